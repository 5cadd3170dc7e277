"""The dealt operators: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; brute force where SQL can't tell."""

import itertools
import json
import random
import re
import time
from collections import Counter
from datetime import datetime

import numpy as np
import pytest

from failscope.llm import bpe, consensus, fragments, grouped_split, leakage, pairs, residue, splits_overlap, truncation

T1, T2 = datetime(2025, 1, 1), datetime(2025, 2, 1)

# 1 pairs


def test_pairs_rules():
    assert pairs.is_empty(None) and pairs.is_empty(" \t") and pairs.is_empty("(no answer)") and pairs.is_empty("N/A") and not pairs.is_empty("0") and not pairs.is_empty("-5")
    for s in ("I’m sorry, but I can't help with this request.", "**Unfortunately I won't be able to assist with the question.**", "Lo siento, no puedo ayudar con esa petición.", "This request can't be fulfilled."):
        assert pairs.is_refusal(s)
    for s in ("I could not find the first register, but the second one names Zed.", "The agent cannot verify the date because the page was empty."):
        assert not pairs.is_refusal(s)
    q = "A ferry carries 14 wagons and returns with 9. How many wagons stand on the far bank?"
    assert pairs.is_copy(q.upper(), q) and pairs.is_copy("How many wagosn stand on the far bank", q) and not pairs.is_copy("You ask: How many wagons stand on the far bank? The answer is 30.", q) and not pairs.is_copy("9", q)
    assert pairs.other_language("Der Preis sinkt auf 9 Münzen, wenn der Rabatt für alle gilt.", q) and not pairs.other_language("The plaque reads “Wenn es regnet, bleiben wir hier.” and was put up in Pell by Zed.", q)
    assert pairs.code_cut("def f(rows, k):\n    kept = [") and pairs.code_cut("def f(a):\n    if not a:\n        return None") and not pairs.code_cut("def f(a):\n    return a[1:]")


def brute_tiles(a, s, least=3):
    """Longest common runs by trying all."""
    ma, ms = [False] * len(a), [False] * len(s)
    while True:
        runs = [(k, -i, -j) for i in range(len(a)) for j in range(len(s)) for k in range(least, min(len(a) - i, len(s) - j) + 1) if a[i : i + k] == s[j : j + k] and not any(ma[i : i + k]) and not any(ms[j : j + k])]
        if not runs:
            return ma
        k, i, j = max(runs)
        for x in range(k):
            ma[-i + x] = ms[-j + x] = True


def test_tiling_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a, s = ([rng.choice("1234") for _ in range(12)] for _ in range(2))  # digits are no misspelling
        assert pairs.tiled(a, s) == brute_tiles(a, s)


def test_tiling_of_long_texts_is_fast():
    rng = random.Random(8)
    long = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10_000)]
    began = time.process_time()
    assert all(pairs.tiled(long[2000:9000], long)) and all(pairs.tiled(["x"] * 3000, ["x"] * 3000))
    assert time.process_time() - began < 30


def test_scripts():
    assert [pairs.language(t) for t in ("Πού είναι το κλειδί;", "鍵はどこですか", "钥匙在哪里", "Где ключ от дома", "열쇠가 어디에 있습니까", "The key of the house")] == ["el", "ja", "zh", "ru", "ko", "en"]


def _traces(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x") for r in rows], "trace_id string, problem_id string, domain string, problem_statement string, gold_answer string, final_answer string, ingested_at timestamp, s string, kind string")


def test_pairs_frame(spark):
    full = "The price falls to 5 coins when the discount is applied to all 9 drums."
    traces = _traces(spark, [
        ("t1", "p", "D", "What is the price of the drums?", None, full, T1), ("t1", "p", "D", "What is the price of the drums?", None, full, T2), ("t2", "p", "D", None, "12", "The price falls to 77 coins when the discount is app", T1),
        ("t3", None, None, "Q of the thing?", "Draani Zed", "x " * 50_000 + "end.", T1), ("t4", "q", "D", "", "", "   ", None), (None, None, None, None, "a", "b", None),
    ])
    labels = spark.createDataFrame([("t1", "RETRY", None, T1, "c"), ("t2", None, None, T1, "c"), ("t9", "RETRY", "No answer will be given for safety reasons.", None, "c"), ("t9", "RETRY", "No answer will be given for safety reasons.", None, "c")], "trace_id string, llm_1_action string, llm_1_rationale string, ingested_at timestamp, statement string")
    got = sorted((r.trace_id or "", r.field, r.defect) for r in pairs.defects(traces, labels).collect())
    assert got == [("t1", "gold_answer", "empty"), ("t1", "llm_1_rationale", "empty"), ("t2", "final_answer", "truncated"), ("t4", "final_answer", "empty"), ("t4", "gold_answer", "empty"), ("t9", "llm_1_rationale", "refusal")]
    assert pairs.defects(traces.limit(0), labels.limit(0)).count() == 0


def test_pairs_open_signs(spark):
    """Responses like no other, cut within a fence, bracket, quotation, list item or markup; and the same closed."""
    cut = {
        "bracket": "Vell sold the eighth lamp (see the", "quote": "Nobody answered “we kept", "list": "Steps:\n1. Sell both lamps.\n2.", "strong": "The clerk notes **seven lamps", "inline": "Call `sort_lamps", "fence": "So:\n```python\nx = 1\nprint(x)",
        "tilde": "So:\n~~~\nseven lamps", "after": "```python\nx = 1\n```\nHere x holds (as was",
    }
    whole = {
        "bracket_": "Vell sold the eighth lamp (see the map)", "quote_": "Nobody answered “we kept it”", "list_": "Steps:\n1. Sell both lamps.\n2. Rest", "strong_": "The clerk notes **seven** lamps", "inline_": "Call `sort_lamps`", "fence_": "So:\n```python\nx = 1\n```",
        "times_": "7 ** 2 is 49", "after_": "```python\nx = 1\n```\nHere x holds one lamp", "smile_": "Seven lamps :(", "item_": "a) seven lamps", "line_": "Use ```x = 1``` here", "init_": "Call __init__ twice",
    }
    traces = _traces(spark, [(k, None, None, None, "7", v, T1) for k, v in (cut | whole).items()])
    labels = spark.createDataFrame([], "trace_id string, llm_1_action string, llm_1_rationale string, ingested_at timestamp")
    assert sorted((r.trace_id, r.defect) for r in pairs.defects(traces, labels).collect()) == sorted((k, "truncated") for k in cut)


# 2 truncation


def test_strict_prefixes_match_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    bank, tails = words[:60], words[60:] + words[:5]
    want = {t for t in tails if t not in bank and any(b.startswith(t) and b != t for b in bank)}
    for n in (1, 7, 31):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = fragments.strict_prefixes(spark.createDataFrame([(t,) for t in tails], "s string"), spark.createDataFrame([(b,) for b in bank], "s string"))
        assert {r.s for r in got.collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_truncation_frame(spark):
    whole = "The remaining 12 can be split evenly, which leaves 3 for the mill."
    rows = [
        ("s1", whole + " I add a guard.", None), ("s2", whole + " The remaining 9 can be split e", json.dumps({"content": whole + " The remaining 7 can"})), ("s3", "The remaining 12 can be split evenly, which leaves 3 for the mill", '{"a": [1, 2'),
        ("s4", whole + " The rem\n...[cut]", "{'ok': True, 'note': None}"), ("s5", None, ""), ("s6", "   ", "null"), ("s7", (whole + " ") * 3000, json.dumps(json.dumps({"content": whole}))), ("s2", whole + " The remaining 9 can be split e", None), (None, None, None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "step_uid string, text string, tool_output_json string, path string")
    got = sorted((r.step_uid, r.field) for r in truncation.cut_values(df).collect())
    assert got == [("s2", "text"), ("s2", "tool_output_json"), ("s3", "tool_output_json"), ("s4", "text")]
    assert truncation.cut_values(df.limit(0)).count() == 0


def _cut(spark, rows):
    df = spark.createDataFrame(rows, "step_uid string, text string, tool_output_json string")
    return {r.step_uid for r in truncation.cut_values(df).collect()}


KNOWN = [
    "Let me check whether the wagon is the same as the “amber clock” named earlier.", "I assume that Perovic works every morning and rests afterwards.", "The remaining 12 can be split evenly, which leaves 3 for the mill.",
    "It lists 31 gloves and a hinge.", "The lamp of Nevald was sold to the shop.", "A letter from Osterdal came late.",
]


def test_rare_cut_prose(spark):
    """Tails whose whole fragment occurs nowhere else."""
    cut = {
        "quote": "Let me check whether the helmet is the same as the “copper", "bracket": "We found it odd (see the seventh", "word": "He lends the mellow shovel they named earl", "opener": "Hm I assume that Tamelle works every afternoon and rests afterwar",
        "window": "Let me check whether the boat is the same as the “mellow shovel” named", "dots": "Let me check whether the boat is the same as the “mellow shovel” named ear...", "name": "Yesterday came a note from the clerk of Os",
    }
    whole = {
        "stop": "I assume that Perovic works every morning and rests afterwards", "odd": "Let me check whether the boat is the same as the “mellow shovel” named earlier", "singular": "We keep one old glove", "dots2": "I assume that Perovic works every morning and rests afterwards...",
        "closed": "We keep (in Vell) the “old bell”", "inch": 'The oar is 5" by 7" wide and old', "clause": "Today the rest can be split evenly",
    }
    assert _cut(spark, [(k, v, None) for k, v in (cut | whole).items()] + [(f"k{i}", v, None) for i, v in enumerate(KNOWN)]) == set(cut)


def test_cut_values_under_any_key(spark):
    """A source that cuts most values of a key, keys that are data, short values, and prose that holds an equation."""
    out = lambda **v: json.dumps(v)
    whole = {f"w{i}": out(content=KNOWN[0], title=f"The lamp of {n}") for i, n in enumerate(("Nevald", "Osterdal", "Tamekko"))} | {"kw": json.dumps({"Lima": "The lamp of Nevald"})}
    cut = {f"c{i}": out(content=v) for i, v in enumerate(("I assume that Tamelle works every morning and rests afterwar", "The remaining 7", "The remaining 9 can be sp", "I assume that", "It lists 4 glo", "A letter"))}
    cut |= {"k1": json.dumps({"Tokyo": "I assume that Tamelle works every mor"}), "k2": json.dumps({"Paris": {"São Tomé": "The remaining 7 can"}}), "t": out(title="A letter from Oster", content=KNOWN[1])}
    texts = {"eq": "total = 34, so the rest goes to the shop. The remaining 8 can be split eve"}
    codes = {"code": "total = 34", "code2": "def f(a):\n    kept = [a]\n    return kept"}
    cut_codes = {"cc": "def f(a):\n    if not a:\n        return None"}
    rows = [(k, None, v) for k, v in (whole | cut).items()] + [(k, v, None) for k, v in (texts | codes | cut_codes).items()] + [(f"k{i}_", v, None) for i, v in enumerate(KNOWN)]
    assert _cut(spark, rows) == {*cut, *texts, *cut_codes}


# 3 consensus


def test_labels_recognised():
    ok = {"retry.": 1, "RETYR": 1, "Re plan": 2, '"TOOL_FIX"': 4, "ESKALATE": 5, "LOCAL_REPAIR / RETRY": 0, "LocalRepair\t": 0}
    assert {k: consensus.recognised(k) for k in ok} == ok
    assert all(consensus.recognised(x) == -1 for x in (None, "", "?", "N/A", "skip", "unsure", " "))


def test_model_beats_majority_and_finds_copying():
    rng = np.random.default_rng(0)
    n = 4000
    truth = rng.integers(0, 6, n)
    # annotators that outvote the careful ones by copying can't be told from them; a pair can
    votes = np.stack([np.where(rng.random(n) < acc, truth, rng.integers(0, 6, n)) for acc in (0.9, 0.8, 0.5, 0.3)], axis=1)
    copied = np.where(rng.random(n) < 0.8, votes[:, 3], rng.integers(0, 6, n))
    votes = np.concatenate([votes, copied[:, None]], axis=1)
    model = consensus.CommunityModel(votes, np.ones(n))
    majority = np.array([Counter(v).most_common(1)[0][0] for v in votes.tolist()])
    assert (model.post.argmax(1) == truth).mean() > (majority == truth).mean() + 0.02 and (model.post.argmax(1) == truth).mean() > 0.88
    assert model.copy[3, 4] > 0.5 and model.copy[0, 1] == 0


def test_consensus_frame(spark):
    rows = [("a", "RETRY", "retry", None, "?", "REPLAN", None), ("a", "RETRY", "retry", None, "?", "REPLAN", None), ("b", None, None, None, None, None, None), ("c", "REPLAN", "REPLAN", "REPLAN", "", "x", "y"), (None, "RETRY", None, None, None, None, None)]
    df = spark.createDataFrame([(*r, T1, "clash") for r in rows], "trace_id string, P1 string, P2 string, P3 string, P4 string, P5 string, P6 string, audited_at timestamp, label string")
    got = {r.trace_id: r for r in consensus.consensus(df).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].label == "RETRY" and got["c"].label == "REPLAN" and got["b"].agreement is None
    assert consensus.consensus(df.limit(0)).count() == 0
    assert consensus.annotator_reliability(df.limit(0)).count() == 6


def test_consensus_beyond_the_bound_is_summed_by_tasks(spark):
    rng = random.Random(7)
    rows = [(f"t{i}", *[rng.choice([a] * 6 + [None, "RETRY", "ESCALATE"]) for _ in range(7)], T1) for i, a in ((i, consensus.ACTIONS[i % 6]) for i in range(300))]
    seven = [f"P{j}" for j in range(1, 8)]
    df = spark.createDataFrame(rows, "trace_id string, " + ", ".join(f"{c} string" for c in seven) + ", audited_at timestamp")
    near = {r.trace_id: (r.label, r.agreement) for r in consensus.consensus(df, seven).collect()}
    bound, rounds = consensus.MAX_PATTERNS, consensus.CommunityModel.__init__.__defaults__
    try:
        consensus.MAX_PATTERNS = 10
        consensus.CommunityModel.__init__.__defaults__ = (*rounds[:2], 12, rounds[3])
        far = {r.trace_id: (r.label, r.agreement) for r in consensus.consensus(df, seven).collect()}
    finally:
        consensus.MAX_PATTERNS, consensus.CommunityModel.__init__.__defaults__ = bound, rounds
    assert sum(near[k] == far[k] for k in near) >= 298 and len(far) == 300
    assert sum(near[f"t{i}"][0] == consensus.ACTIONS[i % 6] for i in range(300)) >= 290


def test_digamma():
    assert abs(consensus.digamma(np.array(1.0)) + 0.5772156649015329) < 1e-9 and abs(consensus.digamma(np.array(0.5)) + 1.9635100260214235) < 1e-8 and abs(consensus.digamma(np.array(30.0)) - 3.384438142) < 1e-8


# 4 overlap


def test_same_problem():
    c = splits_overlap.canonical
    a = "Perorin gives 65 drums to a teacher and lends 4 to the school. Rent rises from 185 to 201 coins. How many trips are needed?"
    for b in ("Q: " + a.upper(), a.replace("drums", "durms") + " Think step by step.", a.replace(" 4 ", " four ").replace("How many", "What number of"), "Rent rises from 185 to 201 coins. Perorin gives 65 drums to a teacher and lends 4 to the school. How many trips are needed?", f"<p>{a}</p>"):
        assert splits_overlap.same_problem(c(a), c(b)), b
    for b in (a.replace("Perorin", "Perald"), a.replace("65", "66"), a.replace("65", "X").replace(" 4 ", " 65 ").replace("X", "4"), a.replace("185 to 201", "201 to 185")):
        assert not splits_overlap.same_problem(c(a), c(b)), b
    assert c("It was -8 or twenty one") == "it was -8 or 21"
    assert c("one hundred and five mills, a hundred carts and two") == "105 mills 100 carts and 2" and c("two thousand three hundred and forty-one") == "2341" and c("one two three") == "1 2 3"
    assert c("1.50 or 3.0 or 1,200 or 1200.25") == "1.5 or 3 or 1200 or 1200.25" and c("one hundred and a boat, a thousand of five") == "100 and a boat 1000 of 5"


def test_overlap_frame(spark):
    base = "{} gives {} drums to a teacher and lends 4 to the school in {}. How many trips to {} are needed to carry all the sacks?"
    p1, p2, p3 = base.format("Perorin", 65, "Vell", "Mar"), base.format("Dunald", 65, "Vell", "Mar"), base.format("Perorin", 66, "Vell", "Mar")
    st = {"a1": p1, "a2": p1.replace("teacher", "taecher"), "a3": "Task: " + p1.upper(), "b1": p2, "b2": p2, "c1": p3, "n": None, "x": p1, "u": p1, "d1": " ".join([p1] * 400), "d2": " ".join([p1] * 400)}
    sp = {"a1": "train", "a2": " Validation", "a3": "TEST", "b1": "train", "b2": "dev", "c1": "test", "n": "test", "u": None, "zz": "dev", "d1": "train", "d2": "test"}
    traces = spark.createDataFrame([(k, "B", v, T1, 1) for k, v in st.items()] * 2, "trace_id string, benchmark string, problem_statement string, ingested_at timestamp, key int")
    labels = spark.createDataFrame([(k, v, T1, "c") for k, v in sp.items()] * 2, "trace_id string, split string, ingested_at timestamp, sig string")
    got = sorted((r.trace_id_a, r.trace_id_b) for r in splits_overlap.overlapping_traces(traces, labels).collect())
    assert got == [("a1", "a2"), ("a1", "a3"), ("b1", "b2"), ("d1", "d2")]
    assert splits_overlap.overlapping_traces(traces.limit(0), labels).count() == 0


def test_overlap_is_the_same_for_any_partitioning(spark):
    """Slips, a third of all texts with one ending, and texts of another name that share everything else."""
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("bdklmnrstv") + rng.choice("aeiou") for _ in range(4)).capitalize()
    st, sp, want = {}, {}, set()
    for i in range(120):
        a, b, n = name(), name(), rng.randint(10, 60)
        text = f"{a} sells {n} lamps to the mill in the valley and {b} keeps the rest for the winter market."
        if i % 3 == 0:
            text += " Nobody may count the lamps again before the bell of the old tower has rung, and how many lamps are left?"
        slip = text.replace("valley", "vallye") if i % 2 else text.replace("sells", "selsl")
        st |= {f"t{i}": text, f"e{i}": slip, f"c{i}": text.replace(a, name()), f"d{i}": text.replace(b, name())}
        sp |= {f"t{i}": "train", f"e{i}": "test", f"c{i}": "train", f"d{i}": "train"}
        want.add((f"e{i}", f"t{i}"))
    traces = spark.createDataFrame([(k, "B", v, T1) for k, v in st.items()], "trace_id string, benchmark string, problem_statement string, ingested_at timestamp")
    labels = spark.createDataFrame([(k, v, T1) for k, v in sp.items()], "trace_id string, split string, ingested_at timestamp")
    texts = spark.createDataFrame([(1, i, splits_overlap.canonical(v)) for i, v in enumerate(sorted(st.values()))], "bucket bigint, n bigint, canon string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spans = []
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spans.append(sorted(map(tuple, splits_overlap.shared_spans(texts).collect())))
    assert spans[0] == spans[1] == spans[2]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = {(r.trace_id_a, r.trace_id_b) for r in splits_overlap.overlapping_traces(traces, labels).collect()}
    assert got == want


# 7 grouped split


def test_allocation_is_whole_and_near_quotas():
    bundles = [(1, "A", 700), (2, "A", 60), (3, "B", 50), (1, "B", 100), (90, "A", 1), (7, None, 9)]
    many = [(z, "AB"[z % 2], 1 + z % 3) for z in range(1, 9000)]  # no sizes are merged, however many there are
    for bundles, off in ((bundles, 10), (many, 10)):
        _check_allocation(bundles, off)


def _check_allocation(bundles, off):
    out = grouped_split.allocate(bundles)
    assert all(sum(o) == b[2] and min(o) >= 0 for o, b in zip(out, bundles))
    total = sum(b[0] * b[2] for b in bundles)
    for s, p in enumerate(grouped_split.PROPORTIONS):
        assert abs(sum(o[s] * b[0] for o, b in zip(out, bundles)) - p * total) <= off


def test_min_cost_flow_is_optimal():
    rng = random.Random(3)
    for _ in range(40):  # against all assignments of unit supplies
        cost = [[rng.randint(0, 5) for _ in range(2)] for _ in range(4)]
        arcs = [(0, 1 + i, 1, 0) for i in range(4)] + [(1 + i, 5 + j, 1, cost[i][j]) for i in range(4) for j in range(2)] + [(5, 7, 2, 0), (6, 7, 2, 0)]
        f = grouped_split._min_cost_flow(8, arcs, 0, 7)
        got = sum(x * a[3] for x, a in zip(f, arcs))
        want = min(sum(cost[i][c[i]] for i in range(4)) for c in itertools.product(range(2), repeat=4) if sum(c) == 2)
        assert sum(f[:4]) == 4 and got == want


def test_grouped_split_frame(spark):
    rows = [("a", "train", "canary_1", "D", "X"), ("b", "dev", " Canary-01", "d ", "X"), ("b", "dev", " Canary-01", "d ", "X"), ("c", "test", "gsm8k_10", "D", None), ("d", "train", "gsm8k_1", "D", None), ("e", None, "canary1", "D", None), ("f", "train", None, "D", None), ("g", "dev", "canary1", None, None)]
    df = spark.createDataFrame([(*r, T1, "x") for r in rows], "trace_id string, split string, problem_id string, domain string, action_label string, ingested_at timestamp, problem string")
    lab = grouped_split.labelled(df)
    assert sorted(r.trace_id for r in grouped_split.torn_records(lab).collect()) == ["a", "b"]
    new = {r.trace_id: r.new_split for r in grouped_split.assign_splits(lab).collect()}
    assert len(new) == 7 and new["a"] == new["b"] == new["e"] and new["f"] is not None
    assert grouped_split.assign_splits(lab.limit(0)).count() == 0 and grouped_split.torn_records(lab.limit(0)).count() == 0


def test_components_of_several_keys(spark):
    """Records that share a problem or a domain, directly or through others, stay together; nulls link nothing."""
    rows = [("a", "train", "p1", None), ("b", "test", "p1", "x"), ("c", "train", "p2", "x"), ("d", "train", "p3", "y"), ("e", None, None, "y"), ("f", "dev", None, None), ("g", "train", None, None)]
    df = spark.createDataFrame([(i, s, p, a, "L") for i, s, p, a in rows], "trace_id string, split string, problem string, author string, label string")
    keyed = {r.trace_id: r.component for r in grouped_split.with_components(df, ("problem", "author")).collect()}
    assert keyed["a"] == keyed["b"] == keyed["c"] != keyed["d"] == keyed["e"] and len({keyed[x] for x in "adfg"}) == 4
    assert sorted(r.trace_id for r in grouped_split.torn_records(df, ("problem", "author")).collect()) == ["a", "b", "c"]
    new = {r.trace_id: r.new_split for r in grouped_split.assign_splits(df, keys=("problem", "author")).collect()}
    assert len(new) == 7 and new["a"] == new["b"] == new["c"] and new["d"] == new["e"]


# 8 encoding


@pytest.fixture(scope="session")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/{bpe.VOCABULARY}.json")
    t.encode_special_tokens = True
    return t


def test_encoding_matches_the_library(library):
    rng = random.Random(4)
    bits = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "é", "１", "²", "٣", "你", "!", "??", "<|endoftext|>", "ab", "​", "i̇", "🙂", "12", "0" * 40, "the", " the"]
    enc = bpe.encoder()
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x" * 5000, "abab" * 3000, " " * 3000, "".join(rng.choice("abcdefg") for _ in range(20_000))]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert enc.encode(t) == e.ids, t[:80]


def test_encoding_frame(spark):
    df = spark.createDataFrame([(1, "Hello"), (2, ""), (3, None), (3, None), (None, " a"), (5, "a" * 2_000_000)], "doc_id bigint, text string").selectExpr("*", "array(9) as ids")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()]
    assert [x for x in got if x[0] != 5] == [(1, [15496]), (2, []), (3, []), (3, []), (None, [257])]
    spelled = b"".join(bpe.encoder().spelling[i] for i in next(x for x in got if x[0] == 5)[1])
    assert spelled == b"a" * 2_000_000
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# 9 leakage

ITEM = "Of the 31 apprentices sent to Yarrowfell, only Brimiven learned to measure a clever letter. Whoever keeps the brittle bottle past Friday must pay Tamovic."


def srt(words, per=4):
    cues = [" ".join(words[i : i + per]) for i in range(0, len(words), per)]
    return "".join(f"{n}\r\n00:00:0{n % 10},000 --> 00:00:09,000\r\n<i>{c}</i>\r\n\r\n" for n, c in enumerate(cues, 1))


def test_leaks(spark):
    w = ITEM.split()
    ocr = " ".join(w[2:16]).replace("e", "c").replace("m", "rn")
    docs = [
        (1, srt(["Wait."] + w[3:15] + ["Run."])), (2, srt(w[3:14])), (3, "{1}{2}" + "|".join(w[0:13])), (4, ocr), (5, srt(w).replace("Brimiven", "Caldira").replace("Yarrowfell", "Pellwick").replace("bottle", "ladder").replace("31", "77")),
        (6, None), (7, ""), (8, "word " * 200_000 + " ".join(w[4:18])), (9, srt(w[:6]) + "7\n00:00:01,000 --> 00:00:02,000\n(wind howling)\nMOTHER: " + " ".join(w[6:14])), (1, srt(w)),
    ]
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id bigint, text string, item_text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, 1), (8, "too short", 1), (9, None, 1), (7, ITEM, 1)], "item_id bigint, text string, doc_id int")
    assert sorted(map(tuple, leakage.leaks(df, items).collect())) == [(1, 7), (3, 7), (4, 7), (8, 7), (9, 7)]
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_index_finds_all_within_radius():
    rng = random.Random(5)
    index = leakage.ItemIndex([(1, ITEM)])
    for _ in range(300):
        k = rng.randrange(len(index.codes))
        code = index.codes[k]
        for b in rng.sample(range(64), rng.randint(0, leakage.RADIUS)):
            code ^= np.uint64(1 << b)
        want = {i for i, c in enumerate(index.codes) if bin(int(c ^ code)).count("1") <= leakage.RADIUS}
        assert set(index.within_radius(code).tolist()) == want and k in want


def test_misread_letters_are_no_way_out():
    """Any one letter of the twelve words misread, and one in each of four words, short ones too."""
    index = leakage.ItemIndex([(1, ITEM)])
    w = [x.strip(".,") for x in ITEM.split()[6:18]]
    misread = lambda x, at: x[:at] + ("q" if x[at] != "q" else "x") + x[at + 1 :]
    for n, x in enumerate(w):
        for at in range(len(x)):
            assert index.leaked(" ".join([*w[:n], misread(x, at), *w[n + 1 :]])) == {1}, (x, at)
    for four in itertools.combinations(range(12), 4):
        got = index.leaked(" ".join(misread(x, len(x) // 2) if n in four else x for n, x in enumerate(w)))
        assert got == {1}, four
    assert not index.leaked(" ".join(misread(x, 0) if n < 5 else x for n, x in enumerate(w)))
    assert leakage._near("tbe", "the") and leakage._near("o", "a") and not leakage._near("on", "a") and not leakage._near("12", "13") and not leakage._near("kettle", "bottle")


# 10 residue


def test_residue(spark):
    yes = ["{{ cue.text }}, we go", "Dear __next_cue__,", "TODO: <%= show.title %>", "&lt;show.title&gt;", "[INSERT name HERE]", "Please enable JavaScript to view this content.", "Plcase cnable JavaScript to vicw this contcnt.", "<html><body><h1>503 Service Unavailable</h1></body></html>", "Lorem ipsum magna sed amet vestra tempora lorem amet.", "Error 404. The requested subtitle file could not be located on this server.", "No se ha encontrado la página solicitada (error 3)."]
    no = ["Turn JavaScript off, it eats the battery.", "I typed lorem ipsum into the brochure and nobody noticed.", "He wrote \"insert name here\" on his own cards.", "Page not found? Then look behind the key.", "Access denied? To me?", "It's 100% sure, {\\an8}50%.", "[SOFT PIANO MUSIC]", "Advertise your product here, contact a.example today", "♪ la ♪", None, "", " \n"]
    rows = [(i, t if t is None else f"1\n00:00:01,000 --> 00:00:02,000\n{t}\n\n2\n00:00:03,000 --> 00:00:04,000\nFine.\n") for i, t in enumerate(yes + no)] + [(0, yes[0]), (99, "Fine. " * 200_000 + "\n\n" + yes[5])]
    df = spark.createDataFrame([(*r, None, "c", "c") for r in rows], "doc_id bigint, text string, source string, message string, rule string")
    assert sorted(r.doc_id for r in residue.residue_documents(df).collect()) == [*range(len(yes)), 99]
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_loose_phrases_need_to_recur(spark):
    docs = [(i, "Permission denied", f"s{i % 2}") for i in range(3)] + [(9, "Access denied again", "s1")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in residue.residue_documents(df).collect()) == [0, 1, 2]


def test_rules_hold_over_breaks_and_styling(spark):
    """Phrases over line breaks, bars and styling, filler, and each kind of strict phrase."""
    phrases = [
        "Consectetur adipiscing elit sed do eiusmod tempor", "Sed magna aliqua enim ad minim veniam", "Quis amet nostrud exercitation ullamco laboris", "Tempora rerum quidem porta verbis", "text text text text", "Sample subtitle line number 5", "asdf asdf qwer asdf", "Hello {% speaker %}, welcome", "<<CHARACTER>>, come", "Something went wrong. Please try again", "Your session has expired", "The name goes here",
        "402 Payment Required", "405 Method Not Allowed", "501 Not Implemented", "503 Service Unavailable", "404 Not Found", "The page could not be found", "Connection timed out", "We are down for maintenance", "You don't have permission to access this", "Proxy at 10.0.0.1",
        "Die angeforderte Seite wurde nicht gefunden", "La pagina richiesta non è stata trovata", "Enter your name here", "Type some text here", "[ add name ]", "[Add your name]",
    ]
    # a number alone on its line is the frame of a cue, so a status keeps its blank
    texts = [re.sub(r"(?<!\d) ", lambda _, sep=sep: sep, p) for p in phrases for sep in (" ", "\n", "|", "\r\n", "<b> ", " <br/>", "  ")]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in residue.residue_documents(docs).collect()) == [*range(len(texts))]
    assert not any(residue.rule_of(residue.mask(m)) for m in residue.folded_messages("Fine.\n\nI could have found the session.\n\nTest, test.\n\nNulla dolor e minima ma non per lei."))


def test_groups_count_documents(spark):
    """A line that one document repeats is one document; a null source is one source; many groups are joined without a broadcast."""
    docs = [(1, "Permission denied\n\nPermission denied\n\nPermission denied", "a"), (2, "Permission denied", None), (2, "Permission denied", None), (3, "Dear {{ name }},", "a"), (4, "Dear __cue__,", "b"), (5, "Dear <%= x %>,", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in residue.residue_documents(df).collect()) == [3, 4, 5]
    got = {r.message: (r.n_docs, r.n_sources, r.recurs) for r in residue.classified_groups(residue.message_rows(df)).collect()}
    assert got == {residue.fold_py("permission denied"): (2, 2, False), f"dear {residue.SLOT},": (3, 3, True)}
    few = residue.BROADCAST_GROUPS
    try:
        residue.BROADCAST_GROUPS = 0
        assert sorted(r.doc_id for r in residue.residue_documents(df).collect()) == [3, 4, 5]
    finally:
        residue.BROADCAST_GROUPS = few
