"""Functions, votes, windows, sources, flattening, providers and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from failscope.functions import text as X
from failscope.operators import agreement as A
from failscope.operators import flatten as L
from failscope.operators import windows as W
from failscope.plans import provider as P
from failscope.sources import bson as B
from failscope.sources import files as S
from failscope.streaming import resumable as R


@pytest.mark.parametrize(("domain", "gold", "answer", "ok"), [
    ("GSM8K", "70000", "The profit is $70,000.", True), ("GSM8K", "70000", "The profit is $50,000.", False), ("GSM8K", "1200", "Answer: 1,200", True), ("GSM8K", "-5", "the result is -5 degrees", True),
    ("SealQA", "Paris", "The capital is Paris, France.", True), ("SealQA", "Paris", "The capital is Berlin.", False), ("MedBrowseComp", "aspirin reduces fever", "aspirin reduces fever in patients", True),
    ("GSM8K", "", "70000", False), ("GSM8K", "70000", "", False), ("GSM8K", None, "1", False), (None, "a b", "b a", True),
])
def test_verify_answer(spark, domain, gold, answer, ok):
    df = spark.createDataFrame([(domain, gold, answer)], "d string, g string, a string")
    assert df.select(X.verify_answer(F.col("d"), F.col("g"), F.col("a")).alias("x")).first().x is ok


def test_text_functions(spark):
    df = spark.createDataFrame([("  abcdef ", "```python\nx=1\n```", " escelate / RETRY", "I would RETRIEVE_MORE, not RETRY", '```json\n{"action": "retry", "confidence": 1.7}\n```')], "a string, b string, c string, d string, e string")
    r = df.select(X.truncate(F.col("a"), 3, "~").alias("a"), X.code_block(F.col("b")).alias("b"), X.normal_label(F.col("c")).alias("c"), X.parse_action(F.col("d")).alias("d"), X.parse_prediction(F.col("e")).alias("e"), X.head_tail(F.col("a"), 4, marker="|").alias("h")).first()
    assert (r.a, r.b, r.c, r.d, tuple(r.e), r.h) == ("abc~", "x=1", "ESCALATE", "RETRIEVE_MORE", ("RETRY", 1.0), "  |f ")
    pages = spark.createDataFrame([("<p>a<script>x<b>y</b></script> b &amp; c</p><style>z</style>",), (None,), ("",)], "p string")
    assert [x.t for x in pages.select(X.html_text("p").alias("t")).collect()] == ["a b & c", None, ""]


def test_majority_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "RETRY", "REPLAN", None), (2, None, "?", None), (3, "REPLAN", "RETRY", "retry ")], "k int, a string, b string, c string")
    got = {r.k: (r.majority, r.agreement, r.n_votes) for r in A.majority(df, "k", ["a", "b", "c"]).collect()}
    assert got == {1: ("RETRY", 0.5, 2), 2: (None, None, 0), 3: ("RETRY", 0.666667, 3)}


def test_kappa_edges(spark):
    same = spark.createDataFrame([("g", "RETRY", "RETRY")] * 3 + [("h", "RETRY", "REPLAN"), ("h", "REPLAN", "RETRY")], "g string, a string, b string")
    assert {r.g: r.kappa for r in A.kappa(same, ["g"], "a", "b").collect()} == {"g": 1.0, "h": -1.0}
    assert A.kappa(same.limit(0), ["g"], "a", "b").count() == 0


def test_windows(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", None, "c")], "k string, o int, v string")
    assert {r.k: r.v for r in W.last_wins(df, ["k"], ["o"]).collect()} == {"k": "b", "l": "c"}
    n = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert W.ordinals(n, ["x"]).filter("ordinal <> x + 1").count() == 0
    lab = spark.createDataFrame([("A", f"a{i}") for i in range(50)] + [("B", f"b{i}") for i in range(5)] + [("C", "c1"), ("C", "c2")], "label string, id string")
    got = {(r.label, r.split): r["count"] for r in W.stratified_split(lab, "label", "id").groupBy("label", "split").count().collect()}
    assert got == {("A", "train"): 40, ("A", "dev"): 5, ("A", "test"): 5, ("B", "train"): 3, ("B", "dev"): 1, ("B", "test"): 1, ("C", "train"): 2}


DOC = {
    "run_id": "r1", "experiment_name": "ablation_minimality_gsm8k", "stats": {"accuracy": 0.5}, "passing_traces": [{"problem_id": 1, "success": None, "trace": {"success": True, "steps": [{"text": "a"}]}}],
    "failing_traces": [{"problem_id": "p2", "final_answer": " x", "gold_answer": "x", "trace": {"success": False, "steps": [{"step_id": 5, "tool_name": "web"}, {"step_id": 5, "tool_name": "later"}, {"text": "é"}]}, "analysis": {
        "counterfactual_repair": {"successful_repairs": [{"repaired_text": "fix"}, "no"], "num_successful_repairs": 0}, "multi_agent_critique": {"critique_details": {"5": {"judge_ensemble": [{"agent": "J", "agrees": True}]}, "x": {"judge_ensemble": [{"agent": "K"}]}}, "consensus_steps": [{"step_id": 5}]}}}],
}


def test_bson_and_flatten(spark, tmp_path):
    (tmp_path / "a.bson").write_bytes(B.encode(DOC) + B.encode({"run_id": "r2", "experiment_name": "GSM8K"}))
    (tmp_path / "empty.bson").write_bytes(b"")
    raw = B.read_bson(spark, str(tmp_path), str(tmp_path / "none.bson"), missing="ignore")
    assert json.loads(raw.orderBy("ordinal").first().doc) == DOC
    t = {k: v.collect() for k, v in L.flatten(raw).items()}
    assert {k: len(v) for k, v in t.items()} == {"runs": 2, "traces": 2, "triage_labels": 1, "steps": 3, "repair_attempts": 1, "judge_votes": 2, "consensus_steps": 1, "trace_metrics": 1}
    traces = {r.trace_id: r for r in t["traces"]}
    assert traces["r1::1"].success is None and traces["r1::p2"].success == 0 and traces["r1::p2"].answer_exact_match == 1  # a null doesn't fall through
    assert {r.step_uid: r.tool_name for r in t["steps"]}["r1::p2::step::5"] == "later"
    assert t["triage_labels"][0].num_successful_repair_steps == 2 and t["runs"][0].domain in ("GSM8K",)
    assert sorted(r.step_uid for r in t["judge_votes"]) == ["r1::p2::step::5", "r1::p2::step::None"]
    assert L.flatten(raw, include_ablations=False)["runs"].count() == 1
    with pytest.raises(Exception, match="none.bson"):
        B.read_bson(spark, str(tmp_path / "none.bson")).count()
    with pytest.raises(ValueError):
        B.document(B.Cursor(b"\x08\0\0\0\x7fa\0\0"))


def test_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"trace_id": "a", "v": 1}\n\n{"trace_id": "a", "v": 2}\n')
    assert [r.v for r in S.read_jsonl_last(spark, str(tmp_path / "l.jsonl"), "trace_id string, v int", ["trace_id"]).collect()] == [2]
    assert S.read_jsonl(spark, str(tmp_path / "no.jsonl"), "a int", missing="empty").count() == 0
    (tmp_path / "b.csv").write_text('﻿Trace #,P1\n1,"a\nb"\n')
    assert S.read_csv(spark, str(tmp_path / "b.csv"), ["Trace #"]).first()["P1"] == "a\nb"
    with pytest.raises(ValueError):
        S.read_csv(spark, str(tmp_path / "b.csv"), ["P9"])
    (tmp_path / "p1.json").write_text('{"t": {"action": "RETRY"}}')
    (tmp_path / "p2.json").write_text('{"t": {"action": "REPLAN"}}')
    assert S.read_json_maps(spark, str(tmp_path / "p*.json")).first().action == "REPLAN"
    df = spark.createDataFrame([("a", "X", "train"), ("b", "Y", "test")], "trace_id string, label string, split string")
    m = S.write_split_files(df, "label", str(tmp_path / "splits"))
    assert m["total_rows"] == 2 and S.verify_manifest(str(tmp_path / "splits")) == []
    (tmp_path / "splits" / "test.csv").write_text("changed")
    assert S.verify_manifest(str(tmp_path / "splits")) == ["test"]
    t = str(tmp_path / "t.parquet")
    S.upsert(spark, t, spark.createDataFrame([("a", 1)], "k string, v int"), ["k"], ["v"])
    S.upsert(spark, t, spark.createDataFrame([("a", 2), ("b", 1)], "k string, v int"), ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(t).collect())) == [("a", 2), ("b", 1)]
    assert S.content_hash(df, ["trace_id"]).first() == S.content_hash(df.orderBy(F.desc("trace_id")), ["trace_id"]).first()


def _fails_on_bad(prompts):
    if any("bad" in p for p in prompts):
        raise RuntimeError("no")
    return [(p.upper(), 1, 1) for p in prompts]


def test_provider(spark):
    req = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id int, q string")
    got = P.ask(req, _fails_on_bad, ["id"], "q", tries=2, pause=0.0)
    assert {r.id: (r.reply, r.error is None) for r in got.collect()} == {1: ("GOOD", True), 2: (None, False), 3: ("FINE", True)}
    assert [r.id for r in P.resume(req, got, ["id"]).collect()] == [2]
    ok, bad = P.split_errors(got)
    assert ok.count() == 2 and bad.count() == 1


def test_streams(spark, tmp_path):
    src, out, err, ck = (str(tmp_path / x) for x in ("src", "out", "err", "ck"))
    rows = [("t1", "RETRY", None), ("t1", "RETRY", None), ("t2", "RETRY", "boom")]
    spark.createDataFrame(rows, "trace_id string, action string, error string").withColumn("ts", F.current_timestamp()).coalesce(1).write.json(src)
    R.append_new(R.read_log(spark, src), ["trace_id", "action"], out, ck, err).awaitTermination()
    assert spark.read.parquet(out).count() == 1 and spark.read.parquet(err).count() == 1
    q = R.running_totals(R.read_log(spark, src), ["action"]).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("totals").first().n == 3


def test_entry_without_llm(monkeypatch):
    import sys

    import __spark_entry__ as E

    monkeypatch.setitem(sys.modules, "failscope.llm", None)
    names = E.queries()
    assert "p5_found" in names and "p1_found" not in names and set(E.oracle_sql()) <= set(names)


def test_full_trace_has_all_steps(spark):
    from failscope.functions import text

    traces = spark.createDataFrame([("t", "D", "p1", "Q?", "4", "The end", 0), ("u", None, None, None, None, None, None)], "trace_id string, domain string, problem_id string, problem_statement string, gold_answer string, final_answer string, answer_exact_match int").withColumn("num_steps", F.lit(45))
    steps = spark.createDataFrame([("t", i, f"s{i:02}", i, "tool_call", f"text {i}", "web" if i else None, f"out {i}" if i else None, 1) for i in range(45)], "trace_id string, step_index int, step_uid string, step_id int, step_type string, text string, tool_name string, tool_output_json string, tool_call_result int").withColumn("tool_args_json", F.lit(None).cast("string")).withColumn("has_tool", F.lit(0))
    sus = spark.createDataFrame([("t", 40, 0.5, 1, 0, "why")], "trace_id string, step_id int, consensus_score double, is_repairable_step int, has_successful_repair int, final_critic_summary string")
    got = {r.trace_id: r for r in text.text_views(traces, steps, sus).collect()}
    steps_of = "\n".join(f"[STEP {i}] type=tool_call" + (f" tool=web\n  text {i}\n  output: out {i}" if i else f"\n  text {i}") for i in range(45))
    assert got["t"].full_trace == f"[DOMAIN] D\n[PROBLEM] Q?\n{steps_of}\n[FINAL_ANSWER] The end"
    assert got["t"].verifier_feedback_only == "[DOMAIN] D\n[PROBLEM_ID] p1\n[GOLD_ANSWER] 4\n[AGENT_FINAL_ANSWER] The end\n[ANSWER_EXACT_MATCH] 0"
    near = got["t"].causal_neighborhood.split("\n")
    assert [x for x in near if x.startswith("[STEP")] == [f"[STEP {i}] type=tool_call tool=web" for i in range(38, 43)] and "[SUSPICIOUS_STEP] score=0.5 repairable=1 successful_repair=0" in near and "[CRITIC_SUMMARY] why" in near
    assert got["u"].causal_neighborhood.endswith("unavailable") and "[TOOL_FAILURE_RATE] 0.0" in got["u"].trace_stats_only and "[NUM_TOOL_CALLS] 44.0" in got["t"].trace_stats_only
    assert got["u"].full_trace == "[DOMAIN] None\n[PROBLEM] None\n[FINAL_ANSWER] None"


def test_cross_domain_holds_out_every_domain(spark):
    from pyspark.sql import functions as F

    from failscope.operators import ml

    spelt = [f"Domain {i:02}" for i in range(60)] + [f" domain-{i:02}" for i in range(60)] + [None, "?", "rare"]
    data = spark.createDataFrame([(x,) for x in spelt], "domain string").withColumn("domain", ml.domain_key(F.col("domain")))
    assert ml.held_out_domains(data, 2) == ["?"] + [f"domain{i:02}" for i in range(60)]


def test_label_and_name_constants(spark):
    """The three known slips wherever they stand, the spellings of domains, and the prefixes of ablations."""
    df = spark.createDataFrame([("ESCELATE", "SealQA Hard", "ablation_nogold_mbpp"), ("repplan/retry", "medbrowse", "ablation_minimality_gsm8k"), ("Repan ", "humaneval", "ablation_style_x"), ("RETYR", "other", "gsm8k"), (None, "", None)], "a string, b string, c string")
    got = [tuple(r) for r in df.select(X.normal_label(F.col("a")), X.domain_of(F.col("b")), X.benchmark_of(F.col("c")), X.ablation_of(F.col("c"))).collect()]
    assert got == [("ESCALATE", "SealQA", "mbpp", "nogold"), ("REPLAN", "MedBrowseComp", "gsm8k", "minimality"), ("REPLAN", "Humaneval", "ablation_style_x", "style"), (None, "other", "gsm8k", None), (None, None, None, None)]


def test_kappa_without_common_rows_is_zero(spark):
    from failscope.operators import agreement

    df = spark.createDataFrame([("g", "RETRY", None), ("g", None, "RETRY"), ("h", "RETRY", "RETRY")], "g string, a string, b string")
    assert sorted((r.g, r.n, r.kappa) for r in agreement.kappa(df, ["g"], "a", "b").collect()) == [("g", 0, 0.0), ("h", 1, 1.0)]


def test_word_pairs(spark):
    from failscope.operators import ml

    df = spark.createDataFrame([("Fix the tool",), ("a",), (None,)], "t string")
    assert [r[0] for r in df.select(ml.terms(F.col("t"))).collect()] == [["fix", "the", "tool", "fix the", "the tool"], [], []]
