"""Problem 1: broken prompt and response pairs.

Each response gets at most one defect, tried in this order: `empty`, `refusal` (a grammar of
openings and verbs in several languages), `copy` (greedy string tiling against the problem
statement), `language` (script and function words, quotations left out), `truncated` (pushdown scans:
of code, and of the fences, brackets, quotations, list items and markup of all other responses; and the
sorted prefix search of `fragments` for prose without open signs).

Scale: one narrow pass a table; statements reach the rationales by one equi-join on the trace. Rows
without a statement look it up by problem, after one aggregation. The prefix search sorts distinct
masked fragments only.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm.fragments import DANGLING, after_fences, bare, dangling, fragments, last_name, mask, names, open_markup, open_stack, starts_sentence, strict_prefixes
from failscope.session import checkpointed, require, stored, table, trim_all

_SCHEMA = "kind string, trace_id string, field string, s string, last_name string, defect string"

#: Responses that say nothing, without signs and blanks.
NOTHING = set("na nan none null nil empty blank noanswer nonegiven noanswergiven notavailable notprovided noresponse undefined tbd nothing".split())

_SORRY = (
    r"(?:i'?m (?:very |really |so )?sorry|i am sorry|(?:my )?apologies|sorry|i (?:sincerely )?apologi[sz]e|unfortunately|regrettably|i regret|i'?m afraid|as an? (?:ai |language |large language )*(?:assistant|model|ai)|"
    r"at this point|i must (?:let you know|inform you|say) that|please note that|i have to (?:say|tell you) that)"
)
_CANNOT = (
    r"(?:can ?not|can't|could not|couldn't|am not able|am unable|are not able|won't be able|will not be able|have to decline|must decline|need to decline|will have to decline|decline|refuse|"
    r"do not feel comfortable|don't feel comfortable|am not comfortable|will not|won't|am not (?:allowed|permitted)|may not)"
)
_HELP = r"(?:answer|answering|help|assist|provide|share|discuss|comply|fulfil|fulfill|respond|reply|giving|give|comment|judge|assess|do that|do this|this one|that)"
REFUSALS = [
    rf"^{_SORRY}\b[\s,;:.-]*(?:but |however,? |that )*(?:i )?{_CANNOT}\b[^.]*\b{_HELP}\b",
    rf"^i {_CANNOT}\b[^.]*\b(?:{_HELP})\b[^.]*\b(?:request|question|that|this|information|answer|here|one|trace)\b",
    r"^(?:answering|an answer|a reply|responding)\b[^.]*\b(?:would|will) not be (?:appropriate|given|possible|provided)\b",
    r"^no (?:answer|reply|response) (?:will|can) be (?:given|provided)\b", r"\bthis (?:request|question) (?:can(?:no|')t|cannot|can not|won't|will not) be (?:fulfilled|answered|processed)\b",
    r"^declined\b", r"^i(?:'d| would) (?:rather|prefer) not\b", r"\b(?:outside|beyond) (?:what i (?:may|can|am allowed to)|my permitted|my allowed)\b",
    # German, Spanish, French, Portuguese, Italian, Russian
    r"^(?:es )?tut mir leid\b[^.]*\b(?:nicht|keine)\b", r"\bdarf ich (?:leider )?nicht (?:beantworten|teilen|sagen)\b", r"^(?:leider )?kann ich\b[^.]*\bnicht (?:helfen|beantworten)\b", r"^ich kann\b[^.]*\bnicht (?:helfen|beantworten)\b",
    r"^lo siento\b", r"\bno me es posible (?:responder|ayudar|contestar)\b", r"^no puedo (?:responder|ayudar|contestar|compartir)\b",
    r"^(?:je suis )?désolée?\b", r"\bje ne (?:peux|suis) pas (?:répondre|aider|en mesure)\b", r"\bil ne m'est pas possible\b",
    r"^(?:desculpe|sinto muito|lamento)\b", r"\bnão (?:posso|me é possível) (?:responder|ajudar)\b", r"^mi dispiace\b", r"\bnon posso (?:rispondere|aiutare)\b",
    r"^(?:к сожалению|извините|простите)\b", r"\bне могу (?:ответить|помочь)\b",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))

#: Function words of the languages that are told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for with after before from than which who how what each all are not have has be will when how many never left on at it by an",
    "de": "der die das und ist nicht den dem des ein eine einen für mit auf aus im zum am wie viele von hat noch wenn wird nach ohne bleiben bis deshalb dass doch davon würde wurde",
    "es": "el la los las de que y en un una por con para del se al no hasta cuando cuántos cuántas cuántas le su pero sin más a todo después",
    "fr": "le la les des du et est une un en au aux ne pas que qui dans pour sur il reste quand vaut tout sans après sont ont à jusqu'à donc",
    "pt": "o a os as do da dos das e em um uma no na não que para com por depois até quando é foi são está mais isso à sobram restam",
    "it": "il lo la gli le di e un una che non per con del della dei dopo fino quando è sono nel alla più sul",
}
#: function word -> the languages that have it
_FUNCTION: dict[str, list[str]] = {}
for _k, _v in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_v.split()):
        _FUNCTION.setdefault(_w, []).append(_k)
#: Scripts by their letters, and the language (or group of languages) that is written in each.
SCRIPTS = {
    "ru": "\u0400-\u04ff", "el": "\u0370-\u03ff\u1f00-\u1fff", "ar": "\u0600-\u06ff", "he": "\u0590-\u05ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f", "ko": "\uac00-\ud7af\u1100-\u11ff",
    "ja": "\u3040-\u30ff", "zh": "\u4e00-\u9fff\u3400-\u4dbf",
}
_SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"]{3,}\"")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CODE = re.compile(r"(?m)^\s*(?:def |class |import |from \w+ import |return\b|@\w+)|\blambda\b|^```|^\w+ = ")


def plain(text: str) -> str:
    """Lower case without emphasis and quoting marks, one kind of apostrophe."""
    return " ".join(re.sub(r"[*_`#>~]+", " ", text.lower().replace("’", "'")).split())


def is_empty(text: str | None) -> bool:
    if text is None or not text.strip():
        return True
    letters = re.sub(r"[\W_]+", "", text.lower())
    return not letters or letters in NOTHING


def is_refusal(text: str) -> bool:
    p = plain(text)
    return bool(_REFUSAL.search(p)) and not _CODE.search(text)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().replace("&amp;", " and ").replace("’", "'"))


def _common_runs(answer: list[str], statement: list[str], least: int) -> list[tuple[int, int, int]]:
    """(-length, i, j) of the maximal common runs of `least` or more tokens, found by hashed windows of `least` tokens."""
    places: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(statement) - least + 1):
        places.setdefault(tuple(statement[j : j + least]), []).append(j)
    starts = [(i, places.get(tuple(answer[i : i + least]), ())) for i in range(len(answer) - least + 1)]
    runs = []
    if sum(len(js) for _, js in starts) > 50_000:  # texts that repeat themselves: diagonal by diagonal
        number: dict[str, int] = {}
        a, s = (np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in (answer, statement))
        for d in range(least - len(a), len(s) - least + 1):
            lo, hi = max(0, -d), min(len(a), len(s) - d)
            equal = np.concatenate(([0], (a[lo:hi] == s[lo + d : hi + d]).view(np.int8), [0]))
            edges = np.flatnonzero(np.diff(equal))
            runs += [(-int(q - p), lo + int(p), lo + d + int(p)) for p, q in zip(edges[::2], edges[1::2]) if q - p >= least]
        return runs
    for i, js in starts:
        for j in js:
            if i and j and answer[i - 1] == statement[j - 1]:
                continue  # inside a longer run
            k = least
            while i + k < len(answer) and j + k < len(statement) and answer[i + k] == statement[j + k]:
                k += 1
            runs.append((-k, i, j))
    return runs


def tiled(answer: list[str], statement: list[str], least: int = 3) -> list[bool]:
    """Greedy string tiling: which tokens of the answer lie in tiles of `least` or more tokens that the statement also has.

    The longest common run is marked first, then the longest among what is left, until none is
    long enough; a tile goes on over words that are misspelt forms of what stands there in the statement.
    Common runs are found once and kept by length; a run that later tiles cut into is split when its turn comes.
    """
    marked_a, marked_s = [False] * len(answer), [False] * len(statement)
    queue = _common_runs(answer, statement, least)
    heapq.heapify(queue)
    while queue:
        k, i, j = heapq.heappop(queue)
        k = -k
        free = [not (marked_a[i + x] or marked_s[j + x]) for x in range(k)]
        if not all(free):
            x = 0
            while x < k:
                if free[x]:
                    y = x
                    while y < k and free[y]:
                        y += 1
                    if y - x >= least:
                        heapq.heappush(queue, (x - y, i + x, j + x))
                    x = y
                x += 1
            continue
        for x in range(k):
            marked_a[i + x] = marked_s[j + x] = True
        # a misspelt word doesn't end a tile: it goes on in both directions, over words that are equal or misspelt
        for step, n, m in ((1, i + k, j + k), (-1, i - 1, j - 1)):
            while 0 <= n < len(answer) and 0 <= m < len(statement) and not marked_a[n] and not marked_s[m] and (answer[n] == statement[m] or _misspelt(answer[n], statement[m])):
                marked_a[n] = marked_s[m] = True
                n, m = n + step, m + step
    return marked_a


def _misspelt(a: str, b: str) -> bool:
    if min(len(a), len(b)) < 3 or any(c.isdigit() for c in a + b) or abs(len(a) - len(b)) > 2:
        return False
    x, y = Counter(a), Counter(b)
    return sum(((x - y) + (y - x)).values()) <= 2


_FRAMING = set("question problem task q you ask the statement says please solve following show your work think step by give only final value answer briefly from practice set a is to".split())


def is_copy(text: str, statement: str | None) -> bool:
    """The text repeats the statement, or its closing request, and what is left says nothing of its own."""
    if not statement or _CODE.search(text):
        return False
    a, s = tokens(text), tokens(statement)
    if len(a) < 4:
        return False
    own = [w for w, m in zip(a, tiled(a, s)) if not m]
    if any(any(c.isdigit() for c in w) for w in own):
        return False
    said = [w for w in own if w not in _FRAMING]
    return len(said) <= 0.2 * len(a) and len(own) < 0.5 * len(a)


def language(text: str) -> str | None:
    """The language of a text, by script and function words; None where neither tells."""
    t = _QUOTED.sub(" ", text.lower())
    scores = dict.fromkeys(FUNCTION_WORDS, 0)
    ws = _TOKEN.findall(t)
    if not t.isascii():
        n = sum(map(str.isalpha, t))
        for k, script in _SCRIPTS.items():
            if n and len(script.findall(t)) >= 0.3 * n:
                return k
        scores["de"] += 2 * sum("ß" in w or "ü" in w or "ä" in w for w in ws)
        scores["es"] += 2 * t.count("ñ") + 2 * t.count("¿") + sum("ó" in w or "í" in w for w in ws)
        scores["pt"] += 2 * sum("ã" in w or "õ" in w for w in ws)
        scores["fr"] += 2 * sum("è" in w or "ê" in w or "œ" in w for w in ws)
    for w in ws:
        for k in _FUNCTION.get(w, ()):
            scores[k] += 1
    ranked = sorted(scores.items(), key=lambda x: -x[1])
    (best, n), (_, second) = ranked[0], ranked[1]
    return best if n >= 2 and n > second else None


_statements = lru_cache(4096)(language)


def other_language(text: str, statement: str | None) -> bool:
    if not statement or _CODE.search(text) or len(text.split()) < 3:
        return False
    a = language(text)
    return a is not None and _statements(statement) not in (None, a)


def code_cut(text: str) -> bool:
    """Code whose end is lost: brackets, strings or fences are open, or a block or function has no end."""
    body = text.rstrip()
    if after_fences(body) is None or body.count("```") % 2:
        return True
    body = re.sub(r"```\w*\n?", "", body).rstrip()
    if open_stack(body) or re.search(r"(?:[:=+\-*/%,.&|<>\\]|\b(?:return|in|if|else|for|and|or|not|lambda|def|class|import))$", body):
        return True
    lines = body.split("\n")
    if lines[0].startswith("def ") and len(lines) > 1:
        last = lines[-1]
        step = len(lines[1]) - len(lines[1].lstrip())
        return len(last) - len(last.lstrip()) > step
    return bool(re.fullmatch(r"(?:def|class)\s+\w+\s*", body))


class _Out:
    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.sent: set[tuple[str, str]] = set()

    def known(self, kind: str, s: str) -> None:
        if (kind, s) not in self.sent:
            if len(self.sent) > 500_000:
                self.sent = set()
            self.sent.add((kind, s))
            self.rows.append((kind, None, None, s, None, None))

    def judge(self, trace: str, field: str, text: str | None, statement: str | None, has_action: bool) -> None:
        defect = None
        if text is None:
            defect = "empty" if field != "llm_1_rationale" or has_action else None
            if defect is None:
                return
        elif is_empty(text):
            defect = "empty"
        elif is_refusal(text):
            defect = "refusal"
        elif is_copy(text, statement):
            defect = "copy"
        elif other_language(text, statement):
            defect = "language"
        elif _CODE.search(text) and ((rest := after_fences(text)) is None or rest == text or not rest.strip()):
            defect = "truncated" if code_cut(text) else None
        elif len(text.split()) > 1 and open_markup(text):
            defect = "truncated"
        else:
            whole, tail = fragments(after_fences(text))
            for f in whole:
                self.known("bank", bare(mask(f)))
                for name in names(f):
                    self.known("name", name)
            # a whole value of a few words is a short answer (a name, a thing, an amount) unless it starts or breaks off like a sentence
            if tail is not None:
                ws = tail.split()
                sentence = bool(whole) or len(ws) >= 4 or starts_sentence(tail) or ws[-1] in DANGLING
                m = bare(mask(tail))
                if m and sentence:
                    kind = "dangle" if dangling(tail) else "tail"
                    self.rows.append((kind, trace, field, m, last_name(tail) if whole or len(ws) >= 4 else None, None))
        if defect:
            self.rows.append(("found", trace, field, None, None, defect))

    def flush(self) -> pa.RecordBatch:
        columns = [x.split()[0] for x in _SCHEMA.split(", ")]
        values = list(zip(*self.rows)) if self.rows else [[]] * len(columns)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in values], names=columns)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out()
    for b in batches:
        for trace, field, text, statement, action in zip(*(b.column(i).to_pylist() for i in range(5))):
            out.judge(trace, field, text, statement, action)
        yield out.flush()


def responses(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """(trace_id, field, text, statement, has_action): one row a trace and field.

    Rows of one key count once (the latest). A trace without a statement takes the one that other
    traces of its problem pose.
    """
    t = require(traces, "trace_id", "problem_id", "domain", "problem_statement", "gold_answer", "final_answer", "ingested_at")
    t = t.groupBy("trace_id").agg(F.max_by(F.struct("problem_id", "domain", "problem_statement", "gold_answer", "final_answer"), F.coalesce(F.unix_micros("ingested_at"), F.lit(0))).alias("r")).select("trace_id", "r.*")
    key = F.concat_ws("/", F.lower(trim_all(F.col("domain"))), F.regexp_replace(F.lower(F.col("problem_id")), r"[^\p{L}\p{N}]", ""))
    blank = F.col("problem_statement").isNull() | ~F.col("problem_statement").rlike(r"\w")
    t = stored(t.withColumn("problem", F.when(F.col("problem_id").isNotNull() & F.col("domain").isNotNull(), key)).withColumn("no_statement", blank))  # read four times
    known = t.filter(~F.col("no_statement") & F.col("problem").isNotNull()).groupBy("problem").agg(F.min("problem_statement").alias("statement"))
    bare_rows = t.filter("no_statement").join(known, "problem", "left").drop("problem_statement").withColumnRenamed("statement", "problem_statement")
    t = t.filter("not no_statement").unionByName(bare_rows.select(*t.columns)).select("trace_id", "problem_statement", "gold_answer", "final_answer")
    answers = t.select("trace_id", F.explode(F.array(F.struct(F.lit("final_answer").alias("field"), F.col("final_answer").alias("text")), F.struct(F.lit("gold_answer").alias("field"), F.col("gold_answer").alias("text")))).alias("a"), "problem_statement")
    answers = answers.select("trace_id", "a.field", "a.text", F.col("problem_statement").alias("statement"), F.lit(False).alias("has_action"))
    lab = require(labels, "trace_id", "llm_1_action", "llm_1_rationale", "ingested_at").groupBy("trace_id").agg(
        F.max_by(F.struct("llm_1_action", "llm_1_rationale"), F.coalesce(F.unix_micros("ingested_at"), F.lit(0))).alias("r")
    ).select("trace_id", "r.*")
    has_action = F.length(trim_all(F.coalesce(F.col("llm_1_action"), F.lit("")))) > 0
    rationales = lab.filter(F.col("llm_1_rationale").isNotNull() | has_action).join(t.select("trace_id", "problem_statement"), "trace_id", "left")
    rationales = rationales.select("trace_id", F.lit("llm_1_rationale").alias("field"), F.col("llm_1_rationale").alias("text"), F.col("problem_statement").alias("statement"), has_action.alias("has_action"))
    return answers.unionByName(rationales)


def defects(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """(trace_id, field, defect): each defective response, with at most one defect a trace and field.

    Defined results: null and blank answers are `empty`, a null rationale only where llm_1_action is
    set; without any statement of the problem there is neither `copy` nor `language`; empty tables
    give no rows; other columns are ignored; whole texts are read.
    """
    judged = stored(responses(traces, labels).mapInArrow(_judge, _SCHEMA))
    tails = judged.filter("kind in ('tail', 'dangle')").select("kind", "trace_id", "field", F.concat(F.lit("s "), "s").alias("s"), F.concat(F.lit("n "), "last_name").alias("name"))
    # one sorted search for fragments and names, kept apart by their first letter
    ends = tails.select(F.explode(F.array("s", "name")).alias("s")).filter("s is not null").distinct()
    bank = judged.filter("kind = 'bank'").select(F.concat(F.lit("s "), "s").alias("s")).distinct()
    cut = strict_prefixes(ends, bank.unionByName(judged.filter("kind = 'name'").select(F.concat(F.lit("n "), "s").alias("s"))))
    # a word after which nothing ends is a cut unless the bank has such a fragment
    open_ends = tails.filter("kind = 'dangle'").select("s").distinct().join(bank, "s", "left_anti")
    ended = checkpointed(cut.unionByName(open_ends).distinct())
    hit = lambda c: tails.withColumn("t", F.col(c)).join(ended.select(F.col("s").alias("t")), "t", "left_semi").select("trace_id", "field")
    truncated = hit("s").unionByName(hit("name")).distinct().select("trace_id", "field", F.lit("truncated").alias("defect"))
    return judged.filter("kind = 'found'").select("trace_id", "field", "defect").unionByName(truncated)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(table(spark, d, "traces"), table(spark, d, "triage_labels"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("field", "defect").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}
SQL: dict[str, str] = {}
