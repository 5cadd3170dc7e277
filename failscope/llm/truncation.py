"""Problem 2: texts cut off by field limits or in transfer.

Each value is read by the grammar it is written in. JSON, literals and code are scanned by a pushdown
automaton: an open bracket or string at the end means that the end is lost. Prose, alone or as a text
value inside tool output, is split into fragments; the unterminated last one goes into the sorted
prefix search of `fragments`. It was cut when it is a strict prefix of a longer, complete copy of
such a fragment elsewhere, when its last words go on inside complete fragments and end none, or when
its last word is only a part of known words. Open quotations and brackets, words after which nothing
ends, and marks of cutting count by themselves.

Text values under all keys of tool output are searched. Of a key whose values don't end like sentences
(titles, addresses, names) a complete value may well begin a sentence elsewhere; there only what
shows a cut by itself counts, unless so many values of the key show it that the key holds prose.

Scale: one narrow pass per value, whose small result is checkpointed; the search sorts distinct masked
fragments; what remains are joins of the few tails with the few cut strings.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm.fragments import bare, cut_mark, dangling, end_name, end_window, fragments, mask, names, open_prose, open_stack, starts_sentence, strict_prefixes, windows, word_forms
from failscope.llm.pairs import code_cut
from failscope.session import checkpointed, require, table

#: share of a key's values that must end like sentences for the key to hold prose, or of its unterminated values that show a cut by themselves (LEAST_SHOWN at least)
PROSE_SHARE, CUT_SHARE, LEAST_SHOWN = 0.5, 0.3, 3
#: words of a value from which an unterminated value can be told from a name or a number; shorter ones must begin like a sentence or end in a cut name
LEAST_WORDS = 4

_CODE = re.compile(r"^\s*(?:def |class |return |for |if |import |from \w+ import )|\blambda\b|\w+\s*=\s*\S|^\s{4}\S", re.M)
_CODE_START = re.compile(r"^\s*(?:def |class |@\w|import |from \w+ import |```|\w+ = lambda\b)")
_SCHEMA = "kind string, step_uid string, field string, path string, s string, last_name string, word string, win string, dangles boolean, n bigint, n_ended bigint"
_FIXED_KEY = re.compile(r"[a-z_][A-Za-z0-9_-]*")


def is_code(text: str) -> bool:
    """The text parses as code."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.strip("\n"))
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _leaves(value, path: str = "") -> Iterator[tuple[str, str]]:
    """(key path without positions and without keys that are data, text) of all text values."""
    todo = [(value, path)]
    while todo:
        v, p = todo.pop()
        if isinstance(v, str):
            yield p, v
        elif isinstance(v, dict):
            todo += [(x, f"{p}.{k if _FIXED_KEY.fullmatch(k) else '*'}") for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(x, p) for x in v]


def _load(s: str):
    try:
        return json.loads(s)
    except (ValueError, RecursionError):
        return None


class _Out:
    """Rows of one batch; complete fragments and counts are merged before they leave the task."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bank: set[str] = set()
        self.sent: set[str] = set()
        self.names: set[str] = set()
        self.words: set[str] = set()
        self.windows: set[str] = set()
        self.sent_names: set[str] = set()
        self.sent_words: set[str] = set()
        self.sent_windows: set[str] = set()
        self.ended: dict[str, list[int]] = {}

    def prose(self, uid: str, field: str, path: str, text: str) -> None:
        if not text or text.isspace():
            return
        whole, tail = fragments(text)
        marked = cut_mark(text)
        ended = tail is None
        if ended and text.rstrip().endswith(("...", "…")):  # an ellipsis may end a sentence or stand where one was cut
            tail = whole.pop().rstrip().rstrip(".…")
        for f in whole[:-1] if marked else whole:
            masked = mask(f)
            m = bare(masked)
            if m not in self.sent and m not in self.bank:
                self.bank.add(m)
                self.words |= word_forms(m)
                self.windows.update(windows(masked))
            for name in names(f):
                if name not in self.sent_names:
                    self.names.add(name)
        count = self.ended.setdefault(path, [0, 0])
        count[0] += 1
        count[1] += ended
        if marked or tail is not None and len(text.split()) > 1 and open_prose(text):
            self.rows.append(("cut", uid, field, path, "", None, None, None, False, 0, 0))
        elif tail is not None:
            tail, name = end_name(tail)
            masked = mask(tail)
            m = bare(masked)
            if not m:
                return
            before, _, last = m.rpartition(" ")
            self.words |= word_forms(before)
            if len(text.split()) >= LEAST_WORDS:
                word = last if last.isalpha() and last.islower() and len(last) > 2 and tail.rstrip()[-1:].isalpha() else None
                self.rows.append(("tail", uid, field, path, m, name, word, end_window(masked), dangling(tail), 0, 0))
            elif starts_sentence(tail):
                self.rows.append(("tail", uid, field, path, m, None, None, None, dangling(tail), 0, 0))

    def text(self, uid: str, field: str, text: str) -> None:
        code = bool(_CODE.search(text))
        if code and (open_stack(text) or _CODE_START.search(text) and code_cut(text)):
            self.rows.append(("cut", uid, field, "", "", None, None, None, False, 0, 0))
        elif not (code and not cut_mark(text) and (_CODE_START.search(text) or is_code(text))):
            self.prose(uid, field, "", text)

    def output(self, uid: str, field: str, s: str) -> None:
        t = s.strip()
        if not t:
            return
        v = _load(t)
        if v is None and t != "null":
            if cut_mark(t) or (t[0] in "{[\"" and open_stack(t)):
                self.rows.append(("cut", uid, field, "", "", None, None, None, False, 0, 0))
            elif t[0] not in "{[":
                self.prose(uid, field, "", t)
            return
        if isinstance(v, str):
            inner = v.strip()
            if inner[:1] in ("{", "["):
                self.output(uid, field, inner)
                return
        for path, x in _leaves(v):
            x = x.strip()
            if x[:1] in ("{", "[") and _load(x) is None:
                if cut_mark(x) or open_stack(x):
                    self.rows.append(("cut", uid, field, path, "", None, None, None, False, 0, 0))
            elif x[:1] not in ("{", "["):
                self.prose(uid, field, path or ".", x)

    def flush(self) -> pa.RecordBatch:
        rows = list(self.rows)
        for kind, known in (("bank", self.bank), ("name", self.names), ("word", self.words - self.sent_words), ("window", self.windows - self.sent_windows)):
            rows += [(kind, None, None, None, s, None, None, None, False, 0, 0) for s in known]
        rows += [("path", None, None, p, None, None, None, None, False, n, e) for p, (n, e) in self.ended.items()]
        for sent, new in ((self.sent, self.bank), (self.sent_names, self.names), (self.sent_words, self.words), (self.sent_windows, self.windows)):
            sent |= new
            if len(sent) > 500_000:
                sent.clear()
        self.rows, self.bank, self.names, self.words, self.windows, self.ended = [], set(), set(), set(), set(), {}
        kinds = [pa.string()] * 8 + [pa.bool_()] + [pa.int64()] * 2
        columns = [x.split()[0] for x in _SCHEMA.split(", ")]
        values = list(zip(*rows)) if rows else [[]] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(values, kinds)], names=columns)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out()
    for b in batches:
        for uid, text, output in zip(*(b.column(i).to_pylist() for i in range(3))):
            if text:
                out.text(uid, "text", text)
            if output:
                out.output(uid, "tool_output_json", output)
        yield out.flush()


def cut_values(steps: DataFrame) -> DataFrame:
    """(step_uid, field): values of `text` and `tool_output_json` that lost their end, or hold a text value that did.

    Defined results: null, empty and blank values are no cases, nor are values shorter than LEAST_WORDS
    words without a mark or an open bracket; repeated rows count once; other columns are ignored;
    whole texts are read.
    """
    scanned = checkpointed(require(steps, "step_uid", "text", "tool_output_json").mapInArrow(_scan, _SCHEMA))
    tails = scanned.filter("kind = 'tail'")
    # one sorted search for fragments, names, words and windows, kept apart by their first letter
    sought = {"bank": "s", "name": "last_name", "word": "word", "window": "win"}
    tagged = {k: F.concat(F.lit(f"{k[0] if k != 'window' else 'v'} "), F.col(c)) for k, c in sought.items()}
    ends = tails.select(F.explode(F.array(*tagged.values())).alias("s")).filter("s is not null").distinct()
    known = scanned.filter(F.col("kind").isin(*sought)).select(F.concat(F.when(F.col("kind") == "window", "v").otherwise(F.left("kind", F.lit(1))), F.lit(" "), F.col("s")).alias("s"))
    cut = checkpointed(strict_prefixes(ends, known))
    hit = lambda k: tails.withColumn("t", tagged[k]).join(cut.select(F.col("s").alias("t")), "t", "left_semi")
    dangles = tails.filter("dangles").join(scanned.filter("kind = 'bank'").select("s").distinct(), "s", "left_anti")
    at = ["step_uid", "field", "path"]
    # a part of a name or word, or a word after which nothing ends, shows a cut whatever the key
    shown = checkpointed(hit("name").select(*at).unionByName(hit("word").select(*at)).unionByName(dangles.select(*at)))
    counts = scanned.filter("kind = 'path'").groupBy("path").agg(F.sum("n").alias("n"), F.sum("n_ended").alias("n_ended"))
    counts = counts.join(shown.groupBy("path").agg(F.count(F.lit(1)).alias("n_shown")), "path", "left")
    is_prose = (F.col("path") == "") | (F.col("n_ended") >= PROSE_SHARE * F.col("n")) | ((F.col("n_shown") >= LEAST_SHOWN) & (F.col("n_shown") >= CUT_SHARE * (F.col("n") - F.col("n_ended"))))
    prose = counts.filter(is_prose).select("path")
    by_place = hit("bank").select(*at).unionByName(hit("window").select(*at)).join(prose, "path", "left_semi")
    sure = scanned.filter("kind = 'cut'").select("step_uid", "field")
    return sure.unionByName(shown.select("step_uid", "field")).unionByName(by_place.select("step_uid", "field")).distinct()


def cut_shares(steps: DataFrame, traces: DataFrame, found: DataFrame) -> DataFrame:
    """(field, source_kind, source, n_values, n_cut, share): per model_used of the trace and per tool_name."""
    values = require(steps, "step_uid", "trace_id", "tool_name", "text", "tool_output_json").dropDuplicates(["step_uid"]).select(
        "step_uid", "trace_id", "tool_name",
        F.explode(F.array(F.when(F.col("text").isNotNull(), F.lit("text")), F.when(F.col("tool_output_json").isNotNull(), F.lit("tool_output_json")))).alias("field"),
    ).filter("field is not null")
    models = require(traces, "trace_id", "model_used").groupBy("trace_id").agg(F.max("model_used").alias("model_used"))
    flagged = values.join(found.withColumn("is_cut", F.lit(1)), ["step_uid", "field"], "left").join(models, "trace_id", "left")
    kinds = F.explode(F.array(F.struct(F.lit("model_used").alias("source_kind"), F.col("model_used").alias("source")), F.struct(F.lit("tool_name").alias("source_kind"), F.col("tool_name").alias("source"))))
    out = flagged.select("field", "is_cut", kinds.alias("k")).groupBy("field", "k.source_kind", "k.source").agg(F.count(F.lit(1)).alias("n_values"), F.count("is_cut").alias("n_cut"))
    return out.withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_values(table(spark, d, "steps"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "steps")
    return cut_shares(steps, table(spark, d, "traces"), cut_values(steps))


QUERIES = {"p2_found": p2_found, "p2_shares": p2_shares}
SQL: dict[str, str] = {}
