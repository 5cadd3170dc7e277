"""Problem 4: the same or nearly the same problem in the training split and in an evaluation split.

Statements are made canonical (letter case, markup, framing, number words, decimals) and distinct. A
suffix array is built over the concatenated texts of each partition, a partition being the texts with
the same quantities and number of words, since only those can pose one problem: all word suffixes are
sorted, and neighbours with a long common prefix reveal pairs of texts with shared spans. Equal
suffixes stand in the order of the whole texts, so that texts of other names don't come between two
that differ by a slip. The shared spans of a revealed pair are merged into the coverage of its texts;
covered pairs are verified word by word (the same names and quantities in the same places, other words
the same but for slips of typing). Verified links make classes, and the answer is every train trace with
every evaluation trace of its class.

Scale: a text that a third of all traces share is one row until the last step. Suffixes are made
only for texts whose quantities occur in both sides. The sort is a range partitioning by suffix and
text, so that an ending which all texts share is spread too; each task streams, and the pairs over
the edges of partitions are settled from two rows a partition, so the result is the same for any number
of partitions. The last join splits large classes into blocks of train traces, so that no task holds
a class, and every pair is made once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from failscope.operators.windows import ordinals
from failscope.session import checkpointed, require, table, trim_all

#: words of a common prefix that make a shared span; words of a suffix that are sorted (beyond them the order of the whole texts holds)
SPAN_WORDS, SUFFIX_WORDS = 5, 16
#: share of a text that merged spans must cover for a pair to be verified
COVERAGE = 0.5
#: train traces of one class that are joined in one block
BLOCK = 2_000

#: Number words, and phrases that frame a problem or mean the same.
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
_OTHER = dict(zip("zwei drei vier fünf sechs sieben acht neun zehn elf zwölf".split(), range(2, 13))) | dict(zip("dos tres cuatro cinco seis siete ocho nueve diez once doce".split(), range(2, 13)))
NUMBER_WORDS = {w: i for i, w in enumerate(_UNITS)} | _TENS | _OTHER
_BEFORE = re.compile(r"^(?:q|question|task|problem|exercise|please solve the following|solve the following|please answer the following|frage|pregunta)\b ?")
_AFTER = re.compile(r" ?\b(?:think step by step|show your work|give only the final value|give only the final answer|answer briefly|from the practice set|from the test set|explain your reasoning)$")
_WORD = re.compile(r"(?<![\w-])-\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?|[^\W\d]+(?:['’][^\W\d]+)*|\w+")


def _digits(w: str) -> str:
    """A number without thousands marks and closing zeros."""
    w = w.replace(",", "")
    return w.rstrip("0").rstrip(".") if "." in w else w


def numbers_in_digits(ws: list[str]) -> list[str]:
    """Number words as digits: seven, twenty one, one hundred and five, two thousand."""
    out: list[str] = []
    total = current = None  # of the number being read
    joined = False  # an "and" stands after hundred or thousand

    def close() -> None:
        nonlocal total, current, joined
        if total is not None or current is not None:
            out.append(str((total or 0) + (current or 0)))
        if joined:
            out.append("and")
        total = current = None
        joined = False

    for w in ws:
        n = NUMBER_WORDS.get(w)
        if n is not None:
            c = current or 0
            goes_on = (current is None and total is not None) or (c >= 100 and c % 100 == 0) or (20 <= c % 100 and c % 10 == 0 and 0 < n < 10)
            if (current is not None or total is not None) and not (goes_on and n > 0):
                close()
            current, joined = (current or 0) + n, False
        elif w == "hundred" and (current is None and out and out[-1] == "a" or current is not None and 0 < current < 100):
            if current is None:
                out.pop()
            current = (current or 1) * 100
        elif w == "thousand" and (current is not None and total is None or current is None and total is None and out and out[-1] == "a"):
            if current is None:
                out.pop()
            total, current = (current or 1) * 1000, None
        elif w == "and" and not joined and (current is not None and current >= 100 and current % 100 == 0 or current is None and total is not None):
            joined = True
        else:
            close()
            out.append(w)
    close()
    return out


def canonical(statement: str) -> str:
    """The words of a statement as they count: blank-separated, lower case, numbers in digits, without framing."""
    t = html.unescape(re.sub(r"<[^<>]{1,40}>", " ", statement))
    t = unicodedata.normalize("NFKC", t).lower().replace("’", "'").replace("&", " and ")
    words = (w.rstrip(",") if w[-1:] == "," else w for w in _WORD.findall(t))
    s = " ".join(numbers_in_digits([_digits(w) if w[0].isdigit() or w[0] == "-" else w for w in words])).replace("what number of", "how many")
    last = None
    while s != last:
        last = s
        s = _AFTER.sub("", _BEFORE.sub("", s))
    return s


def quantities(canon: str) -> str:
    return " ".join(sorted(w for w in canon.split(" ") if w[:1].isdigit() or w[:1] == "-"))


def slip(a: str, b: str) -> bool:
    """One word is the other with two neighbouring letters swapped, or a letter doubled, left out or put in."""
    if a == b:
        return True
    if any(c.isdigit() for c in a + b) or min(len(a), len(b)) < 3:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def same_problem(a: str, b: str) -> bool:
    """Exact check of two canonical texts; sentences may stand in another order.

    Words must pair off one to one, equal or slips; each word that occurs once must keep one of
    its neighbours, so names and quantities that changed places are told apart.
    """
    x, y = a.split(" "), b.split(" ")
    cx, cy = Counter(x), Counter(y)
    left, right = list((cx - cy).elements()), list((cy - cx).elements())
    if len(left) != len(right) or len(left) > 2 + len(x) // 8:
        return False
    pairs: dict[str, str] = {}
    for w in left:
        m = next((v for v in right if slip(w, v)), None)
        if m is None:
            return False
        right.remove(m)
        pairs[w] = m
    y_at = {w: i for i, w in enumerate(y)}

    def at(ws: list[str], i: int) -> str:
        return ws[i] if 0 <= i < len(ws) else ""

    for i, w in enumerate(x):
        v = pairs.get(w, w)
        if cx[w] != 1 or cy[v] != 1:
            continue
        j = y_at[v]
        before, after = at(x, i - 1), at(x, i + 1)
        if pairs.get(before, before) != at(y, j - 1) and pairs.get(after, after) != at(y, j + 1):
            return False
    return True


def labelled_statements(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """(trace_id, benchmark, split, statement) of labelled traces with a statement and a split; rows of one key count once."""
    lab = require(labels, "trace_id", "split", "ingested_at")
    name = F.lower(trim_all(F.col("split")))
    split = F.when(name == "validation", "dev").when(name.isin("train", "dev", "test"), name)
    lab = lab.withColumn("split", split).filter("split is not null and trace_id is not null")
    lab = lab.groupBy(trim_all(F.col("trace_id")).alias("trace_id")).agg(F.min_by("split", F.struct(F.col("ingested_at"), F.col("split"))).alias("split"))
    t = require(traces, "trace_id", "benchmark", "problem_statement", "ingested_at").filter(F.col("problem_statement").rlike(r"\w"))
    t = t.groupBy(trim_all(F.col("trace_id")).alias("trace_id")).agg(F.min_by(F.struct("benchmark", "problem_statement"), F.struct("ingested_at", "problem_statement")).alias("r"))
    return t.join(lab, "trace_id").select("trace_id", "r.benchmark", "split", F.col("r.problem_statement").alias("statement"))


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        canon = [canonical(s) for s in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(canon, pa.string()), pa.array([quantities(c) for c in canon], pa.string())], names=["statement", "canon", "sig"])


def coverage(a: str, b: str) -> float:
    """The share of the words of `a` that lie in spans of SPAN_WORDS or more words which `b` has too."""
    x, y = a.split(" "), b.split(" ")
    k = min(SPAN_WORDS, len(x), len(y))
    there = {tuple(y[j : j + k]) for j in range(len(y) - k + 1)}
    covered, end = 0, 0
    for i in range(len(x) - k + 1):
        if tuple(x[i : i + k]) in there:
            covered += i + k - max(i, end)
            end = i + k
    return covered / len(x)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: tuple[list, list, list] = ([], [], [])
        for bucket, n, canon in zip(*(b.column(i).to_pylist() for i in range(3))):
            ws = canon.split(" ")
            for p in range(max(1, len(ws) - SPAN_WORDS + 1)):
                for c, v in zip(out, (bucket, " ".join(ws[p : p + SUFFIX_WORDS]), n)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["bucket", "suffix", "n"])


def _linked(a: tuple, b: tuple) -> bool:
    """Two neighbouring suffixes (bucket, suffix, n) of different texts share a span."""
    if a[0] != b[0] or a[2] == b[2]:
        return False
    x, y = a[1].split(" ", SPAN_WORDS), b[1].split(" ", SPAN_WORDS)
    k = min(SPAN_WORDS, len(x), len(y))
    return x[:k] == y[:k]


_PAIR = "kind string, pid int, bucket bigint, suffix string, n_a bigint, n_b bigint"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over suffixes sorted by bucket, text and n: the pairs of neighbours that share a span, and the first and the last row of the partition."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _PAIR.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    rows: set[tuple] = set()
    first = last = None
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(3))):
            if last is None:
                first = row
            elif _linked(last, row):
                rows.add((min(last[2], row[2]), max(last[2], row[2])))
            last = row
        pairs = [("pair", pid, None, None, x, y) for x, y in rows]
        rows = set()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*pairs)) or [[]] * 6, kinds)], names=names)
    if first is not None:
        ends = [("first", pid, first[0], first[1], first[2], None), ("last", pid, last[0], last[1], last[2], None)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ends), kinds)], names=names)


def shared_spans(texts: DataFrame) -> DataFrame:
    """(n_a, n_b): distinct pairs of texts, by number, that are neighbours in the suffix arrays of (bucket, n, canon) with a common prefix of SPAN_WORDS or more."""
    suffixes = texts.select("bucket", "n", "canon").mapInArrow(_suffixes, "bucket bigint, suffix string, n bigint")
    ordered = suffixes.repartitionByRange("bucket", "suffix", "n").sortWithinPartitions("bucket", "suffix", "n")
    out = checkpointed(ordered.mapInArrow(_neighbours, _PAIR))
    # two rows a partition: the first row of each meets the last row of the partition before it that holds rows
    edge = Window.orderBy("pid", "kind")
    at = lambda c: F.lag(c).over(edge).alias(f"p_{c}")
    edges = out.filter("kind <> 'pair'").select("kind", "bucket", "suffix", "n_a", at("bucket"), at("suffix"), at("n_a"))
    k = lambda c: F.slice(F.split(c, " "), 1, SPAN_WORDS)
    span = F.least(F.size(k("suffix")), F.size(k("p_suffix")))
    same = F.slice(k("suffix"), F.lit(1), span) == F.slice(k("p_suffix"), F.lit(1), span)
    edges = edges.filter((F.col("kind") == "first") & (F.col("bucket") == F.col("p_bucket")) & (F.col("n_a") != F.col("p_n_a")) & same)
    over = edges.select(F.least("n_a", "p_n_a").alias("n_a"), F.greatest("n_a", "p_n_a").alias("n_b"))
    return out.filter("kind = 'pair'").select("n_a", "n_b").unionByName(over).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, class_id): smallest key of each connected component, by repeated neighbour minima and pointer jumping."""
    both = checkpointed(links.select("key_a", "key_b").unionByName(links.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"))).distinct())
    label = nodes.select("key", F.col("key").alias("class_id"))
    touched = checkpointed(label.join(both.select(F.col("key_a").alias("key")).distinct(), "key", "left_semi"))
    while True:
        near = both.join(touched.select(F.col("key").alias("key_b"), F.col("class_id").alias("c")), "key_b").groupBy(F.col("key_a").alias("key")).agg(F.min("c").alias("c"))
        step = touched.join(near, "key").select("key", F.least("class_id", "c").alias("class_id"), F.col("class_id").alias("old"))
        jump = step.select(F.col("key").alias("class_id"), F.col("class_id").alias("further"))
        new = checkpointed(step.join(jump, "class_id", "left").select("key", F.least("class_id", F.coalesce("further", "class_id")).alias("class_id"), "old"))
        touched = new.select("key", "class_id")
        if new.filter("class_id <> old").isEmpty():
            break
    return label.join(touched.withColumnRenamed("class_id", "c"), "key", "left").select("key", F.coalesce("c", "class_id").alias("class_id"))


def problem_classes(rows: DataFrame) -> DataFrame:
    """The labelled statements with class_id: equal for traces that pose the same problem."""
    side = F.when(F.col("split") == "train", 1).otherwise(2)
    raw = rows.groupBy("statement").agg(F.bit_or(side).alias("sides"))
    canon = checkpointed(raw.select("statement").mapInArrow(_canonical_rows, "statement string, canon string, sig string").withColumn("key", F.md5("canon")))
    texts = canon.join(raw, "statement").groupBy("key", "sig").agg(F.min("canon").alias("canon"), F.bit_or("sides").alias("sides"))
    # texts of one problem have the same quantities and as many words
    texts = checkpointed(texts.withColumn("bucket", F.xxhash64("sig", F.size(F.split("canon", " ")))))
    shared = texts.groupBy("bucket").agg(F.bit_or("sides").alias("s"), F.count(F.lit(1)).alias("n")).filter("s = 3 and n > 1").select("bucket")
    numbered = ordinals(texts.join(shared, "bucket", "left_semi").select("key", "bucket", "canon"), ["canon", "key"]).withColumnRenamed("ordinal", "n")
    numbered = checkpointed(numbered)
    spans = shared_spans(numbered)
    a = numbered.select(F.col("n").alias("n_a"), F.col("key").alias("key_a"), F.col("canon").alias("canon_a"))
    b = numbered.select(F.col("n").alias("n_b"), F.col("key").alias("key_b"), F.col("canon").alias("canon_b"))
    pairs = spans.join(a, "n_a").join(b, "n_b").select("key_a", "key_b", "canon_a", "canon_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [coverage(x, y) >= COVERAGE and same_problem(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    classes = components(texts, pairs.mapInArrow(verify, "key_a string, key_b string"))
    return rows.join(canon.select("statement", "key"), "statement").join(classes, "key").select("trace_id", "benchmark", "split", "class_id")


def overlapping_traces(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """(trace_id_a, trace_id_b, split_a, split_b, ...): pairs of a train and a dev or test trace that pose the same problem, the smaller id first.

    Defined results: traces without a row, a statement or a split take no part; rows of one key
    count once, with their earliest row; empty tables give no rows; other columns are ignored;
    whole statements are read.
    """
    rows = checkpointed(problem_classes(labelled_statements(traces, labels)))
    is_train = F.col("split") == "train"
    sizes = rows.groupBy("class_id").agg(F.count_if(is_train).alias("n_train"), F.count_if(~is_train).alias("n_eval")).filter("n_train > 0 and n_eval > 0")
    rows = rows.join(sizes.select("class_id", F.ceil(F.col("n_train") / BLOCK).cast("int").alias("blocks")), "class_id")
    train = rows.filter(is_train).select("class_id", F.pmod(F.xxhash64("trace_id"), F.col("blocks")).cast("int").alias("block"), F.col("trace_id").alias("t"), F.col("benchmark").alias("t_benchmark"))
    held = rows.filter(~is_train).select("class_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("trace_id").alias("e"), F.col("split").alias("e_split"), F.col("benchmark").alias("e_benchmark"))
    return train.join(held, ["class_id", "block"]).select(F.least("t", "e").alias("trace_id_a"), F.greatest("t", "e").alias("trace_id_b"), "e_split", "t_benchmark", "e_benchmark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlapping_traces(table(spark, d, "traces"), table(spark, d, "triage_labels")).select("trace_id_a", "trace_id_b")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs per evaluation split and benchmark of the evaluation trace, counted per class without making the pairs."""
    rows = problem_classes(labelled_statements(table(spark, d, "traces"), table(spark, d, "triage_labels")))
    train = rows.filter("split = 'train'").groupBy("class_id").agg(F.count(F.lit(1)).alias("n_train"))
    held = rows.filter("split <> 'train'").groupBy("class_id", "split", "benchmark").agg(F.count(F.lit(1)).alias("n"))
    return held.join(train, "class_id").groupBy("split", "benchmark").agg(F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"), F.sum("n").alias("n_traces"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a trace of a class that both sides have: its class and the number of its links (the traces of the other side)."""
    rows = checkpointed(problem_classes(labelled_statements(table(spark, d, "traces"), table(spark, d, "triage_labels"))))
    is_train = F.col("split") == "train"
    sizes = rows.groupBy("class_id").agg(F.count_if(is_train).alias("n_train"), F.count_if(~is_train).alias("n_eval")).filter("n_train > 0 and n_eval > 0")
    return rows.join(sizes, "class_id").select("trace_id", "split", "class_id", F.when(is_train, F.col("n_eval")).otherwise(F.col("n_train")).alias("n_links"))


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p4_classes": p4_classes}
SQL: dict[str, str] = {}
