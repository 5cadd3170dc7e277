"""Logistic regression over sparse texts and dense features for many rows: counted vocabulary, vectors and an optimiser of few passes.

Texts are split where they lie (Arrow batches), so that only terms with their counts are shuffled, and vectors stay sparse.
The training rows are kept as blocks by the executors (in memory, else on disk); a pass gives the loss and its gradient, one
array a partition. What reaches the driver: a vocabulary, labels, and coefficients (features x labels).
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: terms that a task holds at most before it hands on their counts, and rows of a block
HELD_TERMS, BLOCK_ROWS = 300_000, 500
#: Python's \w is what terms() in ml.py takes: letters, numbers and the underscore of Unicode
_WORD = re.compile(r"\w{2,}")


def split_terms(text: str, ngrams: int = 2) -> list[str]:
    """The words of two or more letters of a lower-case text, and their n-grams."""
    w = _WORD.findall(text)
    out = list(w)
    for n in range(2, ngrams + 1):
        out += map(" ".join, zip(*[w[i:] for i in range(n)], strict=False))
    return out


def lowered(text: str):
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def document_frequencies(df: DataFrame, text: str, ngrams: int) -> DataFrame:
    """(term, df, total): texts that hold a term, and how often; summed up in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total = Counter(), Counter()

        def handed():
            keys = list(total)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([docs[k] for k in keys], pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "df", "total"])

        for b in batches:
            for t in b.column(0).to_pylist():
                found = split_terms(t, ngrams)
                total.update(found)
                docs.update(set(found))
                if len(total) > HELD_TERMS:
                    yield handed()
                    docs, total = Counter(), Counter()
        if total:
            yield handed()

    parts = df.select(lowered(text).alias("t")).mapInArrow(count, "term string, df bigint, total bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def with_sparse_vectors(df: DataFrame, text: str, vocab: list[tuple[str, float]], dense: list[str], keep: list[str], ngrams: int) -> DataFrame:
    """`keep`, the tf-idf of a text by (`idx`, `val`) of known terms (1 + ln tf, times idf, length one), and the dense columns as an array `z`."""
    known = df.sparkSession.sparkContext.broadcast(({t: k for k, (t, _) in enumerate(vocab)}, np.array([i for _, i in vocab])))  # at most MAX_TERMS

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, idf = known.value
        for b in batches:
            idx, tf, size = [], [], []
            for t in b.column(0).to_pylist():
                c = Counter(map(index.get, split_terms(t, ngrams)))
                c.pop(None, None)
                idx += c.keys()
                tf += c.values()
                size.append(len(c))
            idx, size = np.array(idx, np.int32), np.array(size, np.int64)
            val = (1 + np.log(np.array(tf, float))) * idf[idx]
            row = np.repeat(np.arange(len(size)), size)
            val = val / np.sqrt(np.bincount(row, val * val, len(size)))[row]
            starts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(starts, pa.array(idx)), pa.ListArray.from_arrays(starts, pa.array(val))], [*b.schema.names[1:], "idx", "val"])

    kinds = dict(df.dtypes)
    source = df.select(lowered(text).alias("t"), *keep, F.array(*[F.col(c).cast("double") for c in dense]).cast("array<double>").alias("z"))
    return source.mapInArrow(vectors, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", z array<double>, idx array<int>, val array<double>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists of a column, and their values one after another."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


class Block:
    """Some rows: sparse parts in order of the rows and once more of the terms, dense parts with a one behind them, and labels by number."""

    def __init__(self, b: pa.RecordBatch, number: dict[str, int] | None = None) -> None:
        size, self.idx = _lists(b.column("idx"))
        self.val = _lists(b.column("val"))[1]
        self.held = np.flatnonzero(size)  # rows that hold a term, and where each begins
        self.begin = (np.cumsum(size) - size)[self.held]
        z = _lists(b.column("z"))[1].reshape(b.num_rows, -1)
        self.z = np.hstack([z, np.ones((b.num_rows, 1))])
        if number is not None:
            self.y = np.array([number[x] for x in b.column("label").to_pylist()])
            order = np.argsort(self.idx, kind="stable")
            self.row, self.row_val = np.repeat(np.arange(len(size)), size)[order].astype(np.int16), self.val[order]
            self.terms, self.terms_begin = np.unique(self.idx[order], return_index=True)

    def scores(self, w: np.ndarray, n_terms: int) -> np.ndarray:
        """Rows x labels. `w` is labels x (terms, dense, 1)."""
        s = self.z @ w[:, n_terms:].T
        if len(self.held):
            for k, own in enumerate(w):
                s[self.held, k] += np.add.reduceat(own[self.idx] * self.val, self.begin)
        return s

    def over_terms(self, each: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For every term of the block the sum of a number of its rows times its values there."""
        return np.add.reduceat(each[self.row] * values, self.terms_begin) if len(self.terms) else np.zeros(0)

    def loss(self, w: np.ndarray, weight: np.ndarray, n_terms: int) -> tuple[float, np.ndarray]:
        """The weighted cross-entropy and its gradient."""
        s = self.scores(w, n_terms)
        s -= s.max(1, keepdims=True)
        e = np.exp(s)
        of, rows, each = e.sum(1), np.arange(len(self.y)), weight[self.y]
        p = e / of[:, None]
        total = float(each @ (np.log(of) - s[rows, self.y]))
        p[rows, self.y] -= 1
        p *= each[:, None]
        g = np.zeros_like(w)
        for k, own in enumerate(np.ascontiguousarray(p.T)):
            g[k, self.terms] = self.over_terms(own, self.row_val)
        g[:, n_terms:] = p.T @ self.z
        return total, g

    def moments(self, weight: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        """Weighted sums of squares of the terms, and of products of the dense parts."""
        each, squares = weight[self.y], np.zeros(n_terms)
        squares[self.terms] = self.over_terms(each, self.row_val**2)
        return squares, (self.z * each[:, None]).T @ self.z


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, tol: float, max_iter: int, memory: int = 30, window: int = 20) -> tuple[np.ndarray, list[float]]:
    """Limited-memory BFGS: (x, the values on the way). As in Spark's, it ends when the value fell by less than `tol` of the first one
    over the last steps, or when the gradient's length is below `tol` of the value."""
    value, g = f(x)
    values, pairs = [value], []
    for _ in range(max_iter):
        if np.linalg.norm(g) <= tol * max(abs(value), 1e-4):
            break
        q, back = g.copy(), []
        for s, y, r in reversed(pairs):
            back.append(r * (s @ q))
            q -= back[-1] * y
        if pairs:
            s, y, r = pairs[-1]
            q /= r * (y @ y)
        for (s, y, r), a in zip(pairs, reversed(back), strict=True):
            q += (a - r * (y @ q)) * s
        slope, t = float(g @ q), 1.0
        if not slope > 0:
            q, slope, pairs = g.copy(), float(g @ g), []
        while True:
            new_value, new_g = f(x - t * q)
            if new_value <= value - 1e-4 * t * slope:
                break
            t *= min(0.5, max(0.1, 0.5 * slope * t / (new_value - value + slope * t)))
            if t < 1e-10:
                return x, values
        s, y = -t * q, new_g - g
        x, value, g = x + s, new_value, new_g
        if s @ y > 1e-14:
            pairs = [*pairs, (s, y, 1.0 / (s @ y))][-memory:]
        values.append(value)
        if max(values[-window:]) - value <= tol * values[0]:
            break
    return x, values


def fitted(train: DataFrame, n_terms: int, n_dense: int, reg: float | None = None, tol: float = 1e-4, max_iter: int = 1000) -> tuple[list[str], np.ndarray, list[float]]:
    """(labels, coefficients as labels x (terms, dense, 1), values of the objective on the way) of multinomial regression with balanced row weights.

    Mean weighted cross-entropy plus half of `reg` (1 / rows: C = 1) times the squared coefficients, intercepts left out. The
    variables are scaled by the curvature at the start: its diagonal for terms, its whole block for the dense features, which
    depend on each other. That leaves the minimum where it is and cuts the number of passes.
    """
    sc = train.sparkSession.sparkContext
    per = {r["label"]: r["count"] for r in train.groupBy("label").count().orderBy("label").collect()}  # labels
    labels, n = list(per), sum(per.values())
    k, number = len(labels), {x: i for i, x in enumerate(labels)}
    weight, reg = np.array([n / (k * per[x]) for x in labels]), 1.0 / n if reg is None else reg

    def blocks(batches):
        for b in batches:
            own = [pickle.dumps(Block(b.slice(i, BLOCK_ROWS), number), 5) for i in range(0, b.num_rows, BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], ["block"])

    kept = train.select("label", "z", "idx", "val").mapInArrow(blocks, "block binary").rdd.map(lambda r: bytes(r[0])).coalesce(2 * sc.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)

    def summed(each):
        """The sums of a pair of results over all blocks, one pair a partition."""

        def run(own):
            a = b = 0.0
            for raw in own:
                x, y = each(pickle.loads(raw))
                a, b = a + x, b + y
            yield a, b

        return tuple(sum(x) for x in zip(*kept.mapPartitions(run).collect(), strict=True))

    squares, products = summed(lambda b: b.moments(weight, n_terms))
    curvature = (k - 1) / k**2
    ridge = np.diag([*[reg] * n_dense, 0.0])
    lower = np.linalg.cholesky(curvature * products / n + ridge + 1e-12 * np.eye(n_dense + 1))
    scale, into = 1 / np.sqrt(curvature * squares / n + reg), np.linalg.inv(lower)

    def coefficients(x):
        x = x.reshape(k, -1)
        return np.hstack([x[:, :n_terms] * scale, x[:, n_terms:] @ into])

    def objective(x):
        w = coefficients(x)
        sent = sc.broadcast(w)
        try:
            total, g = summed(lambda b: b.loss(sent.value, weight, n_terms))
        finally:
            sent.destroy()
        inner = w.copy()
        inner[:, -1] = 0
        g = g / n + reg * inner
        return total / n + reg / 2 * float((inner**2).sum()), np.hstack([g[:, :n_terms] * scale, g[:, n_terms:] @ into.T]).ravel()

    try:
        x, values = minimised(objective, np.zeros(k * (n_terms + n_dense + 1)), tol, max_iter)
    finally:
        kept.unpersist()
    return labels, coefficients(x), values


def predicted(df: DataFrame, labels: list[str], w: np.ndarray, n_terms: int, keep: list[str]) -> DataFrame:
    """`keep` and the label of the greatest score as `predicted`."""
    sent = df.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for b in batches:
            best = Block(b).scores(sent.value, n_terms).argmax(1) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([labels[i] for i in best], pa.string())], [*keep, "predicted"])

    kinds = dict(df.dtypes)
    return df.select(*keep, "z", "idx", "val").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", predicted string")
