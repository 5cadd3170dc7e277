"""Problem 3: consensus from several annotators' labels.

A community confusion model: each annotator belongs to a latent community, communities have
Dirichlet confusion matrices, and an annotator's own matrix has a Dirichlet prior around its
community's. The variational updates alternate the items' label posteriors with the posteriors of
memberships, community matrices and annotators' matrices, whose expected logarithms (digamma) weigh the
votes, until the matrices stand still. So an annotator with few labels keeps close to its community.
Annotators who copy each other are not independent: for each pair the rate of copying is estimated from
how often both give the same wrong label, and a copied vote counts once. (Copying annotators who outvote
all careful ones can't be told from them by any model without known labels.)

Scale: all that the updates need of the items are sums (a few numbers for each pair of annotators), and
items with equal votes have equal posteriors, so the items are aggregated to distinct vote patterns first
(map-side combine). Up to MAX_PATTERNS distinct patterns, counted, are collected and summed on the
driver; beyond that each update is a distributed sum over the patterns, of which a task returns one row.
Labels are given to the items in one narrow pass with the fitted matrices.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.session import checkpointed, require, table

#: The actions.
ACTIONS = ("LOCAL_REPAIR", "RETRY", "REPLAN", "RETRIEVE_MORE", "TOOL_FIX", "ESCALATE")
ANNOTATORS = ("P1", "P2", "P3", "P4", "P5", "P6")
MAX_PATTERNS = 200_000
#: updates at most, and the change of the matrices below which they end
COMMUNITIES, ITERATIONS, STILL = 4, 100, 1e-6
#: updates during which memberships are kept soft, so that early mistakes can be undone, and before copying is estimated
SOFT, LATER = 30, 5
#: pseudo-labels per row that tie an annotator's matrix to its community's
TIE = 20.0
_SQUEEZED = {a.replace("_", ""): i for i, a in enumerate(ACTIONS)}


def _distance(a: str, b: str) -> int:
    """Edits, swaps of neighbours included."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def recognised(cell: str | None) -> int:
    """The number of the action that a cell names, -1 where it names none: of two labels the first counts; up to two slips of typing are allowed."""
    if cell is None:
        return -1
    word = re.sub(r"[^A-Z]", "", re.split(r"[/|;,]", cell)[0].upper())
    if word in _SQUEEZED:
        return _SQUEEZED[word]
    if len(word) < 4:
        return -1
    near = sorted((_distance(word, a), i) for a, i in _SQUEEZED.items() if abs(len(word) - len(a)) <= 2)
    return near[0][1] if near and near[0][0] <= (2 if len(word) >= 6 else 1) and (len(near) < 2 or near[0][0] < near[1][0]) else -1


def label_numbers(col):
    """recognised as a column (Arrow batches)."""

    @F.pandas_udf("tinyint")
    def to_number(cells: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for c in cells:
            if c not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[c] = recognised(c)
            out.append(memo[c])
        return pd.Series(out, dtype="int8")

    return to_number(col)


def vote_patterns(audit: DataFrame, annotators=ANNOTATORS) -> DataFrame:
    """(trace_id, pattern array<tinyint>): one row an audited trace, the earliest of its rows."""
    rows = require(audit, "trace_id", *annotators, "audited_at").filter(F.length(F.trim("trace_id")) > 0)
    first = rows.groupBy("trace_id").agg(F.min_by(F.struct(*annotators), F.struct("audited_at", *annotators)).alias("r"))
    return first.select("trace_id", F.array(*[label_numbers(F.col(f"r.{a}")) for a in annotators]).alias("pattern"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln Gamma for positive numbers: recurrence up to six, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out = np.where(small, out - 1 / x, out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def _expected_log(alpha: np.ndarray) -> np.ndarray:
    """E[log p] of Dirichlet distributions along the last axis."""
    return digamma(alpha) - digamma(alpha.sum(-1, keepdims=True))


class CommunityModel:
    """Variational estimate from votes V (n x A, -1 for no vote) that occur w times.

    `statistics` gives the sums over all items for the present matrices; by default they are made from
    votes and weights at hand.
    """

    def __init__(self, votes: np.ndarray, weights: np.ndarray, n_labels: int = len(ACTIONS), communities: int = COMMUNITIES, iterations: int = ITERATIONS, statistics: Callable[[CommunityModel], np.ndarray] | None = None) -> None:
        a, k = votes.shape[1], n_labels
        self.a, self.k, self.log_conf = a, k, None
        self.copy = np.zeros((a, a))
        statistics = statistics or (lambda m: m.sums(votes, weights))
        own, base, _ = self._unpacked(statistics(self))
        empty = base.sum() <= 0
        c = min(communities, a)
        # communities start from annotators ranked by their agreement with the majority
        agree = np.array([np.trace(o) / max(o.sum(), 1e-9) for o in own])
        self.member = np.full((a, c), 0.1 / c)
        for rank, j in enumerate(np.argsort(-agree)):
            self.member[j, rank * c // a] += 0.9
        self.confusion = np.tile(np.eye(k), (a, 1, 1))
        self.base = np.full(k, 1 / k)
        self.iterations = 0
        while not empty and self.iterations < iterations:
            before = self.confusion
            self._update(own, base)
            own, base, pairs = self._unpacked(statistics(self))
            if self.iterations >= LATER:
                self._estimate_copying(*pairs)
            self.iterations += 1
            if self.iterations > SOFT + LATER and np.abs(self.confusion - before).max() < STILL:
                break
        self.post = self.posteriors(votes)

    def _update(self, own: np.ndarray, base: np.ndarray) -> None:
        """Posteriors of communities, memberships, annotators and the labels' shares, from expected counts."""
        k = self.k
        alpha = np.eye(k) * 2 + 0.5 + np.einsum("ac,akl->ckl", self.member, own)
        mix = digamma(self.member.sum(0) + 1 / self.member.shape[1]) - digamma(np.array(self.a + 1.0))
        score = np.einsum("akl,ckl->ac", own, _expected_log(alpha)) + mix
        if self.iterations < SOFT:
            score = score / max(1.0, own.sum() / self.a / 50.0)
        self.member = np.exp(score - score.max(1, keepdims=True))
        self.member /= self.member.sum(1, keepdims=True)
        centre = np.einsum("ac,ckl->akl", self.member, alpha / alpha.sum(2, keepdims=True))
        tied = own + TIE * centre
        self.confusion = tied / tied.sum(2, keepdims=True)
        self.log_conf = _expected_log(tied)
        self.log_base = _expected_log(base + 1.0)
        self.base = (base + 1.0) / (base + 1.0).sum()

    def posteriors(self, votes: np.ndarray) -> np.ndarray:
        """Label posteriors of vote patterns; shares of the votes before the first update."""
        n = len(votes)
        if self.log_conf is None:
            counts = np.full((n, self.k), 0.01)
            for j in range(self.a):
                m = np.flatnonzero(votes[:, j] >= 0)
                counts[m, votes[m, j]] += 1
            return counts / counts.sum(1, keepdims=True)
        log_post = np.tile(self.log_base, (n, 1))
        # votes in order of care; a vote that an earlier annotator's vote explains counts by what is left of it
        care = np.argsort(-np.einsum("akk->a", self.confusion))
        for pos, j in enumerate(care):
            m = np.flatnonzero(votes[:, j] >= 0)
            lik = np.exp(self.log_conf[j])[:, votes[m, j]].T
            best = np.zeros(len(m))
            for i in care[:pos]:
                best = np.where(votes[m, i] == votes[m, j], np.maximum(best, self.copy[i, j]), best)
            log_post[m] += np.log(best[:, None] + (1 - best[:, None]) * lik)
        post = np.exp(log_post - log_post.max(1, keepdims=True))
        return post / post.sum(1, keepdims=True)

    def sums(self, votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What an update needs of these items: expected counts of (annotator, true label, given label), of labels, and of wrong labels that pairs share."""
        a, k = self.a, self.k
        post = self.posteriors(votes) * np.asarray(weights, dtype=float)[:, None]
        own = np.zeros((a, k, k))
        pairs = np.zeros((3, a, a))
        for j in range(a):
            m = votes[:, j] >= 0
            np.add.at(own[j].T, votes[m, j], post[m])
        if self.log_conf is not None:
            for i in range(a):
                wrong = post.copy()
                has = np.flatnonzero(votes[:, i] >= 0)
                wrong[has, votes[has, i]] = 0.0
                for j in range(a):
                    if i != j:
                        m = has[votes[has, j] >= 0]
                        vi, w = votes[m, i], wrong[m]
                        pairs[:, i, j] = (w.sum(1) * (vi == votes[m, j])).sum(), (w * self.confusion[j][:, vi].T).sum(), w.sum()
        return np.concatenate([own.ravel(), post.sum(0), pairs.ravel()])

    def _unpacked(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, k = self.a, self.k
        n = a * k * k
        return flat[:n].reshape(a, k, k) + 1e-6, flat[n : n + k], flat[n + k :].reshape(3, a, a)

    def _estimate_copying(self, seen: np.ndarray, expected: np.ndarray, total: np.ndarray) -> None:
        """copy[i, j]: the share of j's votes that repeat i's, beyond what their matrices explain, from where i's label is wrong."""
        rate = np.where(total > 5, (seen - expected) / np.maximum(total - expected, 1e-9), 0.0)
        self.copy = np.where(rate > 0.2, np.clip(rate, 0.0, 0.99), 0.0)

    def reliability(self) -> np.ndarray:
        return np.einsum("akk,k->a", self.confusion, self.base)


def fit(patterns: DataFrame, annotators=ANNOTATORS) -> CommunityModel:
    """The model over the distinct patterns of `vote_patterns`: summed on the driver up to MAX_PATTERNS of them, else by the tasks."""
    distinct = checkpointed(patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    shape = (-1, len(annotators))
    if distinct.count() <= MAX_PATTERNS:
        rows = sorted((list(r[0]), r[1]) for r in distinct.collect())
        return CommunityModel(np.array([p for p, _ in rows], dtype=int).reshape(shape), np.array([n for _, n in rows]))

    def distributed(model: CommunityModel) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                votes = np.array(b.column(0).to_pylist(), dtype=int).reshape(shape)
                part = model.sums(votes, b.column(1).to_numpy())
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

        return np.sum([r[0] for r in distinct.mapInArrow(run, "s array<double>").collect()], axis=0)  # one short row a task

    return CommunityModel(np.zeros((0, len(annotators)), dtype=int), np.zeros(0), statistics=distributed)


def consensus(audit: DataFrame, annotators=ANNOTATORS) -> DataFrame:
    """(trace_id, label, confidence, agreement) of every audited trace.

    agreement is the share of its recognised votes that name the label, null without votes.
    Defined results: a cell without a recognisable label is no vote; a trace without any vote gets
    the most frequent consensus; equal posteriors go to the earlier action of ACTIONS; repeated
    rows count once (the earliest); an empty table gives no rows.
    """
    patterns = checkpointed(vote_patterns(audit, annotators))
    model = fit(patterns, annotators)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = np.array(b.column(1).to_pylist(), dtype=int).reshape(-1, len(annotators))
            post = model.posteriors(votes)
            best = np.argmax(np.round(post, 9), axis=1) if len(post) else np.zeros(0, int)
            n = (votes >= 0).sum(1)
            same = (votes == best[:, None]).sum(1)
            agreement = pa.array([s / m if m else None for s, m in zip(same.tolist(), n.tolist())], pa.float64())
            names = pa.array([ACTIONS[x] for x in best.tolist()], pa.string())
            confidence = pa.array([round(float(post[i, x]), 6) for i, x in enumerate(best.tolist())], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), names, confidence, agreement], names=["trace_id", "label", "confidence", "agreement"])

    return patterns.mapInArrow(label, "trace_id string, label string, confidence double, agreement double")


def annotator_reliability(audit: DataFrame, annotators=ANNOTATORS) -> DataFrame:
    """(annotator, reliability, community, copies): expected share of right labels, community, and the annotator it copies most, if any."""
    model = fit(vote_patterns(audit, annotators), annotators)
    r = model.reliability()
    out = []
    for j, a in enumerate(annotators):
        i = int(np.argmax(model.copy[:, j]))
        out.append((a, float(round(r[j], 6)), int(np.argmax(model.member[j])), annotators[i] if model.copy[i, j] > 0 else None, float(round(model.copy[i, j], 6))))
    return audit.sparkSession.createDataFrame(out, "annotator string, reliability double, community int, copies string, copy_rate double")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus(table(spark, d, "human_vs_llm_audit")).select("trace_id", "label")


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus(table(spark, d, "human_vs_llm_audit"))


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    return annotator_reliability(table(spark, d, "human_vs_llm_audit"))


QUERIES = {"p3_found": p3_found, "p3_agreement": p3_agreement, "p3_annotators": p3_annotators}
SQL: dict[str, str] = {}
