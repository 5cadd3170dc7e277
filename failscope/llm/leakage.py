"""Problem 9: evaluation texts that leak into training text.

Every window of WINDOW words of a held-out item gets a SimHash of 64 bits over its letter trigrams,
weighted by how often they stand in the window. The fingerprints go into a multi-index: RADIUS + 1
blocks of bits, each a table from block value to fingerprints. Two fingerprints within RADIUS bits
agree in at least one block, so probing all blocks finds every fingerprint within the radius. Windows
of the corpus probe the index. A few misread letters already turn more bits than that, so candidates
come from word pairs too: of WINDOW words with MISREAD misread ones at least LEAST_PAIRS pairs of
neighbours are as in the item, and each fixes the diagonal on which the others must stand. Candidates are
verified on the words themselves: shingles weighted by word length must agree to SIMILARITY or more,
and WINDOW consecutive words of the item must stand one after the other in the document, of which a
few may be misread.

Scale: one narrow pass over the corpus. The item index goes to the tasks in blocks of BLOCK_ITEMS
items (a fixed bound on what is broadcast); a larger item set takes more passes, not more memory.
A window with fewer words of the item vocabulary than a verified match must have is not hashed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm.subtitles import fold_py
from failscope.session import require, table

WINDOW, RADIUS, SIMILARITY = 12, 4, 0.8
#: of WINDOW words, how many may be misread beyond the usual confusions of letters
MISREAD = 4
#: MISREAD words leave at most MISREAD + 1 runs of exact words in a window, so at least so many exact pairs of neighbours
LEAST_PAIRS = WINDOW - MISREAD - (MISREAD + 1)
BLOCK_ITEMS = 5_000

_CLEAN = re.compile(
    r"^[﻿ \t]*(?:WEBVTT[^\n]*|\d+|[^\n]*-->[^\n]*)[ \t\r]*$|\{\d+\}\{\d+\}"  # frames
    r"|<[^<>\n]{1,40}>|\{\\[^{}\n]*\}|\{[a-zA-Z]:[^{}\n]*\}"  # styling
    r"|\[[^\[\]\n]{0,60}\]|\([^()\n]{0,60}\)|\*[^*\n]{1,60}\*"  # sound descriptions
    r"|(?:^|(?<=[|}>]))[ \t]*[-–—]?[ \t]*[A-Z][A-Z0-9 .'’-]{1,30}:(?=[ \t\r\n])",  # speakers
    re.M,
)
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\u00ad][ \t\r]*[\n|][\s|]*(?=[^\W\d_])")  # a word broken over lines or cues
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
def words(text: str) -> list[str]:
    """The spoken words of a subtitle file, or the words of an item, with confusable letters made one."""
    return _WORD.findall(fold_py(_HYPHEN.sub("", _CLEAN.sub(" ", text)).replace("\u00ad", "").replace("|", " ")))


_vectors: dict[str, np.ndarray] = {}


def _vector(word: str) -> np.ndarray:
    """Sum of the 64 signs of each letter trigram of a word."""
    v = _vectors.get(word)
    if v is None:
        if len(_vectors) > 200_000:
            _vectors.clear()
        padded = f" {word} "
        v = np.zeros(64, np.int32)
        for i in range(len(padded) - 2):
            bits = np.unpackbits(np.frombuffer(blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), np.uint8))
            v += bits.astype(np.int32) * 2 - 1
        _vectors[word] = v
    return v


def simhashes(ws: list[str]) -> np.ndarray:
    """The fingerprints of all windows of a word list."""
    sums = np.zeros((len(ws) + 1, 64), np.int32)
    np.cumsum(np.stack([_vector(w) for w in ws]), axis=0, out=sums[1:])
    bits = (sums[WINDOW:] - sums[:-WINDOW]) > 0
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def _near(a: str, b: str) -> bool:
    """Equal, or one word a misread form of the other; "m" also stands for the "rn" that was folded into it."""
    return a == b or _edited(a, b) or ("m" in a or "m" in b) and _edited(a.replace("m", "rn"), b.replace("m", "rn"))


def _edited(a: str, b: str) -> bool:
    """One edit apart, two from nine letters; a single letter for a single letter."""
    n, d = min(len(a), len(b)), len(a) - len(b)
    if abs(d) > 2 or n < 2 and d or n < 9 and abs(d) > 1:
        return False
    if n < 9:
        i = 0
        while i < n and a[i] == b[i]:
            i += 1
        return a[i + (d >= 0) :] == b[i + (d <= 0) :] and not any(c.isdigit() for c in a + b)
    if any(c.isdigit() for c in a + b):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > 2:
            return False
    return row[-1] <= 2


class ItemIndex:
    """Multi-index of the windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, words(t)) for i, t in items if t]
        self.items = [(i, ws) for i, ws in self.items if len(ws) >= WINDOW]
        self.vocabulary = {w for _, ws in self.items for w in ws}
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for k, (_, ws) in enumerate(self.items):
            for q, pair in enumerate(zip(ws, ws[1:])):
                self.pairs.setdefault(pair, []).append((k, q))
        codes, self.places = [], []
        for k, (_, ws) in enumerate(self.items):
            codes.append(simhashes(ws))
            self.places += [(k, q) for q in range(len(ws) - WINDOW + 1)]
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        edges = np.linspace(0, 64, RADIUS + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            shift, mask = np.uint64(lo), np.uint64((1 << int(hi - lo)) - 1)
            part = (self.codes >> shift) & mask
            order = np.argsort(part, kind="stable")
            self.blocks.append((shift, mask, part[order], order))

    def near(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position in codes, index of an item window) of all within RADIUS bits."""
        found: set[tuple[int, int]] = set()
        for shift, mask, keys, order in self.blocks:
            wanted = (codes >> shift) & mask
            lo, hi = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
            for n in np.flatnonzero(hi > lo).tolist():
                same = order[lo[n] : hi[n]]
                found.update((n, c) for c in same[np.bitwise_count(self.codes[same] ^ codes[n]) <= RADIUS].tolist())
        yield from sorted(found)

    def within_radius(self, code: np.uint64) -> np.ndarray:
        """Indices of all item windows within RADIUS bits."""
        return np.array([c for _, c in self.near(np.array([code], np.uint64))], np.int64)

    def verified(self, ws: list[str], p: int, k: int, q: int) -> bool:
        """The exact check of a document's window at p against an item's window at q."""
        item = self.items[k][1][q : q + WINDOW]
        seen = ws[p : p + WINDOW]
        weight = equal = misread = 0
        for a, b in zip(item, seen):
            weight += len(a)
            if a == b:
                equal += len(a)
            elif _near(a, b):
                misread += 1
                equal += len(a) - 1
            else:
                return False
        return misread <= MISREAD and equal >= SIMILARITY * weight

    def on_diagonal(self, ws: list[str], i: int, k: int, q: int) -> bool:
        """The document's words i and i + 1 are the item's at q: WINDOW words around them are verified."""
        item = self.items[k][1]
        lo, hi = 0, 2
        while hi < WINDOW + WINDOW - 2 and i + hi < len(ws) and q + hi < len(item) and _near(item[q + hi], ws[i + hi]):
            hi += 1
        while hi - lo < WINDOW + WINDOW - 2 and i + lo > 0 and q + lo > 0 and _near(item[q + lo - 1], ws[i + lo - 1]):
            lo -= 1
        return any(self.verified(ws, i + o, k, q + o) for o in range(lo, hi - WINDOW + 1))

    def leaked(self, text: str) -> set[int]:
        """The ids of the items of which the text holds WINDOW consecutive words."""
        ws = words(text)
        known = [0, *accumulate(w in self.vocabulary for w in ws)]
        need = WINDOW - MISREAD
        starts = [p for p in range(len(ws) - WINDOW + 1) if known[p + WINDOW] - known[p] >= need]
        if not starts:
            return set()
        lo, hi = starts[0], starts[-1] + WINDOW
        codes = simhashes(ws[lo:hi])
        found: set[int] = set()
        for n, c in self.near(codes[np.array(starts) - lo]):
            k, q = self.places[c]
            if self.items[k][0] not in found and self.verified(ws, starts[n], k, q):
                found.add(self.items[k][0])
        hits: dict[tuple[int, int], list[int]] = {}
        get, done = self.pairs.get, -1
        for p in starts:
            for i in range(max(p, done + 1), p + WINDOW - 1):
                for k, q in get((ws[i], ws[i + 1]), ()):
                    at = hits.setdefault((k, q - i), [])
                    at.append(i)
                    if len(at) >= LEAST_PAIRS and i - at[-LEAST_PAIRS] <= WINDOW - 2 and self.items[k][0] not in found and self.on_diagonal(ws, i, k, q):
                        found.add(self.items[k][0])
            done = max(done, p + WINDOW - 2)
        return found


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id): documents that hold WINDOW or more consecutive words of an item.

    Defined results: null, empty and blank texts, and items of fewer than WINDOW words, give no
    rows; repeated documents or items count once; other columns are ignored; whole texts are read.
    """
    docs = require(documents, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = require(items, item_id, item_text).toLocalIterator()  # read by blocks; the item set is the stated query set
    out, block = None, []

    def pass_over(block: list[tuple[int, str]]) -> DataFrame:
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shipped.value)
            for b in batches:
                ids, hits, texts = b.column(0), [], b.column(1)
                for i in range(b.num_rows):
                    text = texts[i].as_py()
                    if text:
                        hits += [(i, item) for item in index.leaked(text)]
                at = pa.array([i for i, _ in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([x for _, x in hits], pa.int64())], names=[id_col, item_id])

        return docs.mapInArrow(run, f"`{id_col}` {kind}, `{item_id}` bigint")

    for r in rows:
        block.append((r[0], r[1]))
        if len(block) == BLOCK_ITEMS:
            out, block = pass_over(block) if out is None else out.unionByName(pass_over(block)), []
    if block or out is None:
        out = pass_over(block) if out is None else out.unionByName(pass_over(block))
    return out.distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each leaked item."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
