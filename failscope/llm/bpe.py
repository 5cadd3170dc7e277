"""Problem 8: encode the whole corpus with a public byte-level BPE vocabulary.

The pre-tokens of a text are merged by a rank queue whose priority structure is a hierarchical
bitmap: every merge rank has a bucket, a linked list of the positions where its pair stands, and
three levels of 64-bit words tell which buckets are filled. The next rank is found by three
find-first-set steps, whatever the length of the pre-token; entries whose pair has changed since
are stale and skipped. So a pre-token of n bytes takes O(n) queue operations, where the usual scan
for the lowest rank takes O(n^2) on long runs without white space.

Scale: a narrow Arrow pass, no shuffle. Each Python worker loads the vocabulary once and keeps a
bounded memo of pre-tokens that it has merged.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.session import require, table

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: pre-tokens kept per Python worker, and the longest one that is kept
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64

#: The published split of this vocabulary, and the same for text that is all ASCII.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT_ASCII = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""


class RankBuckets:
    """Hierarchical bitmap over ranks 0..limit-1; each set rank heads a linked list of positions."""

    __slots__ = ("heads", "low", "mid", "top")

    def __init__(self, limit: int) -> None:
        self.low = [0] * ((limit >> 6) + 1)
        self.mid = [0] * ((len(self.low) >> 6) + 1)
        self.top = 0
        self.heads: dict[int, tuple] = {}

    def push(self, rank: int, position: int, left: int, right: int) -> None:
        below = self.heads.get(rank)
        self.heads[rank] = (position, left, right, below)
        if below is None:
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b

    def pop_bucket(self):
        """The lowest set rank and its list, taken out; None when all is empty."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        a = (b << 6) | ((self.mid[b] & -self.mid[b]).bit_length() - 1)
        bit = self.low[a] & -self.low[a]
        rank = (a << 6) | (bit.bit_length() - 1)
        self.low[a] ^= bit
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return rank, self.heads.pop(rank)


class Encoder:
    """Byte-level BPE over ranks {bytes: id}; the rank of a merge is the id of what it makes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.limit = max(ranks.values()) + 1
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: pair of ids -> id made of them; filled as pairs are met
        self.spelling = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.split = regex.compile(SPLIT).findall
        self.split_ascii = re.compile(SPLIT_ASCII).findall
        self.queue = RankBuckets(self.limit)
        encoder = self

        class Memo(dict):
            def __missing__(self, token: str) -> tuple[int, ...]:
                ids = encoder.merge(token.encode("utf-8", "replace"))
                if len(token) <= MEMO_CHARS:
                    if len(self) >= MEMO_ENTRIES:
                        self.clear()
                    self[token] = ids
                return ids

        self.memo = Memo()

    def _made(self, left: int, right: int) -> int:
        """The id of a merged pair, or -1."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            got = self.ranks.get(self.spelling[left] + self.spelling[right], -1)
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def merge(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue, made = self.queue, self._made
        for i in range(n - 1):
            rank = made(ids[i], ids[i + 1])
            if rank >= 0:
                queue.push(rank, i, ids[i], ids[i + 1])
        while (found := queue.pop_bucket()) is not None:
            rank, entry = found
            places = []
            while entry is not None:
                places.append(entry)
                entry = entry[3]
            places.sort(key=lambda e: e[0])  # of equal ranks the leftmost merges first
            for i, left, right, _ in places:
                j = after[i]
                if ids[i] != left or j >= n or ids[j] != right:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                k = after[j]
                after[i] = k
                if k < n:
                    before[k] = i
                    r = made(rank, ids[k])
                    if r >= 0:
                        queue.push(r, i, rank, ids[k])
                h = before[i]
                if h >= 0:
                    r = made(ids[h], rank)
                    if r >= 0:
                        queue.push(r, h, ids[h], rank)
        out = []
        i = 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return tuple(out)

    def encode_into(self, text: str, out) -> None:
        pieces = self.split_ascii(text) if text.isascii() else self.split(text)
        out.extend(chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        self.encode_into(text, out)
        return out


def load_ranks(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> dict[bytes, int]:
    """{token bytes: id} of a public vocabulary file (.tiktoken lines of base64 and rank)."""
    lines = Path(directory, f"{name}.tiktoken").read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Encoder:
    key = (directory, name)
    if key not in _encoders:
        _encoders[key] = Encoder(load_ranks(directory, name))
    return _encoders[key]


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(id_col, ids array<int>) of every row, without special tokens.

    Defined results: an empty or null text gives an empty list; the whole text is encoded,
    whatever its length or language; strings of special tokens are ordinary text; repeated rows
    stay repeated; other columns are ignored.
    """
    source = require(documents, id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(directory, name)
        for b in batches:
            start = 0
            while start < b.num_rows:  # whole rows, in slices whose ids stay small in memory
                ids: list[int] = []
                ends = [0]
                column = b.column(1)
                stop = start
                while stop < b.num_rows and len(ids) < 1_500_000:
                    text = column[stop].as_py()
                    if text:
                        enc.encode_into(text, ids)
                    ends.append(len(ids))
                    stop += 1
                values = pa.array(np.fromiter(ids, dtype=np.int32, count=len(ids)))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), lists], names=[id_col, "ids"])
                start = stop

    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents and ids per source, a corpus count."""
    docs = table(spark, d, "documents")
    per = encode_corpus(docs).select("doc_id", F.size("ids").alias("n"))
    return per.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("bigint").alias("n_ids"))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths}
SQL: dict[str, str] = {}


def vocabulary_json(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> dict:
    """The same vocabulary as the tokenizers library stores it."""
    return json.loads(Path(directory, f"{name}.json").read_text())
