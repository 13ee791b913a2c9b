"""Best-fit packing by minimum bin slack.

Only lengths matter for the bins, so the plan is made on the histogram of lengths (at most `capacity` numbers, at any
input size). Each bin takes the longest length left; a bitset subset-sum over the other lengths that are left finds the
fullest combination that still fits, and that combination is removed from the histogram, as often at once as the counts
allow. A removal uses a length up or nearly so, so the plan has few patterns more than there are lengths. Pieces then
get their places from their number among the pieces of their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .sharding import numbered

CAPACITY = 2048
#: Words whose ids a worker keeps; beyond that it starts anew.
KEPT_WORDS = 400_000
_EDGE = re.compile(r"\s")


class Encoder:
    """Ids of the byte-level BPE of a vocabulary file, as little-endian 32-bit numbers.

    The vocabulary's pattern never joins a space that stands between two other characters to what is before it, so a
    text is encoded word by word, and the ids of a word with its space are kept. Texts with other runs of white space
    are encoded in one piece. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = self._ranks(path)
        self.kept: dict[str, bytes] = {}

    def _ranks(self, path: str):
        """The same ids by a faster library, if the vocabulary is there as ranks."""
        import os

        other = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(other):
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        with open(other, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast else self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        kept, out = self.kept, [self.plain(head)]
        for w in rest:
            ids = kept.get(w)
            if ids is None:
                if not w or _EDGE.match(w[0]) or _EDGE.match(w[-1]):
                    return self.plain(text)
                ids = self._spaced(w)
            out.append(ids)
        if _EDGE.match(head[-1:]):
            return self.plain(text)
        return b"".join(out)

    def _spaced(self, w: str) -> bytes:
        if len(w) > 64:
            return self.plain(" " + w)
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        ids = self.kept[w] = self.plain(" " + w)
        return ids


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity if there are more."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = ["doc_id", "nth", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
        for batch in batches:
            held: list[list] = [[] for _ in names]
            size = 0
            for doc_id, nth, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = enc(text.as_py() or "") + b"\0\0\0\0"
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, v in zip(held, (doc_id, nth, k, start, length, zlib.crc32(part), part), strict=False):
                        column.append(v)
                    size += len(part) * with_ids + 48
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds, strict=True)], names)
                    held, size = [[] for _ in names], 0
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds, strict=True)], names)

    return pieces


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = True, nth: str | None = None) -> DataFrame:
    """(doc_id, nth, piece, start, length, ids_crc32[, ids]) of all texts; each text ends with id 0; null is empty.

    ids are little-endian 32-bit numbers. nth names a column of docs with a number that tells rows of one doc_id apart; otherwise it is 0.
    """
    number = (F.col(nth) if nth else F.lit(0)).cast("long")
    schema = "doc_id long, nth long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", number.alias("nth"), "text").mapInArrow(_pieces(path, capacity, with_ids), schema)


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how often) of the combination with the largest sum up to room: subset sums as the bits of an integer.

    A count goes in as 1, 2, 4, ... of a length, so one pass of shifts a length suffices.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for n, c in zip(lengths, counts, strict=True):
        if n > room:
            continue
        left, k = min(c, room // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, bits))
            bits |= (bits << (n * k)) & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    sum_, out = bits.bit_length() - 1, Counter()
    for n, k, before in reversed(steps):
        if not before >> sum_ & 1:
            out[n] += k
            sum_ -= n * k
    return sorted(out.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, how often)]) of the patterns."""
    left, out = {n: c for n, c in histogram.items() if c > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        # Long ones first: short ones fit later as well.
        order = sorted((n for n, c in rest.items() if c), reverse=True)
        combined = Counter(dict(fullest(order, [rest[n] for n in order], capacity - longest)))
        combined[longest] += 1
        times = min(left[n] // k for n, k in combined.items())
        out.append((times, sorted(combined.items(), reverse=True)))
        for n, k in combined.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _placer(patterns: list[tuple[int, list[tuple[int, int]]]]):
    """A function of (length, number among its length) that gives (sequence, offset)."""
    used: Counter = Counter()
    rows, base = [], 0
    for times, combined in patterns:
        offset = 0
        for n, k in combined:
            rows.append((n, used[n], base, k, offset))
            used[n] += times * k
            offset += n * k
        base += times
    rows.sort()
    lengths, firsts, bases, often, offsets = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    wide = np.int64(1) << np.int64(48)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lengths * wide + firsts
        for batch in batches:
            n, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(keys, n * wide + number, "right") - 1
            rank = number - firsts[at]
            sequence, offset = bases[at] + rank // often[at], offsets[at] + rank % often[at] * n
            keep = [i for i, c in enumerate(batch.schema.names) if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    return place


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, nth: str | None = None) -> DataFrame:
    """One row per piece: doc_id, nth, piece, start, length, ids_crc32, sequence_id, offset.

    Every sequence holds at most capacity ids, without gaps. Rows that repeat a doc_id are documents of their own; a
    null doc_id stays null. A null or empty text is one piece of the id 0. Other columns are ignored; an empty table
    gives no rows. The ids themselves come from pieces().
    """
    held = materialize(pieces(docs, path, capacity, False, nth), "pieces")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    schema = "doc_id long, nth long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if not histogram:
        return held.sparkSession.createDataFrame([], schema)
    rows = numbered(held, ["length"], ["doc_id", "nth", "piece", "ids_crc32"], "number").withColumn("number", F.col("number").cast("long"))
    return rows.select("doc_id", "nth", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_placer(plan(histogram, capacity)), schema)
