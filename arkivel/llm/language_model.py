"""LM scoring by deleted interpolation.

P(w | h) = l2 * c(h w) / c(h) + l1 * c(w) / N + l0 / (V + 1); the mixture weights depend on the bucket of c(h), and are
learned by expectation-maximisation on the counts of held-out training blocks, against the maximum-likelihood estimates
of all other training blocks. The final estimates use all training counts.

Documents are dealt into blocks by doc_id and text. A block sends its distinct n-grams once, with counts: that is its share of
the corpus counts and its request for them. Requests meet by ranges of n-gram hashes, where counts are summed and sent
back to each block in the order it asked. So each occurrence is looked up within its block, and what is moved grows
with distinct n-grams per block, not with tokens. n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .texts import MIX1, MIX2, column, hashes, mix, words

#: Bytes of text of a block, on average; fewer for small inputs, which have BLOCKS_AT_LEAST.
BLOCK_BYTES, BLOCKS_AT_LEAST = 12 << 20, 24
#: Every HELD-th block is held out of the counts that EM sees as the model's.
HELD = 8
#: Upper edges of the buckets of c(h).
EDGES = (0, 1, 3, 10, 30, 100, 1000, 10_000, 100_000)
#: Steps per octave of the grid on which EM sees ratios of estimates.
GRID = 8
END = np.uint64(0x5851F42D4C957F2D)
_U = np.uint64


def tokens(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, unigram, bigram): hashes of each text's tokens and of their bigrams; an end follows the words of a text.

    The context of a text's first token is the end token.
    """
    offsets, data = column(arr)
    first, s, e, low = words(offsets, data)
    h = hashes(low, s, e)
    n = np.diff(first)
    docs = np.arange(len(n))
    out = np.full(len(h) + len(n), END, _U)
    out[np.arange(len(h)) + np.repeat(docs, n)] = h
    first = first + np.arange(len(first))
    context = np.empty_like(out)
    context[1:] = out[:-1]
    context[first[:-1]] = END
    return first, out & ~_U(1), mix(context * MIX1 + mix(out) * MIX2) | _U(1)  # the last bit tells the orders apart


def _distinct(one: np.ndarray, two: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, place of each unigram, place of each bigram) of a block; keys in ascending order."""
    keys, where = np.unique(np.concatenate([one, two]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([weight, weight]), len(keys)).astype(np.uint64)
    return keys, counts, where[: len(one)], where[len(one) :]


def _learns(table: pa.Table, first: np.ndarray) -> np.ndarray:
    learns = np.array(table.column("learns").to_pylist(), bool)
    return np.repeat(learns, np.diff(first)).astype(np.float64)


def _deltas(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as 6-byte differences, or as they are if a difference is too large."""
    if len(keys) < 2:
        return b"\0" + keys.tobytes()
    gaps = np.diff(keys)
    if int(gaps.max()) >> 48:
        return b"\0" + keys.tobytes()
    return b"\1" + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _keys(raw: bytes) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(raw, _U, offset=1)
    gaps = np.zeros(((len(raw) - 9) // 6, 8), np.uint8)
    gaps[:, :6] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(np.concatenate([np.frombuffer(raw, _U, 1, 1), gaps.view(_U).ravel()]))


def _small(counts: np.ndarray) -> bytes:
    """Counts with one byte each where that is enough."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return low.tobytes() + counts[counts >= 255].astype(np.uint64).tobytes()


def _counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.uint64)
    out[out == 255] = np.frombuffer(raw[n:], np.uint64)
    return out


def _ask(parts: int):
    bits = parts.bit_length() - 1

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        first, one, two = tokens(table.column("text"))
        learns = _learns(table, first)
        keys, counts, _, _ = _distinct(one, two, learns)
        ends = np.searchsorted(keys >> _U(64 - bits), np.arange(parts + 1, dtype=_U)) if bits else np.array([0, len(keys)])
        some = np.flatnonzero(np.diff(ends))
        cut = [(int(ends[p]), int(ends[p + 1])) for p in some]
        blobs = [_deltas(keys[a:b]) for a, b in cut]
        return pa.table({"block": pa.array([block] * len(cut), pa.int32()), "part": pa.array(some.astype(np.int32)), "n": pa.array([b - a for a, b in cut], pa.int32()), "keys": pa.array(blobs, pa.binary()), "counts": pa.array([_small(counts[a:b]) for a, b in cut], pa.binary()), "tokens": pa.array([int(learns.sum()) if k == 0 else 0 for k in range(len(cut))], pa.int64())})

    return ask


def _answer(held: int):
    """Sums the counts of a range of n-grams over all blocks; answers each block in its own order.

    Held-out blocks also get the counts without any held-out block.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows = [(b.as_py(), n.as_py(), k.as_py(), c.as_py()) for b, n, k, c in zip(*(table.column(x) for x in ("block", "n", "keys", "counts")), strict=True)]
        part = table.column("part")[0].as_py()
        keys = np.concatenate([_keys(k) for _, _, k, _ in rows])
        counts = np.concatenate([_counts(c, n) for _, n, _, c in rows])
        out = np.concatenate([np.full(n, b % held == 0) for b, n, _, _ in rows])
        distinct, where = np.unique(keys, return_inverse=True)
        everything = np.bincount(where, counts, len(distinct)).astype(np.uint64)
        fitted = everything - np.bincount(where, counts * out, len(distinct)).astype(np.uint64)
        ends = np.cumsum([0, *(n for _, n, _, _ in rows)])
        total, less = everything[where], fitted[where]
        known = int(((distinct & _U(1)) == 0)[everything > 0].sum())
        return pa.table({"block": pa.array([b for b, _, _, _ in rows], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "tokens": table.column("tokens").combine_chunks(), "vocabulary": pa.array([known, *[0] * (len(rows) - 1)], pa.int64()), "n": pa.array([n for _, n, _, _ in rows], pa.int32()), "total": pa.array([_small(total[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), "fitted": pa.array([_small(less[a:b]) if r[0] % held == 0 else b"" for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True)], pa.binary())})

    return answer


def _joined(answers: pa.Table, name: str) -> np.ndarray:
    answers = answers.sort_by("part")
    return np.concatenate([_counts(r.as_py(), n.as_py()) for r, n in zip(answers.column(name), answers.column("n"), strict=True)]).astype(np.float64)


def _estimates(first, one, two, counts, where1, where2, n, v):
    """For each token: c(h w) / c(h) (0 if h is new), c(w) / N, 1 / (V + 1), bucket of c(h)."""
    c1, c2 = counts[where1], counts[where2]
    context = np.empty_like(c1)
    context[1:] = c1[:-1]
    starts = first[:-1]
    context[starts] = c1[first[1:] - 1]  # the end token's own count
    p2 = np.divide(c2, context, out=np.zeros_like(c2), where=context > 0)
    return p2, c1 / max(n, 1), 1 / (v + 1), np.searchsorted(EDGES, context, "left"), c1


def _statistics(n: float, v: float):
    """Held-out counts on a grid of the logarithms of the estimates."""

    def statistics(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({k: pa.array([], pa.int32()) for k in ("bucket", "two", "one")} | {"n": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        first, one, two = tokens(left.column("text"))
        learns = _learns(left, first) > 0
        _, _, w1, w2 = _distinct(one, two, np.ones(len(one)))
        p2, p1, p0, bucket, _ = _estimates(first, one, two, _joined(right, "fitted"), w1, w2, n, v)
        grid = lambda p: np.where(p > 0, np.round(GRID * np.log2(np.maximum(p, 1e-300) / p0)), -9999).astype(np.int32)
        rows, count = np.unique(np.stack([bucket.astype(np.int32), grid(p2), grid(p1)], axis=1)[learns], axis=0, return_counts=True)
        return pa.table({"bucket": pa.array(rows[:, 0]), "two": pa.array(rows[:, 1]), "one": pa.array(rows[:, 2]), "n": pa.array(count.astype(np.int64))})

    return statistics


def weights(bucket: np.ndarray, two: np.ndarray, one: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """(buckets, 3) mixture weights for orders 2, 1, 0 by expectation-maximisation; a bucket without data gets fixed ones."""
    ratio = lambda g: np.where(g == -9999, 0.0, np.exp2(g / GRID))
    p = np.stack([ratio(two), ratio(one), np.ones(len(one))], axis=1)
    out = np.tile([0.3, 0.6, 0.1], (len(EDGES) + 1, 1))
    for b in range(len(out)):
        own = bucket == b
        if not own.any():
            continue
        x, c = p[own], n[own][:, None]
        for _ in range(rounds):
            post = x * out[b]
            post /= post.sum(axis=1, keepdims=True)
            out[b] = ((post * c).sum(axis=0) + [0.1, 0.1, 0.1]) / (c.sum() + 0.3)
    out[0] = [0, out[0, 1] / (out[0, 1] + out[0, 2]), out[0, 2] / (out[0, 1] + out[0, 2])]  # a new context says nothing
    return out


def _score(n: float, v: float, mixture: np.ndarray):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        first, one, two = tokens(left.column("text"))
        _, _, w1, w2 = _distinct(one, two, np.ones(len(one)))
        p2, p1, p0, bucket, c1 = _estimates(first, one, two, _joined(right, "total"), w1, w2, n, v)
        lam = mixture[bucket]
        sums = lambda x: np.add.reduceat(x, first[:-1])
        logs = np.log10(np.maximum(lam[:, 0] * p2 + lam[:, 1] * p1 + lam[:, 2] * p0, 1e-300))
        base = np.log10((c1 + 1) / (n + v + 1))
        return pa.table({"doc_id": left.column("doc_id").combine_chunks(), "held_out": pa.array([not x for x in left.column("learns").to_pylist()], pa.bool_()), "n_tokens": pa.array(np.diff(first)), "n_known": pa.array(sums((c1 > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(first) - 1, int(n))), "base_score": pa.array(sums(base)), "score": pa.array(sums(logs))})

    return score


def scored(docs: DataFrame, learns, block_bytes: int = BLOCK_BYTES, held: int = HELD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    learns: a condition on docs' columns; the model learns from the rows where it holds, held_out marks the others.
    A null text is empty and has the end token alone. Rows that repeat a doc_id count one by one; a null doc_id is a
    document like any other, and learns if the condition is true. An empty table gives no rows; other columns are
    ignored. If nothing is learned all counts are 0.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(BLOCKS_AT_LEAST, -(-size // block_bytes))
    parts = 1 << max(3, (blocks - 1).bit_length())
    rows = docs.select("doc_id", "text", F.coalesce(learns, F.lit(False)).alias("learns"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    asked = rows.groupBy("block").applyInArrow(_ask(parts), "block int, part int, n int, keys binary, counts binary, tokens long")
    answers = asked.groupBy("part").applyInArrow(_answer(held), "block int, part int, tokens long, vocabulary long, n int, total binary, fitted binary")
    answers = materialize(answers, "answers")
    n, n_held, v = answers.agg(F.sum("tokens"), F.sum(F.when(F.col("block") % held == 0, F.col("tokens"))), F.sum("vocabulary")).first()
    n, n_held, v = n or 0, n_held or 0, v or 0
    some = F.col("block") % held == 0
    grid = rows.where(some).groupBy("block").cogroup(answers.where(some).groupBy("block")).applyInArrow(_statistics(n - n_held, v), "bucket int, two int, one int, n long")
    got = grid.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toArrow()  # cells of a fixed grid
    mixture = weights(*(got.column(c).to_numpy() for c in ("bucket", "two", "one", "n")))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(n, v, mixture), schema)
