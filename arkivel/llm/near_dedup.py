"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

One hash of each shingle serves all bins of a signature (one permutation); an empty bin copies a filled bin that a
bin-specific random order of all bins names first (optimal densification). Texts of equal shingle sets are one class
from then on, so copies cost nothing. Classes that agree on a band share a bucket, and a bucket gives star edges only:
from its member of fewest shingles, the centre, to the others. The full shingle sets confirm an edge.

Members that are not linked to their centre may be linked to each other. At most 100 - percent per cent of a member's
shingles are missing in one that it is linked to; and of two linked members, one of them not linked to a centre of no
more shingles, some shingle outside the centre is in both. So among the shingles of a member outside the centre, in the
order of their hashes, the first of those it shares stands within the first (100 - percent) per cent of its size, plus
one. These few shingles are its keys: linked members always meet again under one of them, without the centre, and so on
until no new pair is compared. The filter is exact: within a bucket no link is lost, and only the bands of the signature
leave anything to chance. Every member of a large bucket of several components gets these keys, whether linked with the
centre or not and whenever it was compared, and stays under them for good. A bucket that fits into a task is settled
there by the same filter, with the rarest shingles first. No bucket or number of partners is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import components
from .texts import MIX1, MIX2, mix, shingle_sets

BANDS, ROWS, WIDTH, PERCENT = 48, 7, 5, 80
#: A bucket of so many shingles at most is settled within one task once its centre is done; larger ones are split by keys.
TASK_SHINGLES = 1 << 20


@cache
def _orders(bins: int) -> np.ndarray:
    """[i, j]: the place of bin j in the order in which bin i, if empty, asks the others."""
    return np.argsort(np.random.default_rng(1).random((bins, bins)), axis=1).argsort(axis=1).astype(np.int32)


def signature(x: np.ndarray, bins: int) -> np.ndarray:
    """One value per bin of a non-empty sorted set of hashes."""
    at = ((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # sorted: the first of a bin is its smallest
    full = at[first].astype(np.int64)
    out = np.empty(bins, np.uint64)
    out[full] = x[first]
    if len(full) < bins:
        empty = np.setdiff1d(np.arange(bins), full, assume_unique=True)
        out[empty] = x[first][_orders(bins)[np.ix_(empty, full)].argmin(axis=1)]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    factors = np.multiply.accumulate(np.full(rows, MIX1, np.uint64))
    return mix((mix(sig.reshape(bands, rows)) * factors).sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * MIX2).view(np.int64)


def _sketcher(bands: int, rows: int, width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, keys = [], [], []
            for _, x in shingle_sets(batch.column(1), width):
                n.append(len(x))
                digests.append(hashlib.sha256(x.tobytes()).digest()[:16] if len(x) else None)
                keys.append(band_keys(signature(x, bands * rows), bands, rows) if len(x) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "n_shingles", "digest", "bands"])

    return sketch


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd blocks with their sizes, so that a shuffle moves less of them; a null is empty."""
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        packed = pa.array([pa.compress(r, "zstd", asbytes=True) for r in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), packed], ["doc_id", "size", "text"])


def _opened(batch: pa.RecordBatch) -> pa.Array:
    sizes, blocks = batch.column("size").to_pylist(), batch.column("text").to_pylist()
    return pa.array([pa.decompress(b, n, "zstd", asbytes=True) if n else b"" for n, b in zip(sizes, blocks, strict=True)], pa.large_binary()).cast(pa.large_string())


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = batch.column(0), [], 0
            done = 0
            for i, x in shingle_sets(_opened(batch), width):
                held.append(x.tobytes())
                size += x.nbytes
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([ids.slice(done, len(held)), pa.array(held, pa.binary())], ["rep", "hashes"])
                    held, size, done = [], 0, i + 1
            if held:
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(held)), pa.array(held, pa.binary())], ["rep", "hashes"])

    return sets


def prefix_keys(centre: int, outside: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Keys of a member of the given size by its sorted shingles outside the centre; see above for how many suffice."""
    first = outside[: (100 - percent) * size // 100 + 1]
    return mix(first ^ mix(np.array([centre], np.int64).view(np.uint64) + MIX2)).view(np.int64)


def _comparer(percent: int):
    """Sizes of intersection and union of a centre and a member, and the member's keys around that centre.

    Pairs from buckets that fit into a task (not wide) need no keys.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, union, keys = [], [], []
            for c, wide, x, y in zip(batch.column("centre").to_pylist(), batch.column("wide").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                both.append(int(same.sum()))
                union.append(len(x) + len(y) - both[-1])
                keys.append(prefix_keys(c, y[~same], len(y), percent) if wide else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("centre"), batch.column("rep"), batch.column("n"), pa.array(both, pa.int64()), pa.array(union, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["centre", "rep", "n", "common", "whole", "apart"])

    return compare


def _settler(percent: int):
    """Links among the members (rep, comp, hashes) of one bucket, but for those that comp or other links connect."""

    def settle(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("n", "ascending"), ("rep", "ascending")])
        reps, up = bucket.column("rep").to_pylist(), {c: c for c in bucket.column("comp").to_pylist()}
        own = bucket.column("comp").to_pylist()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in bucket.column("hashes")]

        def root(k):
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        once = int((counts == 1).sum())  # ranks below that are of one member
        ranks = [np.sort(r) for r in np.split(rank[at.ravel()], np.cumsum([len(x) for x in sets])[:-1])]
        holders, a, b = {}, [], []
        for i, x in enumerate(ranks):
            first = x[: (100 - percent) * len(x) // 100 + 1]
            first = first[first >= once].tolist()
            for j in {j for r in first for j in holders.get(r, ())}:
                y = ranks[j]
                if 100 * len(y) >= percent * len(x) and root(own[i]) != root(own[j]):
                    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        up[root(own[i])] = root(own[j])
                        a.append(reps[j])
                        b.append(reps[i])
            for r in first:
                holders.setdefault(r, []).append(i)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return settle


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): digest names the shingle set; null and no bands if that is empty."""
    return docs.select("doc_id", "text").mapInArrow(_sketcher(bands, rows, width), "doc_id long, n_shingles long, digest binary, bands array<long>")


def _labelled(active: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return active.withColumn("comp", F.col("rep"))
    return active.join(labels, active["rep"] == labels["node"], "left").select(*active.columns, F.coalesce("component", "rep").alias("comp"))


def class_links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame | None:
    """(node, component) of the classes (rep, n, bands) that are linked with others; None without any.

    rep is the doc_id whose text stands for the class.
    """
    active = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = materialize(active.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"), "buckets")
    active = materialize(active.join(shared, "key").select("key", "rep", "n"), "members")
    spent, labelled = [shared, active], []
    if active.isEmpty():
        release(*spent)
        return None
    needed = active.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").mapInArrow(_pressed, "doc_id long, size long, text binary")
    texts = texts.join(needed.hint("merge"), "doc_id", "left_semi")  # ids grow with the input: no broadcast
    sets = materialize(texts.mapInArrow(_sets(width), "rep long, hashes binary"), "sets")
    release(shared)
    fresh, tested, links, labels = active, None, None, None
    while True:
        # Buckets with new members; all others were settled when they last had some, as components only grow together.
        now = active if tested is None else active.join(fresh.select("key").distinct(), "key", "left_semi")
        now = materialize(_labelled(now, labels), "open")
        stars = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("n", "rep")).alias("c"), F.sum("n").alias("total"))
        centres = materialize(stars.where("lo < hi").select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("least"), (F.col("total") > TASK_SHINGLES).alias("wide")), "centres")
        if centres.isEmpty():
            spent += [now, centres]
            break
        # Every member is compared, also those linked with the centre: others may be linked to them alone. Only one too
        # large for a link with the centre is not, in a bucket that is settled within a task: it needs no keys.
        able = F.col("wide") | (F.col("n") * percent <= F.col("least") * 100)
        pairs = now.join(centres, "key").where((F.col("rep") != F.col("centre")) & able).groupBy("centre", "rep", "n").agg(F.max("wide").alias("wide"))
        if tested is not None:  # a pair is compared again only if it had no keys and now needs them
            seen = tested.select(F.col("centre").alias("c"), F.col("rep").alias("r"), F.col("wide").alias("keyed"))
            pairs = pairs.join(seen, (F.col("centre") == F.col("c")) & (F.col("rep") == F.col("r")) & (F.col("keyed") | ~F.col("wide")), "left_anti")
        pairs = materialize(pairs, "pairs")
        left = sets.select(F.col("rep").alias("centre"), F.col("hashes").alias("x"))
        common = pairs.join(left, "centre").join(sets.withColumnRenamed("hashes", "y"), "rep")
        common = common.mapInArrow(_comparer(percent), "centre long, rep long, n long, common long, whole long, apart array<long>")
        common = materialize(common, "common")
        found = materialize(common.where(F.col("common") * 100 >= F.col("whole") * percent).select(F.col("centre").alias("a"), F.col("rep").alias("b")), "links")
        tested = pairs if tested is None else tested.union(pairs)
        spent += [pairs, common, found]
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = materialize(components(links), "labels")
            labelled.append(labels)
        rest = now.select("key", "rep", "n").join(centres.where("not wide"), "key").where("rep <> centre").select("key", "rep", "n")
        rest = materialize(_labelled(rest, labels), "rest")
        release(now, centres)
        still = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
        still = still.where("lo < hi").groupBy("members", "who").agg(F.min("key").alias("key")).select("key")  # buckets of the same members once
        inside = rest.join(still, "key").join(sets.hint("merge"), "rep").select("key", "rep", "n", "comp", "hashes")
        inside = materialize(inside.groupBy("key").applyInArrow(_settler(percent), "a long, b long").distinct(), "inside")
        release(rest)
        spent.append(inside)
        if not inside.isEmpty():
            links = inside if links is None else links.union(inside)
            labels = materialize(components(links), "labels")
            labelled.append(labels)
        fresh = common.where(F.size("apart") > 0).select(F.explode("apart").alias("key"), "rep", "n")
        if fresh.isEmpty():
            break
        active = active.union(fresh)
    release(*[t for t in spent if t is not shared], sets, *labelled[:-1])
    return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.

    Texts are linked if 100 * intersection >= percent * union of their shingle sets. A text without words (or null)
    has no shingles and no links. Rows that repeat a doc_id form one document each by their text; a null doc_id gets
    a null component and is kept. Other columns of docs are ignored. An empty table gives no rows.
    """
    sketched = materialize(sketches(docs, bands, rows, width), "sketches")
    some = sketched.where("digest is not null and doc_id is not null")
    classes = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    labels = class_links(docs, classes, percent, width)
    names = classes.select("digest", "rep")
    if labels is not None:
        names = names.join(labels, names["rep"] == labels["node"], "left").select("digest", F.coalesce("component", "rep").alias("rep"))
    names = materialize(names, "names")
    held = materialize(sketched.select("doc_id", "n_shingles", "digest"), "held")  # without the bands
    release(sketched, classes, *([labels] if labels is not None else []))
    out = held.join(names, "digest", "left")
    component = F.coalesce("rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
