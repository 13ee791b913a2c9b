"""Document fingerprints: MinHash by many universal hash permutations over word shingles, in vectorised numpy.

Permutation p of a shingle hash x is the upper half of a[p] * x + b[p] mod 2**64. A fingerprint keeps 16 bits of each
minimum; the share of equal places of two fingerprints estimates the Jaccard similarity of the shingle sets. near()
joins bands of the minima in Spark and verifies the Jaccard similarity on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .near_dedup import band_keys, class_links
from .texts import column, groups, hashes, mix, shingles, words

PERMUTATIONS, WIDTH, BANDS, ROWS = 128, 5, 21, 6
#: Bytes of text of a range in with_next(), on average.
RANGE_BYTES = 8 << 20
#: Columns of with_next().
_DEALT = ["place", "tail", "doc_id", "text_key", "says", "class_id", "text"]
_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, 1024, np.uint64)


def minima(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """(sets, permutations) minima; those of an empty set are the largest number."""
    out = np.full((len(sets), permutations), 0xFFFFFFFF, np.uint32)
    full = [i for i, x in enumerate(sets) if len(x)]
    if not full:
        return out
    x = np.concatenate([sets[i] for i in full])
    at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    h = np.empty_like(x)
    for p in range(permutations):
        np.multiply(x, _A[p], out=h)
        np.add(h, _B[p], out=h)
        np.right_shift(h, np.uint64(32), out=h)
        out[full, p] = np.minimum.reduceat(h, at)
    return out


def short(minima_: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, mixed, as big-endian numbers."""
    return (mix(minima_.astype(np.uint64)) >> np.uint64(48)).astype(">u2")


def _sets(texts: list[str], width: int) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    first, s, e, low = words(offsets, np.frombuffer(b"".join(raw), np.uint8))
    return shingles(first, hashes(low, s, e), width)


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many, or all, of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, int | None, str]]:
    """(doc_id, text, class_id, next text) of the rows of each range, in order; a row of the next range comes last and is none itself.

    The class of a text comes in a row of its own just before the rows of that doc_id and text.
    """
    before, named, of = None, None, None
    for batch in batches:
        for place, tail, doc_id, text_key, says, class_id, text in zip(*(batch.column(c).to_pylist() for c in _DEALT), strict=True):
            if says:
                named, of = (doc_id, text_key), class_id
                continue
            row = (place, tail, doc_id, text or "", of if named == (doc_id, text_key) else None)
            if before is not None and not before[1]:
                assert before[0] == row[0], "a range ends without the first row of the next"
                yield before[2], before[3], before[4], row[3]
            before = row


def _compared(permutations: int, width: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"]

    def flush(held):
        ids, texts, classes, after = zip(*held, strict=True)
        changed = [edited(t, a) for t, a in zip(texts, after, strict=True)]
        chain = [*texts, after[-1]] if all(a is b for a, b in zip(after, texts[1:], strict=False)) else None
        prints = short(minima(_sets(chain or [*texts, *after], width), permutations))
        own, following = prints[: len(held)], prints[1:] if chain else prints[len(held) :]
        other = short(minima(_sets(changed, width), permutations))
        shas = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
        cols = [ids, [len(t) for t in texts], shas, [p.tobytes().hex() for p in own], [p.tobytes().hex() for p in other], (own == other).mean(axis=1), (own == following).mean(axis=1), classes]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()], strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in _pairs(batches):
            held.append(row)
            size += len(row[1])
            if size >= 1 << 20:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _cuts(ids: DataFrame, parts: int) -> list[int]:
    """About parts quantiles of key, in two steps, so that no task holds a summary of more than its share of them."""
    outer = math.isqrt(parts - 1) + 1
    inner = -(-parts // outer)
    first = ids.agg(F.percentile_approx("key", [i / outer for i in range(1, outer)], 20 * outer)).first()[0] if outer > 1 else []
    edges = np.unique(np.array(first or [], np.int64))

    @F.pandas_udf("int")
    def range_of(keys):
        return type(keys)(np.searchsorted(edges, keys.to_numpy(), "right").astype(np.int32))

    of = ids.withColumn("of", range_of("key"))
    second = of.groupBy("of").agg(F.percentile_approx("key", [i / inner for i in range(1, inner)] or [0.5], 20 * inner).alias("cuts"))
    return [*(first or []), *(c for r in second.select(F.explode("cuts").alias("c")).distinct().collect() for c in [r["c"]])]


def with_next(docs: DataFrame, classes: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(place, tail, doc_id, text_key, says, class_id, text), each partition in order: after the rows of a place the first of the next place, as tail.

    classes (doc_id, text_key, class_id), one row for each doc_id and text, are dealt along, as rows that only say a
    class: so they meet their texts without a join of their own.

    Places are ranges of doc_id between quantiles of the ids. Each quantile is itself a doc_id, so a range begins with
    it, and one shuffle of the texts brings every row and the one after it to one task. Null doc_ids come first.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    size, low = docs.agg(F.sum(F.octet_length("text")), F.min(key)).first()
    parts = max(1, -(-(size or 0) // range_bytes))
    cuts = _cuts(ids, parts) if parts > 1 else []
    bounds = spark.sparkContext.broadcast(np.unique(np.array([low or 0, *cuts], np.int64)))  # a number per range_bytes of text

    @F.pandas_udf("long")
    def place_of(ids):
        return type(ids)(np.searchsorted(bounds.value, ids.to_numpy(), "right") - 1)

    @F.pandas_udf("boolean")
    def leads(ids):
        b = bounds.value
        return type(ids)(b[np.searchsorted(b, ids.to_numpy(), "right") - 1] == ids.to_numpy())

    last = F.lit(len(bounds.value))
    rows = docs.select("doc_id", "text", key.alias("key")).withColumn("at", place_of("key")).withColumn("leads", leads("key"))
    both = F.array(F.struct(F.col("at").alias("place"), F.lit(False).alias("tail")), F.struct(F.pmod(F.col("at") - 1, last).alias("place"), F.lit(True).alias("tail")))
    rows = rows.select("doc_id", "text", "key", F.explode(F.when(F.col("leads"), both).otherwise(F.slice(both, 1, 1))).alias("p"))
    rows = rows.select("p.place", "p.tail", "key", "doc_id", F.xxhash64("text").alias("text_key"), F.lit(False).alias("says"), F.lit(None).cast("long").alias("class_id"), "text")
    if classes is not None:
        said = classes.select(key.alias("key"), "doc_id", "text_key", "class_id").withColumn("place", place_of("key"))
        rows = rows.unionByName(said.select("place", F.lit(False).alias("tail"), "key", "doc_id", "text_key", F.lit(True).alias("says"), "class_id", F.lit(None).cast("string").alias("text")))
    dealt = rows.repartition(max(8, len(bounds.value)), "place")
    return dealt.sortWithinPartitions("place", "tail", "key", "text_key", F.col("says").desc()).select(*_DEALT)


def compared(docs: DataFrame, classes: DataFrame | None = None, permutations: int = PERMUTATIONS, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one that follows by (doc_id, hash of the text), the first after the last. A null text is
    empty; an empty text has no shingles, a fingerprint of its own, and is like other empty texts only. Equal texts
    have equal fingerprints. Null doc_ids come first; an empty table gives no rows; other columns are ignored. With
    classes, as near() gives them, class_id comes as well.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"
    out = with_next(docs, classes).mapInArrow(_compared(permutations, width), schema)
    return out if classes is not None else out.drop("class_id")


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, digest, n_shingles, bands): digest names the shingle set (null if empty), bands its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column(batch.column(1))
            for i, j in groups(offsets):
                first, s, e, low = words(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                sets = shingles(first, hashes(low, s, e), width)
                low = minima(sets, permutations)
                keys = [band_keys(m[: bands * rows].astype(np.uint64), bands, rows).tolist() if len(x) else [] for m, x in zip(low, sets, strict=True)]
                digests = [hashlib.sha256(x.tobytes()).digest()[:16] if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(digests, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "digest", "n_shingles", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, digest binary, n_shingles long, bands array<long>")


def near(docs: DataFrame, percent: int = 80, permutations: int = PERMUTATIONS, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, class_id): documents whose signature bands meet and whose Jaccard similarity is verified.

    class_id is the smallest doc_id that verified links lead to; texts without words are alone. text_key is the hash of
    the text; there is one row for each doc_id and text.
    """
    held = materialize(fingerprints(docs, permutations, width, bands, rows), "fingerprints")
    classes = materialize(held.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    labels = class_links(docs, classes, percent, width)
    names = classes.select("digest", "rep")
    if labels is not None:
        names = names.join(labels, names["rep"] == labels["node"], "left").select("digest", F.coalesce("component", "rep").alias("rep"))
    names = materialize(names, "names")
    named = held.join(names, "digest", "left").select("doc_id", "text_key", F.coalesce("rep", "doc_id").alias("class_id"))
    named = materialize(named.groupBy("doc_id", "text_key").agg(F.min("class_id").alias("class_id")), "class_ids")
    release(held, classes, names, *([labels] if labels is not None else []))
    return named


def compared_with_classes(docs: DataFrame) -> DataFrame:
    """The rows of compared() with the class_id of near()."""
    return compared(docs, near(docs))
