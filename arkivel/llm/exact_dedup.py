"""Exact duplicates by a tree merge of sorted digest runs.

Every run holds one sorted entry per digest: the identifier to keep and the number of rows. In each binomial round the
runs of FAN neighbours exchange parts: a run is cut by the next digits of its digests, part d of all FAN runs goes to
one place, and a multiway merge of the sorted parts leaves one entry per digest there. After log_FAN(runs) rounds each
place holds one range of digests, merged over all runs. Entries shrink at every level, so a text that a third of all
rows share is at most one entry per run in the first round. Results go back down the tree the same way: to the entries
of the first runs, and from those to rows, keyed by run and digest, so that no key is hot on the way down either.

"Verified": entries are merged only if SHA-256, UTF-8 length and MD5 of the normalised text all agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .texts import column

FAN, LEVELS = 16, 2
_KEY = ["digest", "size", "check"]
_ENTRY = "place int, digest binary, size long, check binary, keep_id long, count long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = column(batch.column(1))
        sha, md5, view = [], [], memoryview(np.ascontiguousarray(data))
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            norm = bytes(view[a:b]).lower()  # of bytes: A-Z only
            sha.append(hashlib.sha256(norm).digest())
            md5.append(hashlib.md5(norm, usedforsecurity=False).digest()[:8])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary()), pa.array(np.diff(offsets)), pa.array(md5, pa.binary())], ["doc_id", "digest", "size", "check"])


def _merge(largest: bool):
    """Merges what a task holds of sorted runs: the stream is in the order of (place, digest), as Spark's external merge gives it."""
    better = max if largest else min

    def pick(ids):
        known = [x for x in ids if x is not None]
        return better(known) if known else None

    def rows(batches: Iterator[pa.RecordBatch]):
        names = ["place", *_KEY, "keep_id", "count"]
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        schema = pa.schema([("place", pa.int32()), ("digest", pa.binary()), ("size", pa.int64()), ("check", pa.binary()), ("keep_id", pa.int64()), ("count", pa.int64())])
        for key, same in groupby(rows(batches), itemgetter(0, 1, 2, 3)):
            keep, count = None, 0
            for x in same:
                keep, count = pick((keep, x[4])), count + x[5]
            out.append((*key, keep, count))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)

    return merge


def exact_duplicates(docs: DataFrame, keep: str = "smallest", fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after lower-casing A-Z; null counts as empty. keep: whether the smallest or the
    largest doc_id of a group stays. There are fan ** levels runs, set by doc_id. Rows that repeat both text and
    doc_id count one by one and are all kept if that doc_id is. A null doc_id is kept only where its group has no
    other. Other columns of docs are ignored; an empty table gives no rows.
    """
    assert keep in ("smallest", "largest")
    runs = fan**levels
    run = F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int")
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_digests, "doc_id long, digest binary, size long, check binary").withColumn("run", run), "digests")
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    first = materialize(rows.groupBy("run", *_KEY).agg(best.alias("keep_id"), F.count("*").alias("count")), "runs")
    # A place is a number of `levels` digits to the base of fan; level k swaps digit k of the run for digit k of the digest.
    entries = first.withColumn("place", F.col("run"))
    digits = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    for k in range(levels):
        unit = fan**k
        own = (F.floor(F.col("place") / unit) % fan).cast("int")
        new = (F.floor(digits / unit) % fan).cast("int")
        entries = entries.withColumn("place", (F.col("place") + (new - own) * unit).cast("int"))
        entries = entries.select("place", *_KEY, "keep_id", "count").repartition("place").sortWithinPartitions("place", *_KEY)
        entries = entries.mapInArrow(_merge(keep == "largest"), _ENTRY)
    top = materialize(entries.select(*_KEY, "keep_id", "count"), "merged")
    down = materialize(first.select("run", *_KEY).join(top, _KEY).select("run", *_KEY, "keep_id", F.col("count").alias("group_size")), "down")
    out = rows.join(down, ["run", *_KEY])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
