"""Suffix-array dedup: bytes covered by a long string that also begins elsewhere.

A string of `length` bytes has one anchor: the place of the smallest hash among its `gram`-byte strings, the first of
equals. So the starts of such strings fall into runs with the same anchor, and equal strings have equal anchors at equal
distance. A run's stretch (all its strings) is dealt by the anchor's hash; a stretch whose anchor is nowhere else cannot
hold a repeat, and stretches that are alike (a class) are settled by their number. All classes that share an anchor with
another class form shards: every string that could be equal to another one is in the same shard as that. Within a shard the same
is done once more with parts of a stretch, of a few starts each, aligned by their distance to the anchor: parts that are
alike stand once, and parts whose strings all share what no other part has go. What is left of the shard is written to
disk and its suffixes are sorted by external induced sorting with common prefixes (induced_sort.py); a string begins
elsewhere if a neighbour shares `length` bytes or its stretch or part has copies.

An anchor with very many classes (a passage in ever other surroundings) is dealt anew by parts: a part's new anchor is
what all its strings share. So equal strings meet again, and parts that lie within the passage are one class. At the last
step a part is one string.

A second, shorter length (`passage`) can be asked for: its strings make the runs, a stretch goes on to the longer
strings' ends, and one sort serves both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .induced_sort import LIMIT, Scratch, repeated
from .texts import MIX1, MIX2, column, mix, powers

LENGTH, PASSAGE, GRAM = 400, 280, 64
#: Starts that are looked at in one piece, so that long texts take bounded memory; a multiple of neither matters.
PIECE = 1 << 19
#: Bytes of a shard, on average.
SHARD_BYTES = 3 << 20
#: Starts of a part within a shard.
PART = 16
#: Classes of an anchor that are sorted together; stretches of one with more are dealt anew in parts of so many starts.
HOT, PARTS = 16384, (32, 4, 1)
_RNG = np.random.default_rng(8)
_VALUE = [_RNG.integers(1, 1 << 63, 256, np.uint64) for _ in range(2)]
_PLACE = np.uint64((1 << 24) - 1)
_KEY, _ROW = ["anchor", "one", "two"], ["row_key", "row_two"]
_AT = ["start", "count", "length", "lead"]
_RUN = "anchor long, one long, two long, row_key long, row_two long, start long, count int, length int, lead int"
_NAMES, _KINDS = _KEY + _ROW + _AT, [pa.int64()] * 6 + [pa.int32()] * 3


def _minima(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbours: least of block suffixes and block prefixes."""
    n = len(key) - width + 1
    blocks = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def _sums(data: np.ndarray) -> list[np.ndarray]:
    up, out = powers(len(data) + 1)[0], []
    for value in _VALUE:
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * up[: len(data)], out=s[1:])
        out.append(s)
    return out


def _names_of(sums: list[np.ndarray], first: np.ndarray, count: np.ndarray, size: np.ndarray, lead: np.ndarray) -> list[np.ndarray]:
    """Two content hashes of the stretches data[first : first + size]."""
    down = powers(len(sums[0]))[1]
    salt = mix(((count * (1 << 40)) + (size * (1 << 20)) + lead).astype(np.uint64)) * MIX1
    return [mix((s[first + size] - s[first]) * down[first] + salt) for s in sums]


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, full: int | None = None) -> list[np.ndarray]:
    """(anchor hash, two content hashes, start, starts, bytes of the stretch, bytes before the anchor) of the runs of a text.

    A stretch has the strings of `full` bytes from its starts, as far as the text goes.
    """
    full = full or length
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    for low in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[low : low + PIECE + full - 1]
        starts = min(PIECE, len(data) - low - length + 1)
        sums, down = _sums(part), powers(len(part) + 1)[1]
        m = starts + length - gram
        h = mix((sums[0][gram : gram + m] - sums[0][:m]) * down[:m])
        at = (_minima((h & ~_PLACE) | np.arange(m, dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        turn = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.r_[0, turn], np.r_[turn, len(at)] - 1
        count, lead = last - first + 1, at[first] - first
        size = np.minimum(count + full - 1, len(part) - first)
        for held, got in zip(out, (h[at[first]], *_names_of(sums, first, count, size, lead), first + low, count, size, lead), strict=True):
            held.append(got)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def parts_of(data: np.ndarray, begin: np.ndarray, anchor: np.ndarray, count: np.ndarray, size: np.ndarray, lead: np.ndarray, width: int, length: int, full: int) -> list[np.ndarray]:
    """(stretch, anchor hash, two content hashes, offset, starts, bytes, bytes before the anchor) of the parts of stretches.

    A part has the starts of width successive distances to the anchor; its anchor is all that their strings share.
    """
    low = (lead - count + 1) // width
    k = lead // width - low + 1
    of = np.repeat(np.arange(len(k)), k)
    p = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + low[of]
    nearest = lead[of] - p * width  # the last start of the part, were the stretch that long, and where the anchor's bytes begin
    first, last = np.maximum(nearest - width + 1, 0), np.minimum(nearest, count[of] - 1)
    n = last - first + 1
    bytes_, before = np.minimum(n + full - 1, size[of] - first), lead[of] - first
    sums, down, at = _sums(data), powers(len(data) + 1)[1], begin[of] + nearest
    core = (sums[0][at - width + 1 + length] - sums[0][at]) * down[at]
    core = mix(core + mix(anchor.view(np.uint64)[of] + p.astype(np.uint64) * MIX2))
    return [of, core, *_names_of(sums, begin[of] + first, n, bytes_, before), first, n, bytes_, before]


def _runs(length: int, full: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column(batch.column(2))
            held, size = [], 0
            for key, two, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b - a < length:
                    continue
                got = runs(data[a:b], length, gram, full)
                n = len(got[0])
                held.append([*(x.view(np.int64) for x in got[:3]), np.full(n, key), np.full(n, two), *got[3:]])
                size += n
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], _NAMES)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], _NAMES)

    return find


def _parts(width: int, length: int, full: int):
    names = ["of_anchor", "of_one", "of_two", "offset", "n", *_NAMES]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), *_KINDS]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for key, two, text, wanted in zip(*(batch.column(c) for c in (*_ROW, "text", "wanted")), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for w in wanted.as_py():
                    one = [np.array([w[c]], np.int64) for c in ("anchor", "count", "length", "lead")]
                    got = parts_of(data[w["start"] : w["start"] + w["length"]], np.zeros(1, np.int64), *one, width, length, full)[1:]
                    k = len(got[0])
                    of = [np.full(k, v) for v in (w["anchor"], w["one"], w["two"])]
                    held.append([*of, got[3], np.full(k, w["n"]), *(x.view(np.int64) for x in got[:3]), np.full(k, key.as_py()), np.full(k, two.as_py()), got[3] + w["start"], *got[4:]])
                    size += k
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return cut


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches that each text is to give."""
    names = [*_KEY, "count", "lead", "body"]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        held, size = [[] for _ in names], 0
        for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            raw = text.as_buffer()
            for w in wanted.as_py():
                body = raw[w["start"] : w["start"] + w["length"]].to_pybytes()
                for c, v in zip(held, (w["anchor"], w["one"], w["two"], w["count"], w["lead"], body), strict=True):
                    c.append(v)
                size += len(body)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names)
                held, size = [[] for _ in names], 0
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names)


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _pieces(data: np.ndarray, begin: np.ndarray, anchor: np.ndarray, count: np.ndarray, size: np.ndarray, lead: np.ndarray, lengths: tuple[int, ...]):
    """(stretch, offset, starts) of the parts that have copies, and of the pieces of stretches that are to be sorted."""
    found, i = [], 0
    while i < len(begin):  # some stretches at a time
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + PIECE)))
        x, y = int(begin[i]), int(begin[j - 1] + size[j - 1])
        of, *rest = parts_of(np.asarray(data[x:y]), begin[i:j] - x, anchor[i:j], count[i:j], size[i:j], lead[i:j], PART, lengths[-1], lengths[0])
        found.append([of + i, *rest[:5]])
        i = j
    of, core, one, two, first, n = (np.concatenate(c) for c in zip(*found, strict=True))
    _, at, which, often = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    _, group = np.unique(core, return_inverse=True)
    bodies = np.bincount(group[at])
    once = np.zeros(len(of), bool)
    once[at] = True
    copies, own = often[which.ravel()] > 1, np.flatnonzero(once & (bodies[group] > 1))
    own = own[np.lexsort((first[own], of[own]))]
    joins = np.r_[False, (of[own[1:]] == of[own[:-1]]) & (first[own[1:]] == first[own[:-1]] + n[own[:-1]])][: len(own)]
    heads = np.flatnonzero(~joins)
    return (of[copies], first[copies], n[copies]), (of[own[heads]], first[own[heads]], np.add.reduceat(n[own], heads) if len(own) else n[own])


def _shard(lengths: tuple[int, ...]):
    names = [*_KEY, "from_", "to_", "whole"]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.bool_())]

    def mapped(file, kind) -> np.ndarray:
        file.flush()
        small = file.tell() <= LIMIT
        file.seek(0)
        return np.fromfile(file, kind) if small else np.memmap(file, kind, "r")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, scratch = [], [], Scratch()  # scratch of this task alone
        with scratch.file() as raw, scratch.file() as text:
            for batch in batches:
                for *key, count, lead, body in zip(*(batch.column(n) for n in (*_KEY, "count", "lead", "body")), strict=True):
                    keys.append(tuple(k.as_py() for k in key))
                    sizes.append((count.as_py(), len(body.as_buffer()), lead.as_py()))
                    raw.write(body.as_buffer())
            if not keys:
                return
            data = mapped(raw, np.uint8)
            count, size, lead = np.array(sizes, np.int64).T
            begin = np.cumsum(size) - size
            copies, pieces = _pieces(data, begin, np.array([k[0] for k in keys], np.int64), count, size, lead, lengths)
            flags = [scratch.array(len(data), bool) for _ in lengths]
            starts_of = lambda of, first, n, length: max(0, min(n, size[of] - first - length + 1))  # noqa: E731  that have so many bytes
            for of, first, n in zip(*(x.tolist() for x in copies), strict=True):
                for f, length in zip(flags, lengths, strict=True):
                    f[begin[of] + first : begin[of] + first + starts_of(of, first, n, length)] = True
            if len(pieces[0]):
                whole = np.minimum(pieces[2] + lengths[0] - 1, size[pieces[0]] - pieces[1])
                place = np.cumsum(whole + 1) - whole - 1
                own = scratch.array(int(place[-1] + whole[-1]) + 2, bool)  # behind its own starts a piece shows those of others
                for of, first, n, k, at in zip(*(x.tolist() for x in (*pieces, whole, place)), strict=True):
                    x = data[begin[of] + first : begin[of] + first + k]
                    np.append(x.astype(np.uint16) + np.uint16(2), np.uint16(1)).tofile(text)
                    own[at : at + n] = True
                np.zeros(1, np.uint16).tofile(text)
                for f, got, length in zip(flags, repeated(mapped(text, np.uint16), lengths, scratch, own), lengths, strict=True):
                    for of, first, n, at in zip(*(x.tolist() for x in (*pieces, place)), strict=True):
                        k = starts_of(of, first, n, length)
                        f[begin[of] + first : begin[of] + first + k] |= got[at : at + k]
        out: list[list] = [[] for _ in names]
        for key, a, n in zip(keys, begin.tolist(), count.tolist(), strict=True):
            found = [spans(f[a : a + n]) for f in flags]
            whole = [k == 0 for k, (s, _) in enumerate(found) for _ in s]
            if whole:
                for c, v in zip(out, (*key, np.concatenate([s for s, _ in found]), np.concatenate([e for _, e in found]), whole), strict=True):
                    c.append(v)
        for k in range(0, len(out[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 20_000], t) for c, t in zip(out, kinds, strict=True)], names)

    return shard


def _all_starts(lengths: tuple[int, ...]) -> Column:
    """The ranges of a stretch all of whose strings begin elsewhere."""
    full = F.least(F.col("at.count"), F.col("at.length") - lengths[0] + 1)
    ranges = [F.struct(F.lit(0).alias("a"), full.alias("b"), F.lit(True).alias("whole"))]
    ranges += [F.struct(F.lit(0).alias("a"), F.col("at.count").alias("b"), F.lit(False).alias("whole")) for _ in lengths[1:]]
    return F.filter(F.array(*ranges), lambda r: r["b"] > 0)


def _classes(rows: DataFrame, n: Column) -> DataFrame:
    return materialize(rows.groupBy(*_KEY).agg(n.alias("n"), F.min(F.struct(*_ROW, *_AT)).alias("at")), "stretches")


def _wanted(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Each text with the stretches that it gives for their classes."""
    some = classes.groupBy(*[F.col(f"at.{c}").alias(c) for c in _ROW]).agg(F.collect_list(F.struct(*_KEY, "n", *[f"at.{c}" for c in _AT])).alias("wanted"))
    return texts.join(some.hint("merge"), _ROW).select(*_ROW, "text", "wanted")


def _settled(texts: DataFrame, classes: DataFrame, lengths: tuple[int, ...], steps: tuple[int, ...]) -> DataFrame:
    """(anchor, one, two, ranges): of the classes, the starts whose strings begin elsewhere; steps: widths of parts to come."""
    ranges = "array<struct<a:int,b:int,whole:boolean>>"
    copies = classes.where("n > 1").select(*_KEY, _all_starts(lengths).cast(ranges).alias("ranges"))
    groups = materialize(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "groups")
    shared = materialize(classes.join(groups, "anchor"), "meeting")
    release(groups)
    if not steps:  # each class is one string of the shorter length, which its anchor stands for
        met = shared.where("n = 1").select(*_KEY, F.filter(_all_starts(lengths), lambda r: ~r["whole"]).cast(ranges).alias("ranges"))
        return materialize(copies.union(met), "marks")
    cold, hot = shared.where(F.col("classes") <= HOT), shared.where(F.col("classes") > HOT)
    size = cold.agg(F.sum("at.length")).first()[0] or 0
    bodies = _wanted(texts, cold).mapInArrow(_cut, "anchor long, one long, two long, count int, lead int, body binary")
    dealt = bodies.repartition(max(8, -(-size // SHARD_BYTES)), "anchor")
    sorted_ = dealt.mapInArrow(_shard(lengths), "anchor long, one long, two long, from_ array<int>, to_ array<int>, whole array<boolean>")
    sorted_ = materialize(sorted_, "sorted").join(classes.where("n = 1").select(*_KEY), _KEY, "left_semi")
    zipped = F.zip_with(F.arrays_zip("from_", "to_"), "whole", lambda r, w: F.struct(r["from_"].alias("a"), r["to_"].alias("b"), w.alias("whole")))
    marks = copies.union(sorted_.select(*_KEY, zipped.cast(ranges).alias("ranges")))
    if not hot.isEmpty():
        cut = _parts(steps[0], lengths[-1], lengths[0])
        parts = materialize(_wanted(texts, hot).mapInArrow(cut, "of_anchor long, of_one long, of_two long, offset int, n long, " + _RUN), "parts")
        known = _settled(texts, _classes(parts, F.sum("n")), lengths, steps[1:])
        each = parts.where("n = 1").join(known, _KEY)
        moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("offset")).alias("a"), (r["b"] + F.col("offset")).alias("b"), r["whole"].alias("whole")))
        again = each.groupBy("of_anchor", "of_one", "of_two").agg(F.flatten(F.collect_list(moved)).cast(ranges).alias("ranges"))
        marks = marks.union(again)
    return materialize(marks, "marks")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int | None = None) -> DataFrame:
    """(row_key, row_two, starts): of the rows with repeats, ranges [from, to) of the starts of strings that also begin elsewhere.

    Two hashes of (doc_id, text) name a row. whole tells strings of length bytes from those of passage bytes.
    """
    lengths = (length, passage) if passage and passage < length else (length,)
    texts = docs.select(*_row_names(), "text")
    found = materialize(texts.mapInArrow(_runs(lengths[-1], length, min(gram, lengths[-1])), _RUN), "runs")
    often = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    shared = materialize(found.join(often, "anchor"), "shared")
    release(found, often)
    marks = _settled(texts, _classes(shared, F.count("*")), lengths, PARTS)
    each = shared.select(*_KEY, *_ROW, "start").join(marks, _KEY)
    starts = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("from"), (r["b"] + F.col("start")).alias("to"), r["whole"].alias("whole")))
    return each.groupBy(*_ROW).agg(F.flatten(F.collect_list(starts)).alias("starts"))


def _row_names() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64(F.lit(8), "text", "doc_id").alias("row_two")]


def _united(a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that strings of length bytes from the starts a to b - 1 cover, as maximal spans."""
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order] - 1 + length)
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]][: len(a)])
    return a[new], b[np.r_[new[1:] - 1, len(a) - 1][: len(new)]]


def _stripped(length: int, passage: int | None, columns: list[str]):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage", "kept", "removed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            starts = batch.column("starts")
            ranges = starts.flatten()
            first, last, whole = (ranges.field(c).to_numpy(zero_copy_only=False) for c in ("from", "to", "whole"))
            ends = np.cumsum([0, *starts.value_lengths().fill_null(0).to_pylist()]).tolist()
            for text, lo, hi in zip(batch.column("text"), ends[:-1], ends[1:], strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                a, b, w = first[lo:hi], last[lo:hi], whole[lo:hi].astype(bool)
                removed = [x.tolist() for x in _united(a[w], b[w], length)]
                shorter = int(np.subtract(*_united(a[~w], b[~w], passage or length)[::-1]).sum())
                kept = b"".join(raw[x:y] for x, y in zip([0, *removed[1]], [*removed[0], len(raw)], strict=True))
                for c, v in zip(out, (len(raw), len(raw) - len(kept), len(removed[0]), hashlib.sha256(kept).hexdigest(), shorter, kept, list(zip(*removed, strict=True))), strict=True):
                    c.append(v)
            wanted = [i for i, n in enumerate(names) if n in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[i], kinds[i]) for i in wanted)], ["doc_id", *(names[i] for i in wanted)])

    return strip


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True, passage: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256[, n_passage][, kept, removed].

    Removes each byte covered by a string of `length` bytes that also starts anywhere else in the table, in the same
    text too; strings never go over the end of a text. With a shorter length `passage`, n_passage counts the bytes that
    strings of that length cover, which are reported and not removed. kept are the other bytes (they may begin or end
    within a character), removed the ranges. A null text is empty; rows that repeat doc_id and text repeat each other.
    An empty table gives no rows; other columns are ignored.
    """
    found = repeated_spans(docs, length, gram, passage)
    columns = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    if passage:
        columns["n_passage"] = "long"
    if with_bytes:
        columns |= {"kept": "binary", "removed": "array<array<bigint>>"}
    rows = docs.select("doc_id", "text", *_row_names()).join(found.hint("merge"), _ROW, "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(_stripped(length, passage, list(columns)), "doc_id long, " + ", ".join(f"{c} {k}" for c, k in columns.items()))
