"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents: whole copies plus a
fractional probability. Two documents of the source meet; word mass goes from one to the other at random, so that
expectations and the sum of mass stay as they are, until one of the two probabilities is 0 or 1. The other one, the
residual, meets the next document. This runs within chunks of a source in parallel; the chunks' residuals are the
documents of the next level of a reduction tree, until each source has one residual, which is rounded to the nearer
whole. So the words taken of a source differ from its target by half a document at most. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, materialize, unit

#: Documents of a chunk, on average.
CHUNK = 128
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab, line feed, VT, FF and CR; null: 0."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size): weights by rank of the source, capped at most * size.

    The excess over a cap goes to the others by weight until none is above. Those capped come first in the order of
    cap / weight, so prefix sums find the level. Its input has a row for each source, its windows no more.
    """
    everything, ranked = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ranked) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("key", F.col("cap") / F.col("weight"))
    order = W.orderBy("key", F.col("source").asc_nulls_last())
    rows = rows.withColumn("caps", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.col("caps")) / F.col("rest"))  # if all before are capped, and none from here on
    rows = rows.withColumn("nth", F.row_number().over(order))
    level = F.min(F.when(F.col("level") <= F.col("key"), F.struct("nth", "level"))).over(everything)["level"]  # of the first not to be capped
    return rows.withColumn("found", level).select("source", "source_size", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("weight"))).alias("target"))


def _settled(p: Column) -> Column:
    return F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p)


def _meet(state: Column, doc: Column) -> Column:
    """The residual in state meets doc; the one that gets integral joins the done."""
    a, b = state["held"], doc
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])  # mass that b can give to a
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    u = unit(a["id"], a["nth"], b["id"], b["nth"], seed=6)
    mass = F.when(u * (up + down) < down, up).otherwise(-down)  # expectations stay
    pa, pb = _settled(a["p"] + mass / a["size"]), _settled(b["p"] - mass / b["size"])
    after_a = F.struct(a["id"].alias("id"), a["nth"].alias("nth"), a["size"].alias("size"), pa.alias("p"))
    after_b = F.struct(b["id"].alias("id"), b["nth"].alias("nth"), b["size"].alias("size"), pb.alias("p"))
    a_done = (pa == 0) | (pa == 1)
    moved = F.struct(F.when(a_done, after_b).otherwise(after_a).alias("held"), F.concat(state["done"], F.array(F.when(a_done, after_a).otherwise(after_b))).alias("done"))
    return F.when(a.isNull(), F.struct(doc.alias("held"), state["done"].alias("done"))).otherwise(moved)


def _level(rows: DataFrame, chunk: Column) -> DataFrame:
    """(source, held, done) of each chunk of (source, id, nth, size, p), largest documents first."""
    doc = "struct<id:bigint,nth:bigint,size:double,p:double>"
    start = F.struct(F.lit(None).cast(doc).alias("held"), F.array().cast(f"array<{doc}>").alias("done"))
    grouped = rows.groupBy("source", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("rank"), "id", "nth", "size", "p"))).alias("docs"))
    each = F.transform("docs", lambda d: F.struct(d["id"].alias("id"), d["nth"].alias("nth"), d["size"].alias("size"), d["p"].alias("p")))
    return grouped.withColumn("end", F.aggregate(each, start, _meet)).select("source", F.col("end.held").alias("held"), F.col("end.done").alias("done"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, source, nth, size, source_size, target, copies, taken.

    size counts words (null text: 0), taken is copies * size. nth tells rows apart that repeat doc_id, source and size:
    they are documents of their own, and which of them is taken is the same for all that count. Documents without
    words are never taken. A null source is a source like any other, and so is a null doc_id a key. Other columns are
    ignored; an empty table gives no rows.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    same = W.partitionBy("doc_id", "source", "size").orderBy("doc_id")
    sized = materialize(sized.withColumn("nth", F.row_number().over(same).cast("long")), "numbered")
    aims = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    on = sized["source"].eqNullSafe(aims["source"])
    rows = sized.join(F.broadcast(aims) if aims.count() <= 10_000 else aims, on, "left").select("doc_id", sized["source"], "nth", "size", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(rate + EPS).cast("long")).withColumn("p", F.greatest(rate - F.floor(rate + EPS), F.lit(0.0)))
    rows = materialize(rows, "expected")
    open_ = rows.where((F.col("size") > 0) & (F.col("p") > EPS)).select("source", F.col("doc_id").alias("id"), "nth", F.col("size").cast("double").alias("size"), "p")
    counts = materialize(open_.groupBy("source").agg(F.count("*").alias("n")), "counts")
    largest = counts.agg(F.max("n")).first()[0] or 0
    small = counts.count() <= 10_000
    settled, level = None, 0
    while largest:
        by = counts.select(F.col("source").alias("at"), F.ceil(F.col("n") / chunk).alias("chunks"))
        here = open_.join(F.broadcast(by) if small else by, open_["source"].eqNullSafe(by["at"]), "left")
        out = materialize(_level(here, F.pmod(F.xxhash64("id", "nth", F.lit(level)), F.col("chunks"))), "level")
        done = out.select("source", F.explode("done").alias("d")).select("source", "d.*")
        settled = done if settled is None else settled.union(done)
        open_ = out.where("held is not null and held.p > 0 and held.p < 1").select("source", "held.*")
        whole = out.where("held is not null and (held.p = 0 or held.p = 1)").select("source", "held.*")
        settled = settled.union(whole)
        counts = materialize(open_.groupBy("source").agg(F.count("*").alias("n")), "counts")
        last, largest = largest, counts.agg(F.max("n")).first()[0] or 0
        if largest <= 1:
            settled = settled.union(open_.withColumn("p", F.round("p")))
            break
        level += 1
    if settled is not None:
        extra = settled.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("nth").alias("k"), F.col("size").cast("long").alias("z"), F.col("p").cast("long").alias("extra"))
        on = rows["source"].eqNullSafe(extra["s"]) & rows["doc_id"].eqNullSafe(extra["i"]) & (rows["nth"] == extra["k"]) & (rows["size"] == extra["z"])
        rows = rows.join(extra, on, "left").drop("s", "i", "k", "z")
    else:
        rows = rows.withColumn("extra", F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "source", "nth", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
