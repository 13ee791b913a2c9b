"""Tables that are combined by position or by source, and pages of decoded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str], name: str = "row_no", parts: int | None = None) -> DataFrame:
    """rows with their place from 0 in an order: ranges are sorted in parallel and start after the ranges before them."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # A range's key must be the same in both readings, so it is kept with the rows.
    held = dealt.withColumn("__part", F.spark_partition_id()).persist()
    counts = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return held.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__within") - 1).drop("__part", "__within", "__before")  # a row per range


def zipped(left: DataFrame, left_order: list[str], left_name: str, right: DataFrame, right_order: list[str], right_name: str) -> DataFrame:
    """Row i with row i, as many as the shorter has; columns are prefixed."""
    a = numbered(left, left_order, "__row").withColumnsRenamed({c: f"{left_name}.{c}" for c in left.columns})
    b = numbered(right, right_order, "__row").withColumnsRenamed({c: f"{right_name}.{c}" for c in right.columns})
    return a.join(b, "__row").drop("__row")


def tagged_union(first: DataFrame, first_tag: str, second: DataFrame, second_tag: str) -> DataFrame:
    """All rows with their source first; the same number and kinds of columns, names from the first."""
    kinds = [[t for _, t in d.dtypes] for d in (first, second)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"columns differ: {kinds[0]} and {kinds[1]}")
    return first.select(F.lit(first_tag).alias("source"), *first.columns).union(second.select(F.lit(second_tag).alias("source"), *second.columns))


def rows_page(rows: DataFrame, row_no: str, number: int, size: int, count: int, most: int = 1000) -> DataFrame:
    """A page by row number, the last one if the number is beyond it."""
    size = max(1, min(most, size))
    number = max(1, min(number, max(1, -(-count // size))))
    return rows.where(F.col(row_no).between((number - 1) * size, number * size - 1))


def edited(rows: DataFrame, key: str, edits: DataFrame, name: str) -> DataFrame:
    """Cells replaced by those of (key, value), nulls too."""
    over = edits.select(F.col(key).alias("__key"), F.col("value").alias("__value"), F.lit(True).alias("__edited"))
    out = rows.join(over, rows[key] == over["__key"], "left")
    return out.withColumn(name, F.when(F.col("__edited"), F.col("__value")).otherwise(F.col(name))).drop("__key", "__value", "__edited")


def column_quality(rows: DataFrame, name: str, fill: str | None = None, codes: list[str] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of blank, fill, unknown code, not a number and out of range, in one pass."""
    text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
    number = text.try_cast("double")
    blank = text == ""
    is_fill = F.lit(False) if fill is None else ~blank & F.coalesce(text.try_cast("decimal(38,10)") == F.lit(fill).cast("decimal(38,10)"), text == fill)
    rest = ~blank & ~is_fill
    outside: Column = F.lit(False)
    if low is not None:
        outside = outside | (number < low)
    if high is not None:
        outside = outside | (number > high)
    ranged = low is not None or high is not None
    return rows.agg(
        F.count_if(blank).alias("blank"), F.count_if(is_fill).alias("fill"),
        F.count_if(rest & (~text.isin(codes) if codes is not None else F.lit(False))).alias("unknown_code"),
        F.count_if(rest & number.isNull() & F.lit(ranged)).alias("not_number"), F.count_if(rest & F.coalesce(outside, F.lit(False))).alias("out_of_range"),
    )


def display_limits(values: DataFrame, name: str, percent: float = 99.5) -> DataFrame:
    """(low, high): sorted[floor(cut * (n - 1))] and sorted[ceil((1 - cut) * (n - 1))], 1 apart at least."""
    ranked = numbered(values.where(F.col(name).isNotNull()).select(F.col(name).cast("double").alias("v")), ["v"], "rank")
    n = ranked.count()
    cut = (1 - percent / 100) / 2
    lo, hi = int(cut * (n - 1) // 1), int(-(-(1 - cut) * (n - 1) // 1))
    picked = ranked.agg(F.max(F.when(F.col("rank") == lo, F.col("v"))).alias("low"), F.max(F.when(F.col("rank") == hi, F.col("v"))).alias("high"))
    return picked.select("low", F.when(F.col("low") == F.col("high"), F.col("high") + 1).otherwise(F.col("high")).alias("high"))


def proposed(rows: DataFrame) -> DataFrame:
    """(column, type, blanks, distinct) that a table of text columns seems to have, in one pass.

    A type fits if all filled cells are of it: boolean, integer, decimal, date, else text; a column without filled cells
    is text. distinct counts filled cells and is an estimate.
    """
    tests = {
        "boolean": lambda c: F.lower(c).isin("true", "false"), "integer": lambda c: c.try_cast("bigint").isNotNull() & c.rlike(r"^[+-]?\d+$"),
        "decimal": lambda c: c.try_cast("decimal(38,10)").isNotNull(), "date": lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(),
    }
    aggs = []
    for i, name in enumerate(rows.columns):
        cell = F.trim(F.col(f"`{name}`").cast("string"))
        filled = cell.isNotNull() & (cell != "")
        fits = [F.coalesce(F.bool_and(F.when(filled, F.coalesce(t(cell), F.lit(False)))), F.lit(False)) for t in tests.values()]
        kind = F.coalesce(*[F.when(f, F.lit(k)) for f, k in zip(fits, tests, strict=True)], F.lit("text"))
        aggs.append(F.struct(F.lit(i).alias("place"), F.lit(name).alias("column"), kind.alias("type"), F.count_if(~filled).alias("blanks"), F.approx_count_distinct(F.when(filled, cell)).alias("distinct")).alias(f"c{i}"))
    return rows.agg(*aggs).select(F.explode(F.array(*[f"c{i}" for i in range(len(aggs))])).alias("c")).select("c.column", "c.type", "c.blanks", "c.distinct")
