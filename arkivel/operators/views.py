"""Table, time-series, vector and image views of decoded rows."""

from __future__ import annotations

from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import coerced, pixel

#: View types and what they are here.
TYPES = {"int": "int", "integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "double": "double", "float": "float", "boolean": "boolean", "string": "string", "biginteger": "decimal(38,0)", "bigdecimal": "decimal(38,18)", "object": "string"}


@dataclass(frozen=True)
class ViewColumn:
    name: str
    child: str
    kind: str = "string"


@dataclass(frozen=True)
class View:
    rows: str  # self, or the child or array whose elements are rows
    columns: tuple[ViewColumn, ...]


def read_view(xml: str) -> View:
    """<view><rows self|children|array="name"/><columns><column name type [child]/></columns></view>"""
    root = ElementTree.fromstring(xml)
    rows, columns = root.find("rows"), root.findall("columns/column")
    if not columns:
        raise ValueError("a view needs columns")
    which = "self" if rows is None or rows.get("self") is not None else rows.get("children") or rows.get("array")
    return View(which, tuple(ViewColumn(c.get("name"), c.get("child", c.get("name")), c.get("type", "string").lower()) for c in columns))


def table(data: DataFrame, view: View) -> DataFrame:
    """Typed columns; where a value does not fit its type, <name>__raw has its text."""
    source = data if view.rows == "self" else data.select(F.explode(view.rows).alias("row"))
    out = []
    for c in view.columns:
        value = F.col(c.child if view.rows == "self" else f"row.{c.child}")
        typed, raw = coerced(value, TYPES[c.kind])
        out += [typed.alias(c.name), *([] if c.kind in ("string", "object") else [raw.alias(f"{c.name}__raw")])]
    return source.select(*out)


def time_series(data: DataFrame, start: str, end: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Epoch milliseconds become timestamps; what is no number becomes null."""
    stamp = lambda c: F.timestamp_millis(F.col(c).cast("string").try_cast("bigint"))
    return data.select(stamp(start).alias("event_start"), *([stamp(end).alias("event_end")] if end else []), *columns)


def geometry(kind: str, vertices: list[list[str]]) -> Column:
    """struct<kind, dimension, coordinates>; an ordinate that is no number is an error."""
    if len({len(v) for v in vertices}) != 1 or len(vertices[0]) not in (2, 3):
        raise ValueError("2 or 3 ordinates, as many for each vertex")
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.col(c).cast("string"))).cast("double"))
    return F.struct(F.lit(kind).alias("kind"), F.lit(len(vertices[0])).alias("dimension"), F.array(*[F.array(*[number(c) for c in v]) for v in vertices]).alias("coordinates"))


def vector(data: DataFrame, kind: str, vertices: list[list[str]], columns: tuple[str, ...] = ()) -> DataFrame:
    return data.select(geometry(kind, vertices).alias("geometry"), *columns)


def image(data: DataFrame, row: str, pixels: str) -> DataFrame:
    """(row, col, value) of (row number, array of pixels)."""
    return data.select(F.col(row).alias("row"), F.posexplode(pixels).alias("col", "raw")).select("row", "col", pixel(F.col("raw")).alias("value"))


def pixel_rows(cells: DataFrame) -> DataFrame:
    """(row, pixels): arrays again, in order."""
    return cells.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("pixels"))


def pixel_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value") != F.floor("value")).alias("fractions"), F.count("*").alias("pixels"))


def fits_storage(low: float | None, high: float | None, fractions: int) -> tuple[int, int]:
    """(BITPIX, BZERO) of the smallest exact storage."""
    if fractions or low is None or abs(low) > 2**53 or abs(high) > 2**53:
        return -64, 0
    for bits, signed, zero in ((8, False, 0), (16, True, 0), (16, False, 32768), (32, True, 0), (32, False, 2147483648)):
        least = -(1 << (bits - 1)) if signed else 0
        if least <= low and high <= least + (1 << bits) - 1:
            return bits, zero
    return -64, 0


def spectrum(data: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of two numeric columns; rows without two finite numbers go."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return data.select(number(x).alias("x"), number(y).alias("y")).where(finite("x") & finite("y"))


def read_spec(xml: str) -> tuple[str, dict]:
    """(kind, settings) of a view text: series (start, end, columns), vector (kind, vertices, columns), image (row, pixels)."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(xml)
    columns = tuple(c.get("name") for c in root.iter("column"))
    if (e := root.find("series")) is not None:
        return "series", {"start": e.get("start"), "end": e.get("end"), "columns": columns}
    if (e := root.find("vector")) is not None:
        return "vector", {"kind": e.get("kind", "point"), "vertices": [[o.text for o in v.iter("ordinate")] for v in e.iter("vertex")], "columns": columns}
    if (e := root.find("image")) is not None:
        return "image", {"row": e.get("row"), "pixels": e.get("pixels")}
    raise ValueError("neither series, vector nor image")


def apply_spec(data: DataFrame, xml: str) -> DataFrame:
    kind, settings = read_spec(xml)
    return {"series": time_series, "vector": vector, "image": image}[kind](data, **settings)
