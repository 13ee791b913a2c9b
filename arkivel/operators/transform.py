"""The mapping language that turns one format into another, and the check that values are preserved.

    # comment
    count = count(star)
    for stars in star
      name = name
      ra_rad = ra * 0.017453292519943295
      dec = dec + 0
    end
    origin = "catalogue"
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Context, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sixteen digits, half to even.
DECIMAL64 = Context(prec=16, rounding=ROUND_HALF_EVEN)


@dataclass(frozen=True)
class Copy:
    target: str
    source: str
    scale: str = ""
    offset: str = ""


@dataclass(frozen=True)
class Count:
    target: str
    source: str


@dataclass(frozen=True)
class Text:
    target: str
    value: str


@dataclass(frozen=True)
class For:
    target: str
    source: str
    body: tuple[Copy | Count | Text | For, ...] = ()


_NAME = r"[A-Za-z_][\w./]*"
_NUMBER = r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def parse_mapping(text: str) -> tuple:
    """The rules of a mapping text; an error names its line."""
    stack: list[list] = [[]]
    heads: list[tuple[str, str]] = []
    for i, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if m := re.fullmatch(rf"for\s+({_NAME})\s+in\s+({_NAME})", line):
            heads.append((m[1], m[2]))
            stack.append([])
        elif line == "end" and heads:
            body = stack.pop()
            stack[-1].append(For(*heads.pop(), tuple(body)))
        elif m := re.fullmatch(rf"({_NAME})\s*=\s*count\(({_NAME})\)", line):
            stack[-1].append(Count(m[1], m[2]))
        elif m := re.fullmatch(rf'({_NAME})\s*=\s*"([^"]*)"', line):
            stack[-1].append(Text(m[1], m[2]))
        elif m := re.fullmatch(rf"({_NAME})\s*=\s*({_NAME})(?:\s*\*\s*(-?{_NUMBER}))?(?:\s*([+-])\s*({_NUMBER}))?", line):
            stack[-1].append(Copy(m[1], m[2], m[3] or "", (m[4] + m[5]) if m[5] else ""))
        else:
            raise ValueError(f"line {i}: {line!r} is no rule")
    if heads:
        raise ValueError("a for has no end")
    return tuple(stack[0])


def copies(rules: tuple, source: str = "", target: str = "") -> Iterator[Copy]:
    """All copies with whole paths."""
    for r in rules:
        if isinstance(r, For):
            yield from copies(r.body, f"{source}{r.source}.", f"{target}{r.target}.")
        elif isinstance(r, Copy):
            yield Copy(target + r.target, source + r.source, r.scale, r.offset)


def _scaled(scale: str, offset: str, whole: bool):
    factor, add = Decimal(scale or "1"), Decimal(offset or "0")

    @F.pandas_udf("string")
    def run(values):
        def one(v):
            if v is None:
                return None
            got = DECIMAL64.add(DECIMAL64.multiply(Decimal(v), factor), add)
            return str(got.quantize(Decimal(1), ROUND_HALF_EVEN) if whole else got)

        return values.map(one, na_action="ignore")

    return run


def mapped(rows: DataFrame, rule: For, kinds: dict[str, str]) -> DataFrame:
    """The target rows of one for: kinds are the Spark types of the target columns.

    Plain copies are casts in the JVM; only scaled values, which need 16-digit decimals, go through Arrow. An inner for
    gives an array of structs, made of the elements of a source array (or of the one struct that it names); its kinds
    are those of target.name, and its scaled values are decimals of the JVM.
    """
    source = rows if rule.source in ("", "self") or rule.source not in rows.columns else rows.select(F.explode(rule.source).alias("__row")).select("__row.*")
    out = []
    for r in rule.body:
        kind = kinds.get(r.target, "string")
        if isinstance(r, Text):
            value = F.lit(r.value)
        elif isinstance(r, Count):
            value = F.size(r.source)
        elif isinstance(r, Copy) and (r.scale or r.offset):
            value = _scaled(r.scale, r.offset, kind in ("int", "bigint", "smallint", "tinyint"))(F.col(r.source).cast("string"))
        elif isinstance(r, Copy):
            value = F.col(r.source)
        else:
            out.append(_inner(r, lambda name: F.col(name), kinds, "").alias(r.target))
            continue
        out.append((value if isinstance(r, Text | Count) and kind == "string" else value.cast("string").try_cast(kind)).alias(r.target))
    return source.select(*out)


def _inner(rule: For, look, kinds: dict[str, str], above: str) -> Column:
    """The array of one inner for; look gives the Column of a name of the element around it."""

    def element(e: Column) -> Column:
        own = lambda name: e.getField(name)
        made = []
        for r in rule.body:
            kind = kinds.get(f"{above}{rule.target}.{r.target}", "string")
            if isinstance(r, For):
                made.append(_inner(r, own, kinds, f"{above}{rule.target}.").alias(r.target))
                continue
            if isinstance(r, Text):
                value = F.lit(r.value)
            elif isinstance(r, Count):
                value = F.size(own(r.source))
            else:
                value = own(r.source)
                if r.scale or r.offset:
                    value = value.cast("string").try_cast("decimal(30,12)") * F.lit(r.scale or "1").cast("decimal(38,18)") + F.lit(r.offset or "0").cast("decimal(30,12)")
                    value = F.bround(value, 0) if kind in ("int", "bigint", "smallint", "tinyint") else value
            made.append(value.cast("string").try_cast(kind).alias(r.target))
        return F.struct(*made)

    return F.transform(look(rule.source), element)


def transformation_check(source: DataFrame, target: DataFrame, key: str, rule: For, kinds: dict[str, str]) -> DataFrame:
    """(target, preserved, compared, max_difference) of each copy of a rule against rows that some other tool has made.

    What the rule itself makes of the source is compared with target at equal keys, within the tolerance of the kind.
    """
    wanted, out = mapped(source, rule, kinds), None
    for r in rule.body:
        if isinstance(r, Copy) and r.target != key:
            got = property_check(wanted, target, key, r.target, r.target, *tolerance(kinds.get(r.target, "string"), r.scale))
            got = got.select(F.lit(r.target).alias("target"), "preserved", "compared", "max_difference")
            out = got if out is None else out.unionByName(got)
    return out


def preserved_summary(checks: DataFrame) -> DataFrame:
    """(preserved, checked) of the rows of a transformation check."""
    return checks.agg(F.count_if("preserved").alias("preserved"), F.count("*").alias("checked"))


def missing_targets(rules: tuple, wanted: list[str]) -> list[str]:
    have = {c.target for c in copies(rules)} | {r.target for r in rules if isinstance(r, Count | Text)}
    return [w for w in wanted if w not in have]


def tolerance(kind: str, scale: str = "") -> tuple[float, float]:
    """(relative, absolute): float 1e-6, double 1e-12, half a step for scaled whole numbers, else exact."""
    if scale and kind in ("int", "bigint", "smallint", "tinyint"):
        return 0.0, abs(float(scale)) / 2
    return {"float": (1e-6, 0.0), "double": (1e-12, 0.0)}.get(kind, (0.0, 0.0))


def property_check(left: DataFrame, right: DataFrame, key: str, a: str, b: str, relative: float = 0.0, absolute: float = 0.0) -> DataFrame:
    """(same_count, compared, max_difference, first_difference) of values at equal keys (their places, from 1).

    Numbers compare within tolerance, NaN and infinities by themselves, other text without trailing spaces and NULs.
    compared stops at the first difference.
    """
    both = left.select(F.col(key).alias("k"), F.col(a).cast("string").alias("x")).join(right.select(F.col(key).alias("k2"), F.col(b).cast("string").alias("y")), F.col("k") == F.col("k2"), "full_outer")
    x, y = F.col("x").try_cast("double"), F.col("y").try_cast("double")
    gap = F.abs(x - y)
    close = (gap <= F.lit(absolute)) | (gap <= F.lit(relative) * F.greatest(F.abs(x), F.abs(y))) | (gap == 0)
    odd = F.isnan(x) | F.isnan(y) | (F.abs(x) == float("inf")) | (F.abs(y) == float("inf"))
    text = F.rtrim(F.rtrim("x"), F.lit("\0 ")) == F.rtrim(F.rtrim("y"), F.lit("\0 "))
    same = F.coalesce(F.when(odd, x.eqNullSafe(y)).when(x.isNotNull() & y.isNotNull(), close).otherwise(text), F.col("x").isNull() & F.col("y").isNull() & F.col("k").isNotNull() & F.col("k2").isNotNull())
    out = both.agg(
        F.count("k").alias("n_left"), F.count("k2").alias("n_right"), F.max(F.when(~odd, gap)).alias("max_difference"),
        F.min(F.when(~same & F.col("k").isNotNull() & F.col("k2").isNotNull(), F.col("k"))).alias("first_difference"),
    )
    return out.select((F.col("n_left") == F.col("n_right")).alias("same_count"), F.coalesce("first_difference", F.least("n_left", "n_right")).alias("compared"), "max_difference", "first_difference", ((F.col("n_left") == F.col("n_right")) & F.col("first_difference").isNull()).alias("preserved"))


def reversible(rules: tuple, source_paths: list[str], computed: list[str], preserved: set[str]) -> list[str]:
    """Source paths that stand in the way: not computed, and not carried unscaled and preserved."""
    carried = {c.source for c in copies(rules) if not c.scale and not c.offset and c.target in preserved}
    return [p for p in source_paths if p not in computed and p not in carried]


def aligned(nodes: DataFrame, description: DataFrame) -> DataFrame:
    """(path, presence, kind) of described paths: present, nil or absent; names match without case and underscores."""
    plain = lambda c: F.lower(F.replace(F.col(c), F.lit("_"), F.lit("")))
    have = nodes.groupBy(plain("name").alias("__name")).agg(F.count_if(F.col("kind") == "NIL").alias("nils"), F.count("*").alias("n"))
    out = description.withColumn("__name", plain("name")).join(have, "__name", "left")
    return out.select("name", F.when(F.col("n").isNull(), "absent").when(F.col("nils") == F.col("n"), "nil").otherwise("present").alias("presence"), F.coalesce("n", F.lit(0)).alias("n"))


def siblings(nodes: DataFrame) -> DataFrame:
    """Nodes with name[i] among siblings of one name, i from 1, where there are several."""
    w = W.partitionBy("doc_id", "parent_id", "name")
    place = F.row_number().over(w.orderBy("node_id"))
    return nodes.withColumn("shown", F.when(F.count("*").over(w) > 1, F.concat("name", F.lit("["), place.cast("string"), F.lit("]"))).otherwise(F.col("name")))


def scaled_batch(values: pa.Array, scale: str, offset: str) -> pa.Array:
    """Sixteen-digit results of a batch, for callers outside Spark."""
    return pa.array([None if v is None else str(DECIMAL64.add(DECIMAL64.multiply(Decimal(v), Decimal(scale)), Decimal(offset))) for v in values.to_pylist()], pa.string())
