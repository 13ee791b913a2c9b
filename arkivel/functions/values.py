"""Values of decoded data: coercion, physical values, codes, numbers in text, image stretches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerced(value: Column, kind: str) -> tuple[Column, Column]:
    """(typed, raw): the value as kind, and the text as it was where that is impossible."""
    if kind == "boolean":  # any text but true is false
        typed = F.lower(value.cast("string")) == "true"
    else:
        typed = F.trim(value.cast("string")).try_cast(kind)
    return typed, F.when(typed.isNull() & value.isNotNull(), value.cast("string"))


def physical(raw: Column, scale: Column | float | None, offset: Column | float | None) -> Column:
    """raw * scale + offset in exact decimals."""
    out = raw.cast("decimal(20,0)") if not isinstance(raw, str) else F.col(raw).cast("decimal(20,0)")
    if scale is not None:
        out = out * (scale if isinstance(scale, Column) else F.lit(str(scale))).cast("decimal(12,6)")
    if offset is not None:
        out = out + (offset if isinstance(offset, Column) else F.lit(str(offset))).cast("decimal(18,6)")
    return out


def plain_number(text: Column) -> Column:
    """A number's text without sign of +, leading zeros and a zero fraction; other text as it is."""
    number = F.trim(text).try_cast("decimal(38,10)")
    shown = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(number.isNull(), text).otherwise(shown)


def meaning(raw: Column, codes: Mapping[str, str]) -> Column:
    """What a code stands for; numbers compare by value."""
    out = F.lit(None).cast("string")
    key = plain_number(raw.cast("string"))
    for code, text in codes.items():
        out = F.when(key == plain_number(F.lit(code)), text).otherwise(out)
    return out


def fill_text(raw: Column, fill: str) -> Column:
    """The fill value by text: the raw value is normalised, the fill value is not."""
    return plain_number(raw.cast("string")) == F.lit(fill)


def fill_number(raw: Column, fill: str) -> Column:
    """The fill value by number."""
    return F.coalesce(raw.cast("string").try_cast("decimal(38,10)") == F.lit(fill).cast("decimal(38,10)"), F.lit(False))


def ascii_number(text: Column) -> Column:
    """A number in text with D or d exponents and leading +."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "[Dd]", "E"), r"^\+", "").try_cast("double")


def grouped_number(text: Column, decimal: str = ".", grouping: str = ",") -> Column:
    return F.replace(F.replace(text, F.lit(grouping), F.lit("")), F.lit(decimal), F.lit(".")).try_cast("decimal(38,10)")


def pixel(value: Column) -> Column:
    """A whole number, else a finite number, else null, as double."""
    text = value.cast("string")
    number = F.coalesce(text.try_cast("bigint").cast("double"), text.try_cast("double"))
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def stretched(value: Column, low: Column, high: Column, kind: str) -> Column:
    """0..1 between the limits: linear, sqrt, log or asinh."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return {"linear": t, "sqrt": F.sqrt(t), "log": F.log10(F.lit(1.0) + F.lit(999.0) * t) / 3, "asinh": F.asinh(t * 10) / F.asinh(F.lit(10.0))}[kind]


def quotient(a: Column, b: Column) -> Column:
    """Whole division that truncates toward zero; null by zero."""
    whole = F.floor(F.abs(a).cast("decimal(20,0)") / F.nullif(F.abs(b).cast("decimal(20,0)"), F.lit(0)))
    return (whole * F.when((a < 0) != (b < 0), -1).otherwise(1)).cast("bigint")


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return ((a % b) + b) % b


def canonical(value: Column, kind: str, missing: str = "<none>") -> Column:
    """Text of a value for comparison: bytes as 0x..., plain numbers."""
    made = F.concat(F.lit("0x"), F.lower(F.hex(value))) if kind == "bytes" else plain_number(value.cast("string")) if kind != "string" else value
    return F.coalesce(made, F.lit(missing))


def function(name: str, *args: Column) -> Column:
    """Functions of the record language: results of 12 decimals, half to even; a result that is not finite is an error."""
    made = {
        "is_odd": lambda x: x % 2 != 0, "is_even": lambda x: x % 2 == 0, "!": F.factorial,
        "cos": F.cos, "sin": F.sin, "tan": F.tan, "acos": F.acos, "asin": F.asin, "atan": F.atan, "log": F.log10, "ln": F.ln,
        "cosh": F.cosh, "sinh": F.sinh, "tanh": F.tanh, "acosh": F.acosh, "asinh": F.asinh, "atanh": F.atanh,
    }[name](*args)
    if name in ("is_odd", "is_even", "!"):
        return made
    finite = made.isNotNull() & ~F.isnan(made) & (F.abs(made) != float("inf"))
    return F.when(finite, F.bround(made, 12)).otherwise(F.raise_error(F.lit(f"{name} has no finite result")))
