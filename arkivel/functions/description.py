"""Format descriptions: fields, records and choices, as neutral of any description language."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .expressions import parse, references

#: Kind -> (bytes, struct code, signed).
NUMBERS = {"INT8": (1, "b"), "INT16": (2, "h"), "INT32": (4, "i"), "INT64": (8, "q"), "UINT8": (1, "B"), "UINT16": (2, "H"), "UINT32": (4, "I"), "UINT64": (8, "Q"), "FLOAT32": (4, "f"), "FLOAT64": (8, "d")}


@dataclass(frozen=True)
class Times:
    """once, optional by a condition, repeated by a count, or until the end."""

    kind: str = "once"
    expression: str = ""


ONCE, UNTIL_END = Times(), Times("until_end")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # of NUMBERS, STRING, BYTES, or BITS with bits set
    length: str = ""  # an expression, for STRING and BYTES
    bits: int = 0
    big: bool = True
    times: Times = ONCE
    offset: str = ""  # an expression: the place in the data, for positioned fields
    nil: str = ""  # the text that stands for nil
    scale: str = ""
    fill: str = ""


@dataclass(frozen=True)
class Choice:
    name: str
    on: str  # an expression
    branches: tuple[tuple[str, Field | Record], ...] = ()
    others: Field | Record | None = None
    times: Times = ONCE


@dataclass(frozen=True)
class Record:
    name: str
    parts: tuple[Field | Record | Choice, ...] = ()
    times: Times = ONCE
    size: str = ""  # an expression: bytes that it takes, rest unused
    separator: str = ""  # text layout: fields between separators, the record up to the terminator
    terminator: str = "\n"
    quote: str = ""
    zlib: bool = False
    until: str = ""  # a condition on the record itself that ends a repetition


Element = Field | Record | Choice


@dataclass(frozen=True)
class Description:
    root: Record
    extensions: tuple[str, ...] = field(default=())


#: Features a language may lack; fixed values.
CAPABILITIES = {
    "DFDL": {"bits", "text", "choice", "optional", "repeat", "until_end", "sized", "nil"},
    "KAITAI": {"bits", "choice", "optional", "repeat", "until_end", "sized", "zlib", "offset"},
    "DRB": {"text", "choice", "optional", "repeat", "until_end"}, "EAST": {"bits", "choice", "optional", "repeat", "until_end", "offset"},
}


def features(e: Element) -> set[str]:
    out = {e.times.kind} - {"once"}
    if isinstance(e, Field):
        return out | ({"bits"} if e.bits else set()) | ({"offset"} if e.offset else set()) | ({"nil"} if e.nil else set())
    if isinstance(e, Choice):
        parts = [b for _, b in e.branches] + ([e.others] if e.others else [])
        return out.union({"choice"}, *map(features, parts))
    return out.union({"text"} if e.separator else set(), {"zlib"} if e.zlib else set(), {"sized"} if e.size else set(), *map(features, e.parts))


def lacking(d: Description, language: str) -> set[str]:
    return {"repeat" if f == "repeated" else f for f in features(d.root)} - CAPABILITIES[language]


def problems(d: Description) -> list[str]:
    """What is wrong with a description: names, scope of references, lengths, bits, text rules."""
    out: list[str] = []

    def expression(text: str, scope: set[str], at: str) -> None:
        if not text:
            return
        try:
            out.extend(f"{at}: {'.'.join(r)} is not known there" for r in references(parse(text)) if r[0] not in scope)
        except ValueError as e:
            out.append(f"{at}: {e}")

    def walk(e: Element, scope: set[str], path: str) -> None:
        at = f"{path}/{e.name}"
        if not e.name.isidentifier():
            out.append(f"{at}: not a name")
        if e.times.kind in ("optional", "repeated"):
            expression(e.times.expression, scope, at)
            if not e.times.expression:
                out.append(f"{at}: how often is missing")
        if isinstance(e, Field):
            if e.kind in ("STRING", "BYTES") and not e.length and not path.endswith("~text"):
                out.append(f"{at}: a length is missing")
            if e.kind == "BITS" and not 1 <= e.bits <= 64:
                out.append(f"{at}: 1 to 64 bits")
            if e.kind not in (*NUMBERS, "STRING", "BYTES", "BITS"):
                out.append(f"{at}: {e.kind} is no type")
            expression(e.length, scope, at)
            expression(e.offset, scope, at)
        elif isinstance(e, Choice):
            expression(e.on, scope, at)
            keys = [k for k, _ in e.branches]
            if len(set(keys)) != len(keys):
                out.append(f"{at}: a key occurs twice")
            for _, b in e.branches:
                walk(b, set(scope), at)
        else:
            expression(e.size, scope, at)
            inner, seen = set(scope), set()
            for p in e.parts:
                if p.name in seen:
                    out.append(f"{at}: {p.name} occurs twice")
                seen.add(p.name)
                if e.separator and not isinstance(p, Field):
                    out.append(f"{at}: only fields in text records")
                walk(p, inner, at + ("~text" if e.separator else ""))
                if p.times.kind == "once":
                    inner.add(p.name)

    walk(d.root, set(), "")
    return out


def found(d: Description, path: str) -> Element | None:
    e: Element = d.root
    for name in [p for p in path.strip("/").split("/") if p][1:]:
        parts = e.parts if isinstance(e, Record) else [b for _, b in e.branches] if isinstance(e, Choice) else ()
        e = next((p for p in parts if p.name == name), None)
        if e is None:
            return None
    return e


def changed(d: Description, path: str, change) -> Description:
    """A description with the element at a path replaced by change(element), or gone if that is None."""
    names = [p for p in path.strip("/").split("/") if p][1:]

    def walk(e: Element, rest: list[str]):
        if not rest:
            return change(e)
        if isinstance(e, Record):
            made = [walk(p, rest[1:]) if p.name == rest[0] else p for p in e.parts]
            return replace(e, parts=tuple(p for p in made if p is not None))
        made = [(k, walk(b, rest[1:]) if b.name == rest[0] else b) for k, b in e.branches]
        return replace(e, branches=tuple((k, b) for k, b in made if b is not None))

    return replace(d, root=walk(d.root, names))
