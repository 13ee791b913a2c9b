"""Decoding of described data: fixed layouts as Columns, others by an interpreter in Arrow batches; and write-back."""

from __future__ import annotations

import csv
import io
import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.description import NUMBERS, Choice, Description, Element, Field, Record
from ..functions.expressions import evaluate, parse

NODES = "doc_id string, node_id int, parent_id int, depth int, name string, kind string, value string, branch string, bit_start long, bit_len long"
_SPARK = {"INT8": "tinyint", "INT16": "smallint", "INT32": "int", "INT64": "bigint", "UINT8": "smallint", "UINT16": "int", "UINT32": "bigint", "UINT64": "decimal(20,0)", "FLOAT32": "float", "FLOAT64": "double"}


class Node:
    """A decoded element: a leaf has a value, others have children."""

    __slots__ = ("branch", "children", "kind", "length", "name", "start", "value")

    def __init__(self, name: str, kind: str, start: int, length: int = 0, value: Any = None, branch: str | None = None):
        self.name, self.kind, self.start, self.length, self.value, self.branch, self.children = name, kind, start, length, value, branch, []


class _Scope:
    """References see the earlier single elements of their record, then those of enclosing ones."""

    def __init__(self, outer: _Scope | None = None):
        self.outer, self.own = outer, {}

    def look(self, ref: tuple[str, ...]) -> Any:
        scope: _Scope | None = self
        while scope is not None:
            if ref[0] in scope.own:
                node = scope.own[ref[0]]
                for name in ref[1:]:
                    node = next(c for c in node.children if c.name == name)
                return node.value
            scope = scope.outer
        raise ValueError(f"{'.'.join(ref)} is not known")

    def number(self, text: str) -> int:
        return int(evaluate(parse(text), self.look))


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0  # at counts bits

    def _take(self, n: int) -> bytes:
        if self.at % 8:
            self.at += 8 - self.at % 8
        a = self.at // 8
        if a + n > len(self.data):
            raise ValueError(f"the data end at byte {len(self.data)}, {n} are wanted at {a}")
        self.at += 8 * n
        return self.data[a : a + n]

    def field(self, f: Field, scope: _Scope) -> Node:
        back = self.at
        if f.offset:
            self.at = 8 * scope.number(f.offset)
        elif not f.bits and self.at % 8:
            self.at += 8 - self.at % 8
        start = self.at
        if f.kind == "BITS":
            if self.at + f.bits > 8 * len(self.data):
                raise ValueError("the data end within a bit field")
            a, b = self.at // 8, -(-(self.at + f.bits) // 8)
            value: Any = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - f.bits) & ((1 << f.bits) - 1)
            self.at += f.bits
        elif f.kind in NUMBERS:
            n, code = NUMBERS[f.kind]
            value = struct.unpack((">" if f.big else "<") + code, self._take(n))[0]
        else:
            raw = self._take(scope.number(f.length))
            value = raw if f.kind == "BYTES" else raw.decode("latin-1").rstrip("\0")
        node = Node(f.name, "LEAF", start, self.at - start, value)
        if f.nil and str(value) == f.nil:
            node.kind, node.value = "NIL", None
        if f.offset:
            self.at = back
        return node

    def one(self, e: Element, scope: _Scope) -> Node:
        if isinstance(e, Field):
            return self.field(e, scope)
        if isinstance(e, Choice):
            key = evaluate(parse(e.on), scope.look)
            chosen = next((b for k, b in e.branches if _fits(k, key)), e.others)
            if chosen is None:
                raise ValueError(f"{e.name}: no branch for {key!r}")
            start = self.at
            node = Node(e.name, "COMPOSITE", start, branch=chosen.name)
            node.children.append(self.one(chosen, scope))
            node.length = self.at - start
            return node
        start = self.at
        if e.separator:
            return self.text(e, start)
        if e.size or e.zlib:
            raw = self._take(scope.number(e.size) if e.size else len(self.data) - -(-self.at // 8))
            inner = Decoder(zlib.decompress(raw) if e.zlib else raw)
            node = inner.parts(e, scope)
            if not e.zlib:
                _shift(node, start)
            node.start, node.length = start, self.at - start
            return node
        return self.parts(e, scope)

    def parts(self, e: Record, outer: _Scope) -> Node:
        node, scope = Node(e.name, "COMPOSITE", self.at), _Scope(outer)
        for p in e.parts:
            for child in self.times(p, scope):
                node.children.append(child)
                if p.times.kind == "once":
                    scope.own[p.name] = child
        node.length = self.at - node.start
        return node

    def times(self, e: Element, scope: _Scope) -> Iterator[Node]:
        kind = e.times.kind
        if kind == "once" or kind == "optional" and evaluate(parse(e.times.expression), scope.look) not in (0, "", None):
            yield self.one(e, scope)
        elif kind == "repeated":
            for _ in range(scope.number(e.times.expression)):
                yield self.one(e, scope)
        elif kind == "until_end":
            while -(-self.at // 8) < len(self.data):
                node = self.one(e, scope)
                yield node
                if isinstance(e, Record) and e.until:
                    inner = _Scope(scope)
                    inner.own = {c.name: c for c in node.children}
                    if evaluate(parse(e.until), inner.look) not in (0, "", None):
                        return

    def _line_end(self, first: int, e: Record) -> int:
        """Where the next terminator outside quotes is; bytes of the line are looked at once or twice, never the rest."""
        stop, quote, at, quotes = e.terminator.encode("latin-1"), e.quote.encode("latin-1"), first, 0
        while (found := self.data.find(stop, at)) >= 0:
            quotes += self.data.count(quote, at, found) if quote else 0
            if quotes % 2 == 0:
                return found
            at = found + 1
        return len(self.data)

    def text(self, e: Record, start: int) -> Node:
        """One line: up to the terminator outside quotes, or the end of the data."""
        first = self.at // 8
        end = self._line_end(first, e)
        line = self.data[first:end].decode("latin-1")
        cells = next(csv.reader(io.StringIO(line, newline=""), delimiter=e.separator, quotechar=e.quote or None, quoting=csv.QUOTE_MINIMAL if e.quote else csv.QUOTE_NONE), [""])
        if len(cells) != len(e.parts):
            raise ValueError(f"{e.name}: {len(cells)} values, {len(e.parts)} wanted")
        self.at = 8 * min(len(self.data), end + len(e.terminator))
        node = Node(e.name, "COMPOSITE", start, self.at - start)
        for f, cell in zip(e.parts, cells, strict=True):
            kind = "NIL" if f.nil and cell == f.nil else "LEAF"
            value: Any = None if kind == "NIL" else cell if f.kind == "STRING" else float(cell) if f.kind.startswith("FLOAT") else int(cell)
            node.children.append(Node(f.name, kind, start, 0, value))
        return node


def _fits(key: str, value: Any) -> bool:
    """A key is a number, a text, or a range a..b."""
    low, dots, high = key.partition("..")
    if dots and isinstance(value, int):
        return int(low, 0) <= value <= int(high, 0)
    return str(value) == key or isinstance(value, int) and key.lower().startswith("0x") and int(key, 16) == value


def _shift(node: Node, by: int) -> None:
    node.start += by
    for c in node.children:
        _shift(c, by)


def decoded(data: bytes, d: Description) -> Node:
    reader = Decoder(data)
    return next(reader.times(d.root, _Scope())) if d.root.times.kind == "once" else _all(reader, d.root)


def _all(reader: Decoder, root: Record) -> Node:
    node = Node("data", "ARRAY", 0)
    node.children = list(reader.times(root, _Scope()))
    node.length = reader.at
    return node


def shown(value: Any) -> str | None:
    """Text of a value: bytes as 0x..., floats plainly."""
    if isinstance(value, bytes):
        return "0x" + value.hex()
    if isinstance(value, float):
        return format(Decimal(repr(value)), "f") if value == value and abs(value) != float("inf") else str(value)
    return None if value is None else str(value)


def flattened(root: Node) -> Iterator[tuple[int, int | None, int, Node]]:
    """(id, parent id, depth, node) in document order."""
    stack, n = [(root, None, 0)], 0
    while stack:
        node, parent, depth = stack.pop()
        own, n = n, n + 1
        yield own, parent, depth, node
        stack += [(c, own, depth + 1) for c in reversed(node.children)]


def canonical(root: Node) -> list[str]:
    """path[i] = value lines; nil and branches are told."""
    out: list[str] = []

    def walk(node: Node, path: str) -> None:
        if node.kind == "NIL":
            out.append(f"{path} = <nil>")
        elif node.kind == "LEAF":
            out.append(f"{path} = {shown(node.value)}")
        elif node.branch:
            out.append(f"{path}: choice -> {node.branch}")
        seen: dict[str, int] = {}
        many = {c.name for c in node.children if sum(x.name == c.name for x in node.children) > 1} if node.kind != "ARRAY" else {c.name for c in node.children}
        for c in node.children:
            seen[c.name] = seen.get(c.name, 0) + 1
            walk(c, f"{path}/{c.name}" + (f"[{seen[c.name]}]" if c.name in many else ""))

    walk(root, "")
    return out


def nodes(files: DataFrame, d: Description, key: str = "path", content: str = "content") -> DataFrame:
    """The node table of described files; one file is one task's work at a time. A file that fails gives one ERROR node."""
    names = ["doc_id", "node_id", "parent_id", "depth", "name", "kind", "value", "branch", "bit_start", "bit_len"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    root = decoded(raw or b"", d)
                    rows += [(doc, i, p, depth, n.name, n.kind, shown(n.value), n.branch, n.start, n.length) for i, p, depth, n in flattened(root)]
                except (ValueError, struct.error, zlib.error) as e:
                    rows.append((doc, 0, None, 0, "error", "ERROR", str(e), None, 0, 0))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, NODES)


def fixed_columns(content: Column, d: Description) -> list[Column]:
    """Columns of a layout of whole numbers and texts of fixed length, within codegen: no Python touches the bytes."""
    out, at = [], 1
    for f in d.root.parts:
        if not isinstance(f, Field) or f.times.kind != "once" or f.offset or f.bits:
            raise ValueError(f"{f.name}: not a fixed layout")
        n = NUMBERS[f.kind][0] if f.kind in NUMBERS else int(f.length)
        raw = F.substring(content, at, n)
        if f.kind == "STRING":
            made = F.rtrim(F.decode(raw, "ISO-8859-1"), F.lit("\0"))
        elif f.kind == "BYTES":
            made = raw
        elif f.kind.startswith("FLOAT"):
            raise ValueError(f"{f.name}: real numbers are for nodes()")
        else:
            ordered = F.hex(raw) if f.big else F.hex(F.concat(*[F.substring(content, at + n - 1 - i, 1) for i in range(n)]))
            number = F.conv(ordered, 16, 10).cast("decimal(20,0)")
            if f.kind.startswith("INT"):
                half, whole = 1 << (8 * n - 1), 1 << (8 * n)
                number = F.when(number >= F.lit(str(half)).cast("decimal(20,0)"), number - F.lit(str(whole)).cast("decimal(21,0)")).otherwise(number)
            made = number.cast(_SPARK[f.kind])
        out.append(made.alias(f.name))
        at += n
    return out


class Encoder:
    """The inverse of decoding: the bytes of a tree, values as edited."""

    def __init__(self):
        self.out, self.bits = bytearray(), 0

    def _bytes(self, raw: bytes) -> None:
        self.bits = len(self.out) * 8
        self.out += raw
        self.bits = len(self.out) * 8

    def one(self, e: Element, node: Node, scope: _Scope) -> None:
        if isinstance(e, Field):
            value = node.value if node.kind != "NIL" else e.nil if e.kind in ("STRING", "BYTES") else int(e.nil)
            if e.kind == "BITS":
                if self.bits % 8 == 0:
                    self.out = self.out[: self.bits // 8]
                whole = int.from_bytes(self.out, "big") >> (8 * len(self.out) - self.bits) if self.out else 0
                self.bits += e.bits
                n = -(-self.bits // 8)
                self.out = bytearray((((whole << e.bits) | int(value)) << (8 * n - self.bits)).to_bytes(n, "big"))
            elif e.kind in NUMBERS:
                self._bytes(struct.pack((">" if e.big else "<") + NUMBERS[e.kind][1], value))
            else:
                raw = value if isinstance(value, bytes) else value.encode("latin-1")
                n = scope.number(e.length)
                self._bytes(raw[:n] + b"\0" * (n - len(raw)))
        elif isinstance(e, Choice):
            chosen = next(b for b in [*(b for _, b in e.branches), e.others] if b is not None and b.name == node.branch)
            self.one(chosen, node.children[0], scope)
        elif e.separator:
            line = io.StringIO()
            cells = [f.nil if c.kind == "NIL" else shown(c.value) for f, c in zip(e.parts, node.children, strict=True)]
            csv.writer(line, delimiter=e.separator, quotechar=e.quote or None, quoting=csv.QUOTE_MINIMAL if e.quote else csv.QUOTE_NONE, lineterminator=e.terminator).writerow(cells)
            self._bytes(line.getvalue().encode("latin-1"))
        else:
            inner = Encoder() if e.size or e.zlib else self
            own = _Scope(scope)
            left = list(node.children)
            for p in e.parts:
                while left and left[0].name == p.name:
                    child = left.pop(0)
                    inner.one(p, child, own)
                    if p.times.kind == "once":
                        own.own[p.name] = child
                        break
            if inner is not self:
                raw = bytes(inner.out)
                if e.zlib:
                    raw = zlib.compress(raw)
                n = scope.number(e.size) if e.size else len(raw)
                self._bytes(raw + b"\0" * (n - len(raw)))


def encoded(root: Node, d: Description) -> bytes:
    out = Encoder()
    for node in [root] if d.root.times.kind == "once" else root.children:
        out.one(d.root, node, _Scope())
    return bytes(out.out)


def compared(a: bytes, b: bytes) -> tuple[int, int]:
    """(bytes that differ, the first place that does or -1): a difference in length counts in full."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    first = int(differs[0]) if len(differs) else n if len(a) != len(b) else -1
    return len(differs) + abs(len(a) - len(b)), first


def round_trips(files: DataFrame, d: Description, key: str = "path", content: str = "content") -> DataFrame:
    """(doc_id, differing, first): what a decode and encode changes in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [compared(raw, encoded(decoded(raw, d), d)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["doc_id", "differing", "first"])

    return files.select(F.col(key).cast("string").alias("doc_id"), content).mapInArrow(run, "doc_id string, differing long, first long")


def inferred(table: DataFrame) -> DataFrame:
    """(path, kind, type) of a node table: its shape, learned from the data."""
    number = F.col("value").try_cast("bigint").isNotNull()
    kind = F.when(F.col("kind") != "LEAF", None).when(number, "integer").when(F.col("value").try_cast("double").isNotNull(), "real").otherwise("text")
    return table.where("kind <> 'ERROR'").select("depth", "name", "kind", kind.alias("type")).distinct()


def rebuilt(rows: list[dict]) -> Node:
    """The tree of the node table's rows of one file; values are text and get their kinds back on encoding."""
    made = {r["node_id"]: Node(r["name"], r["kind"], r["bit_start"], r["bit_len"], r["value"], r["branch"]) for r in rows}
    root = None
    for r in sorted(rows, key=lambda r: r["node_id"]):
        if r["parent_id"] is None:
            root = made[r["node_id"]]
        else:
            made[r["parent_id"]].children.append(made[r["node_id"]])
    return root


def _valued(e: Element, node: Node) -> None:
    """Text values of a rebuilt tree as values of its description."""
    if isinstance(e, Field):
        if node.value is not None and e.kind != "STRING":
            node.value = bytes.fromhex(node.value[2:]) if e.kind == "BYTES" else float(node.value) if e.kind.startswith("FLOAT") else int(node.value)
        return
    parts = [b for _, b in e.branches] + [e.others] if isinstance(e, Choice) else e.parts
    for c in node.children:
        _valued(next(p for p in parts if p is not None and p.name == c.name), c)


def rewritten(nodes: DataFrame, d: Description) -> DataFrame:
    """(doc_id, content): the files of a node table, written again from its rows; a file is one group."""

    def run(own: pa.Table) -> pa.Table:
        root = rebuilt(own.to_pylist())
        for c in [root] if d.root.times.kind == "once" else root.children:
            _valued(d.root, c)
        return pa.table({"doc_id": pa.array([own.column("doc_id")[0].as_py()], pa.string()), "content": pa.array([encoded(root, d)], pa.binary())})

    return nodes.groupBy("doc_id").applyInArrow(run, "doc_id string, content binary")
