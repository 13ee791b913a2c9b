"""Triples as a DataFrame: (g, s, s_kind, p, o, o_kind, o_dt, o_lang), a set; graphs ontology and data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V

COLUMNS = ["g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
#: The class hierarchy of the test projection.
HIERARCHY = [
    ("ex:Customer", "rico:Person"), ("rico:Person", "rico:Agent"), ("ex:Supplier", "rico:CorporateBody"), ("rico:CorporateBody", "rico:Group"),
    ("rico:Family", "rico:Group"), ("rico:Group", "rico:Agent"), ("rico:Record", "rico:RecordResource"), ("rico:RecordPart", "rico:RecordResource"),
    ("rico:RecordSet", "rico:RecordResource"), ("rico:Activity", "rico:Event"), ("rico:Mandate", "rico:Rule"),
]


def full(name: str) -> str:
    prefix, _, rest = name.partition(":")
    return V.PREFIXES[prefix] + rest


def literal(graph: str, s: Column, p: str, o: Column, dt: str = "", lang: Column | str = "") -> list[Column]:
    return [F.lit(graph).alias("g"), s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(dt).alias("o_dt"), (lang if isinstance(lang, Column) else F.lit(lang)).alias("o_lang")]


def link(graph: str, s: Column, p: str, o: Column) -> list[Column]:
    return [F.lit(graph).alias("g"), s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang")]


def iri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{V.EX}{kind}-"), F.col(key).cast("string"))


def described(df: DataFrame, s: Column, cls: str, parts: list[tuple[str, Column, bool]]) -> DataFrame:
    """The type and the given (property, object, whether it is a link) of each row, in one pass; null objects give none."""
    fields = ["p", "o", "o_kind"]
    one = lambda p, o, is_link: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("iri" if is_link else "literal").alias("o_kind"))
    rows = df.select(s.alias("s"), F.explode(F.array(one(V.TYPE, F.lit(cls), True), *[one(*x) for x in parts])).alias("t")).select("s", *[f"t.{f}" for f in fields])
    return rows.where("o is not null").select(F.lit("data").alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))


def ontology(spark: SparkSession) -> DataFrame:
    rows = [("ontology", full(a), "iri", V.SUB_CLASS, full(b), "iri", "", "") for a, b in HIERARCHY]
    return spark.createDataFrame(rows, SCHEMA)


def projected(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("customer", "supplier", "orders", "nation", "region", "documents", "part")) -> DataFrame:
    """The tables as data triples. A query asks for the tables it needs; columns it does not use are never read."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    dc, rico, ex = V.DC, V.RICO, V.EX
    made = {
        "customer": lambda d: described(d, iri("customer", "c_custkey"), ex + "Customer", [(rico + "name", F.col("c_name"), False), (dc + "type", F.col("c_mktsegment"), False), (ex + "inNation", iri("nation", "c_nationkey"), True)]),
        "supplier": lambda d: described(d, iri("supplier", "s_suppkey"), ex + "Supplier", [(rico + "name", F.col("s_name"), False), (ex + "inNation", iri("nation", "s_nationkey"), True)]),
        "orders": lambda d: described(d, iri("order", "o_orderkey"), rico + "Record", [(rico + "title", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), False), (rico + "hasCreator", iri("customer", "o_custkey"), True), (dc + "type", F.col("o_orderpriority"), False), (dc + "date", F.date_format("o_orderdate", "yyyy-MM-dd"), False), (ex + "transferredRecord", F.col("o_orderstatus"), False)]),
        "nation": lambda d: described(d, iri("nation", "n_nationkey"), ex + "Place", [(rico + "name", F.col("n_name"), False), (ex + "partOf", iri("region", "n_regionkey"), True)]),
        "region": lambda d: described(d, iri("region", "r_regionkey"), ex + "Place", [(rico + "name", F.col("r_name"), False)]),
        "documents": lambda d: described(d, iri("document", "doc_id"), rico + "Record", [(rico + "title", F.substring("text", 1, 40), False), (rico + "generalDescription", F.col("text"), False), (dc + "language", F.col("lang"), False), (dc + "subject", F.col("source"), False)]),
        "part": lambda d: described(d, iri("part", "p_partkey"), ex + "Part", [(rico + "name", F.col("p_name"), False), (dc + "type", F.col("p_type"), False)]),
    }
    out = None
    for t in tables:
        rows = made[t](read(t))
        out = rows if out is None else out.unionByName(rows)
    return out


def union_view(*graphs: DataFrame) -> DataFrame:
    """Ontology and data as one set, whatever graph a triple is in."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.drop("g").distinct()


def merged(graph: DataFrame, more: DataFrame) -> DataFrame:
    """Set union."""
    return graph.unionByName(more).dropDuplicates(COLUMNS)


def without(graph: DataFrame, less: DataFrame) -> DataFrame:
    """Set difference."""
    return graph.join(less.select(COLUMNS), COLUMNS, "left_anti")


def save_snapshot(graph: DataFrame, root: str, version: int) -> str:
    """A new version directory, partitioned by graph; readers name the version they read."""
    at = f"{root}/v{version:06d}"
    graph.write.partitionBy("g").parquet(at)
    return at


def load_snapshot(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(at).select(COLUMNS)


_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<str>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<dir>@prefix|@base|PREFIX\b|BASE\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<bnode>_:[A-Za-z0-9_.-]*[A-Za-z0-9_-])|(?P<name>[A-Za-z_][\w.-]*?:[\w%-]*(?:\.[\w%-]+)*|:[\w%-]*(?:\.[\w%-]+)*)|(?P<word>a\b|true\b|false\b)|(?P<punct>[;,.\[\]()])')
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_XSD = "http://www.w3.org/2001/XMLSchema#"


class Turtle:
    """A Turtle document as rows (s, s_kind, p, o, o_kind, o_dt, o_lang); a syntax error gives nothing at all."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"Turtle: cannot read {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.prefixes, self.base, self.rows, self.blanks = 0, {}, "", [], 0

    def _next(self, *want: str) -> tuple[str, str]:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if want and kind not in want and value not in want:
            raise ValueError(f"Turtle: expected {want}, found {value!r}")
        self.at += 1
        return kind, value

    def _peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def parse(self) -> list[tuple]:
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind == "dir":
                self._directive()
                continue
            s = self._term(True)
            if not (s[1] == "bnode" and self._peek() == "."):
                self._properties(s)
            self._next(".")
        return self.rows

    def _directive(self) -> None:
        _, word = self._next()
        if word.lower().endswith("prefix"):
            name = self._next("name")[1]
            self.prefixes[name[:-1]] = self._iri(self._next("iri")[1])
        else:
            self.base = self._next("iri")[1][1:-1]
        if word[0] == "@":
            self._next(".")

    def _iri(self, raw: str) -> str:
        ref = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), raw[1:-1])
        return ref if re.match("[A-Za-z][A-Za-z0-9+.-]*:", ref) else self.base + ref

    def _name(self, raw: str) -> str:
        prefix, _, rest = raw.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"Turtle: unknown prefix {prefix!r}")
        return self.prefixes[prefix] + rest

    def _blank(self) -> tuple:
        self.blanks += 1
        return (f"_:b{self.blanks}", "bnode", "", "")

    def _string(self, raw: str) -> str:
        body = raw[3:-3] if raw.startswith('"""') else raw[1:-1]
        return re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES[m[3]], body, flags=re.S)

    def _term(self, subject: bool = False) -> tuple:
        kind, value = self._next()
        if kind == "iri":
            return (self._iri(value), "iri", "", "")
        if kind == "name":
            return (self._name(value), "iri", "", "")
        if kind == "bnode":
            return (value, "bnode", "", "")
        if value == "[":
            node = self._blank()
            if self._peek() != "]":
                self._properties(node)
            self._next("]")
            return node
        if value == "(":
            items = []
            while self._peek() != ")":
                items.append(self._term())
            self._next(")")
            rest = (V.RDF + "nil", "iri", "", "")
            for item in reversed(items):
                node = self._blank()
                self._add(node, V.RDF + "first", item)
                self._add(node, V.RDF + "rest", rest)
                rest = node
            return rest
        if not subject and kind == "str":
            text = self._string(value)
            nxt = self.tokens[self.at][0] if self.at < len(self.tokens) else ""
            if nxt == "lang":
                return (text, "literal", V.RDF + "langString", self._next()[1][1:])
            if nxt == "dt":
                self._next()
                return (text, "literal", self._term()[0], "")
            return (text, "literal", "", "")
        if not subject and kind == "num":
            dt = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return (value, "literal", _XSD + dt, "")
        if not subject and value in ("true", "false"):
            return (value, "literal", _XSD + "boolean", "")
        raise ValueError(f"Turtle: unexpected {value!r}")

    def _add(self, s: tuple, p: str, o: tuple) -> None:
        self.rows.append((s[0], s[1], p, *o))

    def _properties(self, s: tuple) -> None:
        while True:
            kind, value = self._next("iri", "name", "a")
            p = V.TYPE if value == "a" else self._iri(value) if kind == "iri" else self._name(value)
            self._add(s, p, self._term())
            while self._peek() == ",":
                self._next()
                self._add(s, p, self._term())
            if self._peek() != ";":
                return
            while self._peek() == ";":
                self._next()
            if self._peek() in (".", "]", ""):
                return


def read_turtle(spark: SparkSession, text: str, graph: str = "data") -> DataFrame:
    return spark.createDataFrame([(graph, *r) for r in Turtle(text).parse()], SCHEMA).dropDuplicates(COLUMNS)


def read_turtle_lines(lines: DataFrame, graph: str = "data") -> DataFrame:
    """The triples of lines of Turtle (value) that each hold whole statements, as to_turtle() writes them; lines stay where they are.

    A line that needs others or a name of its own (directives, prefixed names, [] and lists) is refused: that is for
    read_turtle(), which takes a document as one text. A syntax error fails the whole read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            for i in range(0, len(values), 5_000):
                rows: list[tuple] = []
                for value in values[i : i + 5_000]:
                    doc = Turtle(value)
                    rows += doc.parse()
                    if doc.blanks or doc.prefixes or doc.base:
                        raise ValueError(f"Turtle: not a line of its own: {value[:80]!r}")
                if rows:
                    cols = [[graph] * len(rows), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], COLUMNS)

    return lines.select("value").mapInArrow(run, SCHEMA).dropDuplicates(COLUMNS)


def to_turtle(graph: DataFrame) -> DataFrame:
    """One line of text per triple, in the order of subject, property and object."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))
    tagged = F.when(F.col("o_lang") != "", F.concat(quoted, F.lit("@"), "o_lang")).when(F.col("o_dt") != "", F.concat(quoted, F.lit("^^<"), "o_dt", F.lit(">"))).otherwise(quoted)
    term = lambda v, k: F.when(F.col(k) == "iri", F.concat(F.lit("<"), v, F.lit(">"))).otherwise(F.col(v))
    line = F.concat(term("s", "s_kind"), F.lit(" <"), "p", F.lit("> "), F.when(F.col("o_kind") == "literal", tagged).otherwise(term("o", "o_kind")), F.lit(" ."))
    return graph.orderBy("s", "p", "o").select(line.alias("value"))
