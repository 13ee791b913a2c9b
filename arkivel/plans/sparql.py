"""SPARQL SELECT over the triples view (s, s_kind, p, o, o_kind, o_dt, o_lang), as one DataFrame plan.

Patterns, FILTER, BIND, VALUES, OPTIONAL, UNION, MINUS, EXISTS, sub-SELECT, paths (/ | ^ * + ? and sets), DISTINCT,
aggregates with HAVING, ORDER BY, LIMIT and OFFSET. Other query forms are refused. A variable is a column of text with
its kind beside it (iri, bnode, literal, or literal^^datatype@language); an expression that errs is null, which no FILTER
lets through. Kinds are dropped at the edge.

Triple patterns are joined in an order in which each shares a variable with those before it, if there is one. OPTIONAL,
EXISTS and NOT EXISTS are joins whose condition holds the filters of their group, which may name outer variables. A
variable that may be unbound is compatible with any value in a join.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators.closures import closure

_TOKEN = re.compile(
    r"\s+|#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<var>[?$][A-Za-z_]\w*)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')(?:@(?P<lang>[A-Za-z-]+))?"
    r"|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w-]*:[\w-]*|:[\w-]+)|(?P<word>[A-Za-z_]\w*)|(?P<op>&&|\|\||!=|<=|>=|\^\^|[{}().;,=<>!+*/|^?\[\]-])"
)


class Parser:
    def __init__(self, text: str):
        self.tokens, at, self.prefixes, self.fresh = [], 0, dict(V.PREFIXES), 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"SPARQL: cannot read {text[at : at + 20]!r}")
            kind = "str" if m.lastgroup == "lang" else m.lastgroup
            if kind:
                self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self, want: str | None = None) -> str:
        value = self.peek()
        if want is not None and value.upper() != want:
            raise ValueError(f"SPARQL: {want} is wanted, not {value!r}")
        self.at += 1
        return value

    def has(self, *words: str) -> bool:
        if self.peek().upper() in words and self.kind() in ("word", "op"):
            self.at += 1
            return True
        return False

    def query(self) -> dict:
        while self.has("PREFIX"):
            name = self.take()
            self.prefixes[name.rstrip(":")] = self.take()[1:-1]
        out = self.select()
        if self.kind() != "end":
            raise ValueError(f"SPARQL: unexpected {self.peek()!r}")
        return out

    def select(self) -> dict:
        if not self.has("SELECT"):
            raise ValueError("SPARQL: only SELECT is answered")
        q: dict = {"distinct": self.has("DISTINCT", "REDUCED"), "items": [], "group": [], "having": [], "order": [], "limit": None, "offset": 0}
        while not (self.peek().upper() == "WHERE" or self.peek() == "{"):
            if self.has("*"):
                q["items"] = None
            elif self.has("("):
                e = self.expression()
                self.take("AS")
                q["items"].append((self.take()[1:], e))
                self.take(")")
            else:
                v = self.take()
                q["items"].append((v[1:], ("var", v[1:])))
        self.has("WHERE")
        q["where"] = self.group()
        while True:
            if self.has("GROUP"):
                self.take("BY")
                while self.kind() == "var":
                    q["group"].append(self.take()[1:])
            elif self.has("HAVING"):
                q["having"].append(self.bracketed())
            elif self.has("ORDER"):
                self.take("BY")
                while self.kind() == "var" or self.peek().upper() in ("ASC", "DESC"):
                    down = self.peek().upper() == "DESC"
                    if self.kind() != "var":
                        self.take()
                        q["order"].append((self.bracketed(), down))
                    else:
                        q["order"].append((("var", self.take()[1:]), False))
            elif self.has("LIMIT"):
                q["limit"] = int(self.take())
            elif self.has("OFFSET"):
                q["offset"] = int(self.take())
            else:
                return q

    def bracketed(self):
        if self.kind() == "word":
            return self.primary()
        self.take("(")
        e = self.expression()
        self.take(")")
        return e

    def group(self) -> list:
        self.take("{")
        out: list = []
        if self.peek().upper() == "SELECT":
            out.append(("select", self.select()))
        while not self.has("}"):
            if self.has("."):
                continue
            if self.has("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.has("MINUS"):
                out.append(("minus", self.group()))
            elif self.has("FILTER"):
                out.append(("filter", self.bracketed()))
            elif self.has("BIND"):
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.append(("bind", self.take()[1:], e))
                self.take(")")
            elif self.has("VALUES"):
                out.append(self.values())
            elif self.peek() == "{":
                if self.peek(1).upper() == "SELECT":
                    self.take()
                    out.append(("select", self.select()))
                    self.take("}")
                else:
                    parts = [self.group()]
                    while self.has("UNION"):
                        parts.append(self.group())
                    out.append(("union", parts))
            else:
                self.triples(out)
        return out

    def values(self) -> tuple:
        many = self.has("(")
        names = []
        while self.kind() == "var":
            names.append(self.take()[1:])
        if many:
            self.take(")")
        self.take("{")
        rows = []
        while not self.has("}"):
            if many:
                self.take("(")
            rows.append([None if self.has("UNDEF") else self.term() for _ in names])
            if many:
                self.take(")")
        return ("values", names, rows)

    def term(self) -> tuple:
        kind, value = self.kind(), self.take()
        if kind == "var":
            return ("var", value[1:])
        if kind == "iri":
            return ("iri", value[1:-1])
        if kind == "name":
            prefix, _, rest = value.partition(":")
            return ("iri", self.prefixes[prefix] + rest)
        if kind == "word" and value == "a":
            return ("iri", V.TYPE)
        if kind == "str":
            return ("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "num" or value.lower() in ("true", "false"):
            return ("number", value)
        raise ValueError(f"SPARQL: unexpected {value!r}")

    def triples(self, out: list) -> None:
        s = self.term()
        while True:
            p = self.path() if self.kind() != "var" else self.term()
            while True:
                out.append(("triple", s, p, self.term()))
                if not self.has(","):
                    break
            if not self.has(";"):
                return
            if self.peek() in (".", "}"):
                return

    def path(self) -> tuple:
        def alternative() -> tuple:
            parts = [sequence()]
            while self.has("|"):
                parts.append(sequence())
            return parts[0] if len(parts) == 1 else ("alt", parts)

        def sequence() -> tuple:
            parts = [step()]
            while self.has("/"):
                parts.append(step())
            return parts[0] if len(parts) == 1 else ("seq", parts)

        def step() -> tuple:
            if self.has("^"):
                return ("inverse", step())
            if self.has("!"):
                own = self.has("(")
                names = [self.term()[1]]
                while own and self.has("|"):
                    names.append(self.term()[1])
                if own:
                    self.take(")")
                made: tuple = ("not", names)
            elif self.has("("):
                made = alternative()
                self.take(")")
            else:
                made = self.term()
            if self.kind() == "op" and self.peek() in ("*", "+", "?"):
                made = ("times", made, self.take())
            return made

        return alternative()

    def expression(self):
        left = self.conjunction()
        while self.has("||"):
            left = ("||", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.has("&&"):
            left = ("&&", left, self.comparison())
        return left

    def comparison(self):
        left = self.sum()
        if self.kind() == "op" and self.peek() in ("=", "!=", "<", "<=", ">", ">="):
            return (self.take(), left, self.sum())
        no = self.peek().upper() == "NOT" and self.peek(1).upper() == "IN"
        if no:
            self.take()
        if self.has("IN"):
            self.take("(")
            items = [self.expression()]
            while self.has(","):
                items.append(self.expression())
            self.take(")")
            return ("!", ("in", left, items)) if no else ("in", left, items)
        return left

    def sum(self):
        left = self.product()
        while self.kind() == "op" and self.peek() in ("+", "-"):
            left = (self.take(), left, self.product())
        return left

    def product(self):
        left = self.primary()
        while self.kind() == "op" and self.peek() in ("*", "/"):
            left = (self.take(), left, self.primary())
        return left

    def primary(self):
        if self.has("!"):
            return ("!", self.primary())
        if self.has("-"):
            return ("-", ("number", "0"), self.primary())
        if self.has("("):
            e = self.expression()
            self.take(")")
            return e
        if self.kind() == "word" and self.peek().lower() not in ("true", "false"):
            name = self.take().upper()
            if name in ("EXISTS", "NOT"):
                if name == "NOT":
                    self.take("EXISTS")
                e = ("exists", self.group())
                return ("!", e) if name == "NOT" else e
            self.take("(")
            distinct = self.has("DISTINCT")
            args, sep = [], " "
            while not self.has(")"):
                if self.has("*"):
                    args.append(("star",))
                elif self.has(";"):
                    self.take("SEPARATOR")
                    self.take("=")
                    sep = self.take()[1:-1]
                elif not self.has(","):
                    args.append(self.expression())
            return ("call", name, args, distinct, sep)
        return self.term()


XSD = "http://www.w3.org/2001/XMLSchema#"
#: Datatypes whose literals are ordered as numbers.
NUMERIC = ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "unsignedInt", "unsignedLong", "nonNegativeInteger", "positiveInteger")
WHOLE, FRACTION = f"literal^^{XSD}integer@", f"literal^^{XSD}decimal@"
NUMBERS = {"ABS", "CEIL", "FLOOR", "ROUND", "STRLEN", "YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
KIND = "__kind_"


def plain(number: Column) -> Column:
    """A number's text; whole numbers without a fraction."""
    return F.when(number == F.floor(number), number.try_cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))


class _Names:
    """Stands for rows where only their columns' names matter."""

    def __init__(self, columns):
        self.columns = list(columns)


class Engine:
    def __init__(self, triples: DataFrame):
        literal = F.when((F.coalesce("o_dt", F.lit("")) == "") & (F.coalesce("o_lang", F.lit("")) == ""), F.lit("literal")).otherwise(F.concat(F.lit("literal^^"), F.coalesce("o_dt", F.lit("")), F.lit("@"), F.coalesce("o_lang", F.lit(""))))
        kind = F.when(F.col("o_kind") == "literal", literal).otherwise(F.col("o_kind")) if {"o_dt", "o_lang"} <= set(triples.columns) else F.col("o_kind")
        self.triples, self.spark, self.made = triples.select("s", "s_kind", "p", "o", kind.alias("o_kind")), triples.sparkSession, 0
        self.loose: set[str] = set()  # variables that may be unbound

    def select(self, q: dict) -> DataFrame:
        rows = self.group(q["where"], None)
        names = self.names(rows)
        items = q["items"] if q["items"] is not None else [(n, ("var", n)) for n in names]
        if q["group"] or any(self.aggregates(e) for _, e in items):
            keys = [F.col(g) for g in q["group"]] + [F.first(F.col(KIND + g), True).alias(KIND + g) for g in q["group"]]
            aggs = [self.aggregate(e, rows).alias(f"__agg{i}") for i, (_, e) in enumerate(items) if self.aggregates(e)]
            having = [self.aggregate(h, rows).alias(f"__having{i}") for i, h in enumerate(q["having"])]
            grouped = rows.groupBy(*q["group"]).agg(*(keys[len(q["group"]) :] + aggs + having or [F.count("*").alias("__n")]))
            for i in range(len(having)):
                grouped = grouped.where(F.col(f"__having{i}"))
            cols = []
            for i, (n, e) in enumerate(items):
                if self.aggregates(e):
                    cols += self.aggregated(e, F.col(f"__agg{i}"), n)
                else:
                    cols += [F.col(e[1]).alias(n), F.col(KIND + e[1]).alias(KIND + n)]
            rows = grouped.select(*cols)
        else:
            cols = []
            for n, e in items:
                if e[0] == "var" and e[1] not in names:
                    cols += [F.lit(None).cast("string").alias(n), F.lit(None).cast("string").alias(KIND + n)]
                elif e[0] == "var":
                    cols += [F.col(e[1]).alias(n), F.col(KIND + e[1]).alias(KIND + n)]
                else:
                    cols += [self.text(e, rows).alias(n), self.kind_of(e, rows).alias(KIND + n)]
            if q["order"]:
                rows = rows.select(*cols, *[F.col(c).alias("__o_" + c) for c in rows.columns])
            else:
                rows = rows.select(*cols)
        if q["distinct"]:
            rows = rows.select(*[c for c in rows.columns if not c.startswith("__o_")]).distinct()
        for_order = []
        for e, down in q["order"]:
            n = e[1] if e[0] == "var" else None
            value = F.col(n if n in rows.columns else f"__o_{n}") if n else self.text(e, rows)
            kind = F.col((KIND + n) if n in rows.columns else f"__o_{KIND}{n}") if n else self.kind_of(e, rows)
            rank = F.when(value.isNull(), 0).when(kind == "bnode", 1).when(kind == "iri", 2).otherwise(3)
            number = F.when(F.regexp_extract(kind, r"#(\w+)@$", 1).isin(*NUMERIC), value.try_cast("double"))
            for c in (rank, number, value):
                for_order.append(c.desc() if down else c.asc())
        if for_order:
            rows = rows.orderBy(*for_order)
        if q["offset"]:
            rows = rows.offset(q["offset"])
        if q["limit"] is not None:
            rows = rows.limit(q["limit"])
        return rows.select(*[c for c in rows.columns if not c.startswith("__o_")])

    @staticmethod
    def names(rows: DataFrame) -> list[str]:
        return [c for c in rows.columns if not c.startswith("__")]

    def unit(self) -> DataFrame:
        return self.spark.range(1).select()

    def join(self, a: DataFrame | None, b: DataFrame, how: str = "inner", filters: list | None = None) -> DataFrame:
        """Compatible rows of a and b; filters see the variables of both and are part of the condition."""
        if a is None:
            return b
        shared = [n for n in self.names(a) if n in self.names(b)]
        self.made += 1
        mine = f"__j{self.made}_"
        b = b.withColumnsRenamed({c: mine + c for n in shared for c in (n, KIND + n)})
        tests = []
        for n in shared:
            same = (F.col(n) == F.col(mine + n)) & (F.col(KIND + n) == F.col(mine + KIND + n))
            tests.append(F.col(n).isNull() | F.col(mine + n).isNull() | same if n in self.loose else same)
        both = _Names([*a.columns, *b.columns])
        tests += [F.coalesce(self.boolean(f, both), F.lit(False)) for f in filters or []]
        out = a.join(b, reduce(lambda x, y: x & y, tests, F.lit(True)), how)
        if how in ("left_semi", "left_anti"):
            return out
        bound = {c: F.coalesce(F.col(c), F.col(mine + c)).alias(c) for n in shared if n in self.loose for c in (n, KIND + n)}
        return out.select(*[bound.get(c, F.col(c)) for c in a.columns], *[c for c in b.columns if not c.startswith(mine)])

    @staticmethod
    def ordered(parts: list, known: set[str]) -> list:
        """The parts with each run of triple patterns so ordered that one shares a variable with those before, if any does."""
        out, run = [], []
        variables = lambda p: {t[1] for t in p[1:] if t[0] == "var"}

        def settle() -> None:
            nonlocal run
            while run:
                best = min(run, key=lambda p: (bool(known) and not variables(p) & known, len(variables(p) - known), run.index(p)))
                run.remove(best)
                known.update(variables(best))
                out.append(best)

        for p in parts:
            if p[0] == "triple":
                run.append(p)
            elif p[0] != "filter":
                settle()
                known.update([p[1]] if p[0] == "bind" else p[1] if p[0] == "values" else [])
                out.append(p)
        settle()
        return out

    def group(self, parts: list, rows: DataFrame | None) -> DataFrame:
        filters = [p[1] for p in parts if p[0] == "filter"]
        for p in self.ordered(parts, set(self.names(rows)) if rows is not None else set()):
            if p[0] == "triple":
                found = self.pattern(*p[1:])
                rows = self.join(rows, found)
                self.loose -= set(self.names(found))
            elif p[0] == "optional":
                rows = self.optional(rows, p[1])
            elif p[0] == "minus":
                less = self.group(p[1], None)
                rows = self.join(rows, less, "left_anti") if set(self.names(rows)) & set(self.names(less)) else rows
            elif p[0] == "union":
                made = None
                for g in p[1]:
                    part = self.group(g, None)
                    if made is not None:
                        self.loose |= set(self.names(part)) ^ set(self.names(made))
                    made = part if made is None else made.unionByName(part, allowMissingColumns=True)
                rows = self.join(rows, made)
            elif p[0] == "select":
                rows = self.join(rows, self.select(p[1]))
            elif p[0] == "bind":
                rows = rows if rows is not None else self.unit()
                rows = rows.withColumns({p[1]: self.text(p[2], rows), KIND + p[1]: self.kind_of(p[2], rows)})
                self.loose.add(p[1])
            elif p[0] == "values":
                self.loose |= {n for i, n in enumerate(p[1]) if any(r[i] is None for r in p[2])}
                flat = [[x for t in r for x in ((t[1], "iri" if t[0] == "iri" else "literal") if t else (None, None))] for r in p[2]]
                rows = self.join(rows, self.spark.createDataFrame(flat, ", ".join(f"`{n}` string, `{KIND}{n}` string" for n in p[1])))
        rows = self.unit() if rows is None else rows
        for f in filters:
            rows = self.filtered(rows, f)
        return rows

    def optional(self, rows: DataFrame, parts: list) -> DataFrame:
        """A left join; a filter of the optional group may speak of variables outside it, so it is part of the condition."""
        inner, filters = self.apart(parts)
        rows = rows if rows is not None else self.unit()
        out = self.join(rows, inner, "left", filters)
        self.loose |= set(self.names(inner)) - set(self.names(rows))
        return out

    def apart(self, parts: list) -> tuple[DataFrame, list]:
        """A group without its filters, and these; filters with groups of their own are applied within it."""
        nested = lambda e: isinstance(e, tuple) and (e[0] == "exists" or any(nested(x) for x in e[1:]))
        filters = [p[1] for p in parts if p[0] == "filter" and not nested(p[1])]
        return self.group([p for p in parts if p[0] != "filter" or nested(p[1])], None), filters

    def filtered(self, rows: DataFrame, e: tuple) -> DataFrame:
        if e[0] == "&&":
            return self.filtered(self.filtered(rows, e[1]), e[2])
        if e[0] == "exists":
            inner, filters = self.apart(e[1])
            return self.join(rows, inner, "left_semi", filters)
        if e[0] == "!" and e[1][0] == "exists":
            inner, filters = self.apart(e[1][1])
            return self.join(rows, inner, "left_anti", filters)
        return rows.where(F.coalesce(self.boolean(e, rows), F.lit(False)))

    def pattern(self, s: tuple, p: tuple, o: tuple) -> DataFrame:
        if p[0] == "iri":
            base = self.triples.where(F.col("p") == p[1]).select("s", "s_kind", "o", "o_kind")
        elif p[0] == "var":
            base = self.triples.select("s", "s_kind", "p", "o", "o_kind")
        elif p[0] == "times" and s[0] != "iri" and o[0] == "iri":  # from the known end backwards
            back = self.pairs(("times", ("inverse", p[1]), p[2]), o)
            base = back.select(F.col("o").alias("s"), F.col("o_kind").alias("s_kind"), F.col("s").alias("o"), F.col("s_kind").alias("o_kind"))
        else:
            base = self.pairs(p, s)
        tests, cols, seen = [], [], {}
        for term, c in ((s, "s"), (p, "p"), (o, "o")):
            if c == "p" and p[0] != "var":
                continue
            kind = F.lit("iri") if c == "p" else F.col(f"{c}_kind")
            if term[0] != "var":
                tests += [F.col(c) == term[1], kind == "iri" if term[0] == "iri" else kind.startswith("literal")]
            elif term[1] in seen:
                tests.append(F.col(c) == F.col(seen[term[1]]))
            else:
                seen[term[1]] = c
                cols += [F.col(c).alias(term[1]), kind.alias(KIND + term[1])]
        for t in tests:
            base = base.where(t)
        return base.select(*cols) if cols else base.limit(1).select()

    def pairs(self, p: tuple, s: tuple) -> DataFrame:
        """Distinct (s, s_kind, o, o_kind) of a path."""
        if p[0] == "iri":
            return self.triples.where(F.col("p") == p[1]).select("s", "s_kind", "o", "o_kind")
        if p[0] == "not":
            return self.triples.where(~F.col("p").isin(p[1])).select("s", "s_kind", "o", "o_kind")
        if p[0] == "inverse":
            return self.pairs(p[1], ("none",)).select(F.col("o").alias("s"), F.col("o_kind").alias("s_kind"), F.col("s").alias("o"), F.col("s_kind").alias("o_kind"))
        if p[0] == "alt":
            return reduce(lambda a, b: a.unionByName(b), [self.pairs(x, ("none",)) for x in p[1]])
        if p[0] == "seq":
            out = self.pairs(p[1][0], ("none",))
            for nxt in p[1][1:]:
                b = self.pairs(nxt, ("none",)).withColumnsRenamed({"s": "m", "s_kind": "m_kind", "o": "o2", "o_kind": "o2_kind"})
                out = out.join(b, (F.col("o") == F.col("m")) & (F.col("o_kind") == F.col("m_kind"))).select("s", "s_kind", F.col("o2").alias("o"), F.col("o2_kind").alias("o_kind"))
            return out
        edges = self.pairs(p[1], ("none",)).distinct()
        ends = edges.select(F.col("s").alias("node"), F.col("s_kind").alias("k")).unionByName(edges.select(F.col("o").alias("node"), F.col("o_kind").alias("k"))).distinct()
        seeds = self.spark.createDataFrame([(s[1],)], "node string") if s[0] == "iri" else ends.select("node")
        found = closure(edges.select(F.col("s").alias("a"), F.col("o").alias("b")), seeds, 1 if p[2] == "?" else None)
        if p[2] == "+":  # a node is beyond itself only by a circle
            back = found.join(edges.select(F.col("s").alias("node"), F.col("o").alias("to")), "node").select("root", F.col("to").alias("node")).distinct()
            found = back
        kinds = ends.groupBy("node").agg(F.min("k").alias("k"))
        out = found.join(kinds.withColumnsRenamed({"node": "root", "k": "s_kind"}), "root", "left").join(kinds.withColumnRenamed("k", "o_kind"), "node", "left")
        return out.select(F.col("root").alias("s"), F.coalesce("s_kind", F.lit("iri")).alias("s_kind"), F.col("node").alias("o"), F.coalesce("o_kind", F.lit("iri")).alias("o_kind")).distinct()

    def aggregates(self, e) -> bool:
        return isinstance(e, tuple) and (e[0] == "call" and e[1] in AGGREGATES or any(self.aggregates(x) for x in e[1:] if isinstance(x, tuple)))

    def aggregate(self, e: tuple, rows: DataFrame) -> Column:
        if e[0] == "call" and e[1] in AGGREGATES:
            _, name, args, distinct, sep = e
            if args[0] == ("star",):
                return F.countDistinct(F.struct(*rows.columns)) if distinct else F.count("*")
            text, number = self.text(args[0], rows), self.number(args[0], rows)
            if name == "COUNT":
                return F.countDistinct(text) if distinct else F.count(text)
            if name == "GROUP_CONCAT":
                return F.concat_ws(sep, F.array_sort(F.collect_set(text) if distinct else F.collect_list(text)))
            if name in ("MIN", "MAX"):  # numbers by value before text
                f = F.min if name == "MIN" else F.max
                return f(F.struct(number.alias("n"), text.alias("t")))["t"]
            if name == "SAMPLE":
                return F.min(text)
            if distinct:
                return {"SUM": F.sum_distinct, "AVG": lambda c: F.sum_distinct(c) / F.countDistinct(c)}[name](number)
            return F.coalesce({"SUM": F.sum, "AVG": F.avg}[name](number), F.lit(0.0))
        if e[0] in ("=", "!=", "<", "<=", ">", ">="):
            a, b = (self.aggregate(x, rows) if self.aggregates(x) else F.lit(float(x[1])) if x[0] == "number" else F.lit(x[1]) for x in e[1:])
            return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[0]]
        if e[0] in ("+", "-", "*", "/"):
            a, b = (self.aggregate(x, rows) if self.aggregates(x) else F.lit(float(x[1])) for x in e[1:])
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[0]]
        raise ValueError("SPARQL: not an aggregate")

    def aggregated(self, e: tuple, value: Column, name: str) -> list[Column]:
        """Text and kind of an aggregate's column."""
        if e[0] == "call" and e[1] in ("GROUP_CONCAT", "SAMPLE", "MIN", "MAX"):
            kind = F.lit("literal") if e[1] in ("GROUP_CONCAT", "SAMPLE") else F.when(value.try_cast("double").isNotNull(), F.lit(FRACTION)).otherwise(F.lit("literal"))
            return [value.cast("string").alias(name), kind.alias(KIND + name)]
        number = value.cast("double")
        return [plain(number).alias(name), F.when(number == F.floor(number), F.lit(WHOLE)).otherwise(F.lit(FRACTION)).alias(KIND + name)]

    def kind_of(self, e: tuple, rows: DataFrame) -> Column:
        if e[0] == "var":
            return F.col(KIND + e[1]) if KIND + e[1] in rows.columns else F.lit(None).cast("string")
        if e[0] == "iri" or e[0] == "call" and e[1] in ("IRI", "URI", "DATATYPE"):
            return F.lit("iri")
        if e[0] in ("number", "+", "-", "*", "/") or e[0] == "call" and e[1] in NUMBERS:
            number = self.number(e, rows)
            return F.when(number == F.floor(number), F.lit(WHOLE)).otherwise(F.lit(FRACTION))
        if e[0] == "call" and e[1] == "COALESCE":
            return F.coalesce(*[F.when(self.text(a, rows).isNotNull(), self.kind_of(a, rows)) for a in e[2]])
        if e[0] == "call" and e[1] == "IF":
            return F.when(self.boolean(e[2][0], rows), self.kind_of(e[2][1], rows)).otherwise(self.kind_of(e[2][2], rows))
        return F.lit("literal")

    def number(self, e: tuple, rows: DataFrame) -> Column:
        if e[0] == "number":
            return F.lit(float(e[1])) if e[1].lower() not in ("true", "false") else F.lit(float(e[1].lower() == "true"))
        if e[0] in ("+", "-", "*", "/"):
            a, b = self.number(e[1], rows), self.number(e[2], rows)
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[0]]
        if e[0] == "call" and e[1] in NUMBERS:
            if e[1] in ("HOURS", "MINUTES", "SECONDS"):
                at = self.text(e[2][0], rows).try_cast("timestamp_ntz")
                return {"HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}[e[1]](at).cast("double")
            if e[1] == "STRLEN":
                return F.char_length(self.text(e[2][0], rows)).cast("double")
            if e[1] in ("YEAR", "MONTH", "DAY"):
                day = F.substring(self.text(e[2][0], rows), 1, 10).try_cast("date")
                return {"YEAR": F.year, "MONTH": F.month, "DAY": F.day}[e[1]](day).cast("double")
            return {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": F.round}[e[1]](self.number(e[2][0], rows)).cast("double")
        return self.text(e, rows).try_cast("double")

    def text(self, e: tuple, rows: DataFrame) -> Column:
        if e[0] == "var":
            return F.col(e[1]) if e[1] in rows.columns else F.lit(None).cast("string")
        if e[0] in ("iri", "literal"):
            return F.lit(e[1])
        if e[0] == "number":
            return F.lit(e[1])
        if e[0] in ("+", "-", "*", "/"):
            return plain(self.number(e, rows))
        if e[0] == "call":
            name, args = e[1], e[2]
            t = lambda i: self.text(args[i], rows)
            if name == "IF":
                return F.when(self.boolean(args[0], rows), t(1)).otherwise(t(2))
            if name == "SUBSTR":
                start = self.number(args[1], rows).cast("int")
                return F.substring(t(0), start, self.number(args[2], rows).cast("int") if len(args) > 2 else F.lit(1 << 30))
            if name in NUMBERS:
                return plain(self.number(e, rows))
            if name in ("LANG", "DATATYPE"):
                kind = self.kind_of(args[0], rows)
                lang = F.regexp_extract(kind, "@([^@]*)$", 1)
                if name == "LANG":
                    return F.when(kind.startswith("literal"), lang)
                known = F.regexp_extract(kind, r"\^\^(.+)@", 1)
                return F.when(kind.startswith("literal"), F.when(lang != "", V.RDF + "langString").when(known != "", known).otherwise(XSD + "string"))
            if name in ("CONTAINS", "STRSTARTS", "STRENDS", "REGEX", "BOUND", "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISNUMERIC", "LANGMATCHES", "SAMETERM"):
                return self.boolean(e, rows).cast("string")
            simple = {
                "STR": lambda: t(0), "LCASE": lambda: F.lower(t(0)), "UCASE": lambda: F.upper(t(0)), "IRI": lambda: t(0), "URI": lambda: t(0),
                "CONCAT": lambda: F.concat(*[self.text(a, rows) for a in args]), "COALESCE": lambda: F.coalesce(*[self.text(a, rows) for a in args]),
                "REPLACE": lambda: F.regexp_replace(t(0), t(1), t(2)), "STRBEFORE": lambda: F.when(F.contains(t(0), t(1)), F.split_part(t(0), t(1), F.lit(1))).otherwise(F.lit("")),
                "STRAFTER": lambda: F.when(F.contains(t(0), t(1)), F.substring(t(0), F.instr(t(0), args[1][1]) + F.length(t(1)), F.lit(1 << 30))).otherwise(F.lit("")),
                "MD5": lambda: F.md5(t(0)), "SHA1": lambda: F.sha1(t(0)), "SHA256": lambda: F.sha2(t(0), 256), "SHA512": lambda: F.sha2(t(0), 512), "ENCODE_FOR_URI": lambda: F.url_encode(t(0)),
            }
            if name in simple:
                return simple[name]()
        raise ValueError(f"SPARQL: {e[:2]} is not known")

    def boolean(self, e: tuple, rows: DataFrame) -> Column:
        if e[0] in ("&&", "||"):
            a, b = self.boolean(e[1], rows), self.boolean(e[2], rows)
            return a & b if e[0] == "&&" else a | b
        if e[0] == "!":
            return ~self.boolean(e[1], rows)
        if e[0] in ("=", "!=", "<", "<=", ">", ">="):
            def made(x, y):
                return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e[0]]

            a, b = (self.number(x, rows) for x in e[1:])
            return F.when(a.isNotNull() & b.isNotNull(), made(a, b)).otherwise(made(*(self.text(x, rows) for x in e[1:])))
        if e[0] == "in":
            return reduce(lambda x, y: x | y, [self.boolean(("=", e[1], x), rows) for x in e[2]])
        if e[0] == "call":
            name, args = e[1], e[2]
            if name == "BOUND":
                return self.text(args[0], rows).isNotNull()
            if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
                kind = self.kind_of(args[0], rows)
                return kind.startswith("literal") if name == "ISLITERAL" else kind == ("bnode" if name == "ISBLANK" else "iri")
            if name == "ISNUMERIC":
                return F.regexp_extract(self.kind_of(args[0], rows), r"#(\w+)@$", 1).isin(*NUMERIC)
            if name == "SAMETERM":
                return (self.text(args[0], rows) == self.text(args[1], rows)) & (self.kind_of(args[0], rows) == self.kind_of(args[1], rows))
            if name == "LANGMATCHES":
                tag, asked = F.lower(self.text(args[0], rows)), F.lower(self.text(args[1], rows))
                return F.when(asked == "*", tag != "").otherwise((tag == asked) | tag.startswith(F.concat(asked, F.lit("-"))))
            if name == "REGEX":
                flags = "(?i)" if len(args) > 2 and "i" in args[2][1] else ""
                return F.rlike(self.text(args[0], rows), F.lit(flags + args[1][1]))
            if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
                f = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name]
                return f(self.text(args[0], rows), self.text(args[1], rows))
        return self.text(e, rows).try_cast("boolean")


def run(triples: DataFrame, query: str) -> DataFrame:
    """The rows of a SELECT, as text; unbound is null."""
    rows = Engine(triples).select(Parser(query).query())
    return rows.select(*[c for c in rows.columns if not c.startswith("__")])


def result_iris(triples: DataFrame, query: str) -> DataFrame:
    """(node): all IRIs of the result, whatever the variable, to view as a graph."""
    rows = Engine(triples).select(Parser(query).query())
    names = [c for c in rows.columns if not c.startswith("__")]
    return rows.select(F.explode(F.array(*[F.when(F.col(KIND + n) == "iri", F.col(n)) for n in names])).alias("node")).where("node is not null").distinct()
