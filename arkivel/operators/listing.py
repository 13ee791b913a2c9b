"""Listings, search, facets, statistics and paging over triples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V


def of(triples: DataFrame, p: str, name: str = "o") -> DataFrame:
    """(s, name): the objects of a property."""
    return triples.where(F.col("p") == p).select("s", F.col("o").alias(name))


def typed(triples: DataFrame, cls: str, below: DataFrame | None = None) -> DataFrame:
    """(s, type): resources of a class, or of one below it if the closure (a, b) is given."""
    types = of(triples, V.TYPE, "type")
    if below is None:
        return types.where(F.col("type") == cls)
    return types.join(below.where(F.col("b") == cls).select(F.col("a").alias("type")), "type", "left_semi").select("s", "type")


def display(triples: DataFrame) -> DataFrame:
    """(s, title): title, else name, else label, else the local name; the smallest of each kind."""
    pick = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    return triples.groupBy("s").agg(F.coalesce(pick(V.TITLE), pick(V.NAME), pick(V.LABEL), V.local_name("s")).alias("title"))


def titled(rows: DataFrame, triples: DataFrame) -> DataFrame:
    """Rows of s with each title, else name, else IRI: several titles give several rows."""
    title, name = of(triples, V.TITLE, "t"), of(triples, V.NAME, "n")
    return rows.join(title, "s", "left").join(name, "s", "left").select(*rows.columns, F.coalesce("t", "n", "s").alias("title"))


@dataclass(frozen=True)
class Page:
    number: int
    size: int
    total: int

    @property
    def pages(self) -> int:
        return max(1, -(-self.total // self.size))

    @property
    def first(self) -> int:
        return 0 if not self.total else (self.number - 1) * self.size + 1

    @property
    def last(self) -> int:
        return min(self.number * self.size, self.total)


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 50, largest: int = 200) -> DataFrame:
    size, number = max(1, min(largest, size)), max(1, number)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def sorted_page(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """(s, type, title) rows by lower-cased title, then IRI; not distinct, as the total is."""
    return page(rows, [F.lower("title"), F.col("s"), F.col("type")], number, size)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("s").alias("total"))


def entities(triples: DataFrame, cls: str) -> DataFrame:
    """(s, sort_key) of a class, the smallest lower-cased title, name, label or tail of each."""
    some = triples.join(typed(triples, cls).select("s").distinct(), "s", "left_semi")
    pick = lambda p: F.min(F.when(F.col("p") == p, F.lower("o")))
    return some.groupBy("s").agg(F.coalesce(pick(V.TITLE), pick(V.NAME), pick(V.LABEL), F.lower(V.local_name("s"))).alias("sort_key"))


def collated(rows: DataFrame, name: str) -> DataFrame:
    """By a collation that ignores case, blanks last, code points between equals."""
    text = F.trim(F.coalesce(F.col(name), F.lit("")))
    return rows.orderBy(text == "", F.collate(text, "UNICODE_CI"), F.col(name))


def search(triples: DataFrame, ids: DataFrame, word: str) -> DataFrame:
    """(s): ids whose title, description, subject, type, record number or identifier (two links away) has the word."""
    has = F.contains(F.lower("o"), F.lit(word.lower()))
    direct = [V.TITLE, V.NAME, V.RICO + "generalDescription", V.DC + "subject", V.DC + "type", V.EX + "recordNumber", V.DC + "identifier"]
    hits = triples.where(F.col("p").isin(direct) & (F.col("o_kind") == "literal") & has).select("s")
    far = triples.where((F.col("p") == V.RICO + "hasOrHadIdentifier") & (F.col("o_kind") == "iri")).select("s", F.col("o").alias("mid"))
    value = triples.where((F.col("p") == V.RICO + "textualValue") & has).select(F.col("s").alias("mid"))
    return ids.join(hits.unionByName(far.join(value, "mid", "left_semi").select("s")).distinct(), "s", "left_semi")


@dataclass(frozen=True)
class Facets:
    """All given ones must hold: contains ones by lower-cased text, equals ones without case, dates as text from..to."""

    contains: tuple[tuple[str, str], ...] = ()
    equals: tuple[tuple[str, str], ...] = ()
    linked: tuple[tuple[str, str], ...] = ()
    date_from: str | None = None
    date_to: str | None = None


def advanced(triples: DataFrame, ids: DataFrame, facets: Facets) -> DataFrame:
    out = ids
    for p, word in facets.contains:
        out = out.join(triples.where((F.col("p") == p) & F.contains(F.lower("o"), F.lit(word.lower()))).select("s"), "s", "left_semi")
    for p, word in facets.equals:
        out = out.join(triples.where((F.col("p") == p) & (F.lower("o") == word.lower())).select("s"), "s", "left_semi")
    for p, name in facets.linked:  # the name of what a property leads to
        to = triples.where(F.col("p").isin(V.NAME, V.TITLE) & F.contains(F.lower("o"), F.lit(name.lower()))).select(F.col("s").alias("o"))
        out = out.join(triples.where(F.col("p") == p).join(to, "o", "left_semi").select("s"), "s", "left_semi")
    if facets.date_from is not None or facets.date_to is not None:  # both bounds for the same literal
        own = F.col("p") == V.DC + "date"
        if facets.date_from is not None:
            own &= F.col("o") >= facets.date_from
        if facets.date_to is not None:
            own &= F.col("o") <= facets.date_to
        out = out.join(triples.where(own).select("s"), "s", "left_semi")
    return out


def facet(ids: DataFrame, values: DataFrame, limit: int = 25) -> DataFrame:
    """(value, count): distinct ids by value, the largest first, ties by value."""
    both = ids.select("s").distinct().join(values, "s")
    return both.groupBy("value").agg(F.countDistinct("s").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def by_creator(triples: DataFrame, ids: DataFrame, limit: int = 25) -> DataFrame:
    made = of(triples, V.RICO + "hasCreator", "creator")
    names = of(triples, V.NAME, "value").withColumnRenamed("s", "creator")
    return facet(ids, made.join(names, "creator").select("s", "value"), limit)


def by_property(triples: DataFrame, ids: DataFrame, p: str, limit: int = 25) -> DataFrame:
    return facet(ids, of(triples, p, "value"), limit)


def by_year(triples: DataFrame, ids: DataFrame, limit: int = 100) -> DataFrame:
    years = of(triples, V.DC + "date", "d").select("s", F.substring("d", 1, 4).alias("value")).where(F.col("value").rlike("^[0-9]{4}$"))
    both = ids.select("s").distinct().join(years, "s")
    return both.groupBy("value").agg(F.countDistinct("s").alias("count")).orderBy("value").limit(limit)


def property_usage(data: DataFrame) -> DataFrame:
    """(p, uses, subjects) of all properties but rdf:type."""
    return data.where(F.col("p") != V.TYPE).groupBy("p").agg(F.count("*").alias("uses"), F.countDistinct("s").alias("subjects"))


def types_in_use(data: DataFrame) -> DataFrame:
    return data.where(F.col("p") == V.TYPE).groupBy(F.col("o").alias("type")).agg(F.countDistinct("s").alias("count"))


def dashboard(triples: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """Distinct resources by listing, and all triples, in one pass."""
    is_type = F.col("p") == V.TYPE
    return triples.agg(*[F.countDistinct(F.when(is_type & F.col("o").isin(list(v)), F.col("s"))).alias(k) for k, v in classes.items()], F.count("*").alias("triples"))


def literals(triples: DataFrame, s: str, hidden: tuple[str, ...] = (V.TITLE, V.NAME, V.RICO + "generalDescription")) -> DataFrame:
    return triples.where((F.col("s") == s) & (F.col("o_kind") == "literal") & ~F.col("p").isin(*hidden)).orderBy("p", "o")


def outgoing(triples: DataFrame, s: Column | str) -> DataFrame:
    """(p, target, title) of links but rdf:type, by property and title."""
    own = triples.where((F.col("s") == s) & (F.col("o_kind") == "iri") & (F.col("p") != V.TYPE)).select("p", F.col("o").alias("target"))
    names = display(triples.join(own.select(F.col("target").alias("s")).distinct(), "s", "left_semi")).withColumnRenamed("s", "target")
    return own.join(names, "target", "left").select("p", "target", F.coalesce("title", V.local_name("target")).alias("title")).orderBy("p", "title", "target")


def incoming(triples: DataFrame, o: str) -> DataFrame:
    own = triples.where((F.col("o") == o) & (F.col("o_kind") == "iri") & (F.col("p") != V.TYPE)).select("p", F.col("s").alias("source"))
    names = display(triples.join(own.select(F.col("source").alias("s")).distinct(), "s", "left_semi")).withColumnRenamed("s", "source")
    return own.join(names, "source", "left").select("p", "source", "title").orderBy("p", "title", "source")


def parents(triples: DataFrame, p: str) -> DataFrame:
    """(node, parent): of the sources of p the first by title."""
    both = triples.where((F.col("p") == p) & (F.col("o_kind") == "iri")).select("s", F.col("o").alias("node")).join(display(triples), "s")
    return both.groupBy("node").agg(F.min(F.struct("title", "s"))["s"].alias("parent"))


def truncated(triples: DataFrame, limit: int = 1500) -> tuple[DataFrame, bool]:
    """The first `limit` triples in order, and whether there are more."""
    some = triples.orderBy("s", "p", "o").limit(limit + 1)
    return some.limit(limit), some.count() > limit


def mentions(triples: DataFrame, uuid: str, limit: int = 5) -> DataFrame:
    hit = F.contains(F.lower("s"), F.lit(uuid.lower())) | F.contains(F.lower("o"), F.lit(uuid.lower()))
    return triples.where(hit).select("s").distinct().orderBy("s").limit(limit)
