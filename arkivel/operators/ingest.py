"""Catalogue rows to triples, edits of a graph, and agents that are looked up or made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..sources.triples import COLUMNS, described, literal, merged, without

#: Normalised header -> (property, repeatable).
CATALOGUE = {
    "title": (V.TITLE, False), "originaltitle": (V.TITLE, False), "othertitle": (V.RICO + "otherTitle", True), "subject": (V.DC + "subject", True),
    "description": (V.RICO + "generalDescription", True), "publisher": (V.DC + "publisher", True), "contributor": (V.DC + "contributor", True),
    "date": (V.DC + "date", True), "type": (V.DC + "type", True), "format": (V.DC + "format", True), "identifier": (V.DC + "identifier", True),
    "source": (V.DC + "source", True), "language": (V.DC + "language", True), "relation": (V.DC + "relation", True), "coverage": (V.DC + "coverage", True),
    "rights": (V.DC + "rights", True), "location": (V.EX + "hasStorageLocation", False), "receiveddate": (V.EX + "receivedDate", False),
    "accessioneddate": (V.EX + "accessionedDate", False), "provenance": (V.EX + "provenance", True), "fixityhashsha256": (V.EX + "fixity", False),
    "formatinfo": (V.EX + "formatInfo", True), "semantics": (V.EX + "semantics", True), "otherri": (V.EX + "otherRepInfo", True), "transferredrecord": (V.EX + "transferredRecord", False),
}


def _key(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def catalogue_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows with normalised column names, warnings): rows without number and title are set aside."""
    named = rows.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(_key(c)) for c in rows.columns])
    for c in ("recordno", "title"):
        if c not in named.columns:
            named = named.withColumn(c, F.lit(None).cast("string"))
    empty = (F.coalesce("recordno", F.lit("")) == "") & (F.coalesce("title", F.lit("")) == "")
    return named.where(~empty), named.where(empty).select(F.lit("a row without record number and title").alias("warning"))


def _valued(values: Column, p: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(p).alias("p"), v.alias("o"), F.lit("literal").alias("o_kind")))


def records(rows: DataFrame, batch: str) -> DataFrame:
    """Triples of the records, their creators and their preservation counterparts; one explode, no shuffle.

    Rows with one record number give one resource. Repeatable values are split; blanks give nothing.
    """
    number = F.coalesce(F.when(F.col("recordno") != "", F.col("recordno")), F.col("title"))
    s = F.concat(F.lit(f"{V.EX}record-{batch}-"), V.slug(number))
    aip = F.concat(F.lit(f"{V.EX}aip-{batch}-"), V.slug(number))
    one = lambda p, o, link: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("iri" if link else "literal").alias("o_kind"))
    parts = [F.array(one(V.TYPE, F.lit(V.RICO + "Record"), True), one(V.EX + "hasCounterpart", aip, True), one(V.EX + "recordNumber", number, False))]
    for c, (p, many) in CATALOGUE.items():
        if c in rows.columns:
            values = V.repeatable(c) if many else F.filter(F.array(F.trim(c)), lambda x: x != "")
            parts.append(_valued(F.coalesce(values, F.array().cast("array<string>")), p))
    if "creator" in rows.columns:
        parts.append(F.when(F.trim("creator") != "", F.array(one(V.RICO + "hasCreator", F.concat(F.lit(V.EX + "agent-"), V.slug("creator")), True))).otherwise(F.array().cast("array<struct<p:string,o:string,o_kind:string>>")))
    spread = rows.select(s.alias("s"), F.explode(F.concat(*parts)).alias("t")).where("t.o is not null")
    out = spread.select(F.lit("data").alias("g"), "s", F.lit("iri").alias("s_kind"), "t.p", "t.o", "t.o_kind", F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    counterpart = described(rows, aip, V.EX + "InformationPackage", [(V.EX + "describes", s, True)])
    return out.unionByName(counterpart).dropDuplicates(COLUMNS)


def accession(rows: DataFrame, batch: str, depositor: str, date: str) -> DataFrame:
    """The batch's own triples: how many rows came (repeats counted), and a link from it to every record."""
    s = F.lit(f"{V.EX}accession-{batch}")
    counted = rows.agg(F.count("*").cast("string").alias("n"))
    about = described(counted, s, V.EX + "Accession", [(V.EX + "quantityReceived", F.col("n"), False), (V.EX + "depositor", F.lit(depositor), False), (V.DC + "date", F.lit(date), False)])
    number = F.coalesce(F.when(F.col("recordno") != "", F.col("recordno")), F.col("title"))
    links = rows.select(F.concat(F.lit(f"{V.EX}record-{batch}-"), V.slug(number)).alias("o")).distinct()
    made = links.select(F.lit("data").alias("g"), s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(V.EX + "hasRecord").alias("p"), "o", F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    return about.unionByName(made)


def new_agents(rows: DataFrame, triples: DataFrame) -> DataFrame:
    """(s, name) of creators that no resource is named after, once each."""
    names = rows.select(F.trim("creator").alias("name")).where("name <> ''").distinct()
    known = triples.where(F.col("p") == V.NAME).select(F.col("o").alias("name"))
    return names.join(known, "name", "left_anti").select(F.concat(F.lit(V.EX + "agent-"), V.slug("name")).alias("s"), "name")


def add_literal(graph: DataFrame, s: str, p: str, value: str) -> DataFrame:
    one = graph.sparkSession.range(1).select(*literal("data", F.lit(s), p, F.lit(value)))
    return merged(graph, one)


def remove_literal(graph: DataFrame, s: str, p: str, value: str) -> DataFrame:
    """Plain literals only: values with a type or language stay."""
    one = graph.sparkSession.range(1).select(*literal("data", F.lit(s), p, F.lit(value)))
    return without(graph, one)


def delete_resource(graph: DataFrame, s: str) -> DataFrame:
    """Without the triples that have it as subject or as object."""
    return graph.where((F.col("s") != s) & ~((F.col("o") == s) & (F.col("o_kind") == "iri")))


def cascade_delete(graph: DataFrame, slug: str) -> DataFrame:
    """Without the resources whose IRI contains the slug, as subject or object: acc-1 takes acc-12 too."""
    victim = lambda c: F.contains(F.col(c), F.lit(slug))
    return graph.where(~victim("s") & ~((F.col("o_kind") == "iri") & victim("o")))


def create_if_absent(graph: DataFrame, s: str, cls: str, title: str) -> DataFrame:
    spark = graph.sparkSession
    new = described(spark.range(1), F.lit(s), cls, [(V.TITLE, F.lit(title), False)])
    return merged(graph, new.join(graph.select("s").where(F.col("s") == s).distinct(), "s", "left_anti").select(COLUMNS))


def group_migrated(graph: DataFrame, old: str, group: str, member: str) -> DataFrame:
    """Direct links of property `old` become links to one group per subject, which has their objects as members.

    Subjects that have a group already are left as they are.
    """
    grouped = graph.where(F.col("p") == group).select("s").distinct()
    direct = graph.where(F.col("p") == old).join(grouped, "s", "left_anti")
    node = F.concat("s", F.lit("-group"))
    shape = lambda s, p, o: [F.lit("data").alias("g"), s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang")]
    made = direct.select(*shape(F.col("s"), group, node)).unionByName(direct.select(*shape(node, member, F.col("o")))).distinct()
    return without(graph, direct.select(COLUMNS)).unionByName(made)


def attached(graph: DataFrame, files: DataFrame) -> DataFrame:
    """Storage links (url, name) on the records whose number a file name contains; the first file by name of each."""
    numbers = graph.where(F.col("p") == V.EX + "recordNumber").select("s", F.upper("o").alias("number"))
    named = files.select(V.record_number("name").alias("number"), F.struct("name", V.direct_link("url").alias("url")).alias("f")).where("number <> ''")
    first = named.groupBy("number").agg(F.min("f")["url"].alias("url"))
    new = numbers.join(first, "number").select(F.lit("data").alias("g"), "s", F.lit("iri").alias("s_kind"), F.lit(V.EX + "hasStorageLocation").alias("p"), F.col("url").alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    return merged(graph, new)
