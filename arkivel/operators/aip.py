"""Archival packages built from data objects, as triples, for any number of objects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from .packages import completeness

#: Part -> (class, property that leads to it, from which part).
PARTS = {
    "content": ("ContentInformation", "hasContentInformation", "aip"), "pdi": ("PreservationDescriptionInformation", "hasPreservationDescriptiveInformation", "aip"),
    "fixity": ("FixityInformation", "hasFixityInformation", "pdi"), "reference": ("ReferenceInformation", "hasReferenceInformation", "pdi"),
    "provenance": ("ProvenanceInformation", "hasProvenanceInformation", "pdi"), "context": ("ContextInformation", "hasContextInformation", "pdi"),
    "rights": ("AccessRightsInformation", "hasAccessRightsInformation", "pdi"), "description": ("PackageDescription", "describedBy", "aip"),
}


def build(objects: DataFrame) -> DataFrame:
    """Triples of the packages of (iri, name, sha256, size, location, context, rights, recorded_by, recorded_at).

    A part whose text is null is left out: fixity without a digest, rights without any.
    """
    node = lambda part: F.concat("iri", F.lit(f"/{part}"))
    comments: dict[str, Column] = {
        "fixity": F.concat(F.lit("SHA-256: "), "sha256", F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes), of the bits at "), "location"),
        "reference": F.concat(F.lit("Identifier: "), "iri", F.coalesce(F.concat(F.lit(". Its bits are at "), "location"), F.lit(""))),
        "provenance": F.concat(F.lit("Made from "), "name", F.lit(" on "), "recorded_at", F.coalesce(F.concat(F.lit(" by "), "recorded_by"), F.lit(""))),
        "context": F.coalesce("context", F.lit("")), "rights": F.col("rights"), "description": F.concat("name", F.lit(": an Archival Information Package")),
    }
    one = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))
    parts = [one(node("aip"), V.TYPE, F.lit(V.EX + "ArchivalInformationPackage"), "iri"), one(node("aip"), V.LABEL, F.concat(F.lit("AIP: "), "name"), "literal"), one(node("content"), V.EX + "hasDataObject", F.col("iri"), "iri")]
    for part, (cls, leads, above) in PARTS.items():
        there = comments[part].isNotNull() if part in comments else F.lit(True)
        some = lambda c, there=there: F.when(there, c)
        parts += [one(node(part), V.TYPE, some(F.lit(V.EX + cls)), "iri"), one(node(above), V.EX + leads, some(node(part)), "iri"), one(node(part), V.LABEL, some(F.concat(F.lit(cls + ": "), "name")), "literal")]
        if part in comments:
            parts.append(one(node(part), V.RDFS + "comment", comments[part], "literal"))
    rows = objects.select(F.explode(F.array(*parts)).alias("t")).select("t.*").where("o is not null and o <> ''")
    return rows.select(F.lit("data").alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))


def checked(triples: DataFrame) -> DataFrame:
    """(package, component, n, status) of the parts of each package in triples."""
    spark = triples.sparkSession
    links = triples.where(F.col("o_kind") == "iri").select("s", V.local_name("p").alias("component"), "o")
    packages = triples.where((F.col("p") == V.TYPE) & (F.col("o") == V.EX + "ArchivalInformationPackage")).select(F.col("s").alias("package"))
    direct = packages.join(links, packages["package"] == links["s"]).select("package", "component", "o")
    deep = direct.where(F.col("component") == PARTS["pdi"][1]).select("package", F.col("o").alias("s")).join(links, "s").select("package", "component", "o")
    rules = spark.createDataFrame([(p, 0 if part == "rights" else 1, 1) for part, (_, p, _) in PARTS.items()], "component string, least int, most int")
    return completeness(direct.unionByName(deep).select("package", "component"), rules)
