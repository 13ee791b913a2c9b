"""Package checks: payload against manifest, completeness of components, findings by rules; bags written."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Component -> (required, normalised columns that are a source).
RULES = {
    "Package Description": (True, ["title", "description"]), "Data Object": (True, ["filename", "objectname"]),
    "Structure RepInfo": (True, ["format", "formatinfo"]), "Semantic RepInfo": (True, ["semantics", "language"]), "Other RepInfo": (False, ["otherri"]),
    "PDI Fixity": (True, ["fixityhashsha256"]), "PDI Provenance": (True, ["provenance", "creator", "publisher", "contributor"]), "PDI Context": (True, ["relation"]),
    "PDI Reference": (True, ["recordno", "identifier"]), "PDI Access Rights": (True, ["rights"]),
}


def bag_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): matched, mismatched, missing or unlisted; manifest (path, sha256), files (path, sha256)."""
    m, f = manifest.select("path", F.lower("sha256").alias("want")), files.select("path", F.lower("sha256").alias("have"))
    both = m.join(f, "path", "full_outer")
    return both.select("path", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") == F.col("have"), "matched").otherwise("mismatched").alias("status"))


def bag_summary(checked: DataFrame) -> DataFrame:
    """Counts by status; valid: nothing mismatched or missing; verified: something was compared."""
    kinds = ("matched", "mismatched", "missing", "unlisted")
    counts = checked.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    return counts.withColumns({"valid": (F.col("mismatched") == 0) & (F.col("missing") == 0), "verified": F.col("matched") > 0})


def oxum(files: DataFrame) -> DataFrame:
    """Octets and number of streams of a payload."""
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("octets"), F.count("*").alias("streams"))


def completeness(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """(package, component, status): rules (component, least, most) against parts (package, component)."""
    counts = parts.groupBy("package", "component").agg(F.count("*").alias("n"))
    wanted = parts.select("package").distinct().join(F.broadcast(rules))  # the rules are a handful of rows
    out = wanted.join(counts, ["package", "component"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") < F.col("least"), "MISSING").when(F.col("n") > F.col("most"), "TOO_MANY").otherwise("PRESENT")
    return out.select("package", "component", "n", status.alias("status"))


def findings(metadata: DataFrame, package: str) -> DataFrame:
    """(package, component, required, sources, gaps, found) of metadata rows: filled is non-blank, not 0, not `Words:`."""
    def key(c: str) -> str:
        return "".join(x for x in c.lower().removeprefix("dc.") if x.isascii() and x.isalnum())

    names = {key(c): c for c in metadata.columns}
    def filled(c: str):
        v = F.trim(F.coalesce(F.col(f"`{names[c]}`").cast("string"), F.lit("")))
        return (v != "") & (v != "0") & ~v.rlike(r"^[A-Za-z ]+:$")

    rows = []
    for component, (required, columns) in RULES.items():
        sources = F.filter(F.array(*[F.when(filled(c), c) if c in names else F.lit(None).cast("string") for c in columns]), lambda x: x.isNotNull())
        gaps = F.array_except(F.array(*[F.lit(c) for c in columns]), sources)
        rows.append(F.struct(F.lit(component).alias("component"), F.lit(required).alias("required"), sources.alias("sources"), gaps.alias("gaps")))
    return metadata.select(F.col(f"`{package}`").alias("package"), F.explode(F.array(*rows)).alias("r")).select("package", "r.*", (F.size("r.sources") > 0).alias("found"))


def bag(files: dict[str, bytes], info: dict[str, str], fetch: dict[str, tuple[str, int]] | None = None) -> bytes:
    """A bag as zip: payload under data/, sha256 manifests of payload and tags, Payload-Oxum, fetch.txt if asked."""
    fetch = fetch or {}
    tags = {
        "bagit.txt": "BagIt-Version: 1.0\nTag-File-Character-Encoding: UTF-8\n",
        "bag-info.txt": "".join(f"{k}: {v}\n" for k, v in info.items()) + f"Payload-Oxum: {sum(map(len, files.values())) + sum(n for _, n in fetch.values())}.{len(files) + len(fetch)}\n",
        "manifest-sha256.txt": "".join(f"{hashlib.sha256(b).hexdigest()}  data/{p}\n" for p, b in sorted(files.items())),
    }
    if fetch:
        tags["fetch.txt"] = "".join(f"{url} {n} data/{p}\n" for p, (url, n) in sorted(fetch.items()))
    tags["tagmanifest-sha256.txt"] = "".join(f"{hashlib.sha256(t.encode()).hexdigest()}  {p}\n" for p, t in sorted(tags.items()))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p, b in sorted(files.items()):
            z.writestr(f"data/{p}", b)
        for p, t in tags.items():
            z.writestr(p, t)
    return out.getvalue()


#: Namespaces of package metadata and the names they get.
SCHEMES = {"http://www.loc.gov/METS/": "mets", "http://www.loc.gov/premis/v3": "premis", "info:lc/xmlns/premis-v2": "premis", "http://purl.org/dc/elements/1.1/": "dc", "http://purl.org/dc/terms/": "dcterms"}


def metadata(files: DataFrame) -> DataFrame:
    """(path, scheme, term, place, value, error) of the METS, PREMIS and Dublin Core elements of XML files (path, content).

    Elements with text, and attributes of METS files (checksum, size, mimetype, href) as terms of their own. place counts
    the elements of a file. What is not XML gives one row with an error.
    """
    names = ["path", "scheme", "term", "place", "value", "error"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def found(path: str, raw: bytes) -> Iterator[tuple]:
        if re.search(rb"<!DOCTYPE|<!ENTITY", raw[:4096]):
            raise ET.ParseError("document types are not read")
        for i, e in enumerate(ET.fromstring(raw).iter()):
            space, _, term = e.tag[1:].partition("}") if e.tag[:1] == "{" else ("", "", e.tag)
            scheme = SCHEMES.get(space)
            if scheme and (e.text or "").strip():
                yield path, scheme, term, i, e.text.strip(), None
            if scheme == "mets" and term in ("file", "FLocat"):
                for k, v in sorted(e.attrib.items()):
                    yield path, scheme, f"{term}@{k.rpartition('}')[2]}", i, v, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += found(path, raw or b"")
                except (ET.ParseError, ValueError) as e:
                    rows.append((path, None, None, 0, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "path string, scheme string, term string, place int, value string, error string")
