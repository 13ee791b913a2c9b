"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of WINDOW lines decides, by its content alone, whether a chunk ends after a line. So
chunks of a repeated passage are found again wherever it stands, whatever stands around it. Several such chunkings, with
rolling hashes of their own, cut a passage at other lines, and so reach more of its edges. Chunks of two or more lines
that occur more than once are removed but for their first place, after a comparison of their bytes with those of that
place; a line goes if a removed chunk of any chunking has it. The first place of a line stays: whatever removes a line
has its like at a smaller place. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW, MEAN, LEAST = 2, 4, 2
#: What goes before the line hashes in the rolling hash of each chunking.
SALTS = ("", "b", "c")


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.md5(x.cast("binary")))


def _ends_after(hashes: Column, i: Column, window: int, mean: int, salt: str) -> Column:
    rolled = F.md5(F.concat(F.lit(salt), F.array_join(F.slice(hashes, F.greatest(i + 2 - window, F.lit(1)), F.least(F.lit(window), i + 1)), "")).cast("binary"))
    return F.conv(F.substring(rolled, 1, 4), 16, 10).cast("int") % mean == 0


def chunk_spans(hashes: Column, window: int = WINDOW, mean: int = MEAN, salt: str = "") -> Column:
    """array<struct<start, length>> of the chunks of a text, from its line hashes."""
    n = F.size(hashes)
    inner = F.filter(F.sequence(F.lit(0), n - 2), lambda i: _ends_after(hashes, i, window, mean, salt))
    starts = F.when(n < 2, F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), F.transform(inner, lambda i: i + 1)))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length")))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines but for those of the numbers gone."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def _row_name() -> Column:
    """128 bits that tell rows apart by doc_id and text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), "text").cast("binary")))


def repeated_chunks(docs: DataFrame, window: int = WINDOW, mean: int = MEAN, least: int = LEAST) -> DataFrame:
    """(doc_id, row_key, spans) of the rows that lose chunks; row_key tells texts of one doc_id apart."""
    rows = docs.select("doc_id", _row_name().alias("row_key"), "text").where("text is not null")
    hashed = rows.select("doc_id", "row_key", line_hashes(F.col("text")).alias("hashes"))
    every = F.array_union(*[chunk_spans(F.col("hashes"), window, mean, s) for s in SALTS[:2]])
    for salt in SALTS[2:]:
        every = F.array_union(every, chunk_spans(F.col("hashes"), window, mean, salt))
    spans = hashed.select("doc_id", "row_key", "hashes", F.explode(F.filter(every, lambda c: c["length"] >= least)).alias("c"))
    digest = F.unhex(F.md5(F.array_join(F.slice("hashes", F.col("c.start") + 1, F.col("c.length")), "").cast("binary")))
    keys = materialize(spans.select("doc_id", "row_key", F.col("c.start").alias("start"), F.col("c.length").alias("length"), digest.alias("digest")), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("row_key"), F.col("start"))
    first = keys.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = materialize(first, "repeated")
    again = keys.join(first, "digest").withColumn("is_first", place == F.col("first"))
    wanted = again.groupBy("row_key").agg(F.collect_list(F.struct("start", "length", "digest", "is_first")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    lines = F.split("text", "\n", -1)
    found = rows.join(wanted.hint("merge"), "row_key").select("doc_id", "row_key", lines.alias("lines"), F.explode("wanted").alias("w"))
    found = found.select("doc_id", "row_key", "w.*", F.array_join(F.slice("lines", F.col("w.start") + 1, F.col("w.length")), "\n").alias("body"))
    found = materialize(found, "bodies")
    source = found.where("is_first").select("digest", F.col("body").alias("first_body")).dropDuplicates(["digest"])
    source = materialize(source, "firsts")
    gone = found.where("not is_first").join(source, "digest").where("body = first_body")
    return gone.groupBy("row_key").agg(F.collect_set(F.struct("start", "length")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, mean: int = MEAN, least: int = LEAST) -> DataFrame:
    """docs with the columns text, chunks_removed, lines_removed and lines_before set; all other columns stay.

    A text's first place is the one of the smallest (doc_id, row, line), a null doc_id last. A null text stays null,
    with no lines; an empty text is one empty line. Rows that are alike in doc_id and text are one place and keep or
    lose the same chunks. An empty table gives no rows.
    """
    spans = materialize(repeated_chunks(docs, window, mean, least), "spans").withColumnsRenamed({"row_key": "__key", "spans": "__spans"})
    keyed = docs.withColumn("__row", _row_name())
    out = keyed.join(spans.hint("merge"), F.col("__row") == F.col("__key"), "left")
    none = F.col("__spans").isNull() | F.col("text").isNull()
    lines = F.split("text", "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform("__spans", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1))))
    return out.select(
        *[c for c in docs.columns if c not in ("text", "chunks_removed", "lines_removed", "lines_before")],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("lines_before"),
        F.when(none, 0).otherwise(F.size("__spans")).cast("long").alias("chunks_removed"),
        F.when(none, 0).otherwise(F.size(gone)).cast("long").alias("lines_removed"),
        F.when(none, F.col("text")).otherwise(_kept(lines, gone)).alias("text"),
    )


#: The same in SQL over `documents` (doc_ids there are distinct and not null).
ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, md5(line) AS h, lag(md5(line)) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l),
e AS (SELECT h.*, salt, ('0x' || substr(md5(salt || coalesce(p, '') || h), 1, 4))::INT % {MEAN} = 0 AS ends
      FROM h, unnest([{", ".join(f"'{s}'" for s in SALTS)}]) AS t(salt)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, salt ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
g AS (SELECT doc_id, salt, chunk, min(i) AS s, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY ALL),
u AS (SELECT DISTINCT doc_id, s, n, body FROM g WHERE n >= {LEAST}),
r AS (SELECT *, row_number() OVER (PARTITION BY body, n ORDER BY doc_id, s) > 1 AS gone FROM u),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + n - 1)) AS i FROM r WHERE gone),
k AS (SELECT l.doc_id, count(*) AS lines, count(x.i) AS lines_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL) AS body
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS chunks_removed FROM r WHERE gone GROUP BY doc_id)
SELECT d.doc_id,
       coalesce(k.lines, 0)::BIGINT AS n_lines, coalesce(k.lines_removed, 0)::BIGINT AS lines_removed,
       coalesce(n.chunks_removed, 0)::BIGINT AS chunks_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.body, '')) END AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
