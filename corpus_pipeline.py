"""Toxicity, line dedup, near dedup, mixing to target weights and best-fit packing over the documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arkivel.llm.common import materialize, table


def _renewed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows a changed text."""
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels whose crc32(doc_id) mod 5 is not 0."""
    from arkivel.llm.toxicity import accepted, fit

    model = fit(docs, table(spark, sf_dir, "labels"), usable=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go but for their first place; documents stay, if with less text."""
    from arkivel.llm.line_dedup import without_repeats

    return _renewed(without_repeats(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id."""
    from arkivel.llm.near_dedup import near_duplicates

    kept = materialize(near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")), "kept")
    out = docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")
    if not kept.where("__n > 1 and __id is not null").isEmpty():  # rows that repeat doc_id and text are one document
        again = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
        out = out.withColumn("__again", again).where("__again = 1 or doc_id is null").drop("__again")
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    from arkivel.llm.mixing import mixed, word_count

    taken = materialize(mixed(docs).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("nth").alias("__nth"), F.col("copies").alias("__copies")), "taken")
    rows = docs.withColumn("__words", word_count(F.col("text")))
    if taken.where("__nth > 1").isEmpty():
        rows = rows.withColumn("__k", F.lit(1))
    else:
        rows = rows.withColumn("__k", F.row_number().over(W.partitionBy("doc_id", "source", "__words").orderBy(F.xxhash64("text"))))
    on = rows["doc_id"].eqNullSafe(taken["__id"]) & rows["source"].eqNullSafe(taken["__source"]) & (rows["__words"] == taken["__size"]) & (rows["__k"] == taken["__nth"])
    return rows.join(taken.hint("merge"), on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens; repeated documents have pieces of their own."""
    import public_tokenizers

    from arkivel.llm.packing import packed

    return packed(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("nth")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither a trained classifier nor a packing plan; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
