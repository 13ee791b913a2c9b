"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .line_dedup import ORACLE as LINE_DEDUP


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    fold = lambda c: F.crc32(F.col(c).cast("string")) % 5
    model = fit(docs, table(spark, sf_dir, "labels"), usable=fold("doc_id") != 0)
    return scored(docs, model).select("doc_id", (F.coalesce(fold("doc_id"), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import packed

    rows = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import without_repeats

    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("lines_before").alias("n_lines"), "lines_removed", "chunks_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compared_with_classes

    return compared_with_classes(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import PASSAGE, without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), with_bytes=False, passage=PASSAGE)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded, tree

    return sharded(table(spark, sf_dir, "documents"), tree(8), tree(9))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import scored

    return scored(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_toxicity, op3_best_fit_packing, op4_exact_dedup, op5_line_dedup, op6_mixing, op7_fingerprints, op8_suffix_dedup, op9_sharding, op10_lm_scoring)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_line_dedup": LINE_DEDUP,
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, text_sha256
        FROM d""",
}
