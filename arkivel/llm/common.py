"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files are removed at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and Spark runs in one local process, as in tests, a new local folder is taken.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            at = "file://" + tempfile.mkdtemp(prefix="arkivel-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks of one step, never earlier steps. The shuffle files of the
    step go as soon as it is written; without SHUFFLES_GO they would stay until the driver's heap is collected.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/arkivel-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; results that are still to be computed must not go back to them.

    Spark removes the shuffle files of a step when the driver's heap has forgotten its plan; collecting the heap here
    lets those of written steps go as well, rather than whenever the heap happens to fill up.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; no other character changes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit(*parts: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the given values alone."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    whole = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])), 1, 13), 16, 10)
    return (whole.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
