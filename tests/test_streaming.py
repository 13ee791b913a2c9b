from arkivel import streaming
from arkivel.functions import vocab as V


def test_ingest_stream(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([("R1", "One"), ("R2", "Two")], "recordno string, title string").write.parquet(src)
    rows = spark.readStream.schema("recordno string, title string").parquet(src)
    streaming.ingest_stream(rows, "b", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    made = spark.read.parquet(f"file://{tmp_path}/out")
    assert made.where(made.p == V.TITLE).count() == 2
