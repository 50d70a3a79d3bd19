"""The debounced stream against the batch rule."""

from pyspark.sql import functions as F

from quirefold.operators import sessions
from quirefold.streaming import debounce


def test_last_value_of_each_burst(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00.000", 1, 1), ("a", "2024-01-01 00:00:00.300", 2, 2), ("a", "2024-01-01 00:00:05.000", 3, 3), ("b", "2024-01-01 00:00:00.100", 9, 4), ("a", "2024-01-01 01:00:00.000", 0, 5)]
    df = spark.createDataFrame(rows, "key string, ts string, value int, id int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = debounce.debounced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "ts", "value")
    query = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["key"], r["value"]) for r in spark.table("bursts").collect()}
    batch = {(r["key"], r["value"]) for r in sessions.debounced(df, "key", "ts", "value", "id").collect()}
    assert got <= batch
    assert {("a", 2), ("a", 3), ("b", 9)} <= got
