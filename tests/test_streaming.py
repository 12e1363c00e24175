from pyspark.sql import functions as F

from loomspark.streaming import events


def test_closed_windows_equal_the_batch_counts(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    src.withColumn("ts", F.col("ts").cast("timestamp")).repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    events.write_available(events.slot_counts(events.read_events(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r["inicio"], r["event_type"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = events.slot_counts(spark.read.parquet(f"{tmp_path}/in"))
    want = {(r["inicio"], r["event_type"]): r["n"] for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > 0.9 * len(want)
