"""Streams: batches stored once whatever happens to the job, and late rows."""

import os
import shutil

from pyspark.sql import functions as F

from pagewarden.streaming import streams


def test_a_restart_repeats_nothing(spark, tmp_path):
    spark.range(100).select("id", F.lit("x").alias("x")).repartition(20).write.parquet(f"{tmp_path}/in")
    run = lambda: streams.write_once(streams.stream_snapshots(spark, f"{tmp_path}/in", "id long, x string"), f"{tmp_path}/out", f"{tmp_path}/state")
    rows = lambda: sorted((r["id"], r["batch"]) for r in streams.stored(spark, f"{tmp_path}/out", "id long, x string").collect())
    run()
    first = rows()
    assert [i for i, _ in first] == list(range(100)) and {b for _, b in first} == {0, 1, 2}
    run()
    assert rows() == first
    # The job fell after a batch was stored and before that was noted: the batch is run again, into its own folder.
    for f in os.listdir(f"{tmp_path}/state/commits"):
        if f.strip(".").startswith("2"):
            os.remove(f"{tmp_path}/state/commits/{f}")
    run()
    assert rows() == first
    # Half of its files were lost with the failure.
    shutil.rmtree(f"{tmp_path}/out/batch={2:012d}")
    for f in os.listdir(f"{tmp_path}/state/commits"):
        if f.strip(".").startswith("2"):
            os.remove(f"{tmp_path}/state/commits/{f}")
    run()
    assert rows() == first
    spark.createDataFrame([(1000, "new")], "id long, x string").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert rows() == [*first, (1000, 3)]


def test_late_rows_and_repeated_keys(spark, tmp_path):
    day = 86400
    for rows in ([("a", 0), ("b", 10), ("a", 20)], [("c", 10 * day), ("a", 10 * day)], [("c", 10 * day + 1)], [("late", 100), ("c", 10 * day + 5), ("d", 9 * day + 100)], [("e", 20 * day)]):
        df = spark.createDataFrame(rows, "finding_key string, s long").select("finding_key", F.timestamp_seconds("s").alias("fetched_at"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("finding_key string, fetched_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.write_once(streams.alerts_once(stream, "1 day").select("finding_key"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = [r["finding_key"] for r in streams.stored(spark, f"{tmp_path}/out", "finding_key string").orderBy("batch").collect()]
    assert "late" not in got and sorted(set(got)) == ["a", "b", "c", "d", "e"] and got.count("c") == 1
