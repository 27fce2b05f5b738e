"""The batch operators over streams of files: same functions, stateless where they can be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.findings import to_findings
from ..operators.html import extract_signals
from ..operators.rules import evaluate_rules
from ..operators.vitals import stream_windows


def stream_snapshots(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def page_context(snapshots: DataFrame) -> DataFrame:
    """Snapshot rows with signals, parsed JSON-LD and empty vitals; batch and streaming."""
    from pyspark.sql import functions as F

    s = snapshots.withColumn("rendered_html", F.coalesce("rendered_html", "html"))
    c = extract_signals(s, {"html": "raw", "rendered_html": "rendered"}, {"rendered": "jsonld"})
    return c.select("*", *[F.lit(None).cast("double").alias(v) for v in ("lcp_ms", "cls_unitless", "tbt_ms")])


def stream_findings(snapshots: DataFrame, rules=None) -> DataFrame:
    """Findings of a stream of snapshot rows (with fetched_at); no state."""
    from pyspark.sql import functions as F

    times = snapshots.columns
    c = page_context(snapshots)
    found = to_findings(evaluate_rules(c, rules))
    return found.withColumn("seen_at", F.current_timestamp()) if "fetched_at" not in times else found


def alerts_once(findings: DataFrame, delay: str = "1 day", time: str = "fetched_at") -> DataFrame:
    """One row for each finding key within the watermark; later rows of a key are dropped.

    A row is late by the watermark that the batch before worked with, so what is behind is dropped one batch later.
    """
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark(["finding_key"])


def stream_alerts(findings: DataFrame, baseline: DataFrame, delay: str = "1 day", time: str = "fetched_at") -> DataFrame:
    """Keys that the baseline lacks, each once: a stream joined with a static table."""
    return alerts_once(findings, delay, time).join(baseline.select("finding_key").distinct(), "finding_key", "left_anti")


def stream_vitals(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    return stream_windows(events.withWatermark("ts", delay), width, slide)


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs the stream to the end of what is there; each micro-batch is the folder of its number.

    A batch that is run again after a failure replaces its folder, so a row is stored once however often the job starts.
    """

    def store(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch:012d}")

    q = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """What `write_once` has stored, with the batch of each row."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)
