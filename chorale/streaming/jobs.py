"""Structured Streaming jobs.

Every sink may see a batch twice after a crash; writes are keyed by upload or batch and replace
what an earlier attempt left, so a restart ends in the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chorale.operators import gates, trends
from chorale.operators.metrics import latency_histogram
from chorale.plans import prepare
from chorale.session import settled
from chorale.sources import store
from chorale.sources.writers import read_table

WEEK, MONDAY = "7 days", "4 days"  # windows start on Thursday 1970-01-01; four days make it Monday


def _start(writer, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.start() if continuous else writer.trigger(availableNow=True).start()


def file_stream(
    spark: SparkSession, folder: str, schema, fmt: str = "parquet", per_batch: int | None = None, bytes_per_batch: int = 1 << 30, **options: str
) -> DataFrame:
    """Files of a folder, oldest first: batches of bounded size, or of ``per_batch`` files where that is given."""
    reader = spark.readStream.format(fmt).schema(schema)
    reader = reader.option("maxBytesPerTrigger", bytes_per_batch) if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)
    return reader.options(**options).load(folder)


def ingest(uploads: DataFrame, run_ts: Column, out: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Prepare arriving uploads; a batch that is run again replaces what it left, as it holds the same files.

    ``uploads``: the raw columns of ``prepare.parsed``. A session may come in many uploads and batches, so
    copies and gates are judged over all of them on read (:func:`ingested`), and folders grow with batches, not
    with sessions. A row without its required fields is stored as a refusal; its session fails from then on.
    """
    def write(batch: DataFrame, number: int) -> None:
        valid, invalid = gates.split_required(batch)
        rows = prepare.parsed(valid, run_ts)
        tagged = rows.withColumn("upload", F.sha2(F.col("metadata.ingested_from"), 256))
        tagged.write.mode("overwrite").parquet(f"{out}/batch={number}")
        refused = invalid.select("session_id", "raw_index", "ingested_from", "code", "message")
        refused.write.mode("overwrite").parquet(f"{out}-refused/batch={number}")
        if after is not None:
            after(number)

    return _start(uploads.writeStream.foreachBatch(write), checkpoint)


def ingested(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept reviews, summary per session, failures) of all uploads so far, as ``prepare.prepare`` gives them for one batch."""
    refused = read_table(spark, f"{out}-refused").drop("batch")
    rows = read_table(spark, out).drop("batch", "upload").join(refused, "session_id", "left_anti")
    return prepare.gated(rows, refused)


def deduplicated(rows: DataFrame, event_time: str, delay: str, keys: list[str]) -> DataFrame:
    """First arrival per key; state older than the watermark is dropped."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def weekly_counts(events: DataFrame, keys: list[str], event_time: str, delay: str = "7 days") -> DataFrame:
    """Rows per key and Monday-based week.

    State holds the weeks that still may get rows: a week's count is dropped from it once the newest row is
    ``delay`` past the week's end, and rows of that week that come in later batches are not counted.
    """
    watermarked = events.withWatermark(event_time, delay)
    counted = watermarked.groupBy(F.window(event_time, WEEK, WEEK, MONDAY), *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("window.start").alias("week_start"), "n")


def _keep(batch: DataFrame, number: int, out: str, part: str, keys: list[str]) -> None:
    """The batch's rows as the newest of their keys; a batch that is run again leaves the same table."""
    store.commit(out, {part: batch.withColumn("batch", F.lit(number).cast("bigint"))}, keys, order="batch")


def keep_current(counts: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row per key. A batch sends changed rows only; tables that later ones replace are removed."""
    def write(batch: DataFrame, number: int) -> None:
        _keep(batch, number, out, "rows", keys)
        store.drop_superseded(batch.sparkSession, out)

    return _start(counts.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def current(spark: SparkSession, out: str, part: str = "rows") -> DataFrame:
    """The newest row per key so far."""
    rows = store.read(spark, out, part)
    return rows.drop("batch")


def spike_alerts(weekly: DataFrame, keys: list[str], out: str, checkpoint: str, **rule) -> StreamingQuery:
    """Alerts of all keys so far (``current(spark, out + "/alerts")``), judged again for the keys a batch changes.

    The stream's state holds open weeks; closed ones are rows of the stored weekly table (``out + "/weekly"``), of
    which a batch reads the buckets of its keys. A key whose alert no longer holds loses it.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = settled(batch, "weeks")
        _keep(changed, number, f"{out}/weekly", "rows", [*keys, "week_start"])
        names = changed.select(*keys).distinct()
        same = reduce(Column.__and__, [F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
        weeks = current(spark, f"{out}/weekly").alias("w").join(names.alias("c"), same, "left_semi")
        found = trends.spike_alerts(trends.history(weeks, keys, "week_start"), name=keys[0], **rule)
        store.commit(f"{out}/alerts", {"rows": found.withColumn("batch", F.lit(number).cast("bigint"))}, keys, cleared={"rows": names})
        for name in ("weekly", "alerts"):
            store.drop_superseded(spark, f"{out}/{name}")

    return _start(weekly.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def event_log(events: DataFrame, out: str, checkpoint: str, by: str) -> StreamingQuery:
    """Append events with their correlation id; the file sink commits each batch once."""
    return _start(events.writeStream.format("parquet").outputMode("append").partitionBy(by).option("path", out), checkpoint)


def metrics(events: DataFrame, labels: list[str], value: str, edges: list[float], out: str, checkpoint: str) -> StreamingQuery:
    """Running latency buckets (read with :func:`current`): each batch replaces the label sets that changed."""
    return keep_current(latency_histogram(events, labels, value, edges), [*labels, "le"], out, checkpoint)
