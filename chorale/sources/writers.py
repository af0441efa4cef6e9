"""Writes that may be repeated: a retried or restarted job leaves the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale import schemas
from chorale.operators.ranking import latest
from chorale.sources import store


#: Key of the tables that follow sessions.
SESSION = ["session_id"]


def write_sanitized(reviews: DataFrame, path: str) -> None:
    """One JSON row per kept review; a session that comes again replaces its rows."""
    store.commit(path, {"rows": reviews}, SESSION, fmt="json")


def replace_sessions(rows: DataFrame, path: str, cleared: DataFrame | None = None) -> None:
    """Replace all rows of the sessions that occur, or that ``cleared`` names; other sessions stay."""
    store.commit(path, {"rows": rows}, SESSION, cleared=None if cleared is None else {"rows": cleared})


def read_sessions(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """Rows of all sessions, or of one, for which only its bucket is read."""
    return store.read(spark, path, **({} if session_id is None else {"session_id": session_id}))


def append_log(rows: DataFrame, path: str, by: str, batch: str) -> None:
    """Append events, turns, or state changes; ``by`` is a low-cardinality partition column.

    A repeated ``batch`` replaces what its earlier attempt left.
    """
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch={batch}")


def append_trace(rows: DataFrame, path: str, batch: str) -> None:
    """JSON-lines copy of the event log, repeatable by batch."""
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")


#: Partition columns that are text; left alone, the reader takes '001' and '1' for the same number.
TEXT_KEYS = ("session_id", "kind", "upload", "batch", "stage", "job_id")


def read_table(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """A stored table. ``merge`` reads every footer, for tables whose columns changed over time."""
    reader = spark.read.option("mergeSchema", merge)
    found, stored = reader.parquet(path).schema, reader.option("recursiveFileLookup", True).parquet(path).columns
    text = {f.name for f in found if f.name in TEXT_KEYS and f.name not in stored}
    fields = [T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keyed upsert, last version wins."""
    return latest(current.unionByName(changes, allowMissingColumns=True), keys, version)


def current_state(changes: DataFrame, key: str, kept: list[str], raw: list[str]) -> DataFrame:
    """Current row per key from appended state changes ordered by ``id``.

    ``kept`` fields keep their last given value, ``raw`` fields take the last one as it is.
    ``max_by`` aggregates on the map side, so a key with many changes is no hot task.
    """
    aggregates = [
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col("id"))).alias(name) for name in kept
    ] + [F.max_by(name, "id").alias(name) for name in raw]
    return changes.groupBy(key).agg(*aggregates, F.max("id").alias("id"))


def upsert_vectors(vectors: DataFrame, path: str) -> None:
    """Store the newest version of each item; an item that comes again with an older one stays as it is."""
    store.commit(path, {"rows": vectors}, ["session_id", "kind", "item_id"], order="version")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path)


def save_index(parts: dict[str, DataFrame], path: str) -> None:
    """Store the parts of a search index as one version, replacing the sessions each of them holds."""
    store.commit(path, parts, SESSION)


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The stored parts, with defaults for columns an older version did not write."""
    parts = {}
    for name in names:
        try:
            part = store.read(spark, path, name)
        except FileNotFoundError as error:
            raise FileNotFoundError(f"INDEX_NOT_FOUND: {path}/{name}") from error
        for column, default in schemas.INDEX_DEFAULTS.items():
            value = F.col(column) if column in part.columns else F.lit(None).cast("string")
            part = part.withColumn(column, F.coalesce(value, F.lit(default)))
        parts[name] = part
    return parts


def write_reports(reports: DataFrame, path: str) -> None:
    """One row per session with the markdown text and its metadata."""
    replace_sessions(reports, path)
