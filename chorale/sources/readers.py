"""Review files and stored tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chorale import rules, schemas

SUFFIXES = {"csv": "*.csv", "json": "*.json", "jsonl": "*.jsonl", "parquet": "*.parquet"}


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("ingested_from", F.col("_metadata.file_path"))


def read_csv(spark: SparkSession, path: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected files): quoted fields with line breaks, UTF-8 with or without BOM.

    Columns go by the names in the header of each file, in any order and number; the CSV source
    itself would go by position, with one header for all files. A file whose header lacks a
    required name is rejected. The widest line with a required name sets how many cells are read.
    """
    named = F.greatest(*[F.contains("value", F.lit(f)) for f in rules.REQUIRED_FIELDS])
    separators = F.length("value") - F.length(F.replace("value", F.lit(options.get("sep", ","))))
    widest = spark.read.options(**options).text(path).where(named).agg(F.max(separators)).first()[0]
    cells = [f"c{i}" for i in range((widest or 0) + 1)]
    raw = _with_file(
        spark.read.schema(", ".join(f"{c} string" for c in cells))
        .options(header=False, multiLine=True, quote='"', escape='"', **options).csv(path)
    )
    bare = F.regexp_replace("c0", '^\ufeff"?|"$', "")
    names = F.array(F.when(F.startswith("c0", F.lit("\ufeff")), bare).otherwise(F.col("c0")), *cells[1:])
    is_header = F.array_size(F.array_intersect(names, F.array(*[F.lit(f) for f in rules.REQUIRED_FIELDS]))) == len(rules.REQUIRED_FIELDS)
    headers = raw.where(is_header).groupBy("ingested_from").agg(F.first(names).alias("_names"))
    value = lambda f: F.get(F.array(*cells), (F.array_position("_names", f) - 1).cast("int"))
    known = lambda f: F.when(F.array_contains("_names", f), value(f))
    records = raw.where(~is_header).join(headers, "ingested_from").select(
        *[F.coalesce(known(f), F.lit("")).alias(f) for f in schemas.RAW_FIELDS], "ingested_from"
    )
    rejected = raw.select("ingested_from").distinct().join(headers, "ingested_from", "left_anti")
    return records, rejected.withColumn("code", F.lit("INPUT_SCHEMA_INVALID"))


def read_json(spark: SparkSession, path: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected files): a list of records or an object with a ``reviews`` list."""
    raw = _with_file(
        spark.read.schema(schemas.RAW_JSON).options(multiLine=True, **options).json(path)
    )
    wrapped = raw.where(F.col("reviews").isNotNull()).select(
        F.explode("reviews").alias("r"), "ingested_from"
    )
    top = raw.where(F.col("reviews").isNull())
    given = F.greatest(*[F.col(f).isNotNull() for f in schemas.RAW_FIELDS])
    records = top.where(given).select(*schemas.RAW_FIELDS, "ingested_from").unionByName(
        wrapped.select("r.*", "ingested_from")
    )
    rejected = top.where(~given).select("ingested_from").distinct()
    return records, rejected.withColumn("code", F.lit("INPUT_SCHEMA_INVALID"))


def read_json_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    raw = spark.read.schema(schemas.JSON_LINE).options(**options).json(path)
    return _with_file(raw).select(*schemas.RAW_FIELDS, "ingested_from")


def read_parquet(spark: SparkSession, path: str, **options: str) -> DataFrame:
    raw = spark.read.options(**options).parquet(path)
    present = [
        (F.col(f) if f in raw.columns else F.lit(None)).cast("string").alias(f)
        for f in schemas.RAW_FIELDS
    ]
    return _with_file(raw).select(*present, "ingested_from")


def read_feedback(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected files) of a folder tree, each file read by its suffix."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"))
    )
    known = listing.where(F.col("suffix").isin(list(SUFFIXES)))
    found = {row.suffix for row in known.select("suffix").distinct().collect()}
    frames, rejects = [], []
    for suffix in SUFFIXES:
        if suffix not in found:
            continue
        options = {"pathGlobFilter": SUFFIXES[suffix], "recursiveFileLookup": "true"}
        if suffix in ("csv", "json"):
            read = read_csv if suffix == "csv" else read_json
            records, rejected = read(spark, folder, **options)
            frames.append(records)
            rejects.append(rejected)
        elif suffix == "jsonl":
            frames.append(read_json_lines(spark, folder, **options))
        else:
            frames.append(read_parquet(spark, folder, **options))
    refused = listing.where(~F.col("suffix").isin(list(SUFFIXES))).select(
        F.col("path").alias("ingested_from"), F.lit("INPUT_SCHEMA_INVALID").alias("code")
    )
    for extra in rejects:
        refused = refused.unionByName(extra)
    if not frames:
        raise AnalysisException(f"INPUT_SCHEMA_INVALID: no review files under {folder}")
    records = frames[0]
    for extra in frames[1:]:
        records = records.unionByName(extra)
    return records, refused


def input_limits(
    raw: DataFrame,
    uploads: DataFrame,
    size: Column,
    max_rows: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Verdict per upload (session): empty, too many rows, too many bytes, or accepted.

    There is no quota unless one is given; ``rules`` holds the quotas of an interactive upload.
    """
    counted = raw.groupBy("session_id").agg(
        F.count("*").alias("total_records"), F.sum(size).alias("total_bytes")
    )
    joined = uploads.select("session_id").join(counted, "session_id", "left")
    rows = F.coalesce("total_records", F.lit(0))
    weight = F.coalesce("total_bytes", F.lit(0))
    over = F.lit(False)
    if max_rows is not None:
        over = over | (rows > max_rows)
    if max_bytes is not None:
        over = over | (weight > max_bytes)
    code = (
        F.when(rows == 0, "INPUT_SCHEMA_INVALID")
        .when(over, "INPUT_LIMIT_EXCEEDED")
        .otherwise("ACCEPTED")
    )
    return joined.select("session_id", rows.alias("total_records"), weight.alias("total_bytes"), code.alias("code"))


SCAN_ORDERS = {
    "reviews": [("created_at", True), ("review_id", True)],
    "clusters": [("priority_score", False), ("size", False), ("cluster_id", True)],
    # Severity sorts as text: medium, info, high.
    "alerts": [("created_at", False), ("severity", False)],
    "job_events": [("id", True)],
}


def session_scan(table: DataFrame, session_id: str, kind: str) -> DataFrame:
    """All rows of one session in the order of that table."""
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in SCAN_ORDERS[kind]]
    return table.where(F.col("session_id") == session_id).orderBy(*order)


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows for many keys at once."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def exists(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each asked key once, with a flag."""
    known = table.select(key).distinct().withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(known, key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def json_column(text: Column, schema: str, default: str) -> Column:
    """JSON text by schema; empty or null text gives the default."""
    filled = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))
    return F.from_json(filled, schema)


def iso_moment(text: Column) -> Column:
    """Stored ISO text as timestamp; text without an offset is UTC."""
    return F.to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")))
