"""Raw reviews to sanitized reviews.

``parsed`` is one narrow plan (no shuffle): everything a row needs is computed where the row is
read. ``kept`` adds the single shuffle of the workflow, the search for first copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale import rules, schemas
from chorale.functions import flags as flag_rules
from chorale.functions import privacy, text, values
from chorale.operators import gates
from chorale.operators.ranking import first_copies


def parsed(raw: DataFrame, run_ts: Column, text_limit: int | None = None) -> DataFrame:
    """Every input row normalized, masked, flagged and hashed.

    ``raw`` has session_id, raw_index, ingested_from and the raw fields as strings. The stored
    text is whole unless ``text_limit`` is given.
    """
    base = raw.withColumn("text_raw", text.pinned(text.normalize(F.col("text"))))
    given = F.lower(text.squeeze(F.col("language")))
    base = base.withColumn(
        "language", F.coalesce(F.nullif(given, F.lit("")), text.language(F.col("text_raw")))
    )
    mixed = F.col("language") == "mixed"
    # No mask reaches over a sentence end, so masking the whole text gives what masking a mixed
    # text sentence by sentence gives; only the chunk facts need the sentences.
    base = privacy.with_masked(base, "text_raw")
    base = base.withColumn("_words", text.words(F.lower("text_raw")))
    flagged = base.withColumn(
        "flags",
        text.pinned(flag_rules.flag_array({
            "injection_suspected": flag_rules.is_injection(F.col("text_raw")),
            "spam": flag_rules.is_spam(F.col("text_raw"), F.col("_words")),
            "low_information": flag_rules.is_low_information(F.col("text_raw"), F.col("_words")),
            "pii_found": F.col("pii_hits") > 0,
            "mixed_language": mixed,
        })),
    )
    stored = F.col("masked") if text_limit is None else F.left("masked", F.lit(text_limit))
    parts = F.transform(text.language_chunks(F.col("text_raw")), lambda c: c.dropFields("text"))
    chunks = F.when(mixed, parts).otherwise(F.array().cast(schemas.CHUNKS))
    return flagged.select(
        "session_id",
        text.squeeze(F.col("review_id")).alias("review_id"),
        values.source(F.col("source")).alias("source"),
        values.timestamp(F.col("created_at"), run_ts).alias("created_at"),
        values.rating(F.col("rating")).alias("rating"),
        "language",
        F.nullif(text.squeeze(F.col("app_version")), F.lit("")).alias("app_version"),
        stored.alias("text_normalized"),
        stored.alias("text_anonymized"),
        dedupe_hash(F.col("masked")).alias("dedupe_hash"),
        "flags",
        "pii_hits",
        privacy.has_residual(F.col("masked")).alias("residual"),
        "raw_index",
        F.struct(
            "raw_index",
            F.col("ingested_from"),
            F.lit("regex").alias("pii_backend_effective"),
            mixed.alias("mixed_language_processed"),
            chunks.alias("language_chunks"),
        ).alias("metadata"),
    )


def dedupe_hash(masked: Column) -> Column:
    """Hash of the whole masked text in lower case."""
    return F.sha2(text.squeeze(F.lower(masked)), 256)


def first_per_hash(rows: DataFrame) -> DataFrame:
    """First row per session and hash. Copies are found before any row is quarantined."""
    return first_copies(rows, ["session_id", "dedupe_hash"], "raw_index")


def summary(rows: DataFrame) -> DataFrame:
    """The counters of a batch per session, from ``parsed`` rows.

    Aggregated per hash first with map-side combine: a hash that covers a third of all rows
    leaves each task as one row.
    """
    flag = lambda name: F.array_contains("flags", name)
    injection, short = flag("injection_suspected"), flag("low_information")
    # The first row's three marks ride on its index, so the buffer stays one BIGINT.
    bits = F.when(F.col("residual"), 4).otherwise(0)
    bits = bits + F.when(injection, 2).otherwise(0) + F.when(short, 1).otherwise(0)
    per_hash = rows.groupBy("session_id", "dedupe_hash").agg(
        F.count("*").alias("n"),
        F.sum("pii_hits").alias("pii_hits"),
        F.count_if(injection).alias("injection"),
        F.count_if(short).alias("low_information"),
        F.count_if(F.col("language") == "unknown").alias("unknown"),
        (F.min(F.col("raw_index") * 8 + bits) % 8).alias("marks"),
    )
    marked = lambda bit: F.col("marks").bitwiseAND(bit) > 0
    kept = ~marked(4)
    return per_hash.groupBy("session_id").agg(
        F.sum("n").alias("total_records"),
        F.count_if(kept).alias("kept_records"),
        (F.sum("n") - F.count("*")).alias("duplicate_records"),
        F.count_if(~kept).alias("quarantined_records"),
        F.sum("pii_hits").alias("pii_hits"),
        F.sum("injection").alias("injection_hits"),
        F.sum("low_information").alias("low_information_records"),
        F.sum("unknown").alias("unsupported_language_records"),
        F.count_if(kept & marked(2)).alias("kept_injection"),
        F.count_if(kept & marked(1)).alias("kept_low_information"),
    )


def refreshed(counters: DataFrame) -> DataFrame:
    """The final summary: injection and low-information hits counted on kept rows."""
    return counters.withColumn("injection_hits", F.col("kept_injection")).withColumn(
        "low_information_records", F.col("kept_low_information")
    ).drop("kept_injection", "kept_low_information")


def sanitized(rows: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept reviews of the passing sessions, failed sessions with their code)."""
    first = first_per_hash(rows).where(~F.col("residual")).drop("residual")
    ratio = F.col("quarantined_records") / F.col("total_records")
    code = F.when(F.col("kept_records") == 0, "FAILED_INPUT").when(
        ratio > rules.MAX_QUARANTINE_RATIO, "PRIVACY_GATE_FAILED"
    )
    failed = counters.select("session_id", code.alias("code")).where(F.col("code").isNotNull())
    return first.join(failed, "session_id", "left_anti"), failed


def prepare(
    raw: DataFrame, run_ts: Column, text_limit: int | None = None, store: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept reviews, summary per session, failures) of a batch of uploads.

    Reviews and summary both read the parsed rows: give ``store``, a path, to write them there
    once instead of running the regexes twice.
    """
    valid, invalid = gates.split_required(raw)
    rows = parsed(valid.join(invalid, "session_id", "left_anti"), run_ts, text_limit)
    if store is not None:
        rows.write.mode("overwrite").parquet(store)
        rows = rows.sparkSession.read.parquet(store)
    return gated(rows, invalid)


def gated(rows: DataFrame, invalid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept reviews, summary per session, failures) of parsed rows, and of the rows refused before parsing."""
    counters = summary(rows)
    kept, failed = sanitized(rows, counters)
    broken = invalid.groupBy("session_id").agg(F.min_by("code", "raw_index").alias("code"))
    return kept, refreshed(counters), failed.unionByName(broken)


def duplicate_ids(reviews: DataFrame) -> DataFrame:
    """Review ids that occur more than once in a session: refused, not stored twice."""
    return reviews.groupBy("session_id", "review_id").agg(F.count("*").alias("n")).where("n > 1")
