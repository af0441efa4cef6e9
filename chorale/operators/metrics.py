"""Roll-ups of run events: provider usage, counters, gauges, latency buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def provider_usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens, models in first-seen order and last status per provider.

    ``calls``: id, provider, model, kind (llm or embedding), status, prompt_tokens, input_tokens,
    completion_tokens, output_tokens, total_tokens.
    """
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit(0)) for n in names], F.lit(0))
    llm, emb = F.col("kind") == "llm", F.col("kind") == "embedding"
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown"))
    per_model = calls.groupBy(*by, model.alias("model")).agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.max_by("status", "id").alias("status"),
        F.count_if(llm).alias("llm_calls"), F.count_if(emb).alias("embedding_calls"),
        F.sum(F.when(llm, first("prompt_tokens", "input_tokens")).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(llm, first("completion_tokens", "output_tokens")).otherwise(0)).alias("completion_tokens"),
        F.sum(F.when(emb, first("prompt_tokens", "input_tokens", "total_tokens")).otherwise(0)).alias("embedding_tokens"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("first_id", "model")))
    return per_model.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("llm_calls", "embedding_calls", "prompt_tokens", "completion_tokens", "embedding_tokens")],
        F.transform(ordered, lambda m: m["model"]).alias("models"),
        F.max_by("status", "last_id").alias("last_status"),
    )


def counters(events: DataFrame, labels: list[str], gauge: str, order: str) -> DataFrame:
    """Event count and last gauge value per label set."""
    return events.groupBy(*labels).agg(F.count("*").alias("total"), F.max_by(gauge, order).alias("last_value"))


def latency_histogram(events: DataFrame, labels: list[str], value: str, edges: list[float]) -> DataFrame:
    """Cumulative bucket counts with sum and count, one row per label set and edge.

    Counted in one pass without multiplying rows: a conditional count per edge, unpivoted last.
    """
    counted = events.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= edge).alias(f"_{i}") for i, edge in enumerate(edges)],
        F.count("*").alias("count"),
        F.sum(F.col(value).cast("decimal(28,9)")).cast("double").alias("sum"),
    )
    buckets = [
        F.struct(F.lit(f"{edge:g}").alias("le"), F.col(f"_{i}").alias("n")) for i, edge in enumerate(edges)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n"))]
    return counted.select(*labels, "sum", "count", F.explode(F.array(*buckets)).alias("b")).select(
        *labels, "b.le", "b.n", "sum", "count"
    )


def context_tokens(texts: Column) -> Column:
    """Token estimate summed over an array of texts."""
    return F.aggregate(
        texts, F.lit(0), lambda n, t: n + F.greatest(F.lit(1), F.floor(F.length(t) / 4).cast("int"))
    )
