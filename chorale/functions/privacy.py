"""Masking of personal data with built-in regex expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale import rules
from chorale.functions.text import language_chunks, let, sentences


def found(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs; texts without the character that each match holds are passed over."""
    needed = rules.NEEDED.get(pattern)
    return text.rlike(pattern) if needed is None else text.contains(needed) & text.rlike(pattern)


def has_residual(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [found(text, p) for p in rules.RESIDUAL])


def masked(text: Column, masks: list[tuple[str, str]] = rules.MASKS) -> Column:
    """Struct (text, hits) after all masks, as one expression usable inside a lambda."""

    def step(state: Column, rest: list[tuple[str, str]]) -> Column:
        if not rest:
            return state
        pattern, replacement = rest[0]
        following = F.struct(
            F.regexp_replace(state["text"], pattern, replacement).alias("text"),
            (state["hits"] + F.regexp_count(state["text"], F.lit(pattern))).alias("hits"),
        )
        return let(following, lambda s: step(s, rest[1:]))

    return let(F.struct(text.alias("text"), F.lit(0).alias("hits")), lambda s: step(s, masks))


def with_masked(
    df: DataFrame, text: str, masks: list[tuple[str, str]] = rules.MASKS
) -> DataFrame:
    """Add ``masked`` and ``pii_hits``; projections of their own keep each regex in codegen.

    Most texts hold no match of a mask; only those that do are counted and replaced.
    """
    out = df.withColumn("masked", F.col(text)).withColumn("pii_hits", F.lit(0))
    for pattern, replacement in masks:
        out = out.withColumn("_found", found(F.col("masked"), pattern))
        hits = F.when(F.col("_found"), F.regexp_count("masked", F.lit(pattern))).otherwise(0)
        changed = F.when(F.col("_found"), F.regexp_replace("masked", pattern, replacement)).otherwise(F.col("masked"))
        out = out.withColumns({"pii_hits": F.col("pii_hits") + hits, "masked": changed}).drop("_found")
    return out


def masked_by_chunk(text: Column) -> Column:
    """Struct (text, hits, chunks): sentence by sentence for mixed-language text."""

    def whole(parts: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
            F.aggregate(parts, F.lit(0), lambda n, p: n + p["hits"]).alias("hits"),
        )

    def piece(part: Column) -> Column:
        clean = F.struct(part.alias("text"), F.lit(0).alias("hits"))
        return F.when(part.rlike(rules.MASKABLE), masked(part)).otherwise(clean)

    chunks = F.transform(language_chunks(text), lambda c: c.dropFields("text"))
    return let(F.transform(sentences(text), piece), whole).withField("chunks", chunks)


REVIEW = ("session_id", "review_id")


def with_spans_masked(
    reviews: DataFrame, spans: DataFrame, models: list[str], keys: tuple[str, ...] = REVIEW
) -> DataFrame:
    """Replace externally found person spans, model after model, right to left.

    ``reviews`` needs the keys and ``masked``; ``spans`` has the keys and ``model, start, end, label,
    text`` with positions in the text that the earlier model left. Adds ``span_hits``. A review_id is
    unique in its session only.
    """
    usable = spans.where(
        F.col("label").isin(rules.PERSON_LABELS)
        & (F.length(F.trim("text")) >= 3)
        & ~F.col("text").rlike(r"\p{Nd}")
        & ~(F.trim("text").startswith("[") & F.trim("text").endswith("]"))
    )
    out = reviews.withColumn("span_hits", F.lit(0))
    for model in models:
        ordered = (
            usable.where(F.col("model") == model)
            .groupBy(*keys)
            .agg(F.collect_list(F.struct(-F.col("start"), "start", "end")).alias("_spans"))
        )
        start = F.struct(
            F.col("masked").alias("text"),
            F.lit(0).alias("hits"),
            (F.length("masked") + 1).cast("int").alias("limit"),
        )

        def replace(state: Column, span: Column) -> Column:
            begin, end = span["start"].cast("int"), span["end"].cast("int")
            changed = F.struct(
                F.concat(
                    F.substr(state["text"], F.lit(1), begin),
                    F.lit("[PERSON]"),
                    F.substr(state["text"], end + 1),
                ).alias("text"),
                (state["hits"] + 1).alias("hits"),
                begin.alias("limit"),
            )
            return F.when(end > state["limit"], state).otherwise(changed)

        spans_desc = F.array_sort(F.coalesce("_spans", F.array().cast(ordered.schema["_spans"].dataType)))
        out = (
            out.join(ordered, list(keys), "left")
            .withColumn("_state", F.aggregate(spans_desc, start, replace))
            .withColumn("masked", F.col("_state.text"))
            .withColumn("span_hits", F.col("span_hits") + F.col("_state.hits"))
            .drop("_spans", "_state")
        )
    return out


def with_person_pipeline(reviews: DataFrame, spans: DataFrame, keys: tuple[str, ...] = REVIEW) -> DataFrame:
    """Regex-masked reviews plus the span models of their language: ru, en, or en then ru."""
    reads = F.col("language").isin("ru", "en", "mixed")
    wanted = spans.join(reviews.select(*keys, "language"), list(keys)).where(
        F.col("language").isin("mixed") | (F.col("model") == F.col("language"))
    )
    out = with_spans_masked(reviews, wanted.drop("language"), ["en", "ru"], keys)
    return out.withColumn("pii_hits", F.col("pii_hits") + F.col("span_hits")).withColumn(
        "pii_backend", F.when(reads, "regex+spacy").otherwise("regex")
    )
