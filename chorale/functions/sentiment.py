"""Lexicon sentiment and the choice between lexicon and external scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale import rules


def lexical(
    tokens: Column,
    positive: list[str] = rules.POSITIVE_WORDS,
    negative: list[str] = rules.NEGATIVE_WORDS,
) -> Column:
    """Four times the balance of positive and negative tokens, clamped to -1..1."""
    good = F.size(F.filter(tokens, lambda t: t.isin(positive)))
    bad = F.size(F.filter(tokens, lambda t: t.isin(negative)))
    score = (good - bad).cast("double") / F.greatest(F.lit(1), F.size(tokens)) * 4.0
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def routed(lexical_score: Column, language: Column, external_score: Column, model: str) -> Column:
    """Struct (score, backend, model): Russian and unscored text stay lexical."""
    use_lexical = external_score.isNull() | (language == "ru")
    blend = (language == "mixed") & (lexical_score != 0)
    mean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (external_score + lexical_score) / 2.0))
    return F.struct(
        F.when(use_lexical, lexical_score).when(blend, mean).otherwise(external_score).alias("score"),
        F.when(use_lexical, "lexical").when(blend, "hybrid").otherwise("vader").alias("backend"),
        F.when(~use_lexical, model).alias("model"),
    )
