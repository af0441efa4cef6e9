"""Review quality flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale import rules
from chorale.functions.text import lower_perplexity


def is_injection(text: Column, phrases: list[str] = rules.INJECTION_PHRASES) -> Column:
    return text.rlike("(?iu)" + "|".join(phrases))


def is_low_information(text: Column, words: Column) -> Column:
    return (F.size(words) < rules.MIN_WORDS) | (F.length(text) < rules.MIN_CHARS)


def is_spam(text: Column, lower_words: Column) -> Column:
    """``lower_words`` are the words of the lowered text, computed once by the caller."""
    lowered = F.lower(text)
    count = F.size(lower_words)
    unique_ratio = F.size(F.array_distinct(lower_words)) / F.greatest(F.lit(1), count)
    return (
        (F.regexp_count(lowered, F.lit("http")) > rules.MAX_LINKS)
        | lowered.rlike(rules.REPEATED_CHAR)
        | ((count >= 6) & (unique_ratio < rules.SPAM_UNIQUE_RATIO))
        | F.coalesce(lower_perplexity(F.when(count >= 8, lowered)) < rules.SPAM_PERPLEXITY, F.lit(False))
    )


def flag_array(conditions: dict[str, Column]) -> Column:
    """The names whose condition holds, in the fixed flag order."""
    return F.array_compact(
        F.array(*[F.when(conditions[name], name) for name in rules.FLAG_ORDER])
    )
