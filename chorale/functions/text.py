"""Text expressions: every function maps Columns to a Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blocks in which NFKC changes nothing and nothing combines; all other text is folded.
NFKC_STABLE = (
    r"\x00-\x9F¡-§©«-®°±¶·»¿-ı"
    r"Ĵ-ľŁ-ňŊ-žЀ-҂Ҋ-ԯ"
    r"–—‘-„"
)
SPACES = r"(?U)[\s\x1C-\x1F]+"
# Runs of blanks other than a single space, which is what they become.
UNEVEN = r"(?U) [\s\x1C-\x1F]+|[\s\x1C-\x1F&&[^ ]][\s\x1C-\x1F]*"
# The code points of SPACES.
SPACE_CODES = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
NOT_WORD = r"[^\p{L}\p{N}_]+"
TOKEN = r"([A-Za-zА-Яа-я0-9]+)"
SENTENCE_END = r"(?<=[.!?;])\s+|\n+"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def pinned(value: Column) -> Column:
    """``value``, computed once a row where it stands.

    As the condition is not deterministic, Spark neither copies the expression into each of its uses nor pushes a filter
    on it below the projections it is made of, where all of them would be computed again.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def squeeze(text: Column) -> Column:
    """Zero-width space and whitespace runs become one space; ends are trimmed."""
    spaced = F.replace(F.coalesce(text, F.lit("")), F.lit("\u200b"), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, UNEVEN, " "))


def normalize(text: Column) -> Column:
    """NFKC, then :func:`squeeze`. Spark has no NFKC; only unstable rows reach Python."""
    # Anchored and possessive: ten times faster than searching for the first unstable character.
    unstable = ~text.rlike(rf"^[{NFKC_STABLE}]*+\z")
    folded = F.when(unstable, _nfkc(F.when(unstable, text))).otherwise(text)
    return squeeze(folded)


def slugify(text: Column) -> Column:
    parts = F.regexp_replace(F.lower(text), "[^a-zа-я0-9]+", "_")
    return F.coalesce(F.nullif(F.btrim(parts, F.lit("_")), F.lit("")), F.lit("cluster"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, NOT_WORD), "")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def trim_words(text: Column, limit: int) -> Column:
    parts = F.split(squeeze(text), " ")
    cut = F.concat(F.array_join(F.slice(parts, 1, limit), " "), F.lit("..."))
    return F.when(F.size(parts) > limit, cut).otherwise(F.trim(text))


def language(text: Column) -> Column:
    """``ru``, ``en``, ``mixed`` or ``unknown`` by the letters that occur, in either case."""
    # the lower forms of U+0130 and U+212A hold i and k
    cyrillic, latin = text.rlike("[а-яёА-ЯЁ]"), text.rlike("[a-zA-Z\u0130\u212A]")
    return (
        F.when(cyrillic & latin, "mixed").when(cyrillic, "ru").when(latin, "en")
        .otherwise("unknown")
    )


def sentences(text: Column) -> Column:
    """Non-blank parts after sentence ends and line breaks, trimmed."""
    parts = F.transform(F.split(text, SENTENCE_END), lambda p: F.trim(p))
    return F.filter(parts, lambda p: squeeze(p) != "")


def language_chunks(text: Column) -> Column:
    """One struct (text, language, char_count, token_count) per sentence."""
    return F.transform(
        sentences(text),
        lambda part: F.struct(
            part.alias("text"),
            language(part).alias("language"),
            F.length(part).alias("char_count"),
            F.size(words(part)).alias("token_count"),
        ),
    )


def _entropy_power(text: str) -> float:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if not len(codes):
        return 1.0
    if codes.max() < 1 << 16:
        counts = np.bincount(codes, minlength=SPACE_CODES[-1] + 1)
        counts[SPACE_CODES] = 0
        counts = counts[counts > 0]
    else:
        counts = np.unique(codes[~np.isin(codes, SPACE_CODES)], return_counts=True)[1]
    size = counts.sum()
    return 1.0 if size < 8 else 2.0 ** (np.log2(size) - (counts * np.log2(counts)).sum() / size)


@F.pandas_udf(T.DoubleType())
def _perplexity(text: pd.Series) -> pd.Series:
    return text.map(_entropy_power, na_action="ignore").astype("float64")


def lower_perplexity(lowered: Column) -> Column:
    """:func:`perplexity` of a text that is in lower case, in one pass of numpy over its code points."""
    return _perplexity(lowered)


def perplexity(text: Column) -> Column:
    """Two to the entropy of the non-space characters, 1.0 for fewer than eight of them.

    Character counts come from length differences, one pass per distinct character, so a long
    text is never exploded into one row per character.
    """

    def of(chars: Column) -> Column:
        def add(total: Column, char: Column) -> Column:
            return let(
                F.length(chars) - F.length(F.replace(chars, char, F.lit(""))),
                lambda n: total + F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0),
            )

        weighted = F.aggregate(F.array_distinct(F.split(chars, "")), F.lit(0.0), add)
        size = F.length(chars).cast("double")
        return F.when(size < 8, 1.0).otherwise(F.pow(F.lit(2.0), F.log2(size) - weighted / size))

    return let(F.lower(F.regexp_replace(text, SPACES, "")), of)


def first_json_object(text: Column) -> Column:
    """The JSON object held in free text as VARIANT: whole, fenced, or between outer braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)

    def parsed(candidate: Column) -> Column:
        trimmed = F.trim(candidate)
        return F.when(trimmed.startswith("{"), F.try_parse_json(trimmed))

    return F.coalesce(parsed(text), parsed(fenced), parsed(braces))
