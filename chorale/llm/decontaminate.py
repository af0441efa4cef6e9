"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

A window is ten consecutive words of a benchmark item, or a whole shorter item. A document that holds
a window holds each of its words, so the rarest word is a sufficient prefix of the window:

1. Words of the benchmark are counted over all documents; each window keeps its rarest word and that
   word's place in it. A window whose rarest word occurs in no document is done.
2. Documents' words meet the prefix words. A meeting fixes where the window would have to start;
   starts before the first word or past the last full window are dropped (positional and length
   bounds). Only these few rows are shuffled.
3. Candidates are gathered by document and checked exactly: the slice of the document's words must
   equal the window's words.

The word lists of the benchmark are broadcast only while they have at most ``broadcast_rows`` rows,
which is counted first; beyond it the joins shuffle. The search folds case with ``lower`` (a superset
of the exact rule, since both sides are folded alike), the check lower-cases A-Z alone.

Defined results: null text, empty text and text without words have no words and are not contaminated.
Items without words have no windows. Windows of items without id hit words like any other and are in no list
of items. Items with equal ids count once. Rows of
``docs`` keep their number; repeated rows get equal results, a null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.registry import LOWER, UPPER, query, table
from chorale.session import settled

WINDOW = 10
BROADCAST_ROWS = 200_000
#: Fixed value: what separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _folded(text: Column) -> Column:
    """A coarser case folding, quick in the JVM; final and inner sigma are one."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _exact(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def _lead(parts: Column) -> Column:
    return F.when(parts[0] == "", 1).otherwise(0)


def _count(parts: Column) -> Column:
    """Words of a split text: its first and last part may be empty."""
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.size(parts) - _lead(parts) - last


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, exact, folded): the distinct windows of the items; both lists have the same length."""
    items = benchmark.where("text IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item"), _words(_exact(F.col("text"))).alias("e"), _words(_folded(F.col("text"))).alias("f")
    ).where(F.size("e") > 0)
    size = F.least(F.size("e"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("e") - size + 1)
    return items.select("item", "e", "f", size.alias("n"), F.explode(starts).alias("s")).select(
        "item", F.slice("e", F.col("s"), F.col("n")).alias("exact"), F.slice("f", F.col("s"), F.col("n")).alias("folded")
    ).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, n_words, n_hit, items): every row of ``docs`` as a struct, its words, words hit and sorted items found."""

    def small(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if frame.count() <= broadcast_rows else frame

    windows = settled(item_windows(benchmark, window), "benchmark-windows")
    text = F.coalesce(F.col("text"), F.lit(""))
    # the list may begin and end with an empty string; positions are counted from the first word
    parts = F.split(_folded(text), SEPARATORS)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select(F.struct("*").alias("row"), key.alias("id"), F.xxhash64("text").alias("tag"), text.alias("text"), parts.alias("parts"))
    vocabulary = settled(windows.select(F.explode("folded").alias("word")).distinct(), "benchmark-words")
    counts = docs.select(F.explode(parts).alias("word")).join(small(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = settled(counts, "benchmark-counts")
    rarest = Window.partitionBy("item", "exact").orderBy("n", "word", "place")
    prefixes = windows.select("item", "exact", F.posexplode("folded").alias("place", "word")).join(counts, "word", "left")
    prefixes = prefixes.select("item", "exact", "place", "word", F.coalesce("n", F.lit(0)).alias("n"))
    prefixes = prefixes.withColumn("rank", F.row_number().over(rarest)).where("rank = 1 AND n > 0").select("word", "place", "item", "exact")
    prefixes = settled(prefixes, "benchmark-prefixes")
    places = keyed.select(
        "id", "tag", _lead(F.col("parts")).alias("lead"), _count(F.col("parts")).alias("n_words"), F.posexplode("parts").alias("pos", "word")
    )
    found = places.join(small(prefixes), "word")
    start = F.col("pos") - F.col("lead") - F.col("place")
    found = found.withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.size("exact") <= F.col("n_words")))
    gathered = found.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "item", "exact")).alias("found"))
    counted = keyed.select("row", "id", "tag", "text", _count(F.col("parts")).alias("n_words"))
    joined = counted.join(gathered, ["id", "tag"], "left")

    def in_text(words: Column) -> Column:
        return F.filter("found", lambda c: F.slice(words, c["start"] + 1, F.size(c["exact"])) == c["exact"])

    # the words are bound to a lambda's variable: else the optimiser would split the text again for every candidate
    words = F.when(F.col("found").isNotNull(), _words(_exact(F.col("text"))))
    joined = joined.select("row", "n_words", F.transform(F.array(words), in_text)[0].alias("held"))
    hit = F.array_distinct(F.flatten(F.transform("held", lambda c: F.sequence(c["start"], c["start"] + F.size(c["exact"]) - 1))))
    named = F.filter(F.transform("held", lambda c: c["item"]), lambda i: i.isNotNull())
    return joined.select(
        "row", "n_words", F.coalesce(F.when(F.size("held") > 0, F.size(hit)), F.lit(0)).alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(named)), F.array().cast("array<string>")).alias("items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with the columns of ``docs``."""
    return hits(docs, benchmark, window).where("n_hit = 0").select("row.*")


SQL = f"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
    SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (
        SELECT item_id, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'),
            '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
        FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t
    FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM i)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT DISTINCT doc_id, s, n, CAST(item_id AS VARCHAR) AS item FROM dw JOIN iw USING (t, n)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item) AS n_items, list_sort(list_distinct(list(item))) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op8_decontamination", SQL)
def op8_decontamination(spark, sf_dir):
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
