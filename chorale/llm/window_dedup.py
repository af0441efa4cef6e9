"""Substring deduplication: repeated word windows are found by Rabin-Karp hashes and cut out.

Every window of ``window`` words has a rolling hash. To count them all without shuffling one row a
word, windows are first grouped by a representative: the least hash among the shorter word runs
(``window // 2`` words) inside the window. Equal windows have equal representatives, and neighbouring
windows mostly share theirs, so about one row in thirteen words is counted. A window whose
representative occurs in one document alone is unique, and is settled without a row of its own.

1. Scan: per document its word count, a 128-bit digest of the whole word sequence, the digest of the
   text if nothing is removed, and its representatives.
2. Documents with a word sequence that a smaller doc_id has too are removed whole; only the smallest
   goes on. So groups of exact copies take part once.
3. Representatives in at least two documents are found by a map-side combined minimum and maximum.
4. The windows behind them are hashed (96 bits), counted in Spark, and each learns the smallest
   doc_id it starts in. Windows of larger documents merge into maximal removal intervals.

Defined results: words are runs of characters other than blanks (0x20, 0x09-0x0D). Null text has no
words. Texts with fewer words than a window lose nothing. Rows with the same doc_id never remove
words of each other. A row without doc_id neither loses words nor takes them. Rows keep their number.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.registry import query, table, texts
from chorale.session import settled

WINDOW = 50
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses modulo 2**64
ROWS_AT_ONCE = 512


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            up = np.uint64(pow(self.base, size, 1 << 64))
            down = np.uint64(pow(self.inverse, size, 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * up]), np.concatenate([self.down, self.down * down])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _OTHER = _Powers(_BASE), _Powers(_WORD_BASE), _Powers(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@cache
def _blank() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~_blank()[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _BYTES.upto(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_byte_values()[data] * up[: len(data)], dtype=np.uint64)))
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(words: np.ndarray, length: int, powers: _Powers = _WORDS) -> np.ndarray:
    """The rolling hash of every run of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.upto(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    return mixed((total[length:] - total[:n]) * down[:n])


def representatives(words: np.ndarray, window: int) -> np.ndarray:
    """For every window the least hash among its runs of half the length."""
    half = max(1, window // 2)
    low, width, size = runs(words, half), 1, window - half + 1
    while 2 * width <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = size - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _scan(window: int):
    def scan(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                counts, sequences, plain, lists = [], [], [], []
                for raw in part.column("content"):
                    joined = b" ".join(raw.as_py().split())  # of bytes: at ASCII blanks alone
                    words = word_hashes(joined)
                    counts.append(len(words))
                    sequences.append(hashlib.blake2b(joined, digest_size=16).digest())
                    plain.append(hashlib.sha256(joined).hexdigest())
                    lists.append(np.unique(representatives(words, window)).view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
                ends = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("tag"), pa.array(range(number, number + n), pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(sequences, pa.binary()), pa.array(plain, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))),
                ], names=["doc_id", "tag", "row_no", "n_words", "sequence", "plain_sha", "runs"])
                number += n

    return scan


def _window_rows(window: int):
    """The windows of a document whose representative other documents have too; place holds the text's tag above."""

    def emit(batches):
        for batch in batches:
            for i, shared in enumerate(batch.column("shared")):
                words = word_hashes(batch.column("content")[i].as_py())
                if len(words) < window:
                    continue
                known = np.array(shared.as_py(), np.int64).view(np.uint64)
                place = np.flatnonzero(np.isin(representatives(words, window), known))
                first, second = runs(words, window)[place], runs(words, window, _OTHER)[place]
                n = len(place)
                yield pa.RecordBatch.from_arrays([
                    pa.array(first.view(np.int64)), pa.array((second >> np.uint64(33)).astype(np.int32)),
                    pa.array(np.full(n, batch.column("doc_id")[i].as_py(), np.int64)),
                    pa.array(place | (batch.column("tag")[i].as_py() << 32)),
                ], names=["h", "check", "doc_id", "place"])

    return emit


def covered(places: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``places``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + window, -1)
    return np.cumsum(change)[:n] > 0


def _removed(window: int):
    def cut(batches):
        for batch in batches:
            texts_out, counts = [], []
            for raw, places in zip(batch.column("content"), batch.column("places")):
                words = raw.as_py().split()
                gone = covered(np.array(places.as_py(), np.int64), len(words), window)
                texts_out.append(b" ".join([w for w, g in zip(words, gone) if not g]))
                counts.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(counts, pa.int64()), pa.array(texts_out, pa.binary())],
                names=["doc_id", "tag", "n_removed", "kept"],
            )

    return cut


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (null where all words stay) and kept_sha256 of every row of ``docs``."""
    tag = F.shiftrightunsigned(F.xxhash64("content"), 33)  # tells texts with one doc_id apart
    source = texts(docs).select("doc_id", F.col("text").cast("binary").alias("content")).withColumn("tag", tag)
    rows = settled(
        source.mapInArrow(
            _scan(window), "doc_id long, tag long, row_no long, n_words long, sequence binary, plain_sha string, runs array<long>"
        ),
        "window-rows",
    )
    long_rows = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    smallest = long_rows.groupBy("sequence").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    smallest = smallest.where("first_id < last_id").select("sequence", "first_id")
    copies = settled(
        long_rows.select("doc_id", "row_no", "sequence").join(smallest, "sequence").where("doc_id > first_id").select("row_no"),
        "window-copies",
    )
    marks = long_rows.join(copies, "row_no", "left_anti").select("doc_id", F.explode("runs").alias("mark"))
    shared = marks.groupBy("mark").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("mark")
    wanted = marks.join(shared, "mark", "left_semi").groupBy("doc_id").agg(F.collect_set("mark").alias("shared"))
    near = settled(source.join(wanted, "doc_id"), "window-texts")
    windows = near.mapInArrow(_window_rows(window), "h long, check int, doc_id long, place long")
    firsts = windows.groupBy("h", "check").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    firsts = firsts.where("a < b").select("h", "check", "a")
    places = windows.join(firsts, ["h", "check"]).where("doc_id > a").select(
        "doc_id", F.shiftright("place", 32).alias("tag"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place")
    ).groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"))
    cut = near.select("doc_id", "tag", "content").join(places, ["doc_id", "tag"]).mapInArrow(
        _removed(window), "doc_id long, tag long, n_removed long, kept binary"
    ).dropDuplicates(["doc_id", "tag"])
    out = rows.select("doc_id", "tag", "row_no", "n_words", "plain_sha").join(cut, ["doc_id", "tag"], "left")
    out = out.join(copies.withColumn("copy", F.lit(True)), "row_no", "left")
    whole = F.col("copy").isNotNull()
    kept = F.when(whole, F.lit("")).otherwise(F.col("kept").cast("string"))
    return out.select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        kept.alias("kept"), F.when(kept.isNull(), F.col("plain_sha")).otherwise(F.sha2(kept, 256)).alias("kept_sha256"),
    )


SQL = f"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
w AS (SELECT doc_id, s, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS t
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS s FROM d)),
f AS (SELECT t, min(doc_id) AS a FROM w GROUP BY t HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, list_distinct(flatten(list(generate_series(s, s + {WINDOW - 1})))) AS gone
    FROM w JOIN f USING (t) WHERE doc_id > a GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
    CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
    FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query("op7_substring_dedup", SQL)
def op7_substring_dedup(spark, sf_dir):
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
