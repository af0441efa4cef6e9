"""Text quality from document statistics, by histogram gradient-boosted trees.

One scan turns every whole text into a row of statistics, written to the shared folder (about 100
bytes a row). The trees are fitted on the driver, with numpy, on at most ``sample`` labelled rows:
those whose doc_id has the smallest hashes, so the choice depends on no order or partition. Scoring
is a vectorised walk through the flattened trees over Arrow batches of the statistics.

Defined results: null text is the empty text, whose statistics are all 0; it gets a score as any
other. Rows of ``labels`` without doc_id or label are ignored, and of several labels of one doc_id
the largest holds. Without labels of both classes every score is the share of label 1 (0.5 without
labels). Repeated rows get equal scores. A null doc_id is never held out and never a training row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.registry import query, table, texts
from chorale.session import settled

SAMPLE = 20_000
STATISTICS = (
    "log_bytes log_words mean_word sd_word upper digit space non_ascii ascii_mark pipe_rate hash_rate money_rate percent_rate "
    "amp_rate star_rate bang_rate dot_rate comma_rate lines mean_line repeated_lines distinct_words top_word "
    "doubled_words marked_ends upper_words one_letter letter_entropy"
).split()
_MARKS = [ord(c) for c in "|#$%&*!.,"]


def statistics(text: str) -> list[float]:
    """The statistics of one whole text."""
    raw = text.encode()
    words = text.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(STATISTICS) - 1)
    n, m = len(raw), len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.float64, m)
    kinds = dict.fromkeys(words, 0)
    for w in words:
        kinds[w] += 1
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    letters = hist[97:123] + hist[65:91]
    total = letters.sum()
    share = letters[letters > 0] / max(total, 1)
    marked = sum(not w[-1].isalnum() for w in words)
    upper = sum(w.isupper() for w in words)
    return [
        float(np.log1p(n)), float(np.log1p(m)), lengths.mean(), lengths.std(), hist[65:91].sum() / n, hist[48:58].sum() / n,
        (hist[32] + hist[9:14].sum()) / n, hist[128:].sum() / n,
        (hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()) / n,
        *(hist[c] / m for c in _MARKS), len(lines) / m, m / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1), len(kinds) / m, max(kinds.values()) / m, doubled / m, marked / m, upper / m,
        float((lengths == 1).mean()), float(-(share * np.log2(share)).sum()) if total else 0.0,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, an array of floats."""

    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            flat = np.array([statistics(t.as_py()) for t in batch.column("text")], np.float32).reshape(-1)
            ends = np.arange(len(ids) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "x"])

    return texts(docs).mapInArrow(scan, "doc_id long, x array<float>")


class Trees:
    """Boosted trees of logistic loss on binned values, flattened: node 2i+1 and 2i+2 follow node i."""

    def __init__(self, base: float, feature=None, cut=None, value=None, depth: int = 0):
        self.base, self.feature, self.cut, self.value, self.depth = base, feature, cut, value, depth

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees=80, depth=4, bins=64, rate=0.2, ridge=1.0, least=5) -> Trees:
        prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        base = float(np.log(prior / (1 - prior)))
        if len(y) == 0 or y.min() == y.max():
            return cls(base)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # x <= edge of its bin
        inner, leaves = 2**depth - 1, 2**depth
        feature = np.zeros((trees, inner), np.int32)
        cut = np.full((trees, inner), np.inf, np.float32)
        value = np.zeros((trees, leaves), np.float64)
        margin = np.full(len(y), base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                width = 2**level
                best = np.full(width, 1e-9)
                pick_f, pick_b = np.full(width, -1), np.zeros(width, np.int64)
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    at = node * bins + binned[f]
                    g = np.bincount(at, grad, width * bins).reshape(width, bins).cumsum(axis=1)
                    h = np.bincount(at, hess, width * bins).reshape(width, bins).cumsum(axis=1)
                    c = np.bincount(at, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                    gs, hs, cs = g[:, -1:], h[:, -1:], c[:, -1:]
                    gain = g**2 / (h + ridge) + (gs - g) ** 2 / (hs - h + ridge) - gs**2 / (hs + ridge)
                    gain[(c < least) | (cs - c < least)] = 0
                    gain[:, len(edges[f]) :] = 0  # the last bin has no upper edge
                    b = gain.argmax(axis=1)
                    top = gain[np.arange(width), b]
                    better = top > best
                    best[better], pick_f[better], pick_b[better] = top[better], f, b[better]
                split = pick_f >= 0
                for k in np.flatnonzero(split):
                    feature[t, width - 1 + k] = pick_f[k]
                    cut[t, width - 1 + k] = np.float32(edges[pick_f[k]][pick_b[k]])
                f = pick_f[node]
                right = np.where(f >= 0, binned[f, np.arange(len(y))] > pick_b[node], False)
                node = 2 * node + right
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            value[t] = -rate * g / (h + ridge)
            margin += value[t][node]
        return cls(base, feature, cut, value, depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(0 if self.feature is None else len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t][at]] > self.cut[t][at])
            margin += self.value[t][at - len(self.feature[t])]
        return 1 / (1 + np.exp(-margin))


def label_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row a labelled doc_id."""
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    return kept.groupBy("doc_id").agg(F.max("label").alias("label"))


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def scored(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    rows = settled(measured(docs), "quality-statistics")
    allowed = label_of(labels, column).where(remainder(modulus) != held)
    chosen = rows.dropDuplicates(["doc_id"]).join(allowed, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    fitted = chosen.select("x", "label").toPandas()  # at most ``sample`` rows of 28 numbers
    x = np.array(fitted["x"].tolist(), np.float32).reshape(len(fitted), len(STATISTICS))
    model = Trees.fit(x, fitted["label"].to_numpy(np.float64))

    def score(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op9_quality")
def op9_quality(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
