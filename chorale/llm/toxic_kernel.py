"""Toxicity by a support vector machine on a gapped subsequence kernel with Nystroem landmarks.

The kernel of two words is the sum, over common subsequences of three letters that lie within
``SPAN`` letters of each word, of ``DECAY`` to the number of skipped letters, divided by the words'
norms. Case and digits used as letters are folded; marks inside a word count as skipped
letters, and single letters set apart by blanks (``i d i o t``) count as one word. So insults with
inserted or dropped characters stay close to their landmark.

Training reads a bounded sample of labelled documents, ``per_class`` of each label, chosen by a hash
of doc_id. Their sentences are cut into words; a word's label comes from the documents it is found
in, where all documents with the same rarest-hash word (near copies) count as one. The machine is a
squared-hinge SVM on the Nystroem features of the landmarks. As kernel and features are linear in
subsequences, the fitted machine is one weight a subsequence: a table of 2**18 floats. Scoring sums
those weights over every word of every whole text, in numpy; a document's score is a logistic function,
fitted on the sample, of the values above the machine's boundary as shares of all words, with and
without the highest one, and of the logarithm of the number of words. So a few chance hits weigh less
the longer a text is.

Defined results: null or empty text, and text without letters, get the score of a text of one word
below the boundary. Labels without doc_id or value are ignored; of several labels of a doc_id the largest
holds. If a class is missing from the sample, every score is the share of label 1, or 0 without
labels. Repeated rows get equal scores. A null doc_id is never held out and never trained on.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.quality_trees import label_of, remainder
from chorale.llm.registry import query, table, texts
from chorale.session import settled

PER_CLASS = 5_000
SPAN, DECAY = 5, 0.6
LANDMARKS = 160
SURPRISE = 3.0
HARD = 2_000
FLOOR = -2.0
_PATTERNS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]  # places of letters 2 and 3 after letter 1
_BLANK, _MARK = 0, 63  # symbols 1..62 are letters
#: Digits and marks often written for letters.
_LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


@cache
def symbols() -> np.ndarray:
    """The symbol of every code point: a-z are 1..26, other letters 27..62 by code point."""
    out = np.full(0x110000, _MARK, np.uint8)
    for c in range(0x3000):
        letter = chr(c).lower()[:1]
        letter = _LOOKALIKES.get(letter, letter)
        if chr(c).isspace():
            out[c] = _BLANK
        elif "a" <= letter <= "z":
            out[c] = ord(letter) - 96
        elif letter.isalpha():
            out[c] = 27 + ord(letter) % 36  # accents tell words of one language from another's
    high = np.arange(0x3000, 0x110000)
    out[0x3000:] = 27 + high % 36
    out[0x3000] = _BLANK
    return out


def encoded(text: str) -> np.ndarray:
    """Symbols of a text; the blanks between single letters become marks."""
    s = symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(s) > 4:
        blank = s == _BLANK
        edge = np.concatenate(([True], blank, [True]))  # edge[i] says whether position i - 1 is outside a word
        single = ~blank & edge[:-2] & edge[2:]
        between = blank.copy()
        between[[0, -1]] = False
        between[1:-1] &= single[:-2] & single[2:]
        s = np.where(between, np.uint8(_MARK), s)
    return s


def word_bounds(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], s != _BLANK, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def subsequences(s: np.ndarray):
    """For each pattern: first positions, codes and weight of the letter triples inside words."""
    n, word = len(s), np.cumsum(s == _BLANK)
    letter = (s != _BLANK) & (s != _MARK)
    wide = s.astype(np.int32)
    for i, j in _PATTERNS:
        m = n - j
        if m <= 0:
            continue
        ok = letter[:m] & letter[i : i + m] & letter[j:] & (word[:m] == word[j:])
        at = np.flatnonzero(ok)
        yield at, (wide[at] << 12) | (wide[at + i] << 6) | wide[at + j], DECAY ** (j - 2)


def word_scores(text: str, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of every word of a whole text that has a triple."""
    s = encoded(text)
    starts, ends = word_bounds(s)
    if not len(starts):
        return np.zeros(0)
    total, norm = np.zeros(len(s) + 1), np.zeros(len(s) + 1)
    for at, code, weight in subsequences(s):
        total[at] += weight * weights[code]
        norm[at] += weight * weight
    edges = np.stack([starts, ends], axis=1).reshape(-1)
    value, size = np.add.reduceat(total, edges)[::2], np.add.reduceat(norm, edges)[::2]
    value, size = value[size > 0], size[size > 0]
    return value / np.sqrt(size) + bias


def vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normed subsequence vectors of words as (row, code, value)."""
    rows, codes, values = [], [], []
    for r, w in enumerate(words):
        found = [(c, np.full(len(c), weight)) for _, c, weight in subsequences(symbols()[np.frombuffer(w.encode("utf-32-le"), np.uint32)])]
        c = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int32)
        v = np.concatenate([x[1] for x in found]) if found else np.zeros(0)
        rows.append(np.full(len(c), r))
        codes.append(c)
        values.append(v / max(np.sqrt((v * v).sum()), 1e-9))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(values)


def fitted(words: list[str], y: np.ndarray, importance: np.ndarray, landmarks: list[int], penalty: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights of all subsequences, and bias, of a squared-hinge SVM on Nystroem features."""
    row, code, value = vectors(words)
    mine = np.isin(row, landmarks)
    used = np.unique(code[mine])  # the subsequences of the landmarks: a few thousand
    place = np.full(2**18, -1, np.int32)
    place[used] = np.arange(len(used))
    column = {w: k for k, w in enumerate(landmarks)}
    marks = np.zeros((len(used), len(landmarks)))
    np.add.at(marks, (place[code[mine]], [column[r] for r in row[mine].tolist()]), value[mine])
    kernel = np.zeros((len(words), len(landmarks)))
    hits = np.flatnonzero(place[code] >= 0)
    for at in range(0, len(hits), 20_000):  # a slice at a time bounds the driver's memory
        h = hits[at : at + 20_000]
        np.add.at(kernel, row[h], marks[place[code[h]]] * value[h, None])
    among = kernel[landmarks]
    lam, u = np.linalg.eigh((among + among.T) / 2)
    keep = lam > 1e-6 * lam.max()
    root = u[:, keep] / np.sqrt(lam[keep])  # features are kernel @ root
    z = kernel @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    ridge = penalty * np.append(np.ones(z.shape[1] - 1), 1e-3)  # the bias is hardly bound
    w = np.zeros(z.shape[1])
    for _ in range(rounds):  # Newton steps: least squares on the words inside the margin
        active = y * (z @ w) < 1
        za, weight = z[active], importance[active]
        after = np.linalg.solve((za * weight[:, None]).T @ za + np.diag(ridge), za.T @ (weight * y[active]))
        if np.allclose(after, w, atol=1e-9):
            break
        w = after
    weights = np.zeros(2**18)
    weights[used] = marks @ (root @ w[:-1])
    return weights, float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps of a class-balanced logistic regression with an intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    each = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + ridge * w
        hess = (x * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def measures(text: str, weights: np.ndarray, bias: float) -> tuple[float, float, float]:
    """What a document's score reads of its words: share above the boundary, the same without the highest word, length.

    The second share keeps one chance hit from deciding.
    """
    v = word_scores(text, weights, bias)
    n = max(len(v), 1)
    above = np.maximum(v, 0.0)
    total = float(above.sum())
    rest = max(total - float(above.max(initial=0.0)), 0.0)
    return float(np.log1p(100 * total / n)), float(np.log1p(100 * rest / n)), float(np.log(n))


def _distinct_words(batches):
    """(word, toxic, group): the folded words of a document; group is the word with the least hash."""
    import xxhash

    for batch in batches:
        out: list[tuple[str, int, int]] = []
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            words = {w for w in text.as_py().lower().split()}
            if not words:
                continue
            group = min(xxhash.xxh64_intdigest(w) for w in words) >> 1
            pure = {w.strip("#$%&*|!.,;:?") for w in words}
            out += [(w, label, group) for w in pure if 2 < len(w) <= 40]
        yield pa.RecordBatch.from_pylist(
            [{"word": w, "label": x, "group": g} for w, x, g in out],
            schema=pa.schema([("word", pa.string()), ("label", pa.int32()), ("group", pa.int64())]),
        )


def spread(words: list[str], weight: np.ndarray, k: int) -> list[int]:
    """Up to ``k`` of the words, each the one whose kernel vector the chosen ones explain least, times its weight.

    A pivoted Cholesky decomposition of the words' kernel: forms of one family leave little of each other.
    """
    row, code, value = vectors(words)
    pair, at = np.unique(row * 2**18 + code, return_inverse=True)  # a code may stand in a word more than once
    left = np.bincount(pair >> 18, np.bincount(at, value) ** 2, len(words))
    columns, chosen = np.zeros((len(words), 0)), []
    for _ in range(min(k, len(words))):
        best = int(np.argmax(left * weight))
        if left[best] < 1e-6:
            break
        chosen.append(best)
        mine = row == best
        dense = np.bincount(code[mine], value[mine], 2**18)
        column = (np.bincount(row, value * dense[code], len(words)) - columns @ columns[best]) / np.sqrt(left[best])
        columns = np.hstack([columns, column[:, None]])
        left = np.maximum(left - column * column, 0.0)
        left[best] = 0.0
    return chosen


def _problem(insults: list[tuple[str, int]], clean: list[tuple[str, int]], hard: list[str] = ()):
    """Words, their classes and weights, and which of them are landmarks: insults spread over families, hard words, frequent words."""
    words = [w for w, _ in insults + clean]
    y = np.array([1.0] * len(insults) + [-1.0] * len(clean))
    importance = np.sqrt(np.array([n for _, n in insults + clean], np.float64))
    importance[np.isin(words, list(hard))] *= 3
    for label in (1, -1):
        importance[y == label] /= importance[y == label].sum()
    place = {w: i for i, w in enumerate(words)}
    landmarks = spread([w for w, _ in insults], np.sqrt(np.array([n for _, n in insults], np.float64)), LANDMARKS // 2)
    rest = [place[w] for w in hard[: LANDMARKS // 4]] + list(range(len(insults), len(words)))
    landmarks += list(dict.fromkeys(rest))[: LANDMARKS - len(landmarks)]
    return words, y, importance, landmarks


class Machine:
    def __init__(self, weights: np.ndarray | None, bias: float, scale: np.ndarray | None, prior: float):
        self.weights, self.bias, self.scale, self.prior = weights, bias, scale, prior

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        margin = np.dot(self.scale[:-1], measures(text, self.weights, self.bias)) + self.scale[-1]
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def trained(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = PER_CLASS) -> Machine:
    allowed = label_of(labels, "toxic").where(remainder(modulus) != held)
    one, other = (
        allowed.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)
    )
    chosen = one.unionAll(other)
    chosen = settled(chosen, "toxic-chosen")  # at most two times per_class rows of two numbers
    sample = settled(texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "label"), "toxic-sample")
    sizes = dict(sample.groupBy("label").count().collect())
    if len(sizes) < 2:
        return Machine(None, 0.0, None, float(bool(sizes.get(1))))
    words = sample.mapInArrow(_distinct_words, "word string, label int, group long").distinct()
    counts = words.groupBy("word").agg(
        F.sum((F.col("label") == 1).cast("int")).alias("toxic"), F.sum((F.col("label") == 0).cast("int")).alias("clean")
    )
    counts = settled(counts, "toxic-words")
    share = sizes[1] / (sizes[0] + sizes[1])
    n, t = F.col("toxic") + F.col("clean"), F.col("toxic")
    part = F.greatest(t / n, F.lit(1e-9))
    # the likelihood ratio of a word that is more frequent among toxic documents, against chance over all words
    evidence = t * F.log(part / share) + F.when(t < n, (n - t) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    bar = float(np.log(max(counts.count(), 1)) + SURPRISE)
    marked = counts.withColumn("sure", (part > share) & (evidence > bar))
    insults = [(r.word, r.toxic) for r in marked.where("sure").orderBy(F.desc("toxic"), "word").limit(1_500).collect()]
    if not insults:
        return Machine(None, 0.0, None, float(sizes[1] / sum(sizes.values())))
    plain = marked.where(~F.col("sure") & (part <= 0.5))
    common = [(r.word, r.clean) for r in plain.orderBy(F.desc("clean"), "word").limit(3_000).collect()]
    rare = [(r.word, 1) for r in plain.orderBy(F.xxhash64("word")).limit(9_000).collect()]
    known = {w for w, _ in insults}
    clean = [x for x in dict(rare + common).items() if x[0] not in known]
    weights, bias = fitted(*_problem(insults, clean))

    def value(batches):
        for batch in batches:
            top = [max(word_scores(w.as_py(), weights, bias), default=FLOOR) for w in batch.column("word")]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("clean"), pa.array(top, pa.float64())], names=["word", "clean", "value"])

    near = plain.select("word", "clean").mapInArrow(value, "word string, clean long, value double")
    hard = [(r.word, 1 + r.clean) for r in near.orderBy(F.desc("value"), "word").limit(HARD).collect() if r.word not in known]
    weights, bias = fitted(*_problem(insults, list(dict(clean + hard).items()), [w for w, _ in hard]))

    names = ["share", "rest", "length"]

    def measured(batches):
        for batch in batches:
            got = np.array([measures(t.as_py(), weights, bias) for t in batch.column("text")]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(c, pa.float64()) for c in got.T)], names=["label", *names])

    levels = sample.mapInArrow(measured, "label int, share double, rest double, length double").toPandas()  # bounded as the sample is
    scale = logistic(levels[names].to_numpy(), levels["label"].to_numpy(np.float64))
    return Machine(weights, bias, scale, 0.0)


def scored(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    machine = trained(docs, labels, modulus, held, per_class)

    def score(batches):
        for batch in batches:
            values = [machine.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(score, "doc_id long, score double").select(
        "doc_id", F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, all columns as they came; scored where they lie."""
    machine = trained(docs, labels, per_class=per_class)

    @F.pandas_udf("boolean")
    def toxic(column: pd.Series) -> pd.Series:
        return pd.Series([machine.score(t or "") >= 0.5 for t in column], dtype=bool)

    return docs.where(~toxic("text"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
