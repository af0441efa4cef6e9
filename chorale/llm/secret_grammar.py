"""Secret scans: fixed patterns, and probabilistic automata inferred from the secrets they find.

One scan finds the base spans of every whole text and notes other credential-like tokens (candidates:
runs of 20 or more credential characters that mix letters and digits) and counts how character
classes follow each other in all texts. The values of base spans are the labelled credentials. A
bounded sample of distinct values a kind, chosen by hash, builds a prefix tree of character classes;
its states are merged where their continuations are statistically compatible (Hoeffding bound, the
ALERGIA rule), which gives one probabilistic automaton a kind. Every candidate is then scored: the log
likelihood of its format under the best automaton against the class chain of ordinary text. Candidates
above ``THRESHOLD`` are added as spans of kind ``learned``; base spans are never changed.

Defined results: null or empty text has no spans; positions are code points, end exclusive. Keyword
letters match in either case, A-Z only. Without base spans no automaton is learned and nothing is
added. Repeated rows get equal spans; a null doc_id is kept.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.registry import query, table, texts
from chorale.session import settled

#: The kinds and their patterns; the learned kind comes last.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a shorter run holds no longer one
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KEYWORDS = (b"passw", b"secret", b"token", b"api")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}")
PER_KIND = 400
ALPHA = 0.05
THRESHOLD = 6.0

_CLASS = np.zeros(256, np.uint8)  # 0: any other character
for _chars, _k in (("0123456789", 1), ("abcdef", 2), ("ghijklmnopqrstuvwxyz", 3), ("ABCDEF", 4), ("GHIJKLMNOPQRSTUVWXYZ", 5)):
    _CLASS[list(_chars.encode())] = _k
for _i, _c in enumerate("+/_.=-"):
    _CLASS[ord(_c)] = 6 + _i
N_CLASSES = 12
END = N_CLASSES
_SIZE = np.array([1, 10, 6, 20, 6, 20, 1, 1, 1, 1, 1, 1], np.float64)  # characters in a class


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in the order of start, then kind."""
    out = []
    low = text.encode().lower()
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"akia" in low:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of credential-like tokens that no base span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            if not any(s < m.end() and m.start() < e for _, s, e, _ in taken):
                out.append((m.start(), m.end(), value))
    return out


def classes(value: str) -> list[int]:
    return _CLASS[np.frombuffer(value.encode(), np.uint8)].tolist()


class Automaton:
    """ALERGIA: a prefix tree whose compatible states are merged, most frequent first."""

    def __init__(self, values: list[list[int]], alpha: float = ALPHA):
        self.count, self.final, self.step = [0], [0], [{}]  # step[state][symbol] = [state, times]
        for value in values:
            at = 0
            self.count[0] += 1
            for c in value:
                edge = self.step[at].get(c)
                if edge is None:
                    edge = self.step[at][c] = [len(self.count), 0]
                    self.count.append(0)
                    self.final.append(0)
                    self.step.append({})
                edge[1] += 1
                at = edge[0]
                self.count[at] += 1
            self.final[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], [e[0] for e in self.step[0].values()]
        while blue:
            blue.sort(key=lambda s: (-self.count[s], s))
            state = blue.pop(0)
            home = next((r for r in red if self._compatible(r, state)), None)
            if home is None:
                red.append(state)
            else:
                self._redirect(red, state, home)
                self._fold(home, state)
            known = set(red)
            blue = list(dict.fromkeys(e[0] for r in red for _, e in sorted(self.step[r].items()) if e[0] not in known))
        self.states = red

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.final[a], self.count[a], self.final[b], self.count[b]):
                return False
            for c in {*self.step[a], *self.step[b]}:
                x, y = self.step[a].get(c), self.step[b].get(c)
                if self._differ(x[1] if x else 0, self.count[a], y[1] if y else 0, self.count[b]):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _redirect(self, red: list[int], old: int, new: int) -> None:
        for r in red:
            for edge in self.step[r].values():
                if edge[0] == old:
                    edge[0] = new

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts; what the automaton lacks is hung on as it is."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for c, (state, times) in self.step[b].items():
                edge = self.step[a].get(c)
                if edge is None:
                    self.step[a][c] = [state, times]
                else:
                    edge[1] += times
                    todo.append((edge[0], state))

    def log_likelihood(self, value: list[int]) -> float:
        """Log probability of a class string; unseen steps have a small one."""
        at, total = 0, 0.0
        for c in value:
            edge = self.step[at].get(c) if at is not None else None
            n = self.count[at] if at is not None else 0
            total += math.log(((edge[1] if edge else 0) + 0.02) / (n + 0.02 * (N_CLASSES + 1))) if at is not None else math.log(1e-3)
            at = edge[0] if edge else None
        return total


class Grammar:
    def __init__(self, values: dict[int, list[str]], chain: np.ndarray):
        self.automata = {k: Automaton([classes(v) for v in vs]) for k, vs in values.items()}
        chain = chain.reshape(N_CLASSES, N_CLASSES) + 0.5
        self.chain = np.log(chain / chain.sum(axis=1, keepdims=True))

    def score(self, value: str) -> float:
        """Log likelihood of the best format against ordinary text."""
        c = classes(value)
        plain = float(self.chain[np.array([0, *c[:-1]]), np.array(c)].sum())
        return max((a.log_likelihood(c) for a in self.automata.values()), default=-math.inf) - plain


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("tally", pa.list_(pa.int64())),
    ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))),
    ("other", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))),
])
_FOUND_DDL = (
    "doc_id long, tally array<long>, base array<struct<kind:int,start:int,end:int,value:string>>, "
    "other array<struct<start:int,end:int,value:string>>"
)


def _scan(batches):
    """A row a document, and one tally of class pairs a batch (its spans are null)."""
    for batch in batches:
        base, other, tally = [], [], np.zeros(N_CLASSES * N_CLASSES, np.int64)
        for text in batch.column("text"):
            text = text.as_py()
            found = base_spans(text)
            base.append([dict(zip(("kind", "start", "end", "value"), x)) for x in found])
            other.append([dict(zip(("start", "end", "value"), x)) for x in candidates(text, found)])
            c = _CLASS[np.frombuffer(text.encode(), np.uint8)].astype(np.int64)
            tally += np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=len(tally))
        n = len(base)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.nulls(n, _FOUND.field(1).type), pa.array(base, _FOUND.field(2).type), pa.array(other, _FOUND.field(3).type)],
            schema=_FOUND,
        )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([tally.tolist()], _FOUND.field(1).type), pa.nulls(1, _FOUND.field(2).type), pa.nulls(1, _FOUND.field(3).type)],
            schema=_FOUND,
        )


def found(docs: DataFrame, per_kind: int = PER_KIND, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>> of every row of ``docs``, by start, then kind."""
    rows = settled(texts(docs).mapInArrow(_scan, _FOUND_DDL), "secret-scan")
    pairs = rows.where("base IS NULL").select(F.posexplode("tally").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    chain = np.zeros(N_CLASSES * N_CLASSES)
    for i, n in pairs.collect():  # 144 numbers
        chain[i] = n
    by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    labelled = rows.where("base IS NOT NULL").select(F.explode("base").alias("b")).select("b.kind", "b.value").distinct()
    labelled = labelled.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= per_kind)
    values: dict[int, list[str]] = {}
    for r in labelled.orderBy("kind", "rank").collect():  # at most per_kind values a kind
        values.setdefault(r.kind, []).append(r.value)
    grammar = Grammar(values, chain)

    def added(batches):
        for batch in batches:
            out = []
            for others in batch.column("other").to_pylist():
                out.append([{"k": 3, "start": o["start"], "end": o["end"]} for o in others if grammar.score(o["value"]) >= threshold])
            kind = pa.list_(pa.struct([("k", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(out, kind)], names=["doc_id", "base", "more"])

    scored = rows.where("base IS NOT NULL").select("doc_id", "base", "other").mapInArrow(
        added,
        "doc_id long, base array<struct<kind:int,start:int,end:int,value:string>>, more array<struct<k:int,start:int,end:int>>",
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("k"), b["end"].alias("end")))
    more = F.transform("more", lambda b: F.struct(b["start"].alias("start"), b["k"].alias("k"), b["end"].alias("end")))
    spans = F.transform(F.array_sort(F.concat(base, more)), lambda s: F.struct(names[s["k"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scored.select("doc_id", spans.alias("spans"))


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return spans.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op5_secrets")
def op5_secrets(spark, sf_dir):
    return digests(found(table(spark, sf_dir, "documents")))
