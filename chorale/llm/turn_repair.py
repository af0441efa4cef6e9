"""Conversation structure repair over a suffix-shared DAWG of role/fault signatures.

1. **Rows.** Damage and faults are column expressions; a conversation's rows are sorted in one shuffle, which
   also finds repeats. A row becomes one letter: ``x`` if it must go, else its role's initial (``o``: any
   other), in capitals if truncated. A conversation's letters are its signature.
2. **Automaton.** Equal signatures are one. States with the same rest of a signature are the same state, so the
   minimal automaton of all signatures is ordered by their reversed letters: range partitions in that order
   hold every state once, except along the border of two partitions. In a task, the states a signature shares
   with the one before are the longest common suffix; a stack holds them and each new state is solved once:
   for each of four grammar states the cost to go, and the first edits of the best audit suffix.
3. **Audits.** A signature's audit is read off along its states. Conversations get theirs by a join
   (signatures of more than a thousandth of all conversations, under 1,000, are broadcast). The
   rows then stream past their audit, which gives the digest of the repaired conversation.

Grammar states: 0 nothing yet, 1 after the system turn, 2 after user, 3 after assistant; a repaired conversation
ends in 0 or 3. What may come next is fixed in each of them, so an audit determines the repair. Audits of a state
differ first in a row's letter or an insertion (none is the beginning of another), so choosing the
least of equal costs state by state gives the ASCII-least audit.

Defined results: nulls in conv_id, turn (for the checksum), role and text count as one space; rows without
conv_id are one conversation, with null conv_id. Rows are taken by turn, nulls first, then role and text, so
rows with one turn have an order, and repeated rows lie together. Damage treats repeated rows alike. Of a
role only its first character counts, as written. A conversation without rows left has zeros, the empty audit
and the digest of the empty text; one with only rows to delete has its audit and that digest. Texts may be of
any length; of a conversation, only its signature (a byte a row, as long as the audit) is held in memory: its
rows stream through one task, as its digest runs over its whole text.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.registry import hot_join, packed, query, table

#: The blanks, the ends of sentences, and the costs of the edits.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
DAMAGE = 20
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # the grammar state after an inserted or re-roled turn
ROLES = {2: b"user", 3: b"assistant"}
END = (("", 0), ("II", 2 * INSERT), ("I", INSERT), ("", 0))
_ORDER = ["conv_id", "turn", "role", "text"]  # ascending, nulls first


def typed(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text alone, so that no other column can clash; null role and text are one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    )


def damaged(conversations: DataFrame, modulus: int = DAMAGE) -> DataFrame:
    """conv_id, turn, role, text, gone of every row after the damage; a dropped row stays, marked ``gone``, without text."""
    rows = typed(conversations)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("harm", F.pmod(F.crc32(F.encode(name, "utf-8")), F.lit(modulus)))
    harm = F.col("harm")
    text = F.when(harm <= 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(harm == 4, "user").otherwise(F.col("role"))
    times = F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (harm == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def faulted(rows: DataFrame) -> DataFrame:
    """Rows of ``damaged`` with ``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated; sorted within each conversation."""
    rows = rows.repartition("conv_id")
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(body == "", 1).when(seen, 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("*", fault.alias("fault")).sortWithinPartitions(*_ORDER, F.col("fault") == 2)  # of equal rows the first is no repeat


class _Seen:
    """What is known of the conversation that is being read."""

    def __init__(self, conv_id):
        self.conv_id, self.letters, self.faults = conv_id, [], np.zeros(4, np.int64)
        self.illegal, self.last, self.turns, self.low, self.high = 0, None, 0, None, None

    def add(self, letters: bytes, initials: np.ndarray, faults: np.ndarray, turns: np.ndarray) -> None:
        """``turns``: without nulls, in order; ``initials``: 0 s, 1 u, 2 a, 3 any other."""
        self.letters.append(letters)
        self.faults += np.bincount(faults, minlength=4)
        row = initials if self.last is None else np.append(self.last, initials)
        a, b = row[:-1], row[1:]
        self.illegal += int((~((b == 1) & ((a == 0) | (a == 2)) | (a == 1) & (b == 2))).sum())
        self.last = row[-1]
        if len(turns):
            self.turns += int((turns[1:] != turns[:-1]).sum()) + int(self.high != turns[0])
            self.low, self.high = (turns[0] if self.low is None else self.low), turns[-1]

    def row(self) -> tuple:
        gaps = 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.turns
        return (self.conv_id, gaps, *(int(x) for x in self.faults[1:]), self.illegal, b"".join(self.letters).decode())


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_SIGNED = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", signature string"
_CODES = np.frombuffer(b"suaoSUAO", np.uint8)


def _integers(column) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def _edges(ids: np.ndarray, null: np.ndarray) -> list[int]:
    """Where conversations begin, and the end."""
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]))) if len(ids) else np.zeros(0, bool)
    return [*np.flatnonzero(new).tolist(), len(ids)]


def _signatures(batches):
    now = None

    def as_batch(rows):
        names = ["conv_id", *_COUNTS, "signature"]
        kinds = [pa.int64()] * (1 + len(_COUNTS)) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        (ids, no_id), (turns, no_turn) = _integers(batch.column("conv_id")), _integers(batch.column("turn"))
        stay = ~batch.column("gone").to_numpy(zero_copy_only=False)
        initials, faults = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("initial", "fault"))
        letters = np.where((faults == 1) | (faults == 2), ord("x"), _CODES[initials + 4 * (faults == 3)]).astype(np.uint8)
        out, edges = [], _edges(ids, no_id)
        for a, b in zip(edges, edges[1:]):
            conv_id = None if no_id[a] else int(ids[a])
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Seen(conv_id)
            here = np.flatnonzero(stay[a:b]) + a
            if len(here):
                now.add(letters[here].tobytes(), initials[here], faults[here], turns[here[~no_turn[here]]])
        if out:
            yield as_batch(out)
    if now is not None:
        yield as_batch([now.row()])


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, signature of every conversation of ``faulted`` rows."""
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.select("conv_id", "turn", "gone", initial.alias("initial"), "fault").mapInArrow(_signatures, _SIGNED)


@cache
def state(letter: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """An automaton state before ``letter``: by grammar state, the cost to go and (first edits, grammar state after them).

    ``costs`` are those after the letter, less their least, so few arguments occur however long the signatures are.
    """
    own, late = letter.lower(), TRUNCATED if letter.isupper() else 0
    by_row = []
    for s in range(4):
        ways = [(DELETE + costs[s], "D", s)]
        if own != "x":
            to = NEXT[s]
            ways.append((REROLE + late + costs[to], "R", to))
            if own == "s" and s == 0:
                ways.append((KEEP + late + costs[1], "K", 1))
            elif own == ("a" if s == 2 else "u"):
                ways.append((KEEP + late + costs[to], "K", to))
        by_row.append(min(ways))
    best = []
    for s in range(4):
        once = NEXT[s]
        ways = [by_row[s]]
        for inserted, at in (("I", once), ("II", NEXT[once])):
            cost, edit, to = by_row[at]
            ways.append((cost + INSERT * len(inserted), inserted + edit, to))
        best.append(min(ways))
    return tuple(c for c, _, _ in best), tuple((edits, to) for _, edits, to in best)


class Automaton:
    """The states along one signature, read from its end; the next signature keeps those of the common suffix."""

    def __init__(self):
        self.letters, self.made = "", 0
        self.costs: list[tuple[int, tuple[int, ...]]] = [(0, tuple(c for _, c in END))]  # (least, costs less the least)
        self.ways: list[tuple] = [None]

    def solve(self, backwards: str) -> tuple[int, str]:
        """(least cost, ASCII-least audit of that cost) of a signature given from its end."""
        same, limit = 0, min(len(backwards), len(self.letters))
        while same < limit and backwards[same] == self.letters[same]:
            same += 1
        del self.costs[same + 1 :], self.ways[same + 1 :]
        for letter in backwards[same:]:
            base, after = self.costs[-1]
            costs, ways = state(letter, after)
            least = min(costs)
            self.costs.append((base + least, tuple(c - least for c in costs)))
            self.ways.append(ways)
        self.made += len(backwards) - same
        self.letters = backwards
        at, audit = 0, []
        for depth in range(len(backwards), 0, -1):
            edits, at = self.ways[depth][at]
            audit.append(edits)
        audit.append(END[at][0])
        base, costs = self.costs[-1]
        return base + costs[0], "".join(audit)


def _solved(batches):
    automaton = Automaton()
    for batch in batches:
        got = [automaton.solve(b) for b in batch.column("backwards").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("signature"), batch.column("times"), pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())],
            names=["signature", "times", "cost", "audit"],
        )


def audits(signed: DataFrame) -> DataFrame:
    """signature, times, cost, audit: each signature once, solved along the automaton of all."""
    once = signed.groupBy("signature").agg(F.count("*").alias("times")).withColumn("backwards", F.reverse("signature"))
    ordered = once.repartitionByRange("backwards").sortWithinPartitions("backwards")
    return ordered.mapInArrow(_solved, "signature string, times long, cost long, audit string")


class _Repair:
    """Applies an audit to the rows of a conversation as they come, and digests what results."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.first = audit, 0, 0, hashlib.sha256(), True

    def _turn(self, role: bytes, text: bytes) -> None:
        self.digest.update((b"" if self.first else b"\n") + role + b":")
        self.digest.update(text)
        self.first = False

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self._turn(ROLES[self.state], b"")

    def row(self, role: bytes, text: bytes) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        system = edit == "K" and role[:1] == b"s"
        self.state = 1 if system else NEXT[self.state]
        self._turn(role if edit == "K" else ROLES[self.state], text)

    def hexdigest(self) -> str:
        self._insert()
        return self.digest.hexdigest()


_OUT = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
_OUT_SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in [*_COUNTS, "cost"]) + ", audit string, repaired_sha256 string"


def _repaired(batches):
    now, head = None, None

    def as_batch(rows):
        kinds = [pa.int64()] * (2 + len(_COUNTS)) + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_OUT)

    for batch in batches:
        out = []
        for audit, role, text, at in zip(batch.column("audit"), batch.column("role"), batch.column("content"), range(batch.num_rows)):
            if audit.is_valid:  # a conversation's first row
                if now is not None:
                    out.append((*head, now.audit, now.hexdigest()))
                now, head = _Repair(audit.as_py()), [batch.column(c)[at].as_py() for c in _OUT[:-2]]
            else:
                now.row(role.as_py(), text.as_py())
        if out:
            yield as_batch(out)
    if now is not None:
        yield as_batch([(*head, now.audit, now.hexdigest())])


def repaired(conversations: DataFrame, modulus: int = DAMAGE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    harmed = damaged(conversations, modulus)
    signed = packed(signatures(faulted(harmed)), "turn-signatures")
    solved = packed(audits(signed), "turn-audits")
    heads = hot_join(signed, solved, "signature", signed.count())
    none = F.lit(None)
    heads = heads.select(
        "conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"),
        *_COUNTS, "cost", "audit",
    )
    rows = harmed.where(~F.col("gone")).select(
        "conv_id", "turn", "role", "text", *(none.cast("long").alias(c) for c in [*_COUNTS, "cost"]), none.cast("string").alias("audit")
    )
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER[1:])
    both = both.withColumn("role", F.col("role").cast("binary")).withColumn("content", F.col("text").cast("binary")).drop("text")
    return both.mapInArrow(_repaired, _OUT_SCHEMA)


def _more(f: str, cost: int | str, letter: str) -> str:
    """SQL of a state's text, nine digits of cost and the audit, after one more edit."""
    return f"(lpad(CAST(CAST({f}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {f}[10:] || '{letter}')"


_LATE = f"(CASE WHEN x[1] = upper(x[1]) THEN {TRUNCATED} ELSE 0 END)"
_FREE = "least(f[1], f[2], f[4])"  # the states in which a user turn may come
#: One step of the forward search over the states; ``x`` holds a row's letter or + for a possible insertion.
_STEP = f"""CASE WHEN x[1] = '+'
    THEN [f[1], f[2], least(f[3], {_more("f[1]", INSERT, "I")}, {_more("f[2]", INSERT, "I")}, {_more("f[4]", INSERT, "I")}), least(f[4], {_more("f[3]", INSERT, "I")})]
    WHEN x[1] = 'x' THEN [{", ".join(_more(f"f[{s}]", DELETE, "D") for s in (1, 2, 3, 4))}]
    ELSE [{_more("f[1]", DELETE, "D")},
        least({_more("f[2]", DELETE, "D")}, CASE WHEN lower(x[1]) = 's' THEN {_more("f[1]", _LATE, "K")} ELSE 'none' END),
        least({_more("f[3]", DELETE, "D")}, {_more(_FREE, f"{REROLE} + {_LATE}", "R")}, CASE WHEN lower(x[1]) = 'u' THEN {_more(_FREE, _LATE, "K")} ELSE 'none' END),
        least({_more("f[4]", DELETE, "D")}, {_more("f[3]", f"{REROLE} + {_LATE}", "R")}, CASE WHEN lower(x[1]) = 'a' THEN {_more("f[3]", _LATE, "K")} ELSE 'none' END)]
    END"""
SQL = f"""
WITH bits AS (SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, b: xor(c >> 1, 3988292384 * (c & 1)), i) ORDER BY i) AS tab
    FROM (SELECT CAST(unnest(generate_series(0, 255)) AS BIGINT) AS i)),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT d.*, xor(list_reduce(list_transform(generate_series(1, length(name)), lambda k: CAST(ascii(name[k]) AS BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {DAMAGE} AS harm FROM d, bits),
r AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE harm <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM p),
f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN seen THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM n),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list(CASE WHEN fault IN (1, 2) THEN 'x' ELSE CASE WHEN fault = 3 THEN upper(k) ELSE k END END ORDER BY pos) AS letters
    FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS k FROM f) GROUP BY conv_id),
e AS (SELECT * EXCLUDE letters, list_reduce(
        flatten(list_transform(letters, lambda x: [['+'], ['+'], [x]])) || [['+'], ['+']],
        lambda f, x: {_STEP}, ['000000000', '900000000', '900000000', '900000000']) AS f FROM c),
a AS (SELECT *, CAST(least(f[1], f[4])[1:9] AS BIGINT) AS cost, least(f[1], f[4])[10:] AS audit FROM e),
s AS (SELECT conv_id, i, letter, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS nth
    FROM (SELECT conv_id, unnest(generate_series(1, length(audit))) AS i, unnest(string_split(audit, '')) AS letter FROM a WHERE audit <> '')
    WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT s.conv_id, s.i, s.letter, s.nth, f.role, f.text,
    max(CASE WHEN s.nth = 1 AND s.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS system
    FROM s LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos AND s.letter <> 'I'),
t AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS repaired FROM g WHERE letter <> 'D' GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_conversation_repair", SQL)
def op12_conversation_repair(spark, sf_dir):
    return repaired(table(spark, sf_dir, "conversations"))
