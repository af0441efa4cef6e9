"""URL rules as glob patterns, all simulated at once with multiword Shift-And masks.

A rule ``host/path`` becomes the glob ``*.host/path**`` over the canonical URL ``.host/path``: ``*``
is any run without ``/`` (so it stays inside the host), ``**`` any run, ``?`` any one byte but ``/``.
The states of all globs lie side by side in 64-bit words. One step reads one byte of every URL of the
Arrow batch: ``D = ((D << 1) & next[byte]) | (D & stay[byte])``, then stars that follow a reached
state are entered. The automaton is a constant of a few words for each byte value, whatever the data.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule. A URL
with no path (``http://a.com?x``) fits no rule that has a path, so also not ``com/``. Where several
rules fit, the longest rule text wins, then the first listed. Where none fits, ``rule`` is null and
the verdict is ``default``. Rows keep their number: repeated rows are judged one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.registry import LOWER, UPPER, query, table

#: Fixed values: (rule, verdict).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
DEFAULT_VERDICT = "allow"
SLASH = ord("/")


class ShiftAnd:
    """The packed masks of some globs."""

    def __init__(self, globs: list[str]):
        next_bits, stay_bits, enter, start, final = {}, {}, [], [], []
        bit = 0
        for glob in globs:
            raw, i = re.sub(r"\*{2,}", "**", glob).encode(), 0  # any more stars in a row say no more
            start.append(bit)  # an anchor state: on before the first byte only
            bit += 1
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    double = raw[i : i + 2] == b"**"
                    stay_bits[bit] = [b for b in range(256) if double or b != SLASH]
                    enter.append(bit)
                    i += 2 if double else 1
                else:
                    next_bits[bit] = [b for b in range(256) if b != SLASH] if raw[i : i + 1] == b"?" else [raw[i]]
                    i += 1
                bit += 1
            final.append(bit - 1)
        self.words = max(1, -(-bit // 64))
        self.final = final
        self.next, self.stay = self._masks(next_bits), self._masks(stay_bits)
        self.enter = self._pack(enter)
        # a star may match nothing, so it is on as soon as the state before it is
        self.start = self._entered(self._pack(start)[:, None])[:, 0]

    def _pack(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def _masks(self, bits: dict[int, list[int]]) -> np.ndarray:
        out = np.zeros((self.words, 256), np.uint64)
        for b, chars in bits.items():
            out[b // 64, chars] |= np.uint64(1 << (b % 64))
        return out

    @staticmethod
    def _shifted(state: np.ndarray) -> np.ndarray:
        out = state << np.uint64(1)
        out[1:] |= state[:-1] >> np.uint64(63)
        return out

    def _entered(self, state: np.ndarray) -> np.ndarray:
        return state | (self._shifted(state) & self.enter[:, None])

    def fits(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(globs, strings) booleans for strings that lie in ``buffer``."""
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], -lengths[order]
        state = np.repeat(self.start[:, None], len(order), axis=1)
        for i in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(left, -i))  # strings that still have a byte
            byte = buffer[at[:n] + i]
            state[:, :n] = self._entered(
                (self._shifted(state[:, :n]) & self.next[:, byte]) | (state[:, :n] & self.stay[:, byte])
            )
        out = np.zeros((len(self.final), len(order)), bool)
        for k, b in enumerate(self.final):
            out[k, order] = (state[b // 64] >> np.uint64(b % 64)) & np.uint64(1) == 1
        return out


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    automaton = ShiftAnd([f"*.{rule}**" for rule, _ in ranked])
    names = np.array([r for r, _ in ranked] + [None], object)
    verdicts = np.array([v for _, v in ranked] + [default], object)

    def judge(batches):
        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            whole = [f".{h}{p}".encode() for h, p in zip(host.to_pylist(), path.to_pylist())]
            lengths = np.fromiter(map(len, whole), np.int64, len(whole))
            starts = np.cumsum(lengths) - lengths
            hit = automaton.fits(np.frombuffer(b"".join(whole), np.uint8), starts, lengths)
            first = np.where(hit.any(axis=0), hit.argmax(axis=0), len(ranked))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), host, path, pa.array(names[first], pa.string()), pa.array(verdicts[first], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    split = pages.select("page_id", rest.alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    kind = dict(split.dtypes)["page_id"]
    return split.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


_FITS = {r: (r.split("/", 1)[0], "/" + r.split("/", 1)[1]) for r, _ in RULES}
_CASES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}'"
    for r, (h, p) in sorted(_FITS.items(), key=lambda x: -len(x[0]))
)
_VERDICTS = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
SQL = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT page_id, host, path, CASE {_CASES} END AS rule FROM split)
SELECT page_id, host, path, rule, CASE rule {_VERDICTS} ELSE '{DEFAULT_VERDICT}' END AS verdict FROM ruled
"""


@query("op4_url_filter", SQL)
def op4_url_filter(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages"))
