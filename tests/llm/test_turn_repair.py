import itertools
import re
import zlib
from collections import Counter, defaultdict

from helpers import SMALL, sha

from chorale.llm import turn_repair
from chorale.llm.queries import ORACLES, QUERIES

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def harmed(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        keep = out[conv_id]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        keep += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired) by forward search over all edits, keeping the least of each (row, what came so far allows)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", [])}

    def put(into, last, new):
        if last not in into or new[:2] < into[last][:2]:
            into[last] = new

    def with_inserts(states):
        out = dict(states)
        for _ in range(3):
            for last, (cost, audit, turns) in list(out.items()):
                for c in follow[last]:
                    if c != "s":
                        put(out, c, (cost + 3, audit + "I", [*turns, ({"u": "user", "a": "assistant"}[c], "")]))
        return out

    for (_, role, text), kind in zip(rows, kinds):
        after = {}
        for last, (cost, audit, turns) in with_inserts(states).items():
            put(after, last, (cost + 4, audit + "D", turns))
            if kind in ("blank", "duplicate"):
                continue
            late = 3 if kind == "truncated" else 0
            for c in follow[last]:
                if role[:1] == c:
                    put(after, c, (cost + late, audit + "K", [*turns, (role, text)]))
                if c != "s":
                    put(after, c, (cost + late + 3, audit + "R", [*turns, ({"u": "user", "a": "assistant"}[c], text)]))
        states = after
    return min((v for k, v in with_inserts(states).items() if k in ("", "a")), key=lambda v: v[:2])


def plain(rows):
    out = {}
    for conv_id, kept in harmed(rows).items():
        kinds = faults(kept)
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        cost, audit, repaired = cheapest(kept, kinds)
        assert LEGAL.match("".join(r[0] for r, _ in repaired))
        count = Counter(kinds)
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            sha("\n".join(f"{r}:{t}" for r, t in repaired)),
        )
    return out


def check(frame, rows):
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in frame.collect()]
    assert {r[0]: r[1:] for r in got} == plain(rows) and len(got) == len({r[0] for r in rows})


def conversations(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return frame.selectExpr("*", "cast(null as string) fault", "1 as gone", "'x' as harm", "2 as copy", "3L as cost", "'K' as audit", "'s' as signature", "1 as times", "0 as initial")


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(QUERIES["op12_conversation_repair"](spark, SMALL), rows)
    assert "op12_conversation_repair" in ORACLES


def test_many_shapes(spark):
    texts = ["Yes.", "No!", "Yes.", "and then", " ", "", "Well? ", "é…", None]
    roles = ["user", "assistant", "system", "user", "tool", None, "User", "assistant", ""]
    rows = [(c, t if t % 7 else None, roles[(c * 5 + t * t) % 9], texts[(c * c + t * 3) % 9]) for c in range(150) for t in range(c % 11)]
    rows += [(None, t, "user", "Hm.") for t in range(6)] + [(None, None, None, None)] * 2 + [(500, 3, "user", "Twice.")] * 4
    rows += [(600, t, ["user", "assistant"][t % 2], f"Text {t}." * 50) for t in range(3000)] + [(601, 10**12, "user", "x." * 400_000), (601, -5, "system", "A.")]
    check(turn_repair.repaired(conversations(spark, rows)), rows)


def test_empty_table(spark):
    assert turn_repair.repaired(conversations(spark, [(1, 1, "user", "a")]).limit(0)).collect() == []


def test_every_signature_against_all_edits():
    """All signatures up to five letters: cost and ASCII-least audit by trying every sequence of edits."""
    automaton = turn_repair.Automaton()
    kinds = {"x": ("u", "blank"), **{c: (c, "") for c in "sua"}, **{c.upper(): (c, "truncated") for c in "sua"}, "o": ("t", ""), "O": ("t", "truncated")}
    words = sorted((w for n in range(5) for w in itertools.product(kinds, repeat=n)), key=lambda w: w[::-1])
    for word in words:
        rows = [(0, kinds[c][0], "text") for c in word]
        want = cheapest(rows, [kinds[c][1] for c in word])[:2]
        assert automaton.solve("".join(word)[::-1]) == want, word
    assert automaton.made == len(words) - 1  # every rest of a signature is one state, made once


def test_states_have_few_cost_patterns():
    turn_repair.state.cache_clear()
    automaton = turn_repair.Automaton()
    automaton.solve("uaSxoA" * 5_000)
    assert turn_repair.state.cache_info().currsize < 60
