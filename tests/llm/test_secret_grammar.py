import random
import re

from helpers import EDGES, SMALL, documents, sha

from chorale.llm import secret_grammar
from chorale.llm.queries import QUERIES

WORDS = r"(?ai:(password|passwd|secret|token|api_?key))"


def by_hand(text):
    text, out = text or "", []
    out += [("assign", m) for m in re.finditer(WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    spans = [(m.start(), secret_grammar.KINDS.index(k), m.end(), k) for k, m in out]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


def planted(n=300, seed=1):
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    rows = []
    for i in range(n):
        kind = i % 5
        secret = [f'api_key = "{hexes(24)}"', key(), hexes(40), f"PASSWORD: short token=token:abcdefgh_{i}", "nothing at all"][kind]
        rows.append((i, f"é some words before {secret} and the other words after, no. {i}"))
    return rows


def test_base_spans_stay_and_formats_are_learned(spark):
    rows = planted() + [(1000, "here is " + planted(1, seed=9)[0][1].split('"')[1] + " without its name"), (1001, "extraordinarily-wellformed-2-words")]
    got = {r.doc_id: r for r in secret_grammar.digests(secret_grammar.found(documents(spark, rows))).collect()}
    for doc_id, text in rows:
        base = by_hand(text)
        spans = got[doc_id].spans.split(",") if got[doc_id].spans else []
        assert [s for s in spans if not s.startswith("learned")] == base
        assert got[doc_id].base_sha256 == sha(",".join(base))
        assert (got[doc_id].n_assign, got[doc_id].n_access, got[doc_id].n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
    assert got[1000].spans.startswith("learned:8:")
    assert got[1001].spans == ""


def test_merged_states_generalise():
    rng = random.Random(4)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(300)]
    automaton = secret_grammar.Automaton([secret_grammar.classes(v) for v in values])
    assert len(automaton.states) < 200  # the prefix tree has thousands
    unseen = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    word = "internationalisationofeverything"
    assert automaton.log_likelihood(secret_grammar.classes(unseen)) > automaton.log_likelihood(secret_grammar.classes(word)) + 20


def test_edge_rows(spark):
    got = secret_grammar.found(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.spans == [] for r in got)
    assert secret_grammar.found(documents(spark, EDGES).limit(0)).collect() == []


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.base_sha256 for r in QUERIES["op5_secrets"](spark, SMALL).collect()}
    assert got == {r.doc_id: sha(",".join(by_hand(r.text))) for r in rows}
