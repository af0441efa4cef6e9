import random

import numpy as np
import pytest
from helpers import EDGES, SMALL, documents, multiset, near_groups

from chorale.llm import occurrence_join
from chorale.llm.queries import QUERIES


def near_copies(seed, bases=6, copies=9, words=60):
    """Texts around the threshold: words replaced one by one, passages shared, sizes changed."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(8, words))]
        if rng.random() < 0.6:
            base += passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text += [rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))]
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


def columns(rows):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in rows]


def spanning(links, m):
    root = list(range(m))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(m)]


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_every_link(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 60 + 200 * (seed % 3), rng.integers(1, 60))).astype(np.uint64) for _ in range(15)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(len(base))]
        s = np.union1d(s[rng.random(len(s)) > rng.choice([0.0, 0.03, 0.1])], rng.integers(1000, 2000, rng.integers(0, 4)).astype(np.uint64))
        sets.append(s if len(s) else base[0])
    side = None if seed % 2 else rng.integers(0, 2, len(sets))
    want = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and (side is None or side[i] != side[j]):
                want.append((i, j))
    got = occurrence_join.Sets(sets, 80).links(side)
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in want}
    a, b = spanning(got, len(sets)), spanning(want, len(sets))
    assert len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_prefixes_of_linked_sets_meet_often_enough():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        x = np.sort(rng.choice(10**6, n, replace=False))
        drop = int(rng.integers(0, n // 5 + 1))
        y = np.union1d(x[rng.permutation(n)[drop:]], rng.choice(10**6, int(rng.integers(0, n // 5 + 1))) + 10**6)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            (p, c), (q, d) = occurrence_join.hash_prefix(len(x)), occurrence_join.hash_prefix(len(y))
            assert len(np.intersect1d(x[:p], y[:q])) >= max(c, d)


def test_edge_rows(spark):
    got = columns(occurrence_join.joined(documents(spark, EDGES)).collect())
    assert multiset(got) == multiset(near_groups(EDGES))
    assert occurrence_join.joined(documents(spark, EDGES).limit(0)).collect() == []


def test_near_copies_with_and_without_slices(spark):
    rows = near_copies(3, bases=8, copies=14)
    docs = documents(spark, rows).repartition(5)
    want = multiset(near_groups(rows))
    assert multiset(columns(occurrence_join.joined(docs).collect())) == want
    assert multiset(columns(occurrence_join.joined(docs, block_tokens=300).collect())) == want  # blocks in many slices


def test_frequent_shingles_are_passed_on(spark, monkeypatch):
    rows = near_copies(4, bases=5, copies=12)
    sets = [(i + 1, occurrence_join.shingles(t.encode())) for i, (_, t) in enumerate(rows)]
    dealt = list(occurrence_join._dealt(1, lambda _: iter(sets))(iter([])))
    def found(batches):
        return {c: list(h) for b in occurrence_join._gathered(batches) for c, h in zip(b["cls"].to_pylist(), b["hashes"].to_pylist())}

    def by_part(batches):
        return iter(sorted((b.slice(i, 1) for b in batches for i in range(b.num_rows)), key=lambda r: r["part"][0].as_py()))

    whole = found(by_part(occurrence_join._shared(3)(iter(dealt))))
    monkeypatch.setattr(occurrence_join, "PER_BUCKET", 50)
    monkeypatch.setattr(occurrence_join, "FREQUENT", 5)
    monkeypatch.setattr(occurrence_join, "TOKENS_AT_ONCE", 60)
    parts = found(by_part(occurrence_join._shared(3)(iter(list(occurrence_join._dealt(1, lambda _: iter(sets))(iter([])))))))
    parts, whole = ({c: set(h) for c, h in x.items()} for x in (parts, whole))
    assert parts == whole


def test_one_document_of_each_group_stays(spark):
    rows = near_copies(7, bases=4, copies=6) + [(900, None), (901, ""), (902, " ")]
    docs = documents(spark, rows)
    kept = occurrence_join.representatives(docs)
    assert kept.columns == docs.columns
    want = sorted({c for d, n, c in near_groups(rows) if n} | {900, 901, 902})
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert multiset(QUERIES["op3_ngram_jaccard"](spark, SMALL).collect()) == multiset(near_groups(rows))
