import random

import numpy as np
import pytest
from helpers import EDGES, SMALL, documents, multiset, windows_cut

from chorale.llm import window_dedup
from chorale.llm.queries import QUERIES


def columns(rows):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows]


def passages(seed, n=120):
    rng = random.Random(seed)
    shared = [[rng.choice("abcdefgh") for _ in range(rng.randrange(5, 30))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        rows.append((rng.randrange(n), rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [rows[0], rows[1], (None, rows[2][1]), (n + 1, "a " * 300), (n + 2, "a " * 200), (n + 3, rows[3][1])]


@pytest.mark.parametrize("window", [1, 2, 7, 10])
def test_planted_passages(spark, window):
    rows = passages(window)
    got = window_dedup.deduplicated(documents(spark, rows).repartition(4), window).collect()
    assert multiset(columns(got)) == multiset(windows_cut(rows, window))


def test_edge_rows(spark):
    got = window_dedup.deduplicated(documents(spark, EDGES)).collect()
    assert multiset(columns(got)) == multiset(windows_cut(EDGES))
    assert window_dedup.deduplicated(documents(spark, EDGES).limit(0)).collect() == []


def test_rolling_hash_is_the_hash_of_the_run():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, 5000).astype(np.uint64)
    words[3000:3100] = words[100:200]
    hashes = window_dedup.runs(words, 50)
    assert len(np.unique(hashes)) == len(hashes) - 51 and (hashes[3000:3051] == hashes[100:151]).all()
    low = window_dedup.representatives(words, 50)
    half = window_dedup.runs(words, 25)
    assert all(low[i] == half[i : i + 26].min() for i in range(0, len(low), 97)) and len(low) == len(hashes)


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert multiset(columns(QUERIES["op7_substring_dedup"](spark, SMALL).collect())) == multiset(windows_cut(rows))
