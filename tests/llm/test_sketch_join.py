import random

import numpy as np
from helpers import EDGES, SMALL, documents, multiset, near_groups

from chorale.llm import sketch_join
from chorale.llm.queries import QUERIES


def plain(rows, percent=85):
    out = []
    for doc_id, n, low in near_groups(rows, percent):
        component = doc_id if low is None or not n else low
        out.append((doc_id, n, component, doc_id is not None and doc_id == component))
    return out


def columns(frame):
    return frame.select("doc_id", "n_shingles", "component_id", "kept").collect()


def planted(seed=3, groups=14, copies=6):
    """Groups whose copies drift apart around the threshold, all with one frequent passage, and short texts."""
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(60))
    rows = []
    for g in range(groups):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([30, 90, 200, 400]))]
        for c in range(copies):
            rows.append((len(rows), " ".join(words) + (" " + passage if g % 2 else "")))
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice([40, 60, 90]))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    rows += [(1000 + i, " ".join(f"s{(i // 2 * 31 + k) % 50}" for k in range(1 + i % 9))) for i in range(40)]
    rng.shuffle(rows)
    return rows


def test_components_against_every_pair(spark):
    rows = planted()
    want = multiset(plain(rows))
    assert len({c for _, _, c, _ in plain(rows)}) < len(rows) - 20
    assert multiset(columns(sketch_join.deduplicated(documents(spark, rows)))) == want


def test_large_blocks_are_cut_and_stay_whole(spark):
    """Slices of a few sets each: pivots join the main component, chains and outsiders are met afterwards."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):  # a wide group around one text, and a chain drifting away from it
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    words = list(base)
    for i in range(60):
        words[i] = f"chain{i}"
        rows.append((500 + i, " ".join(words)))
    want = multiset(plain(rows))
    got = sketch_join.deduplicated(documents(spark, rows), block_tokens=2_000)
    assert multiset(columns(got)) == want


def test_estimates_are_of_the_union_sketch():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, size, replace=False)) for size in (20, 60, 96, 200, 700, 700)]
    sets.append(sets[-1][5:])
    search = sketch_join.Search(sets, np.zeros(len(sets), np.int64), np.arange(len(sets)), 85)
    for x, mine in enumerate(sets):
        for y, got in enumerate(search.estimates(x, np.arange(len(sets)))):
            union = np.union1d(mine, sets[y])[: sketch_join.KEPT]
            both = np.isin(union, mine) & np.isin(union, sets[y])
            assert got == both.sum() / len(union)


def test_a_group_of_copies_costs_its_size():
    base = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(np.append(np.delete(base, i % 400), np.uint64(i + 7))) for i in range(800)]
    search = sketch_join.Search(sets, np.zeros(800, np.int64), np.arange(800), 85)
    calls = []
    compare = search.compare
    search.compare = lambda x: (calls.append(x), compare(x))
    search.run(np.arange(800) < 8)
    assert len(set(search.root.tolist())) == 1 and len(calls) < 20 and len(search.links) == 799


def test_edge_rows_and_empty_table(spark):
    got = columns(sketch_join.deduplicated(documents(spark, EDGES)))
    assert multiset(got) == multiset(plain(EDGES))
    assert columns(sketch_join.deduplicated(documents(spark, EDGES).limit(0))) == []


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert multiset(QUERIES["op11_minhash"](spark, SMALL).collect()) == multiset(plain(rows))
