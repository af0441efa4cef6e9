import random
import zlib
from collections import defaultdict

from helpers import EDGES, SMALL, documents

from chorale.llm import shard_balance
from chorale.llm.queries import QUERIES
from chorale.llm.shard_balance import differenced


def test_differencing_balances_and_keeps_items_whole():
    rng = random.Random(1)
    for n in (1, 2, 7, 8, 9, 500):
        sizes = [int(rng.paretovariate(1.2) * 100) for _ in range(n)]
        labels, sums = differenced([(s, *[0] * 7) for s in sizes])
        again = [0] * 8
        for s, label in zip(sizes, labels):
            assert sorted(label) == list(range(8))
            again[label[0]] += s
        assert again == sums
        if n == 500 and max(sizes) < sum(sizes) / 8:
            assert max(sums) - min(sums) < min(sizes) + 2


def check(rows, got, shards=8, tolerance=None):
    assert sorted(r.doc_id is not None and r.doc_id for r in got) == sorted(d is not None and d for d, _ in rows)
    slots, groups, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    text_of = defaultdict(list)
    for d, t in rows:
        text_of[d].append(t or "")
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    for r in got:
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in text_of[r.doc_id]}
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        groups[(r.size, r.text_crc32)].add(r.shard)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weight = defaultdict(int)
    for r in got:
        weight[(r.size, r.text_crc32)] += r.size
    assert all(len(groups[g]) == 1 for g in groups if weight[g] * shards <= total)
    if tolerance is not None:
        assert max(sizes.values()) - min(sizes.values()) <= tolerance


def test_edge_rows(spark):
    check(EDGES, shard_balance.sharded(documents(spark, EDGES)).collect())
    assert shard_balance.sharded(documents(spark, EDGES).limit(0)).collect() == []


def test_hot_group_is_dealt_in_pieces(spark):
    rng = random.Random(2)
    rows = [(i, "hot text " * 30 if i % 3 == 0 else "t" * rng.randrange(400)) for i in range(3000)]
    got = shard_balance.sharded(documents(spark, rows).repartition(5), per_part=150, per_bucket=200).collect()
    check(rows, got, tolerance=50)


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op10_sharding"](spark, SMALL).collect()
    check(rows, got)
    assert {r.law for r in got} == {"bytes"}
