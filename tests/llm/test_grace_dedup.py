import random

from helpers import EDGES, documents, exact_groups, lowered, multiset

from chorale.llm import grace_dedup


def test_table_compares_contents_not_hashes():
    table = grace_dedup.ContentTable()
    entries = [table.entry(7, str(i % 3000).encode()) for i in range(9000)]  # one hash for all
    assert len(table) == 3000 and all(e == i % 3000 for i, (e, _) in enumerate(entries))
    assert sum(new for _, new in entries) == 3000


def test_edge_rows(spark):
    got = grace_dedup.grouped(documents(spark, EDGES)).collect()
    assert multiset(got) == exact_groups(EDGES)
    assert grace_dedup.grouped(documents(spark, EDGES).limit(0)).collect() == []


def test_small_tables_recurse_and_hot_text(spark):
    rng = random.Random(5)
    rows = [(i, "hot" * 50 if i % 3 == 0 else f"text {rng.randrange(300)} " + "y" * rng.randrange(90)) for i in range(1500)]
    docs = documents(spark, rows).repartition(6)
    assert multiset(grace_dedup.grouped(docs, table_bytes=2000).collect()) == exact_groups(rows)
    # one bucket holds far more than a table: it is partitioned again
    records = spark.range(4000).selectExpr("id * 64 as hash", "cast(repeat('z', 100) as binary) as content")
    sizes = grace_dedup.bucketed(records, 8_000).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) * 100 <= 8_000 and any("/" in r.bucket for r in sizes)


def test_kept_rows_keep_their_columns(spark):
    docs = documents(spark, EDGES)
    kept = grace_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert sorted(lowered(r.text) for r in rows) == sorted({lowered(t) for _, t in EDGES})
    assert {r.doc_id for r in rows} >= {5, 6, 8, 13}
