import random

import pytest
from helpers import EDGES, SMALL, documents, leaks, multiset

from chorale.llm import decontaminate
from chorale.llm.queries import QUERIES


def columns(rows):
    import hashlib

    return [(r.row.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in rows]


def cases(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "É", "é", "ΑΣ", "ας", "K", "k", "x1", "Ab", "aB"]) + rng.choice(["", "", "1", "q"])
    items = [(i % 9, rng.choice([" ", ". ", "--"]).join(word() for _ in range(rng.randrange(1, 16)))) for i in range(12)]
    items += [(50, None), (51, ""), (None, "the of the of"), (None, "an item without an id of ten words or so, in all"), (52, "..."), (53, "the")]
    rows = []
    for i in range(80):
        parts = [word() for _ in range(rng.randrange(0, 30))]
        if rng.random() < 0.6:
            parts[0:0] = [rng.choice(items)[1] or ""]
        rows.append((rng.randrange(60), rng.choice(["", ".", "!? "]) + rng.choice([" ", "\n"]).join(parts) + rng.choice(["", "."])))
    return rows + [rows[0], (None, rows[1][1])], items


@pytest.mark.parametrize("seed,limit", [(1, 200_000), (2, 0)])  # words broadcast, words shuffled
def test_random_items(spark, seed, limit):
    rows, items = cases(seed)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(documents(spark, rows).repartition(3), benchmark, broadcast_rows=limit).collect()
    assert multiset(columns(got)) == multiset(leaks(rows, items))


def test_edge_rows(spark):
    items = [(1, "same text here"), (2, LEAK := "word5x5 word6x6 word7x7 word8x8 word9x9 word10x10 word11x11 word12x12 word13x0 word14x1")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, EDGES)
    assert multiset(columns(decontaminate.hits(docs, benchmark).collect())) == multiset(leaks(EDGES, items))
    assert decontaminate.hits(docs.limit(0), benchmark).collect() == []
    assert len(decontaminate.hits(docs, benchmark.limit(0)).where("n_hit = 0").collect()) == len(EDGES)
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert multiset(kept.select("doc_id", "text").collect()) == multiset(
        (d, t) for (d, t), r in zip(EDGES, leaks(EDGES, items)) if not r[-1]
    )
    assert LEAK in EDGES[9][1]


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert multiset(QUERIES["op8_decontamination"](spark, SMALL).collect()) == multiset(leaks(rows, items))


def test_plan_has_no_python(spark):
    plan = QUERIES["op8_decontamination"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
