"""The two classifiers: held-out accuracy, defined results, and their parts."""

import numpy as np
import pytest
from helpers import EDGES, documents

from chorale.llm import quality_trees, toxic_kernel
from chorale.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def held_out_accuracy(spark, query, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES[query](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([p == y for p, y in held]), len(held)


def test_quality_of_held_out_documents(spark):
    accuracy, n = held_out_accuracy(spark, "op9_quality", "quality")
    assert n > 50 and accuracy > 0.97


def test_toxicity_of_held_out_documents(spark):
    accuracy, n = held_out_accuracy(spark, "op6_toxicity", "toxic")
    assert n > 50 and accuracy > 0.9


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] < -0.3)).astype(float)
    model = quality_trees.Trees.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    for row in x[:20]:  # the vectorised walk against one step at a time
        margin = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            at = 0
            for _ in range(model.depth):
                at = 2 * at + 1 + (row[f[at]] > c[at])
            margin += v[at - len(f)]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_scores_without_usable_labels(spark):
    docs = documents(spark, EDGES)
    none = spark.createDataFrame([(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_trees.scored(docs, none).collect()} == {0.5}
    assert {r.score for r in toxic_kernel.scored(docs, none).collect()} == {0.0}
    assert quality_trees.scored(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    assert len(quality_trees.scored(docs, one).collect()) == len(EDGES)
    assert {r.score for r in toxic_kernel.scored(docs, one).collect()} == {1.0}


def insults(seed=0, n=900):
    rng = np.random.default_rng(seed)
    syllables = ["ta", "ro", "mi", "len", "sor", "ka", "fu", "dem", "pol", "nir"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.integers(20, 60))]
        toxic = i % 4 == 0
        for _ in range(rng.integers(1, 4) if toxic else 0):
            words[rng.integers(len(words))] = str(rng.choice(["grumpwit", "blockhead", "numbskull"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_gapped_and_inserted_insults_are_found(spark):
    rows, labels = insults()
    tests = [(10_000 + i, f"taro mikalen sor {w} demfu polnir ro") for i, w in enumerate(
        ["grumpwit", "g.r.u.m.p.w.i.t", "grump-wit", "GRUMPWIT!!", "gruumpwit", "blockxhead", "numb5kull", "b l o c k h e a d"])]
    clean = [(20_000, "taro mikalen sor demfu polnir ro"), (20_001, None), (20_002, ""), (20_003, "!!! ... ???"), (None, "taro ro")]
    docs = documents(spark, rows + tests + clean)
    frame = spark.createDataFrame(labels + [(0, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxic_kernel.scored(docs, frame).collect()}
    assert all(got[d].predicted == 1 for d, _ in tests), [(t, got[d].score) for d, t in tests]
    assert all(got[d].predicted == 0 for d, _ in clean)
    assert got[None].held_out is False
    kept = toxic_kernel.without_toxic(docs, frame)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxic_kernel.scored(docs, frame).collect() if not r.predicted}


def test_long_clean_documents_outlive_chance_hits(spark):
    rows, labels = insults()
    rng = np.random.default_rng(5)
    plain = " ".join(text for (_, text), (_, toxic) in zip(rows, labels) if not toxic).split()

    def long(n, marked):
        words = [str(w) for w in rng.choice(plain, n)]
        for at in rng.choice(n, marked, replace=False):
            words[at] = str(rng.choice(["grumpwit", "blockhead", "numbskull"]))
        return " ".join(words)

    clean = [(30_000 + i, long(n, marked)) for i, (n, marked) in enumerate([(2_000, 2), (2_000, 3), (5_000, 3), (20_000, 3)])]
    toxic = [(40_000 + i, long(n, n // 20)) for i, n in enumerate([40, 2_000, 5_000, 20_000])]
    docs = documents(spark, rows + clean + toxic)
    got = {r.doc_id: r for r in toxic_kernel.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[d].predicted for d, _ in clean] == [0] * len(clean), [got[d].score for d, _ in clean]
    assert [got[d].predicted for d, _ in toxic] == [1] * len(toxic), [got[d].score for d, _ in toxic]


def test_landmarks_reach_a_rare_family():
    common = [(f"grumpwit{x}{y}", 100) for x in "abcdefghij" for y in "klmnopqrs"]  # more forms than landmarks
    rare = [("zebufol", 9), ("zebufola", 8)]
    words, y, _, landmarks = toxic_kernel._problem(common + rare, [(f"plain{i}word", 50) for i in range(400)])
    chosen = [words[i] for i in landmarks]
    assert len(set(landmarks)) == len(landmarks) <= toxic_kernel.LANDMARKS and set(y[landmarks]) == {1, -1}
    assert {"zebufol", "zebufola"} & set(chosen)


def test_statistics_have_fixed_length():
    for _, text in EDGES:
        row = quality_trees.statistics(text or "")
        assert len(row) == len(quality_trees.STATISTICS) and np.isfinite(row).all()
