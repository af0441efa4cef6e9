from helpers import SMALL, exact_groups, leaks, near_groups, sha

import corpus_pipeline
from chorale.llm import bpe_chunks
from chorale.llm.queries import QUERIES
from chorale.session import settled


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    scores = {r.doc_id: r.predicted for r in QUERIES["op6_toxicity"](spark, SMALL).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    want = [d for d in text if not scores[d]]
    kept = {"toxicity": set(want)}
    want = [d for d, _, _, stays, _ in exact_groups([(d, text[d]) for d in want]) if stays]
    kept["exact dedup"] = set(want)
    want = [d for d, n, low in near_groups([(d, text[d]) for d in want]) if d == low or not n]
    kept["near dedup"] = set(want)
    want = [r[0] for r in leaks([(d, text[d]) for d in want], items) if not r[-1]]
    kept["decontamination"] = set(want)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settled(stage(spark, at, SMALL), "test-stage")
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} == kept[name], name
        at = out
    tok = bpe_chunks.tokenizer(bpe_chunks.default_path())
    got = corpus_pipeline.STAGES[-1][1](spark, at, SMALL).collect()
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded_sha256 == sha(tok.decode(ids, skip_special_tokens=False))


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 100


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
