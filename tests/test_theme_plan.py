"""The whole way from uploads to ranked themes."""

import re

from pyspark.sql import functions as F

from chorale import catalog_entries, rules
from chorale.operators import ranking, themes
from chorale.plans import prepare

SMALL = "/root/testdata/sf0.001"


def test_every_sanitized_review_is_in_one_theme(spark):
    kept, _, _ = prepare.prepare(catalog_entries.feedback(spark, SMALL), F.lit("2024-06-01").cast("timestamp"))
    want = {(r.session_id, r.review_id) for r in kept.select("session_id", "review_id").collect()}
    assigned, attempts, selection = catalog_entries.themed_reviews(spark, SMALL)
    rows = assigned.select("session_id", "review_id", "cluster_id", "text_anonymized").collect()
    assert {(r.session_id, r.review_id) for r in rows} == want and len(rows) == len(want)
    assert not any(re.search(rules.LEAK_EMAIL, r.text_anonymized) for r in rows)  # themes are made of masked texts
    chosen = {r.session_id: r for r in selection.collect()}
    tried = {(r.session_id, r.profile_name): r for r in attempts.collect()}
    for session, row in chosen.items():
        found = {r.cluster_id for r in rows if r.session_id == session} - {"weak_signals"}
        assert len(found) == row.cluster_count
        if row.backend != "single":
            assert tried[session, row.profile_name].quality_score == row.quality_score
    rolled = themes.rollup(themes.weekly_stats(assigned)).collect()
    assert sum(r["size"] for r in rolled) == len(want)
    best = ranking.top_clusters(themes.rollup(themes.weekly_stats(assigned)), 3).collect()
    assert {r.session_id for r in best} == set(chosen) and max(r["rank"] for r in best) <= 3
