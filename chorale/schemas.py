"""Schemas of the tables. ``session_id`` is the partition column of all of them."""

from __future__ import annotations

from pyspark.sql import types as T

from chorale import rules

RAW_FIELDS = [*rules.REQUIRED_FIELDS, *rules.OPTIONAL_FIELDS]
RAW = T.StructType([T.StructField(name, T.StringType()) for name in RAW_FIELDS])
# A JSON upload is a list of records, or an object whose ``reviews`` is that list.
RAW_JSON = T.StructType([*RAW.fields, T.StructField("reviews", T.ArrayType(RAW))])
JSON_LINE = T.StructType(RAW.fields)

CHUNKS = "array<struct<language:string,char_count:int,token_count:int>>"
REVIEW_METADATA = (
    "struct<raw_index:bigint,ingested_from:string,pii_backend_effective:string,"
    f"mixed_language_processed:boolean,language_chunks:{CHUNKS}>"
)

# Columns added to the vector index over time, with the value that older tables imply.
INDEX_DEFAULTS = {
    "backend_requested": "local",
    "backend_effective": "local",
    "embedding_backend_effective": "projection",
    "embedding_model_effective": "tfidf-svd-projection",
}

# Defaults for runtime metadata written before a field existed.
RUNTIME_DEFAULTS = {
    "trace_correlation_id": "n/a",
    "presentation_mode": "clustered",
    "low_data_mode": False,
    "pii_backend_requested": "regex",
    "pii_backend_effective": "regex",
    "sentiment_backend_requested": "lexical",
    "sentiment_backend_effective": "lexical",
    "llm_call_count": 0,
    "embedding_call_count": 0,
    "prompt_tokens_total": 0,
    "completion_tokens_total": 0,
    "embedding_input_tokens_total": 0,
    "estimated_cost_usd": 0.0,
    "weak_signal_count": 0,
    "mixed_sentiment_cluster_count": 0,
    "mixed_language_review_count": 0,
}
