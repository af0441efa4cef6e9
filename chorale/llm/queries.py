"""Imports every operator module of this subpackage, so that all queries are registered."""

from chorale.llm import (  # noqa: F401
    bpe_chunks,
    decontaminate,
    grace_dedup,
    occurrence_join,
    quality_trees,
    secret_grammar,
    shard_balance,
    sketch_join,
    toxic_kernel,
    turn_repair,
    url_automaton,
    whitening,
    window_dedup,
)
from chorale.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
