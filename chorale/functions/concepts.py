"""Concept tags from fragment rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale import rules

Concepts = list[tuple[str, str, list[list[str]]]]


def detect(text: Column, concepts: Concepts = rules.CONCEPTS) -> Column:
    """Ids of the concepts with a pattern whose fragments all occur in the lower text."""

    def all_of(fragments: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.contains(text, F.lit(f)) for f in fragments])

    def any_of(patterns: list[list[str]]) -> Column:
        return reduce(lambda a, b: a | b, [all_of(p) for p in patterns])

    return F.array_compact(F.array(*[F.when(any_of(p), name) for name, _, p in concepts]))


def enrich(text: Column, found: Column, repeats: int = rules.CONCEPT_REPEATS) -> Column:
    """Append each concept marker ``repeats`` times."""
    marks = F.flatten(
        F.transform(found, lambda c: F.array_repeat(F.concat(F.lit("concept_"), c), repeats))
    )
    return F.when(F.size(found) > 0, F.concat_ws(" ", text, F.array_join(marks, " "))).otherwise(text)


def label_of(concept: Column, concepts: Concepts = rules.CONCEPTS) -> Column:
    names = F.create_map(*[F.lit(v) for name, label, _ in concepts for v in (name, label)])
    return F.try_element_at(names, concept)
