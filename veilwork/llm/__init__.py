"""Operators of a training-data pipeline, and their queries.

A task that runs one operator imports that operator's module and no other.
"""

from __future__ import annotations

from importlib import import_module

from veilwork.llm.base import ORACLES, QUERIES

OPERATORS = (
    "clustering decontam extraction langid lines lm packing quality search sharding simhash suffixes toxicity".split()
)


def _registered() -> None:
    for name in OPERATORS:
        import_module(f"{__name__}.{name}")


def queries():
    _registered()
    return dict(QUERIES)


def oracle_sql():
    _registered()
    return dict(ORACLES)
