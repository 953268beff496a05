"""All registered queries with the SQL that states their results."""

from __future__ import annotations

from veilwork.catalog import bodies, flows, json_replies, outcomes, streams, texts, traffic  # noqa: F401  (register on import)
from veilwork.catalog.base import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
