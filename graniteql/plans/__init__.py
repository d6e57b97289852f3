"""The registered queries and the DuckDB statements that they equal."""

from __future__ import annotations

from graniteql.plans import corpus, inputs, relational, scalars, streams, udfs
from graniteql.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
for part in (inputs, relational, scalars, corpus, streams, udfs):
    QUERIES |= part.query.queries
    ORACLE |= part.query.oracle
