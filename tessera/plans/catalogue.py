"""Every registered query of the library with the SQL that it must agree with."""

from __future__ import annotations

from tessera.plans import cases, filing, numeric, retrieval, tabular, texts
from tessera.plans.registry import Query

_PARTS = (retrieval.query, texts.query, tabular.query, numeric.query, filing.query, cases.query)
QUERIES: dict[str, Query] = {name: q for part in _PARTS for name, q in part.queries.items()}
ORACLE: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.oracle.items()}
