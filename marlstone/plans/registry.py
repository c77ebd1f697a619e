"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from marlstone.plans import chunks, dedup, dialogue, filegraph, files, graphs, knowledge, links, pages, records, retrieval, search, streams, telemetry, texts  # noqa: F401  they register their queries
from marlstone.plans._base import QUERIES, SQL

FLAGSHIP = "R8_hybrid_search"


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
