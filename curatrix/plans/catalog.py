"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from curatrix.plans import base, captions, files, masks, more, orders, records, scans, sinks, tables  # noqa: F401  they register their queries

FLAGSHIP = "f29_f37_post_thresholds"


def queries() -> dict[str, Callable]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
