"""The registered queries, grouped by screen."""

from shoptally.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    from shoptally.plans import (  # noqa: F401
        cleaning, dashboard, ingest, integrity, pos, scalars, stock, stored, streams, upload,
    )

    return QUERIES
