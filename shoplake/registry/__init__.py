"""All registered queries."""

from __future__ import annotations

from shoplake.registry.base import CHECKS, QUERIES


def _load() -> None:
    from shoplake.registry import (  # noqa: F401
        aggregate_queries, change_queries, detail_queries, filter_queries, join_queries, mart_queries,
        quality_queries, scalar_queries, sketch_queries, source_queries, state_queries, stream_queries)


def queries():
    _load()
    return dict(QUERIES)


def checks():
    _load()
    return dict(CHECKS)
