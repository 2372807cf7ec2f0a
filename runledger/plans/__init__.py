"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "source_queries", "classify_queries", "text_queries", "generate_queries", "stats_queries", "report_queries",
    "flow_queries",
]


def _load():
    for name in MODULES:
        import_module(f"runledger.plans.{name}")
    from runledger.plans import fixtures

    return fixtures


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_load().ORACLES)
