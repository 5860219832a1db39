"""Registered queries over the benchmark tables."""

import importlib

MODULES = ("q_stats", "q_insights", "q_motion", "q_corpus", "q_language", "q_checks", "q_sources")


def load_queries() -> None:
    for name in MODULES:
        importlib.import_module(f"trajlake.plans.{name}")
