"""Query registry; importing the query modules fills it."""

from __future__ import annotations

import importlib

MODULES = [
    "pooling_queries",
    "flow_queries",
    "array_queries",
    "tidy_queries",
    "metric_queries",
    "loss_queries",
]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"medley.plans.{name}")
