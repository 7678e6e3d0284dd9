"""Imports every query module so the registry is complete."""

from __future__ import annotations

import importlib

from sitewise.plans.registry import ORACLES, QUERIES

MODULES = [
    "sitewise.plans.q_clean",
    "sitewise.plans.q_core",
    "sitewise.plans.q_stats",
    "sitewise.plans.q_io",
    "sitewise.plans.q_report",
    "sitewise.plans.q_spatial",
    "sitewise.plans.q_metrics",
    "sitewise.plans.q_model",
    "sitewise.plans.q_missing",
]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries():
    load_all()
    return dict(QUERIES)


def oracle_sql():
    load_all()
    return dict(ORACLES)
