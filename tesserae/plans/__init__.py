"""Test-table queries, one module per block of operators."""

from __future__ import annotations

import importlib

MODULES = ["resolution", "relational", "datasets", "quality", "files"]


def all_modules() -> None:
    for name in MODULES:
        importlib.import_module(f"tesserae.plans.{name}")
