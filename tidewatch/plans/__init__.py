"""Runnable queries by family; importing the package registers all of them."""

import importlib

FAMILIES = ("aggregation", "checks", "shifts", "building", "models", "watching", "tables", "flows")


def load_all() -> None:
    for name in FAMILIES:
        importlib.import_module(f"tidewatch.plans.{name}")
