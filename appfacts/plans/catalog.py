"""Imports every module that registers queries."""

import importlib

MODULES = ["misuse", "manifest", "text", "matching", "hierarchy", "graph", "taint", "studies", "sets", "pointers", "io"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"appfacts.plans.{m}")
