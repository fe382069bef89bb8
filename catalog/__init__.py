"""Registered queries over the driver tables, each with the SQL it is checked against."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "job_queries", "index_queries")


def load():
    """The registry with all query modules imported."""
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
    return importlib.import_module("catalog.registry")
