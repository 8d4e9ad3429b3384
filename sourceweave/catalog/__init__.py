"""Every registered query, with the SQL that checks it where SQL can express it."""

import importlib

_MODULES = ["panel_queries", "reference_queries", "graph_queries", "text_queries", "dq_queries", "io_queries"]


def load():
    """Import all query modules and return the registry."""
    for m in _MODULES:
        importlib.import_module(f"sourceweave.catalog.{m}")
    return importlib.import_module("sourceweave.catalog.registry")
