"""Registered queries over the driver tables, each with its SQL counterpart."""

import importlib

MODULES = ("text_queries", "table_queries", "layout_queries", "report_queries", "source_queries")


def load():
    """Import every query module and return the filled registry."""
    for module in MODULES:
        importlib.import_module(f"pagegauge.catalog.{module}")
    return importlib.import_module("pagegauge.catalog.registry")
