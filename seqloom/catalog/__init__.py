"""All registered queries over the given tables."""

from importlib import import_module

MODULES = ["interactions", "lookups", "codes", "texts", "tasks", "evaluation", "streams", "files"]


def load():
    from seqloom.catalog.base import ORACLES, QUERIES

    for name in MODULES:
        import_module(f"seqloom.catalog.{name}")
    return QUERIES, ORACLES
