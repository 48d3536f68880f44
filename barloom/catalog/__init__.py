"""All registered queries with their SQL twins."""

from importlib import import_module

MODULES = ["panel", "windows", "signals", "joins", "xsection", "returns", "metrics", "evidence", "quality", "storage", "misc"]


def load():
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    from .base import ORACLES, QUERIES

    return QUERIES, ORACLES
