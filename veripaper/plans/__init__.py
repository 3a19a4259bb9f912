"""Registered queries over the test tables."""

from importlib import import_module

from .registry import ORACLES, QUERIES

AREAS = ["papers", "references", "citations", "diagrams", "listings", "documents", "streams", "records"]


def _load() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
