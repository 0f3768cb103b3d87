"""Registered queries, grouped by operator family."""

from importlib import import_module

FAMILIES = ("pixels", "labels", "aggregates", "windows", "sampling", "metrics", "gates", "lineage", "raster",
            "regions", "destitching", "models", "streams", "sources", "hooks", "retraining")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"rasterloom.plans.{family}")
