"""Registered queries with their independent SQL checks."""

from importlib import import_module

CATALOGS = ["catalog_clean", "catalog_panel", "catalog_models", "catalog_forecast", "catalog_estimation"]


def load_catalog() -> list[str]:
    """Import every catalog module and return the registered keys."""
    from ledgerline.plans.registry import REGISTRY

    for name in CATALOGS:
        import_module(f"ledgerline.plans.{name}")
    return list(REGISTRY)
