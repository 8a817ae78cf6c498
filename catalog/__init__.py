"""Queries over the given tables, one per operator, with their oracle SQL."""

import importlib
import pkgutil


def load():
    """Import every module of the catalog, which registers its queries."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return importlib.import_module(f"{__name__}.registry")
