"""Registered queries, one module per family; importing this package fills the registry."""

from importlib import import_module
from pkgutil import iter_modules

from shelfline.catalog.base import QUERIES, SQL

for _module in sorted(m.name for m in iter_modules(__path__)):
    import_module(f"{__name__}.{_module}")

__all__ = ["QUERIES", "SQL"]
