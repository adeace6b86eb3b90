"""All queries of the engine: importing this package registers them."""

import importlib
import pkgutil

from graphloom.plans.registry import QUERIES, SQL

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["QUERIES", "SQL"]
