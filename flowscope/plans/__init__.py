"""Queries over the driver's tables and whole workflows."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
