"""Operators of a training-data pipeline: one module per operator, with its registered query."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every operator module so that its query is registered."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("op"):
            importlib.import_module(f"{__name__}.{module.name}")
