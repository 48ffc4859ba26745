"""Queries over the driver tables and their SQL twins."""

import importlib
import pkgutil
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def all_queries():
    """Imports every ``q_*`` module and returns the registry."""
    from checks.registry import QUERIES

    for m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"checks.{m}")
    return QUERIES
