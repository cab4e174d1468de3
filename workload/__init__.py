"""The registered queries. Importing the package fills the registry."""

from importlib import import_module

from .base import ORACLES, QUERIES

for _name in ("joins", "aggregates", "windows", "projections", "geo", "experiments", "models", "sources"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
