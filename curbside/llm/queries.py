"""Importing this module fills the registry of corpus queries."""

from importlib import import_module

from .base import ORACLES, QUERIES

for _name in ("html_extraction", "pii", "license_scan", "substring_dedup", "language_id", "decontamination", "lm_scoring", "packing", "jaccard_join", "quality_rules",
              "token_alignment", "spelling_variants", "embedding_neighbours"):
    import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
