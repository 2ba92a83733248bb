"""Registered queries; importing this package fills the registry."""

from featlake.plans import (  # noqa: F401
    catalog_queries,
    clean_queries,
    embed_queries,
    metric_queries,
    sequence_queries,
    split_queries,
)
from featlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
