"""Feature preparation and evaluation for conversion prediction, on Spark."""

from featlake.catalog import Catalog, Feature

__all__ = ["Catalog", "Feature"]
