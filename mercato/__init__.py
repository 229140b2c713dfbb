"""Marketplace analytics as PySpark DataFrame jobs."""

from mercato.plans.star import Star, master, order_payments, products_en, store
from mercato.plans.tables import Tables
from mercato.session import configure
from mercato.sources.population import population
from mercato.sources.readers import export_csv, load_jdbc, load_subset, load_tables, sample_cap

__all__ = [
    "Star",
    "Tables",
    "configure",
    "export_csv",
    "load_jdbc",
    "load_subset",
    "load_tables",
    "master",
    "order_payments",
    "population",
    "products_en",
    "sample_cap",
    "store",
]
