"""Queries: operators applied to the tables, each with its SQL."""

from frostline.plans import data, fields, files, measures, pools, reports, retrieval, scoring, training  # noqa: F401  they register their queries
from frostline.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
