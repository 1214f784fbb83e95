"""Named queries on the driver's tables, each with its DuckDB twin."""

from waymark.plans import courses, names, rules, shapes, state, stores, texts  # noqa: F401
from waymark.plans.registry import QUERIES, SQL  # noqa: F401
