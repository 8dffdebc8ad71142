"""Registered queries: the operators over the driver tables, each with the SQL it must equal."""

from catalog import cleaning, models, reports, requests, responses, scoring, sources, splits

MODULES = (responses, scoring, cleaning, splits, requests, models, reports, sources)


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL over the same tables."""
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
