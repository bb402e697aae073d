"""Registered queries and their DuckDB reference SQL, by family."""

from fareflow.catalog import associations, evaluations, features, ingest, models, profiles, reporting

FAMILIES = [ingest, profiles, features, associations, evaluations, reporting, models]


def all_queries() -> dict:
    return {name: entry[0] for family in FAMILIES for name, entry in family.QUERIES.items()}


def all_oracles() -> dict:
    return {name: entry[1] for family in FAMILIES for name, entry in family.QUERIES.items() if entry[1]}
