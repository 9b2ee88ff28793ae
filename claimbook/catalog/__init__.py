"""Every registered query with the SQL it is checked against."""

from claimbook.catalog.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    """All queries by name."""
    from claimbook.catalog import basics, household, losses, profiling, statistics  # noqa: F401

    return dict(REGISTRY)
