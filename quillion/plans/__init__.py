"""Queries over the driver tables and their SQL."""


def queries() -> dict:
    from quillion.plans import answers, mining, pages, ranking  # noqa: F401  they register themselves
    from quillion.plans.base import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from quillion.plans.base import ORACLES

    return dict(ORACLES)
