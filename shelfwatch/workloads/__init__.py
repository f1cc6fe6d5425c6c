"""Registered queries over the given tables, each with its equivalent SQL where there is one."""


def load():
    """`(queries, oracles)` by name."""
    from . import changes, extraction, jobs, reporting  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
