"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""


def registries() -> list:
    """The registries of this subpackage's queries."""
    from . import queries

    return [queries.R]
