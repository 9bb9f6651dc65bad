"""Named queries and their SQL oracles."""


def registries() -> list:
    """The registries of all core queries."""
    from . import data_quality, graph_queries, model_queries, record_queries

    return [data_quality.R, graph_queries.R, record_queries.R, model_queries.R]
