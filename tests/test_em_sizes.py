import inspect

import pytest

from veridex.operators import hardem as H
from veridex.operators import mixture as X
from veridex.plans import registries

QUERIES = {n: q for r in registries() for n, q in r.queries.items()}


class Called(Exception):
    pass


@pytest.mark.parametrize(
    ("query", "module", "operator", "want"),
    [
        ("nl_em_bipartite", X, "cluster", {"iterations": 30, "runs": 8}),
        ("nl_em_nodes", X, "cluster", {"iterations": 10, "runs": 6}),
        ("hard_em", H, "hard_em", {"iterations": 30, "restarts": 16}),
        ("labelled_nodes", H, "hard_em", {"iterations": 30, "restarts": 16}),
        ("detection_pipeline", H, "hard_em", {"iterations": 30, "restarts": 16}),
    ],
)
def test_queries_run_the_reference_iterations_and_restarts(spark, monkeypatch, query, module, operator, want):
    signature = inspect.signature(getattr(module, operator))

    def spy(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in want})

    monkeypatch.setattr(module, operator, spy)
    with pytest.raises(Called) as e:
        QUERIES[query](spark, "/root/testdata/sf0.001")
    assert e.value.args[0] == want
