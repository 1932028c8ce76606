"""Label propagation finds best labels anew only where something has changed."""

import random

import pytest

from codeloom.plans import fixpoint
from tests.graph.test_traverse import plain_labels


@pytest.mark.parametrize("sent", [0, fixpoint.SENT if hasattr(fixpoint, "SENT") else 0])
def test_late_rounds_go_to_few_links(spark, monkeypatch, sent):
    rng = random.Random(5)
    pairs = [(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(260)]
    plans, cut = [], fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    monkeypatch.setattr(fixpoint, "SENT", sent)
    got = fixpoint.propagated_labels(spark.createDataFrame(pairs, "source_id string, target_id string"), rounds=9).collect()
    assert {r.id: r.label for r in got} == plain_labels(pairs, 9)
    whole = [k for k, p in enumerate(plans) if "RepartitionByExpression" in p]
    part = [k for k, p in enumerate(plans) if "LeftOuter" in p]
    assert whole and part and max(whole) < min(part) and len(part) >= 2  # all nodes first, then those touched
