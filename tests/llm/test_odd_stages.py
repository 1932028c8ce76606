"""Every stage of the pipeline on nulls, repeats, clashing columns and empty tables."""

import pytest

from tests.llm.test_operators import odd_docs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", range(5))
def test_stage_bears_odd_rows(spark, n):
    import corpus_pipeline as p

    rows, odd = odd_docs(spark)
    odd = odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "n AS score", "bands AS items", "n_words AS n_hit", "kept AS spans")
    name, stage = p.STAGES[n]
    got = stage(spark, odd, SF)
    if name != "tokens":
        assert got.columns == odd.columns
        assert {(r.score, r["items"], r.spans) for r in got.collect()} <= {(1, "p", True)}
    if name in ("secrets", "tokens"):
        assert got.count() == len(rows)
    if name == "near_duplicates":
        ids = [r.doc_id for r in got.collect()]
        assert 1 in ids and 2 not in ids and None in ids and 4 in ids and 5 in ids
    assert stage(spark, odd.limit(0), SF).count() == 0
