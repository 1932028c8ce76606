"""Whitening, languages and ranked search against plain versions, and on odd rows."""

import math
import random
import re

import numpy as np
import pytest

from tests.llm.test_operators import documents, odd_docs

SF = "/root/testdata/sf0.001"


def plain_whitening(rows, components=4):
    """(x by row, n, S, values, vectors) over the different vectors."""
    x = np.array([[int(np.floor(256 * np.float64(c))) for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return x, n, s, values[::-1][:components], vectors[:, ::-1][:, :components], values.sum()


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_whitening(spark, far):
    from codeloom.llm.whitening import whiten

    rng = random.Random(3)
    rows = [(i, [far + rng.gauss(0, 3) * (6 - j) for j in range(6)]) for i in range(300)]
    rows += [(300, rows[0][1]), (7, rows[7][1]), (None, rows[9][1])]
    bad = [(400, None), (401, [1.0] * 5 + [None]), (402, [float("nan")] * 6), (403, [1.0] * 5 + [float("-inf")])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + bad], "vec_id long, embedding array<double>, n int, whitened double").repartition(3)
    got = whiten(df).collect()
    x, n, s, values, vectors, trace = plain_whitening(rows)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} == {300}
    want = {}
    for (i, _), v in zip(rows, x, strict=True):
        want[i] = (sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)), (v - s / n) @ vectors / np.sqrt(values))
    sign = {}
    for r in got:
        k = r.component - 1
        assert r.deviation == want[r.vec_id][0] and abs(r.explained - values[k] / trace) < 1e-9 and 0 <= r.identity_error < 1e-9
        w = want[r.vec_id][1][k]
        if abs(w) > 1e-3:
            assert sign.setdefault(k, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(w) - abs(r.whitened)) < 1e-6


def test_whitening_without_variance_and_of_odd_vectors(spark):
    from codeloom.llm.whitening import whiten

    kind = "vec_id long, embedding array<double>"
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    line = whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], kind)).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and all(r.identity_error < 1e-12 for r in line)
    short = whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 7.0]), (4, [0.0, -3.0])], kind)).collect()
    assert {r.n for r in short} == {3} and len(short) == 8
    huge = whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], kind)).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id < 3} == {None}
    for empty in ([], [(1, None)], [(1, [])]):
        assert whiten(spark.createDataFrame(empty, kind)).count() == 0


def test_languages_of_held_out_texts(spark):
    from codeloom.llm.languages import language_report

    docs = documents(spark)
    got = {r.doc_id: r for r in language_report(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(lang)
    held = [d for d, r in got.items() if r.held_out]
    assert len(held) > 20 and sum(got[d].lang_pred == lang[d] for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.lang_pred in set(lang.values()) for r in got.values())


def test_vectors_are_normalised_tf_idf_of_all_grams():
    from codeloom.llm import languages as m

    texts = ["Élan vital, a-b!", "", None, "x" * 50, "The the 123"]
    counts = m.gram_counts(texts)
    for row, t in zip(counts, texts, strict=True):
        b = b" " + m.folded(t) + b" "
        grams = [b[i : i + n] for n in m.GRAMS for i in range(len(b) - n + 1)]
        fine = [g for g in grams if (len(g) == 3 and g[1] != 32) or (len(g) < 3 and g.strip())]
        want = np.zeros(m.FEATURES)
        for g in fine:
            key = len(g)
            for c in g:
                key = ((key << 8) & 0xFFFFFFFF) ^ c
            want[(key * 2654435761 & 0xFFFFFFFF) >> (32 - m.FEATURE_BITS)] += 1
        assert (row == want).all()
    long = "abc déf " * 3000
    old, m.STRETCH = m.STRETCH, 1000
    try:
        cut = m.gram_counts([long])
    finally:
        m.STRETCH = old
    assert (cut == m.gram_counts([long])).all()
    v = m.weighted(counts, np.ones(m.FEATURES, np.float32))
    assert np.allclose((v * v).sum(axis=1), [1, 0, 0, 1, 1])


def test_languages_have_several_centroids_and_far_texts_are_rejected(spark):
    from codeloom.llm.languages import identify, train

    docs = documents(spark)
    model = train(docs)
    assert all((model.owner == k).sum() > 1 for k in range(len(model.languages))) and np.allclose((model.rows**2).sum(axis=1), 1, atol=1e-4)
    rows = [(1, "Συντάκτης μεγάλων κειμένων και άλλα πολλά πράγματα " * 5), (2, None), (3, "12 3!"), (4, ""), (5, docs.where("lang = 'fr'").first().text)]
    odd = spark.createDataFrame([(i, t, "q", True) for i, t in rows], "doc_id long, text string, score string, rejected boolean")
    got = {r.doc_id: r for r in identify(odd, model).collect()}
    assert [(got[i].lang_pred, got[i].rejected) for i in range(1, 6)] == [("und", True), ("und", False), ("und", False), ("und", False), ("fr", False)]
    near = {r.doc_id: r for r in identify(odd, model, reject=False).collect()}
    assert near[1].lang_pred in model.languages and near[1].rejected and near[2].score == 0


def test_languages_of_odd_and_empty_tables(spark):
    from codeloom.llm.languages import language_report

    rows, odd = odd_docs(spark)
    got = language_report(odd.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "n", "bands AS lang_pred")).collect()
    assert len(got) == len(rows) and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    taught = language_report(odd.selectExpr("doc_id", "text", "IF(doc_id % 2 = 0, 'a', 'b') AS lang")).collect()
    assert len(taught) == len(rows) and {r.lang_pred for r in taught} == {"a", "b", "und"}
    assert {r.lang_pred for r in taught if r.doc_id in (4, 5, 6)} == {"und"}
    assert language_report(odd.selectExpr("doc_id", "text", "'en' AS lang").limit(0)).count() == 0


def plain_ranking(docs, items, k=10):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").encode().lower())
    held = [(d, words(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, w in held:
            m = 10 + 90 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in df and t in w)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search_on_odd_rows(spark, monkeypatch):
    from codeloom.llm import ranked

    rng = random.Random(4)
    rows, _ = odd_docs(spark)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(d, t) for d, t in rows if d != 12] + [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(400)]
    rows += [rows[30]] * 30 + [(None, rows[31][1]), (None, rows[31][1])]
    items = [(1, "W1 w2,w3"), (1, "w4"), (2, None), (3, ""), (4, "absent"), (None, "w5 w6 w7"), (5, rows[0][1]), (6, "w1é one")] + [(10 + i, " ".join(rng.choices(vocabulary, k=8))) for i in range(30)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, shard string, rank int").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    monkeypatch.setattr(ranked, "SHARD_BYTES", 4000)
    monkeypatch.setattr(ranked, "TILE", 8)
    monkeypatch.setattr(ranked, "SLICE_BYTES", 2000)
    assert sorted(map(tuple, ranked.rank_documents(docs, bench).select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_ranking(rows, items)
    assert ranked.rank_documents(docs.limit(0), bench).count() == 0
    assert ranked.rank_documents(docs, bench.limit(0)).count() == 0


def test_bisection_brings_alike_documents_together():
    from codeloom.llm import ranked

    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat([0, 1], 128))
    terms = [np.unique(rng.integers(0, 300, 40) + 300 * k) for k in topic]
    ptr = np.r_[0, np.cumsum([len(t) for t in terms])]
    a, b = ranked.bisect(ptr, np.concatenate(terms), np.arange(256))
    assert len(a) == len(b) == 128 and len(set(topic[a].tolist())) == 1 and len(set(topic[b].tolist())) == 1
    by = ranked.order(ptr, np.concatenate(terms))
    assert sorted(by.tolist()) == list(range(256)) and len(set(topic[by[:128]].tolist())) == 1


def test_clusters_below_the_floor_are_left_alone():
    import pyarrow as pa
    from collections import Counter

    from codeloom.llm import ranked

    law = ranked.Law(640, 640 * 20)
    texts = [" ".join([f"t{i // 64}", *(f"u{i}_{j}" for j in range(19))]) for i in range(640)]
    row = ranked._shard(pa.table({"shard": pa.array([0] * 640, pa.int64()), "doc_id": pa.array(range(640), pa.int64()), "text": texts}), law).to_pylist()[0]
    queries = ranked.Queries([(1, [b"t3"])])
    queries.weights[:] = 1000
    mine, number = ranked._numbers(row["terms"], queries.terms)
    found, seen = ranked.Found(np.zeros(1, np.int64), 5), Counter()
    bound = ranked.shard_bounds(queries, mine, number, np.frombuffer(row["maxima"], "<i4"))
    ranked.search_shard(queries, found, row | {"mine": mine, "number": number, "doc_ids": np.array(row["doc_ids"])}, bound, seen)
    assert found.doc[0].tolist() == list(range(192, 197)) and seen["pairs"] <= 2
