"""The radix sort of suffixes beyond the common cases: colliding hashes, hot anchors, long texts, clashing columns."""

import random

import numpy as np
import pytest

from tests.llm import brute


def texts(n=120):
    """Passages that stand in most texts, after and before texts of their own that partly agree."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(80))
    out = []
    for i in range(n):
        own = " ".join(word() for _ in range(60))
        out.append((i, f"{own}{rng.choice(('. ', '.. ', ' '))}{passage}{rng.choice((' a', ' ab', ''))} {own[:150] if i % 3 else ''}"))
    return [*out, (n, "ab" * 500), (n + 1, out[3][1]), (n + 2, None), (n + 3, "é" * 300), (n + 4, "x" * 99), (n + 5, "x" * 100), (n + 6, "x" * 101)]


def spans_of(df):
    from codeloom.llm.suffixes import dedup_report

    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_report(df).collect()}


@pytest.mark.parametrize("hot", [4096, 5])
def test_passages_in_most_texts(spark, monkeypatch, hot):
    from codeloom.llm import suffixes

    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert spans_of(df) == brute.suffix(rows)


@pytest.mark.parametrize("hot", [4096, 3])
def test_hashes_that_collide_change_nothing(spark, monkeypatch, hot):
    from codeloom.llm import suffixes

    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
    rows = texts(40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r.doc_id: [(s.s, s.e) for s in r.spans] for r in suffixes.repeated_spans(df).collect()}
    got = {r.doc_id: [(s.s, s.e) for s in r.spans] for r in suffixes.repeated_spans(df, hash_bits=3).collect()}

    def covered(spans):
        return {d: sorted({i for s, e in x for i in range(s, e)}) for d, x in spans.items()}

    assert covered(got) == covered(want) and want


def test_windows_are_ordered_by_their_bytes():
    from codeloom.llm.suffixes import repeated_windows

    rng = random.Random(2)
    for window in (3, 8, 12, 100):
        buf = "".join(rng.choices("ab", k=900)).encode() + b"a" * 300
        at = np.arange(len(buf) - window + 1)
        index, group = repeated_windows(buf, at, np.zeros(len(at), np.int64), window)
        found = [buf[i : i + window] for i in index.tolist()]
        assert found == sorted(found)
        want = {}
        for i in at.tolist():
            want.setdefault(buf[i : i + window], []).append(i)
        got = {}
        for i, g in zip(index.tolist(), group.tolist(), strict=True):
            got.setdefault(g, []).append(i)
        assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def test_long_text_and_clashing_columns(spark):
    from codeloom.llm.suffixes import cleaned

    rng = random.Random(4)
    long = "".join(rng.choices("abcdefghij", k=1_300_000))
    rows = [(1, long, "s"), (2, long[600_000:900_000], "s"), (3, "own", "s"), (None, long[:500], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in cleaned(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 300_000 and got[2].n_spans == 1 and bytes(got[2].kept) == b""
    assert got[3].spans == "s" and got[None].n_removed == 0
    clash = spark.createDataFrame([(1, "x" * 150, 5, 6), (2, "x" * 150, 7, 8)], "doc_id long, text string, __place int, kept int")
    assert sorted((r.doc_id, r["__place"], r.n_removed) for r in cleaned(clash).collect()) == [(1, 5, 149), (2, 7, 150)]
