"""Training works on the texts of many batches in step."""

import numpy as np
import pyarrow as pa

from codeloom.llm import markov


def test_batches_are_joined_to_groups_of_many_texts():
    batches = [pa.RecordBatch.from_arrays([pa.array([[i] * 1000, [i, 7]], pa.list_(pa.int32()))], names=["symbols"]) for i in range(2000)]
    tables = list(markov._gathered(iter(batches)))
    assert len(tables) == 4 and sum(t.num_rows for t in tables) == 4000
    assert all(sum(map(len, markov._sequences(t.column("symbols")))) >= markov.GROUP for t in tables[:-1])
    assert [s[0] for t in tables for s in markov._sequences(t.column("symbols"))] == [i for i in range(2000) for _ in range(2)]


def test_counts_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    model = markov.starting_point(rng.integers(1, 90, 50).astype(float), 5)
    sequences = [rng.integers(0, 50, n).astype(np.int32) for n in (1, 2, 127, 128, 129, 300, 1, 2000, 256)]
    monkeypatch.setattr(markov, "CHUNK", 4000)
    like, want = markov.Texts(sequences).forward(model)[0], markov.Texts(sequences).expect(model)
    for chunk in (1, 7, 8, 9, 128):
        monkeypatch.setattr(markov, "CHUNK", chunk)
        np.testing.assert_allclose(markov.Texts(sequences).forward(model)[0], like, rtol=1e-10)
        for a, b in zip(markov.Texts(sequences).expect(model), want, strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-9)
    assert abs(want[3].sum() - sum(map(len, sequences))) < 1e-6
