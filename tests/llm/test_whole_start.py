"""The hidden Markov model's start comes from all training texts."""

import random

import numpy as np

from codeloom.llm import markov


def test_the_start_does_not_depend_on_a_sample(spark, monkeypatch):
    rng = random.Random(3)
    words = [[f"{c}{i}" for i in range(8)] for c in "abc"]
    docs = spark.createDataFrame([(d, " ".join(rng.choice(words[d % 3]) for _ in range(30))) for d in range(40)], "doc_id long, text string")
    monkeypatch.setattr(markov, "SYMBOLS", 20)
    monkeypatch.setattr(markov, "PASSES", 1)
    scores = []
    for tokens in (1, 10**9):
        monkeypatch.setattr(markov, "START_TOKENS", tokens, raising=False)
        scores.append([r.score for r in markov.language_scores(docs).orderBy("doc_id").collect()])
    np.testing.assert_allclose(*scores, rtol=1e-9)


def test_the_lexicon_counts_all_training_tokens():
    lexicon = markov.Lexicon([("x", 5), ("", 4), ("yy", 2)], {markov.class_of(b"x"): (5, 1), markov.class_of(b"yy"): (2, 1), markov.class_of(b"zzz"): (1, 1)}, 12, 4)
    assert lexicon.counts.sum() == 12 and lexicon.counts[lexicon.end] == 4 and lexicon.counts[0] == 5 and lexicon.counts[lexicon.end + 1 + markov.class_of(b"zzz")] >= 1
