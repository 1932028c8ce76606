"""Text quality by a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_pieces, text_bytes, written

#: Hashed words, and the statistics' buckets behind them.
WORDS = 1 << 16
#: Statistics of a text, each cut into STEPS buckets.
STATS = ("letters", "digits", "upper", "marks", "space", "words", "word_length", "repeated", "top_word", "stutter", "lines", "repeated_lines", "mark_ends", "non_ascii", "bytes")
STEPS = 12
FEATURES = WORDS + len(STATS) * STEPS
#: Pairwise factors of each feature.
RANK = 4
#: Labelled texts that the model is fitted on at most: those of lowest hash, in the labels' own proportion.
SAMPLE = 10_000
#: Features that these may have in all (12 bytes each on the driver).
SAMPLE_PLACES = 1 << 23
#: Passes over the sample, its mini-batches' rows, the step size and the penalty.
EPOCHS, ROWS, STEP, PENALTY = 6, 64, 0.08, 1e-5
#: Share by which the words and the statistics enter the squared norm of a text's features.
WORD_SHARE = 0.5

_KINDS = np.zeros(256, np.int64)
_KINDS[[*range(0x61, 0x7B)]] = 1
_KINDS[[*range(0x41, 0x5B)]] = 2
_KINDS[[*range(0x30, 0x3A)]] = 3
_KINDS[[0x20, *range(0x09, 0x0E)]] = 4
_KINDS[0x80:] = 5

_places: dict[bytes, int] = {}


def _place(word: bytes) -> int:
    p = _places.get(word)
    if p is None:
        if len(_places) > 300_000:
            _places.clear()
        p = _places[word] = zlib.crc32(word) % WORDS
    return p


def statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Shares between 0 and 1 (lengths by logarithm) that don't depend on the language or the topic."""
    n = len(text)
    if not n:
        return [0.0] * len(STATS)
    kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=6) / n
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    letters = kinds[1] + kinds[2] + kinds[5]
    return [
        letters,
        kinds[3],
        kinds[2] / letters if letters else 0.0,
        kinds[0],
        kinds[4],
        min(1.0, math.log1p(m) / 12),
        min(1.0, n / m / 20),
        (len(words) - len(counts)) / (m + 4),  # what repeats, drawn to 0 for short texts
        (max(counts.values(), default=1) - 1) / (m + 4),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / (m + 4),
        min(1.0, math.log1p(k) / 10),
        (len(lines) - len(set(lines))) / (k + 1),
        sum(not (w[-1:].isalnum() or w[-1] > 127) for w in words) / m,
        kinds[5],
        min(1.0, math.log1p(n) / 16),
    ]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features: its whole text's words by log count, scaled to a norm, and one bucket of each statistic."""
    words = text.split()
    counts = Counter(words)
    by: dict[int, float] = {}
    for w, n in counts.items():
        p = _place(w)
        by[p] = by.get(p, 0) + n
    places = np.fromiter(by, np.int64, len(by))
    values = np.log1p(np.fromiter(by.values(), np.float64, len(by)))
    norm = math.sqrt(float(values @ values)) or 1.0
    values = values / norm * math.sqrt(WORD_SHARE)
    stats = np.array(statistics(text, words, counts))
    steps = np.minimum((stats * STEPS).astype(np.int64), STEPS - 1)
    return np.concatenate((places, WORDS + np.arange(len(STATS)) * STEPS + steps)), np.concatenate((values, np.full(len(STATS), math.sqrt((1 - WORD_SHARE) * 4 / len(STATS)))))


class Machine:
    """w0 + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j, with the pairs in linear time:
    half of the factors' (sum v x)^2 - sum v^2 x^2."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, places: np.ndarray, values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows that start at begin: the machine's value, and the factors' sums. No row is empty."""
        vx = self.v[places] * values[:, None]
        sums = np.add.reduceat(vx, begin)
        squares = np.add.reduceat(vx * vx, begin)
        return self.w0 + np.add.reduceat(self.w[places] * values, begin) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, places: np.ndarray, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(places, values, begin)[0], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> Machine:
    """Logistic loss by adaptive gradient steps over mini-batches."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, RANK)))
    gw, gv, g0 = np.full(FEATURES, 1e-3), np.full((FEATURES, RANK), 1e-3), 1e-3
    n = len(labels)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, ROWS):
            pick = order[at : at + ROWS]
            size = np.array([len(rows[i][0]) for i in pick])
            begin = np.cumsum(size) - size
            places = np.concatenate([rows[i][0] for i in pick])
            values = np.concatenate([rows[i][1] for i in pick])
            raw, sums = m.raw(places, values, begin)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
            e = np.repeat(err, size)
            used, inverse = np.unique(places, return_inverse=True)
            dw = np.bincount(inverse, e * values) + PENALTY * m.w[used]
            part = (e * values)[:, None] * (np.repeat(sums, size, axis=0) - m.v[places] * values[:, None])
            dv = np.stack([np.bincount(inverse, part[:, f]) for f in range(RANK)], axis=1) + PENALTY * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += float(err.sum()) ** 2
            m.w[used] -= STEP * dw / np.sqrt(gw[used])
            m.v[used] -= STEP * dv / np.sqrt(gv[used])
            m.w0 -= STEP * float(err.sum()) / math.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, text: str = "text", held_out=None) -> Machine | None:
    """A machine fitted to labelled texts outside held_out (by default, crc32 of the id modulo 4 is 2).

    The SAMPLE labelled documents of lowest hash are taken (all, if fewer), as far as their
    features stay below SAMPLE_PLACES in all: their ids first, from the labels alone, then their
    texts by a join with that bounded list. Executors turn them into features, the driver fits.
    With one label only, there is no machine.

    Defined cases: null texts count as empty; labels of no document, of a null doc_id or other
    than 0 and 1 don't count; of several labels of a document the greater counts; rows of one
    doc_id are each learned from; no rows or no labels give no machine.
    """
    held_out = crc_mod("doc_id", 4) == 2 if held_out is None else held_out
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    ids = docs.sparkSession.createDataFrame(ids.toPandas().astype({"doc_id": "int64", "quality": "int32"}), "doc_id long, quality int")  # SAMPLE rows at most

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in text_bytes(batch.column(text))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
            names=["doc_id", "quality", "places", "values"],
        )

    rows = map_pieces(docs.select("doc_id", text).join(F.broadcast(ids), "doc_id"), text, fn, "doc_id long, quality int, places array<int>, values array<float>")
    rows = written(rows, "features")
    sizes = [(r.doc_id, r.n) for r in rows.groupBy("doc_id").agg(F.sum(F.size("places")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]  # SAMPLE rows at most
    held = np.cumsum([n for _, n in sizes]) <= SAMPLE_PLACES
    if not held.all():
        few = docs.sparkSession.createDataFrame([(d,) for (d, _), h in zip(sizes, held, strict=True) if h], "doc_id long")
        rows = rows.join(F.broadcast(few), "doc_id", "left_semi")
    got = rows.orderBy("doc_id").toArrow()
    y = got.column("quality").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None

    def arrays(name):
        col = got.column(name).combine_chunks()
        off = col.offsets.to_numpy()
        flat = col.values.to_numpy()
        return [flat[a:b] for a, b in zip(off, off[1:], strict=False)]

    return fit(list(zip([p.astype(np.int64) for p in arrays("places")], [v.astype(np.float64) for v in arrays("values")], strict=True)), y)


def score_quality(docs: DataFrame, machine: Machine | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs (all columns) and the score of each whole text; a column of that name is replaced.

    Only the text enters. Null counts as empty; without a machine every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    base = docs.drop(out)
    names = base.columns

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in text_bytes(batch.column(text))]
        if shared.value is None or not found:
            score = np.full(len(found), 0.5)
        else:
            size = np.array([len(p) for p, _ in found])
            score = shared.value.score(np.concatenate([p for p, _ in found]), np.concatenate([v for _, v in found]), np.cumsum(size) - size)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, out])

    return map_pieces(base, text, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{out}` double")


def quality_report(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """Per document doc_id, held_out, score, predicted (1 from a score of `least` on)."""
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
