"""Language of a text, by the nearest of several centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_pieces, pieces, small_batches, tree_merged

#: Places of hashed n-grams, and the lengths of these in bytes.
FEATURE_BITS, GRAMS = 12, (1, 2, 3)
FEATURES = 1 << FEATURE_BITS
#: Centroids of a language, and of all languages together (what is broadcast stays below 32 MB).
CLUSTERS, CENTROIDS = 4, 2048
#: Training texts, those of least hashes, from which the clusters start; shared out among the languages.
START = 2048
#: Rounds over the start, and over all training texts.
START_ROUNDS, ROUNDS = 12, 1
#: Share of training texts that may be farther from their language than the radius, and steps of distances.
BEYOND, STEPS = 0.001, 200
#: Bytes whose n-grams are hashed at once: a longer text is taken part by part.
STRETCH = 4 << 20

_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def folded(text: str | None) -> bytes:
    """Lower-cased letters in UTF-8; every other ASCII character is a space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """How often each place's n-grams stand in each text: a row for each text, over all of it.

    N-grams of three bytes have a letter in the middle, so that they reach over a word's edge by
    one space; those of two bytes have one at least.
    """
    out = np.zeros((len(texts), FEATURES), np.float32)
    joined = [b" " + folded(t) + b" " for t in texts]
    at = 0
    while at < len(joined):
        end, held = at, 0
        while end < len(joined) and (end == at or held + len(joined[end]) <= STRETCH):
            held += len(joined[end])
            end += 1
        buf = np.frombuffer(b"".join(joined[at:end]), np.uint8)
        row = np.repeat(np.arange(end - at), [len(t) for t in joined[at:end]])
        for low in range(0, len(buf), STRETCH):
            _count(out[at:end], buf[low : low + STRETCH + 2], row[low : low + STRETCH + 2], STRETCH)
        at = end
    return out


def _count(out: np.ndarray, buf: np.ndarray, row: np.ndarray, most: int) -> None:
    """Add the n-grams that start in the first `most` bytes; none crosses texts, as each ends in a space."""
    letter = buf != 0x20
    code = buf.astype(np.uint32)
    for n in GRAMS:
        m = min(len(buf) - n + 1, most)
        if m <= 0:
            continue
        key = np.full(m, n, np.uint32)
        for i in range(n):
            key = key << np.uint32(8) ^ code[i : i + m]
        keep = letter[:m] if n == 1 else letter[1 : m + 1] if n == 3 else letter[:m] | letter[1 : m + 1]
        keep = np.flatnonzero(keep & (row[:m] == row[n - 1 : n - 1 + m]))
        place = (key[keep] * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)
        out += np.bincount(row[keep] * FEATURES + place, minlength=out.size)[: out.size].reshape(out.shape)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("nd,nd->n", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of log counts by inverse document frequency; a text without n-grams is all zero."""
    return unit(np.log1p(counts) * idf)


def length_class(counts: np.ndarray) -> np.ndarray:
    """0 to 31: twice the logarithm of the letters, as short texts lie farther off."""
    return np.minimum(np.log2(counts.sum(axis=1) + 1) * 1.5, 31).astype(np.int64)


class Centroids:
    """Unit centroids as rows, the language of each, the places' weights, and for each class of length the distance beyond which a text is of no learned language."""

    def __init__(self, languages: list[str], owner: np.ndarray, rows: np.ndarray, idf: np.ndarray, radius: np.ndarray | None = None):
        self.languages, self.owner, self.rows, self.idf, self.radius = languages, owner, rows, idf, radius

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid's language and its cosine; of equal ones, the first."""
        cosine = vectors @ self.rows.T
        best = cosine.argmax(axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)

    def own(self, vectors: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row's own language, and its cosine."""
        cosine = np.where(self.owner[None, :] == language[:, None], vectors @ self.rows.T, -1.0)
        best = cosine.argmax(axis=1)
        return best, cosine[np.arange(len(best)), best]


def clusters(x: np.ndarray, k: int, rounds: int = START_ROUNDS) -> np.ndarray:
    """At most k unit centroids of unit rows: each starts at the row farthest from those before, then rows and means by turns."""
    centres = unit(x.mean(axis=0, keepdims=True))
    while len(centres) < k:
        cosine = (x @ centres.T).max(axis=1)
        if cosine.min() > 1 - 1e-6:
            break
        centres = np.vstack([centres, x[cosine.argmin()]])
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        centres = unit(np.stack([x[near == j].mean(axis=0) for j in np.unique(near)]))
    return centres


def _rows(batches: Iterator[pa.RecordBatch], text: str, number: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts and language numbers of the texts with letters of a learned language, in pieces."""
    for batch in batches:
        for piece in pieces(batch, text):
            keep = [(t, number[x]) for t, x in zip(piece.column(text).to_pylist(), piece.column("lang").to_pylist(), strict=True) if x in number and has_letter(t)]
            if keep:
                yield gram_counts([t for t, _ in keep]), np.array([n for _, n in keep])


def train(docs: DataFrame, text: str = "text", held_out=None, clusters_each: int = CLUSTERS) -> Centroids | None:
    """Centroids of the languages of docs outside held_out (by default, crc32 of the id modulo 4 is 2).

    Document frequencies are over all training texts. Clusters start from START texts of least
    hashes, an equal share for each language; then ROUNDS passes over all training texts take
    each to its language's nearest centroid and the centroids to their members' means. A last
    pass gathers distances, and the radius of a class of length leaves out the BEYOND farthest.
    Matrices of a row for each centroid are merged in a tree; no text is shuffled.

    Defined cases: rows without a language, and texts that are null or have no letter, teach
    nothing; repeated rows each count; with more than CENTROIDS languages those of most training
    texts are learned; no training rows give None.
    """
    spark = docs.sparkSession
    held_out = crc_mod("doc_id", 4) == 2 if held_out is None else held_out
    rows = docs.where(~F.coalesce(held_out, F.lit(False))).where(F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), text)
    n = rows.where(F.col(text).rlike(r"\p{L}")).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CENTROIDS).collect()
    if not n:
        return None
    languages = sorted(r.lang for r in n)
    number = {x: k for k, x in enumerate(languages)}
    small_batches(spark)
    rows = rows.select("lang", text, F.xxhash64("doc_id", text).alias("hash"))

    def frequencies(batches):
        df, total = np.zeros(FEATURES, np.int64), 0
        for counts, _ in _rows(batches, text, number):
            df += (counts > 0).sum(axis=0)
            total += len(counts)
        return df, total

    df, total = tree_merged(rows.select("lang", text), frequencies, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    model = _start(rows, text, {r.lang: r["count"] for r in n}, languages, number, idf, clusters_each)

    def members(batches):
        sums, size = np.zeros(shared.value.rows.shape), np.zeros(len(shared.value.rows), np.int64)
        for counts, language in _rows(batches, text, number):
            v = weighted(counts, idf)
            best, _ = shared.value.own(v, language)
            one = np.zeros((len(best), len(size)), np.float32)
            one[np.arange(len(best)), best] = 1
            sums += one.T @ v
            size += np.bincount(best, minlength=len(size))
        return sums, size

    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        sums, size = tree_merged(rows.select("lang", text), members, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        model = Centroids(languages, model.owner, np.where((size > 0)[:, None], unit(sums), model.rows).astype(np.float32), idf)

    def distances(batches):
        seen = np.zeros((32, STEPS), np.int64)
        for counts, language in _rows(batches, text, number):
            _, cosine = shared.value.own(weighted(counts, idf), language)
            np.add.at(seen, (length_class(counts), np.clip(((1 - cosine) * STEPS).astype(np.int64), 0, STEPS - 1)), 1)
        return seen

    shared = spark.sparkContext.broadcast(model)
    seen = tree_merged(rows.select("lang", text), distances, np.add)
    return Centroids(languages, model.owner, model.rows, idf, radii(seen))


def radii(seen: np.ndarray) -> np.ndarray:
    """The distance that all but BEYOND of a class's texts keep to; a shorter text's radius is no less than a longer one's, and beyond the longest class with texts that one's holds."""
    within = np.cumsum(seen, axis=1)
    radius = np.where(within[:, -1] > 0, ((within >= np.ceil((1 - BEYOND) * within[:, -1:])).argmax(axis=1) + 1) / STEPS, 0.0)
    last = int(np.flatnonzero(within[:, -1]).max())
    radius[last:] = radius[last]
    return np.maximum.accumulate(radius[::-1])[::-1]


def _start(rows: DataFrame, text: str, sizes: dict[str, int], languages: list[str], number: dict[str, int], idf: np.ndarray, each: int) -> Centroids:
    """Clusters of the texts of least hashes: twice the share is asked for, as a bound on the hash, and the least of it kept."""
    share = max(1, START // len(languages))
    bound = F.create_map(*(F.lit(v) for lang in languages for v in (lang, min(1.0, (2 * share + 20) / sizes[lang]))))
    some = rows.where(F.col(text).rlike(r"\p{L}")).where(F.pmod("hash", F.lit(1 << 30)) < bound[F.col("lang")] * float(1 << 30))
    some = some.orderBy(F.pmod("hash", F.lit(1 << 30)), "hash", "lang").limit(4 * START)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = weighted(gram_counts(batch.column(text).to_pylist()), idf).astype(np.float16)
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array([r.tobytes() for r in v], pa.binary())], names=["lang", "hash", "v"])

    got = map_pieces(some, text, fn, "lang string, hash long, v binary").toArrow()  # 4 * START rows of 8 kB at most
    by: dict[str, list[tuple[int, int, bytes]]] = {}
    for lang, h, v in zip(got.column("lang").to_pylist(), got.column("hash").to_pylist(), got.column("v").to_pylist(), strict=True):
        by.setdefault(lang, []).append((h % (1 << 30), h, v))
    centres, owner = [], []
    for lang in languages:
        if lang in by:
            x = unit(np.frombuffer(b"".join(v for _, _, v in sorted(by[lang])[:share]), np.float16).reshape(-1, FEATURES).astype(np.float32))
            found = clusters(x, max(1, min(each, CENTROIDS // len(languages))))
            centres.append(found)
            owner += [number[lang]] * len(found)
    return Centroids(languages, np.array(owner), np.vstack(centres).astype(np.float32), idf)


def identify(docs: DataFrame, model: Centroids | None, text: str = "text", unknown: str = "und", reject: bool = True) -> DataFrame:
    """docs (all columns) and lang_pred, score, rejected for each whole text; columns of these names are replaced.

    lang_pred is the language of the nearest centroid and score its cosine. A text farther from
    it than the radius of its length is rejected: then lang_pred is `unknown`, or stays the
    nearest language if `reject` is False. Null texts and texts without a letter are `unknown`
    with score 0 and not rejected; so is every text without a model. Only the text enters, so
    that equal texts have equal answers; an empty table gives none.
    """
    added = ("lang_pred", "score", "rejected")
    base = docs.drop(*added)
    kept = {f"c{i}": c for i, c in enumerate(base.columns)}
    base = base.select(*(F.col(f"`{c}`").alias(k) for k, c in kept.items()))
    place = next(k for k, c in kept.items() if c == text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = shared.value, batch.column(place).to_pylist()
        lang, score, far = [unknown] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        some = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
        if some:
            counts = gram_counts([texts[i] for i in some])
            best, cosine = m.nearest(weighted(counts, m.idf))
            beyond = 1 - cosine > m.radius[length_class(counts)]
            score[some], far[some] = cosine, beyond
            for i, k, f in zip(some, best.tolist(), beyond.tolist(), strict=True):
                lang[i] = unknown if f and reject else m.languages[k]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=[*batch.schema.names, *added])

    found = map_pieces(base, place, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", lang_pred string, score double, rejected boolean")
    return found.select(*(F.col(k).alias(c) for k, c in kept.items()), *added)


def language_report(docs: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, lang_pred (the nearest language even if rejected), score, rejected."""
    found = identify(docs.select("doc_id", "text"), train(docs), reject=False)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
