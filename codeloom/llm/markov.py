"""Language-model scores of texts: a hidden Markov model over words, trained by Baum-Welch."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_pieces, pieces, small_batches, text_bytes, tidy, tidy_group, written

#: Latent states, and Baum-Welch passes over all training texts.
STATES, PASSES = 5, 5
#: Words with a symbol of their own (the most frequent); the others emit the symbol of a class.
SYMBOLS, CLASSES = 30_000, 512
#: Words whose counts every task holds (the most frequent); the others' counts are joined.
HELD = 200_000
#: Tokens of a stretch of text whose transfer matrix is computed in step with all others.
CHUNK = 128
#: Tokens that are worked on in step, over the batches of a task (a longer text is a group by itself).
GROUP = 1 << 19
#: Weight, in tokens, of the words' overall shares in a state's emissions.
PRIOR = 50.0
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000

END = ""  # the end of a text, counted as a token; no word is empty


def class_of(word: bytes) -> int:
    """The class of a word without a symbol of its own: its last three characters, hashed."""
    return zlib.crc32(word[-3:] if word.isascii() else word.decode("utf-8", "replace")[-3:].encode()) % CLASSES


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and c, over all words and ends of all texts; counted in tasks before they are shuffled."""
    small_batches(docs.sparkSession)

    def run(batches):
        counts: Counter = Counter()
        ends = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for piece in pieces(batch, text):
                for t in text_bytes(piece.column(text)):
                    counts.update(t.lower().split())
                    ends += 1
                if len(counts) >= COUNTED:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], names=["word", "c"])

    return docs.select(text).mapInArrow(tidy(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """Start and transition probabilities, and emissions by symbol, each over its greatest (whose logarithm is kept)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit  # emit: symbols x states
        most = emit.max(axis=1)
        self.scaled, self.log_most = emit / most[:, None], np.log(most)


class Texts:
    """Symbol sequences cut into chunks, which are worked on in step; arrays have states first, so that each step runs along all chunks."""

    def __init__(self, sequences: list[np.ndarray]):
        size = np.array([len(s) for s in sequences], np.int64)
        chunks = -(-size // CHUNK)
        self.text = np.repeat(np.arange(len(size)), chunks)
        self.nth = np.arange(len(self.text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        self.size = np.minimum(size[self.text] - self.nth * CHUNK, CHUNK)
        begin = np.repeat(np.cumsum(size) - size, chunks) + self.nth * CHUNK
        # Full chunks first: those that still have a t-th token are then a prefix.
        order = np.argsort(-self.size, kind="stable")
        self.text, self.nth, self.size, begin = self.text[order], self.nth[order], self.size[order], begin[order]
        self.live = np.searchsorted(-self.size, -np.arange(CHUNK), "left")  # chunks of over t tokens
        self.live = self.live[: np.count_nonzero(self.live)]
        self.at = np.concatenate(([0], np.cumsum(self.live)))  # where the t-th tokens stand in what follows
        flat = np.concatenate([*sequences, np.zeros(0, np.int32)])
        self.symbols = np.concatenate([*(flat[begin[:n] + t] for t, n in enumerate(self.live)), np.zeros(0, np.int32)]).astype(np.int64)
        self.first, self.rest = np.flatnonzero(self.nth == 0), np.flatnonzero(self.nth)
        self.n = len(sequences)
        self.rounds = []  # the nth chunks of all texts that have so many, from the second on
        by = self.rest[np.argsort(self.nth[self.rest], kind="stable")]
        if len(by):
            self.rounds = np.split(by, np.flatnonzero(np.diff(self.nth[by])) + 1)

    def emitted(self, m: Model) -> np.ndarray:
        """The scaled emissions of all tokens, states x tokens."""
        out = np.empty((len(m.start), len(self.symbols)))
        for row, of_state in zip(out, m.scaled.T, strict=True):
            np.take(np.ascontiguousarray(of_state), self.symbols, out=row, mode="clip")
        return out

    def transfer(self, m: Model, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk but the texts' first ones: the product of (transition, emission) matrices, scaled, and the logarithm of its scale (emissions' greatest left out)."""
        k, rest = len(m.start), self.rest
        out, log = np.repeat(m.step[:, :, None], len(rest), axis=2), np.zeros(len(rest))
        step = np.ascontiguousarray(m.step.T)
        for t in range(len(self.live)):
            n = np.searchsorted(rest, self.live[t])
            if not n:
                break
            now = out[:, :, :n]
            if t:
                now = np.matmul(step, now)
            np.multiply(now, emitted[:, self.at[t] + rest[:n]], out=out[:, :, :n])
            if t % 8 == 7:
                s = out[:, :, :n].max(axis=(0, 1))
                out[:, :, :n] /= s
                log[:n] += np.log(s)
        return out, log

    def states(self, m: Model, emitted: np.ndarray, before: np.ndarray, chunks: np.ndarray, keep: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """The scaled forward recursion inside some chunks (indices, ascending) from the states `before` their first token, with its transition: all states, if they are to be kept (of all chunks), the last ones, and the logarithms of the scales."""
        step = np.ascontiguousarray(m.step.T)
        whole = len(chunks) == len(self.text)
        alpha = np.empty_like(emitted) if keep else None
        last, log = before.copy(), np.zeros(len(chunks))
        for t in range(len(self.live)):
            n = self.live[t] if whole else np.searchsorted(chunks, self.live[t])
            if not n:
                break
            b = emitted[:, self.at[t] : self.at[t] + n] if whole else emitted[:, self.at[t] + chunks[:n]]
            now = alpha[:, self.at[t] : self.at[t] + n] if keep else last[:, :n]
            np.multiply(step @ last[:, :n] if t else last[:, :n], b, out=now)
            if t % 8 == 7:
                s = now.sum(axis=0)
                now /= s
                log[:n] += np.log(s)
            if keep:
                last = now
        return alpha, last, log

    def _scales(self, m: Model) -> np.ndarray:
        """The logarithms of the emissions' greatest, summed for each text."""
        out = np.zeros(self.n)
        most = m.log_most[self.symbols]
        for t, n in enumerate(self.live):
            out += np.bincount(self.text[:n], most[self.at[t] : self.at[t + 1]], minlength=self.n)
        return out

    def _chunks(self, m: Model, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' natural log likelihoods; the state before each chunk's first token (with its transition, a first chunk's start); the matrices of all chunks but the first."""
        k = len(m.start)
        matrix, log = self.transfer(m, emitted)
        before = np.empty((k, len(self.text)))
        before[:, self.first] = m.start[:, None]
        _, last, scale = self.states(m, emitted, before[:, self.first], self.first, False)
        v, like = np.empty((k, self.n)), self._scales(m)
        texts = self.text[self.first]
        s = last.sum(axis=0)
        v[:, texts] = last / s
        like[texts] += np.log(s) + scale
        place = np.empty(len(self.text), np.int64)
        place[self.rest] = np.arange(len(self.rest))
        self.place = place
        for some in self.rounds:
            t = self.text[some]
            before[:, some] = v[:, t]
            now = np.einsum("kn,kjn->jn", v[:, t], matrix[:, :, place[some]])
            s = now.sum(axis=0)
            v[:, t] = now / s
            like[t] += np.log(s) + log[place[some]]
        return like, before, matrix

    def forward(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' natural log likelihoods by the scaled forward recursion over chunks; the state before each chunk; the matrices."""
        return self._chunks(m, self.emitted(m))

    def expect(self, m: Model) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood, and expected counts of starts, transitions and emissions."""
        k = len(m.start)
        emitted = self.emitted(m)
        like, before, matrix = self._chunks(m, emitted)
        after = np.ones((k, len(self.text)))
        u = np.ones((k, self.n))
        for some in reversed(self.rounds):
            t = self.text[some]
            after[:, some] = u[:, t]
            now = np.einsum("kjn,jn->kn", matrix[:, :, self.place[some]], u[:, t])
            u[:, t] = now / now.sum(axis=0)
        after[:, self.first] = u[:, self.text[self.first]]
        entry = before.copy()
        entry[:, self.rest] = m.step.T @ before[:, self.rest]
        alpha = self.states(m, emitted, entry, np.arange(len(self.text)), True)[0]
        # Backward: alpha becomes the states' probabilities. A token's beta times its alpha sums to what divides both them and the transition to the next token.
        step, steps = np.ascontiguousarray(m.step), np.zeros((k, k))
        beta, done = after, 0  # the chunks whose last token has been passed are a prefix
        for t in range(len(self.live) - 1, -1, -1):
            n, a = self.live[t], alpha[:, self.at[t] : self.at[t + 1]]
            if done:
                w = emitted[:, self.at[t + 1] : self.at[t + 2]] * beta[:, :done]
                beta[:, :done] = step @ w
            total = np.einsum("kn,kn->n", a, beta[:, :n])
            a /= total
            if done:
                steps += a[:, :done] @ w.T
            a *= beta[:, :n]
            if t % 8 == 0:
                beta[:, :n] /= beta[:, :n].sum(axis=0)
            done = n
        if len(self.rest):
            w = emitted[:, self.rest] * beta[:, self.rest]
            prev = before[:, self.rest]
            steps += (prev / np.einsum("kn,kn->n", prev, step @ w)) @ w.T
        start = alpha[:, self.first].sum(axis=1)
        counts = np.empty_like(m.emit)
        for j in range(k):
            counts[:, j] = np.bincount(self.symbols, alpha[j], minlength=len(counts))
        return float(like.sum()), start, steps * m.step, counts


def maximised(start: np.ndarray, steps: np.ndarray, counts: np.ndarray) -> Model:
    """The model of expected counts; the symbols' overall shares smooth each state's emissions."""
    share = counts.sum(axis=1) + 0.5
    share /= share.sum()
    emit = counts + PRIOR * share[:, None]
    return Model((start + 1) / (start + 1).sum(), (steps + 1) / (steps + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def starting_point(counts: np.ndarray, states: int, seed: int = 5) -> Model:
    """Where the passes start: the counts of all training tokens by symbol, shared out to the states at random."""
    rng = np.random.default_rng(seed)
    return maximised(np.ones(states), np.ones((states, states)) + 50 * np.eye(states), counts[:, None] * rng.gamma(2.0, 1.0, (len(counts), states)))


class Lexicon:
    """What every task knows of the words: symbols and counts of frequent ones, totals of the classes."""

    def __init__(self, held: list[tuple[str, int]], classes: dict[int, tuple[int, int]], tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        words = [(w.encode(), c) for w, c in held]
        self.end_count = next((c for w, c in words if not w), 0)
        words = [x for x in words if x[0]]
        self.n_symbols = min(SYMBOLS, len(words))
        self.end = self.n_symbols
        self.number = {w: i for i, (w, _) in enumerate(words)}
        self.symbol = np.array([i if i < self.n_symbols else self.end + 1 + class_of(w) for i, (w, _) in enumerate(words)], np.int32)
        self.log = np.log10(np.array([c for _, c in words], np.float64) + 1)
        size = np.zeros(CLASSES)
        for k, (n, v) in classes.items():
            size[k] = n + v
        for w, c in words[: self.n_symbols]:
            size[class_of(w)] -= c + 1
        self.class_log = np.log10(size + 1)  # of the denominator in a class's add-one shares
        self.all_symbols = self.end + 1 + CLASSES
        self.counts = np.zeros(self.all_symbols)  # of all training tokens
        self.counts[: self.n_symbols] = [c for _, c in words[: self.n_symbols]]
        self.counts[self.end] = self.end_count
        for k, (n, _) in classes.items():
            self.counts[self.end + 1 + k] = n
        for w, c in words[: self.n_symbols]:
            self.counts[self.end + 1 + class_of(w)] -= c

    def encode(self, text: bytes) -> tuple[np.ndarray, float, int, float, Counter]:
        """Symbols with the end; of words that are held, the summed log10(c + 1) and number; the log10 of the classed words' shares, but for the other words' log10(c + 1); the other words."""
        words = text.lower().split()
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        known = at >= 0
        out = np.empty(len(words) + 1, np.int32)
        out[-1] = self.end
        out[:-1][known] = self.symbol[at[known]]
        others = np.flatnonzero(~known)
        unheld = [words[i] for i in others.tolist()]
        out[others] = np.fromiter(map(class_of, unheld), np.int32, len(unheld)) + (self.end + 1)
        rest = Counter(unheld)
        logs = float(self.log[at[known]].sum()) + math.log10(self.end_count + 1)
        classed = out > self.end
        share = float(self.log[at[known & classed[:-1]]].sum() - self.class_log[out[classed] - self.end - 1].sum())
        return out, logs, int(known.sum()) + (self.end_count > 0), share, rest


ENCODED = "rid long, doc_id long, held_out boolean, symbols array<int>, logs double, n_known long, class_logs double, words array<string>, ns array<int>"


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def _encoded(docs: DataFrame, lexicon: Lexicon, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        nth = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in pieces(batch, text):
                found = [shared.value.encode(t) for t in text_bytes(piece.column(text))]
                symbols, others = _offsets([len(f[0]) for f in found]), _offsets([len(f[4]) for f in found])
                words, ns = pa.array([w for f in found for w in f[4]], pa.binary()).cast(pa.string()), pa.array([n for f in found for n in f[4].values()], pa.int32())
                cols = [
                    pa.array(range(nth, nth + len(found)), pa.int64()), piece.column("doc_id"), piece.column("held_out"), pa.ListArray.from_arrays(symbols, pa.array(np.concatenate([f[0] for f in found]))),
                    pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64()),
                    pa.ListArray.from_arrays(others, words), pa.ListArray.from_arrays(others, ns),
                ]
                nth += len(found)
                yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "held_out", "symbols", "logs", "n_known", "class_logs", "words", "ns"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "held_out", text).mapInArrow(tidy(run), ENCODED)


def _sequences(col) -> list[np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off, flat = col.offsets.to_numpy(), col.values.to_numpy()
    return [flat[a:b] for a, b in zip(off, off[1:], strict=False)]


def _gathered(batches):
    """Batches joined to tables of about GROUP symbols at least, so that many texts are worked on in step."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("symbols").flatten())
        if n >= GROUP:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _groups(sequences: list[np.ndarray], tokens: int = GROUP):
    """Runs of sequences of about so many tokens."""
    start, held = 0, 0
    for i, s in enumerate(sequences):
        held += len(s)
        if held >= tokens:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sequences):
        yield start, len(sequences)


def baum_welch(encoded: DataFrame, model: Model) -> tuple[Model, float]:
    """One pass: expected counts of all sequences, summed in tasks, then across them in blocks of symbols; the new model comes to the driver."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    block = 1024

    def run(batches):
        m = shared.value
        start, steps, counts, like = np.zeros_like(m.start), np.zeros_like(m.step), np.zeros_like(m.emit), 0.0
        for table in _gathered(batches):
            seqs = _sequences(table.column("symbols"))
            for a, b in _groups(seqs):
                found = Texts(seqs[a:b]).expect(m)
                like += found[0]
                start += found[1]
                steps += found[2]
                counts += found[3]
        rows = [(-1, np.concatenate(([like], start, steps.ravel())))] + [(i // block, counts[i : i + block].ravel()) for i in range(0, len(counts), block)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].astype("<f8").tobytes() for r in rows], pa.binary())], names=["block", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f8") for x in t.column("sums").to_pylist())
        return pa.table({"block": t.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    got = {r.block: np.frombuffer(bytes(r.sums), "<f8") for r in encoded.select("symbols").mapInArrow(tidy(run), "block int, sums binary").groupBy("block").applyInArrow(tidy_group(add), "block int, sums binary").collect()}
    k = len(model.start)
    if -1 not in got:
        return model, 0.0
    head = got.pop(-1)
    counts = np.concatenate([got[i] for i in sorted(got)]).reshape(-1, k)
    return maximised(head[1 : 1 + k], head[1 + k :].reshape(k, k), counts), float(head[0])


def language_scores(docs: DataFrame, held_out=None, text: str = "text", states: int = STATES) -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Tokens are words of the lower-cased (A-Z) text, and its end. Counts over all training texts
    (not held out; by default held_out is crc32 of the id modulo 7 equal 2) give the base score,
    an add-one unigram. The score is a hidden Markov model's: states emit symbols, which are the
    SYMBOLS most frequent words, the end, and classes of all other words; a word of a class has an
    add-one share of it by its own count. Baum-Welch starts from the counts of all training tokens,
    shared out to the states at random, and takes PASSES passes over all training texts. The forward recursion runs over whole texts: chunks'
    transfer matrices in step, then chunk by chunk, scaled.

    A task holds the counts of the HELD most frequent words; the remaining ones of each text are
    joined to the counts by word. Texts are encoded once, to the shared folder.

    Defined cases: a null or empty text has one token, its end; rows are scored each by itself,
    whatever their ids; a null id is not held out; without training texts every count is 0.
    """
    spark = docs.sparkSession
    held_out = crc_mod("doc_id", 7) == 2 if held_out is None else held_out
    base = docs.select("doc_id", text, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = written(word_counts(base.where("not held_out"), text), "counts")
    stat = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    held = [(r.word, r.c) for r in counts.orderBy(F.desc("c"), "word").limit(HELD).toLocalIterator()]
    kind = (F.crc32(F.expr("right(word, 3)")) % CLASSES).cast("int")
    classes = {r.k: (r.n, r.v) for r in counts.where(F.col("word") != END).groupBy(kind.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    lexicon = Lexicon(held, classes, stat.n, stat.v)
    encoded = written(_encoded(base, lexicon, text), "encoded")

    trained = encoded.where("not held_out")
    model = starting_point(lexicon.counts, states)
    for _ in range(PASSES):
        model, _like = baum_welch(trained, model)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for table in _gathered(batches):
            seqs = _sequences(table.column("symbols"))
            like = [Texts(seqs[a:b]).forward(shared.value)[0] for a, b in _groups(seqs)]
            held = {c: table.column(c).combine_chunks() for c in ("rid", "doc_id", "held_out", "logs", "n_known", "class_logs")}
            cols = [*(held[c] for c in ("rid", "doc_id", "held_out")), pa.array([len(s) for s in seqs], pa.int64()), *(held[c] for c in ("logs", "n_known", "class_logs")), pa.array(np.concatenate([*like, np.zeros(0)]) / math.log(10))]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "held_out", "n_tokens", "logs", "n_known", "class_logs", "hidden"])

    scored = encoded.select("rid", "doc_id", "held_out", "symbols", "logs", "n_known", "class_logs").mapInArrow(tidy(run), "rid long, doc_id long, held_out boolean, n_tokens long, logs double, n_known long, class_logs double, hidden double")
    rest = encoded.select("rid", F.explode(F.arrays_zip("words", "ns")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.ns").alias("k"))
    found = rest.join(counts, "word").groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum("k").alias("known"))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return scored.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(stat.n)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(stat.n + stat.v + 1)).alias("base_score"), (F.col("hidden") + F.col("class_logs") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
