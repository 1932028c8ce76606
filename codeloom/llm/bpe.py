"""Byte-level BPE by replaying the merges over a corpus of words, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, pieces, small_batches, tidy, written

#: Words of the corpus that are replayed once and broadcast with their ids (64 characters each at most): the most frequent ones.
COMMON = 200_000
#: Distinct words that a task counts before it hands them on.
TALLIED = 400_000
#: Distinct rarer words whose ids a worker remembers: as many recent ones again before they are forgotten.
REMEMBERED = 50_000
#: Longer words are encoded each time, so that what a worker remembers stays small.
LONGEST_REMEMBERED = 64
#: Longer words (in bytes) take a queue; sweeps over them would be many.
SWEPT_BYTES = 64
#: Stands for a pair that makes no token.
NO_RANK = np.iinfo(np.int64).max
#: Stands between words in the array of symbols; no rank is as high.
EDGE = 1 << 31

_codecs: dict[int, Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Common(dict):
    """Ids of common words; of another word, those that the codec remembers."""

    def __missing__(self, word: str) -> bytes:
        return self.codec.known[word]


class Codec:
    """Encodes many distinct words at once.

    All words lie in one array of symbols. An inverted index tells, for each pair of tokens, where
    it stands and which rank it makes; pairs of the lowest rank are merged at all their
    positions, from left to right, and only the pairs with the two touched neighbours are indexed
    anew. Words don't affect one another, and within a word the lowest rank goes first and the
    leftmost of equals: the order that the rank files define. So the merges of many short words
    are applied in sweeps, each of which takes every word's lowest rank (see swept); in long
    words, a queue gives the lowest rank of all (see queued).
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            token[r] = t
        self.flat = np.frombuffer(b"".join(token), np.uint8)
        self.sizes = np.array([len(t) for t in token], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        #: Rank of the token that two adjacent tokens make, by first << 32 | second.
        self.pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.byte_array = np.array(self.byte_ids, np.int64)
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.source: tuple[pa.Array, pa.Array] | None = None
        self.knows((pa.array([], pa.string()), pa.array([], pa.binary())))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, shared: Broadcast) -> Codec:
        """The codec of a broadcast vocabulary; a worker process keeps the last one over its tasks."""
        key = hash(frozenset(shared.value.items()))
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = cls(shared.value)
        return _codecs[key]

    def knows(self, source: tuple[pa.Array, pa.Array]) -> None:
        """Take the common words and their ids, unless they are those held already."""
        if self.source is not source:
            self.source, self.common = source, Common(zip(source[0].to_pylist(), source[1].to_pylist(), strict=True))
            self.common.codec = self

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers. A word that is itself a token stays whole, whether or not merges lead to it."""
        out = [b""] * len(words)
        short, long = [], []
        for k, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[k] = r.to_bytes(4, "little")
            elif w:
                (short if len(w) <= SWEPT_BYTES else long).append(k)
        for some, merged in ((short, self.swept), (long, self.queued)):
            for k, x in zip(some, merged([words[k] for k in some]), strict=True):
                out[k] = x
        return out

    def swept(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words. The index is an array: the rank that each position makes with its right neighbour."""
        if not words:
            return []
        sym = self.byte_array[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        made = self.made(sym[:-1], sym[1:])
        made[word[:-1] != word[1:]] = NO_RANK
        made = np.append(made, NO_RANK)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(made, first), np.diff(np.r_[first, len(word)]))
            live = least < NO_RANK
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, made, least = sym[live], word[live], made[live], least[live]
                if not len(sym):
                    break
            merge = made == least
            chained = np.flatnonzero(merge[1:] & merge[:-1]) + 1
            if len(chained):  # overlapping pairs: every other one from the left
                at = np.flatnonzero(merge)
                head = np.r_[True, np.diff(at) != 1]
                merge[at[(np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))) % 2 == 1]] = False
            sym[merge] = least[merge]
            keep = np.r_[True, ~merge[:-1]]
            at = (np.cumsum(keep) - 1)[merge]
            sym, word, made = sym[keep], word[keep], made[keep]
            touched = np.unique(np.concatenate((at, at[at > 0] - 1)))
            right = np.minimum(touched + 1, len(sym) - 1)
            new = self.made(sym[touched], sym[right])
            new[(right == touched) | (word[right] != word[touched])] = NO_RANK
            made[touched] = new
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        ids = ids[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(of, minlength=len(words))) * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks that pairs of tokens make, or NO_RANK."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def queued(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of any length, whose symbols are linked to their neighbours."""
        out = [b""] * len(words)
        sym: list[int] = [EDGE]
        begin: list[tuple[int, int]] = []
        ids = self.byte_ids
        for k, w in enumerate(words):
            begin.append((k, len(sym)))
            sym += [ids[b] for b in w]
            sym.append(EDGE)
        n, get = len(sym), self.pairs.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        made = [a << 32 | b for a, b in zip(sym, sym[1:], strict=False)]  # the pair of each position and its right neighbour
        made.append(-1)
        index: dict[int, list[int]] = {}
        of_rank: dict[int, list[int]] = {}
        for i, pair in enumerate(made):
            if pair in index:
                index[pair].append(i)
            elif (r := get(pair, -1)) >= 0:
                index[pair] = [i]
                of_rank.setdefault(r, []).append(pair)
        queue = list(of_rank)
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            rank = pop(queue)
            pairs = of_rank.pop(rank)
            if len(pairs) == 1:
                places = index.pop(pairs[0])
                places.sort()
            else:
                pairs = set(pairs)
                places = sorted(i for p in pairs for i in index.pop(p))
            high = rank << 32
            for i in places:
                if made[i] not in pairs:  # touched since it was indexed
                    continue
                j = right[i]
                k = right[i] = right[j]
                left[k] = i
                sym[i] = rank
                made[j] = -1
                pair = made[i] = high | sym[k]
                if pair in index:
                    index[pair].append(i)
                elif (r := get(pair, -1)) >= 0:
                    index[pair] = [i]
                    if r in of_rank:
                        of_rank[r].append(pair)
                    else:
                        of_rank[r] = [pair]
                        push(queue, r)
                h = left[i]
                pair = made[h] = sym[h] << 32 | rank
                if pair in index:
                    index[pair].append(h)
                elif (r := get(pair, -1)) >= 0:
                    index[pair] = [h]
                    if r in of_rank:
                        of_rank[r].append(pair)
                    else:
                        of_rank[r] = [pair]
                        push(queue, r)
        for k, i in begin:
            found = []
            while (s := sym[i]) != EDGE:
                found.append(s)
                i = right[i]
            out[k] = array("I", found).tobytes()
        return out

    def encode_words(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of words, as little-endian unsigned 32-bit integers; words that are neither common nor remembered are replayed together."""
        known, older, common = self.known, self.older, self.common
        new, long = [], []
        for w in set().union(*lists):
            if w in common or w in known:
                continue
            if (x := older.get(w)) is not None:
                known[w] = x
            else:
                new.append(w)
        for w, x in zip(new, self.replay([w.encode() for w in new]), strict=True):
            known[w] = x
            if len(w) > LONGEST_REMEMBERED:
                long.append(w)
        out = [b"".join(map(common.__getitem__, x)) for x in lists]
        for w in long:
            del known[w]
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return out

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, gathered from the tokens' bytes laid end to end."""
        ids = np.concatenate([*lists, np.zeros(0, np.uint32)])
        size = self.sizes[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.begins[ids] - (ends - size), size)
        at += np.arange(len(at), dtype=at.dtype)
        whole = self.flat[at].tobytes()
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, lists)])].tolist()
        return [whole[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def word_counts(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """word and n of the pattern's matches of LONGEST_REMEMBERED characters at most, over the whole corpus; counted in each task first."""
    small_batches(docs.sparkSession)

    def tally(batches):
        import regex

        split = regex.compile(pattern)
        held: Counter = Counter()

        def flush():
            rows = [(w, n) for w, n in held.items() if len(w) <= LONGEST_REMEMBERED]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for piece in pieces(batch, text):
                for t in piece.column(text).to_pylist():
                    held.update(split.findall(t or ""))
                if len(held) > TALLIED:
                    yield flush()
        yield flush()

    return docs.select(text).mapInArrow(tidy(tally), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def replayed(words: DataFrame, ranks: Broadcast) -> DataFrame:
    """word and ids (little-endian unsigned 32-bit integers) of distinct words: the merges are replayed over each partition at once."""

    def run(batches):
        codec = Codec.of(ranks)
        for batch in batches:
            some = batch.column("word").to_pylist()
            ids = codec.replay([w.encode() for w in some])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.binary())], names=["word", "ids"])

    return words.select("word").mapInArrow(tidy(run), "word string, ids binary")


def common_words(docs: DataFrame, pattern: str, ranks: Broadcast, text: str = "text", most: int = COMMON) -> tuple[pa.Array, pa.Array]:
    """The corpus's most frequent words, `most` at most, and their ids: all that stand k times or more, for the least k that keeps the limit.

    Counts from 1024 on are compared by their power of two, so the driver sees some 1,100 rows
    and then `most` short words. Words that stand once aren't worth the way.
    """
    counts = written(word_counts(docs, pattern, text).where("n > 1"), "words")
    power = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n")) + 1014)  # of 1024: 1024
    held, least = 0, None
    for r in sorted(counts.groupBy(power.alias("k")).agg(F.count("*").alias("c")).collect(), reverse=True):  # 1,078 rows at most
        held += r.c
        if held > most:
            break
        least = r.k
    if least is None:
        return pa.array([], pa.string()), pa.array([], pa.binary())
    table = replayed(counts.where(power >= least), ranks).toArrow().combine_chunks()  # `most` rows, which stay packed on the driver
    return tuple(pa.concat_arrays(table.column(c).chunks) for c in ("word", "ids"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", digest: bool = False, common: int = COMMON) -> DataFrame:
    """The columns of docs and the token ids of each whole text (or their digests).

    The pattern's matches (words) are encoded separately, without special tokens. The driver
    reads the rank file (a vocabulary, of fixed size) and broadcasts it. A first scan counts the
    words of the corpus; the `common` most frequent ones are replayed once, over partitions of
    distinct words, and broadcast with their ids. A second scan puts the ids together, and
    replays the rest, most of which stand in one place, for a piece of text at a time.

    Defined cases: null counts as an empty text and has no ids; equal rows are encoded alike; no
    rows give no rows; a column of docs named as an output is replaced, others don't matter;
    very long words cost n log n, and very long texts are a piece each.
    """
    import regex

    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    frequent = docs.sparkSession.sparkContext.broadcast(common_words(docs, pattern, shared, text, common))
    held: dict[str, object] = {}
    extra = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digest else {ids: "array<int>"}
    base = docs.drop(*extra)
    names = base.columns

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.update(codec=Codec.of(shared), split=regex.compile(pattern))
            held["codec"].knows(frequent.value)
        codec, split = held["codec"], held["split"]
        found = codec.encode_words([split.findall(t or "") for t in batch.column(text).to_pylist()])
        ids_of = [np.frombuffer(x, "<u4") for x in found]
        if digest:
            cols = [
                pa.array([len(x) for x in ids_of], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode(ids_of)], pa.string()),
            ]
        else:
            cols = [pa.array([x.astype(np.int32) for x in ids_of], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], names=[*names, *extra])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"`{k}` {v}" for k, v in extra.items())])
    return map_pieces(base, text, fn, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """The bytes that each row's ids stand for; null ids decode to no bytes. An id outside the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    base = encoded.drop(out)
    names = base.columns

    def run(batches):
        codec = Codec.of(shared)
        for batch in batches:
            found = codec.decode([np.array(x or (), np.int64) for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.binary())], names=[*names, out])

    return base.mapInArrow(tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"`{out}` binary"]))
