"""Ranked lexical search over documents reordered by recursive graph bisection."""

from __future__ import annotations

import math
import os
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_pieces, row_slices, shared_dir, small_batches, text_bytes, tidy, tidy_group, written
from .decontam import words
from .hashing import word_hashes

#: Bytes of text in a shard of the index, about (a longer text is one by itself), and documents in a cluster.
SHARD_BYTES, CLUSTER = 2 << 20, 64
#: The first bisections are fitted on so many documents of least hashes, with so many words in all at most.
SAMPLE, SAMPLE_WORDS = 2048, 1 << 22
#: Halvings of the sample, hashed words that they go by, and rounds of exchanges for each halving.
DEPTH, PLACE_BITS, ROUNDS = 5, 14, 6
#: Shards that set each item's first threshold.
FIRST = 3
#: Bytes of items searched at once; more take several passes. Items that meet a cluster together.
SLICE_BYTES, TILE = 8 << 20, 256
#: The largest share of a term in a score, before its weight: 10 ** 9 div 1000.
MOST = 1_000_000
NONE = -1
LAST = np.iinfo(np.int64).max


def gap_cost(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits that the gaps between `degree` postings spread over `size` documents take, about."""
    return degree * np.log2(size / (degree + 1))


def bisect(ptr: np.ndarray, terms: np.ndarray, docs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """docs in two halves (sizes at most one apart) that share few terms.

    A document's gain is what its terms' gaps become shorter by if it changes sides. Each round
    exchanges the documents of highest gains of both sides, pair by pair, while a pair gains.
    """
    count = ptr[docs + 1] - ptr[docs]
    at = np.repeat(ptr[docs] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    term, owner = terms[at], np.repeat(np.arange(len(docs)), count)
    used, term = np.unique(term, return_inverse=True)
    total = np.bincount(term, minlength=len(used))
    fine = (total > 1)[term]  # a term of one document says nothing
    term, owner = term[fine], owner[fine]
    right = np.arange(len(docs)) >= len(docs) // 2
    n_right = int(right.sum())
    n_left = len(docs) - n_right
    for _ in range(rounds):
        dr = np.bincount(term, right[owner], minlength=len(used))
        dl = total - dr
        now = gap_cost(dl, n_left) + gap_cost(dr, n_right)
        to_right = now - gap_cost(np.maximum(dl - 1, 0), n_left) - gap_cost(dr + 1, n_right)
        to_left = now - gap_cost(dl + 1, n_left) - gap_cost(np.maximum(dr - 1, 0), n_right)
        gain = np.bincount(owner, np.where(right[owner], to_left[term], to_right[term]), minlength=len(docs))
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = min(len(a), len(b))
        swaps = int((gain[a[:k]] + gain[b[:k]] > 1e-9).sum())  # falling, so that they come first
        if not swaps:
            break
        right[a[:swaps]], right[b[:swaps]] = True, False
    return docs[~right], docs[right]


def order(ptr: np.ndarray, terms: np.ndarray, least: int = CLUSTER) -> np.ndarray:
    """All documents in the order of recursive bisection; sides of `least` or fewer stay as they are."""
    out, stack = [], [np.arange(len(ptr) - 1)]
    while stack:
        docs = stack.pop()
        if len(docs) <= least:
            out.append(docs)
        else:
            a, b = bisect(ptr, terms, docs)
            stack += [b, a]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Tree:
    """Halvings fitted on a sample. A document goes down by the bits its hashed terms would add to either side, against the sample's median."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, share: np.ndarray):
        self.weights, self.cuts, self.share = weights, cuts, share

    def leaf(self, owner: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        node = np.zeros(n, np.int64)
        depth = (len(self.share) - 1).bit_length()
        for _ in range(depth):
            score = np.bincount(owner, self.weights[node[owner], place], minlength=n)
            node = 2 * node + 1 + (score > self.cuts[node])
        return node - (len(self.share) - 1)


def grow(ptr: np.ndarray, place: np.ndarray, depth: int = DEPTH) -> Tree:
    """A tree of 2 ** depth leaves from sampled documents' hashed terms, and each leaf's share of them."""
    n, size = len(ptr) - 1, 1 << PLACE_BITS
    owner = np.repeat(np.arange(n), np.diff(ptr))
    weights, cuts = np.zeros(((1 << depth) - 1, size), np.float32), np.zeros((1 << depth) - 1)
    parts = {0: np.arange(n)}
    for node in range((1 << depth) - 1):
        docs = parts.pop(node)
        if len(docs) > 1:
            mine = np.zeros(n, bool)
            a, b = bisect(ptr, place, docs)
            mine[a] = True
            da = np.bincount(place[mine[owner]], minlength=size)
            mine[a], mine[b] = False, True
            db = np.bincount(place[mine[owner]], minlength=size)
            add_a = gap_cost(da + 1, len(a)) - gap_cost(da, len(a))
            add_b = gap_cost(db + 1, len(b)) - gap_cost(db, len(b))
            weights[node] = add_a - add_b
            score = np.bincount(owner, weights[node, place], minlength=n)[docs]
            cuts[node] = float(np.median(score))
            right = score > cuts[node]
        else:
            right = np.zeros(len(docs), bool)
        parts[2 * node + 1], parts[2 * node + 2] = docs[~right], docs[right]
    leaves = [parts[(1 << depth) - 1 + i] for i in range(1 << depth)]
    return Tree(weights, cuts, np.array([(len(x) + 1) / (n + len(leaves)) for x in leaves]))


def hashed_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place) of the different places of each document's hashed terms, in order, and the documents' numbers of terms."""
    bits = np.uint64(64 - PLACE_BITS)
    hashes, count = word_hashes([b" ".join(words(t)) for t in texts])
    key = np.unique(np.repeat(np.arange(len(texts)), count) << PLACE_BITS | (hashes >> bits).astype(np.int64))
    return key >> PLACE_BITS, key & ((1 << PLACE_BITS) - 1), count


class Law:
    """Of an index: the documents with terms, all their terms, and what follows from them."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms

    def length_share(self, n: np.ndarray) -> np.ndarray:
        """m, by a document's number of terms."""
        if 90 * int(n.max(initial=0)) * self.n_docs < 1 << 63:
            return 10 + 90 * n * self.n_docs // max(1, self.n_terms)
        return np.array([10 + 90 * v * self.n_docs // self.n_terms for v in n.tolist()], np.int64)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    @staticmethod
    def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Index:
    """A clustered index: its table of shards, and the law of its documents."""

    def __init__(self, shards: DataFrame, law: Law):
        self.shards, self.law = shards, law


def _sample(docs: DataFrame, text: str) -> Tree:
    """The first bisections, from the SAMPLE documents of least hashes, as far as their words stay below SAMPLE_WORDS."""
    picked = docs.select(text).where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.octet_length(text).alias("b")).orderBy("h", "b").limit(SAMPLE).collect()
    total, bound = 0, None
    for r in picked:
        total += r.b
        if bound is not None and total > 8 * SAMPLE_WORDS:
            break
        bound = r.h
    if bound is None:
        return grow(np.zeros(1, np.int64), np.zeros(0, np.int64), 0)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, place, _ = hashed_terms(text_bytes(batch.column(text)))
        off = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("h"), pa.ListArray.from_arrays(pa.array(off), pa.array(place.astype(np.int32)))], names=["h", "places"])

    some = docs.select(text, F.xxhash64(text).alias("h")).where(F.col(text).isNotNull() & (F.col("h") <= bound)).dropDuplicates(["h"])
    got = map_pieces(some, text, fn, "h long, places array<int>").orderBy("h").toArrow().column("places").combine_chunks()
    ptr = got.offsets.to_numpy().astype(np.int64)
    return grow(ptr, got.values.to_numpy().astype(np.int64), min(DEPTH, max(0, (len(got) // 8).bit_length() - 1)))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The clustered index of docs, written to the shared folder: a row for each shard.

    Documents with terms are written with their leaf of the tree (see Tree), and a leaf's texts
    meet in shards of about SHARD_BYTES, so that a large leaf, one of many copies say, is dealt to many.
    Inside a shard bisection goes on until CLUSTER documents, and these are its clusters.
    terms are the shard's distinct terms, counts their documents, maxima their highest impact in
    a score; posts and impacts (32 bits each) the postings, term by term, by the new place;
    doc_ids leads from the place back to the document.
    """
    tree = _sample(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, place, count = hashed_terms(text_bytes(batch.column("text")))
        leaf = pa.array(shared.value.leaf(owner, place, batch.num_rows).astype(np.int32))
        out = pa.RecordBatch.from_arrays([leaf, pa.array(count), batch.column("doc_id"), batch.column("text")], names=["leaf", "n", "doc_id", "text"])
        return out.filter(pa.array(count > 0))

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    routed = written(map_pieces(base, "text", route, "leaf int, n long, doc_id long, text string"), "routed")
    leaves = routed.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()  # 2 ** DEPTH rows
    law = Law(sum(r.docs for r in leaves), sum(r.terms for r in leaves))
    parts = np.ones(len(tree.share), np.int64)
    for r in leaves:
        parts[r.leaf] = -(-max(1, r.bytes) // SHARD_BYTES)
    of_leaf = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)).cast("array<long>"), F.col("leaf") + 1)
    salt = F.xxhash64("doc_id", F.monotonically_increasing_id())  # equal rows, too, are dealt out; the written table gives the same numbers again
    sharded = routed.select((of_leaf(np.cumsum(parts) - parts) + F.pmod(salt, of_leaf(parts))).alias("shard"), "doc_id", "text")
    schema = "shard long, terms binary, counts binary, maxima binary, posts binary, impacts binary, doc_ids array<long>"
    shards = sharded.groupBy("shard").applyInArrow(tidy_group(lambda t: _shard(t, law)), schema)
    return Index(written(shards, "clustered-index"), law)


def _shard(t: pa.Table, law: Law) -> pa.Table:
    """The row of a shard's documents; their postings come from one text after the other, as a shard of one long text may be long."""
    vocabulary: dict[bytes, int] = {}
    owner, term, tf, n = [], [], [], []
    for i, text in enumerate(text_bytes(t.column("text"))):
        counts = Counter(words(text))
        term.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in counts), np.int32, len(counts)))
        tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        owner.append(np.full(len(counts), i, np.int32))
        n.append(int(tf[-1].sum()))
    owner, term, tf, n = np.concatenate(owner), np.concatenate(term), np.concatenate(tf), np.array(n, np.int64)
    ptr = np.searchsorted(owner, np.arange(len(n) + 1))
    by = order(ptr, term)
    place = np.empty(len(n), np.int32)
    place[by] = np.arange(len(n))
    impact = Law.impact(tf, law.length_share(n)[owner])
    sort = np.lexsort((place[owner], term))
    count = np.bincount(term, minlength=len(vocabulary))
    impact = impact[sort].astype("<i4")
    most = np.maximum.reduceat(impact, np.cumsum(count) - count)
    binary = lambda a: pa.array([a.astype("<i4").tobytes()], pa.binary())
    ids = t.column("doc_id").combine_chunks()
    return pa.table({
        "shard": t.column("shard").slice(0, 1), "terms": pa.array([b" ".join(vocabulary)], pa.binary()), "counts": binary(count), "maxima": binary(most), "posts": binary(place[owner][sort]), "impacts": binary(impact),
        "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), ids.take(pa.array(by))),
    })


class Queries:
    """Items of a slice: the numbers of their terms, each once, and these terms' weights."""

    def __init__(self, items: list[tuple[int | str | None, list[bytes]]]):
        self.terms: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.held = [np.fromiter(sorted({self.terms.setdefault(w, len(self.terms)) for w in ws}), np.int64) for _, ws in items]
        self.weights = np.zeros(len(self.terms), np.int64)

    def tile(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the TILE items from `at` on, and their weights by item; an item's are 0 for terms that it lacks."""
        held = self.held[at : at + TILE]
        terms, column = np.unique(np.concatenate(held), return_inverse=True)
        row = np.repeat(np.arange(len(held)), [len(h) for h in held])
        w = np.zeros((len(held), len(terms)), np.int64)
        w[row, column] = self.weights[terms[column]]
        return terms, w


def _numbers(terms: bytes, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a shard's list of the queries' terms, and their numbers."""
    k = np.fromiter(map(number.get, terms.split(b" ") if terms else [], repeat(-1)), np.int64)
    mine = np.flatnonzero(k >= 0)
    return mine, k[mine]


def _product(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """w @ x in whole numbers: by doubles where all sums are exact in them."""
    if int(w.sum(axis=1).max(initial=0)) * MOST < 1 << 53:
        return (w.astype(np.float64) @ x.astype(np.float64)).astype(np.int64)
    return w @ x


def document_counts(index: Index, terms: list[bytes]) -> np.ndarray:
    """How many documents hold each of some terms; a task sums its shards first."""
    shared = index.shards.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        number = {t: k for k, t in enumerate(shared.value)}
        n = np.zeros(len(number), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                mine, k = _numbers(terms, number)
                n[k] += np.frombuffer(counts, "<i4")[mine]
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    got = index.shards.select("terms", "counts").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the slice
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


def shard_bounds(queries: Queries, mine: np.ndarray, number: np.ndarray, maxima: np.ndarray) -> np.ndarray:
    """What no document of a shard scores more than, for each item."""
    most = np.zeros(len(queries.terms), np.int64)
    most[number] = maxima[mine]
    return np.array([int(queries.weights[h] @ most[h]) for h in queries.held], np.int64)


class Found:
    """The k best (score down, doc_id up) of each item so far, and the score that is still needed: ties count, as a smaller doc_id wins them."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.score, self.doc = np.full((len(floor), k), NONE), np.full((len(floor), k), LAST)

    def add(self, rows: np.ndarray, score: np.ndarray, docs: np.ndarray) -> None:
        """Scores of the same documents for some items (one row each); those of 0 don't count."""
        score = np.where(score > 0, score, NONE)
        all_s = np.hstack([self.score[rows], score])
        all_d = np.hstack([self.doc[rows], np.broadcast_to(docs, score.shape)])
        pick = np.lexsort((all_d, -all_s), axis=1)[:, : self.k]
        self.score[rows], self.doc[rows] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_d, pick, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])


def search_shard(queries: Queries, found: Found, row: dict, bound: np.ndarray, visited: Counter | None = None) -> None:
    """Take a shard's documents into what is found.

    Only items whose bound reaches their floor meet it. Its clusters' bounds come from the highest
    impact of each term in them; clusters are visited by falling bound, and an item leaves the
    rest of them alone as soon as a bound is below its floor.
    """
    if not (bound >= np.maximum(found.floor, 1)).any():
        return
    mine, number, counts, ids = row["mine"], row["number"], np.frombuffer(row["counts"], "<i4").astype(np.int64), row["doc_ids"]
    begin = np.cumsum(counts) - counts
    at = np.repeat(begin[mine] - np.cumsum(counts[mine]) + counts[mine], counts[mine]) + np.arange(int(counts[mine].sum()))
    term, post, impact = np.repeat(number, counts[mine]), np.frombuffer(row["posts"], "<i4")[at], np.frombuffer(row["impacts"], "<i4")[at].astype(np.int64)
    by = np.argsort(post // CLUSTER, kind="stable")
    term, post, impact = term[by], post[by], impact[by]
    n_clusters = -(-len(ids) // CLUSTER)
    edge = np.searchsorted(post // CLUSTER, np.arange(n_clusters + 1))
    for first in range(0, len(queries.ids), TILE):
        rows = np.arange(first, min(first + TILE, len(queries.ids)))
        if not (bound[rows] >= np.maximum(found.floor[rows], 1)).any():
            continue
        terms, w = queries.tile(first)
        column = np.full(len(queries.terms), -1, np.int64)
        column[terms] = np.arange(len(terms))
        most = np.zeros((len(terms), n_clusters), np.int64)
        here = column[term]
        some = here >= 0
        np.maximum.at(most, (here[some], post[some] // CLUSTER), impact[some])
        limit = _product(w, most)
        for c in np.argsort(-limit.max(axis=0), kind="stable").tolist():
            live = np.flatnonzero(limit[:, c] >= np.maximum(found.floor[rows], 1))
            if not len(live):
                continue  # another cluster may be higher for another item
            span = slice(edge[c], edge[c + 1])
            k = here[span]
            used, place = np.unique(k[k >= 0], return_inverse=True)
            x = np.zeros((len(used), min(CLUSTER, len(ids) - c * CLUSTER)), np.int64)
            x[place, post[span][k >= 0] - c * CLUSTER] = impact[span][k >= 0]
            found.add(rows[live], _product(w[np.ix_(live, used)], x), ids[c * CLUSTER : c * CLUSTER + x.shape[1]])
            if visited is not None:
                visited["pairs"] += len(live)


def _search(index: Index, queries: Queries, k: int) -> DataFrame:
    """(q, doc_id, score) of what may be among each item's k best."""
    spark = index.shards.sparkSession
    df = document_counts(index, list(queries.terms))
    queries.weights = np.array([index.law.weight(int(n)) for n in df], np.int64)
    shared = spark.sparkContext.broadcast(queries)
    small_batches(spark)

    def bounds(batches):
        queries = shared.value
        best = Found(np.zeros(len(queries.ids), np.int64), FIRST)
        for batch in batches:
            for shard, terms, maxima in zip(*(batch.column(c).to_pylist() for c in ("shard", "terms", "maxima")), strict=True):
                limit = shard_bounds(queries, *_numbers(terms, queries.terms), np.frombuffer(maxima, "<i4"))
                best.add(np.arange(len(limit)), limit[:, None], np.array([shard]))
        q, r = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best.doc[q, r]), pa.array(best.score[q, r])], names=["q", "shard", "bound"])

    highest = Window.partitionBy("q").orderBy(F.desc("bound"), "shard")
    opened = index.shards.select("shard", "terms", "maxima").mapInArrow(tidy(bounds), "q long, shard long, bound long").withColumn("r", F.row_number().over(highest)).where(F.col("r") <= FIRST)
    opened = sorted(r.shard for r in opened.select("shard").distinct().collect())  # FIRST for each item of the slice at most

    def visit(floor):
        held = spark.sparkContext.broadcast(floor)

        def run(batches):
            queries = shared.value
            found = Found(held.value, k)
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in ("terms", "maxima")}
                    mine, number = _numbers(row["terms"].as_py(), queries.terms)
                    rows.append((shard_bounds(queries, mine, number, np.frombuffer(row["maxima"].as_py(), "<i4")), mine, number, i))
                for bound, mine, number, i in sorted(rows, key=lambda r: -int(r[0].max(initial=0))):
                    row = {"mine": mine, "number": number} | {c: batch.column(c)[i].as_py() for c in ("counts", "posts", "impacts")}
                    row["doc_ids"] = batch.column("doc_ids")[i].values.fill_null(LAST).to_numpy()
                    search_shard(queries, found, row, bound)
            q, r = np.nonzero(found.score > 0)
            fine = found.score[q, r] >= held.value[q]
            q, r = q[fine], r[fine]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found.doc[q, r]), pa.array(found.score[q, r])], names=["q", "doc_id", "score"])

        return run

    schema = "q long, doc_id long, score long"
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    floor = np.zeros(len(queries.ids), np.int64)
    chosen = index.shards.join(F.broadcast(spark.createDataFrame([(s,) for s in opened], "shard long")), "shard", "left_semi")
    early = chosen.mapInArrow(tidy(visit(floor)), schema).withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k)
    for r in early.select("q", "score").collect():  # a row for each item of the slice at most
        floor[r.q] = r.score
    return index.shards.mapInArrow(tidy(visit(floor)), schema)


def search(index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: item_id, rank, doc_id, score.

    The documents that hold an item's terms are counted over the whole index, which gives the
    terms' weights. The shards of highest bounds give each item a score that its k best reach;
    then all shards are passed, and only clusters whose bound reaches it are scored, by falling
    bound, each task raising it with what it finds. A document left out is below k others, so the
    result is exact. A task hands on its k best of each item, and a window ranks them.

    Items are taken in slices of SLICE_BYTES; each slice's rows are written to the shared folder.
    """
    spark = items.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    rows = items.groupBy(F.col(item_id).alias("i")).agg(F.array_join(F.collect_set(text), " ").alias("t")).orderBy("i")
    path = os.path.join(shared_dir(spark), f"ranked-{uuid.uuid4().hex}")
    spark.createDataFrame([], schema).write.parquet(path)
    for part in row_slices(rows.toLocalIterator(), lambda r: len(r.t.encode()) + 64, SLICE_BYTES):
        held = [(r.i, words(r.t.encode())) for r in part]
        queries = Queries([(i, ws) for i, ws in held if ws])
        if not queries.ids:
            continue
        found = _search(index, queries, k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"q long, item_id {kind}")  # the slice's items
        top = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "q").select("item_id", "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score")
        top.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item (see search), over the clustered index of docs.

    Defined cases: null, empty and wordless texts have no terms: they don't count among the
    documents and are in no result, as items they have none; repeated rows of docs are documents
    of their own, and so are those with a null doc_id (null in the result, after all others of
    equal score); items of one item_id (null too) are one, with all their terms; equal scores go
    by doc_id; very long texts count whole; empty tables give no rows; other columns don't matter.
    """
    return search(build_index(docs), items, k)
