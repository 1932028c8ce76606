"""Near-duplicate documents: SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_place, id_filter, id_place, map_pieces, parted, pieces, small_batches, text_bytes, tidy, tidy_group, written
from .hashing import U, mix, word_hashes

BANDS, ROWS = 25, 4
#: Members of a pivot that are compared in one task, and about how many shingles their sets may sum to (8 bytes each).
SLICE = 2000
SLICE_SHINGLES = 1 << 20
#: Parts in which a large pivot's members are dealt when they meet what is known of it.
SALTS = 64


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a shorter text's whole sequence is one."""
    h, count = word_hashes(texts)
    chain = mix(h + U(width))
    n = len(h)
    for i in range(1, width):
        shifted = np.zeros(n, U)
        shifted[: max(0, n - i)] = h[i:]
        chain = mix(chain * U(0x9E3779B97F4A7C15) + shifted)
    out, at = [], 0
    for k in count.tolist():
        if k >= width:
            out.append(np.unique(chain[at : at + k - width + 1]))
        elif k:
            whole = U(k)
            for w in h[at : at + k]:
                whole = mix(np.array([whole * U(0xC2B2AE3D27D4EB4F) + w], U))[0]
            out.append(np.array([whole], U))
        else:
            out.append(np.zeros(0, U))
        at += k
    return out


def super_minhash(elements: np.ndarray, size: int) -> np.ndarray:
    """The SuperMinHash signature of a set: per slot the least of (rank, random bits) over its elements.

    Each element visits the slots in an order that is a random permutation of its own; at its
    j-th visit it offers j + a random fraction. All elements make their j-th visit together, and
    once every slot holds an offer of rank j or less, no later visit can lower one: stop.
    """
    sig = np.full(size, np.iinfo(np.uint64).max, U)
    n = len(elements)
    order = None
    rows = np.arange(n)
    for j in range(size):
        rnd = mix(elements + U((j + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((rnd & U(0xFFFF)) % U(size - j)).astype(np.int64)
        if j == 0:
            slot = first = k
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.int16), (n, 1))
                order[rows, 0], order[rows, first] = order[rows, first], order[rows, 0].copy()
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = slot
        np.minimum.at(sig, slot, (U(j) << U(48)) | (rnd >> U(16)))
        if sig.max() < U(j + 1) << U(48):
            break
    return sig


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def signatures(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (a 128-bit digest of the set), bands."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, k1, k2, bands = [], [], [], []
        for s in shingle_sets(text_bytes(batch.column(text)), width):
            n.append(len(s))
            k1.append(int(_signed(np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), dtype=U, keepdims=True))[0]))
            k2.append(int(_signed(np.add.reduce(mix(s ^ U(0x14057B7EF767814F)), dtype=U, keepdims=True))[0]))
            if len(s):
                sig = super_minhash(s, BANDS * ROWS).reshape(BANDS, ROWS)
                h = np.arange(BANDS, dtype=U)
                for r in range(ROWS):
                    h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, r])
                bands.append(_signed(h))
            else:
                bands.append(np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "k1", "k2", "bands"]
        )

    return map_pieces(docs.select("doc_id", text), text, fn, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, width: int, text: str) -> DataFrame:
    """rep and shingles of the documents named in ids; the texts are filtered where they lie, and only the sets of the rest are shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(id_filter(ids, "rep"))
    small_batches(spark)
    base = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), text, id_place("doc_id").alias("pos"))

    def run(batches):
        bits = shared.value
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            held = batch.filter(pa.array(has_place(bits, pos)))
            for piece in pieces(held, text):
                sets = [_signed(s) for s in shingle_sets(text_bytes(piece.column(text)), width)]
                yield pa.RecordBatch.from_arrays([piece.column("rep"), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return base.mapInArrow(tidy(run), "rep long, shingles array<long>").join(ids, "rep", "left_semi")


def links_within(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what sets of at least percent / 100 similarity connect, beyond what label already does.

    Two such sets share an element among the rarest n - ceil(percent * n / 100) + 1 of each
    (rarest within these sets), so an index of those gives the candidates; a pair with one label
    needs no look. A set's candidates are then confirmed by counting what they share in a full
    index, all at once.
    """
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    ids = np.split(inverse, np.cumsum(n)[:-1])
    holder = np.repeat(np.arange(len(sets)), n)[np.argsort(inverse, kind="stable")]
    at = np.concatenate(([0], np.cumsum(count)))
    heads = []
    for k, x in enumerate(ids):
        keep = n[k] - -(-percent * n[k] // 100) + 1
        rare = x[np.lexsort((x, count[x]))[:keep]]
        heads.append(rare[count[rare] > 1])
    owner = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    token = np.concatenate(heads)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    label, out, members = label.copy(), [], {}
    for k, v in enumerate(label.tolist()):
        members.setdefault(v, []).append(k)
    for x in np.lexsort((np.arange(len(sets)), n)):
        if not len(heads[x]):
            continue
        a, b = np.searchsorted(token, heads[x], "left"), np.searchsorted(token, heads[x], "right")
        cand = np.unique(np.concatenate([owner[i:j] for i, j in zip(a, b, strict=True)]))
        cand = cand[(label[cand] != label[x]) & (n[cand] * 100 >= n[x] * percent) & (n[cand] * percent <= n[x] * 100)]
        if not len(cand):
            continue
        mine = ids[x][count[ids[x]] > 1]
        both = np.bincount(np.concatenate([holder[at[i] : at[i + 1]] for i in mine]), minlength=len(sets))[cand]
        for y in cand[100 * both >= percent * (n[x] + n[cand] - both)].tolist():
            one, two = label[x], label[y]
            if one == two:
                continue
            out.append((int(x), y))
            if len(members[one]) < len(members[two]):
                one, two = two, one
            moved = members.pop(two)
            label[moved] = one
            members[one] += moved
    return out


def _links(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a > b) among the members of each block (key columns p, s); found: p, s, rep, label."""
    placed = found.join(sets, "rep")

    def block(t: pa.Table) -> pa.Table:
        shingles = t.column("shingles").combine_chunks()
        off = shingles.offsets.to_numpy()
        flat = shingles.flatten().to_numpy()
        off = off - off[0]
        rep = t.column("rep").to_numpy()
        _, label = np.unique(t.column("label").to_numpy(), return_inverse=True)
        pairs = links_within([flat[off[i] : off[i + 1]] for i in range(len(rep))], label, percent)
        a = np.array([max(rep[x], rep[y]) for x, y in pairs], np.int64)
        b = np.array([min(rep[x], rep[y]) for x, y in pairs], np.int64)
        return pa.table({"a": a, "b": b})

    return placed.groupBy("p", "s").applyInArrow(tidy_group(block), "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """rep and root (the least id reachable) of every linked id, by alternating large and small stars; never on the driver."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "rep")
        before = now


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of word shingles have at least percent / 100 Jaccard similarity are
    linked; component_id is the least doc_id reachable, and the document with it is kept.

    1. A scan computes SuperMinHash signatures, and a digest of each set. Documents with equal
       sets (all copies) form a class; only its least doc_id goes on.
    2. Bands of the signatures make buckets. Each bucket names as pivot its member that shares
       most buckets; a member then meets its pivots' other members, not every pair of a bucket.
    3. A second scan makes the full sets of documents in shared buckets, and only these move.
       Each pivot's members are compared exactly, in tasks of about SLICE members or SLICE_SHINGLES
       elements, whichever is less: an index of each set's rarest elements gives the pairs that can qualify, pairs already connected by
       union-find are passed over, and links are confirmed on full sets. Of pivots with more
       members, slices are then compared pairwise where they aren't connected yet.
    4. Stars connect the links (see connected).

    A pair of the least similarity is missed with probability (1 - t ** 4) ** 25: 2e-6 at 0.8, 1e-8 at 0.85.

    Shingles are told apart by 64-bit hashes, and sets of equal texts by 128 bits of them: two
    different shingles of one document pair have equal hashes with a probability of about 1e-19
    times their number squared.

    Defined cases: a null or empty text, or one of spaces, has no shingles and is linked with
    nothing; fewer words than `width` make one shingle; rows with one doc_id are one document
    as far as links go; a null doc_id is linked with nothing and kept; no rows give no rows.
    """
    spark = docs.sparkSession
    sigs = written(signatures(docs, width, text), "signatures")
    key = ["n", "k1", "k2"]
    full = sigs.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    members = classes.select("rep", "n", F.explode("bands").alias("h"))
    shared = members.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    inside = written(members.join(shared, "h"), "buckets")
    rank = inside.groupBy("rep").agg(F.sum("c").alias("weight"))
    weighed = inside.join(rank, "rep")
    pivots = weighed.groupBy("h").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("p"))
    pairs = written(inside.join(pivots, "h").select("p", "rep", "n").distinct(), "pairs")  # a pivot is among its members
    sets = written(_sets_of(docs, pairs.select("rep").distinct(), width, text).dropDuplicates(["rep"]), "sets")

    slices = pairs.groupBy("p").agg(F.ceil(F.greatest(F.count("*") / SLICE, F.sum("n") / SLICE_SHINGLES)).cast("int").alias("slices"))
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")
    spread = slices.where("slices > 1").select("p", "slices", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # large pivots only, so that one's members meet it in SALTS tasks
    placed = pairs.withColumn("salt", salt).join(spread, ["p", "salt"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    placed = written(placed.select("p", "rep", "n", "slices", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int").alias("s")), "placed")
    with_pivot = placed.select("p", "s", "rep").unionByName(slices.where("slices > 1").select("p", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"), F.col("p").alias("rep"))).distinct()
    links = written(_links(with_pivot.withColumn("label", F.col("rep")), sets, percent), "links")
    roots = connected(links)
    large = placed.where("slices > 1")
    if large.limit(1).count():
        known = large.join(roots, "rep", "left").withColumn("label", F.coalesce("root", "rep"))
        i, j = F.col("s"), F.col("other")
        grid = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        grid = grid.select("p", F.concat_ws("-", F.least(i, j), F.greatest(i, j)).alias("s"), "rep", "label")
        mixed = grid.groupBy("p", "s").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").drop("mixed")
        more = written(_links(grid.join(mixed, ["p", "s"]), sets, percent), "links")
        roots = connected(links.unionByName(more))
    named = classes.join(roots, "rep", "left").select(*key, F.coalesce("root", "rep").alias("root"))
    out = sigs.join(named, key, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """docs (all columns) without the documents that near_duplicates doesn't keep. Only rows that may go are shuffled."""
    gone = written(near_duplicates(docs.select("doc_id", text), width, percent, text).where("not kept").select("doc_id").distinct(), "gone")
    maybe, rest = parted(docs, "doc_id", gone, "doc_id")
    return rest.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*docs.columns))
