"""Repeated passages, by a depth-limited radix sort of suffixes over the whole corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_pieces, parted, pieces, small_batches, text_bytes, tidy, tidy_group, written
from .hashing import U, mix, powers, prefix

#: Bits of the filters between passes (16 MB; their size doesn't grow with the data).
FILTER_BITS = 27
#: Rows in which a filter comes to the driver.
FILTER_ROWS = 256
#: Input bytes for each bucket of a pass, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 32
#: Input bytes for each task of a pass, and the most tasks (each sorts its buckets by spilling).
TASK_BYTES, MOST_TASKS = 32 << 20, 50_000
#: Bytes of text whose windows are looked at together.
BLOCK_BYTES = 256 << 10
#: Anchors that a task gathers before it hands them on.
GATHER = 1 << 20
#: Runs of an anchor from which they are dealt by later digits too.
HOT_RUNS = 4096
#: Bytes of hot runs or windows that a task holds, to hand on each content once.
HELD_BYTES = 16 << 20
#: Windows that are sorted at once (one anchor's may be more: HOT_RUNS times a run's).
SORTED_WINDOWS = 1 << 19
_LOW = U((1 << 28) - 1)

ANCHOR = np.dtype([("a", "<u8"), ("n", "<u4")])
RUN = np.dtype([("a", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("len", "<i4"), ("shift", "<i4")])
PLACE = np.dtype([("doc", "<i8"), ("start", "<i8")])


class Runs:
    """The windows of some texts in runs that share an anchor.

    A window's anchor is its gram of `gram` bytes with the least hash (the rightmost of equals).
    It depends on the window's content alone, so equal windows have equal anchors at equal
    places: where the anchor stands, and which it is, are the window's first digits. Neighbouring
    windows mostly share one. `bits` shortens the hash (results don't depend on it).
    """

    def __init__(self, parts: list[tuple[int, int, bytes]], window: int, gram: int, bits: int = 64):
        """parts: number of the text, place in it, bytes (see parts_of)."""
        self.window = window
        self.buf = b"".join(p for _, _, p in parts)
        buf = np.frombuffer(self.buf, np.uint8)
        size = np.array([len(p) for _, _, p in parts], np.int64)
        ends = np.cumsum(size)
        begins = ends - size
        sums, down = prefix(buf), powers(len(buf) + 1)[1]
        grams = mix((sums[gram:] - sums[: len(buf) - gram + 1]) * down[: len(buf) - gram + 1]) & U((1 << 64) - (1 << 64 - bits))
        del sums
        key = (grams & ~_LOW) | (_LOW - (np.arange(len(grams), dtype=U) & _LOW))
        width, span, least = window - gram + 1, 1, key
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (_LOW - (least & _LOW)).astype(np.int64)
        own = np.arange(len(place))
        place += (own >> 28) << 28  # the low bits name a place at or after the window's start
        place += (place < own).astype(np.int64) << 28
        edge = np.zeros(len(place) + 1, np.int8)
        np.add.at(edge, begins, 1)
        np.add.at(edge, ends - window + 1, -1)
        begin = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        of = place[begin]
        cut = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (begin[1:] != begin[:-1] + 1)])
        cut = np.unique(np.concatenate((cut, np.searchsorted(begin, begins))))  # no run goes over a border
        self.at = begin[cut]
        self.len = np.diff(np.r_[cut, len(begin)])
        at_anchor = of[cut]
        self.anchor, self.shift = mix(grams[at_anchor] + U(1)), at_anchor - self.at  # least hashes are small: spread them again
        part = np.searchsorted(ends, self.at, "right")
        self.text = np.array([k for k, _, _ in parts], np.int64)[part]
        self.start = self.at - begins[part] + np.array([b for _, b, _ in parts], np.int64)[part]

    def records(self, which: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Records of some runs, and the bytes that their windows cover."""
        r = np.empty(len(which), RUN)
        r["a"], r["doc"], r["start"], r["len"], r["shift"] = self.anchor[which], ids[self.text[which]], self.start[which], self.len[which], self.shift[which]
        at, end = self.at[which], self.at[which] + self.len[which] + self.window - 1
        return r, [self.buf[i:j] for i, j in zip(at.tolist(), end.tolist(), strict=True)]


def parts_of(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """The texts in lists of parts of about BLOCK_BYTES in all; the parts of a long text overlap, so that each window is in one."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - window + 1, BLOCK_BYTES):
            part = t[at : at + BLOCK_BYTES + window - 1]
            if held and size + len(part) > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield held


def repeated_windows(buf: bytes, at: np.ndarray, digit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows of buf that start at `at` equal another one, in order of their bytes, and the group of each.

    A radix sort from the most significant digit on: first the given digit, then eight bytes of
    the window at a time. A pass orders each group of the one before by its next digit, and
    windows that then stand alone leave; after the last byte, groups are equal windows.
    """
    octets = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buf, np.uint8), 8) if len(buf) >= 8 else None
    index, group = np.arange(len(at)), digit
    depths = [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])] if window >= 8 else []
    single = [] if depths else list(range(window))  # windows shorter than a digit
    for depth in [None, *depths, *single]:
        if not len(index):
            break
        if depth is None:
            order = np.argsort(group, kind="stable")
            g = group[order]
            new = np.r_[True, g[1:] != g[:-1]]
        else:
            place = at[index] + depth
            value = np.ascontiguousarray(octets[place]).view(">u8").ravel().astype(U) if depths else np.frombuffer(buf, np.uint8)[place].astype(U)
            order = np.lexsort((value, group))
            g, v = group[order], value[order]
            new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        alone = new & np.r_[new[1:], True]
        group = np.cumsum(new)[~alone]
        index = index[order[~alone]]
    return index, group


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets in the order of the hash's top bits, so that each owns a range of a filter."""
    return ((h >> U(40)) * U(n) >> U(24)).astype(np.int64)


def later(group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a row of the same group stands earlier (equal rows stand nowhere earlier)."""
    order = np.lexsort((start, doc, group))
    g, d, s = group[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = g[1:] != g[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = (d != d[head]) | (s != s[head])
    return out


def numbered(contents: list[bytes]) -> np.ndarray:
    """A number for each distinct content, by comparing the bytes."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(c, len(known)) for c in contents), np.int64, len(contents))


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with those of a document that overlap or touch joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    border = np.r_[True, doc[1:] != doc[:-1]]
    part = np.cumsum(border) - 1
    # Offset each document's places so that one running maximum serves them all.
    base = part * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = border | np.r_[True, start[1:] + base[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(doc) - 1]
    return doc[first], start[first], reach[last] - base[last]


ANCHORS, SPANS, HOT = 0, 1, 2
DEALT = "kind int, bucket int, body binary, more binary"
Dealt = list[tuple[int, int, bytes, bytes]]


def _rows(kind: int, bucket: np.ndarray, records: np.ndarray, contents: list[bytes] | None = None) -> Dealt:
    """Records dealt into one packed row for each bucket (and the bytes of each)."""
    if not len(records):
        return []
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    return [
        (kind, int(b[i]), records[order[i:j]].tobytes(), b"".join([contents[k] for k in order[i:j].tolist()]) if contents else b"")
        for i, j in zip(cuts, np.r_[cuts[1:], len(b)], strict=True)
    ]


def _span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> Dealt:
    """Spans found, joined; they go along to a bucket that leaves them as they are."""
    doc, start, end = joined(doc, start, end)
    return [(SPANS, int(doc[0]) % buckets, np.stack([doc, start, end]).astype("<i8").tobytes(), b"")] if len(doc) else []


def _batch(rows: Dealt) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "bucket", "body", "more"])


def _unpacked(t: pa.Table, kind: int, dtype: np.dtype, extent: int | None = None) -> tuple[np.ndarray, list[bytes]]:
    """The records of a kind in packed rows, and the bytes of each: as many as its length and extent say."""
    keep = [k == kind for k in t.column("kind").to_pylist()]
    some = t.filter(pa.array(keep))
    r = np.frombuffer(b"".join(some.column("body").to_pylist()), dtype)
    if extent is None:
        return r, []
    buf = b"".join(some.column("more").to_pylist())
    size = r["len"].astype(np.int64) + extent if "len" in r.dtype.names else np.full(len(r), extent, np.int64)
    ends = np.cumsum(size)
    return r, [buf[i:j] for i, j in zip((ends - size).tolist(), ends.tolist(), strict=True)]


def _spans_in(t: pa.Table) -> Dealt:
    return [tuple(x.values()) for x in t.filter(pa.array([k == SPANS for k in t.column("kind").to_pylist()])).to_pylist()]


def _bits(h: np.ndarray) -> tuple[int, bytes]:
    """The range of the filter that some hashes of a bucket set."""
    pos = np.unique(h >> U(64 - FILTER_BITS)).astype(np.int64)
    if not len(pos):
        return 0, b""
    low = int(pos[0]) >> 3
    part = np.zeros((int(pos[-1]) >> 3) - low + 1, np.uint8)
    np.bitwise_or.at(part, (pos >> 3) - low, (1 << (pos & 7)).astype(np.uint8))
    return low, part.tobytes()


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    pos = (h >> U(64 - FILTER_BITS)).astype(np.int64)
    return (bits[pos >> 3] >> (pos & 7)) & 1 == 1


def _dealt(found: DataFrame, total: int):
    """Rows grouped by bucket, in as many tasks as the total of input bytes asks for: AQE would put many buckets in one."""
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    return found.repartition(min(buckets, max(200, total // TASK_BYTES), MOST_TASKS), "bucket").groupBy("bucket")


def _counted(found: DataFrame, total: int, levels: tuple[int, ...]) -> list[np.ndarray]:
    """For each level a filter of the hashes that stand more often in rows of packed ANCHOR records.

    Buckets own ranges of a filter; the ranges are put together in FILTER_ROWS rows before they
    come to the driver, whatever the number of buckets.
    """
    kind = "level int, row int, low long, bits binary"
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)

    def count(t: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(t.column("body").to_pylist()), ANCHOR)
        a, inverse = np.unique(r["a"], return_inverse=True)
        n = np.bincount(inverse, weights=r["n"])
        row = t.column("bucket")[0].as_py() * FILTER_ROWS // buckets
        parts = [(k, row, *_bits(a[n > level])) for k, level in enumerate(levels)]
        return pa.table({"level": pa.array([p[0] for p in parts], pa.int32()), "row": pa.array([p[1] for p in parts], pa.int32()), "low": pa.array([p[2] for p in parts], pa.int64()), "bits": pa.array([p[3] for p in parts], pa.binary())})

    def together(t: pa.Table) -> pa.Table:
        parts = [(x["low"], np.frombuffer(x["bits"], np.uint8)) for x in t.to_pylist() if x["bits"]]
        low = min((p[0] for p in parts), default=0)
        out = np.zeros(max((a + len(b) for a, b in parts), default=low) - low, np.uint8)
        for at, part in parts:
            out[at - low : at - low + len(part)] |= part
        return pa.table({"level": t.column("level").slice(0, 1), "row": t.column("row").slice(0, 1), "low": pa.array([low], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    filters = [np.zeros(1 << FILTER_BITS - 3, np.uint8) for _ in levels]
    rows = _dealt(found, total).applyInArrow(tidy_group(count), kind).groupBy("level", "row").applyInArrow(tidy_group(together), kind)
    for r in rows.collect():  # FILTER_ROWS a level
        part = np.frombuffer(bytes(r.bits), np.uint8)
        filters[r.level][r.low : r.low + len(part)] |= part
    return filters


class Held:
    """The first place of each content that a task meets, until HELD_BYTES are held; what stands later is a repeat."""

    def __init__(self):
        self.first: dict[bytes, tuple] = {}
        self.size = 0
        self.again: list[tuple[int, int, int]] = []

    def add(self, content: bytes, record: tuple, n: int) -> None:
        """record begins with doc and start; n is the number of windows from there."""
        had = self.first.get(content)
        if had is None:
            self.first[content] = record
            self.size += len(content) + 200
        elif record[:2] != had[:2]:
            if record[:2] < had[:2]:
                self.first[content], record = record, had
            self.again.append((record[0], record[1], record[1] + n))

    def spans(self, buckets: int, window: int) -> Dealt:
        x = np.array(self.again, np.int64).reshape(-1, 3)
        self.again = []
        return _span_rows(x[:, 0], x[:, 1], x[:, 2] + window - 1, buckets)


def _id_text(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, list[bytes]]:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), text_bytes(batch.column(text))


def _among_firsts(r: np.ndarray, contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """doc and start of windows that equal an earlier one, in runs of different contents."""
    anchor, of, count = np.unique(r["a"], return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[of] > 1)
    some = some[np.argsort(of[some], kind="stable")]
    ends = np.cumsum(r["len"][some].astype(np.int64))
    docs, starts, k = [], [], 0
    while k < len(some):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SORTED_WINDOWS, "right")))
        while stop < len(some) and of[some[stop]] == of[some[stop - 1]]:  # an anchor's runs stay together
            stop += 1
        part = some[k:stop]
        k = stop
        n = r["len"][part].astype(np.int64)
        size = n + window - 1
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(size) - size, n) + offset
        digit = np.repeat(of[part] * (window + 1) + r["shift"][part], n) - offset  # the anchor, and its place in the window
        index, group = repeated_windows(b"".join([contents[i] for i in part.tolist()]), at, digit, window)
        doc = np.repeat(r["doc"][part], n)[index]
        start = (np.repeat(r["start"][part], n) + offset)[index]
        again = later(group, doc, start)
        docs.append(doc[again])
        starts.append(start[again])
    return np.concatenate([*docs, np.zeros(0, np.int64)]), np.concatenate([*starts, np.zeros(0, np.int64)])


def repeated_spans(docs: DataFrame, window: int = 100, gram: int = 32, text: str = "text", hash_bits: int = 64) -> DataFrame:
    """doc_id, spans (sorted, disjoint [s, e) in bytes) of documents with passages that also start earlier.

    A radix sort of all windows from the most significant digit on: each pass deals what is
    left into buckets by the next digit and drops what stands alone there. A window's bytes are
    compared to the last one; hashes only choose anchors and buckets.

    1. The first digit is the window's anchor (see Runs). It takes the place of the leading
       bytes because neighbouring windows share it: they then move together, in about four bytes
       for each of theirs, where leading bytes would send each window's 100 bytes apart. Anchors
       that stand once leave; a filter of fixed size tells which may stand more often.
    2. Runs of windows are dealt by their anchor, with their bytes. In a bucket, runs of equal
       bytes are repeats but for the first. The windows of the first ones are ordered by where
       the anchor stands, then by eight bytes at a time (repeated_windows); of equal windows, all
       but the first are repeats.
    3. Anchors of more than HOT_RUNS runs are dealt by content in pass 2, and each content once
       from a task. What differs goes on: its windows are counted by a hash, and those that may
       stand twice are dealt by it with their bytes, again each content once from a task.

    What a task's piece of text already repeats is dropped or found there, before it is dealt, so
    a passage that stands everywhere makes a record for each piece only.
    """
    spark = docs.sparkSession
    base = docs.where("doc_id is not null").select("doc_id", text)
    total = base.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    small_batches(spark)

    def gathered(hashes: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            a, k = np.unique(np.concatenate(held), return_counts=True)
            records = np.empty(len(a), ANCHOR)
            records["a"], records["n"] = a, k
            return _batch(_rows(ANCHORS, bucket_of(a, buckets), records))

        for h in hashes:
            held.append(h)
            n += len(h)
            if n >= GATHER:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def anchors(batches):
        return gathered(Runs(parts, window, gram, hash_bits).anchor for batch in batches for piece in pieces(batch, text) for parts in parts_of(text_bytes(piece.column(text)), window))

    shared = spark.sparkContext.broadcast(_counted(base.mapInArrow(tidy(anchors), DEALT), total, (1, HOT_RUNS)))

    def runs(batches):
        twice, hot = shared.value
        held = Held()

        def flush():
            contents = list(held.first)
            r = np.array([(a, d, s, n, k) for d, s, a, n, k in held.first.values()], RUN)
            held.first, held.size = {}, 0
            return _batch(_rows(HOT, bucket_of(_content_hash(contents), buckets), r, contents))

        for batch in batches:
            for piece in pieces(batch, text):
                ids, texts = _id_text(piece, text)
                for parts in parts_of(texts, window):
                    found = Runs(parts, window, gram, hash_bits)
                    r, contents = found.records(np.flatnonzero(_has(twice, found.anchor)), ids)
                    again = later(numbered(contents), r["doc"], r["start"])
                    out = _span_rows(r["doc"][again], r["start"][again], r["start"][again] + r["len"][again] + window - 1, buckets)
                    often = _has(hot, r["a"])
                    for k in np.flatnonzero(often & ~again).tolist():
                        held.add(contents[k], (int(r["doc"][k]), int(r["start"][k]), int(r["a"][k]), int(r["len"][k]), int(r["shift"][k])), int(r["len"][k]))
                    rest = np.flatnonzero(~often & ~again)
                    yield _batch(out + held.spans(buckets, window) + _rows(ANCHORS, bucket_of(r["a"][rest], buckets), r[rest], [contents[k] for k in rest.tolist()]))
                    if held.size > HELD_BYTES:
                        yield flush()
        if held.first:
            yield flush()

    def resolve(t: pa.Table) -> pa.Table:
        rows = _spans_in(t)
        for kind in (ANCHORS, HOT):
            r, contents = _unpacked(t, kind, RUN, window - 1)
            if not len(r):
                continue
            again = later(numbered(contents), r["doc"], r["start"])
            rows += _span_rows(r["doc"][again], r["start"][again], r["start"][again] + r["len"][again] + window - 1, buckets)
            first = np.flatnonzero(~again)
            r, contents = r[first], [contents[k] for k in first.tolist()]
            if kind == HOT:
                share = BLOCK_BYTES // (2 * window)  # records that a row holds
                rows += [(HOT, t.column("bucket")[0].as_py(), r[i : i + share].tobytes(), b"".join(contents[i : i + share])) for i in range(0, len(r), share)]
            else:
                doc, start = _among_firsts(r, contents, window)
                rows += _span_rows(doc, start, start + window, buckets)
        return pa.Table.from_batches([_batch(rows)])

    resolved = written(_dealt(base.mapInArrow(tidy(runs), DEALT), total).applyInArrow(tidy_group(resolve), DEALT), "runs")
    spans = resolved.where(F.col("kind") == SPANS).select("body")
    hot_runs = resolved.where(F.col("kind") == HOT)
    if hot_runs.limit(1).count():
        spans = spans.unionByName(_hot_windows(hot_runs, gathered, window, total))

    def unpack(batches):
        for batch in batches:
            for body in batch.column("body").to_pylist():
                doc, s, e = np.frombuffer(body, "<i8").reshape(3, -1)
                for i in range(0, len(doc), 1 << 16):
                    j = i + (1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[i:j]), pa.array(s[i:j]), pa.array(e[i:j])], names=["doc_id", "s", "e"])

    rows = spans.mapInArrow(tidy(unpack), "doc_id long, s long, e long")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def _content_hash(contents: list[bytes]) -> np.ndarray:
    """A hash of each content, the same in every process; it deals, and decides nothing."""
    return np.frombuffer(b"".join(hashlib.blake2b(c, digest_size=8).digest() for c in contents), "<u8")


def _windows_of(t: pa.RecordBatch, window: int):
    """Of each packed row of hot runs: hash, doc and start of every window, the bytes, and where each window stands in them."""
    for body, more in zip(t.column("body").to_pylist(), t.column("more").to_pylist(), strict=True):
        r = np.frombuffer(body, RUN)
        n = r["len"].astype(np.int64)
        size = n + window - 1
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(size) - size, n) + offset
        buf = np.frombuffer(more, np.uint8)
        sums, down = prefix(buf), powers(len(buf) + 1)[1]
        yield mix((sums[at + window] - sums[at]) * down[at]), np.repeat(r["doc"], n), np.repeat(r["start"], n) + offset, more, at


def _hot_windows(hot_runs: DataFrame, gathered, window: int, total: int) -> DataFrame:
    """Spans of windows that stand earlier in another content of a hot anchor."""
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    hashes = hot_runs.mapInArrow(lambda batches: gathered(h for b in batches for h, *_ in _windows_of(b, window)), DEALT)
    shared = hot_runs.sparkSession.sparkContext.broadcast(_counted(hashes, total, (1,))[0])

    def windows(batches):
        twice, held = shared.value, Held()

        def flush():
            contents = list(held.first)
            r = np.array(list(held.first.values()), PLACE)
            held.first, held.size = {}, 0
            return _batch(held.spans(buckets, window) + _rows(HOT, bucket_of(_content_hash(contents), buckets), r, contents))

        for batch in batches:
            for h, doc, start, more, at in _windows_of(batch, window):
                k = np.flatnonzero(_has(twice, h))
                for d, s, i in zip(doc[k].tolist(), start[k].tolist(), at[k].tolist(), strict=True):
                    held.add(more[i : i + window], (d, s), 1)
                    if held.size > HELD_BYTES:
                        yield flush()
        if held.first:
            yield flush()

    def last(t: pa.Table) -> pa.Table:
        r, contents = _unpacked(t, HOT, PLACE, window)
        index, group = repeated_windows(b"".join(contents), np.arange(len(r)) * window, np.zeros(len(r), np.int64), window)
        doc, start = r["doc"][index], r["start"][index]
        again = later(group, doc, start)
        return pa.Table.from_batches([_batch(_spans_in(t) + _span_rows(doc[again], start[again], start[again] + window, buckets))])

    return _dealt(hot_runs.mapInArrow(tidy(windows), DEALT), total).applyInArrow(tidy_group(last), DEALT).select("body")


def cleaned(docs: DataFrame, window: int = 100, text: str = "text") -> DataFrame:
    """docs (all columns) and kept (binary: the bytes left), n_bytes, n_removed, n_spans.

    Every byte covered by a window that also starts earlier (in a document of smaller doc_id, or
    earlier in the same one) is removed. Matches don't cross documents; windows are judged on
    the input.

    Only texts in which something may be removed are shuffled, to meet their spans.

    Defined cases: null counts as an empty text; a text shorter than the window loses nothing;
    rows with a null doc_id stay whole and repeat nothing; equal rows are one document, so
    neither repeats the other; rows of one doc_id with different texts share their spans, cut
    to each text. Columns named as outputs are replaced.
    """
    out = ("kept", "n_bytes", "n_removed", "n_spans")
    base = docs.drop(*out)
    held = fresh("spans", base.columns)
    spans = written(repeated_spans(base.select("doc_id", text), window, text=text), "spans").withColumnRenamed("spans", held)
    maybe, rest = parted(base, "doc_id", spans, "doc_id")
    names = base.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, size, removed, count = [], [], [], []
        for t, sp in zip(text_bytes(batch.column(text)), batch.column(held).to_pylist(), strict=True):
            parts, at, n = [], 0, 0
            for s in sp or ():
                s, e = s["s"], min(s["e"], len(t))
                if e <= at and at:
                    continue
                if n and s <= at:
                    at = max(at, e)
                    continue
                if s < e:
                    parts.append(t[at:s])
                    at, n = e, n + 1
            parts.append(t[at:])
            kept.append(b"".join(parts))
            size.append(len(t))
            removed.append(len(t) - len(kept[-1]))
            count.append(n)
        cols = [*(batch.column(c) for c in names), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, removed, count))]
        return pa.RecordBatch.from_arrays(cols, names=[*names, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", kept binary, n_bytes long, n_removed long, n_spans long"
    kind = "array<struct<s:bigint,e:bigint>>"
    some = maybe.join(spans, "doc_id", "left").select(*(F.col(f"`{c}`") for c in names), F.col(held).cast(kind).alias(held))
    rest = rest.withColumn(held, F.lit(None).cast(kind))
    return map_pieces(some, text, cut, schema).unionByName(map_pieces(rest, text, cut, schema))


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cleaned(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
