"""Benchmark passages in training documents, by a stored positional inverted index."""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_pieces, parted, text_bytes, tidy, written

#: Bytes of text in a segment of the index (a longer text is one by itself).
SEGMENT_BYTES = 256 << 10
#: Places left free between the documents of a segment: no window and no stretch crosses them.
GAP = 256
#: Bytes of benchmark text whose windows are broadcast at once; a larger benchmark takes several passes over the index.
SLICE_BYTES = 16 << 20
#: Candidate places looked at in one step of an intersection.
STEP = 1 << 19
#: Places of a block, and bits of the filter that says in which blocks a term may stand.
BLOCK, BLOCK_BITS = 5, 22

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in _SEPARATORS else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and bytes of characters beyond ASCII."""
    return text.translate(_FOLD).split()


def build_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """The positional inverted index of docs, written to the shared folder: a row for each segment.

    A segment holds some documents whole. terms are its distinct words, counts and positions (32
    bits each) their postings, term by term in rising order; a document's words stand at its place in
    offsets and after. n_words and the other columns of docs are arrays over the segment's documents.
    Segments lie with their documents, so no posting is shuffled.
    """
    names = [c for c in docs.columns if c != text]
    kept = [f"k{i}" for i in range(len(names))]
    numbers: dict[str, int] = defaultdict(int)

    def segment(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [words(t) for t in text_bytes(batch.column(text))]
        n_words = np.array([len(x) for x in lists], np.int64)
        offset = np.cumsum(n_words + GAP) - n_words
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        ids = np.concatenate([np.fromiter(map(vocabulary.__getitem__, x), np.int64, len(x)) for x in lists] or [np.zeros(0, np.int64)])
        vocabulary.default_factory = None  # else it holds itself, until a collection
        place = np.arange(len(ids)) + np.repeat(offset - np.cumsum(n_words) + n_words, n_words)
        posting = np.sort(ids << 32 | place)
        counts = np.bincount(ids, minlength=len(vocabulary))
        task = TaskContext.get().partitionId()
        numbers["next"] += 1
        one = pa.array([0, batch.num_rows], pa.int32())
        columns = {
            "segment": pa.array([task << 32 | numbers["next"]], pa.int64()), "terms": pa.array([b" ".join(vocabulary)], pa.binary()), "counts": pa.array([counts.astype("<i4").tobytes()], pa.binary()),
            "positions": pa.array([(posting & 0xFFFFFFFF).astype("<i4").tobytes()], pa.binary()), "offsets": pa.ListArray.from_arrays(one, pa.array(offset, pa.int64())), "n_words": pa.ListArray.from_arrays(one, pa.array(n_words, pa.int64())),
        }
        columns |= {k: pa.ListArray.from_arrays(one, batch.column(c)) for k, c in zip(kept, names, strict=True)}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "segment long, terms binary, counts binary, positions binary, offsets array<long>, n_words array<long>" + "".join(f", {k} array<{docs.schema[c].dataType.simpleString()}>" for k, c in zip(kept, names, strict=True))
    return written(map_pieces(docs, text, segment, schema, SEGMENT_BYTES), "index", wide=True)


class Windows:
    """The windows of a slice of the benchmark, as term numbers; -2 fills short ones."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        self.size, self.terms = size, {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items: list[str | None] = []
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            number = len(self.items)
            self.items.append(item)
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(number)
        self.rows = np.full((len(found), size), -2, np.int64)
        for k, w in enumerate(found):
            self.rows[k, : len(w)] = w
        self.lens = np.array([len(w) for w in found], np.int64)
        self.owners = [sorted(s) for s in found.values()]
        # Each window's different terms, filled with -2, for matches in any order.
        self.sets = np.full((len(found), size), -2, np.int64)
        for k, w in enumerate(found):
            u = sorted(set(w))
            self.sets[k, : len(u)] = u


class Led:
    """Windows by a term that leads their search: a row of `order` (places in the window, rarest term first) for each."""

    def __init__(self, rows: np.ndarray, live: np.ndarray, df: np.ndarray, leads: int):
        freq = np.where(rows >= 0, df[np.maximum(rows, 0)], np.iinfo(np.int64).max)
        self.order = np.argsort(freq, axis=1, kind="stable")
        window = np.repeat(live, leads)
        nth = np.tile(np.arange(leads), len(live))
        place = self.order[window, nth]
        term = rows[window, place]
        fine = (term >= 0) & (freq[window, place] > 0)
        window, place, term = window[fine], place[fine], term[fine]
        by = np.argsort(term, kind="stable")
        self.window, self.place, self.term = window[by], place[by], term[by]


class Search:
    """What a task needs to search segments: windows, and the order in which their terms' lists are intersected, by the terms' counts in the whole corpus."""

    def __init__(self, items, size: int, slack: int, df: np.ndarray):
        self.win, self.slack = Windows(items, size), slack
        self.span = size + slack
        rows, sets = self.win.rows, self.win.sets
        absent = ((rows >= 0) & (df[np.maximum(rows, 0)] == 0)).sum(axis=1) if len(rows) else np.zeros(0, np.int64)
        self.exact = Led(rows, np.flatnonzero(absent == 0), df, 1)
        held = (sets >= 0).sum(axis=1)
        missing = ((sets >= 0) & (df[np.maximum(sets, 0)] == 0)).sum(axis=1) if len(sets) else held
        self.least = np.maximum(held - slack, 1)  # terms that a stretch must hold
        self.near = Led(sets, np.flatnonzero((self.win.lens == size) & (missing <= slack) & (held > slack)), df, slack + 1)


class Segment:
    """The postings of the benchmark's terms in one segment, in one rising list of number * length + position."""

    def __init__(self, search: Search, terms: bytes, counts: bytes, positions: bytes):
        self.search = search
        number = np.fromiter(map(search.win.terms.get, terms.split(b" ") if terms else [], repeat(-1)), np.int64)
        count = np.frombuffer(counts, "<i4").astype(np.int64)
        begin = np.cumsum(count) - count
        mine = np.flatnonzero(number >= 0)
        self.nth = np.full(len(search.win.terms), -1, np.int64)  # of a term, among those here
        self.nth[number[mine]] = np.arange(len(mine))
        self.count = count[mine]
        self.begin = np.cumsum(self.count) - self.count
        at = np.repeat(begin[mine] - self.begin, self.count) + np.arange(int(self.count.sum()))
        self.position = np.frombuffer(positions, "<i4")[at].astype(np.int64)
        self.length = int(self.position.max(initial=0)) + 2 * GAP
        self.owner = np.repeat(np.arange(len(mine)), self.count)
        self.keys = self.owner * self.length + self.position

    def _candidates(self, led: Led):
        """(window, place of the leading term in it, its position) for all postings of leading terms, in bounded steps."""
        term = self.nth[led.term]
        some = np.flatnonzero(term >= 0)
        term, count = term[some], self.count[term[some]]
        ends = np.cumsum(count)
        for low in range(0, int(ends[-1]) if len(ends) else 0, STEP):
            nth = np.arange(low, min(low + STEP, int(ends[-1])))
            k = np.searchsorted(ends, nth, "right")
            position = self.position[self.begin[term[k]] + nth - (ends[k] - count[k])]
            yield led.window[some[k]], led.place[some[k]], position

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences as (window, position): the list of a window's rarest term, shifted by its place, intersected with the others' from rare to frequent."""
        led, rows, out = self.search.exact, self.search.win.rows, []
        for window, place, position in self._candidates(led):
            start = position - place
            for j in range(1, rows.shape[1]):
                o = led.order[window, j]
                want = rows[window, o]
                nth = self.nth[np.maximum(want, 0)]
                key = nth * self.length + start + o
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                keep = (want < 0) | ((nth >= 0) & (self.keys[at] == key))
                window, start = window[keep], start[keep]
                if not len(window):
                    break
            out.append((window, start))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i in (0, 1))

    def _may_stand(self) -> np.ndarray:
        """A filter of (term, block) in which a term's posting may be within reach of a place of the block."""
        bits = np.zeros(1 << BLOCK_BITS, bool)
        reach = self.search.span - 1
        low, high = (self.position - reach) >> BLOCK, (self.position + reach) >> BLOCK
        for block in range(int((high - low).max(initial=-1)) + 1):
            bits[self._bit(self.owner, np.minimum(low + block, high))] = True
        return bits

    @staticmethod
    def _bit(nth, block):
        return (nth * 0x9E3779B1 + block) & ((1 << BLOCK_BITS) - 1)

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) near which a stretch of size + slack words holds all but `slack` of the window's different terms, in any order.

        One of the slack + 1 rarest terms is in such a stretch, so their lists give the places;
        the other terms' lists are met from rare to frequent, and a place leaves once more than
        `slack` terms are out of reach. What is left is confirmed stretch by stretch.
        """
        led, sets, span = self.search.near, self.search.win.sets, self.search.span
        if not len(led.term) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        may, out = self._may_stand(), []
        for window, _, position in self._candidates(led):
            for exact in (False, True):
                miss = np.zeros(len(window), np.int64)
                for j in range(sets.shape[1]):
                    want = sets[window, led.order[window, j]]
                    nth = self.nth[np.maximum(want, 0)]
                    if exact:
                        low = nth * self.length + position - span + 1
                        at = np.searchsorted(self.keys, low)
                        there = (nth >= 0) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= low + 2 * span - 2)
                    else:
                        there = (nth >= 0) & may[self._bit(nth, position >> BLOCK)]
                    miss += (want >= 0) & ~there
                    keep = miss <= self.search.slack
                    if not keep.all():
                        window, position, miss = window[keep], position[keep], miss[keep]
                    if not len(window):
                        break
            if len(window):
                most = np.zeros(len(window), np.int64)
                for shift in range(span):
                    first = position - span + 1 + shift
                    held = np.zeros(len(window), np.int64)
                    for j in range(sets.shape[1]):
                        want = sets[window, j]
                        nth = self.nth[np.maximum(want, 0)]
                        low = nth * self.length + first
                        at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
                        held += (want >= 0) & (nth >= 0) & (self.keys[at] >= low) & (self.keys[at] <= low + span - 1)
                    np.maximum(most, held, out=most)
                keep = most >= self.search.least[window]
                out.append((window[keep], position[keep]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i in (0, 1))


def term_counts(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    """How often each of some terms stands in the whole corpus; a task sums its segments first."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        number = {t: k for k, t in enumerate(shared.value)}
        n = np.zeros(len(number), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                k = np.fromiter(map(number.get, terms.split(b" ") if terms else [], repeat(-1)), np.int64)
                some = k >= 0
                n[k[some]] += np.frombuffer(counts, "<i4")[some]
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    table = index.select("terms", "counts").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the slice
    out[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return out


def search_index(index: DataFrame, names: list[str], benchmark: DataFrame, window: int = 10, slack: int = 2) -> DataFrame:
    """The columns `names` that build_index kept, and n_words, n_hit, items, near of each document (see index_matches)."""
    if window + slack > GAP:
        raise ValueError(f"windows of {window} words and {slack} more cross the gap of {GAP} places between documents")
    parts = [_pass(index, items, window, slack, len(names)) for items in _slices(benchmark)]
    if len(parts) == 1:
        found = parts[0]
    else:

        def merged(spans):
            return F.aggregate(F.array_sort(F.flatten(spans)), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")), _merge_step, lambda a: a["n"])

        united = parts[0]
        for p in parts[1:]:
            united = united.unionByName(p)
        lists = {c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near")}
        firsts = [F.first(f"k{i}").alias(f"k{i}") for i in range(len(names))]
        found = united.groupBy("segment", "nth").agg(*firsts, F.max("n_words").alias("n_words"), merged(F.collect_list("spans")).alias("n_hit"), lists["items"], lists["near"])
    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(names)]
    return found.select(*kept, "n_words", "n_hit", "items", F.array_except("near", "items").alias("near"))


def _merge_step(a, s):
    return F.struct((a["n"] + F.greatest(s["e"] - F.greatest(s["s"], a["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["end"], s["e"]).alias("end"))


def _slices(benchmark: DataFrame) -> list[list[tuple[str | None, bytes]]]:
    """The benchmark in slices of bounded size, read one row at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    out, held = [[]], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        b = (r.t or "").encode()
        if out[-1] and held + len(b) > SLICE_BYTES:
            out.append([])
            held = 0
        out[-1].append((r.i, b))
        held += len(b)
    return out


def _pass(index: DataFrame, items, window: int, slack: int, n_kept: int) -> DataFrame:
    terms = list(Windows(items, window).terms)
    df = term_counts(index, terms)
    shared = index.sparkSession.sparkContext.broadcast((items, df))
    kept = [f"k{i}" for i in range(n_kept)]
    held: dict[str, Search] = {}
    spans_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def one(search: Search, row: dict[str, pa.Scalar]) -> pa.RecordBatch:
        seg = Segment(search, row["terms"].as_py(), row["counts"].as_py(), row["positions"].as_py())
        win, offset, n_words = search.win, row["offsets"].values.to_numpy(), row["n_words"].values.to_numpy()
        n = len(offset)
        hit, lists, near, where = np.zeros(n, np.int64), [set() for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
        if len(seg.keys):
            w, start = seg.phrases()
            edge = np.zeros(seg.length + win.size + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + win.lens[w], -1)
            covered = np.flatnonzero(np.cumsum(edge) > 0)
            if len(covered):
                breaks = np.flatnonzero(np.diff(covered) > 1)
                firsts, lasts = covered[np.r_[0, breaks + 1]], covered[np.r_[breaks, len(covered) - 1]]
                for d, a, b in zip((np.searchsorted(offset, firsts, "right") - 1).tolist(), firsts.tolist(), lasts.tolist(), strict=True):
                    where[d].append({"s": a - int(offset[d]), "e": b + 1 - int(offset[d])})
                    hit[d] += b + 1 - a
            for found, (w, at) in ((lists, (w, start)), (near, seg.stretches())):
                for d, k in {*zip((np.searchsorted(offset, at, "right") - 1).tolist(), w.tolist(), strict=True)}:
                    found[d].update(win.owners[k])
        names = [[sorted({win.items[k] for k in x if win.items[k] is not None}) for x in found] for found in (lists, near)]
        texts = pa.list_(pa.string())
        columns = {
            "segment": pa.array(np.full(n, row["segment"].as_py()), pa.int64()), "nth": pa.array(np.arange(n), pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(hit),
            "items": pa.array(names[0], texts), "near": pa.array(names[1], texts), "spans": pa.array(where, spans_type),
        }
        columns |= {k: row[k].values for k in kept}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches):
        for batch in batches:
            if "s" not in held:
                items, df = shared.value
                held["s"] = Search(items, window, slack, df)
            for i in range(batch.num_rows):
                yield one(held["s"], {c: batch.column(c)[i] for c in batch.schema.names})

    schema = "segment long, nth long, n_words long, n_hit long, items array<string>, near array<string>, spans array<struct<s:long,e:long>>"
    return index.mapInArrow(tidy(run), schema + "".join(f", {k} {index.schema[k].dataType.elementType.simpleString()}" for k in kept))


def index_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 2, text: str = "text") -> DataFrame:
    """Benchmark windows in each document: the columns of docs but the text, and n_words, n_hit, items, near.

    The documents' positional index is written once (build_index). The benchmark's terms are
    counted over it, and each segment is searched with the terms that are rarest in the whole
    corpus first. Words inside an exact occurrence of a window are hit, and items lists whose
    windows occur. near lists the other items of which a window's different terms stand, all but
    `slack` at most, among window + slack consecutive words, in any order.

    The benchmark is broadcast in slices of at most SLICE_BYTES; what several slices find in a
    document is merged. Columns named n_words, n_hit, items, near in docs are replaced.

    Defined cases: a null or empty text has no words, a very long one is a segment of its own;
    equal rows have equal results; an item without words matches nothing; an item of fewer than
    `window` words is one window (exact only); null item_ids are not listed; equal item_ids count
    once; an empty benchmark marks nothing; no documents give no rows; other columns don't matter.
    """
    base = docs.drop("n_words", "n_hit", "items", "near")
    names = [c for c in base.columns if c != text]
    return search_index(build_index(base, text), names, benchmark, window, slack)


def without_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """docs (all columns as they are) without the documents that hold a window of the benchmark.

    Rows are told apart by a digest of their text, as equal texts have equal verdicts; only rows
    that may go are shuffled. Null and empty texts stay; so do all rows for an empty benchmark.
    """
    key = fresh("__text", docs.columns)
    keyed = docs.withColumn(key, F.sha2(F.encode(text, "UTF-8"), 256))
    hits = index_matches(keyed.select(key, text), benchmark, window, 0, text).where("n_hit > 0")
    gone = written(hits.select(key).distinct(), "contaminated")
    maybe, rest = parted(keyed, key, gone, key)
    return rest.unionByName(maybe.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in keyed.columns))).drop(key)


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    found = index_matches(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near")
    )
