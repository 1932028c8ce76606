"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python. Texts of 100 kB then make batches of 13 MB at most;
#: what a step computes at once is further bounded by PIECE_BYTES.
BATCH_ROWS = 128
#: Bytes of an Arrow batch at which it is handed on.
BATCH_BYTES = 16 << 20
#: Bytes of a row group of an intermediate table.
ROW_GROUP_BYTES = 16 << 20
#: Bytes of text that a vectorised step works on at once (a longer text is a piece by itself).
PIECE_BYTES = 512 << 10


def trim() -> None:
    """Give freed memory back to the system, as a worker process waits for its next task with all that it has."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def tidy(fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, and trim at the end of its task."""

    def run(batches):
        yield from fn(batches)
        trim()

    return run


def tidy_group(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """fn, and trim after each group."""

    def run(t):
        out = fn(t)
        trim()
        return out

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand Python fewer rows and bytes at a time than Spark's 10,000 and 64 MB, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: For tables of few, large rows: a row group's and a page's size is looked at after each row, not after a hundred, and no dictionary of such values is tried.
WIDE = {"parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


def written(df: DataFrame, label: str, wide: bool = False) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. Lost executors don't lose it.

    Row groups are small, as a task holds one whole while it writes or reads rows of some size;
    wide says that a row may have a megabyte.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).options(**(WIDE if wide else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(col: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts sum to at most `limit` bytes (or hold one longer text)."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def map_pieces(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = PIECE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded text size; fn maps a slice to a record batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, limit):
                yield fn(piece)

    return df.mapInArrow(tidy(run), schema)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of those taken is equal to, letter case aside."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def crc_mod(col: str, m: int):
    """crc32 of an integer id as text, modulo m."""
    return F.crc32(F.col(col).cast("string")) % m


#: Bits of the filter of ids: 8 MB, however many ids there are.
ID_FILTER_BITS = 1 << 26


def id_place(col: str):
    """The place of an id in the filter."""
    return F.pmod(F.xxhash64(col), F.lit(ID_FILTER_BITS))


def id_filter(df: DataFrame, col: str) -> np.ndarray:
    """A bit for each hash of an id, gathered as bitmaps of 32768 places (at most 2048 rows come to the driver).

    It saves moving rows that have no partner in a later join; the join decides. With more ids
    than bits, it lets nearly all through.
    """
    place = id_place(col) + 1  # Spark's bitmap functions count from 1
    bits = np.zeros(ID_FILTER_BITS // 8, np.uint8)
    for r in df.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).toLocalIterator():
        part = np.frombuffer(bytes(r.m), np.uint8)
        bits[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(part)] |= part
    return bits


def has_place(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7)) & 1 == 1


def parted(df: DataFrame, col: str, ids: DataFrame, ids_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose col may be among ids, and those whose col surely isn't: only the first need to meet ids in a join."""
    shared = df.sparkSession.sparkContext.broadcast(id_filter(ids, ids_col))
    small_batches(df.sparkSession)
    mark = fresh("__place", df.columns)
    marked = df.withColumn(mark, F.when(F.col(col).isNotNull(), id_place(col)))

    def pick(want: bool) -> DataFrame:
        def run(batches):
            bits = shared.value
            for batch in batches:
                place = batch.column(mark)
                has = has_place(bits, place.fill_null(0).to_numpy()) & ~place.is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(has == want)).drop_columns([mark])

        return marked.mapInArrow(tidy(run), df.schema)

    return pick(True), pick(False)


def packed(fn: Callable[[Iterator[pa.RecordBatch]], object]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow with the schema "part binary": one row a task, what fn makes of its batches (none, if that is None)."""

    def run(batches):
        part = fn(iter(batches))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary())], names=["part"])

    return run


def tree_merged(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], object], add: Callable[[object, object], object]):
    """fn over each task's batches, merged by add in a tree over the executors: the driver gets a few parts only. None without parts."""

    def both(a, b):
        return b if a is None else a if b is None else add(a, b)

    return df.mapInArrow(tidy(packed(fn)), "part binary").rdd.treeAggregate(None, lambda a, r: both(a, pickle.loads(r.part)), both)


def row_slices(rows: Iterable, size: Callable[[object], int], limit: int) -> Iterator[list]:
    """Rows in lists of at most `limit` bytes (or one larger row), one list at a time."""
    held, n = [], 0
    for r in rows:
        b = size(r)
        if held and n + b > limit:
            yield held
            held, n = [], 0
        held.append(r)
        n += b
    if held:
        yield held
