"""Balanced contiguous shards from global prefix sums of bytes."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ORDER = ("text_crc32", "size", "h", "doc_id")
GROUP = ORDER[:3]


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, keep_share: float = 0.02) -> DataFrame:
    """Cut the documents, in one global order, into n_shards runs of near equal bytes.

    The order is by checksum, size and digest of the text, then doc_id, so equal texts stand together. Rows are range
    partitioned by it, each partition sums its own bytes and rows, the totals of all partitions
    give each its offset, and the cuts are at i/n of all bytes. A cut inside a group of equal
    texts moves to the group's nearer end if the group takes no more than `keep_share` of a
    shard; a larger group is split at the row next to the cut, as balance is the law.

    Only sizes and hashes are shuffled, never texts. A group that holds a third of all rows is
    split over range partitions by doc_id. The driver gets a total per partition and n - 1 cuts.

    Input: doc_id, text, any other columns (ignored). Defined cases: a null text has no bytes
    (size 1, like an empty one, checksum 0); a null doc_id sorts first; repeated rows are each
    placed; no rows give no rows; fewer rows than shards leave shards empty.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard),
    grown_shard (null: only a law by key grows without moving rows).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.substring(F.md5(text), 1, 16).alias("h"))

    def local_sums(batches):
        import numpy as np
        import pyarrow as pa

        pid, before, row = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = b.column("size").to_numpy(zero_copy_only=False)
            ends = np.cumsum(size) + before
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "size", "text_crc32", "h")), pa.array(np.full(len(size), pid, np.int32)), pa.array(ends - size), pa.array(np.arange(row, row + len(size)))],
                names=["doc_id", "size", "text_crc32", "h", "pid", "start", "row"],
            )
            if len(size):
                before, row = int(ends[-1]), row + len(size)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    local = written(ordered.mapInArrow(local_sums, f"doc_id {id_type}, size long, text_crc32 long, h string, pid int, start long, row long"), "shards")

    before_bytes, before_rows, offsets = 0, 0, []
    for r in local.groupBy("pid").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("pid").collect():  # one row per partition
        offsets.append((r.pid, before_bytes, before_rows))
        before_bytes, before_rows = before_bytes + r.b, before_rows + r.n
    total = before_bytes
    offs = spark.createDataFrame(offsets, "pid int, b0 long, n0 long")
    placed = local.join(F.broadcast(offs), "pid").withColumns({"start": F.col("start") + F.col("b0"), "rank": F.col("row") + F.col("n0")})

    cuts = _cuts(placed, total, n_shards, keep_share)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("start") >= F.lit(c)).cast("int")
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _cuts(placed: DataFrame, total: int, n: int, keep_share: float) -> list[int]:
    """The byte positions, each at a row's start, where shards 1 to n - 1 begin."""
    targets = [total * i // n for i in range(1, n)]
    if not total:
        return targets
    crosses = F.lit(False)
    for t in targets:
        crosses = crosses | ((F.col("start") <= t) & (F.col("start") + F.col("size") > t))
    hit = placed.where(crosses).select("start", "size", *GROUP).collect()  # n - 1 rows at most
    same = F.lit(False)
    for r in hit:
        same = same | ((F.col("text_crc32") == r.text_crc32) & (F.col("size") == r["size"]) & (F.col("h") == r.h))
    spans = {(r.text_crc32, r["size"], r.h): (r.s, r.e) for r in placed.where(same).groupBy(*GROUP).agg(F.min("start").alias("s"), F.max(F.col("start") + F.col("size")).alias("e")).collect()}
    out = []
    for t in targets:
        row = next(r for r in hit if r.start <= t < r.start + r["size"])
        s, e = spans[(row.text_crc32, row["size"], row.h)]
        if e - s > keep_share * total / n:
            s, e = row.start, row.start + row["size"]
        out.append(s if t - s <= e - t else e)
    return out
