"""A graph written once and kept by its keys, so that lookups, joins and traversals read only what they need."""

from __future__ import annotations

import hashlib
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from codeloom.graph import PropertyGraph
from codeloom.plans.fixpoint import delete_at_end, shared_folder

#: Bytes of input for a bucket, at most.
BUCKET_BYTES = 16 << 20


def fingerprint(spark: SparkSession, paths: list[str]) -> tuple[str, int]:
    """What tells whether the files of some tables are still the same (names, lengths, times), and their bytes."""
    said, total = hashlib.sha256(), 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for text in sorted(paths):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        files = path.getFileSystem(conf).listFiles(path, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        total += sum(n for _, n, _ in found)
        said.update(repr((text, sorted(found))).encode())
    return said.hexdigest(), total


def bucketed(df: DataFrame, key: str, buckets: int, parts: str | None = None, settle: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """The name of a table with df's rows in the shared folder: in `buckets` by the key's hash, sorted by it, and in a folder for each value of `parts`. settle maps the rows once they are there, and moves none.

    A lookup by key reads one bucket, and in it the row groups whose range holds the key; a join on
    it needs no shuffle of the table.
    """
    spark = df.sparkSession
    name = f"codeloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    rows = df.repartition(buckets, key)
    rows = settle(rows) if settle else rows
    writer = rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd")
    (writer.partitionBy(parts) if parts else writer).saveAsTable(name)
    delete_at_end(spark, path)
    return name


def buckets_for(input_bytes: int) -> int:
    """As many as keep a bucket's rows in a task's memory while they are sorted, whatever the input's size."""
    return max(2, -(-input_bytes // BUCKET_BYTES))


class StoredGraph(PropertyGraph):
    """A graph whose tables are written when first asked for: nodes by id, edges by source and, if asked for so, a second time by target; edges lie apart by type, which most questions name.

    ends are the edges without the id, which edge_id computes from the other columns when it is read,
    as it would be most of a table's bytes. settle makes edges of them once they lie by their key, so
    that what it merges isn't moved twice. The second table of edges is made from the first.
    """

    def __init__(self, nodes: DataFrame, ends: DataFrame, edge_id: Column, buckets: int, settle: Callable[[DataFrame], DataFrame] | None = None):
        self._given, self._ends, self._id, self._buckets, self._settle = nodes, ends, edge_id, buckets, settle
        self._names: dict[str, str] = {}

    @property
    def nodes(self) -> DataFrame:
        if "id" not in self._names:
            self._names["id"] = bucketed(self._given, "id", self._buckets)
        return self._given.sparkSession.table(self._names["id"])

    def _edges_by(self, key: str) -> DataFrame:
        spark = self._ends.sparkSession
        columns = (self._settle(self._ends) if self._settle else self._ends).columns
        if key not in self._names:
            other = next((spark.table(n) for k, n in self._names.items() if k != "id"), None)
            self._names[key] = bucketed(self._ends, key, self._buckets, "edge_type", self._settle) if other is None else bucketed(other.select(columns), key, self._buckets, "edge_type")
        return spark.table(self._names[key]).select(self._id.alias("id"), *columns)

    @property
    def edges(self) -> DataFrame:
        return self._edges_by("source_id")

    @property
    def by_target(self) -> DataFrame:
        return self._edges_by("target_id")
