"""Rounds of joins until nothing changes, each written to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which executors share; local runs without one use a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):  # executors of a local cluster have folders of their own
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
            folder = tempfile.mkdtemp(prefix="codeloom-graph-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that what follows doesn't do it again, and knows its size. The folder goes when the application ends.

    A checkpointed plan would keep the size that its joins were guessed to give, which over rounds
    of joins grows beyond all measure.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver's program ends, as far as its session still runs."""
    if not _ending:
        atexit.register(_delete)
    _ending.append((spark, path))


def _delete() -> None:
    for spark, text in _ending:
        context = spark.sparkContext
        try:
            if context._jsc is not None and not context._jsc.sc().isStopped():
                path = context._jvm.org.apache.hadoop.fs.Path(text)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  (the JVM is gone)
            return


_ending: list[tuple[SparkSession, str]] = []


def checksum(df: DataFrame) -> tuple:
    """Equal for equal sets of rows, and for others only by chance: their number and the sum of their hashes."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).head())


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable, direction aside) of each end of edges(source_id, target_id).

    Each round links a node's larger neighbours to its least one, then smaller ones likewise, which
    needs a number of rounds that grows with the logarithm of the longest path. Null ends are left out.
    """
    pairs = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    links = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    everyone = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    now = checksum(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        new = cut(small.where("a <> b").distinct())
        links, before, now = new, now, checksum(new)
        if now == before:
            break
    return everyone.join(links, everyone.id == links.a, "left").select("id", F.coalesce("b", "id").alias("component"))


def moves(round_number: int) -> Column:
    """Whether the node `id` may change its label in a round: half of all nodes may, others each time."""
    return F.substring(F.md5(F.concat("id", F.lit(f"/{round_number}"))), 1, 1) < "8"


#: Links that may go to all tasks at once in a round of label propagation, and those that a bucket has.
SENT, BUCKET_LINKS = 500_000, 1_000_000


def _top(votes: DataFrame, state: DataFrame) -> DataFrame:
    """n and best of votes(n, label, v): the label of most votes, of equals the node's own, else the greatest."""
    best = F.max(F.struct("v", (F.col("label") == F.col("own")).alias("kept"), "label")).alias("x")
    return votes.join(state.select("n", F.col("label").alias("own")), "n").groupBy("n").agg(best).select("n", F.col("x.label").alias("best"))


def propagated_labels(edges: DataFrame, rounds: int = 40, weight: str | None = None) -> DataFrame:
    """id and label of each end of edges(source_id, target_id), direction aside, by label propagation.

    Each node starts as its own label. In a round, every neighbour votes for its label, once or with
    the weight of its edges; a node keeps its own label if no other has more votes, and else takes
    the one of most votes, of equals the greatest. As neighbours that change together can swap
    labels for ever, only half of the nodes, by a hash of id and round, change in a round. It ends
    when no node would change, or after the given rounds. Loops and null ends are left out.

    Ids are numbered in their order, and links are kept by one end, written once. A node's best
    label is kept, too, and found anew only if it or a neighbour has changed: after a few rounds
    these are few, and only their links go to the labels.
    """
    from codeloom.plans.stored import bucketed

    spark = edges.sparkSession
    a, b = F.col("source_id"), F.col("target_id")
    votes = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    pairs = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), votes.alias("w"))
    pairs = cut(pairs.groupBy("a", "b").agg((F.max if weight is None else F.sum)("w").alias("w")))
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    names = cut(degrees.orderBy("id").withColumn("n", F.monotonically_increasing_id()))
    everyone = names.count()
    for end in ("a", "b"):
        pairs = pairs.join(names.select(F.col("id").alias(end), F.struct("n", "d").alias(f"at_{end}")).hint("merge"), end).drop(end)
    links = pairs.select(F.explode(F.array(F.struct("at_a", "at_b", "w"), F.struct(F.col("at_b").alias("at_a"), F.col("at_a").alias("at_b"), "w"))).alias("x")).select("x.at_a.n", F.col("x.at_b.n").alias("other"), F.col("x.at_b.d").alias("d"), "x.w")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-everyone // BUCKET_LINKS))
    links = spark.table(bucketed(links, "n", buckets))

    def anew(state: DataFrame) -> DataFrame:
        """All nodes with their best labels: links meet the labels where they lie, and votes are moved once."""
        cast = links.join(state.select("n", "label").hint("merge"), "n").select(F.col("other").alias("n"), "label", "w")
        return state.drop("best").join(_top(cast.repartition(buckets, "n").groupBy("n", "label").agg(F.sum("w").alias("v")), state.hint("merge")).hint("merge"), "n")

    def mended(state: DataFrame, touched: DataFrame, way: str) -> DataFrame:
        """The same where only those touched can have another best label than before."""
        near = links.join(touched.select("n").hint(way), "n").select(F.col("n").alias("to"), F.col("other").alias("n"), "w")
        cast = state.select("n", "label").join(near.hint(way), "n").groupBy(F.col("to").alias("n"), "label").agg(F.sum("w").alias("v"))
        found = _top(cast.hint(way), state).withColumnRenamed("best", "found")
        return state.join(found.hint(way), "n", "left").withColumn("best", F.coalesce("found", "best")).drop("found")

    columns = ["n", "id", "d", "label", "best"]
    state = cut(anew(names.withColumn("label", F.col("n")).withColumn("best", F.col("n"))).select(columns))
    way = "merge"  # of a round's changes to what they meet
    for k in range(1, rounds + 1):
        go = (F.col("best") != F.col("label")) & moves(k)
        movers = state.where(go)
        touched = cut(links.join(movers.select("n").hint(way), "n").select(F.col("other").alias("n"), "d").unionByName(movers.select("n", "d")).distinct())
        count, near = touched.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).head()
        way = "broadcast" if near <= SENT else "merge"
        if count:
            now = state.withColumn("label", F.when(go, F.col("best")).otherwise(F.col("label")))
            last = k == rounds  # nothing asks for the best labels then
            state = cut((now if last else anew(now) if 2 * count > everyone else mended(now, touched, way)).select(columns))
        elif state.where("best <> label").isEmpty():
            break
    labels = names.select(F.col("n").alias("label"), F.col("id").alias("name"))
    return state.select("id", "label").join(labels, "label").select("id", F.col("name").alias("label"))
