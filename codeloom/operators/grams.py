"""Nodes by a part of their name, through an index of the names' character trigrams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.stored import bucketed

#: Characters of a gram; a shorter part is looked for in all names.
SIZE = 3


@dataclass(frozen=True)
class GramIndex:
    """Tables by name: grams(gram, key), the postings, kept by gram; and names(key, ...), the nodes by their name in lower case."""

    grams: str
    names: str


def grams_of(key: Column) -> Column:
    """The different trigrams of a text; none of a shorter one."""
    places = F.when(F.length(key) >= SIZE, F.sequence(F.lit(1), F.length(key) - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(key, i, F.lit(SIZE))))


def build_grams(nodes: DataFrame, buckets: int = 8) -> GramIndex:
    """The index of the nodes' names. A name counts once, however many nodes have it."""
    named = nodes.where("name IS NOT NULL").withColumn("key", F.lower("name"))
    postings = named.select("key").distinct().select(F.explode(grams_of(F.col("key"))).alias("gram"), "key")
    return GramIndex(bucketed(postings, "gram", buckets), bucketed(named, "key", buckets))


def names_with(spark: SparkSession, index: GramIndex, part: str) -> DataFrame:
    """key of the names that hold the part, letter case aside: those that hold all its trigrams, checked then."""
    part = part.lower()
    wanted = sorted({part[i : i + SIZE] for i in range(len(part) - SIZE + 1)})
    if not wanted:
        return spark.table(index.names).select("key").distinct().where(F.contains("key", F.lit(part)))
    lists = spark.table(index.grams).where(F.col("gram").isin(*wanted))
    return lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("key").where(F.contains("key", F.lit(part)))


def nodes_with(spark: SparkSession, index: GramIndex, part: str, ignore_case: bool = True) -> DataFrame:
    """The nodes whose name holds the part. The table of nodes is joined by the key that it is kept by, and isn't moved."""
    found = spark.table(index.names).join(names_with(spark, index, part), "key")
    return (found if ignore_case else found.where(F.contains("name", F.lit(part)))).drop("key")
