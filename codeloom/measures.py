"""Measures over records of tasks, projects and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def progress(tasks: DataFrame, project: str, done: Column) -> DataFrame:
    """Per project: total, done and their share, 0 without tasks."""
    counts = tasks.groupBy(project).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"))
    return counts.withColumn("share", F.coalesce(F.try_divide("done", "total"), F.lit(0.0)))


def counts_where(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return rows.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


def nearest_rank(rows: DataFrame, key: str, value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Per key: n, least, greatest and mean value, and percentiles by nearest rank: the value at place n * p / 100, rounded down, counted from 0.

    Exact: equal values of a key are counted first, so a key of many rows with few values is no
    large group. Nulls are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(key).orderBy(value)
    upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(key, value, "c", upto.alias("upto"), F.sum("c").over(Window.partitionBy(key)).alias("n"))
    picks = []
    for p in percents:
        place = F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
        picks.append(F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col(value))).alias(f"p{p}"))
    return placed.groupBy(key).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("mean"), *picks)


def trailing_rate(events: DataFrame, key: str, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Each event with its key's number of events in the `seconds` up to it, itself and equal times included, and their rate a second."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = Window.partitionBy(key).orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    counted = events.withColumn("__at", at).withColumn("in_window", F.count("*").over(span)).drop("__at")
    return counted.withColumn("rate", F.col("in_window") / seconds)


#: What tasks are sorted by, with the priority for any other name; one without a date comes as due on the last day.
SORTS = {"priority": "priority", "created": "created", "due_date": "due", "status": "status"}
LAST_DAY = "9999-12-31"


def search_tasks(
    tasks: DataFrame, keyword: str | None = None, texts: tuple[str, ...] = ("title", "description"), least_priority: int | None = None, tag: str | None = None, overdue_at: Column | None = None, done: str = "done", sort_by: str | None = None, ascending: bool = False, **equal
) -> DataFrame:
    """Tasks that hold the keyword in one of the texts, letter case aside, and meet all that is asked for.

    least_priority bounds priority from below; tag is one of tags; with overdue_at, due lies before
    it and status isn't done; the others name columns and their values. sort_by sorts, the greatest
    first unless ascending, and equal ones by ordinal if there is one.
    """
    found = tasks
    if keyword:
        holds = F.lit(False)
        for t in texts:
            holds = holds | F.coalesce(F.contains(F.lower(t), F.lit(keyword.lower())), F.lit(False))
        found = found.where(holds)
    if least_priority is not None:
        found = found.where(F.col("priority") >= least_priority)
    if tag is not None:
        found = found.where(F.array_contains("tags", tag))
    if overdue_at is not None:
        found = found.where((F.col("due") < overdue_at) & ~F.coalesce(F.col("status") == done, F.lit(False)))
    for column, value in equal.items():
        found = found.where(F.col(column) == value)
    if sort_by is not None:
        by = SORTS.get(sort_by, "priority")
        key = F.coalesce("due", F.to_timestamp(F.lit(LAST_DAY))) if by == "due" else F.col(by)
        found = found.orderBy(key.asc() if ascending else key.desc(), *(["ordinal"] if "ordinal" in tasks.columns else []))
    return found


def merged(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Counts of two states summed by key."""
    return left.select(key, count).unionByName(right.select(key, count)).groupBy(key).agg(F.sum(count).alias(count))


def merged_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """kind, name, place and value of two states of metrics put together.

    Counters of a name are summed, of gauges the right one stays, and the right histogram's values
    follow the left one's: their places are counted on from the left one's number. place is 0
    for counters and gauges.
    """
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    summed = both.where("kind = 'counter'").groupBy("kind", "name").agg(F.lit(0).cast("long").alias("place"), F.sum("value").alias("value"))
    last = both.where("kind = 'gauge'").groupBy("kind", "name").agg(F.lit(0).cast("long").alias("place"), F.max_by("value", "side").alias("value"))
    before = left.where("kind = 'histogram'").groupBy("name").agg(F.count("*").alias("n"))
    listed = both.where("kind = 'histogram'").join(before, "name", "left")
    place = F.col("place") + F.when(F.col("side") == 1, F.coalesce("n", F.lit(0))).otherwise(0)
    columns = ["kind", "name", "place", "value"]
    return summed.select(columns).unionByName(last.select(columns)).unionByName(listed.select("kind", "name", place.cast("long").alias("place"), "value"))
