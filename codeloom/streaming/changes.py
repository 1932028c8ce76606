"""Changes of files over time; each function takes a batch, and those named so a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, gap: str = "300 milliseconds", watermark: str | None = None) -> DataFrame:
    """One event a file and burst of events(ts, file_path, event_type): the latest, but a deletion stays.

    Works on streams when a watermark is given; late events past it are dropped by Spark.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    kind = F.when(F.bool_or(F.col("event_type") == "deleted"), "deleted").otherwise(F.max_by("event_type", "ts"))
    return rows.groupBy("file_path", F.session_window("ts", gap).alias("w")).agg(kind.alias("event_type"), F.max("ts").alias("ts"), F.count("*").alias("n")).drop("w")


def signature(*parts: str | Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])


def snapshot_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("file_path", "name", "label")) -> DataFrame:
    """Keys whose rows came, went or changed signature: the keys and change ("added", "removed" or "modified").

    Both have the keys, signature and ordinal; of several rows for a key the last counts.
    """
    last = lambda df: df.groupBy(*keys).agg(F.max_by("signature", "ordinal").alias("signature"))
    both = last(before).withColumnRenamed("signature", "old").join(last(after).withColumnRenamed("signature", "new"), list(keys), "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


def version_changes(rows: DataFrame, key: str, order: list, value: Column) -> DataFrame:
    """Every row with what it changed against the one before of its key: change is "added", "modified" or "same"."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("change", F.when(before.isNull(), "added").when(before != value, "modified").otherwise("same"))


def newest(events: DataFrame, order: list, limit: int = 50, kept: int = 500) -> DataFrame:
    """The newest events, no more than a ring buffer of `kept` holds."""
    return events.orderBy(*order).limit(min(limit, kept))


def session_summary(events: DataFrame) -> DataFrame:
    """Events by type, with the files they touch and their first and last times."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def shown(events: DataFrame, key: str, gap: str = "5 seconds") -> DataFrame:
    """What a viewer shows of bursts of events(ts, key) over all files: the first of each, and the last if there are more. first_of tells them apart.

    The bursts come from a session window, a row a burst, so that no burst is held together.
    """
    bursts = events.groupBy(F.session_window("ts", gap).alias("w")).agg(F.min(F.struct("ts", key)).alias("a"), F.max(F.struct("ts", key)).alias("b"))
    ends = bursts.select(F.explode(F.array(F.struct(F.col(f"a.{key}").alias(key), F.lit(True).alias("first_of")), F.struct(F.col(f"b.{key}").alias(key), F.lit(False).alias("first_of")))).alias("x")).select("x.*")
    return events.join(ends.groupBy(key).agg(F.bool_or("first_of").alias("first_of")), key)


def session_panel(rows: DataFrame, order: list, kept: int = 100) -> DataFrame:
    """One row over the newest events, whose lists added, modified and removed hold names: their sizes summed, how many are of high risk, and n."""
    newest_rows = rows.orderBy(*order).limit(kept)
    sums = [F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in ("added", "modified", "removed")]
    return newest_rows.agg(*sums, F.count_if(F.col("risk").isin("HIGH", "CRITICAL")).alias("high_risk"), F.count("*").alias("n"))


def line_of() -> Column:
    """One line on a change of columns ts, event_type, file_path, added, modified, removed, risk and affected."""
    mark = F.when(F.col("event_type") == "created", "+").when(F.col("event_type") == "modified", "~").when(F.col("event_type") == "deleted", "-").otherwise("?")
    name = F.when(F.coalesce(F.col("file_path"), F.lit("")) == "", "unknown").otherwise(F.element_at(F.split("file_path", "/"), -1))
    sizes = [F.when(F.size(c) > 0, F.concat(F.lit(sign), F.size(c), F.lit(f" {word}"))) for c, sign, word in (("added", "+", "new"), ("modified", "~", "mod"), ("removed", "-", "del"))]
    counts = F.concat_ws(", ", *sizes)
    return F.concat_ws(
        " ", F.date_format("ts", "'['HH:mm:ss']'"), mark, name, F.when(counts != "", F.concat(F.lit("("), counts, F.lit(")"))), F.concat(F.lit("["), "risk", F.lit("]")),
        F.when(F.col("affected") > 0, F.concat(F.lit("→ "), "affected", F.lit(" affected"))),
    )


def summary_lines(rows: DataFrame, groups: Column) -> DataFrame:
    """place and line of a text on a session's events (file_path, added, modified, removed, risk); groups is an array of names."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(groups))))
    one = rows.agg(
        F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), *(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in ("added", "modified", "removed")),
        F.count_if(F.col("risk").isin("HIGH", "CRITICAL")).alias("high"), names.alias("groups"),
    )
    nodes = F.concat(F.lit("Nodes:    +"), "added", F.lit(" added  ~"), "modified", F.lit(" modified  -"), "removed", F.lit(" removed"))
    said = F.array(
        F.lit("── Session Summary ──"), F.concat(F.lit("Changes:  "), "n"), F.concat(F.lit("Files:    "), "files"), nodes, F.concat(F.lit("High risk: "), "high"),
        F.when(F.size("groups") > 0, F.concat(F.lit("Groups:   "), F.array_join("groups", ", "))),
    )
    return one.select(F.posexplode(F.filter(said, lambda x: x.isNotNull())).alias("place", "line"))
