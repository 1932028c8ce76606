"""The queries over tasks: a part needs the parts of half and a third of its key; an order is done, waits or is in work by its status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom import measures
from codeloom.catalog import query
from codeloom.operators import tasks
from codeloom.plans.star import bound

LINKS = "links AS (SELECT concat('p', p_partkey) AS task, concat('p', p_partkey // d) AS needs FROM part, (VALUES (2), (3)) t(d) WHERE p_partkey // d > 0)"
TASKS = "tasks AS (SELECT concat('p', p_partkey) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'done' ELSE 'pending' END AS status FROM part)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.explode(F.array(F.lit(2), F.lit(3))).alias("d"))
    needs = F.floor(F.col("p_partkey") / F.col("d"))
    return keys.where(needs > 0).select(F.concat(F.lit("p"), "p_partkey").alias("task"), F.concat(F.lit("p"), needs).alias("needs"))


@query("SELECT id, CAST(min(d) AS INT) AS depth FROM r GROUP BY id", LINKS, "r(id, d) AS (SELECT needs, 1 FROM links WHERE task = 'p150' UNION SELECT needs, d + 1 FROM links JOIN r ON task = id)")
def d2_dependencies(spark, sf_dir):
    return tasks.dependencies(links(spark, sf_dir), "p150")


ASKED = "asked(a, b) AS (VALUES ('p9', 'p150'), ('p150', 'p149'), ('p7', 'p7'))"


@query("SELECT concat(a, ' needs ', b) AS link, a = b OR EXISTS (SELECT 1 FROM under WHERE x = b AND y = a) AS makes_cycle FROM asked", LINKS, ASKED, "under(x, y) AS (SELECT b, needs FROM asked JOIN links ON task = b UNION SELECT x, needs FROM under JOIN links ON task = y)")
def d3_makes_cycle(spark, sf_dir):
    found = links(spark, sf_dir)
    return spark.createDataFrame([(f"{a} needs {b}", tasks.makes_cycle(found, a, b)) for a, b in (("p9", "p150"), ("p150", "p149"), ("p7", "p7"))], "link string, makes_cycle boolean")


@query("SELECT task, needs FROM links JOIN tasks ON id = needs WHERE status <> 'done'", LINKS, TASKS)
def d4_blocked_by(spark, sf_dir):
    status = F.when(F.col("p_partkey") % 4 == 0, "done").otherwise("pending")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), "p_partkey").alias("id"), status.alias("status"))
    return tasks.blocked_by(rows, links(spark, sf_dir))


@query(
    "SELECT o_orderkey, next_day, len([k for k in range(1, CAST(n AS BIGINT) + 1) if isodow(o_orderdate + to_days(CAST(k AS INT))) < 6]) AS business_days FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 40 AS n, "
    "o_orderdate + to_days(CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS next_day FROM orders)"
)
def d11_business_days(spark, sf_dir):
    end = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 40).cast("int"), F.lit(5))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select("o_orderkey", tasks.next_business_day("o_orderdate").alias("next_day"), tasks.business_days("o_orderdate", end).alias("business_days"))


def order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: due ten days after their date, but every seventh at no time."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("by Customer "), "o_custkey").alias("description"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), F.col("o_custkey").alias("assignee"), F.array(F.col("o_orderstatus"), F.concat(F.lit("t"), key % 5)).alias("tags"),
        F.when(key % 7 > 0, day + F.expr("INTERVAL 10 DAY")).alias("due"), day.alias("created"), key.alias("ordinal"),
    )


ORDER_TASKS = (
    "order_tasks AS (SELECT o_orderkey AS id, o_orderpriority AS title, concat('by Customer ', o_custkey) AS description, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status, CAST(o_orderpriority[1] AS INT) AS priority, o_custkey AS assignee, "
    "[o_orderstatus, concat('t', o_orderkey % 5)] AS tags, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate + INTERVAL 10 DAY END AS due, o_orderdate AS created FROM orders)"
)


@query(
    "SELECT id, status, priority, due FROM order_tasks WHERE (contains(lower(title), 'customer 1') OR contains(lower(description), 'customer 1')) AND priority >= 2 AND list_contains(tags, 't3') AND due < TIMESTAMP '1999-01-01' AND status <> 'done' "
    "ORDER BY coalesce(due, TIMESTAMP '9999-12-31') DESC, id LIMIT 50",
    ORDER_TASKS,
)
def d1_search_tasks(spark, sf_dir):
    """The fifty that were due last, of all that meet five conditions."""
    found = measures.search_tasks(order_tasks(spark, sf_dir), "CUSTOMER 1", least_priority=2, tag="t3", overdue_at=F.to_timestamp(F.lit("1999-01-01")), sort_by="due_date")
    return found.limit(50).select("id", "status", "priority", "due")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def d10_merged(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = lambda i: rows.where(F.col("event_id") % 2 == i).groupBy("event_type").agg(F.count("*").alias("n"))
    return measures.merged(half(0), half(1), "event_type", "n")


METRICS = """
SELECT CASE event_id % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' ELSE 'histogram' END AS kind, event_type AS name, event_id % 2 AS side, value, event_id FROM {events}
"""
STATES = (
    f"metrics AS ({METRICS.format(events='events')})",
    "states AS (SELECT kind, name, side, 0 AS place, CAST(count(*) AS DOUBLE) AS value FROM metrics WHERE kind = 'counter' GROUP BY ALL UNION ALL SELECT kind, name, side, 0, arg_max(value, event_id) FROM metrics WHERE kind = 'gauge' GROUP BY ALL "
    "UNION ALL SELECT kind, name, side, row_number() OVER (PARTITION BY name, side ORDER BY event_id) - 1, value FROM metrics WHERE kind = 'histogram')",
)


@query(
    "SELECT kind, name, CAST(0 AS BIGINT) AS place, sum(value) AS value FROM states WHERE kind = 'counter' GROUP BY kind, name UNION ALL SELECT kind, name, 0, arg_max(value, side) FROM states WHERE kind = 'gauge' GROUP BY kind, name "
    "UNION ALL SELECT kind, name, place + CASE side WHEN 1 THEN coalesce((SELECT count(*) FROM states l WHERE l.kind = 'histogram' AND l.name = states.name AND l.side = 0), 0) ELSE 0 END, value FROM states WHERE kind = 'histogram'",
    *STATES,
)
def d10_merged_metrics(spark, sf_dir):
    """Two collectors' counters, gauges and histograms put together."""
    rows = bound(spark, sf_dir, METRICS)

    def state(side: int) -> DataFrame:
        mine = rows.where(F.col("side") == side)
        counted = mine.where("kind = 'counter'").groupBy("kind", "name").agg(F.lit(0).cast("long").alias("place"), F.count("*").cast("double").alias("value"))
        last = mine.where("kind = 'gauge'").groupBy("kind", "name").agg(F.lit(0).cast("long").alias("place"), F.max_by("value", "event_id").alias("value"))
        order = F.row_number().over(Window.partitionBy("name").orderBy("event_id")) - 1
        return counted.unionByName(last).unionByName(mine.where("kind = 'histogram'").select("kind", "name", order.cast("long").alias("place"), "value"))

    return measures.merged_metrics(state(0), state(1))
