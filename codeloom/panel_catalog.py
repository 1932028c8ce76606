"""The queries over changes and their views, each with its SQL for DuckDB; a file of a nation stands for what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.catalog import EVENTS, SPOTS, TEST, commits, events, on_graph, query
from codeloom.operators import health, panels
from codeloom.plans.star import star_graph
from codeloom.sources import slices
from codeloom.streaming import changes

CHANGED = "changed AS (SELECT id FROM nodes WHERE file_path = (SELECT file_path FROM nodes WHERE id = 'fn:c5'))"
STORY = (
    CHANGED,
    "story AS (SELECT DISTINCT 'out' AS direction, target_id AS id FROM edges WHERE edge_type = 'CALLS' AND source_id IN (SELECT id FROM changed) AND target_id NOT IN (SELECT id FROM changed) "
    "UNION SELECT 'in', source_id FROM edges WHERE edge_type = 'CALLS' AND target_id IN (SELECT id FROM changed) AND source_id NOT IN (SELECT id FROM changed))",
)


def changed(g, member: str = "fn:c5") -> DataFrame:
    path = g.node(member).select("file_path")
    return g.nodes.join(F.broadcast(path), "file_path").select("id")


@on_graph("SELECT direction, s.id, n.name, n.label, split_part(n.file_path, '/', -1) AS file FROM story s JOIN nodes n ON n.id = s.id", *STORY)
def st16_change_story(g):
    return panels.change_story(g, changed(g))


@on_graph(
    "SELECT id, name, label, role FROM (SELECT n.id, name, label, ordinal, 'changed' AS role, 0 AS k FROM nodes n JOIN picked USING (id) UNION ALL SELECT * FROM (SELECT n.id, name, label, ordinal, role, row_number() OVER (ORDER BY ordinal, n.id) AS k FROM nodes n JOIN around USING (id))) WHERE k <= 60 - (SELECT count(*) FROM picked) OR k = 0",
    "picked AS (SELECT id FROM nodes WHERE id IN ('fn:c5', 'fn:p1', 'm:o1'))",
    "around AS (SELECT id, CASE WHEN bool_or(d) THEN 'caller' ELSE 'callee' END AS role FROM (SELECT source_id AS id, true AS d FROM edges WHERE edge_type = 'CALLS' AND target_id IN (SELECT id FROM picked) UNION ALL SELECT target_id, false FROM edges WHERE edge_type = 'CALLS' AND source_id IN (SELECT id FROM picked)) WHERE id NOT IN (SELECT id FROM picked) GROUP BY id)",
)
def st17_impact_nodes(g):
    return panels.impact_nodes(g, g.nodes.where(F.col("id").isin("fn:c5", "fn:p1", "m:o1")).select("id"), expanded="fn:p1")


@on_graph("SELECT source_id, target_id, edge_type FROM edges WHERE edge_type IN ('CALLS', 'IMPORTS') AND source_id IN (SELECT id FROM changed) AND target_id IN (SELECT id FROM changed)", CHANGED)
def st17_impact_links(g):
    return panels.links_among(g, changed(g))


@on_graph(
    "SELECT id, min(d) AS depth FROM (SELECT b AS id, 1 AS d FROM links JOIN changed ON a = id UNION ALL SELECT y.b, 2 FROM changed JOIN links x ON x.a = id JOIN links y ON y.a = x.b) WHERE id NOT IN (SELECT id FROM changed) GROUP BY id",
    CHANGED,
    "links AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges)",
)
def st18_change_chain(g):
    return panels.change_chain(g, changed(g))


@on_graph(
    "SELECT changed, direction, place, id, greatest(total - 10, 0) AS more FROM (SELECT own AS changed, direction, t.id, row_number() OVER (PARTITION BY own, direction ORDER BY n.ordinal, n.id) AS place, count(*) OVER (PARTITION BY own, direction) AS total FROM "
    "(SELECT source_id AS own, 'out' AS direction, target_id AS id FROM edges WHERE edge_type = 'CALLS' UNION ALL SELECT target_id, 'in', source_id FROM edges WHERE edge_type = 'CALLS') t JOIN nodes n ON n.id = t.id WHERE own IN (SELECT id FROM changed) AND own NOT LIKE 'file:%') WHERE place <= 10",
    CHANGED,
)
def u2_impact_tree(g):
    return panels.impact_tree(g, changed(g))


@on_graph(
    f"SELECT file_path, n.name, CAST(1 AS INT) AS depth FROM edges e JOIN nodes n ON n.id = e.source_id WHERE edge_type = 'CALLS' AND target_id IN (SELECT id FROM nodes WHERE id LIKE 'fn:p%' ORDER BY ordinal LIMIT 5) AND {TEST.format('file_path')} GROUP BY file_path, n.name"
)
def u1_merged_tests(g):
    parts = g.nodes.where("id LIKE 'fn:p%'").select(F.col("id").alias("seed"), "id", "ordinal")
    return panels.merged_tests(g, parts, "ordinal")


@on_graph(
    "SELECT name, id, true AS exact FROM targets JOIN gone USING (name) UNION ALL SELECT name, story.id, false FROM gone, story WHERE direction = 'in' AND name NOT IN (SELECT name FROM targets)",
    *(part.replace("fn:c5", "fn:p1") for part in STORY),
    "gone AS (SELECT name FROM nodes WHERE id = 'fn:p1' UNION SELECT 'nothing_so_named')",
    "targets AS (SELECT DISTINCT n.name, e.source_id AS id FROM story s JOIN edges e ON e.source_id = s.id JOIN nodes n ON n.id = e.target_id WHERE s.direction = 'in')",
)
def u4_removed_callers(g):
    names = g.node("fn:p1").select("name")
    return panels.removed_callers(g, changed(g, "fn:p1"), names.unionByName(names.sparkSession.createDataFrame([("nothing_so_named",)], "name string")))


@on_graph("SELECT id, CAST(2 AS INT) AS tier FROM nodes WHERE name IN (SELECT name FROM nodes WHERE id IN ('fn:s1', 'fn:s2')) AND file_path LIKE '%test_s.py'")
def u5_match_by_name(g):
    none = g.nodes.select("id").limit(0)
    return panels.match_changed(g, none, g.nodes.where(F.col("id").isin("fn:s1", "fn:s2")).select("name"), "/w/EUROPE/FRANCE/test_s.py")


@on_graph("SELECT id, CAST(3 AS INT) AS tier FROM nodes WHERE file_path LIKE '%test_s.py'")
def u5_match_by_file(g):
    none = g.nodes.select("id").limit(0)
    return panels.match_changed(g, none, g.nodes.select("name").limit(0), "/w/EUROPE/FRANCE/test_s.py")


@on_graph(
    "SELECT 'node' AS kind, CAST(row_number() OVER (ORDER BY ordinal, id) AS INT) AS place, name FROM (SELECT * FROM nodes WHERE lower(name) LIKE '%ri%' ORDER BY ordinal LIMIT 10) UNION ALL SELECT 'command', CAST(row_number() OVER (ORDER BY k) AS INT), name FROM (SELECT r_regionkey AS k, concat('Focus group: ', r_name) AS name FROM region WHERE lower(concat('Focus group: ', r_name)) LIKE '%ri%' ORDER BY k LIMIT 8)",
)
def u6_palette(g):
    spark = g.nodes.sparkSession
    names = g.nodes.where("label = 'Class'").select(F.split("file_path", "/")[2].alias("region")).distinct()
    places = {"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3, "MIDDLE EAST": 4}
    keys = spark.createDataFrame(list(places.items()), "region string, place int")
    return panels.palette(g, names.join(keys, "region").select(F.concat(F.lit("Focus group: "), "region").alias("name"), "place"), "ri")


@on_graph(
    "SELECT \"group\", n, cx, cy, cz, greatest(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))) * 1.4, 20.0) AS radius FROM pos JOIN centre USING (\"group\") GROUP BY \"group\", n, cx, cy, cz",
    "pos AS (SELECT label AS \"group\", CAST(start_line AS DOUBLE) AS x, CAST(parameter_count AS DOUBLE) AS y, CAST(end_line AS DOUBLE) AS z FROM nodes)",
    "centre AS (SELECT \"group\", count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pos GROUP BY \"group\" HAVING count(*) >= 2)",
)
def u7_group_extent(g):
    return panels.group_extent(g.nodes, "label", "start_line", "parameter_count", "end_line")


@on_graph(
    "SELECT parent, name, is_dir, CAST(row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, name) AS INT) AS place FROM (SELECT DISTINCT array_to_string(p[1:k - 1], '/') AS parent, p[k] AS name, k < len(p) AS is_dir FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT DISTINCT string_split(ltrim(file_path, '/'), '/') AS p FROM nodes WHERE file_path <> '')))"
)
def u8_tree_order(g):
    return panels.tree_order(g)


@on_graph("SELECT \"group\", (row_number() OVER (ORDER BY \"group\") - 1) * 137.508::DOUBLE % 360 AS hue FROM (SELECT DISTINCT file_path AS \"group\" FROM nodes)")
def u9_hues(g):
    return panels.hues(g.nodes, "file_path").withColumn("hue", F.col("hue").cast("double"))


@on_graph("SELECT (SELECT count(*) FROM nodes WHERE label IN ('Class', 'Method')) AS nodes, (SELECT count(*) FROM edges WHERE edge_type = 'HAS_METHOD') AS edges, (SELECT count(DISTINCT file_path) FROM nodes) AS \"groups\"")
def u10_visible_counts(g):
    from codeloom.operators.views import filtered

    return panels.visible_counts(filtered(g, ("Class", "Method"), ("HAS_METHOD",)), g, F.col("file_path"))


@query(
    "SELECT n.id, first(s.file ORDER BY length(s.file) DESC) FILTER (WHERE s.file IS NOT NULL) AS file FROM parts n LEFT JOIN spots s ON ends_with(n.file_path, s.file) GROUP BY n.id",
    *SPOTS,
    "parts AS (SELECT p_partkey AS id, concat('/w/src/', replace(p_type, ' ', '_'), '.py') AS file_path FROM part)",
)
def v5_with_hotspots(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/w/src/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".py")).alias("file_path"))
    return panels.with_hotspots(parts, health.hotspots(*commits(spark, sf_dir)))


ITEMS = "items AS (SELECT CASE WHEN event_id % 2 = 0 THEN concat('order_', event_id % 5000) ELSE concat('Customer#', lpad(CAST(user_id AS STRING), 9, '0')) END AS name, concat('f', user_id, '.py') AS file, event_type AS dir, CASE event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'removed' END AS kind FROM {events})"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.plans.star import bound

    return bound(spark, sf_dir, ITEMS.removeprefix("items AS (").removesuffix(")"))


@query()
def st14_semantic_groups(spark, sf_dir):
    return panels.semantic_groups(star_graph(spark, sf_dir), items(spark, sf_dir))


BATCHED = "batched AS (SELECT user_id, " + ", ".join(f"coalesce(list(DISTINCT concat(event_type, '_', event_id % 2) ORDER BY concat(event_type, '_', event_id % 2)) FILTER (WHERE event_id % 3 = {i}), []) AS {n}" for i, n in enumerate(("added", "modified", "removed"))) + ", count(*) AS affected FROM events GROUP BY user_id)"


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of each user: lists of names by kind, and the number of events as affected nodes."""
    name = F.concat("event_type", F.lit("_"), F.col("event_id") % 2)
    lists = [F.array_sort(F.collect_set(F.when(F.col("event_id") % 3 == i, name))).alias(n) for i, n in enumerate(("added", "modified", "removed"))]
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(*lists, F.count("*").alias("affected"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(list_concat(added, modified)) AS name FROM batched) GROUP BY name", BATCHED)
def st13_heat(spark, sf_dir):
    return panels.heat(batched(spark, sf_dir), "added", "modified")


def part_sql(names: str, verb: str, shown: int, noun: str) -> str:
    return f"CASE WHEN len({names}) = 0 THEN NULL WHEN len({names}) <= {shown} THEN concat('{verb} ', array_to_string({names}, ', ')) ELSE concat('{verb} ', len({names}), ' {noun}') END"


@query(
    "SELECT user_id, CASE WHEN body = '' THEN '' ELSE concat(body, '.', CASE WHEN affected >= 20 THEN concat(' (HIGH risk — ', affected, ' in blast radius)') ELSE '' END) END AS narrative FROM (SELECT *, concat_ws('. ', CASE WHEN user_id % 5 = 0 AND len(added) > 0 THEN concat('Added ', added[1], ' and integrated into main (+1 more)') ELSE "
    + part_sql("added", "Added", 3, "new functions") + " END, " + part_sql("modified", "Modified", 2, "functions") + ", " + part_sql("removed", "Removed", 2, "functions") + ") AS body FROM batched)",
    BATCHED,
)
def st15_narrative(spark, sf_dir):
    entry = F.struct(F.get("added", F.lit(0)).alias("name"), F.lit("main").alias("caller"))
    joined = F.when(F.col("user_id") % 5 == 0, F.array(entry, entry)).otherwise(F.array().cast("array<struct<name:string,caller:string>>"))
    risk = F.when(F.col("affected") >= 20, "HIGH").otherwise("LOW")
    text = panels.narrative(F.col("added"), F.col("modified"), F.col("removed"), risk, F.col("affected"), joined)
    return batched(spark, sf_dir).select("user_id", text.alias("narrative"))


@query(
    "SELECT event_id, first_of FROM (SELECT *, row_number() OVER (PARTITION BY burst ORDER BY ts, event_id) = 1 AS first_of, row_number() OVER (PARTITION BY burst ORDER BY ts DESC, event_id DESC) = 1 AS last_of FROM (SELECT *, sum(fresh) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM "
    "(SELECT *, CASE WHEN ts < lag(ts) OVER (ORDER BY ts, event_id) + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM file_events))) WHERE first_of OR last_of",
    EVENTS,
)
def st12_batches(spark, sf_dir):
    return changes.shown(events(spark, sf_dir), "event_id", gap="5 minutes").select("event_id", "first_of")


@query("SELECT CAST(sum(len(added)) AS BIGINT) AS added, CAST(sum(len(modified)) AS BIGINT) AS modified, CAST(sum(len(removed)) AS BIGINT) AS removed, count(CASE WHEN affected >= 20 THEN 1 END) AS high_risk, count(*) AS n FROM (SELECT * FROM batched ORDER BY user_id DESC LIMIT 100)", BATCHED)
def u3_session_panel(spark, sf_dir):
    rows = batched(spark, sf_dir).withColumn("risk", F.when(F.col("affected") >= 20, "HIGH").otherwise("LOW"))
    return changes.session_panel(rows, [F.desc("user_id")])


@query("SELECT user_id, concat('[00:00:0', user_id % 10, '] ~ m.py', CASE WHEN len(added) + len(modified) + len(removed) > 0 THEN concat(' (', concat_ws(', ', CASE WHEN len(added) > 0 THEN concat('+', len(added), ' new') END, CASE WHEN len(modified) > 0 THEN concat('~', len(modified), ' mod') END, CASE WHEN len(removed) > 0 THEN concat('-', len(removed), ' del') END), ')') ELSE '' END, ' [LOW] → ', affected, ' affected') AS line FROM batched", BATCHED)
def sk7_change_lines(spark, sf_dir):
    rows = batched(spark, sf_dir).select("*", F.timestamp_seconds(F.col("user_id") % 10).alias("ts"), F.lit("/w/m.py").alias("file_path"), F.lit("modified").alias("event_type"), F.lit("LOW").alias("risk"))
    return rows.select("user_id", changes.line_of().alias("line"))


@query(
    "SELECT n_nationkey, array_to_string(list_slice(lines, greatest(a, 1), least(b, len(lines))), chr(10)) AS text FROM (SELECT n_nationkey, n_nationkey % 5 AS a, n_nationkey % 5 + 2 AS b, string_split(repeat(concat(n_name, chr(10)), 6), chr(10)) AS lines FROM nation)"
)
def sc9_source_lines(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.repeat(F.concat("n_name", F.lit("\n")), F.lit(6))
    return rows.select("n_nationkey", slices.lines(text, F.col("n_nationkey") % 5, F.col("n_nationkey") % 5 + 2).alias("text"))
