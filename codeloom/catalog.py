"""The queries of the library over the star graph, each with its SQL for DuckDB where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph, first_named
from codeloom.operators import flows, grams, health, search, traverse, views
from codeloom.plans.star import COMMITS, EVENT_EDGES, bound, oracle, star_grams, star_graph
from codeloom.sources import gitlog, pysource
from codeloom.streaming import changes

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a function of (spark, sf_dir) under its name, and its SQL."""

    def add(fn):
        FOUND[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = oracle(sql, *ctes)
        return fn

    return add


def on_graph(sql: str | None = None, *ctes: str):
    """As query, for a function of a graph."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(star_graph(spark, sf_dir))

        run.__name__ = fn.__name__
        return query(sql, *ctes)(run)

    return add


NAME = "Customer#000000005"
SEED = "seed AS (SELECT id FROM nodes WHERE name = (SELECT name FROM nodes WHERE id = 'fn:p1') AND label IN ('Function', 'Method', 'Class') ORDER BY ordinal LIMIT 1)"
COUNTRY = "(SELECT min(name) FROM nodes WHERE label = 'Class')"
FIRST_BASE = "base AS (SELECT target_id AS id FROM edges WHERE edge_type = 'EXTENDS' ORDER BY target_id LIMIT 1)"
TEST = "regexp_matches({}, '(^|/)(test_[^/]*|[^/]*_test\\.py)$')"


def name_of(g: PropertyGraph, node_id: str) -> str:
    """One point lookup."""
    row = g.node(node_id).select("name").head()
    return row.name if row else ""


def first_base(g: PropertyGraph) -> str:
    row = g.edges.where("edge_type = 'EXTENDS'").select(F.min("target_id").alias("id")).head()
    return row.id if row and row.id else ""


@on_graph("SELECT id, label, name FROM nodes WHERE id = 'fn:p1'")
def g2_point_lookup(g):
    return g.node("fn:p1").select("id", "label", "name")


@on_graph("SELECT (SELECT count(*) FROM nodes WHERE id <> 'fn:p1') AS node_count, (SELECT count(*) FROM edges WHERE source_id <> 'fn:p1' AND target_id <> 'fn:p1') AS edge_count")
def g3_remove_node(g):
    return g.without_node("fn:p1").counts()


@on_graph(
    "SELECT (SELECT count(*) FROM nodes) - (SELECT count(*) FROM gone) AS node_count, (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)) AS edge_count",
    "gone AS (SELECT id FROM nodes WHERE file_path = (SELECT file_path FROM nodes WHERE id = 'fn:c5'))",
)
def g4_remove_file(g):
    path = g.node("fn:c5").select("file_path").head()
    return g.without_file(path.file_path if path else "").counts()


@on_graph("SELECT label, count(*) AS n, count(CASE WHEN label = 'Class' THEN 1 END) AS renamed FROM nodes GROUP BY label")
def g1_upsert_nodes(g):
    renamed = g.by_label("Class").withColumn("name", F.lit("renamed"))
    return g.upsert_nodes(renamed).nodes.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("name") == "renamed").alias("renamed"))


@on_graph("SELECT edge_type, count(*) AS n, count(*) AS changed FROM edges WHERE edge_type = 'EXTENDS' GROUP BY edge_type UNION ALL SELECT edge_type, count(*), 0 FROM edges WHERE edge_type <> 'EXTENDS' GROUP BY edge_type")
def g5_upsert_edges(g):
    lower = g.edges.where("edge_type = 'EXTENDS'").withColumn("confidence", F.lit(0.25))
    return g.upsert_edges(lower).edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == 0.25).alias("changed"))


@on_graph("SELECT count(*) - 1 AS n FROM edges")
def g6_remove_edge(g):
    row = g.edges.where("edge_type = 'EXTENDS'").agg(F.min("id").alias("id")).head()
    return g.without_edge(row.id or "").edges.agg(F.count("*").alias("n"))


@on_graph("SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def g7_counts(g):
    return g.counts()


@on_graph("SELECT id, target_id, edge_type FROM edges WHERE source_id = 'm:o1'")
def g8_edges_from(g):
    return g.edges_from("m:o1").select("id", "target_id", "edge_type")


@on_graph("SELECT id, name, file_path FROM nodes WHERE label = 'Class'")
def g9_by_label(g):
    return g.by_label("Class").select("id", "name", "file_path")


@on_graph("SELECT n.id, n.label, n.name, n.file_path, e.line FROM edges e JOIN seed ON e.target_id = seed.id JOIN nodes n ON n.id = e.source_id WHERE e.edge_type = 'CALLS'", SEED)
def a1_callers_of(g):
    return search.callers_of(g, name_of(g, "fn:p1"))


@on_graph("SELECT n.id, n.label, n.name, n.file_path, e.line FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.edge_type = 'CALLS' AND e.source_id = (SELECT id FROM nodes WHERE name = 'order_1' ORDER BY ordinal LIMIT 1)")
def a2_callees_of(g):
    return search.callees_of(g, "order_1")


@on_graph("SELECT n.id, n.label, n.name, n.file_path, e.line FROM edges e JOIN base ON e.target_id = base.id JOIN nodes n ON n.id = e.source_id WHERE e.edge_type = 'EXTENDS'", FIRST_BASE)
def a4_subclasses_of(g):
    return search.subclasses_of(g, name_of(g, first_base(g)))


@on_graph("SELECT id, name, file_path FROM nodes WHERE label = 'Method' AND name = 'order_7'")
def a5_implementations_of(g):
    return search.implementations_of(g, "order_7").select("id", "name", "file_path")


@on_graph("SELECT id, label, name FROM nodes WHERE file_path = (SELECT file_path FROM nodes WHERE id = 'fn:c5')")
def a7_by_file(g):
    path = g.node("fn:c5").select("file_path").head()
    return g.by_file(path.file_path if path else "").select("id", "label", "name")


@on_graph("SELECT id, name FROM nodes WHERE name GLOB 'order_[1-3]?[!0-4]'")
def a8_by_pattern(g):
    return search.by_pattern(g, "order_[1-3]?[!0-4]").select("id", "name")


@on_graph("SELECT id, name FROM nodes WHERE list_contains(decorators, 'typed')")
def a9_by_decorator(g):
    return search.by_decorator(g, "typed").select("id", "name")


@on_graph(f"SELECT id, name FROM nodes WHERE name = '{NAME}' ORDER BY ordinal LIMIT 1")
def a10_first_named(g):
    return first_named(g.nodes, NAME).select("id", "name")


@on_graph("SELECT id, name FROM nodes WHERE contains(lower(name), 'er_1') ORDER BY ordinal LIMIT 20")
def a11_search(g):
    return search.search(g, "ER_1").select("id", "name")


@query("SELECT id, name FROM nodes WHERE contains(lower(name), 'er_1') ORDER BY ordinal LIMIT 20")
def a11_search_by_grams(spark, sf_dir):
    return grams.nodes_with(spark, star_grams(spark, sf_dir), "ER_1").orderBy("ordinal").limit(20).select("id", "name")


@query("SELECT id, name FROM nodes WHERE label IN ('Function', 'Method', 'Class', 'Process') AND contains(lower(name), '#00000001')")
def a12_keyword_by_grams(spark, sf_dir):
    found = grams.nodes_with(spark, star_grams(spark, sf_dir), "#00000001")
    return found.where(F.col("label").isin(*search.SYMBOLS, "Process")).select("id", "name")


@query("SELECT id, name FROM nodes WHERE label IN ('Function', 'Method') AND contains(name, 'er_12')")
def j5_callable_by_grams(spark, sf_dir):
    return grams.nodes_with(spark, star_grams(spark, sf_dir), "er_12", ignore_case=False).where(F.col("label").isin("Function", "Method")).select("id", "name")


@on_graph("SELECT id, name FROM nodes WHERE label IN ('Function', 'Method', 'Class', 'Process') AND contains(lower(name), 'r_12')")
def a12_keyword_search(g):
    return search.keyword_search(g, "R_12").select("id", "name")


@on_graph(
    "SELECT 'in' AS direction, e.edge_type, e.line, e.source_id AS id, coalesce(n.name, e.source_id) AS name, n.label FROM edges e JOIN seed ON e.target_id = seed.id LEFT JOIN nodes n ON n.id = e.source_id "
    "UNION ALL SELECT 'out', e.edge_type, e.line, e.target_id, coalesce(n.name, e.target_id), n.label FROM edges e JOIN seed ON e.source_id = seed.id LEFT JOIN nodes n ON n.id = e.target_id",
    "seed AS (SELECT id FROM nodes WHERE name = 'order_1' ORDER BY ordinal LIMIT 1)",
)
def a13_context(g):
    return search.context(g, "order_1")


def level_sql(depth: int) -> str:
    prior = " UNION ALL ".join(f"SELECT id FROM l{d}" for d in range(depth))
    start = f"(SELECT h.id FROM l{depth - 1} h JOIN nodes n ON n.id = h.id)"
    return (
        f"l{depth} AS (SELECT id, edge_type, confidence FROM (SELECT source_id AS id, edge_type, confidence, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, edge_type, edges.id) AS k "
        f"FROM edges JOIN {start} f ON edges.target_id = f.id) WHERE k = 1 AND id NOT IN ({prior}))"
    )


LEVELS = ("l0 AS (SELECT 'fn:p1' AS id)", *(level_sql(d) for d in (1, 2, 3)))
REACHED = " UNION ALL ".join(f"SELECT l.id, n.name, n.label, CAST({d} AS INT) AS depth, l.edge_type, l.confidence FROM l{d} l JOIN nodes n ON n.id = l.id" for d in (1, 2, 3))


def seeds(g: PropertyGraph, *ids: str) -> DataFrame:
    return g.nodes.where(F.col("id").isin(*ids)).select(F.col("id").alias("seed"), "id")


@on_graph(REACHED, *LEVELS)
def t1_impact_upstream(g):
    return traverse.impact(g, seeds(g, "fn:p1")).select("id", "name", "label", "depth", "edge_type", "confidence")


@on_graph(
    f"SELECT 'fn:p1' AS seed, count(*) AS total, count(CASE WHEN depth = 1 THEN 1 END) AS direct, CASE WHEN count(*) >= 20 AND count(CASE WHEN depth = 1 THEN 1 END) >= 8 THEN 'CRITICAL' "
    f"WHEN count(*) >= 6 AND count(CASE WHEN depth = 1 THEN 1 END) >= 4 THEN 'HIGH' WHEN count(*) >= 3 AND count(CASE WHEN depth = 1 THEN 1 END) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM ({REACHED}) r HAVING count(*) > 0",
    *LEVELS,
)
def t2_risk(g):
    return traverse.risk(traverse.impact(g, seeds(g, "fn:p1")))


EVENT_GRAPH = "event_edges"
REACH = "reach(a, b) AS (SELECT source_id, target_id FROM event_edges UNION SELECT r.a, e.target_id FROM reach r JOIN event_edges e ON e.source_id = r.b)"


@query("SELECT x.a AS id, least(x.a, min(x.b)) AS scc, count(*) AS size FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a", REACH)
def t3_cycles(spark, sf_dir):
    return traverse.strongly_connected(bound(spark, sf_dir, EVENT_EDGES))


BOTH = "both_ways AS (SELECT source_id AS a, target_id AS b FROM event_edges UNION SELECT target_id, source_id FROM event_edges)"
JOINED = "joined(a, b) AS (SELECT a, b FROM both_ways UNION SELECT j.a, w.b FROM joined j JOIN both_ways w ON w.a = j.b)"
MEMBERS = "members AS (SELECT a AS id, least(a, min(b)) AS component FROM joined GROUP BY a)"


@query("SELECT id, component FROM members", BOTH, JOINED, MEMBERS)
def t4_components(spark, sf_dir):
    return traverse.components(bound(spark, sf_dir, EVENT_EDGES))


@query(
    "SELECT component, size, coalesce(links, 0) AS links, CASE WHEN size <= 1 THEN 1.0E0 ELSE coalesce(links, 0) / (size * (size - 1)) END AS cohesion FROM (SELECT component, count(*) AS size FROM members GROUP BY component) s "
    "LEFT JOIN (SELECT component, count(*) AS links FROM both_ways JOIN members ON id = a WHERE a <> b GROUP BY component) l USING (component)",
    BOTH, JOINED, MEMBERS,
)
def t6_cohesion(spark, sf_dir):
    edges = bound(spark, sf_dir, EVENT_EDGES)
    return traverse.cohesion(traverse.components(edges), edges)


#: Rounds of votes (see propagated_labels) over the same edges until the last, as a round after the end changes nothing; groups of one are left out.
VOTES = (
    "ways AS MATERIALIZED (SELECT source_id AS id, target_id AS other FROM event_edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM event_edges WHERE source_id <> target_id)",
    "lp(k, id, label) AS (SELECT 0, id, id FROM (SELECT DISTINCT id FROM ways) UNION ALL SELECT k + 1, id, CASE WHEN substr(md5(concat(id, '/', k + 1)), 1, 1) < '8' THEN best.label ELSE own END FROM (SELECT k, id, own, max({'n': n, 'kept': label = own, 'label': label}) AS best "
    "FROM (SELECT x.k, w.id, o.label AS own, x.label, count(*) AS n FROM lp x JOIN ways w ON w.other = x.id JOIN lp o ON o.id = w.id GROUP BY ALL) GROUP BY ALL) WHERE k < 40)",
    "labelled AS MATERIALIZED (SELECT id, label AS component FROM lp WHERE k = 40)",
)


def label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and component of the events' users by label propagation."""
    return traverse.propagated_labels(bound(spark, sf_dir, EVENT_EDGES)).withColumnRenamed("label", "component")


@query("SELECT id, component FROM labelled", *VOTES)
def t4_label_groups(spark, sf_dir):
    return label_groups(spark, sf_dir)


@query(
    "SELECT component, size, coalesce(links, 0) AS links, CASE WHEN size <= 1 THEN 1.0E0 ELSE coalesce(links, 0) / (size * (size - 1)) END AS cohesion FROM (SELECT component, count(*) AS size FROM labelled GROUP BY component) s "
    "LEFT JOIN (SELECT x.component, count(*) AS links FROM ways JOIN labelled x ON x.id = ways.id JOIN labelled y ON y.id = other AND y.component = x.component GROUP BY x.component) l USING (component)",
    *VOTES,
)
def t6_label_cohesion(spark, sf_dir):
    return traverse.cohesion(label_groups(spark, sf_dir), bound(spark, sf_dir, EVENT_EDGES))


@query(
    "SELECT component, CASE WHEN len(shared) > 0 THEN shared[len(shared)] ELSE first END AS label FROM (SELECT component, first, list_filter(a[1:coalesce(nullif(list_position(list_transform(list_zip(a, b), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false), 0) - 1, len(a))], lambda x: x <> '') AS shared "
    "FROM (SELECT component, min(split(id, '/')) AS a, max(split(id, '/')) AS b, min(id) AS first FROM labelled GROUP BY component))",
    *VOTES,
)
def t5_community_labels(spark, sf_dir):
    return flows.group_labels(label_groups(spark, sf_dir).withColumn("file_path", F.col("id")).withColumn("ordinal", F.lit(0)))


#: The same events as calls, imports and containment: the last don't make cycles.
TYPED = "typed AS (SELECT source_id, target_id, CASE WHEN source_id < target_id THEN 'CALLS' WHEN source_id > target_id THEN 'IMPORTS' ELSE 'CONTAINS' END AS edge_type FROM event_edges)"
KEPT = "kept AS (SELECT * FROM typed WHERE edge_type <> 'CONTAINS')"
KEPT_REACH = "far(a, b) AS (SELECT source_id, target_id FROM kept UNION SELECT r.a, e.target_id FROM far r JOIN kept e ON e.source_id = r.b)"
CIRCLES = "circles AS (SELECT x.a AS id, least(x.a, min(x.b)) AS scc FROM far x JOIN far y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"


@query(
    "SELECT scc, length, node_ids, edge_types FROM (SELECT scc, count(*) AS length, string_agg(id, ',' ORDER BY id) AS node_ids FROM circles GROUP BY scc) n JOIN (SELECT s.scc, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types "
    "FROM kept JOIN circles s ON s.id = source_id JOIN circles t ON t.id = target_id AND t.scc = s.scc GROUP BY s.scc) t USING (scc)",
    TYPED, KEPT, KEPT_REACH, CIRCLES,
)
def t3_cycle_report(spark, sf_dir):
    a, b = F.col("source_id"), F.col("target_id")
    edges = bound(spark, sf_dir, EVENT_EDGES).withColumn("edge_type", F.when(a < b, "CALLS").when(a > b, "IMPORTS").otherwise("CONTAINS"))
    names = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("name", F.col("id"))
    found = traverse.cycles(PropertyGraph(names, edges))
    return found.select("scc", "length", F.array_join("node_ids", ",").alias("node_ids"), F.array_join("edge_types", ",").alias("edge_types"))


@on_graph(
    "SELECT n.id, n.name, coalesce(o.c, 0) AS callees, coalesce(i.c, 0) AS callers, CASE WHEN coalesce(o.c, 0) = 0 THEN 0.0E0 ELSE o.c - 1.5E0 * coalesce(i.c, 0) END AS score FROM nodes n "
    "LEFT JOIN (SELECT source_id AS id, count(*) AS c FROM edges WHERE edge_type = 'CALLS' GROUP BY 1) o ON o.id = n.id LEFT JOIN (SELECT target_id AS id, count(*) AS c FROM edges WHERE edge_type = 'CALLS' GROUP BY 1) i ON i.id = n.id WHERE label IN ('Function', 'Method')"
)
def t8_entry_scores(g):
    return traverse.entry_scores(g)


@on_graph(f"SELECT 'fn:p1' AS seed, n.file_path, n.name, CAST(1 AS INT) AS depth FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.edge_type = 'CALLS' AND e.target_id = 'fn:p1' AND {TEST.format('n.file_path')} GROUP BY n.file_path, n.name")
def t10_suggest_tests(g):
    return traverse.suggest_tests(g, seeds(g, "fn:p1"))


@on_graph(
    "SELECT b.id, min(b.d) AS depth FROM (SELECT 'fn:s1' AS id, 0 AS d UNION ALL SELECT b, 1 FROM links WHERE a = 'fn:s1' UNION ALL SELECT y.b, 2 FROM links x JOIN links y ON x.b = y.a WHERE x.a = 'fn:s1') b GROUP BY b.id",
    "links AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges)",
)
def t11_neighbourhood(g):
    return traverse.neighbourhood(g, seeds(g, "fn:s1"), 2).select("id", "depth")


@on_graph(f"SELECT id, name, label FROM nodes WHERE label IN ('Function', 'Method', 'Class') AND NOT {TEST.format('file_path')} AND id NOT IN (SELECT target_id FROM edges WHERE edge_type <> 'CONTAINS')")
def a3_orphans(g):
    return traverse.orphans(g).select("id", "name", "label")


@on_graph()
def a6_path_between(g):
    return traverse.path_between(g, NAME, name_of(g, "fn:p1"))


@on_graph(
    "SELECT n.id, n.name, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out FROM nodes n "
    "LEFT JOIN (SELECT source_id AS id, count(*) AS c FROM edges WHERE edge_type = 'CALLS' GROUP BY 1) o ON o.id = n.id LEFT JOIN (SELECT target_id AS id, count(*) AS c FROM edges WHERE edge_type = 'CALLS' GROUP BY 1) i ON i.id = n.id WHERE label IN ('Function', 'Method')"
)
def h1_fan(g):
    return health.fan(g)


def nodes_with_cc(g: PropertyGraph) -> DataFrame:
    """The star graph has no source; a stand-in complexity comes from the start line."""
    return g.nodes.withColumn("cc", F.col("start_line") % 25)


def with_cc(g: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(nodes_with_cc(g), g.edges)


RISK_SQL = "CASE WHEN {0} > 20 OR {1} > 200 THEN 'CRITICAL' WHEN {0} > 10 OR {1} > 100 THEN 'HIGH' WHEN {0} > 5 OR {1} > 50 THEN 'MEDIUM' ELSE 'LOW' END"


@on_graph(f"SELECT id, name, file_path, start_line % 25 AS cc, end_line - start_line + 1 AS line_count, parameter_count, {RISK_SQL.format('start_line % 25', '(end_line - start_line + 1)')} AS risk FROM nodes WHERE label IN ('Function', 'Method')")
def h2_complexity(g):
    return health.complexity(nodes_with_cc(g))


GROUPED = "grouped AS (SELECT id, label, start_line % 25 AS cc, array_to_string(list_slice(split(file_path, '/'), 2, least(3, len(split(file_path, '/')) - 1)), '/') AS grp FROM nodes WHERE label IN ('Function', 'Method', 'Class'))"
HEALTH = (
    "health AS (SELECT b.*, coalesce(calls, 0) AS calls, coalesce(cross_calls, 0) AS cross_calls, coalesce(internal, 0) AS internal FROM (SELECT grp, count(*) AS node_count, CAST(coalesce(sum(CASE WHEN label <> 'Class' THEN cc END), 0) AS BIGINT) AS cc_sum, "
    "count(CASE WHEN label <> 'Class' THEN 1 END) AS cc_count, coalesce(max(CASE WHEN label <> 'Class' THEN cc END), 0) AS cc_max, count(CASE WHEN label <> 'Class' AND cc > 10 THEN 1 END) AS god_functions, "
    "count(CASE WHEN label = 'Class' AND m.c > 20 THEN 1 END) AS god_classes FROM grouped g LEFT JOIN (SELECT source_id, count(*) AS c FROM edges WHERE edge_type = 'HAS_METHOD' GROUP BY 1) m ON m.source_id = g.id GROUP BY grp) b "
    "LEFT JOIN (SELECT s.grp, count(*) AS calls, count(CASE WHEN t.grp IS DISTINCT FROM s.grp THEN 1 END) AS cross_calls, count(CASE WHEN t.grp = s.grp AND edge_type = 'CALLS' THEN 1 END) AS internal "
    "FROM edges e JOIN grouped s ON s.id = e.source_id LEFT JOIN grouped t ON t.id = e.target_id WHERE edge_type IN ('CALLS', 'IMPORTS') GROUP BY 1) l USING (grp))"
)


@on_graph(
    "SELECT grp, node_count, cc_sum, cc_count, cc_max, god_functions, god_classes, calls, cross_calls, internal, CASE WHEN cc_count = 0 THEN 0E0 ELSE cc_sum / cc_count END AS avg_cc, CASE WHEN calls = 0 THEN 0E0 ELSE cross_calls / calls END AS coupling, "
    "internal / greatest(node_count * (node_count - 1), 1) AS cohesion, CASE WHEN cc_max > 20 OR god_functions > 3 THEN 'CRITICAL' WHEN cc_max > 10 OR cross_calls > 0.8 * calls THEN 'HIGH' WHEN cc_sum > 5 * cc_count OR cross_calls > 0.6 * calls THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM health",
    GROUPED, HEALTH,
)
def h3_module_health(g):
    return health.module_health(with_cc(g))


@on_graph(f"SELECT count(*) AS functions, CAST(sum(cc) AS BIGINT) AS cc_sum, count(CASE WHEN risk = 'HIGH' THEN 1 END) AS high, count(CASE WHEN risk = 'CRITICAL' THEN 1 END) AS critical FROM (SELECT start_line % 25 AS cc, {RISK_SQL.format('start_line % 25', '(end_line - start_line + 1)')} AS risk FROM nodes WHERE label IN ('Function', 'Method'))")
def h4_health_report(g):
    rows = health.complexity(nodes_with_cc(g))
    return rows.agg(F.count("*").alias("functions"), F.sum("cc").alias("cc_sum"), F.count_if(F.col("risk") == "HIGH").alias("high"), F.count_if(F.col("risk") == "CRITICAL").alias("critical"))


@on_graph(
    "SELECT 'total' AS kind, name, value FROM (UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS functions, sum(cc) / count(*) AS avg_complexity, CAST(count(CASE WHEN risk = 'HIGH' THEN 1 END) AS DOUBLE) AS high, CAST(count(CASE WHEN risk = 'CRITICAL' THEN 1 END) AS DOUBLE) AS critical FROM scored_cc) ON functions, avg_complexity, high, critical) "
    "UNION ALL SELECT 'function', id, CAST(cc AS DOUBLE) FROM scored_cc UNION ALL SELECT 'module', grp, CASE WHEN cc_count = 0 THEN 0E0 ELSE cc_sum / cc_count END FROM health",
    f"scored_cc AS (SELECT id, start_line % 25 AS cc, {RISK_SQL.format('start_line % 25', '(end_line - start_line + 1)')} AS risk FROM nodes WHERE label IN ('Function', 'Method'))", GROUPED, HEALTH,
)
def h4_report(g):
    return health.health_report(with_cc(g))


@on_graph('SELECT \'node\' AS kind, label AS type, count(*) AS "count" FROM nodes GROUP BY label UNION ALL SELECT \'edge\', edge_type, count(*) FROM edges GROUP BY edge_type')
def h5_counters(g):
    return health.counters(g)


def commits(spark: SparkSession, sf_dir: str):
    """The history, and the time of its last commit as a column."""
    rows = bound(spark, sf_dir, COMMITS)
    return rows, F.lit(rows.agg(F.max("date")).head()[0])


SPOTS = (
    "recent AS (SELECT DISTINCT commit_idx, author, date, file FROM commits WHERE date >= (SELECT max(date) FROM commits) - INTERVAL 90 DAY)",
    "authors AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, newest DESC, author) AS k FROM (SELECT file, author, count(*) AS n, max(date) AS newest, count(CASE WHEN date >= (SELECT max(date) FROM commits) - INTERVAL 30 DAY THEN 1 END) AS r FROM recent GROUP BY file, author))",
    "spots AS (SELECT file, CAST(sum(n) AS BIGINT) AS change_count, CAST(sum(r) AS BIGINT) AS recent_changes, string_agg(CASE WHEN k <= 3 THEN author END, ',' ORDER BY k) AS top_authors, max(newest) AS last_modified FROM authors GROUP BY file)",
)


@query("SELECT *, change_count / (SELECT max(change_count) FROM spots) AS score FROM spots", *SPOTS)
def h7_hotspots(spark, sf_dir):
    return health.hotspots(*commits(spark, sf_dir))


@query(
    "SELECT file, change_count, least(1.0E0, change_count / (SELECT max(change_count) FROM spots) * coalesce(w, 1.0E0)) AS score FROM spots LEFT JOIN (SELECT concat('src/', replace(p_type, ' ', '_'), '.py') AS f, avg(p_size) AS w FROM part WHERE p_type <> 'SMALL' GROUP BY 1) ON f = file",
    *SPOTS,
)
def h7_weighted_hotspots(spark, sf_dir):
    """A file's weight is the mean size of its parts; one kind has none."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_type <> 'SMALL'")
    weights = sizes.groupBy(F.concat(F.lit("src/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".py")).alias("file")).agg((F.avg("p_size") / 1).alias("weight"))
    return health.hotspots(*commits(spark, sf_dir), weights=weights).select("file", "change_count", "score")


@query(
    'SELECT file_a, file_b, c AS "count", c / least(x.n, y.n) AS confidence FROM (SELECT a.file AS file_a, b.file AS file_b, count(*) AS c FROM rowset a JOIN rowset b ON a.commit_idx = b.commit_idx AND a.file < b.file GROUP BY 1, 2) p '
    "JOIN alone x ON x.file = file_a JOIN alone y ON y.file = file_b WHERE c >= 3 AND c / least(x.n, y.n) >= 0.3 ORDER BY c DESC, file_a, file_b LIMIT 100",
    "rowset AS (SELECT DISTINCT commit_idx, file FROM commits WHERE date >= (SELECT max(date) FROM commits) - INTERVAL 90 DAY)", "alone AS (SELECT file, count(*) AS n FROM rowset GROUP BY file)",
)
def h8_co_changes(spark, sf_dir):
    return health.co_changes(*commits(spark, sf_dir))


@query("SELECT count(*) AS files, CAST(sum(change_count) AS BIGINT) AS changes, (SELECT file FROM spots ORDER BY change_count DESC, file LIMIT 1) AS most_volatile, (SELECT count(DISTINCT author) FROM authors WHERE k <= 3) AS active_contributors FROM spots", *SPOTS)
def h9_git_summary(spark, sf_dir):
    return health.git_summary(*commits(spark, sf_dir))


@query("SELECT file, change_count FROM spots ORDER BY change_count DESC, file LIMIT 10", *SPOTS)
def h10_hotspot_report(spark, sf_dir):
    return health.hotspots(*commits(spark, sf_dir)).orderBy(F.desc("change_count"), "file").limit(10).select("file", "change_count")


def dependents_sql(kinds: str, label: str) -> str:
    return (
        f"SELECT *, CASE WHEN incoming > 20 THEN 'CRITICAL' WHEN incoming > 10 THEN 'HIGH' WHEN incoming > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT t.file_path, count(*) AS incoming, count(DISTINCT s.file_path) AS dependent_files, bool_or({TEST.format('s.file_path')}) AS has_tests "
        f"FROM edges e JOIN nodes t ON t.id = e.target_id JOIN nodes s ON s.id = e.source_id WHERE edge_type IN ({kinds}) AND {label} AND s.file_path <> t.file_path GROUP BY t.file_path)"
    )


@on_graph(
    "SELECT f.file_path, node_count, coalesce(incoming, 0) AS incoming, coalesce(dependent_files, 0) AS dependent_files, coalesce(tested, false) AS has_tests, CASE WHEN incoming > 20 THEN 'CRITICAL' WHEN incoming > 10 THEN 'HIGH' WHEN incoming > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk "
    "FROM (SELECT file_path, count(CASE WHEN label IN ('Function', 'Method', 'Class') THEN 1 END) AS node_count FROM nodes GROUP BY file_path) f LEFT JOIN into_file USING (file_path) LEFT JOIN tested_file USING (file_path)",
    "into_file AS (SELECT t.file_path, count(*) AS incoming, count(DISTINCT s.file_path) AS dependent_files FROM edges e JOIN nodes t ON t.id = e.target_id JOIN nodes s ON s.id = e.source_id WHERE edge_type = 'CALLS' AND t.label IN ('Function', 'Method', 'Class') AND s.file_path <> t.file_path GROUP BY 1)",
    f"tested_file AS (SELECT t.file_path, bool_or({TEST.format('s.file_path')}) AS tested FROM edges e JOIN nodes t ON t.id = e.target_id JOIN nodes s ON s.id = e.source_id WHERE edge_type IN ('CALLS', 'IMPORTS') GROUP BY 1)",
)
def h12_safe_to_modify(g):
    return health.safe_to_modify(g)


@on_graph("SELECT name, file_path, cc, line_count, risk FROM (SELECT name, file_path, start_line % 25 AS cc, end_line - start_line + 1 AS line_count, " + RISK_SQL.format("start_line % 25", "(end_line - start_line + 1)") + " AS risk FROM nodes WHERE label IN ('Function', 'Method') AND name = 'order_7' ORDER BY start_line % 25 DESC, ordinal LIMIT 1)")
def h6_complexity_of(g):
    return health.complexity_of(nodes_with_cc(g), "order_7").select("name", "file_path", "cc", "line_count", "risk")


@on_graph(
    f"SELECT count(*) AS upstream_affected, 0 AS downstream_affected, count(*) AS total_affected, CASE WHEN count(*) >= 20 AND count(CASE WHEN depth = 1 THEN 1 END) >= 8 THEN 'CRITICAL' WHEN count(*) >= 6 AND count(CASE WHEN depth = 1 THEN 1 END) >= 4 THEN 'HIGH' "
    f"WHEN count(*) >= 3 AND count(CASE WHEN depth = 1 THEN 1 END) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk, coalesce(string_agg(DISTINCT split_part(n.file_path, '/', -1), ',' ORDER BY split_part(n.file_path, '/', -1)), '') AS affected_files FROM ({REACHED}) r JOIN nodes n ON n.id = r.id",
    *LEVELS,
)
def h14_impact_preview(g):
    return health.impact_preview(g, "fn:p1")


@on_graph(dependents_sql("'CALLS', 'IMPORTS'", "true"))
def h13_quick_check(g):
    return health.dependents(g, any_node=True)


@on_graph("SELECT label, count(*) AS nodes FROM (SELECT label FROM nodes WHERE label IN ('Class', 'File', 'Function') ORDER BY list_position(['Class', 'File', 'Function'], label), ordinal LIMIT 200) GROUP BY label")
def v1_graph_view(g):
    return views.graph_view(g, ("Class", "File", "Function"), ("CALLS", "CONTAINS"), 200).nodes.groupBy("label").agg(F.count("*").alias("nodes"))


SHOWN = (
    "shown AS (SELECT * FROM nodes WHERE label IN ('File', 'Function', 'Class', 'Method') ORDER BY CASE label WHEN 'Class' THEN 3 WHEN 'Function' THEN 4 WHEN 'File' THEN 5 ELSE 7 END, ordinal, id LIMIT 600)",
    "among AS (SELECT e.source_id, e.target_id FROM edges e WHERE source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown))",
)


@on_graph(
    "SELECT s.id, s.name, s.label, array_to_string(list_slice(split(file_path, '/'), 3, len(split(file_path, '/')) - 1), '/') AS grp, start_line AS line, end_line, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM shown s LEFT JOIN (SELECT target_id AS id, count(*) AS n FROM among GROUP BY 1) i ON i.id = s.id LEFT JOIN (SELECT source_id AS id, count(*) AS n FROM among GROUP BY 1) o ON o.id = s.id",
    *SHOWN,
)
def v1_view_nodes(g):
    nodes, _ = views.view_nodes(g, "logic", root="/w")
    return nodes.select("id", "name", "label", F.col("group").alias("grp"), "line", "end_line", "fan_in", "fan_out")


@on_graph(
    "SELECT source_id AS source, target_id AS target, edge_type AS type, confidence FROM edges WHERE edge_type IN ('CALLS', 'IMPORTS', 'EXTENDS', 'HAS_METHOD', 'CONTAINS', 'DECORATES') AND source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown)",
    *SHOWN,
)
def v1_view_links(g):
    return views.view_nodes(g, "logic", root="/w")[1]


@on_graph(
    "SELECT 'label' AS kind, label AS type, count(*) AS \"count\" FROM nodes GROUP BY label UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY edge_type "
    "UNION ALL SELECT 'group', array_to_string(list_slice(split(file_path, '/'), 3, len(split(file_path, '/')) - 1), '/'), count(*) FROM nodes GROUP BY 2"
)
def h16_sidebar_counts(g):
    return health.sidebar_counts(g, "/w")


@on_graph("SELECT file_path, string_agg(name, ',' ORDER BY start_line, ordinal) AS symbols, count(*) AS n FROM nodes WHERE label <> 'File' GROUP BY file_path")
def v3_file_tree(g):
    return views.file_tree(g)


@on_graph("SELECT 0 AS part, concat('  \"', id, '\" [label=\"', replace(name, '\"', '\\\"'), '\"];') AS line FROM nodes UNION ALL SELECT 1, concat('  \"', source_id, '\" -> \"', target_id, '\" [label=\"', edge_type, '\"];') FROM edges")
def sk2_export_dot(g):
    return views.export_dot(g)


@on_graph("SELECT 'node' AS kind, id, name AS text FROM nodes WHERE name <> '' UNION ALL SELECT 'edge', id, concat(source_id, ' ', edge_type, ' ', target_id) FROM edges")
def sk1_export_json(g):
    """The rows as JSON, read again."""
    text = F.when(F.col("kind") == "node", F.get_json_object("json", "$.name")).otherwise(F.concat_ws(" ", F.get_json_object("json", "$.source"), F.get_json_object("json", "$.type"), F.get_json_object("json", "$.target")))
    return views.export_json(g).select("kind", "id", text.alias("text"))


@on_graph(
    "SELECT id, size, CASE WHEN fan >= 10 THEN 'hub' WHEN fan >= 3 THEN 'linked' ELSE 'leaf' END AS kind FROM (SELECT n.id, coalesce(c, 0) AS fan, 2 + log2(1 + coalesce(c, 0)) AS size FROM nodes n LEFT JOIN (SELECT x AS id, count(*) AS c FROM (SELECT source_id AS x FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY x) d ON d.id = n.id)"
)
def v6_importance(g):
    return views.importance(g)


@on_graph("SELECT n.id, n.label FROM nodes n WHERE label IN ('Class', 'Method')")
def v4_filtered_nodes(g):
    return views.filtered(g, ("Class", "Method"), ("HAS_METHOD",)).nodes.select("id", "label")


@on_graph("SELECT source_id, target_id, edge_type FROM edges WHERE edge_type = 'HAS_METHOD'")
def v4_filtered_edges(g):
    return views.filtered(g, ("Class", "Method"), ("HAS_METHOD",)).edges.select("source_id", "target_id", "edge_type")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("event_id") % 7 == 0, "deleted").otherwise("modified")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.concat(F.lit("u"), "user_id").alias("file_path"), kinds.alias("event_type"), "value", F.col("event_type").alias("kind"))


EVENTS = "file_events AS (SELECT event_id, ts, concat('u', user_id) AS file_path, CASE WHEN event_id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS event_type, value, event_type AS kind FROM events)"


@query(
    "SELECT file_path, CASE WHEN bool_or(event_type = 'deleted') THEN 'deleted' ELSE 'modified' END AS event_type, max(ts) AS ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM "
    "(SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY file_path ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM file_events)) GROUP BY file_path, burst",
    EVENTS,
)
def st2_debounce(spark, sf_dir):
    return changes.debounce(events(spark, sf_dir), gap="1 hour")


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN b IS NULL THEN 'added' WHEN b <> kind THEN 'modified' ELSE 'same' END AS change FROM (SELECT kind, lag(kind) OVER (PARTITION BY file_path ORDER BY ts, event_id) AS b FROM file_events)) GROUP BY change", EVENTS)
def st3_version_changes(spark, sf_dir):
    return changes.version_changes(events(spark, sf_dir), "file_path", ["ts", "event_id"], F.col("kind")).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT event_id, file_path, event_type FROM file_events ORDER BY ts DESC, event_id DESC LIMIT 50", EVENTS)
def st7_newest(spark, sf_dir):
    return changes.newest(events(spark, sf_dir), [F.desc("ts"), F.desc("event_id")]).select("event_id", "file_path", "event_type")


@query("SELECT event_type, count(*) AS n, count(DISTINCT file_path) AS files, min(ts) AS first_ts, max(ts) AS last_ts FROM file_events GROUP BY event_type", EVENTS)
def st8_session_summary(spark, sf_dir):
    return changes.session_summary(events(spark, sf_dir))


@query("SELECT o_orderkey AS commit_idx, concat('h', o_orderkey) AS hash, concat('a', o_custkey) AS author, concat('src/', o_orderstatus, '.py') AS file FROM orders")
def sc8_git_log(spark, sf_dir):
    lines = F.concat(F.lit("COMMIT h"), "o_orderkey", F.lit(" a"), "o_custkey", F.lit(" 2026-01-01T00:00:00Z\nsrc/"), "o_orderstatus", F.lit(".py\nREADME.md\n"))
    logs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("commit_idx"), lines.alias("log"))
    return gitlog.commits_of(logs, "commit_idx", "log").select("commit_idx", "hash", "author", "file")


@query(
    "SELECT concat('nation_', n_nationkey, '.py') AS file_path, count(c_custkey) AS functions, CAST(coalesce(sum(c_custkey % 3), 0) AS BIGINT) AS calls, CAST(coalesce(sum(1 + c_custkey % 2), 0) AS BIGINT) AS cc FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey"
)
def sc2_parse_files(spark, sf_dir):
    """Source made from the tables, parsed again: a function for each customer."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    body = F.concat(F.lit("def f"), "c_custkey", F.lit("():\n"), F.when(F.col("c_custkey") % 2 == 1, "    if True:\n        pass\n").otherwise("    pass\n"), F.repeat(F.lit("    g()\n"), (F.col("c_custkey") % 3).cast("int")))
    parts = read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.array_sort(F.collect_list(body)), "").alias("source"))
    files = read("nation").select("n_nationkey").join(parts, "n_nationkey", "left").select(F.format_string("nation_%d.py", "n_nationkey").alias("file_path"), F.coalesce("source", F.lit("")).alias("source"))
    facts = pysource.parse(files)
    total = F.coalesce(F.aggregate(F.transform("functions", lambda f: f["cc"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    return facts.select("file_path", F.size("functions").cast("long").alias("functions"), F.size("calls").cast("long").alias("calls"), total.alias("cc"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from codeloom import overlay_catalog, panel_catalog, resolution_catalog, task_catalog  # noqa: F401  (register more)

    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
