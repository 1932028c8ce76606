"""The queries over robot software, on sources made from the tables: a file a customer, a class a nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.catalog import query
from codeloom.operators.overlay import overlay
from codeloom.sources import robotics

ENTRIES = (
    "entries AS (SELECT c_custkey AS ordinal, concat('C', c_nationkey) AS class_name, concat('/w/', c_custkey, '.py') AS file_path, t.k, t.kind, t.name, t.type FROM customer, LATERAL (VALUES "
    "(0, 'publisher', concat('/', c_mktsegment), concat('T', c_custkey % 3)), (1, 'subscriber', concat('/', c_nationkey % 4), 'Msg'), (2, 'service', concat('s', c_custkey % 7), 'Srv'), (3, 'parameter', concat('p', c_custkey % 2), NULL), "
    "(4, CASE WHEN c_custkey % 2 = 0 THEN 'action_server' ELSE 'action_client' END, 'go', 'Act')) t(k, kind, name, type))",
    "made AS (SELECT *, CASE kind WHEN 'publisher' THEN 'TOPIC' WHEN 'subscriber' THEN 'TOPIC' WHEN 'service' THEN 'SERVICE' WHEN 'parameter' THEN 'PARAMETER' ELSE 'ACTION' END AS label, concat(CASE kind WHEN 'publisher' THEN 'topic::' WHEN 'subscriber' THEN 'topic::' WHEN 'service' THEN 'service::' WHEN 'parameter' THEN concat('param::', class_name, '::') ELSE 'action::' END, name) AS id FROM entries)",
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, ordinal and source: a node class of the customer's nation, with one declaration of each kind."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    line = lambda *parts: F.concat(F.lit("        "), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit("\n"))
    body = F.concat(
        F.lit("from rclpy.node import Node\n\n\nclass C"), nation, F.lit("(Node):\n    def __init__(self):\n"),
        line("super().__init__('n", key, "')"),
        line("self.create_publisher(msgs.T", key % 3, ", '/", F.col("c_mktsegment"), "', qos_profile=10)"),
        line("self.create_subscription(Msg, '/", nation % 4, "', self.on_it, 10)"),
        line("self.create_service(Srv, 's", key % 7, "', self.serve)"),
        line("self.declare_parameter('p", key % 2, "', 1 + 1)"),
        F.when(key % 2 == 0, line("ActionServer(self, Act, 'go', self.act)")).otherwise(line("ActionClient(self, Act, 'go')")),
    )
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("/w/"), key, F.lit(".py")).alias("file_path"), key.alias("ordinal"), body.alias("source"))


@query("SELECT class_name, file_path, concat('n', ordinal) AS node_name, kind, name, type FROM entries", *ENTRIES)
def sc6_robot_classes(spark, sf_dir):
    found = robotics.robots(sources(spark, sf_dir))
    return found.select("class_name", "file_path", "node_name", F.explode("entries").alias("e")).select("class_name", "file_path", "node_name", "e.kind", "e.name", "e.type")


@query(
    "SELECT concat('ros2_node::', class_name) AS id, 'ROS2_NODE' AS label, class_name AS name, concat('/w/', max(ordinal), '.py') AS file_path, concat('n', max(ordinal)) AS topic_name, NULL AS msg_type FROM entries GROUP BY class_name "
    "UNION ALL SELECT id, label, name, file_path, CASE WHEN label = 'TOPIC' THEN name END, type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal, k) AS r FROM made) WHERE r = 1",
    *ENTRIES,
)
def r1_overlay_nodes(spark, sf_dir):
    return overlay(robotics.robots(sources(spark, sf_dir))).nodes


@query(
    "SELECT id, source_id, target_id, edge_type, 0.95::DOUBLE AS confidence FROM (SELECT concat(p, source_id, '::', target_id) AS id, source_id, target_id, edge_type, row_number() OVER (PARTITION BY p, source_id, target_id ORDER BY ordinal, k) AS r FROM "
    "(SELECT concat('ros2_node::', class_name) AS source_id, id AS target_id, ordinal, k, CASE kind WHEN 'publisher' THEN 'PUBLISHES_TO' WHEN 'subscriber' THEN 'SUBSCRIBES_TO' WHEN 'service' THEN 'PROVIDES_SERVICE' WHEN 'parameter' THEN 'USES_PARAMETER' WHEN 'action_server' THEN 'PROVIDES_ACTION' ELSE 'CALLS_ACTION' END AS edge_type, "
    "CASE kind WHEN 'publisher' THEN 'pub::' WHEN 'subscriber' THEN 'sub::' WHEN 'service' THEN 'svc::' WHEN 'parameter' THEN 'param::' ELSE 'action::' END AS p FROM made)) WHERE r = 1",
    *ENTRIES,
)
def r4_overlay_edges(spark, sf_dir):
    return overlay(robotics.robots(sources(spark, sf_dir))).edges


@query(
    "SELECT concat('/w/', n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '.msg' WHEN 1 THEN '.srv' ELSE '.action' END) AS file_path, CAST(n_nationkey AS STRING) AS name, CASE n_nationkey % 3 WHEN 0 THEN 'msg' WHEN 1 THEN 'srv' ELSE 'action' END AS kind, "
    "(CASE n_nationkey % 3 WHEN 0 THEN ['fields'] WHEN 1 THEN ['request', 'response'] ELSE ['goal', 'result', 'feedback'] END)[CASE n_nationkey % 3 WHEN 0 THEN 1 ELSE f.s END] AS section, f.place::INT AS place, f.t AS type_name, f.n AS field_name, CASE WHEN f.n = 'b' THEN concat('\"', n_name, '\"') END AS default_value "
    "FROM nation, (VALUES (1, 1, 'int32', 'a'), (1, 2, 'string', 'b'), (2, 4, 'bool[]', 'c'), (3, 5, 'float64', 'd'), (4, 6, 'int8', 'e')) f(s, place, t, n) WHERE f.s <= n_nationkey % 3 + 1 OR n_nationkey % 3 = 0"
)
def sc4_definitions(spark, sf_dir):
    kind = F.element_at(F.array(F.lit(".msg"), F.lit(".srv"), F.lit(".action")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("# all\nint32 a  # one\n  string   b = \""), "n_name", F.lit("\"\nlonely\n---\nbool[] c#\n ---\nfloat64\td\n---\nint8 e\n"))
    files = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("/w/"), "n_nationkey", kind).alias("file_path"), text.alias("source"))
    return robotics.definitions(files)


@query("SELECT n_nationkey AS ordinal, concat('pkg', n_regionkey) AS package, concat('run', n_nationkey) AS executable, CASE WHEN n_nationkey % 2 = 0 THEN 'LaunchConfiguration(''n'')' ELSE n_name END AS name, 'rate,cfg.yaml' AS parameters, '/a>/b' AS remappings, 'use_sim' AS arguments FROM nation WHERE n_nationkey % 5 <> 0")
def sc5_launches(spark, sf_dir):
    name = F.when(F.col("n_nationkey") % 2 == 0, "LaunchConfiguration('n')").otherwise(F.concat(F.lit("'"), "n_name", F.lit("'")))
    define = F.when(F.col("n_nationkey") % 5 == 0, "def other():\n").otherwise("def generate_launch_description():\n")
    call = F.concat(F.lit("    return [DeclareLaunchArgument('use_sim'), Node(package='pkg"), "n_regionkey", F.lit("', executable='run"), "n_nationkey", F.lit("', name="), name, F.lit(", parameters=[{'rate': 1}, 'cfg.yaml'], remappings=[('/a', '/b'), x]), Node(package='p')]\n"))
    files = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("file_path"), F.concat(define, call).alias("source"))
    rows = robotics.launches(files).select("file_path", F.explode("nodes").alias("n"), F.array_join("arguments", ",").alias("arguments"))
    pairs = F.array_join(F.transform("n.remappings", lambda r: F.concat(r["source"], F.lit(">"), r["target"])), ",")
    return rows.select(F.col("file_path").cast("int").alias("ordinal"), "n.package", "n.executable", "n.name", F.array_join("n.parameters", ",").alias("parameters"), pairs.alias("remappings"), "arguments")
