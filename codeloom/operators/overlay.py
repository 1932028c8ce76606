"""Robot nodes with the topics, services, parameters and actions they use, as nodes and edges beside the code's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph

#: What an entry's kind makes: the label of its node, prefix of that node's id, type and prefix of its edge.
MADE = {
    "publisher": ("TOPIC", "topic::", "PUBLISHES_TO", "pub::"),
    "subscriber": ("TOPIC", "topic::", "SUBSCRIBES_TO", "sub::"),
    "service": ("SERVICE", "service::", "PROVIDES_SERVICE", "svc::"),
    "parameter": ("PARAMETER", "param::", "USES_PARAMETER", "param::"),
    "action_server": ("ACTION", "action::", "PROVIDES_ACTION", "action::"),
    "action_client": ("ACTION", "action::", "CALLS_ACTION", "action::"),
}
#: The order in which a class's entries are taken in, and the confidence of an edge.
TURN = {"publisher": 0, "subscriber": 1, "service": 2, "parameter": 3, "action_server": 4, "action_client": 4}
CONFIDENCE = 0.95


def picked(values: dict[str, object]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]


def overlay(robots: DataFrame) -> PropertyGraph:
    """nodes(id, label, name, file_path, topic_name, msg_type) and edges(id, source_id, target_id, edge_type, confidence) of robots(file_path, ordinal, place, class_name, node_name, entries).

    A class of a later file takes an earlier one's place, runtime name (topic_name) included, but both
    declare; of a topic, service, parameter or action the first declaration counts, and of an action
    both served and called under one name by a class, one edge: the first.
    """
    ros = lambda c: F.concat(F.lit("ros2_node::"), c)
    at = F.struct("ordinal", "place")
    owners = robots.groupBy("class_name").agg(F.max_by(F.struct("file_path", "node_name"), at).alias("x"))
    nodes = owners.select(ros("class_name").alias("id"), F.lit("ROS2_NODE").alias("label"), F.col("class_name").alias("name"), "x.file_path", F.col("x.node_name").alias("topic_name"), F.lit(None).cast("string").alias("msg_type"))
    rows = robots.select("file_path", "ordinal", "place", "class_name", F.posexplode("entries").alias("k", "e")).select("file_path", "ordinal", "place", "class_name", "k", "e.kind", "e.name", "e.type")
    owned = F.when(F.col("kind") == "parameter", F.concat("class_name", F.lit("::"), "name")).otherwise(F.col("name"))
    first = F.struct("ordinal", "place", picked(TURN), "k")
    rows = rows.select("*", first.alias("at"), picked({k: v[0] for k, v in MADE.items()}).alias("label"), F.concat(picked({k: v[1] for k, v in MADE.items()}), owned).alias("id"))
    things = rows.groupBy("id").agg(F.min_by(F.struct("label", "name", "file_path", "type"), "at").alias("x"))
    topic = F.when(F.col("x.label") == "TOPIC", F.col("x.name"))
    nodes = nodes.unionByName(things.select("id", "x.label", "x.name", "x.file_path", topic.alias("topic_name"), F.col("x.type").alias("msg_type")))
    edge = F.concat(picked({k: v[3] for k, v in MADE.items()}), ros("class_name"), F.lit("::"), "id")
    ends = rows.select(edge.alias("edge"), ros("class_name").alias("source_id"), F.col("id").alias("target_id"), picked({k: v[2] for k, v in MADE.items()}).alias("edge_type"), "at")
    edges = ends.groupBy("edge").agg(F.min_by(F.struct("source_id", "target_id", "edge_type"), "at").alias("x")).select(F.col("edge").alias("id"), "x.*", F.lit(CONFIDENCE).alias("confidence"))
    return PropertyGraph(nodes, edges)
