"""A property graph over the star-schema tables, as SQL text that Spark and DuckDB both read.

Tables stand in braces: Spark binds them to DataFrames, and `oracle` puts the plain names there.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.operators.grams import GramIndex, build_grams
from codeloom.plans.stored import StoredGraph, buckets_for, fingerprint

#: Files and classes stand for nations, functions for customers, parts and suppliers, methods for orders.
NODES = """
SELECT concat('file:', n_name) AS id, 'File' AS label, 'm.py' AS name, concat('/w/', r_name, '/', n_name, '/m.py') AS file_path,
       0 AS start_line, 0 AS end_line, 0 AS parameter_count, CAST(NULL AS STRING) AS return_type, split('', ',') AS decorators, CAST(n_nationkey AS BIGINT) AS ordinal
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('cls:', n_name), 'Class', n_name, concat('/w/', r_name, '/', n_name, '/m.py'), 1, 40, 0, NULL, split('dataclass,final', ','), 1000 + n_nationkey
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('fn:c', c_custkey), 'Function', c_name, concat('/w/', r_name, '/', n_name, '/m.py'), CAST(c_custkey AS INT), CAST(c_custkey + c_custkey % 130 AS INT), CAST(c_custkey % 6 AS INT), c_mktsegment,
       split('cached', ','), 10000000000 + c_custkey
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('fn:p', p_partkey), 'Function', p_name, concat('/w/parts/', p_brand, '/m.py'), CAST(p_partkey AS INT), CAST(p_partkey + p_size AS INT), CAST(p_size % 5 AS INT), p_type,
       split(concat('typed,', p_brand), ','), 20000000000 + p_partkey
  FROM {part}
UNION ALL
SELECT concat('fn:s', s_suppkey), 'Function', s_name, concat('/w/', r_name, '/', n_name, '/test_s.py'), CAST(s_suppkey AS INT), CAST(s_suppkey + 3 AS INT), 0, NULL, split('', ','), 30000000000 + s_suppkey
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('m:o', o_orderkey), 'Method', concat('order_', o_orderkey % 5000), concat('/w/', r_name, '/', n_name, '/m.py'), CAST(o_orderkey AS INT), CAST(o_orderkey + o_orderkey % 70 AS INT), CAST(o_orderkey % 4 AS INT), o_orderstatus,
       split('', ','), 40000000000 + o_orderkey
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

#: Call edges are told apart by their line, so that they form a multigraph; other edges by their ends.
CALL_ID = "substr(md5(concat(source_id, '->', target_id, '@', line)), 1, 16)"
PLAIN_ID = "substr(md5(concat(source_id, '-', edge_type, '->', target_id)), 1, 16)"
CALLS = """
  SELECT concat('m:o', o_orderkey) AS source_id, concat('fn:c', o_custkey) AS target_id, CAST(0.95E0 AS DOUBLE) AS confidence, 0 AS line FROM {orders}
  UNION ALL
  SELECT concat('m:o', l_orderkey), concat('fn:p', l_partkey), CAST(max(CASE l_returnflag WHEN 'N' THEN 0.95E0 WHEN 'R' THEN 0.9E0 ELSE 0.5E0 END) AS DOUBLE), l_linenumber
    FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_linenumber
  UNION ALL
  SELECT DISTINCT concat('fn:s', l_suppkey), concat('fn:p', l_partkey), CAST(0.9E0 AS DOUBLE), 0 FROM {lineitem}
"""
STRUCTURE = """
  SELECT concat('file:', n_name) AS source_id, concat('fn:c', c_custkey) AS target_id, 'CONTAINS' AS edge_type, CAST(1.0E0 AS DOUBLE) AS confidence
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
  UNION ALL
  SELECT concat('cls:', n_name), concat('m:o', o_orderkey), 'HAS_METHOD', CAST(0.95E0 AS DOUBLE)
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  UNION ALL
  SELECT concat('cls:', n.n_name), concat('cls:', b.n_name), 'EXTENDS', CAST(0.85E0 AS DOUBLE)
    FROM {nation} n JOIN (SELECT n_regionkey AS rk, min(n_nationkey) AS nk FROM {nation} GROUP BY n_regionkey) f ON n.n_regionkey = f.rk
    JOIN {nation} b ON b.n_nationkey = f.nk WHERE n.n_nationkey <> b.n_nationkey
"""
EDGES = (
    f"\nSELECT {CALL_ID} AS id, source_id, target_id, 'CALLS' AS edge_type, confidence, line FROM ({CALLS}) calls\n"
    f"UNION ALL\nSELECT {PLAIN_ID}, source_id, target_id, edge_type, confidence, 0 FROM ({STRUCTURE}) structure\n"
)
#: The same without ids, which follow from the other columns.
ENDS = f"SELECT source_id, target_id, 'CALLS' AS edge_type, confidence, line FROM ({CALLS}) calls UNION ALL SELECT source_id, target_id, edge_type, confidence, 0 FROM ({STRUCTURE}) structure"
#: ENDS before rows are merged: those of a kind above 0 are one edge if they differ in confidence alone (the greatest), those of kind 0 are an edge each.
UNMERGED = f"""
SELECT source_id, target_id, 'CALLS' AS edge_type, confidence, line, kind FROM (
  SELECT concat('m:o', o_orderkey) AS source_id, concat('fn:c', o_custkey) AS target_id, CAST(0.95E0 AS DOUBLE) AS confidence, 0 AS line, 0 AS kind FROM {{orders}}
  UNION ALL
  SELECT concat('m:o', l_orderkey), concat('fn:p', l_partkey), CAST(CASE l_returnflag WHEN 'N' THEN 0.95E0 WHEN 'R' THEN 0.9E0 ELSE 0.5E0 END AS DOUBLE), l_linenumber, 1 FROM {{lineitem}}
  UNION ALL
  SELECT concat('fn:s', l_suppkey), concat('fn:p', l_partkey), CAST(0.9E0 AS DOUBLE), 0, 2 FROM {{lineitem}}
) calls
UNION ALL
SELECT source_id, target_id, edge_type, confidence, 0, 0 FROM ({STRUCTURE}) structure
"""
EDGE_ID = f"CASE edge_type WHEN 'CALLS' THEN {CALL_ID} ELSE {PLAIN_ID} END"

#: Users as nodes of one day; an edge leads to the next event of the same kind on that day.
EVENT_EDGES = """
SELECT DISTINCT concat(day, '/', user_id) AS source_id, concat(day, '/', next_user) AS target_id FROM (
  SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, user_id,
         lead(user_id) OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS next_user
    FROM {events}
) steps WHERE next_user IS NOT NULL
"""

#: A commit is an order, its author the customer, and its files the kinds of its parts.
COMMITS = """
SELECT o_orderkey AS commit_idx, concat('a', o_custkey) AS author, o_orderdate AS date, concat('src/', replace(p_type, ' ', '_'), '.py') AS file
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""


def merged(ends: DataFrame) -> DataFrame:
    """ENDS of UNMERGED. Rows that lie by source or target are merged where they are."""
    rows = ends.groupBy("source_id", "target_id", "edge_type", "line", "kind").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1, CASE kind WHEN 0 THEN n ELSE 1 END)")))
    return rows.select("source_id", "target_id", "edge_type", "confidence", "line")


def tables_of(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables of a data folder."""
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


_stored: dict[tuple[str, str], StoredGraph] = {}


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The star graph of a data folder; each of its tables is written when first asked for, once for each application and state of the folder's files."""
    paths = [f"{sf_dir}/{t}.parquet" for t in {*tables_of(NODES), *tables_of(EDGES)}]
    known, size = fingerprint(spark, paths)
    key = (spark.sparkContext.applicationId, known)
    if key not in _stored:
        _stored[key] = StoredGraph(bound(spark, sf_dir, NODES), bound(spark, sf_dir, UNMERGED), F.expr(EDGE_ID), buckets_for(size), merged)
    return _stored[key]


_grams: dict[tuple[str, str], GramIndex] = {}


def star_grams(spark: SparkSession, sf_dir: str) -> GramIndex:
    """The index of the star graph's names, written once like the graph, and without it."""
    known, size = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in tables_of(NODES)])
    key = (spark.sparkContext.applicationId, known)
    if key not in _grams:
        _grams[key] = build_grams(bound(spark, sf_dir, NODES), buckets_for(size))
    return _grams[key]


def oracle(sql: str, *ctes: str) -> str:
    """SQL for DuckDB: nodes, edges, event_edges and commits where it names them, then further CTEs, then the query."""
    parts = {"nodes": NODES, "edges": EDGES, "event_edges": EVENT_EDGES, "commits": COMMITS}
    text = " ".join([*ctes, sql])
    shared = [f"{k} AS ({v.format(**{t: t for t in tables_of(v)})})" for k, v in parts.items() if re.search(rf"\b{k}\b", text)]
    head = ", ".join([*shared, *ctes])
    return f"WITH RECURSIVE {head} {sql}" if head else sql
