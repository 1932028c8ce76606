"""Counts and measures over a graph and over the history of its repository."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from codeloom.graph import PropertyGraph
from codeloom.operators.traverse import cycles, impact, is_test_file
from codeloom.plans.fixpoint import cut


def ladder(default: str, *steps: tuple[Column, str]) -> Column:
    """The name of the first step whose condition holds."""
    out = F.lit(default)
    for condition, name in reversed(steps):
        out = F.when(condition, name).otherwise(out)
    return out


def group_of(path: str = "file_path", root: str = "") -> Column:
    """The first two folders of a path under root: "root" for a file right there, "other" without a path."""
    inside = F.regexp_replace(F.when(F.col(path).startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(F.col(path)), "^/+", "")
    folders = F.split(inside, "/")
    return F.when(F.coalesce(F.col(path), F.lit("")) == "", "other").when(F.size(folders) == 1, "root").otherwise(F.array_join(F.slice(F.slice(folders, F.lit(1), F.size(folders) - 1), 1, 2), "/"))


def view_group(root: str) -> Column:
    """group_of below a root; without one all nodes are of the group "other"."""
    return group_of(root=root) if root else F.lit("other")


def fan(g: PropertyGraph) -> DataFrame:
    """id, name, fan_in and fan_out of functions and methods, in call sites."""
    calls = g.edges.where("edge_type = 'CALLS'")
    nodes = g.nodes.where(F.col("label").isin("Function", "Method")).select("id", "name")
    into = calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    out = calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("fan_out"))
    return nodes.join(into, "id", "left").join(out, "id", "left").fillna(0, ["fan_in", "fan_out"])


def complexity(nodes: DataFrame, cc: str = "cc") -> DataFrame:
    """id, name, cc, line_count, parameter_count and risk of functions and methods whose complexity is in the column cc."""
    rows = nodes.where(F.col("label").isin("Function", "Method")).select("id", "name", "file_path", F.col(cc).alias("cc"), (F.col("end_line") - F.col("start_line") + 1).alias("line_count"), "parameter_count")
    c, n = F.col("cc"), F.col("line_count")
    return rows.withColumn("risk", ladder("LOW", ((c > 20) | (n > 200), "CRITICAL"), ((c > 10) | (n > 100), "HIGH"), ((c > 5) | (n > 50), "MEDIUM")))


def module_health(g: PropertyGraph, cc: str = "cc", root: str = "") -> DataFrame:
    """A row for each group of folders: sizes, complexity, calls within and across, god functions and classes, risk."""
    nodes = g.nodes.where(F.col("label").isin("Function", "Method", "Class")).withColumn("grp", group_of("file_path", root))
    methods = g.edges.where("edge_type = 'HAS_METHOD'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("methods"))
    code = F.when(F.col("label") != "Class", F.col(cc))
    base = nodes.join(methods, "id", "left").groupBy("grp").agg(
        F.count("*").alias("node_count"), F.sum(code).alias("cc_sum"), F.count(code).alias("cc_count"), F.max(code).alias("cc_max"),
        F.count_if(code > 10).alias("god_functions"), F.count_if((F.col("label") == "Class") & (F.col("methods") > 20)).alias("god_classes"),
    )
    place = nodes.select("id", "grp")
    calls = g.edges.where(F.col("edge_type").isin("CALLS", "IMPORTS")).select("source_id", "target_id", "edge_type")
    ends = calls.join(place.select(F.col("id").alias("source_id"), "grp"), "source_id").join(place.select(F.col("id").alias("target_id"), F.col("grp").alias("to")), "target_id", "left")
    here = F.coalesce(F.col("to") == F.col("grp"), F.lit(False))
    links = ends.groupBy("grp").agg(F.count("*").alias("calls"), F.count_if(~here).alias("cross_calls"), F.count_if(here & (F.col("edge_type") == "CALLS")).alias("internal"))
    out = base.join(links, "grp", "left").fillna(0, ["calls", "cross_calls", "internal", "cc_sum", "cc_max"])
    mean = F.coalesce(F.try_divide("cc_sum", "cc_count"), F.lit(0.0))
    coupling = F.coalesce(F.try_divide("cross_calls", "calls"), F.lit(0.0))
    n = F.col("node_count")
    out = out.withColumn("avg_cc", mean).withColumn("coupling", coupling).withColumn("cohesion", F.col("internal") / F.greatest(n * (n - 1), F.lit(1)))
    god = F.col("god_functions")
    return out.withColumn("risk", ladder("LOW", ((F.col("cc_max") > 20) | (god > 3), "CRITICAL"), ((F.col("cc_max") > 10) | (F.col("coupling") > 0.8), "HIGH"), ((F.col("avg_cc") > 5) | (F.col("coupling") > 0.6), "MEDIUM")))


@F.pandas_udf(DoubleType())
def rounded(values: pd.Series, digits: pd.Series) -> pd.Series:
    """As Python rounds: the exact value of the double, halves to even. Spark rounds its shortest decimal form."""
    return pd.Series([None if pd.isna(v) else round(v, int(d)) for v, d in zip(values, digits, strict=True)], dtype="float64")


def module_report(g: PropertyGraph, cc: str = "cc", root: str = "") -> DataFrame:
    """Module health with its means and shares rounded for display, the most complex groups first."""
    places = {"avg_cc": 1, "coupling": 2, "cohesion": 3}
    return module_health(g, cc, root).withColumns({c: rounded(F.col(c), F.lit(d)) for c, d in places.items()}).orderBy(F.desc("avg_cc"), "grp")


def complexity_of(nodes: DataFrame, name: str, cc: str = "cc") -> DataFrame:
    """The most complex function or method of a name: one row, or none."""
    found = nodes.where((F.col("name") == name) & F.col("label").isin("Function", "Method")).orderBy(F.desc(cc), "ordinal").limit(1)
    return complexity(found, cc)


def impact_preview(g: PropertyGraph, node_id: str) -> DataFrame:
    """One row: what three levels up and two levels down of a node a change affects, its risk by those above, and the names of their files."""
    seed = g.nodes.where(F.col("id") == node_id).select(F.col("id").alias("seed"), "id")
    up = impact(g, seed)
    down = impact(g, seed, direction="downstream", max_depth=2)
    names = F.array_join(F.array_sort(F.collect_set(F.element_at(F.split("file_path", "/"), -1))), ",")
    counts = up.agg(F.count("*").alias("upstream_affected"), F.count_if(F.col("depth") == 1).alias("direct"), names.alias("affected_files"))
    both = counts.crossJoin(down.agg(F.count("*").alias("downstream_affected")))  # one row each
    n, d = F.col("upstream_affected"), F.col("direct")
    level = ladder("LOW", ((n >= 20) & (d >= 8), "CRITICAL"), ((n >= 6) & (d >= 4), "HIGH"), ((n >= 3) & (d >= 1), "MEDIUM"))
    return both.select("upstream_affected", "downstream_affected", (n + F.col("downstream_affected")).alias("total_affected"), level.alias("risk"), "affected_files")


def dependency_check(g: PropertyGraph, shown: int = 5) -> DataFrame:
    """One row: the number of cycles, and the first of them as lists of names."""
    found = cycles(g)
    first = found.orderBy(F.desc("length"), "scc").limit(shown).agg(F.collect_list("node_names").alias("cycles"))
    return found.agg(F.count("*").alias("n_cycles")).crossJoin(first)  # one row each


def health_report(g: PropertyGraph, cc: str = "cc", root: str = "") -> DataFrame:
    """kind, name and value: the totals ("total"), each function's complexity by id ("function") and each group's mean complexity ("module").

    value is as it is computed (see rounded for display); the display sorts functions and modules by it.
    """
    scores = complexity(g.nodes, cc)
    totals = scores.agg(F.count("*").cast("double").alias("functions"), F.coalesce(F.avg("cc"), F.lit(0.0)).alias("avg_complexity"), F.count_if(F.col("risk") == "HIGH").cast("double").alias("high"), F.count_if(F.col("risk") == "CRITICAL").cast("double").alias("critical"))
    rows = totals.unpivot([], ["functions", "avg_complexity", "high", "critical"], "name", "value").select(F.lit("total").alias("kind"), "name", "value")
    functions = scores.select(F.lit("function").alias("kind"), F.col("id").alias("name"), F.col("cc").cast("double").alias("value"))
    modules = module_health(g, cc, root).select(F.lit("module").alias("kind"), F.col("grp").alias("name"), F.col("avg_cc").cast("double").alias("value"))
    return rows.unionByName(functions).unionByName(modules)


def sidebar_counts(g: PropertyGraph, root: str = "") -> DataFrame:
    """kind ("label", "group" or "edge"), type and count: nodes by label and by group of folders, and edges by type."""
    grouped = g.nodes.groupBy(F.lit("group").alias("kind"), view_group(root).alias("type")).agg(F.count("*").alias("count"))
    labels = g.nodes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("type")).agg(F.count("*").alias("count"))
    return labels.unionByName(grouped).unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).agg(F.count("*").alias("count")))


def counters(g: PropertyGraph) -> DataFrame:
    """kind ("node" or "edge"), type and count."""
    return g.nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("type")).agg(F.count("*").alias("count")).unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).agg(F.count("*").alias("count")))


def hotspots(commits: DataFrame, as_of: Column, days: int = 90, recent: int = 30, weights: DataFrame | None = None) -> DataFrame:
    """Changes, recent changes, the three foremost authors and the last change of each file of commits(commit_idx, author, date, file).

    Authors of equal counts stand by their newest commit, then by name. score is the count over the
    largest one, times the file's weight(file, weight) if weights are given (1 for others), and 1 at most.
    """
    rows = commits.where(F.col("date") >= as_of - F.make_interval(days=F.lit(days))).select("commit_idx", "author", "date", "file").distinct()
    by_author = rows.groupBy("file", "author").agg(F.count("*").alias("n"), F.max("date").alias("newest"), F.count_if(F.col("date") >= as_of - F.make_interval(days=F.lit(recent))).alias("r"))
    ranked = by_author.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), F.desc("newest"), "author")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "author")))), lambda x: x["author"])
    files = ranked.groupBy("file").agg(F.sum("n").alias("change_count"), F.sum("r").alias("recent_changes"), F.array_join(top, ",").alias("top_authors"), F.max("newest").alias("last_modified"))
    most = files.agg(F.max("change_count").alias("most"))  # one row
    scored = files.crossJoin(F.broadcast(most)).withColumn("score", F.col("change_count") / F.col("most")).drop("most")
    if weights is not None:
        scored = scored.join(weights.select("file", "weight"), "file", "left").withColumn("score", F.col("score") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    return scored.withColumn("score", F.least(F.lit(1.0), "score"))


def file_weights(nodes: DataFrame, cc: str = "cc") -> DataFrame:
    """file and weight of the files with functions: the mean complexity of these."""
    return nodes.where(F.col("label").isin("Function", "Method") & F.col(cc).isNotNull()).groupBy(F.col("file_path").alias("file")).agg(F.avg(cc).alias("weight"))


def recent(commits: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The commits of the last days up to as_of."""
    return commits.where(F.col("date") >= as_of - F.make_interval(days=F.lit(days)))


def candidate_pairs(rows: DataFrame, min_count: int) -> DataFrame:
    """file_a < file_b that share one of their commits but for the min_count - 1 largest of each; rows(commit_idx, file) stand once."""
    sizes = rows.groupBy("commit_idx").agg(F.count("*").alias("size"))
    largest = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("size"), F.desc("commit_idx")))
    small = cut(rows.join(sizes, "commit_idx").withColumn("k", largest).where(F.col("k") >= min_count).select("commit_idx", "file"))
    return small.alias("x").join(small.alias("y"), F.expr("x.commit_idx = y.commit_idx AND x.file < y.file")).select(F.col("x.file").alias("file_a"), F.col("y.file").alias("file_b")).distinct()


def co_changes(commits: DataFrame, as_of: Column, days: int = 90, min_count: int = 3, min_confidence: float = 0.3, limit: int = 100) -> DataFrame:
    """Pairs of files that change together in the last days: file_a < file_b, their commits in common and the share of the rarer file's (see rounded for display).

    A pair with min_count commits in common has one among those of either file that remain when
    the min_count - 1 largest of the file's are left out. So only these make candidates, files of
    fewer commits make none, and a commit of very many files makes no pairs, as it is the largest
    of each of them. The candidates' commits in common are then counted over all.
    """
    rows = recent(commits, as_of, days).select("commit_idx", "file").distinct()
    alone = cut(rows.groupBy("file").agg(F.count("*").alias("n")))
    often = cut(rows.join(alone.where(F.col("n") >= min_count).select("file"), "file", "left_semi"))
    pairs = candidate_pairs(often, min_count)
    first = pairs.join(often.withColumnRenamed("file", "file_a"), "file_a")
    pairs = first.join(often.withColumnRenamed("file", "file_b"), ["file_b", "commit_idx"], "left_semi").groupBy("file_a", "file_b").agg(F.count("*").alias("count"))
    both = pairs.where(F.col("count") >= min_count).join(alone.select(F.col("file").alias("file_a"), F.col("n").alias("na")), "file_a").join(alone.select(F.col("file").alias("file_b"), F.col("n").alias("nb")), "file_b")
    out = both.withColumn("confidence", F.col("count") / F.least("na", "nb")).where(F.col("confidence") >= min_confidence)
    return out.orderBy(F.desc("count"), "file_a", "file_b").limit(limit).select("file_a", "file_b", "count", "confidence")


def co_changes_of(commits: DataFrame, as_of: Column, file: str, days: int = 90, min_count: int = 3, min_confidence: float = 0.3, limit: int = 100) -> DataFrame:
    """The pairs of one file, on either side. Only commits that touch it are paired."""
    rows = recent(commits, as_of, days).select("commit_idx", "file").distinct()
    with_it = rows.where(F.col("file") == file).select("commit_idx")
    alone = rows.groupBy("file").agg(F.count("*").alias("n"))
    pairs = rows.join(with_it, "commit_idx", "left_semi").where(F.col("file") != file).groupBy("file").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)
    own = rows.where(F.col("file") == file).agg(F.count("*").alias("own"))
    out = pairs.join(alone, "file").join(F.broadcast(own)).withColumn("confidence", F.col("count") / F.least("n", "own")).where(F.col("confidence") >= min_confidence)
    named = out.select(F.least("file", F.lit(file)).alias("file_a"), F.greatest("file", F.lit(file)).alias("file_b"), "count", "confidence")
    return named.orderBy(F.desc("count"), "file_a", "file_b").limit(limit)


def git_summary(commits: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Files, contributors among the three foremost of each file, and the file that changes most."""
    spots = hotspots(commits, as_of, days)
    people = spots.select(F.explode(F.split("top_authors", ",")).alias("a")).agg(F.countDistinct("a").alias("active_contributors"))
    first = F.min_by("file", F.struct(-F.col("change_count"), F.col("file")))
    return spots.agg(F.count("*").alias("files"), F.sum("change_count").alias("changes"), first.alias("most_volatile")).crossJoin(people)


def safe_to_modify(g: PropertyGraph) -> DataFrame:
    """For each file its symbols, the calls into them from other files and the files these come from, whether a test calls or imports any node of it, and the risk of a change."""
    nodes = g.nodes.select("id", "label", "file_path")
    files = nodes.groupBy("file_path").agg(F.count_if(F.col("label").isin("Function", "Method", "Class")).alias("node_count"))
    edges = g.edges.where(F.col("edge_type").isin("CALLS", "IMPORTS")).select("source_id", "target_id", "edge_type")
    ends = edges.join(nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("from_file")), "source_id").join(nodes.toDF("target_id", "label", "file_path"), "target_id")  # by source first, as edges lie by it
    counted = (F.col("edge_type") == "CALLS") & F.col("label").isin("Function", "Method", "Class") & (F.col("from_file") != F.col("file_path"))
    into = ends.groupBy("file_path").agg(F.count_if(counted).alias("incoming"), F.countDistinct(F.when(counted, F.col("from_file"))).alias("dependent_files"), F.max(is_test_file("from_file")).alias("has_tests"))
    out = files.join(into, "file_path", "left").fillna(0, ["incoming", "dependent_files"]).fillna(False, ["has_tests"])
    n = F.col("incoming")
    return out.withColumn("risk", ladder("LOW", (n > 20, "CRITICAL"), (n > 10, "HIGH"), (n > 3, "MEDIUM")))


def dependents(g: PropertyGraph, any_node: bool = False) -> DataFrame:
    """For each file, the edges into it from other files and the files they come from, whether a test is among them, and the risk of a change.

    Calls into symbols count; with any_node, calls and imports into any node.
    """
    kinds = ("CALLS", "IMPORTS") if any_node else ("CALLS",)
    into = g.nodes if any_node else g.nodes.where(F.col("label").isin("Function", "Method", "Class"))
    edges = g.edges.where(F.col("edge_type").isin(*kinds)).select("source_id", "target_id")
    ends = edges.join(g.nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("from_file")), "source_id").join(into.select(F.col("id").alias("target_id"), "file_path"), "target_id")
    out = ends.where("from_file <> file_path").groupBy("file_path").agg(F.count("*").alias("incoming"), F.countDistinct("from_file").alias("dependent_files"), F.max(is_test_file("from_file")).alias("has_tests"))
    n = F.col("incoming")
    return out.withColumn("risk", ladder("LOW", (n > 20, "CRITICAL"), (n > 10, "HIGH"), (n > 3, "MEDIUM")))
