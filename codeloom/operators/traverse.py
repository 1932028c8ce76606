"""Traversals: what a change reaches, paths, components, tests that cover a symbol, orphans."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.plans.fixpoint import components, cut, propagated_labels

TEST_FILE = r"(^|/)(test_[^/]*|[^/]*_test\.py)$"
#: Names and prefixes of functions that something outside the code calls, and the edges that count as a use.
ENTRY_NAMES = ("main", "__init__", "__new__", "__call__", "__enter__", "__exit__", "setup", "teardown")
ENTRY_PREFIXES = ("on_", "handle_", "test_")
USES = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "HAS_METHOD", "HAS_PROPERTY", "DECORATES")


def is_test_file(path: str | Column = "file_path") -> Column:
    return F.coalesce((F.col(path) if isinstance(path, str) else path).rlike(TEST_FILE), F.lit(False))


def frontier_hits(edges: DataFrame, frontier: DataFrame, own: str, other: str) -> DataFrame:
    """One row for each seed and node that an edge reaches from the frontier: the edge of highest confidence, then least type and id."""
    hits = edges.join(frontier.select("seed", F.col("id").alias(own)), own)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("edge_type").alias("t"), F.col("id").alias("e"))).alias("x")
    return hits.groupBy("seed", F.col(other).alias("id")).agg(best).select("seed", "id", F.col("x.t").alias("edge_type"), (-F.col("x.c")).alias("confidence"))


def impact(g: PropertyGraph, seeds: DataFrame, direction: str = "upstream", max_depth: int = 3, min_confidence: float = 0.0, relation_types: tuple[str, ...] | None = None, cut_rounds: bool = True) -> DataFrame:
    """Nodes within max_depth edges of each seed(seed, id): seed, id, name, label, file_path, depth, edge_type, confidence.

    All seeds go together. Only the ids move between rounds, and each round meets the edges kept by
    the end that it comes from; names are looked up once, at the end. A class brings its methods
    along as seeds. A node that is missing counts as seen and leads nowhere. cut_rounds writes each
    round's ids down, so that a round doesn't do the ones before it again.
    """
    own, other = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    edges = g.edges_by(own).where(F.col("confidence") >= min_confidence)
    if relation_types:
        edges = edges.where(F.col("edge_type").isin(*relation_types))
    classes = seeds.join(g.by_label("Class").select("id"), "id")
    methods = g.edges_by(own).where("edge_type = 'HAS_METHOD'").join(classes.select("seed", F.col("id").alias("source_id")), "source_id")
    frontier = seeds.select("seed", "id").unionByName(methods.select("seed", F.col("target_id").alias("id"))).distinct()
    frontier = cut(frontier) if cut_rounds else frontier
    seen, out = frontier, None
    for depth in range(1, max_depth + 1):
        hits = frontier_hits(edges, frontier, own, other).join(seen, ["seed", "id"], "left_anti")
        there = hits.join(g.nodes.select("id", F.lit(True).alias("known")), "id", "left").withColumn("depth", F.lit(depth))
        there = cut(there) if cut_rounds else there
        seen = seen.unionByName(there.select("seed", "id"))
        there = there.where("known").drop("known")
        out = there if out is None else out.unionByName(there)
        frontier = there.select("seed", "id")
    return out.join(g.nodes.select("id", "name", "label", "file_path"), "id").select("id", "seed", "edge_type", "confidence", "name", "label", "file_path", "depth")


def risk(found: DataFrame) -> DataFrame:
    """seed, total, direct and risk of impact rows; seeds that reach nothing have no row."""
    counts = found.groupBy("seed").agg(F.count("*").alias("total"), F.count_if(F.col("depth") == 1).alias("direct"))
    level = F.lit("LOW")
    for name, total, direct in (("MEDIUM", 3, 1), ("HIGH", 6, 4), ("CRITICAL", 20, 8)):
        level = F.when((F.col("total") >= total) & (F.col("direct") >= direct), name).otherwise(level)
    return counts.withColumn("risk", level)


def stepped(g: PropertyGraph, frontier: DataFrame) -> DataFrame:
    """frontier(id, ...) by one edge, direction aside: its columns with id as "at", and the id, edge and edge_type that it leads to. Each direction meets the edges kept by that end."""
    start = frontier.withColumnRenamed("id", "at")
    ways = []
    for own, other in (("source_id", "target_id"), ("target_id", "source_id")):
        edges = g.edges_by(own).select(F.col(own).alias("at"), F.col(other).alias("id"), F.col("id").alias("edge"), "edge_type")
        ways.append(edges.join(start, "at"))
    return ways[0].unionByName(ways[1])


def neighbourhood(g: PropertyGraph, seeds: DataFrame, max_depth: int) -> DataFrame:
    """seed, id and least depth of the nodes within max_depth edges, direction aside."""
    seen = frontier = cut(seeds.select("seed", "id", F.lit(0).alias("depth")))
    for depth in range(1, max_depth + 1):
        next_ids = stepped(g, frontier.select("seed", "id")).select("seed", "id").distinct()
        frontier = cut(next_ids.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


class _Side:
    """One end's search: rounds of (id, parent, edge, edge_type), and all ids met."""

    def __init__(self, g: PropertyGraph, start: str):
        first = g.nodes.sparkSession.createDataFrame([(start, None, None, None)], "id string, parent string, edge string, edge_type string")
        self.g, self.rounds, self.seen, self.size = g, [first], first.select("id"), 1

    def grow(self) -> None:
        """What was met before goes after the step, by an outer join: Spark would put an anti join before it, and move all edges for that."""
        way = stepped(self.g, self.rounds[-1].select("id")).groupBy("id").agg(F.min(F.struct(F.col("at").alias("parent"), "edge", "edge_type")).alias("x"))
        new = cut(way.join(self.seen.withColumn("met", F.lit(True)), "id", "left").where("met IS NULL").select("id", "x.*"))
        self.rounds.append(new)
        self.seen, self.size = self.seen.unionByName(new.select("id")), new.count()

    def back(self, at: str) -> list:
        """(id, edge, edge_type) from `at` to the start: a row a round."""
        out = []
        for level in reversed(self.rounds):
            row = level.where(F.col("id") == at).head()
            if row:  # else met in an earlier round
                out.append((row.id, row.edge, row.edge_type))
                at = row.parent
        return out


def path_between(g: PropertyGraph, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """A shortest path from the first node of one name to that of another, direction aside: step, id, name, and edge and edge_type of the step to it (null for the first). No rows if there is none.

    Both ends search by turns, the one with the smaller last round first, until a round meets what
    the other has seen; that takes the square root of what one end would reach, where the number
    of nodes grows by a factor each round. Each round keeps an id with its least parent and edge; of
    the nodes that both have met the one of least id is taken. The way back reads a row a round.
    """
    from codeloom.graph import first_named

    start, end = (first_named(g.nodes, n).select("id").head() for n in (source, target))
    steps: list[tuple] = []
    if start and end:
        a, b = _Side(g, start.id), _Side(g, end.id)
        met = start.id if start.id == end.id else None
        while met is None and a.size and b.size and (max_depth is None or len(a.rounds) + len(b.rounds) - 2 < max_depth):
            side, other = (a, b) if a.size <= b.size else (b, a)
            side.grow()
            met = side.rounds[-1].join(other.seen, "id", "left_semi").agg(F.min("id").alias("id")).head().id
        if met is not None:
            ahead, behind = a.back(met)[::-1], b.back(met)
            steps = ahead + [(behind[i + 1][0], behind[i][1], behind[i][2]) for i in range(len(behind) - 1)]
    found = g.nodes.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(steps)], "step int, id string, edge string, edge_type string")
    named = g.nodes.join(F.broadcast(found.select("id")), "id", "left_semi").select("id", "name")
    return found.join(named, "id", "left").select("step", "id", F.coalesce("name", "id").alias("name"), "edge", "edge_type")


def symbol_links(g: PropertyGraph, min_confidence: float = 0.5) -> DataFrame:
    """source_id and target_id of edges of enough confidence between symbols, each pair once, none to itself."""
    symbols = g.nodes.where(F.col("label").isin("Function", "Method", "Class")).select("id")
    edges = g.edges.where(F.col("confidence") >= min_confidence).select("source_id", "target_id").distinct()
    for end in ("source_id", "target_id"):
        edges = edges.join(symbols.withColumnRenamed("id", end), end, "left_semi")
    return edges.where("source_id <> target_id")


def communities(g: PropertyGraph, min_confidence: float = 0.5, by: str = "components") -> DataFrame:
    """id and component of symbols linked by edges of enough confidence: connected ones, or by="labels" those that label propagation gives one label. Those alone have no row."""
    links = symbol_links(g, min_confidence)
    if by == "components":
        return components(links)
    labels = propagated_labels(links)
    large = labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    return labels.join(large, "label").select("id", F.col("label").alias("component"))


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """component, size, links (neighbours within, summed over members) and cohesion (links of all that could be) of members(id, component)."""
    pairs = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    inside = pairs.join(members.select(F.col("id").alias("a"), "component"), "a").join(members.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").where("component = other")
    links = inside.groupBy("component").agg((2 * F.count("*")).alias("links"))
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    share = F.when(F.col("size") <= 1, 1.0).otherwise(F.coalesce("links", F.lit(0)) / (F.col("size") * (F.col("size") - 1)))
    return sizes.join(links, "component", "left").select("component", "size", F.coalesce("links", F.lit(0)).alias("links"), share.alias("cohesion"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """id and scc (its least id) of the nodes on cycles of edges(source_id, target_id), self-loops included.

    Nodes without a way in or out are trimmed. Then each node takes the least id that reaches it;
    those of that colour which reach back to the id are one component, and the rest go on. Every
    round is a join on ids, written to the checkpoint folder.
    """
    left = cut(edges.where("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id").distinct())
    loops = left.where("source_id = target_id").select(F.col("source_id").alias("id")).distinct()
    left = left.where("source_id <> target_id")
    found = None
    while True:
        size = left.count()
        while size:  # trim
            ends = left.select(F.col("source_id").alias("target_id")).intersect(left.select("target_id"))
            left = cut(left.join(ends, "target_id", "left_semi").join(ends.withColumnRenamed("target_id", "source_id"), "source_id", "left_semi"))
            size, before = left.count(), size
            if size == before:
                break
        if not size:
            break
        colour = cut(left.select(F.col("source_id").alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            came = left.join(colour.withColumnRenamed("id", "source_id"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min("colour").alias("m"))
            new = cut(colour.join(came, "id", "left").select("id", F.least("colour", "m").alias("colour"), (F.col("m") < F.col("colour")).alias("moved")))
            colour = new.select("id", "colour")
            if new.where("moved").isEmpty():
                break
        own = cut(
            left.join(colour.select(F.col("id").alias("source_id"), F.col("colour").alias("cs")), "source_id")
            .join(colour.select(F.col("id").alias("target_id"), F.col("colour").alias("ct")), "target_id")
            .where("cs = ct")
            .select("source_id", "target_id", F.col("cs").alias("colour"))
        )
        back = reached = cut(colour.where("id = colour"))
        while not reached.isEmpty():
            step = own.join(reached.select(F.col("id").alias("target_id"), "colour"), ["target_id", "colour"]).select(F.col("source_id").alias("id"), "colour").distinct()
            reached = cut(step.join(back, ["id", "colour"], "left_anti"))
            back = back.unionByName(reached)
        back = cut(back)
        found = back if found is None else found.unionByName(back)
        done = back.select("id")
        left = own.select("source_id", "target_id").join(done.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(done.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        left = cut(left)
    groups = loops.select("id", F.col("id").alias("colour")) if found is None else found.unionByName(loops.join(found, "id", "left_anti").select("id", F.col("id").alias("colour")))
    sizes = groups.groupBy("colour").agg(F.count("*").alias("size"))
    big = groups.join(sizes, "colour").join(loops.withColumn("loop", F.lit(True)), "id", "left")
    return big.where("size > 1 OR loop").select("id", F.col("colour").alias("scc"), "size")


#: Edges that make a cycle of dependencies.
CYCLE_TYPES = ("CALLS", "IMPORTS", "EXTENDS")


def cycles(g: PropertyGraph) -> DataFrame:
    """The cycles of calls, imports and extensions: scc (its least id), length, node_ids and node_names in order of ids, and edge_types within, sorted.

    Edges may lack an end node, whose id then stands for its name; of several edges between two nodes the last one's type counts.
    """
    edges = g.edges.where(F.col("edge_type").isin(*CYCLE_TYPES))
    members = cut(strongly_connected(edges.select("source_id", "target_id")).select("id", "scc"))
    rank = next((c for c in ("ordinal", "id") if c in g.edges.columns), "edge_type")
    last = edges.groupBy("source_id", "target_id").agg(F.max_by("edge_type", rank).alias("edge_type"))
    inside = last.join(members.toDF("source_id", "scc"), "source_id").join(members.toDF("target_id", "other"), "target_id").where("scc = other")
    types = inside.groupBy("scc").agg(F.array_sort(F.collect_set("edge_type")).alias("edge_types"))
    named = members.join(g.nodes.select("id", "name"), "id", "left").groupBy("scc").agg(F.count("*").alias("length"), F.array_sort(F.collect_list(F.struct("id", F.coalesce("name", "id").alias("name")))).alias("m"))
    return named.join(types, "scc").select("scc", "length", F.col("m.id").alias("node_ids"), F.col("m.name").alias("node_names"), "edge_types")


def name_score(name: str | Column = "name") -> Column:
    """Bonus of names that usually start a flow, letter case aside."""
    c = F.lower(name)
    return (
        F.when(c == "main", 3.0).when(c.isin("run", "start"), 2.0).when(c == "execute", 1.5).when(c.startswith("handle_"), 2.5).when(c.startswith("on_"), 2.0)
        .when(c.startswith("process_") | c.startswith("dispatch_"), 1.5).otherwise(0.0)
    )


def entry_scores(g: PropertyGraph) -> DataFrame:
    """id, name, callees, callers and score of functions and methods: callees less one and a half callers, and the bonus; 0 without callees."""
    calls = g.edges.where("edge_type = 'CALLS'")
    out = calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("callees"))
    into = calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))
    nodes = g.nodes.where(F.col("label").isin("Function", "Method")).select("id", "name")
    both = nodes.join(out, "id", "left").join(into, "id", "left").fillna(0, ["callees", "callers"])
    return both.withColumn("score", F.when(F.col("callees") == 0, 0.0).otherwise(F.col("callees") - 1.5 * F.col("callers") + name_score()))


def suggest_tests(g: PropertyGraph, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Functions of test files that reach each seed(seed, id) by calls: seed, file_path, name and least depth. Test files end a way."""
    calls = g.edges_by("target_id").where("edge_type = 'CALLS'").select("source_id", "target_id")
    nodes = g.nodes.select("id", "name", "file_path", is_test_file().alias("test"))
    seen = frontier = cut(seeds.select("seed", "id"))
    found = None
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = calls.join(frontier.withColumnRenamed("id", "target_id"), "target_id").select("seed", F.col("source_id").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti")
        there = cut(step.join(nodes, "id").withColumn("depth", F.lit(depth)))
        if there.isEmpty():
            break
        found = there if found is None else found.unionByName(there)
        seen = seen.unionByName(there.select("seed", "id"))
        frontier = there.where(~F.col("test")).select("seed", "id")
    found = found if found is not None else seeds.join(nodes, "id").withColumn("depth", F.lit(0)).limit(0)
    return found.where("test").groupBy("seed", "file_path", "name").agg(F.min("depth").alias("depth"))


def orphans(g: PropertyGraph) -> DataFrame:
    """Symbols outside test files, neither entry points nor the target of an edge that counts as a use."""
    used = g.edges.where(F.col("edge_type").isin(*USES)).select(F.col("target_id").alias("id"))
    entry = F.col("name").isin(*ENTRY_NAMES)
    for prefix in ENTRY_PREFIXES:
        entry = entry | F.col("name").startswith(prefix)
    symbols = g.nodes.where(F.col("label").isin("Function", "Method", "Class") & ~is_test_file() & ~F.coalesce(entry, F.lit(False)))
    return symbols.join(used, "id", "left_anti")
