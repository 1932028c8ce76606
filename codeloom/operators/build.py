"""A property graph from parsed sources: nodes, imports, inferred types and calls, all as joins on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.operators.resolve import arity_fits, named_edges, ownership_edges, resolve_imports, resolve_names
from codeloom.plans.fixpoint import cut

MODULE = "<module>"
#: The confidence of a type that is declared, and of one that a constructor's call shows.
DECLARED, CONSTRUCTED = 0.95, 0.9
NODE_COLUMNS = {
    "start_line": "int", "end_line": "int", "parameter_count": "int", "return_type": "string", "declared_type": "string", "is_async": "boolean", "docstring": "string", "owner": "string", "cc": "int",
    "parameters": "array<string>", "decorators": "array<string>", "bases": "array<string>",
}


def digest(*parts: Column | str, size: int = 16) -> Column:
    """The first hexadecimal digits of the parts' checksum; strings stand for themselves."""
    return F.substring(F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, size)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), digest(path, size=8))


def unnested(facts: DataFrame, kind: str) -> DataFrame:
    """file_path, pos and the fields of each fact of a kind."""
    return facts.select("file_path", F.posexplode(kind).alias("pos", "x")).select("file_path", "pos", "x.*")


def nodes_of(facts: DataFrame) -> DataFrame:
    """Files, functions, methods, classes and typed variables of parsed files, in the order of path, kind and place (ordinal).

    A variable is kept if its type is declared or shown by a call; of several nodes with one id the last stays.
    """
    path, line = F.col("file_path"), F.col("line")

    def rows(df: DataFrame, kind: int, label: Column | str, node_id: Column, **given) -> DataFrame:
        columns = [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in NODE_COLUMNS.items()]
        name = given["name"] if "name" in given else F.col("name")
        return df.select(F.lit(kind).alias("kind"), F.col("pos").cast("int").alias("pos"), node_id.alias("id"), (F.lit(label) if isinstance(label, str) else label).alias("label"), name.alias("name"), "file_path", *columns)

    files = rows(facts.withColumn("pos", F.lit(0)), 0, "File", file_id(path), name=F.element_at(F.split(path, "/"), -1))
    functions = rows(
        unnested(facts, "functions"), 1, F.when(F.col("is_method"), "Method").otherwise("Function"), digest("fn:", path, ":", F.col("name"), ":", line), start_line=line, end_line=F.col("end_line"), parameter_count=F.size("parameters"),
        return_type=F.col("returns"), is_async=F.col("is_async"), docstring=F.col("docstring"), owner=F.col("owner"), cc=F.col("cc"), parameters=F.col("parameters"), decorators=F.col("decorators"),
    )
    classes = rows(unnested(facts, "classes"), 2, "Class", digest("cls:", path, ":", F.col("name"), ":", line), start_line=line, end_line=F.col("end_line"), docstring=F.col("docstring"), decorators=F.col("decorators"), bases=F.col("bases"))
    typed = unnested(facts, "assignments").withColumn("type", F.coalesce("declared_type", "value_type")).where("type IS NOT NULL")
    variables = rows(typed, 3, "Variable", digest("var:", F.col("name"), ":", path, ":", line), start_line=line, declared_type=F.col("type"))
    every = files.unionByName(functions).unionByName(classes).unionByName(variables)
    last = every.groupBy("id").agg(F.max_by(F.struct(*every.columns), F.struct("kind", "pos")).alias("x")).select("x.*")
    return numbered(last.withColumn("place", F.shiftleft(F.col("kind").cast("long"), 32) + F.col("pos")).drop("kind", "pos"))


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes with their ordinal: the order of path and of the place in the file (by kind, then position)."""
    return nodes.drop("ordinal").orderBy("file_path", "place").withColumn("ordinal", F.monotonically_increasing_id())


def import_bindings(facts: DataFrame, root: str, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """named(file_path, name, target_path): the last binding of a name; imported(file_path, target_path): files imported whole; edges between files, once each. Files are looked for among those of whole (facts, if none)."""
    imports = cut(unnested(facts, "imports"))
    found = resolve_imports(imports, (facts if whole is None else whole).select("file_path"), root).where("target_path IS NOT NULL")
    key = ["file_path", "module", "level"]
    resolved = cut(imports.withColumn("module", F.coalesce("module", F.lit(""))).join(found, key))
    names = resolved.where(F.col("is_from") & (F.size("names") > 0)).select("file_path", "target_path", "line", "pos", F.posexplode("names").alias("k", "name"))
    named = names.groupBy("file_path", "name").agg(F.max_by("target_path", F.struct("pos", "k")).alias("target_path"))
    imported = resolved.where(~F.col("is_from") | (F.size("names") == 0)).select("file_path", "target_path").distinct()
    ends = resolved.select(file_id(F.col("file_path")).alias("source_id"), file_id(F.col("target_path")).alias("target_id")).distinct()
    return named, imported, ends.select("source_id", "target_id", F.lit("IMPORTS").alias("edge_type"), F.lit(1.0).alias("confidence"))


def type_bindings(facts: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """file_path, scope, variable, type, confidence and first of each variable's last binding; first is the place of its first one.

    All assignments of a file count for its module: a declared type, else the class that is
    called. Annotated parameters count under their function's name, and in __init__ what is
    assigned from a class counts as an attribute of the owner's self. Classes are those of whole
    (facts, if none).
    """
    assigned = unnested(facts, "assignments")
    functions = unnested(facts, "functions")
    classes = unnested(facts if whole is None else whole, "classes").select(F.col("name").alias("value_type")).distinct()
    made = assigned.join(classes, "value_type", "left_semi")
    columns = ["file_path", "scope", "variable", "type", "confidence", "at"]
    declared = assigned.where("declared_type IS NOT NULL AND declared_type <> ''")
    module = declared.select("file_path", F.lit(MODULE).alias("scope"), F.col("name").alias("variable"), F.col("declared_type").alias("type"), F.lit(DECLARED).alias("confidence"), F.struct(F.lit(-1).alias("f"), F.lit(0).alias("k"), "pos").alias("at"))
    shown = made.where("declared_type IS NULL OR declared_type = ''").select("file_path", F.lit(MODULE).alias("scope"), F.col("name").alias("variable"), F.col("value_type").alias("type"), F.lit(CONSTRUCTED).alias("confidence"), F.struct(F.lit(-1).alias("f"), F.lit(0).alias("k"), "pos").alias("at"))
    given = functions.select("file_path", F.col("name").alias("scope"), F.col("pos").alias("f"), F.posexplode(F.arrays_zip("parameters", "parameter_types")).alias("pos", "p")).where("p.parameter_types <> '' AND p.parameters NOT IN ('self', 'cls')")
    given = given.select("file_path", "scope", F.col("p.parameters").alias("variable"), F.col("p.parameter_types").alias("type"), F.lit(DECLARED).alias("confidence"), F.struct("f", F.lit(0).alias("k"), "pos").alias("at"))
    inits = functions.where("name = '__init__' AND owner IS NOT NULL").select("file_path", F.col("owner").alias("scope"), F.col("pos").alias("f"), F.col("line").alias("low"), F.col("end_line").alias("high"))
    own = made.join(inits, "file_path").where("line BETWEEN low AND high").select("file_path", "scope", F.concat(F.lit("self."), "name").alias("variable"), F.col("value_type").alias("type"), F.lit(CONSTRUCTED).alias("confidence"), F.struct("f", F.lit(1).alias("k"), "pos").alias("at"))
    every = module.select(columns).unionByName(shown.select(columns)).unionByName(given.select(columns)).unionByName(own.select(columns))
    last = F.max_by(F.struct("type", "confidence"), "at").alias("b")
    return every.groupBy("file_path", "scope", "variable").agg(last, F.min("at").alias("first")).select("file_path", "scope", "variable", "b.type", "b.confidence", "first")


def class_bases(facts: DataFrame) -> DataFrame:
    """name and base (its last part) of the classes that have one."""
    return unnested(facts, "classes").select("name", F.explode("bases").alias("b")).select("name", F.element_at(F.split("b", r"\."), -1).alias("base")).distinct()


def ancestors(facts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """name and ancestor: each class name (of those in of(name), if given), itself, and the names of all classes above it; classes of one name count as one."""
    bases = cut(class_bases(facts))
    known = unnested(facts, "classes").select("name").distinct()
    known = known if of is None else known.join(of, "name", "left_semi")
    found = reached = cut(known.select("name", F.col("name").alias("ancestor")))
    while not reached.isEmpty():
        up = reached.join(bases.withColumnRenamed("name", "ancestor"), "ancestor").select("name", F.col("base").alias("ancestor")).distinct()
        reached = cut(up.join(found, ["name", "ancestor"], "left_anti"))
        found = cut(found.unionByName(reached))
    return found


def receiver_types(calls: DataFrame, types: DataFrame) -> DataFrame:
    """calls, and type: of self the caller's class; of self's attribute its first binding in the file; of a variable its binding in the caller's scope, else the module's."""
    attributes = types.where("variable LIKE 'self.%'").groupBy("file_path", F.col("variable").alias("receiver")).agg(F.min_by("type", "first").alias("of_self"))
    plain = types.select("file_path", "scope", F.col("variable").alias("receiver"), F.col("type").alias("of_scope"))
    module = plain.where(F.col("scope") == MODULE).drop("scope").withColumnRenamed("of_scope", "of_module")
    scoped = calls.withColumn("scope", F.coalesce("caller_class", "caller", F.lit(MODULE)))
    joined = scoped.join(attributes, ["file_path", "receiver"], "left").join(plain, ["file_path", "scope", "receiver"], "left").join(module, ["file_path", "receiver"], "left")
    kind = F.when((F.col("receiver") == "self") & F.col("caller_class").isNotNull(), F.col("caller_class")).when(F.col("receiver").startswith("self."), F.col("of_self")).otherwise(F.coalesce("of_scope", "of_module"))
    return joined.withColumn("type", kind).drop("scope", "of_self", "of_scope", "of_module")


def call_edges(facts: DataFrame, nodes: DataFrame, owned: DataFrame, named: DataFrame, imported: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """source_id, target_id, line, confidence and reason of all calls.

    A call on a receiver of known type leads to the methods of that name on its class and those
    above; if none of them takes the arguments, or the type isn't known, names are resolved as
    elsewhere (see resolve_names). Calls outside functions have no edge; of equal edges the first stays.
    nodes and owned are those of all files, and so is whole (facts, if none).
    """
    whole = facts if whole is None else whole
    code = nodes.where(F.col("label").isin("Function", "Method"))
    callers = code.groupBy("file_path", F.col("name").alias("caller")).agg(F.max_by("id", "ordinal").alias("source_id"))
    calls = cut(unnested(facts, "calls").where("caller IS NOT NULL").join(callers, ["file_path", "caller"]))
    symbols = nodes.where(F.col("label").isin("Function", "Method", "Class"))
    arity = symbols.select(F.col("id").alias("target_id"), "parameter_count")
    methods = owned.where("edge_type = 'HAS_METHOD'").select("source_id", "target_id").join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("ancestor")), "source_id").drop("source_id")
    methods = methods.join(nodes.select(F.col("id").alias("target_id"), F.col("name").alias("callee"), "parameter_count"), "target_id")
    typed = receiver_types(calls.where("is_attribute AND receiver IS NOT NULL"), type_bindings(facts, whole)).where("type IS NOT NULL")
    typed = cut(typed)
    above = ancestors(whole, typed.select(F.col("type").alias("name")).distinct()).withColumnRenamed("name", "type")
    hits = typed.join(above, "type").join(methods, ["ancestor", "callee"]).where(arity_fits("parameter_count", "arg_count"))
    key = ["file_path", "pos"]
    first = cut(hits.select(*key, "source_id", "target_id", "line", F.lit(0.95).alias("confidence"), F.lit("type-inferred resolution").alias("reason")).distinct())
    rest = calls.join(first.select(*key).distinct(), key, "left_anti").withColumnRenamed("callee", "name")
    found = resolve_names(rest, symbols, named, imported).withColumnRenamed("id", "target_id")
    other = rest.join(found, ["file_path", "name"]).join(arity, "target_id").where(arity_fits("parameter_count", "arg_count"))
    every = first.unionByName(other.select(*key, "source_id", "target_id", "line", "confidence", F.concat("tier", F.lit(" resolution")).alias("reason")))
    best = F.min_by(F.struct("confidence", "reason"), "pos").alias("b")
    return every.groupBy("source_id", "target_id", "line").agg(best).select("source_id", "target_id", "line", "b.confidence", "b.reason")


def owned_edges(nodes: DataFrame) -> DataFrame:
    """The edges of containment, without ids."""
    return ownership_edges(nodes).withColumn("confidence", F.when(F.col("edge_type") == "CONTAINS", 1.0).otherwise(0.95))


def edges_of(facts: DataFrame, nodes: DataFrame, root: str, whole: DataFrame | None = None) -> DataFrame:
    """The edges that come from the files of facts, among the nodes of all files: containment, heritage, decoration, imports and calls.

    whole are the facts of all files (facts itself, if none).
    """
    mine = nodes if whole is None else nodes.join(facts.select("file_path").distinct(), "file_path", "left_semi")
    named, imported, imports = import_bindings(facts, root, whole)
    owned = owned_edges(mine)
    extends = named_edges(mine.where("label = 'Class'").select("id", F.explode("bases").alias("text")), nodes, "EXTENDS", ("Class",)).withColumn("confidence", F.lit(0.85))
    used = named_edges(mine.where("label IN ('Function', 'Method', 'Class')").select("id", F.explode("decorators").alias("text")), nodes, "DECORATES", ("Function", "Class"))
    decorates = used.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type", F.lit(0.8).alias("confidence"))  # from the decorator to what it decorates
    plain = owned.unionByName(extends).unionByName(decorates).unionByName(imports).distinct()
    plain = plain.select(digest(F.col("source_id"), "-", F.col("edge_type"), "->", F.col("target_id")).alias("id"), "source_id", "target_id", "edge_type", "confidence", F.lit("").alias("reason"), F.lit(0).alias("line"))
    calls = call_edges(facts, nodes, owned if whole is None else owned_edges(nodes), named, imported, whole)
    calls = calls.select(digest(F.col("source_id"), "->", F.col("target_id"), "@", F.col("line")).alias("id"), "source_id", "target_id", F.lit("CALLS").alias("edge_type"), "confidence", "reason", "line")
    return plain.unionByName(calls)


def build_graph(facts: DataFrame, root: str) -> PropertyGraph:
    """The graph of facts that pysource.parse gives: nodes, and edges of containment, heritage, decoration, imports and calls."""
    facts = cut(facts)
    nodes = cut(nodes_of(facts))
    return PropertyGraph(nodes, cut(edges_of(facts, nodes, root)))


def local_types(facts: DataFrame) -> DataFrame:
    """file_path and types (name to type) of each file by itself: annotations, then constructors of its own classes or of imported names with a capital, which take precedence."""
    assigned = unnested(facts, "assignments")
    own = unnested(facts, "classes").select("file_path", F.col("name").alias("value_type"))
    brought = unnested(facts, "imports").where("is_from").select("file_path", F.explode("names").alias("value_type")).where(F.col("value_type").rlike("^[A-Z]"))
    made = assigned.join(own.unionByName(brought).distinct(), ["file_path", "value_type"], "left_semi").select("file_path", "name", F.col("value_type").alias("type"), F.lit(1).alias("k"), "pos")
    noted = assigned.where("declared_type <> ''").select("file_path", "name", F.col("declared_type").alias("type"), F.lit(0).alias("k"), "pos")
    last = noted.unionByName(made).groupBy("file_path", "name").agg(F.max_by("type", F.struct("k", "pos")).alias("type"))
    return last.groupBy("file_path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "type")))).alias("types"))
