"""Tasks that depend on each other, their calendar, and a store of JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.fixpoint import cut

#: A task's share of a person's load by its priority, the greatest load and number of assignments, and days overdue after which a priority is raised.
SLICES = {1: 1, 2: 2, 3: 3, 4: 4}
MOST, RAISED_AFTER = 5, 2
LAST_DAY = "9999-12-31"


def dependencies(links: DataFrame, start: str, to: DataFrame | None = None) -> DataFrame:
    """id and least depth of all that a task needs, by links(task, needs); the task itself only if it needs itself.

    Null ends lead nowhere. With to(id), rounds stop once one of these is met.
    """
    links = links.where("task IS NOT NULL AND needs IS NOT NULL").select("task", "needs").distinct()
    found = frontier = cut(links.where(F.col("task") == start).select(F.col("needs").alias("id"), F.lit(1).alias("depth")))
    depth = 1
    while not frontier.isEmpty() and (to is None or frontier.join(to, "id", "left_semi").isEmpty()):
        depth += 1
        step = links.join(frontier.select(F.col("id").alias("task")), "task").select(F.col("needs").alias("id")).distinct()
        frontier = cut(step.join(found, "id", "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(frontier)
    return found


def makes_cycle(links: DataFrame, task: str, needs: str) -> bool:
    """Whether a new link from task to needs would close a cycle."""
    if task == needs:
        return True
    target = links.sparkSession.createDataFrame([(task,)], "id string")
    return not dependencies(links, needs, target).join(target, "id", "left_semi").isEmpty()


def blocked_by(tasks: DataFrame, links: DataFrame, done: str = "done") -> DataFrame:
    """task and needs of each link to a known task that isn't done."""
    left = tasks.where(~F.coalesce(F.col("status") == done, F.lit(False))).select(F.col("id").alias("needs"))
    return links.join(left, "needs", "left_semi").select("task", "needs")


def schedule(tasks: DataFrame, links: DataFrame, users: list[str], as_of: Column) -> list[tuple[str, str]]:
    """(task, user) of the next tasks: the highest priorities first, then the earliest due, each to the person of least load.

    tasks(id, status, priority, due, assignee, tags, ordinal): pending ones, and blocked ones after
    them, neither waiting for a task that isn't done. Someone with room who has the task, or a tag
    skill:NAME on it, comes first. No more than MOST tasks are given out, and a task is passed over
    only once nobody has room, so the first MOST rows decide; loads come from one grouped sum.
    """
    if not users:
        return []
    waiting = blocked_by(tasks, links).select(F.col("task").alias("id")).distinct()
    open_tasks = tasks.where(F.col("status").isin("pending", "blocked")).join(waiting, "id", "left_anti")
    due = F.coalesce("due", F.to_timestamp(F.lit(LAST_DAY)))
    first = open_tasks.orderBy(F.desc("priority"), due, F.col("status") == "blocked", "ordinal").limit(MOST)
    late = F.coalesce(as_of > F.col("due"), F.lit(False))
    very_late = F.coalesce(as_of.cast("double") - F.col("due").cast("double") > (RAISED_AFTER - 1) * 86400, F.lit(False))
    raised = F.when(late & (F.col("priority") == 1), 2).otherwise(F.col("priority"))
    raised = F.when(very_late & (raised < 3), 3).otherwise(raised)
    share = F.create_map(*[F.lit(x) for kv in SLICES.items() for x in kv])
    busy = tasks.where((F.col("status") == "in_progress") & F.col("assignee").isin(*users)).groupBy("assignee").agg(F.sum(F.coalesce(share[F.col("priority")], F.lit(1))).alias("load"))
    load = dict.fromkeys(users, 0) | {r.assignee: r.load for r in busy.collect()}  # a row a user given
    given = []
    for task in first.select("id", "assignee", "tags", raised.alias("priority")).collect():  # MOST rows
        free = [u for u in load if load[u] < MOST]
        if not free:
            break
        # users are met in turn: one with a skill ends the search even if an earlier one has less load
        skilled = next((u for u in free if f"skill:{u}" in (task.tags or [])), None)
        user = task.assignee if task.assignee in free else skilled or min(free, key=load.get)
        load[user] += SLICES.get(task.priority, 1)
        given.append((task.id, user))
    return given


def is_weekend(day: str | Column) -> Column:
    return F.weekday(day) >= 5


def next_business_day(day: str | Column) -> Column:
    """The first weekday after a time, at the same hour."""
    at = F.col(day) if isinstance(day, str) else day
    ahead = F.when(F.weekday(at) == 4, 3).when(F.weekday(at) == 5, 2).otherwise(1)
    return at + F.make_dt_interval(ahead)


def business_days(start: str | Column, end: str | Column) -> Column:
    """Weekdays among the times one, two and more whole days after start, up to end: whole weeks have five, and the days left are looked at."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    days = F.greatest(F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400_000_000), F.lit(0))
    left = days % 7
    taken = F.size(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: (i <= left) & ((F.weekday(a) + i) % 7 < 5)))
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.floor(days / 7) * 5 + taken)


class JsonStore:
    """Records by collection and id, as JSON lines in a folder that the driver and the executors share.

    A change adds a line with the next version; the last version of an id counts. One writer at a time.
    """

    SCHEMA = "id string, record string, gone boolean, version long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, collection: str) -> str:
        return f"{self.root}/{collection}"

    def exists(self, collection: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(collection))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def versions(self, collection: str) -> DataFrame:
        if not self.exists(collection):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(self.path(collection))

    def all(self, collection: str) -> DataFrame:
        """id and record (JSON text) of what is there."""
        last = self.versions(collection).groupBy("id").agg(F.max_by(F.struct("record", "gone"), "version").alias("x"))
        return last.where("NOT x.gone").select("id", "x.record")

    def save(self, collection: str, records: DataFrame) -> None:
        """Records(id, record) take the place of those of the same ids; ids are unique."""
        self.add(collection, records.select("id", "record", F.lit(False).alias("gone")))

    def delete(self, collection: str, record_id: str) -> bool:
        """Whether there was such a record."""
        if self.load(collection, record_id) is None:
            return False
        self.add(collection, self.spark.createDataFrame([(record_id, None, True)], "id string, record string, gone boolean"))
        return True

    def add(self, collection: str, rows: DataFrame) -> None:
        last = self.versions(collection).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).head().v
        rows.withColumn("version", F.lit(last + 1)).write.mode("append").json(self.path(collection))

    def load(self, collection: str, record_id: str) -> str | None:
        row = self.all(collection).where(F.col("id") == record_id).head()
        return row.record if row else None

    def count(self, collection: str) -> int:
        return self.all(collection).count()

    def clear(self, collection: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(collection))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
