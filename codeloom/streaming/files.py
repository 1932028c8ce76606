"""Changes of files as a stream, and the graph kept up with them file by file."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from difflib import unified_diff

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import PySparkNotImplementedError
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StringType

from codeloom.graph import PropertyGraph
from codeloom.operators.build import build_graph
from codeloom.operators.traverse import impact, risk
from codeloom.sources.pysource import parse, source_files
from codeloom.streaming.changes import debounce

RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


#: Differences between listings that a task gets, and entries of the log before it is made one listing again.
TASK_ROWS, COMPACT = 1000, 50


def stamps(folder: str, names: list[str]) -> dict[str, str]:
    """The files of a folder with a stamp of size and time."""
    found = {}
    for name in names:
        path = os.path.join(folder, name)
        try:
            at = os.stat(path)
        except OSError:  # gone since
            continue
        found[path] = f"{at.st_mtime_ns}/{at.st_size}"
    return found


def listing(root: str, suffix: str = ".py", threads: int = 1) -> dict[str, str]:
    """The files under a folder that a build reads, with their stamps; folders are looked at side by side."""
    with ThreadPoolExecutor(threads) as pool:
        return {k: v for part in pool.map(lambda x: stamps(*x), source_files(root, suffix)) for k, v in part.items()}


def events_between(before: dict[str, str], after: dict[str, str]) -> Iterator[tuple[str, str]]:
    """(file_path, event_type): what lies between two listings. A moved file is deleted and created."""
    for path in sorted(before.keys() | after.keys()):
        if before.get(path) != after.get(path):
            yield path, "created" if path not in before else "deleted" if path not in after else "modified"


class FileEvents(DataSource):
    """A stream of the changes of the source files in a folder that the driver sees.

    With the option log, a folder for the log of changes, an offset is a number in this log (see
    LoggedReader); without it, an offset is a listing. Both can be read again after a failure.
    """

    @classmethod
    def name(cls) -> str:
        return "fileevents"

    def schema(self) -> str:
        return "file_path string, event_type string, ts timestamp" if "log" in self.options else "file_path string, event_type string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        if "log" not in self.options:
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader"})
        return LoggedReader(self.options["path"], self.options.get("suffix", ".py"), self.options["log"], int(self.options.get("quietms", "300")))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FileEventReader(self.options["path"], self.options.get("suffix", ".py"))


class ChangeLog:
    """A folder of numbered entries, each the differences between two listings, and of whole listings from time to time.

    Entry n is written before n is an offset, by a rename, so that what is there is whole. The
    entries up to a whole listing go once the stream is past it.
    """

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")
        os.makedirs(self.folder, exist_ok=True)

    def numbers(self, kind: str) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in os.listdir(self.folder) if n.endswith(f".{kind}"))

    def _path(self, n: int, kind: str) -> str:
        return os.path.join(self.folder, f"{n:012d}.{kind}")

    def write(self, n: int, kind: str, rows: list) -> None:
        path = self._path(n, kind)
        with open(f"{path}.part", "w", encoding="utf-8", errors="surrogateescape") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.replace(f"{path}.part", path)

    def rows(self, n: int, kind: str = "log") -> list:
        with open(self._path(n, kind), encoding="utf-8", errors="surrogateescape") as f:
            return [json.loads(line) for line in f]

    def last(self) -> tuple[int, dict[str, str]]:
        """The number of the last entry and the listing after it; (-1, nothing) for an empty log."""
        whole = self.numbers("all")
        if not whole:
            return -1, {}
        files = {path: stamp for path, stamp in self.rows(whole[-1], "all")}
        n = whole[-1]
        for n in (k for k in self.numbers("log") if k > whole[-1]):
            for path, kind, stamp, _ in self.rows(n):
                if kind == "deleted":
                    files.pop(path, None)
                elif path is not None:
                    files[path] = stamp
        return n, files

    def forget(self, n: int) -> None:
        """Drop what lies before the last whole listing at or below n."""
        keep = max((k for k in self.numbers("all") if k <= n), default=None)
        for kind, bound in (("log", keep), ("all", None if keep is None else keep - 1)):
            for k in self.numbers(kind) if keep is not None else []:
                if k <= bound:
                    os.remove(self._path(k, kind))


class LoggedReader(DataSourceStreamReader):
    """Offsets are numbers of a ChangeLog. The driver lists the folder, in threads, and hands tasks the differences, TASK_ROWS each.

    An entry's time is later than that of the one before, but while changes go on by half of
    quiet_ms at most, however long a batch takes: what two listings in turn find of a file is one
    burst. Once a listing finds no change quiet_ms after the last that did, one entry without a
    file follows, later by more than that, so that a watermark passes the last change.
    """

    def __init__(self, root: str, suffix: str, log: str, quiet_ms: int):
        self.root, self.suffix, self.quiet_ms = root, suffix, quiet_ms
        self.log, self.n, self.files, self.at, self.open, self.found = ChangeLog(log), None, {}, 0, False, 0

    def _resume(self) -> None:
        if self.n is None:
            self.n, self.files = self.log.last()
            if self.n < 0:
                self.n, self.files = 0, listing(self.root, self.suffix, 8)
                self.log.write(0, "all", list(self.files.items()))
            last = self.log.rows(self.n) if self.n in self.log.numbers("log") else []
            self.at, self.open = max((r[3] for r in last), default=0), any(r[1] != "quiet" for r in last)
            self.found = time.time_ns() // 1_000_000

    def initialOffset(self) -> dict:
        self._resume()
        return {"n": self.n}

    def latestOffset(self) -> dict:
        self._resume()
        now, clock = listing(self.root, self.suffix, 8), time.time_ns() // 1_000_000
        events = list(events_between(self.files, now))
        ms = self.at + max(1, min(clock - self.at, self.quiet_ms // 2)) if self.open and events else max(self.at + 1, clock)
        rows = [(path, kind, now.get(path), ms) for path, kind in events]
        if rows:
            self.open, self.found = True, clock
        elif self.open and clock >= self.found + self.quiet_ms:
            ms, self.open = max(self.at + self.quiet_ms + 1, clock), False
            rows = [(None, "quiet", None, ms)]
        if rows:
            self.log.write(self.n + 1, "log", rows)
            self.n, self.files, self.at = self.n + 1, now, ms
            if self.n % COMPACT == 0:
                self.log.write(self.n, "all", list(now.items()))
        return {"n": self.n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = [r for n in range(start["n"] + 1, end["n"] + 1) for r in self.log.rows(n)]
        return [InputPartition(rows[i : i + TASK_ROWS]) for i in range(0, len(rows), TASK_ROWS)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from datetime import datetime, timezone

        for path, kind, _, ms in partition.value:
            yield path, kind, datetime.fromtimestamp(ms / 1000, timezone.utc)

    def commit(self, end: dict) -> None:
        self.log.forget(end["n"])


class FileEventReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def initialOffset(self) -> dict:
        return {"files": json.dumps(listing(self.root, self.suffix))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = listing(self.root, self.suffix)
        rows = list(events_between(json.loads(start["files"]), now))
        return iter(rows), {"files": json.dumps(now)} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return events_between(json.loads(start["files"]), json.loads(end["files"]))


def file_events(spark: SparkSession, root: str, log: str, gap_ms: int = 300) -> DataFrame:
    """ts, file_path and event_type of a stream of changes, whose log is kept in a folder; one of type quiet, without a file, says that gap_ms passed without a change."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("fileevents").option("path", root).option("log", log).option("quietms", gap_ms).load().select("ts", "file_path", "event_type")


@F.pandas_udf(StringType())
def diff_text(before: pd.Series, after: pd.Series) -> pd.Series:
    """What to show of a changed symbol: the unified difference of two sources; if one is missing or empty, the other. Null if nothing differs."""

    def show(a: str | None, b: str | None) -> str | None:
        if not (a and b):
            return b or a or None
        lines = unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), fromfile="before", tofile="after", lineterm="")
        return "\n".join(lines) or None

    return pd.Series([show(a, b) for a, b in zip(before, after)], dtype=object)


def last_folders(path: str = "file_path") -> Column:
    """The last two parts of a path; null for a path of one part."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/"))


def event_impact(g: PropertyGraph, changed: DataFrame, max_depth: int = 2) -> DataFrame:
    """event, risk, affected and groups of changed(event, id): over its nodes, the greatest risk and number of nodes within reach upstream, and all folders reached.

    All events and nodes go together, a seed for each; a node that the graph lacks affects nothing.
    """
    pairs = changed.select("event", "id").distinct()
    seeds = pairs.select("id").distinct().join(g.nodes.select("id"), "id", "left_semi").select(F.col("id").alias("seed"), "id")
    found = impact(g, seeds, "upstream", max_depth)
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    by_seed = risk(found).select(F.col("seed").alias("id"), "total", rank.alias("rank"))
    reached = found.select(F.col("seed").alias("id"), last_folders().alias("folder")).where("folder IS NOT NULL").distinct()
    worst = pairs.join(by_seed, "id", "left").groupBy("event").agg(F.coalesce(F.max("total"), F.lit(0)).alias("affected"), F.coalesce(F.max("rank"), F.lit(1)).cast("int").alias("rank"))
    folders = pairs.join(reached, "id").groupBy("event").agg(F.array_sort(F.collect_set("folder")).alias("groups"))
    named = F.element_at(F.array(*map(F.lit, RISKS)), F.col("rank")).alias("risk")
    return worst.join(folders, "event", "left").select("event", named, "affected", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"))


def sources_after(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """sources(file_path, source) with those of changed(file_path, event_type, source) in their place; deleted ones go."""
    return sources.join(changed.select("file_path"), "file_path", "left_anti").unionByName(changed.where("event_type <> 'deleted'").select("file_path", "source"))


def refreshed(g: PropertyGraph, sources: DataFrame, paths: DataFrame, root: str) -> PropertyGraph:
    """g with the nodes and outgoing edges of the files paths(file_path) built anew from sources(file_path, source), all of the folder as it is now.

    Edges into the files from others stay as long as their target is still there. Names are resolved
    over all sources, as a whole build resolves them.
    """
    whole = build_graph(parse(sources), root)
    mine = whole.nodes.join(paths, "file_path", "left_semi")
    old = g.nodes.join(paths, "file_path", "left_semi").select("id")
    nodes = g.nodes.join(paths, "file_path", "left_anti").unionByName(mine, allowMissingColumns=True)
    gone = old.join(mine.select("id"), "id", "left_anti")
    kept = g.edges.join(old.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    fresh = whole.edges.join(mine.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    lacking = fresh.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(F.col("target_id").alias("id")).distinct()
    added = whole.nodes.join(lacking, "id", "left_semi")
    return PropertyGraph(nodes.unionByName(added, allowMissingColumns=True), kept.unionByName(fresh.select(*kept.columns), allowMissingColumns=True))


def to_listeners(*listeners: Callable[[DataFrame, int], None], failed: list | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that gives each batch to all listeners; one that fails keeps no other from it, and its error goes to the list."""

    def give(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for listener in listeners:
                try:
                    listener(rows, number)
                except Exception as error:  # noqa: BLE001  (a listener's own affair)
                    if failed is not None:
                        failed.append((number, error))
        finally:
            rows.unpersist()

    return give


def settled(events: DataFrame, gap_ms: int = 300) -> DataFrame:
    """A stream's events(ts, file_path, event_type), one for each file and burst: the latest, but a deletion stays.

    A burst ends once the stream's time passes its last event by the gap, however many batches it
    came in: the sessions are Spark's state, keyed by file, and each event puts the end off. Events
    of type quiet only move the time on; they are left out last, as a condition on the file would
    be pushed below the watermark.
    """
    return debounce(events, f"{gap_ms} milliseconds", "0 seconds").where("event_type <> 'quiet'")


def watch(spark: SparkSession, root: str, checkpoint: str, *listeners: Callable[[DataFrame, int], None], failed: list | None = None, gap_ms: int = 300, **trigger):
    """A started stream of a folder's changes, settled (see there); the log of changes lies in the checkpoint folder."""
    give = to_listeners(*listeners, failed=failed)
    events = file_events(spark, root, os.path.join(checkpoint.removeprefix("file://"), "changes"), gap_ms)
    writer = settled(events, gap_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(give).start()
