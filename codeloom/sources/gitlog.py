"""History from the text of a log: header lines "COMMIT hash author date", each with its files' lines."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds that git may take for the list of commits or for one range of them.
PATIENCE = 10


def commits_of(logs: DataFrame, key: str, text: str, suffix: str = ".py") -> DataFrame:
    """key, hash, author, date and file of each changed file that ends with suffix; lines before the first header are left out."""
    lines = logs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    header = F.when(F.col("line").startswith("COMMIT "), F.split("line", " ", 4))
    at = F.last(header, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("h", at).where(F.col("line").endswith(suffix) & ~F.col("line").startswith("COMMIT ") & F.col("h").isNotNull())
    return rows.select(key, F.get("h", F.lit(1)).alias("hash"), F.get("h", F.lit(2)).alias("author"), F.get("h", F.lit(3)).alias("date"), F.trim("line").alias("file"))


class GitHistory(DataSource):
    """Format "gitlog": a row for each file that a commit of the last `days` days changed, under the folder `path`.

    A task reads `commitsPerTask` commits, by the hashes at the ends of its range, so that all tasks
    see one history even if commits are added meanwhile. The folder must be seen by the driver and
    the executors; without a repository, or where git fails or takes too long, there are no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "commit_idx string, author string, date timestamp, file string"

    def reader(self, schema) -> DataSourceReader:
        return CommitRanges(self.options["path"], int(self.options.get("days", "90")), int(self.options.get("commitsPerTask", "1000")), self.options.get("suffix", ".py"))


class CommitRanges(DataSourceReader):
    def __init__(self, root: str, days: int, size: int, suffix: str):
        self.root, self.days, self.size, self.suffix = root, days, size, suffix

    def said(self, *words: str) -> bytes:
        """What git prints about the folder; nothing if it fails."""
        try:
            return subprocess.run(["git", "-C", self.root, *words], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, timeout=PATIENCE, check=True).stdout
        except (OSError, subprocess.SubprocessError):
            return b""

    def partitions(self) -> list[InputPartition]:
        hashes = self.said("rev-list", f"--since={self.days} days ago", "HEAD").decode().split()
        return [InputPartition(hashes[i : i + self.size]) for i in range(0, len(hashes), self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Names come relative to the folder, those of other folders not at all; each ends in a zero byte, so that any name is told as it is."""
        if not partition or not partition.value:
            return
        ends = self.said("show", "--no-walk=unsorted", "-z", "--relative", "--name-only", "--format=%x01%H%x02%ae%x02%aI%x02", *partition.value, "--", ".")
        for commit in ends.split(b"\x01")[1:]:
            idx, author, date, names = commit.split(b"\x02", 3)
            for name in names.split(b"\0"):
                file = name.lstrip(b"\n").decode("utf-8", "surrogateescape")
                if file.endswith(self.suffix):
                    yield idx.decode(), author.decode("utf-8", "replace"), datetime.fromisoformat(date.decode()), f"{self.root.rstrip('/')}/{file.encode('utf-8', 'surrogateescape').decode('utf-8', 'replace')}"


def read_log(spark: SparkSession, root: str, days: int = 90, commits_per_task: int = 1000) -> DataFrame:
    """commit_idx, author, date and file (a path under root) of the last days of a repository; no rows without one."""
    spark.dataSource.register(GitHistory)
    return spark.read.format("gitlog").option("path", root).option("days", days).option("commitsPerTask", commits_per_task).load()
