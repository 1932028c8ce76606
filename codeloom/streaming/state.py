"""Changes of a stream's files against the version before, and the newest of them for each session, as keyed state."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from difflib import unified_diff

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events that a session keeps, and those that are shown, newest first.
KEPT, SHOWN = 500, 50
SYMBOLS = "array<struct<name:string,label:string,signature:string,source:string>>"
CHANGES = "file_path string, ts timestamp, event_type string, added array<string>, modified array<string>, removed array<string>, diffs map<string,string>"
SUMMARY = "session string, event_count int, files_changed int, added int, modified int, removed int, high_risk int, groups array<string>, newest array<string>"


def keyed_state(spark: SparkSession) -> None:
    """State of several values a key needs the store that keeps it on disk, outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shown_diff(before: str | None, after: str | None) -> str | None:
    """The unified difference of two sources; if one is missing or empty, the other. None if nothing differs."""
    if not (before and after):
        return before or after or None
    return "\n".join(unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), fromfile="before", tofile="after", lineterm="")) or None


class Versions(StatefulProcessor):
    """State: the symbols of a file's last version, by name and label."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "name string, label string", "signature string, source string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {(k[0], k[1]): (v[0], v[1]) for k, v in self.known.iterator()}
        first = dict(before)
        for r in sorted(rows, key=lambda r: r.ts):
            after = {} if r.event_type == "deleted" else {(s["name"], s["label"]): (s["signature"], s["source"]) for s in r.symbols or []}  # the last of a key counts
            added, removed = sorted(after.keys() - before.keys()), sorted(before.keys() - after.keys())
            modified = sorted(k for k in after.keys() & before.keys() if after[k][0] != before[k][0]) if r.event_type == "modified" else []
            diffs = [(k[0], shown_diff(before.get(k, (None, None))[1], after.get(k, (None, None))[1])) for k in [*modified, *added, *removed]]
            yield Row(
                file_path=key[0], ts=r.ts, event_type=r.event_type, added=[k[0] for k in added], modified=[k[0] for k in modified], removed=[k[0] for k in removed], diffs={name: text for name, text in diffs if text},
            )
            before = after
        for k in first.keys() - before.keys():
            self.known.removeKey(k)
        for k, v in before.items():
            if first.get(k) != v:
                self.known.updateValue(k, v)

    def close(self) -> None:
        pass


def version_stream(changes: DataFrame) -> DataFrame:
    """What each of a stream's changes(file_path, ts, event_type, symbols) did to its file: added, modified and removed names, sorted, and diffs by name.

    symbols are those of the file now (an array of name, label, signature, source; see SYMBOLS).
    Symbols are told apart by name and label; one counts as modified if its signature differs and
    the event's type is "modified". A file's first event adds all its symbols, a deletion removes
    all. Only what a version changes is written to the state.
    """
    keyed_state(changes.sparkSession)
    return changes.select("file_path", "ts", "event_type", "symbols").groupBy("file_path").transformWithState(Versions(), CHANGES, "Append", "None")


class Ring(StatefulProcessor):
    """State: the KEPT newest events of a session."""

    def __init__(self, kept: int = KEPT, shown: int = SHOWN):
        self.kept, self.shown = kept, shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [r[0] for r in self.events.get()]
        order = lambda e: (e["ts"], e["file_path"] or "")
        new = heapq.nlargest(self.kept, (json.loads(r.json) for r in rows), key=order)
        events = sorted([*map(json.loads, held), *new], key=order)[-self.kept :]
        self.events.put([(json.dumps(e),) for e in events])
        sizes = {c: sum(len(e.get(c) or []) for e in events) for c in ("added", "modified", "removed")}
        yield Row(
            session=key[0], event_count=len(events), files_changed=len({e["file_path"] for e in events}), **sizes, high_risk=sum(e.get("risk") in ("HIGH", "CRITICAL") for e in events),
            groups=sorted({g for e in events for g in e.get("groups") or []}), newest=[json.dumps(e, sort_keys=True) for e in events[: -self.shown - 1 : -1]],
        )

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, session: str = "session", kept: int = KEPT, shown: int = SHOWN) -> DataFrame:
    """After each batch that holds events(session, file_path, ts, added, modified, removed, risk, groups) of a session: a summary of its `kept` newest ones, and the `shown` newest as JSON.

    A session is what one viewer follows: a batch's events of it go to one task, which reads them
    one by one and holds no more than the ring does.
    """
    keyed_state(events.sparkSession)
    names = [c for c in ("file_path", "ts", "event_type", "added", "modified", "removed", "risk", "groups") if c in events.columns]
    rows = events.select(F.col(session).cast("string").alias("session"), F.to_json(F.struct(*(F.unix_micros("ts").alias("ts") if c == "ts" else c for c in names))).alias("json"))
    return rows.groupBy("session").transformWithState(Ring(kept, shown), SUMMARY, "Update", "None")
