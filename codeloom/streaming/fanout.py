"""Frames of a stream handed to many clients, each at its own pace within bounds."""

from __future__ import annotations

import json
import os
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.views import sse_frame

#: Frames that a client may be behind.
QUEUE = 100


class FanOut:
    """A sink for foreachBatch. A client has a position in the stream's frames and reads on from it; one that a batch leaves more than `queue` frames behind is dropped.

    So no more than the newest `queue` frames are ever needed: of a batch, only its number of rows
    and these come to the driver. Positions and frames are kept in a file of the folder, written
    whole before a batch counts as done; a batch that comes again after a failure is passed over.
    """

    def __init__(self, folder: str, queue: int = QUEUE, event: str = "change", order: tuple[str, ...] = ("ts",)):
        self.path, self.queue, self.event, self.order = os.path.join(folder.removeprefix("file://"), "fanout.json"), queue, event, order
        self.lock = threading.Lock()
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        self.state = {"batch": -1, "total": 0, "frames": [], "clients": {}}
        if os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                self.state = json.load(f)

    def _save(self) -> None:
        with open(f"{self.path}.part", "w", encoding="utf-8") as f:
            json.dump(self.state, f)
        os.replace(f"{self.path}.part", self.path)

    def add_client(self, name: str) -> None:
        """A client that gets the frames from now on; one that is known starts anew."""
        with self.lock:
            self.state["clients"][name] = self.state["total"]
            self._save()

    def remove_client(self, name: str) -> None:
        with self.lock:
            self.state["clients"].pop(name, None)
            self._save()

    @property
    def clients(self) -> list[str]:
        with self.lock:
            return sorted(self.state["clients"])

    def push(self, batch: DataFrame, number: int) -> None:
        """Take in a batch's rows as frames, in the order of the columns `order`."""
        if number <= self.state["batch"]:
            return
        rows = batch.select(*self.order, sse_frame(self.event, F.struct(*batch.columns)).alias("frame"))
        n = rows.count()
        newest = [r.frame for r in rows.orderBy(*(F.desc(c) for c in self.order)).limit(self.queue).collect()][::-1]
        with self.lock:
            s = self.state
            total = s["total"] + n
            s |= {"batch": number, "total": total, "frames": [*s["frames"], *newest][-self.queue :], "clients": {k: p for k, p in s["clients"].items() if total - p <= self.queue}}
            self._save()

    __call__ = push

    def read(self, name: str, most: int | None = None) -> list[str] | None:
        """The client's next frames, `most` at most; None if it was dropped or isn't known."""
        with self.lock:
            at = self.state["clients"].get(name)
            if at is None:
                return None
            behind = self.state["total"] - at
            frames = self.state["frames"][len(self.state["frames"]) - behind :][:most] if behind else []
            self.state["clients"][name] = at + len(frames)
            self._save()
            return frames
