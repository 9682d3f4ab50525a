"""The activity log: a ring in memory with a cursor, a file of JSON lines, and the file as a stream.

    spark.dataSource.register(ActivitySource)
    spark.readStream.format("activity").option("path", ".../activity.jsonl").load()

An offset of the stream is the number of entries so far and the byte where they end, so a
batch is a fixed stretch of the file however often it is read, and a restart goes on behind the last one.
"""

from __future__ import annotations

import json
import os
import threading
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from siftstone.functions import constants as K

SCHEMA = "seq long, ts string, level string, message string"


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


class LogSink:
    def __init__(self, path: str | None = None, ring: int = K.LOG_RING):
        self.path, self.lock = path, threading.Lock()
        self.ring: deque[dict] = deque(maxlen=ring)
        self.written = 0

    def log(self, level: str, message: str) -> None:
        if level not in K.LOG_LEVELS:
            raise ValueError(f"unknown level {level}")
        with self.lock:
            entry = {"seq": self.written, "ts": now(), "level": level, "message": message}
            self.ring.append(entry)
            self.written += 1
            if self.path:
                os.makedirs(os.path.dirname(self.path), exist_ok=True)
                with open(self.path, "a", encoding="utf-8") as f:
                    f.write(json.dumps(entry, ensure_ascii=False) + "\n")

    def info(self, m: str) -> None:
        self.log("info", m)

    def warn(self, m: str) -> None:
        self.log("warn", m)

    def error(self, m: str) -> None:
        self.log("error", m)

    def dry(self, m: str) -> None:
        self.log("dry", m)

    def real(self, m: str) -> None:
        self.log("real", m)

    def tail(self, since: int = 0) -> tuple[list[dict], int]:
        """Entries from the cursor on, as far back as the ring holds, and the next cursor."""
        with self.lock:
            first = self.written - len(self.ring)
            start = max(since, first)
            return list(self.ring)[start - first :] if start < self.written else [], self.written

    def clear(self) -> None:
        """Empty the ring; cursors start from 0 again."""
        with self.lock:
            self.ring.clear()
            self.written = 0


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


#: Bytes of the file that one task reads, about.
TASK_BYTES = 16 << 20


class Stretch(InputPartition):
    """The lines that begin in [begin, end) of the file."""

    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class ActivityReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.task = int(options.get("taskbytes", TASK_BYTES))
        self.known = {"entries": 0, "byte": 0}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entries": 0, "byte": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """Counts on from the last offset known here (a restart counts once from the beginning), whole lines only: one
        that is being written waits."""
        at = dict(self.known)
        if not os.path.exists(self.path):
            return at
        with open(self.path, "rb") as f:
            f.seek(at["byte"])
            while block := f.read(1 << 20):
                end = block.rfind(b"\n") + 1
                if not end:
                    block += f.readline()
                    if not block.endswith(b"\n"):
                        break
                    end = len(block)
                at = {"entries": at["entries"] + block.count(b"\n", 0, end), "byte": at["byte"] + end}
                f.seek(at["byte"])
        self.known = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(b, min(b + self.task, end["byte"])) for b in range(start["byte"], end["byte"], self.task)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            if part.begin:
                f.seek(part.begin - 1)
                f.readline()  # ends the line that began before
            while f.tell() < part.end and (line := f.readline()):
                try:
                    e = json.loads(line)
                except ValueError:
                    continue
                yield (e.get("seq"), e.get("ts"), e.get("level"), e.get("message"))


class ActivitySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "activity"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ActivityReader:  # noqa: N802
        return ActivityReader(dict(self.options))
