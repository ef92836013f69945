"""Recorded runs as a Python data source: a folder for each run and topic, frames <number>.npy and their stamps.

    spark.dataSource.register(RunFrames)
    spark.read.format("run_frames").load("/runs").where("run = 'a' and frame >= 100")
    spark.readStream.format("run_frames").load("/runs")

Filters on run, topic and frame choose folders and files before any is opened (spark.sql.python.filterPushdown.enabled). Each
partition is a range of frames of one run and topic. As a stream, an offset holds the number of the next frame of each run and topic,
so frames that are added to a run come once. Folders must be in a file system that all executors mount.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "run string, topic string, frame int, stamp double, shape array<int>, values array<double>"
#: Frames of a partition, and names of frames.
CHUNK, FRAME = 256, re.compile(r"(\d+)\.npy")


@dataclass
class Span(InputPartition):
    run: str
    topic: str
    frames: list[int]


@dataclass
class Asked:
    """What filters leave of runs, topics and frames."""

    runs: set[str] | None = None
    topics: set[str] | None = None
    low: int = 0
    high: int = 1 << 31
    frames: set[int] | None = field(default=None)

    def take(self, f: Filter) -> bool:
        """Narrow down by a filter; False if it is not one of those known here."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        if name in ("run", "topic", "frame") and isinstance(f, EqualTo | In):
            kind = {"run": "runs", "topic": "topics", "frame": "frames"}[name]
            values = set(f.value if isinstance(f, In) else [f.value])
            setattr(self, kind, values if getattr(self, kind) is None else getattr(self, kind) & values)
            return True
        if name == "frame" and isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            return True
        if name == "frame" and isinstance(f, LessThan | LessThanOrEqual):
            self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            return True
        return False

    def has(self, frame: int) -> bool:
        return self.low <= frame < self.high and (self.frames is None or frame in self.frames)


def folders(root: str, asked: Asked) -> list[tuple[str, str]]:
    """Runs and topics below the root: any folder in a folder."""
    below = lambda path, wanted: sorted(e.name for e in os.scandir(path) if e.is_dir() and (wanted is None or e.name in wanted))
    return [(run, topic) for run in below(root, asked.runs) for topic in below(f"{root}/{run}", asked.topics)]


def numbers(path: str) -> list[int]:
    return sorted(int(m[1]) for e in os.scandir(path) if (m := FRAME.fullmatch(e.name)))


def rows(root: str, span: Span) -> Iterator[tuple]:
    folder = f"{root}/{span.run}/{span.topic}"
    stamps: list[float] = []
    if os.path.exists(f"{folder}/timestamps.txt"):
        with open(f"{folder}/timestamps.txt", encoding="utf-8") as f:
            stamps = [float(x) for x in f.read().split()]
    names = {int(m[1]): e.name for e in os.scandir(folder) if (m := FRAME.fullmatch(e.name))}
    for k in span.frames:
        array = np.load(f"{folder}/{names[k]}", allow_pickle=False)
        yield span.run, span.topic, k, stamps[k] if k < len(stamps) else None, list(array.shape), array.astype(float).ravel().tolist()


def spans(found: dict[tuple[str, str], list[int]]) -> list[Span]:
    return [Span(run, topic, frames[k : k + CHUNK]) for (run, topic), frames in sorted(found.items()) for k in range(0, len(frames), CHUNK)]


class Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root, self.asked = root, Asked()

    def pushFilters(self, filters: list[Filter]):
        return [f for f in filters if not self.asked.take(f)]

    def partitions(self) -> list[Span]:
        return spans({(r, t): [k for k in numbers(f"{self.root}/{r}/{t}") if self.asked.has(k)] for r, t in folders(self.root, self.asked)}) or [Span("", "", [])]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from rows(self.root, partition) if partition.frames else ()


class Follower(DataSourceStreamReader):
    """Frames in the order of their numbers; one that comes with a number below the next one expected is not seen."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {(r, t): numbers(f"{self.root}/{r}/{t}") for r, t in folders(self.root, Asked())}
        return {f"{r}/{t}": frames[-1] + 1 for (r, t), frames in found.items() if frames}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        found = {}
        for name, stop in end.items():
            run, topic = name.split("/")
            frames = [k for k in numbers(f"{self.root}/{run}/{topic}") if start.get(name, 0) <= k < stop]
            if frames:
                found[run, topic] = frames
        return spans(found)

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from rows(self.root, partition)

    def commit(self, end: dict) -> None:
        pass


class RunFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> Follower:
        return Follower(self.options["path"])
