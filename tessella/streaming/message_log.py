"""A message log as a table of offsets: written by batches, read as a batch or a stream, dispatched to with fallbacks.

Each append writes its files and then one manifest, which gives every file its range of offsets and of times; a reader sees what
manifests name. Manifests are named by number and first offset, and one name can be made by one writer only. As in a stored table a
manifest also holds the last batch of each stream of appends, so a batch that comes again adds nothing.

The data source ``message_log`` plans ranges of offsets from the manifests: filters on the offset and on the time column leave out
whole files, and a task reads one range of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.stored import ChangedMeanwhile, Folder

#: Rows that a task reads at most.
RANGE = 100_000
OFFSET = "offset"


@dataclass(frozen=True)
class Segment:
    """A file's place, its first offset, rows, and least and largest time in microseconds (None: no row has a time)."""

    path: str
    first: int
    count: int
    least: int | None
    most: int | None


@dataclass
class Range(InputPartition):
    """Rows ``low`` to ``high`` (exclusive) of a file, the first of which has the offset ``first``."""

    path: str
    low: int
    high: int
    first: int


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def manifests(path: str, start: int = 0) -> list[dict]:
    """The manifests of a log in order, from the one that holds offset ``start`` on."""
    fs, base = _files(path)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{base}/manifests", allow_not_found=True)) if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    begins = [int(n[11:31]) for n in names]
    first = max((i for i, b in enumerate(begins) if b <= start), default=0)
    out = []
    for n in names[first:]:
        with fs.open_input_file(f"{base}/manifests/{n}") as f:
            out.append(json.loads(f.read()))
    return out


def segments(path: str, start: int = 0, stop: int | None = None) -> list[Segment]:
    found = [Segment(**s) for m in manifests(path, start) for s in m["segments"]]
    return [s for s in found if s.first + s.count > start and (stop is None or s.first < stop)]


def end_of(path: str) -> int:
    """The offset that the next message will have."""
    return manifests(path, 1 << 62)[-1]["end"] if manifests(path, 1 << 62) else 0


def micros(value: datetime) -> int:
    whole = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    return round((whole - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


def ranges(found: list[Segment], start: int = 0, stop: int | None = None, rows: int = RANGE) -> list[Range]:
    """The rows of ``found`` with offsets from ``start`` to ``stop`` in parts of at most ``rows``."""
    out = []
    for s in found:
        low, high = max(0, start - s.first), s.count if stop is None else min(s.count, stop - s.first)
        out += [Range(s.path, a, min(a + rows, high), s.first + a) for a in range(low, high, rows)]
    return out


def rows_of(part: Range, path: str, schema: StructType) -> Iterator[pa.RecordBatch]:
    """The rows of a range; row groups before and after it are not read."""
    fs, base = _files(path)
    names = [f.name for f in schema.fields if f.name != OFFSET]
    with fs.open_input_file(f"{base}/{part.path}") as source:
        file, begin = pq.ParquetFile(source), 0
        for g in range(file.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            low, high = max(part.low, begin), min(part.high, begin + n)
            if low < high:
                table = file.read_row_group(g, columns=names).slice(low - begin, high - low)
                offsets = pa.array(range(part.first + low - part.low, part.first + high - part.low), pa.int64())
                columns = {**{c: table.column(c) for c in names}, OFFSET: offsets}
                whole = pa.table({f.name: columns[f.name] for f in schema.fields})
                yield from whole.cast(to_arrow_schema(schema)).combine_chunks().to_batches()
            begin += n


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.time = schema, options["path"], options.get("time", "at")
        self.start, self.stop = int(options.get("from", 0)), int(options["to"]) if "to" in options else None
        self.after: int | None = None
        self.before: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on the offset and the time narrow what is planned; Spark applies all of them again to the rows."""
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            up, down = isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)), isinstance(f, (LessThan, LessThanOrEqual, EqualTo))
            if name == OFFSET and isinstance(value, int):
                if up:
                    self.start = max(self.start, value + isinstance(f, GreaterThan))
                if down:
                    last = value + (not isinstance(f, LessThan))
                    self.stop = last if self.stop is None else min(self.stop, last)
            elif name == self.time and isinstance(value, datetime):
                if up:
                    self.after = max(micros(value), self.after if self.after is not None else micros(value))
                if down:
                    self.before = min(micros(value), self.before if self.before is not None else micros(value))
            yield f

    def planned(self) -> list[Segment]:
        found = segments(self.path, self.start, self.stop)
        if self.after is not None:
            found = [s for s in found if s.most is not None and s.most >= self.after]
        if self.before is not None:
            found = [s for s in found if s.least is not None and s.least <= self.before]
        return found

    def partitions(self) -> list[Range]:
        return ranges(self.planned(), self.start, self.stop) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.low < partition.high:
            yield from rows_of(partition, self.path, self.schema)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.first = schema, options["path"], int(options.get("from", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"offset": max(self.first, end_of(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = start["offset"], end["offset"]
        return ranges(segments(self.path, low, high), low, high) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.low < partition.high:
            yield from rows_of(partition, self.path, self.schema)

    def commit(self, end: dict) -> None:
        pass


class MessageLogSource(DataSource):
    """``format("message_log")`` with the options path, time (the time column, ``at``), from and to (offsets)."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> StructType:
        found = manifests(self.options["path"], 1 << 62)
        if not found:
            raise ValueError("an empty log has no schema of its own: give one")
        return StructType.fromJson(found[-1]["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(schema, dict(self.options))


class MessageLog:
    """A log at ``path`` of messages of ``schema``, one column of which is their time."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, time: str = "at"):
        self.spark, self.folder, self.time = spark, Folder(spark, path), time
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        if OFFSET in self.schema.names or time not in self.schema.names:
            raise ValueError(f"a log's messages have a column {time} and none named {OFFSET}")
        self.whole = StructType([*self.schema.fields, StructField(OFFSET, LongType(), False)])
        if not spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
            spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(MessageLogSource)

    @property
    def path(self) -> str:
        # pyarrow wants an authority, if an empty one
        return self.folder.path.replace("file:/", "file:///", 1) if self.folder.path.startswith("file:/") and not self.folder.path.startswith("file://") else self.folder.path

    def last(self) -> dict:
        found = manifests(self.path, 1 << 62)
        return found[-1] if found else {"version": 0, "end": 0, "batches": {}}

    def has(self, stream: str, batch: int) -> bool:
        return self.last()["batches"].get(stream, -1) >= batch

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Adds messages, those of a file in the order of their times. False if the batch was there before."""
        base = self.last()
        if stream is not None and base["batches"].get(stream, -1) >= batch:
            return False
        name = f"data/{uuid.uuid4().hex}"
        at = F.col(f"`{self.time}`")
        rows.select(*[F.col(f"`{c}`") for c in self.schema.names]).sortWithinPartitions(at).write.parquet(f"{self.folder.path}/{name}")
        # a row per file that was written
        written = self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/{name}").groupBy(F.input_file_name().alias("f"))
        stats = written.agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min(at.cast("timestamp"))).alias("least"), F.unix_micros(F.max(at.cast("timestamp"))).alias("most")).collect()
        end, found = base["end"], []
        for r in sorted(stats, key=lambda r: (r.least is None, r.least or 0, r.f)):
            found.append({"path": f"{name}/{r.f.rsplit('/', 1)[-1]}", "first": end, "count": r.n, "least": r.least, "most": r.most})
            end += r.n
        new = {"version": base["version"] + 1, "end": end, "segments": found, "batches": base["batches"] | ({stream: batch} if stream is not None else {}), "schema": json.loads(self.whole.json())}
        if not self.folder.make(f"manifests/{new['version']:010d}-{base['end']:020d}.json", json.dumps(new)):
            raise ChangedMeanwhile(f"manifest {new['version']} is there already")
        return True

    def read(self, start: int = 0, stop: int | None = None) -> DataFrame:
        reader = self.spark.read.format("message_log").schema(self.whole).option("path", self.path).option("time", self.time).option("from", start)
        return (reader if stop is None else reader.option("to", stop)).load()

    def stream(self, start: int = 0) -> DataFrame:
        return self.spark.readStream.format("message_log").schema(self.whole).option("path", self.path).option("from", start).load()

    def needed(self, n: int) -> list[Segment]:
        """The fewest files that hold the n oldest messages for certain."""
        timed = sorted((s for s in segments(self.path) if s.most is not None), key=lambda s: s.most)
        held, limit = 0, None
        for s in timed:
            held, limit = held + s.count, s.most
            if held >= n:
                break
        return [s for s in timed if limit is not None and s.least <= limit]

    def oldest(self, n: int) -> DataFrame:
        """The n oldest messages by time, ties by offset; messages without a time are left out."""
        parts = self.needed(n)
        at = F.col(f"`{self.time}`")
        if not parts or n < 1:
            return self.spark.createDataFrame([], self.whole)
        out = None
        for low, high in _stretches(parts):
            part = self.read(low, high)
            out = part if out is None else out.union(part)
        return out.where(at.isNotNull()).orderBy(at, OFFSET).limit(n)


def _stretches(parts: list[Segment]) -> list[tuple[int, int]]:
    """Ranges of offsets that lie side by side, as one."""
    out: list[tuple[int, int]] = []
    for s in sorted(parts, key=lambda s: s.first):
        if out and out[-1][1] == s.first:
            out[-1] = (out[-1][0], s.first + s.count)
        else:
            out.append((s.first, s.first + s.count))
    return out


def drain(fallback: MessageLog, into: MessageLog, restart: Callable[[DataFrame], DataFrame]) -> int:
    """Moves what came to ``fallback`` since the last call on to ``into``; returns how many messages.

    The manifest that adds them to ``into`` also says how far the fallback is drained, so each goes over once, whenever a call stops.
    """
    stream = f"drain:{fallback.path}"
    done = into.last()["batches"].get(stream, -1) + 1
    end = end_of(fallback.path)
    if end <= done:
        return 0
    into.append(restart(fallback.read(done, end)).select(*into.schema.names), stream, end - 1)
    return end - done


@dataclass(frozen=True)
class Target:
    """A place that messages can go to; ``append`` may fail, ``has`` says whether a batch is there all the same."""

    name: str
    append: Callable[[DataFrame, str, int], Any]
    has: Callable[[str, int], bool]


def log_target(name: str, log: MessageLog) -> Target:
    return Target(name, log.append, log.has)


def dispatch(rows: DataFrame, targets: list[Target], dead: Callable[[DataFrame, str, str, int], Any], stream: str, batch: int, bad: Column) -> dict[str, str]:
    """Sends a batch to the first target that takes it, and to ``dead`` with the reasons if none does.

    Rows for which ``bad`` is an error and not null go to ``dead`` at once. A target that fails is asked whether the batch got there
    all the same, and so is every target when a batch comes again: each message is in one place. Returns what became of the two parts.
    """
    parts, out = rows.withColumn("error", bad), {}
    refused = parts.where(F.col("error").isNotNull())
    if refused.limit(1).count():
        dead(refused.drop("error"), "not a message", f"{stream}:refused", batch)
        out["refused"] = "dead"
    good = parts.where(F.col("error").isNull()).drop("error")
    for t in targets:
        if t.has(stream, batch):
            return out | {"messages": t.name}
    reasons = []
    for t in targets:
        try:
            t.append(good, stream, batch)
            return out | {"messages": t.name}
        except Exception as e:  # noqa: BLE001 - whatever a target fails with, the next one is tried
            if t.has(stream, batch):
                return out | {"messages": t.name}
            reasons.append(f"{t.name}: {e}")
    dead(good, "; ".join(reasons), stream, batch)
    return out | {"messages": "dead"}
