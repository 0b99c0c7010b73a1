"""Tables that are changed in place of their readers' view: copy-on-write by key buckets, published by one new manifest.

A row's bucket is a hash of its key columns. A change reads and writes the buckets that it touches; all other buckets keep their
files, byte for byte. The new files are seen only once the next manifest is there, a file that names each bucket's folders and that
can be made by one writer only: a change that stops half way leaves the table as it was, and of two at the same time one
fails and can be tried again. A manifest also holds the last batch of each stream, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store

#: From the touched buckets' rows and the changes to what these buckets hold then.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class ChangedMeanwhile(RuntimeError):
    """Another writer published a version first."""


class Folder:
    """Small files and folders of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(self.root).toString()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def make(self, name: str, text: str) -> bool:
        """Makes a file with all its text at once; False if there is one of that name."""
        at, draft = self._at(name), self._at(f"{name}.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        rename = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # fails if the name is taken
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf).rename(draft, at, rename)
            return True
        except Exception as e:  # noqa: BLE001
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class StoredTable:
    """A table at ``path`` whose rows are dealt to ``buckets`` buckets by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.folder = spark, Folder(spark, path)
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self.keys, self.count = list(keys), buckets
        if not set(self.keys) <= set(self.schema.names):
            raise ValueError(f"keys that are no columns: {self.keys}")

    # --- versions

    def version(self) -> int:
        """The number of the last version; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": {}, "batches": {}}
        found = json.loads(self.folder.read(f"manifests/{version:010d}.json"))
        if found["keys"] != self.keys or found["count"] != self.count:
            raise ValueError("the table is dealt out in another way")
        return found

    def _publish(self, base: dict, buckets: dict[str, list[str]], stream: str | None, batch: int | None) -> None:
        batches = base["batches"] | ({stream: batch} if stream is not None else {})
        new = {"version": base["version"] + 1, "keys": self.keys, "count": self.count, "buckets": buckets, "batches": batches}
        if not self.folder.make(f"manifests/{new['version']:010d}.json", json.dumps(new)):
            raise ChangedMeanwhile(f"version {new['version']} is there already")

    # --- rows

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.count)).cast("int"))

    def _of(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = manifest["buckets"] if buckets is None else {b: x for b, x in manifest["buckets"].items() if int(b) in set(buckets)}
        paths = [f"{self.folder.path}/{p}" for ps in wanted.values() for p in ps]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of an earlier one."""
        return self._of(self.manifest(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose keys are among ``keys``; other buckets are not read."""
        wanted = self._bucket(keys.select(*self.keys))
        hit = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # at most as many as there are buckets
        return self._of(self.manifest(), hit).join(wanted.drop("bucket").distinct(), self.keys, "left_semi")

    # --- changes

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """New files of rows, a folder for each bucket; they are part of the table once a manifest names them."""
        name = f"data/{uuid.uuid4().hex}"
        kept = self._bucket(rows.select(*[F.col(f"`{c}`") for c in self.schema.names]))
        kept.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder.path}/{name}")
        return {n.removeprefix("bucket="): [f"{name}/{n}"] for n in self.folder.names(name) if n.startswith("bucket=")}

    def _again(self, base: dict, stream: str | None, batch: int | None) -> bool:
        return stream is not None and base["batches"].get(stream, -1) >= batch

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Adds rows as they are; buckets get one more folder. False if the batch was there before."""
        base = self.manifest()
        if self._again(base, stream, batch):
            return False
        made = self._write(rows)
        buckets = {b: [*base["buckets"].get(b, []), *made.get(b, [])] for b in {*base["buckets"], *made}}
        self._publish(base, buckets, stream, batch)
        return True

    def change(self, changes: DataFrame, merge: Merge, stream: str | None = None, batch: int | None = None, touched: DataFrame | None = None) -> bool:
        """Replaces the touched buckets by ``merge(their rows, changes)``. False if the batch was there before.

        Touched are the buckets of the keys in ``touched``, or else in ``changes``.
        """
        base = self.manifest()
        if self._again(base, stream, batch):
            return False
        keys = (changes if touched is None else touched).select(*[F.col(f"`{k}`") for k in self.keys])
        hit = sorted(r.bucket for r in self._bucket(keys).select("bucket").distinct().collect())  # at most the number of buckets
        made = self._write(merge(self._of(base, hit), changes)) if hit else {}
        buckets = {b: x for b, x in base["buckets"].items() if int(b) not in set(hit)} | made
        self._publish(base, buckets, stream, batch)
        return True

    def upsert(self, rows: DataFrame, order: str, kept: Sequence[str] = (), **batch) -> bool:
        """Last write wins by key; columns ``kept`` keep their first value."""
        return self.change(rows, lambda old, new: store.upsert(old, new, self.keys, order, kept), **batch)

    def delete(self, keys: DataFrame, on: Sequence[str] | None = None, **batch) -> bool:
        """Removes the rows whose columns ``on`` (the table's keys, if not given) are among ``keys``.

        With other columns than the keys, a pass over those columns finds the buckets that hold such rows.
        """
        on = list(on or self.keys)
        touched = None if set(on) >= set(self.keys) else self.read().join(keys.select(*on).distinct(), on, "left_semi")
        return self.change(keys, lambda old, gone: store.delete_by(old, gone, on), touched=touched, **batch)

    def replace(self, rows: DataFrame, **batch) -> bool:
        """All rows of the keys in ``rows`` are replaced by these, whatever their number before."""
        merge = lambda old, new: old.join(new.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(new.select(*old.columns))
        return self.change(rows, merge, **batch)

    def vacuum(self, keep: int = 1) -> int:
        """Removes the files that none of the last ``keep`` versions has, and older manifests; returns how many folders went."""
        last = self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        used = {p for v in kept for ps in self.manifest(v)["buckets"].values() for p in ps}
        gone = 0
        for name in self.folder.names("data"):
            for b in self.folder.names(f"data/{name}"):
                if b.startswith("bucket=") and f"data/{name}/{b}" not in used:
                    self.folder.remove(f"data/{name}/{b}")
                    gone += 1
        for v in range(1, kept.start):
            self.folder.remove(f"manifests/{v:010d}.json")
        return gone


def sink(table: StoredTable, stream: str, apply: Callable[[StoredTable, DataFrame, dict], object], tries: int = 5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``apply(table, rows, {"stream": ..., "batch": ...})``, again if another writer was first."""

    def run(df: DataFrame, batch: int) -> None:
        for left in range(tries - 1, -1, -1):
            try:
                apply(table, df, {"stream": stream, "batch": batch})
                return
            except ChangedMeanwhile:
                if not left:
                    raise

    return run
