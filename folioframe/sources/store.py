"""Tables by key in a shared folder, changed a bucket at a time and committed together.

A table's rows lie in buckets by a hash of their key. A change rewrites the buckets that it
touches as new Parquet folders and leaves all others; a commit is one manifest, a small text
file that names each table's folder for each bucket, put in place by a rename that fails if
that version exists. Readers see the last manifest's tables, or those of an earlier one: what
a killed writer has left is named by none. A commit may carry the number of a stream's batch;
a batch that has been committed is not committed again.

A store may keep views, sums over groups of a table's rows: a change of the table brings its
views up to date from the rows of the buckets that it touches, in the same commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioframe.keeping import kept
from folioframe.operators.maintained import View, merged, part, state
from folioframe.sources.manifests import Conflict, Manifests  # noqa: F401  callers catch Conflict


class Table(NamedTuple):
    """Rows by key (or, for children, by their parent's key); schema as DDL."""

    key: str
    schema: str
    buckets: int = 64


class Store:
    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, Table], views: Mapping[str, tuple[str, View]] | None = None):
        """views: by name, the table that each is of. They are read as tables are."""
        self.spark, self.folder, self.tables, self.views = spark, folder.rstrip("/"), dict(tables), dict(views or {})
        for name, (of, view) in self.views.items():
            empty = state(view, spark.createDataFrame([], StructType.fromDDL(self.tables[of].schema)))
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema)
            self.tables[name] = Table("group_key", f"group_key string, {columns}", self.tables[of].buckets)
        self._held = Manifests(spark, folder)
        self._files, self._path = self._held.files, self._held.path

    def versions(self) -> list[int]:
        return self._held.versions()

    def manifest(self, version: int | None = None) -> dict:
        """{version, tables: {name: {bucket: folder}}, batches: {stream: number}}; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}, "batches": {}}
        return self._held.read(version)

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a version, or some buckets of it."""
        held = self.manifest(version)["tables"].get(name, {})
        folders = [f"{self.folder}/{f}" for b, f in sorted(held.items()) if buckets is None or int(b) in buckets]
        schema = StructType.fromDDL(self.tables[name].schema)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def done(self, stream: str) -> int:
        """The number of the stream's last committed batch, -1 before any."""
        return self.manifest()["batches"].get(stream, -1)

    def begin(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the last `keep`, and all folders that those don't name; returns how many. Not while others write."""
        kept = self.versions()[-keep:]
        named = {f for v in kept for t in self.manifest(v)["tables"].values() for f in t.values()}
        gone = 0
        for v in set(self.versions()) - set(kept):
            self._held.delete(v)
        data = self._path("data")
        for change in self._files.listStatus(data) if self._files.exists(data) else []:
            for table in self._files.listStatus(change.getPath()):
                for bucket in self._files.listStatus(table.getPath()):
                    name = "/".join(bucket.getPath().toString().rsplit("/", 4)[1:])
                    if bucket.isDirectory() and name not in named:
                        gone += bool(self._files.delete(bucket.getPath(), True))
        return gone


class Change:
    """A set of changes of a store's tables, which appear together at `commit`."""

    def __init__(self, store: Store):
        self.store, self.base, self.place, self.touched = store, store.manifest(), f"data/{uuid.uuid4().hex}", {}

    def _bucket(self, name: str, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.store.tables[name].buckets)).cast("int")

    def _rewritten(self, name: str, keys: DataFrame, merge) -> None:
        """Rewrites the buckets of keys; merge: the buckets' rows -> what they shall hold."""
        table = self.store.tables[name]
        if name in self.touched:
            raise ValueError(f"{name} is changed already")
        found = [r[0] for r in keys.select(self._bucket(name, F.col(table.key))).distinct().collect()]  # at most as many as there are buckets
        schema = StructType.fromDDL(table.schema)
        rows = merge(self.store.read(name, self.base["version"], found)).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        rows = rows.withColumn("__b", self._bucket(name, F.col(table.key)))
        # A bucket that one parent fills is written by several tasks.
        spread = rows.repartition(F.col("__b"), F.pmod(F.xxhash64(*(f.name for f in schema if not f.dataType.simpleString().startswith("map"))), F.lit(4)))
        spread.write.partitionBy("__b").parquet(f"{self.store.folder}/{self.place}/{name}")
        there = {x.getPath().getName() for x in self.store._files.listStatus(self.store._path(f"{self.place}/{name}"))}
        self.touched[name] = {str(b): f"{self.place}/{name}/__b={b}" if f"__b={b}" in there else None for b in found}
        for view_name, (of, view) in self.store.views.items():
            if of == name:
                self._follow(view_name, view, name, found)

    def _now(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows as this change leaves them."""
        held = {**self.base["tables"].get(name, {}), **self.touched.get(name, {})}
        folders = [f"{self.store.folder}/{f}" for b, f in sorted(held.items()) if f and (buckets is None or int(b) in buckets)]
        schema = StructType.fromDDL(self.store.tables[name].schema)
        return self.store.spark.read.schema(schema).parquet(*folders) if folders else self.store.spark.createDataFrame([], schema)

    def _follow(self, name: str, view: View, of: str, buckets: list[int]) -> None:
        keyed = lambda df: df.withColumn("group_key", F.to_json(F.struct(*view.groups)))
        if name in self.base["tables"]:
            made = keyed(part(view, self.store.read(of, self.base["version"], buckets), self._now(of, buckets)))
        else:  # the view is newer than the table
            made = keyed(state(view, self._now(of)))
        made = kept(made)
        self._rewritten(name, made, lambda old: keyed(merged(view, old, made)))

    def recount(self, name: str) -> Change:
        """Makes a view's state anew from its whole table."""
        of, view = self.store.views[name]
        whole = kept(state(view, self._now(of)).withColumn("group_key", F.to_json(F.struct(*view.groups))))
        keys = whole.select("group_key").unionByName(self.store.read(name, self.base["version"]).select("group_key"))
        self._rewritten(name, keys, lambda old: whole)
        return self

    def upsert(self, name: str, new: DataFrame, order: str | None = None) -> Change:
        """Overlays rows by key; nulls of new never overwrite. Of rows of one key the last by `order` counts; without one, keys must differ."""
        from folioframe.operators.catalog import upsert

        key = self.store.tables[name].key
        if order is None and new.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}: rows of one {key}; say by what they are ordered")
        self._rewritten(name, new, lambda old: upsert(old, new, key, order))
        return self

    def replace(self, name: str, parents: DataFrame, rows: DataFrame) -> Change:
        """Takes away all rows of the given parents and adds rows, whose parents must be among them."""
        key = self.store.tables[name].key
        gone = parents.select(key).distinct()
        self._rewritten(name, gone, lambda old: old.join(gone, key, "left_anti").unionByName(rows.join(gone, key, "left_semi"), allowMissingColumns=True))
        return self

    def add(self, name: str, rows: DataFrame) -> Change:
        """Adds rows whose key the table lacks, once a key."""
        key = self.store.tables[name].key
        self._rewritten(name, rows, lambda old: old.unionByName(rows.dropDuplicates([key]).join(old.select(key), key, "left_anti")))
        return self

    def commit(self, stream: str | None = None, batch: int = 0) -> int:
        """Makes all changes the store's next version and returns its number."""
        store, number = self.store, self.base["version"] + 1
        tables = {n: dict(t) for n, t in self.base["tables"].items()}
        for name, folders in self.touched.items():
            held = tables.setdefault(name, {})
            for b, folder in folders.items():
                held.pop(b, None)
                if folder:
                    held[b] = folder
        batches = {**self.base["batches"], **({stream: batch} if stream else {})}
        return store._held.commit(number, {"version": number, "tables": tables, "batches": batches})
