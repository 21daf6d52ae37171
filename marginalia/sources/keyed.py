"""A table with a key: rows in hash buckets, merged by key, with versions that readers see whole.

A merge reads and writes only the buckets of the keys that it touches; the new version names the new folders of these and the old folders of all
others. Buckets are fixed when the table is made, so their size, not their number, grows with the rows: choose them for the size that is expected.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources import pointers

BUCKETS = 32


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    schema: str
    key: str
    buckets: int = BUCKETS

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _state(self) -> tuple[int, dict[int, str]]:
        found = pointers.newest(self.spark, self.path)
        if found is None:
            return 0, {}
        if found[1]["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {found[1]['buckets']} buckets")
        return found[0], {int(k): v for k, v in found[1]["folders"].items()}

    def _rows(self, folders) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    @property
    def version(self) -> int:
        return self._state()[0]

    def read(self) -> DataFrame:
        return self._rows(self._state()[1].values())

    def lookup(self, value) -> DataFrame:
        """The rows of one key: one bucket is read."""
        number = self.spark.range(1).select(self._bucket(F.lit(value))).first()[0]
        folder = self._state()[1].get(number)
        return self._rows([folder] if folder else []).where(F.col(self.key) == F.lit(value))

    def merge(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """rows take the place of those of the same key; keys of gone (a column named as the key) leave. The new version's number.

        A key that stands twice in rows is an error of the caller: both rows would stay.
        """
        version, folders = self._state()
        rows = rows.select(*self._rows([]).columns) if rows is not None else self._rows([])
        keys = rows.select(self.key)
        keys = keys.union(gone.select(self.key)) if gone is not None else keys
        # At most one number for each bucket.
        touched = sorted(r[0] for r in keys.select(self._bucket(F.col(self.key))).distinct().collect())
        if not touched and version:
            return version
        kept = self._rows([folders[b] for b in touched if b in folders]).join(keys.distinct(), self.key, "left_anti")
        name = f"data/{uuid.uuid4().hex}"
        new = kept.unionByName(rows).withColumn("bucket", self._bucket(F.col(self.key)))
        new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        fs, _ = pointers.file_of(self.spark, self.path)
        folders = {b: f for b, f in folders.items() if b not in set(touched)}
        for b in touched:  # a bucket whose keys are all gone has no folder
            if fs.exists(pointers.file_of(self.spark, f"{self.path}/{name}/bucket={b}")[1]):
                folders[b] = f"{name}/bucket={b}"
        return pointers.publish_next(self.spark, self.path, version, {"buckets": self.buckets, "folders": folders})

    def upsert(self, rows: DataFrame) -> int:
        return self.merge(rows)

    def delete(self, keys: DataFrame) -> int:
        return self.merge(None, keys)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last `keep` versions names; how many."""
        said = pointers.forget(self.spark, self.path, keep)
        named = {f.split("/")[1] for s in said for f in s["folders"].values()}
        fs, data = pointers.file_of(self.spark, f"{self.path}/data")
        old = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in named] if fs.exists(data) else []
        for p in old:
            fs.delete(p, True)
        return len(old)
