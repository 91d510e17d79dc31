"""Versions of a table in a folder, each swapped in as a whole.

A version is a small manifest that names the Parquet parts it consists of. Parts are written first; the version becomes
current by renaming its manifest to the next number, which fails if that number is taken. So a failed run leaves the
version before in force, and of two runs based on the same version one fails instead of undoing the other's work.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_VERSION = re.compile(r"v-(\d{12})\.json")


class StaleVersion(RuntimeError):
    """Another run has swapped in a version since the one this run is based on."""


class StateStore:
    """The versions in a folder. ``version()`` is 0 before the first."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path())] if self._fs.exists(self._path()) else []

    def version(self) -> int:
        """The number of the version in force."""
        return max((int(m[1]) for n in self._names() if (m := _VERSION.fullmatch(n))), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``parts`` and ``meta`` of a version, the one in force by default."""
        version = self.version() if version is None else version
        if version == 0:
            return {"parts": [], "meta": {}}
        stream = self._fs.open(self._path(f"v-{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, None if it has no parts."""
        parts = self.manifest(version)["parts"]
        return self.spark.read.parquet(*(f"{self.folder}/{p}" for p in parts)) if parts else None

    def add(self, rows: DataFrame, based_on: int, meta: dict | None = None, partition_by: list[str] | None = None) -> int:
        """A version with ``rows`` beside what is there. Gives its number."""
        return self._swap(rows, based_on, self.manifest(based_on)["parts"], meta, partition_by)

    def replace(self, rows: DataFrame, based_on: int, meta: dict | None = None, partition_by: list[str] | None = None) -> int:
        """A version of ``rows`` alone; parts that neither it nor the version before needs are removed."""
        new = self._swap(rows, based_on, [], meta, partition_by)
        kept = {*self.manifest(new)["parts"], *self.manifest(based_on)["parts"]}
        for name in self._names():
            if name.startswith("part-") and name not in kept and name in self._before(based_on):
                self._fs.delete(self._path(name), True)
        return new

    def _before(self, version: int) -> set[str]:
        """Parts of the versions up to this one; the manifests of all but it are dropped with them."""
        parts: set[str] = set()
        for name in self._names():
            if (m := _VERSION.fullmatch(name)) and int(m[1]) < version:
                parts |= set(self.manifest(int(m[1]))["parts"])
        return parts

    def _swap(self, rows: DataFrame, based_on: int, parts: list[str], meta: dict | None, partition_by: list[str] | None) -> int:
        part = f"part-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.folder}/{part}")
        fresh = self._path(f"new-{part}.json")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps({"parts": [*parts, part], "meta": meta or {}}).encode()))
        finally:
            stream.close()
        if self.version() != based_on:
            raise StaleVersion(f"{self.folder}: based on version {based_on}, now {self.version()}")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fresh, self._path(f"v-{based_on + 1:012d}.json"), none)
        except Exception as e:
            if self.version() != based_on:
                raise StaleVersion(f"{self.folder}: based on version {based_on}, now {self.version()}") from e
            raise
        return based_on + 1
