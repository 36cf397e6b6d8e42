"""Versioned state tables and exactly-once appends over plain Parquet files.

Both keep their data in folders that are never changed once they are
committed, and say in a small JSON file which folders count; that file is
written last, under a name of its own, and is the commit. Folder and file names
that begin with ``_`` are skipped by Spark's own readers. All file access goes
through Hadoop's FileSystem, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.sources.tables import schema_of


class Files:
    """The few file operations that commits need, in Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> dict:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, name: str, content: dict) -> None:
        """Write a file that must not exist yet."""
        fs, path = self._at(name)
        try:
            stream = fs.create(path, False)
        except Py4JJavaError as e:
            raise FileExistsError(f"{self.root}/{name}") from e
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()


COMMITS = "_commits"


def append_run(df: DataFrame, path: str, run_id: str, facts: dict | None = None) -> bool:
    """Append a run's rows exactly once; whether they were added now.

    The rows go to ``<path>/run=<run_id>``, then the run is committed (with
    ``facts`` about it). A run that is committed already adds nothing, however
    often it is repeated; one that failed halfway is written anew.
    """
    files = Files(df.sparkSession, path)
    if files.exists(f"{COMMITS}/{run_id}.json"):
        return False
    df.write.mode("overwrite").parquet(f"{files.root}/run={run_id}")
    files.commit(f"{COMMITS}/{run_id}.json", facts or {})
    return True


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    return [n.removesuffix(".json") for n in Files(spark, path).names(COMMITS) if n.endswith(".json")]


def read_appended(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The rows of all committed runs; folders without a commit do not count."""
    runs = [f"{path.rstrip('/')}/run={r}" for r in committed_runs(spark, path)]
    schema = schema_of(name)
    return spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema)


class StateTable:
    """A table of the current state, laid out in parts by a hash of its key.

    Version ``v`` is ``_versions/<v>.json``: for each part the version whose
    folder ``v=<n>/part=<p>`` holds it. A change reads and rewrites the parts of
    the rows that change, and no others, into folders of the new version; older
    versions stay readable. Two writers of one version collide at the commit,
    and the second one fails.
    """

    PART = "part"
    VERSIONS = "_versions"

    def __init__(self, spark: SparkSession, name: str, path: str, key: Sequence[str], parts: int = 256):
        self.spark, self.name, self.files, self.key = spark, name, Files(spark, path), list(key)
        self.parts, self.schema = parts, schema_of(name)
        if self.versions():
            self.parts = self._manifest(self.versions()[-1])["parts"]

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(self.VERSIONS) if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        return self.files.read(f"{self.VERSIONS}/{version}.json")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def _write(self, df: DataFrame, version: int) -> None:
        rows = df.select(*self.schema.fieldNames()).withColumn(self.PART, self._part())
        # Rows of a part meet in one task, so a part is one file.
        rows.repartition(self.PART).write.mode("overwrite").partitionBy(self.PART).parquet(f"{self.files.root}/v={version}")

    def _held(self, version: int) -> list[int]:
        names = self.files.names(f"v={version}")
        return [int(n.removeprefix(f"{self.PART}=")) for n in names if n.startswith(f"{self.PART}=")]

    def create(self, df: DataFrame) -> int:
        """Version 0: all rows."""
        if self.versions():
            raise FileExistsError(self.files.root)
        self._write(df, 0)
        self.files.commit(f"{self.VERSIONS}/0.json", {"parts": self.parts, "at": {p: 0 for p in self._held(0)}})
        return 0

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version (the last by default), of some parts only if given."""
        held = self._manifest(self.versions()[-1] if version is None else version)["at"]
        folders = [f"{self.files.root}/v={v}/{self.PART}={p}" for p, v in held.items() if only is None or int(p) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def merge(self, changed: DataFrame, removed: DataFrame | None = None) -> int:
        """A new version with the rows of ``changed`` in place of those with
        their key (or added), and without the keys of ``removed``."""
        last = self.versions()[-1]
        manifest = self._manifest(last)
        keys = changed.select(*self.key)
        gone = keys if removed is None else keys.unionByName(removed.select(*self.key))
        touched = [r[0] for r in gone.select(self._part().alias(self.PART)).distinct().collect()]
        if not touched:
            return last
        kept = self.read(last, touched).join(gone.distinct(), self.key, "left_anti")
        self._write(kept.unionByName(changed.select(*self.schema.fieldNames())), last + 1)
        at = {p: v for p, v in manifest["at"].items() if int(p) not in touched} | {p: last + 1 for p in self._held(last + 1)}
        self.files.commit(f"{self.VERSIONS}/{last + 1}.json", {"parts": self.parts, "at": at})
        return last + 1
