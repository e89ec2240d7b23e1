"""Cutting a plan's lineage by a table in the shared folder, and versioned tables."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named and Spark is local, one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.conf.get("spark.master", "local") or "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: later plans begin here, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a small file unless it is there; of several writers one is told True. Readers see all of it or no file.

    Locally a complete file is linked to its name; elsewhere the file system
    creates it, which must refuse a name that exists (HDFS and its like do).
    """
    scheme, _, rest = path.partition("://")
    local = path.removeprefix("file://").removeprefix("file:")
    if (not rest or scheme == "file") and _is_local(spark, path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(content)
        try:
            os.link(draft, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where.getParent())
    try:
        out = files.create(where, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(content.encode())
    out.close()
    return True


def _is_local(spark: SparkSession, path: str) -> bool:
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"


def small_files(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none where it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def read_small(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Conflict(RuntimeError):
    """Another writer was first."""


LOG = "version bigint, actor string, summary string, folder string, rows bigint, previous bigint"


class VersionedTable:
    """Snapshots of a table: each write is a new folder and an entry of the log; reading takes the last, or one by number.

    An entry is a file that is created once, so of two writers of one version
    one wins; the other takes the next number, or fails if it named the version
    that its rows were made from.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/log")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def last(self) -> int:
        """The newest version; 0 before the first."""
        return self.log().agg(F.max("version")).first()[0] or 0

    def write(self, df: DataFrame, actor: str, summary: str = "", expected: int | None = None) -> int:
        """A snapshot that readers see once its entry is there. expected: the version that df was made from."""
        folder = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        rows = self.spark.read.parquet(folder).count()
        return self._enter(folder, rows, actor, summary, expected)

    def _enter(self, folder: str, rows: int, actor: str, summary: str, expected: int | None) -> int:
        before = self.last() if expected is None else expected
        while True:
            entry = {"version": before + 1, "actor": actor, "summary": summary, "folder": folder, "rows": rows, "previous": before}
            if create_once(self.spark, f"{self.path}/log/{before + 1:019d}.json", json.dumps(entry)):
                return before + 1
            if expected is not None:
                raise Conflict(f"version {expected} is not the last")
            before += 1

    def update(self, change: Callable[[DataFrame], DataFrame], actor: str, summary: str = "", tries: int = 20) -> int:
        """The last version changed; made again from the newer one when another writer was first."""
        for _ in range(tries):
            version = self.last()
            try:
                return self.write(change(self.read(version)), actor, summary, version)
            except Conflict:
                continue
        raise Conflict(f"others were first {tries} times")

    def read(self, version: int | None = None) -> DataFrame:
        version = version or self.last()
        folder = self.log().where(F.col("version") == version).agg(F.max("folder")).first()[0]
        if not folder:
            raise ValueError(f"there is no version {version}")
        return self.spark.read.parquet(folder)

    def restore(self, version: int, actor: str) -> int:
        """The rows of an older version as a new one; nothing is lost."""
        return self.write(self.read(version), actor, f"restored version {version}")


class BatchTable:
    """A table that grows by numbered batches; a batch that is written again changes nothing.

    ``read(before)`` has the batches before one, so what a batch is made from
    does not change when it is made again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._known: dict[int, str] = {}

    def write(self, df: DataFrame, batch: int) -> bool:
        """All of the batch or nothing: the folder is complete before its entry names it. False if the batch was there, which then stays."""
        folder = f"{self.path}/{batch:019d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(folder)
        return create_once(self.spark, f"{self.path}/log/{batch:019d}.json", json.dumps({"batch": batch, "folder": folder}))

    def _log(self) -> dict[int, str]:
        """The batches' folders; an entry never changes, so each is read once."""
        for name in small_files(self.spark, f"{self.path}/log"):
            if name.endswith(".json") and int(name[:-5]) not in self._known:
                self._known[int(name[:-5])] = json.loads(read_small(self.spark, f"{self.path}/log/{name}"))["folder"]
        return self._known

    def last(self) -> int:
        """The greatest batch; -1 before the first."""
        return max(self._log(), default=-1)

    def has(self, batch: int) -> bool:
        return batch in self._known or batch in self._log()

    def read(self, before: int | None = None, only: int | None = None) -> DataFrame:
        folders = [f for n, f in sorted(self._log().items()) if (before is None or n < before) and (only is None or n == only)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
