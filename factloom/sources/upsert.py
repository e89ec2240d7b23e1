"""Idempotent upsert into a database as a Data Source: tasks stage their rows, the driver's commit merges them at once.

``df.write.format("upsert").mode("append")`` after ``register(spark)``, for rows
of (dm_id, ...). Each task writes a staging table of its own in one
transaction, together with its entry in a register; a task that is lost or
repeated leaves at most a table that nobody commits. ``commit`` creates the
target, adds missing columns, merges the tables of the tasks that Spark counts
(of rows with one id, the last of the last partition stays), and drops the job's
tables, all in one transaction; ``abort`` drops them. A task that ends when its
job is over finds no job to join and takes its table back. So a reader sees all
of a job or nothing, and an aborted job leaves nothing but the empty register.

As a streaming sink the batch's number is kept for each query, and a batch that
comes again is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from importlib import import_module
from typing import Any
from uuid import uuid4

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .outbound import AT, ID, quote, table_name

JOBS, REGISTER, BATCHES = "factloom_jobs", "factloom_stages", "factloom_batches"
#: Column types by Spark's; text for others.
TYPES = {"double": "double precision", "float": "double precision", "bigint": "bigint", "int": "bigint", "date": "date", "boolean": "boolean", "timestamp": "timestamptz"}
_ROWS = 1000


@dataclass
class Staged(WriterCommitMessage):
    partition: int
    stage: str
    rows: int


class UpsertWriter(DataSourceWriter):
    """Options: table, connect (``module:name`` of a callable that takes dsn), dsn, placeholder (%s), job (a name of its own by default)."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.job = options, options.get("job") or uuid4().hex
        self.table, self.mark = table_name(options["table"]), options.get("placeholder", "%s")
        if schema.names[:1] != [ID]:
            raise ValueError(f"the first column is {ID}, the row's stable id")
        self.columns = [(f.name, TYPES.get(f.dataType.simpleString(), "text")) for f in schema.fields[1:] if f.name != AT]
        # columns of the staging tables that no column of the rows is called like
        self.order, self.latest = (next(k for n in range(len(schema) + 1) if (k := f"{name}_{n}") not in schema.names) for name in ("stage_order", "stage_latest"))

    @contextmanager
    def _cursor(self) -> Iterator[Any]:
        """One transaction."""
        module, name = self.options["connect"].split(":")
        connection = getattr(import_module(module), name)(self.options.get("dsn", ""))
        try:
            cursor = connection.cursor()
            yield cursor
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _marks(self, n: int) -> str:
        return ", ".join([self.mark] * n)

    def prepare(self) -> None:
        with self._cursor() as c:
            c.execute(f"CREATE TABLE IF NOT EXISTS {JOBS} (job text PRIMARY KEY, tasks bigint NOT NULL)")
            c.execute(f"CREATE TABLE IF NOT EXISTS {REGISTER} (job text NOT NULL, stage text NOT NULL)")
            c.execute(f"CREATE TABLE IF NOT EXISTS {BATCHES} (query text PRIMARY KEY, batch bigint NOT NULL)")
            c.execute(f"INSERT INTO {JOBS} (job, tasks) VALUES ({self._marks(2)}) ON CONFLICT (job) DO NOTHING", (self.job, 0))

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        stage, n = f"stage_{self.job[:12]}_{part}_{uuid4().hex[:8]}", 0
        with self._cursor() as c:
            names = ", ".join(f"{quote(k)} {kind}" for k, kind in self.columns)
            c.execute(f"CREATE TABLE {stage} ({self.order} bigint NOT NULL, {ID} text NOT NULL{', ' if names else ''}{names})")
            c.execute(f"INSERT INTO {REGISTER} (job, stage) VALUES ({self._marks(2)})", (self.job, stage))
            insert = f"INSERT INTO {stage} VALUES ({self._marks(len(self.columns) + 2)})"
            held: list[tuple] = []
            for row in iterator:
                if row[0] is None:
                    raise ValueError(f"a row has no {ID}")
                held.append((n, str(row[0]), *(row[k] for k, _ in self.columns)))
                n += 1
                if len(held) == _ROWS:
                    c.executemany(insert, held)
                    held = []
            if held:
                c.executemany(insert, held)
            # the job's row is locked till this commits; without it the job is over, and this task's table goes with the transaction
            c.execute(f"UPDATE {JOBS} SET tasks = tasks + 1 WHERE job = {self.mark}", (self.job,))
            if c.rowcount != 1:
                raise RuntimeError(f"job {self.job} is over")
        return Staged(part, stage, n)

    def _merge(self, c: Any, messages: list[WriterCommitMessage | None]) -> None:
        t, names = quote(self.table), [quote(k) for k, _ in self.columns]
        c.execute(f"CREATE TABLE IF NOT EXISTS {t} ({ID} text PRIMARY KEY, {AT} timestamptz NOT NULL DEFAULT CURRENT_TIMESTAMP)")
        c.execute(f"SELECT * FROM {t} WHERE 1 = 0")
        known = {d[0] for d in c.description}
        for k, kind in self.columns:  # additive: no column is ever dropped
            if k not in known:
                c.execute(f"ALTER TABLE {t} ADD COLUMN {quote(k)} {kind}")
        set_ = ", ".join(f"{n} = excluded.{n}" for n in [*names, AT])
        columns = ", ".join([ID, *names])
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            last = f"SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY {self.order} DESC) AS {self.latest} FROM {m.stage}"
            c.execute(f"INSERT INTO {t} ({columns}, {AT}) SELECT {columns}, CURRENT_TIMESTAMP FROM ({last}) AS s WHERE {self.latest} = 1 ON CONFLICT ({ID}) DO UPDATE SET {set_}")

    def _drop(self, c: Any) -> None:
        c.execute(f"DELETE FROM {JOBS} WHERE job = {self.mark}", (self.job,))
        c.execute(f"SELECT stage FROM {REGISTER} WHERE job = {self.mark}", (self.job,))
        for (stage,) in c.fetchall():
            c.execute(f"DROP TABLE IF EXISTS {stage}")
        c.execute(f"DELETE FROM {REGISTER} WHERE job = {self.mark}", (self.job,))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        with self._cursor() as c:
            self._merge(c, messages)
            self._drop(c)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        with self._cursor() as c:
            self._drop(c)


class UpsertStreamWriter(UpsertWriter, DataSourceStreamWriter):
    """query: the name under which its batches are kept. One writer serves many batches, so its job goes on after each."""

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        query = self.options["query"]
        with self._cursor() as c:
            c.execute(f"SELECT batch FROM {BATCHES} WHERE query = {self.mark}", (query,))
            seen = c.fetchone()
            if seen is None or seen[0] < batchId:
                self._merge(c, messages)
                c.execute(f"INSERT INTO {BATCHES} (query, batch) VALUES ({self._marks(2)}) ON CONFLICT (query) DO UPDATE SET batch = excluded.batch", (query, batchId))
            self._drop(c)
            c.execute(f"INSERT INTO {JOBS} (job, tasks) VALUES ({self._marks(2)})", (self.job, 0))

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        UpsertWriter.abort(self, messages)


class Upsert(DataSource):
    @classmethod
    def name(cls) -> str:
        return "upsert"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("an upsert adds and updates; it has no overwrite mode")
        made = UpsertWriter(dict(self.options), schema)
        made.prepare()
        return made

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        made = UpsertStreamWriter(dict(self.options), schema)
        made.prepare()
        return made


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Upsert)


def upsert(rows: DataFrame, table: str, connect: str, dsn: str, **options: str) -> None:
    """All rows (dm_id first) or none: what ``outbound.params`` gives can be written as it is."""
    register(rows.sparkSession)
    rows.write.format("upsert").options(table=table, connect=connect, dsn=dsn, **options).mode("append").save()


def sqlite(dsn: str) -> Any:
    """A connection to a file, for one machine and for tests (placeholder ?). Table definitions are part of its transactions."""
    import sqlite3

    return sqlite3.connect(dsn, timeout=60, autocommit=False)
