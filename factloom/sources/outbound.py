"""Outbound sync: the statements of an idempotent, additive upsert, and a partition-wise writer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import sync_number
from ..operators.tables import ColumnDef

ID, AT = "dm_id", "dm_synced_at"


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def table_name(name: str) -> str:
    """Lower case, word characters, at most 63; a leading digit gets a t."""
    s = re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", name.lower())) or "table"
    return ("t" + s if s[0].isdigit() else s)[:63]


def sql_type(kind: str) -> str:
    return {"number": "double precision", "date": "date"}.get(kind, "text")


@dataclass(frozen=True)
class Plan:
    create: str
    add_columns: tuple[str, ...]
    upsert: str
    keys: tuple[str, ...]


def plan(table: str, columns: list[ColumnDef]) -> Plan:
    """Creates the table, adds missing columns (never drops one), upserts by the row's stable id."""
    own = [c for c in columns if c.key not in (ID, AT)]
    t, names = quote(table_name(table)), [quote(c.key) for c in own]
    set_ = ", ".join(f"{n} = excluded.{n}" for n in [*names, AT])
    return Plan(
        f"CREATE TABLE IF NOT EXISTS {t} ({ID} text PRIMARY KEY, {AT} timestamptz NOT NULL DEFAULT now())",
        tuple(f"ALTER TABLE {t} ADD COLUMN IF NOT EXISTS {n} {sql_type(c.type)}" for n, c in zip(names, own, strict=True)),
        f"INSERT INTO {t} ({', '.join([ID, *names, AT])}) VALUES ({', '.join(['%s'] * (len(names) + 1))}, now()) ON CONFLICT ({ID}) DO UPDATE SET {set_}",
        tuple(c.key for c in own),
    )


def params(rows: DataFrame, columns: list[ColumnDef], data: str = "data", id_col: str = "id") -> DataFrame:
    """The upsert's parameters in order, typed: junk in number and date columns is null."""
    def cell(c: ColumnDef) -> Column:
        x = F.element_at(F.col(data), c.key)
        if c.type == "number":
            return sync_number(x)
        return F.substring(x, 1, 10).try_cast("date") if c.type == "date" else F.nullif(x, F.lit(""))

    return rows.select(F.col(id_col).cast("string").alias(ID), *(cell(c).alias(c.key) for c in columns if c.key not in (ID, AT)))


Connect = Callable[[], object]


def push(rows: DataFrame, statement: str, connect: Connect, batch: int = 1000) -> None:
    """Every partition upserts its own rows by a connection of its own; a retried task writes the same rows again."""
    def write(part: Iterable) -> None:
        connection = connect()
        try:
            for chunk in _batches(iter(part), batch):
                cursor = connection.cursor()
                cursor.executemany(statement, [tuple(r) for r in chunk])
                connection.commit()
        finally:
            connection.close()

    rows.foreachPartition(write)


def _batches(rows: Iterator, n: int) -> Iterator[list]:
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held
