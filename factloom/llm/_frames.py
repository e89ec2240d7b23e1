"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows that are Python objects at once; texts stay in Arrow otherwise.
SLICE_ROWS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named and Spark is local, one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.conf.get("spark.master", "local") or "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings of the session hold within, for what runs there; then it has its own again."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def per_text(
    df: DataFrame,
    row_of: Callable[[str], tuple],
    fields: list[T.StructField],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The id column and row_of(text) for every row; a null text counts as ''.

    Ids pass through as they are, nulls and repeats included; other columns are
    not read, so their names cannot clash.
    """
    schema = T.StructType([df.schema[id_col], *fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                rows = [row_of(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, arrow(f.dataType)) for c, f in zip(zip(*rows), fields, strict=True))], names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def arrow(kind: T.DataType) -> pa.DataType:
    return {
        "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
        "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
    }[kind.simpleString()]


def filter_texts(df: DataFrame, keep: Callable[[str], bool], text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose text keep() accepts (null as '')."""
    at = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                yield part.filter(pa.array([keep(x or "") for x in part.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def string(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def double(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def boolean(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.BooleanType()) for n in names]
