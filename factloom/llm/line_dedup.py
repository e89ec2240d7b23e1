"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines has a digest. A digest met twice or more
anywhere is a repeat; each occurrence but the first, in the order of id, text
digest and position, is later. The lines that later occurrences cover are
merged and removed, so a passage goes as a whole and no line is judged by
itself.

Defined cases: a null text counts as empty; texts of fewer than three lines,
and windows without a word, are left alone; rows with equal id and text are one
document and share its outcome; null ids come first; an empty table gives an
empty result. Other columns pass through as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import written

WIDTH = 3


def _key(id_col: str, text_col: str):
    """Names a document: its id and its text's digest; orders by id, then digest."""
    return F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("digest"))


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, at): for each document with later occurrences, the first lines (from 0) of their windows, sorted."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    docs = docs.select(_key(id_col, text_col).alias("key"), lines.alias("lines")).where(F.size("lines") >= WIDTH)
    window = lambda i: F.array_join(F.slice("lines", i + 1, WIDTH), "\n")
    digests = F.transform(F.sequence(F.lit(0), F.size("lines") - WIDTH), lambda i: F.when(F.length(F.regexp_replace(window(i), r"[\x20\x09-\x0D]+", "")) > 0, F.unhex(F.md5(window(i).cast("binary")))))
    met = written(docs.select("key", F.posexplode(digests).alias("at", "digest")).where("digest is not null"))  # without the texts; read twice
    repeats = met.groupBy("digest").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = met.join(repeats, "digest").where(F.struct("key", "at") > F.col("first"))
    return later.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("at"))


def covered_lines(at: list[int]) -> set[int]:
    return {i + k for i in at for k in range(WIDTH)}


def without(text: str, at: list[int] | None) -> tuple[str, int, int]:
    """The text without the lines that the windows at ``at`` cover, its lines, and how many went."""
    lines = text.split("\n")
    if not at:
        return text, len(lines), 0
    gone = covered_lines(at)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs, all columns, with later repeats gone from the text.

    counts: names of two further columns, the lines before and how many were removed.
    """
    names = [f"__line_{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)  # whatever the columns are called, nothing clashes
    key = _key(names[docs.columns.index(id_col)], names[docs.columns.index(text_col)])
    later = later_windows(docs, id_col, text_col).select(F.col("key.id").alias("later_id"), F.col("key.digest").alias("later_digest"), "at")
    joined = inner.withColumn("key", key).join(later, (F.col("key.digest") == F.col("later_digest")) & F.col("key.id").eqNullSafe(F.col("later_id")), "left").select(*names, "at")
    text_at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in counts or ())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                columns = part.columns
                texts = columns[text_at].to_pylist()
                done = [without(x or "", at) for x, at in zip(texts, columns.pop().to_pylist(), strict=True)]
                columns[text_at] = pa.array([None if x is None else d[0] for x, d in zip(texts, done, strict=True)], columns[text_at].type)
                if counts:
                    columns += [pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(run, schema)


def line_dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_lines, n_removed, and the MD5 of what is left."""
    out = dedup_lines(docs.select(id_col, text_col), id_col, text_col, ("n_lines", "n_removed"))
    return out.select(id_col, "n_lines", "n_removed", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("kept_md5"))


#: DuckDB SQL for line_dedup_digests over documents.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
one AS (SELECT DISTINCT * FROM d),
w AS (
  SELECT doc_id, digest, lines, i AS pos, md5(lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2]) AS h
  FROM (SELECT *, unnest(range(1, len(lines) - 1)) AS i FROM one WHERE len(lines) >= 3)
  WHERE regexp_matches(lines[i] || lines[i + 1] || lines[i + 2], '[^\x20\x09-\x0D]')
),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, digest, pos) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, digest, pos + k AS line FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
l AS (SELECT doc_id, digest, unnest(lines) AS x, unnest(range(1, len(lines) + 1)) AS line FROM one),
kept AS (
  SELECT l.doc_id, l.digest, count(*) AS n_lines, count(g.line) AS n_removed,
    md5(coalesce(string_agg(l.x, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '')) AS kept_md5
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.digest = g.digest AND l.line = g.line
  GROUP BY l.doc_id, l.digest
)
SELECT d.doc_id, n_lines, n_removed, kept_md5 FROM d JOIN kept k ON d.doc_id = k.doc_id AND d.digest = k.digest
"""
