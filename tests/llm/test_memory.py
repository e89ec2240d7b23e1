"""What operators hold at once."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql.readwriter import DataFrameWriter

from factloom.llm import pitman_yor, token_counts
from factloom.llm._text import U64


def test_a_shard_that_answers_holds_few_bytes_a_cell():
    rng, n, d = np.random.default_rng(4), 200_000, 30_000
    names = np.unique(rng.integers(0, 1 << 48, d).astype(U64))
    x, v, w = (rng.integers(0, len(names), n) for _ in range(3))
    cells = pitman_yor.merged([[names, x, v, w, np.ones(n, np.int64)]])
    blob = pitman_yor.pack(np.diff(cells[0].view(np.int64), prepend=0), *cells[1:])
    layout = pitman_yor.Layout(np.zeros(0, U64), np.zeros(0, U64), 16)
    shard = pitman_yor.Shard(blob, layout)
    told = {q: pitman_yor.pack(*(np.ones(len(words), np.int64) for _ in range(2)), *(np.zeros(len(at), np.int64) for _ in range(2)), np.ones(len(words), np.int64)) for q, words, at in shard.receiving()}
    assert {getattr(shard, k).dtype for k in ("n", "r", "b", "own_at", "next_at", "hot_cell", "t", "t2")} == {np.dtype(np.int32)}
    state = pitman_yor.pack(shard.t, shard.t2)
    totals = pitman_yor.Totals((n, d), np.zeros((0, 2)), np.zeros((0, 2)), d)
    del shard
    tracemalloc.start()
    pitman_yor.Asked(blob, {0: state, 1: state}, {(k, q): b for k in (0, 1) for q, b in told.items()}, layout, [totals, totals], pitman_yor.Model())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 230 * n  # 302 a cell before the narrow arrays, 200 with them


def test_tables_of_blobs_close_row_groups_after_a_few(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "count", 0, rng.bytes(1 << 19), None, None, None) for k in range(24)]
    with pitman_yor._settings(spark):
        table = pitman_yor._bucketed(spark.createDataFrame(rows, pitman_yor._ROW).coalesce(1), 1)
        assert table.count() == 24 and {r["blob"] for r in table.collect()} == {r[3] for r in rows}
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert max(g.total_byte_size for g in groups) <= 5 << 20  # 12 MB in one before
    assert {g.column(j).compression for g in groups for j in range(g.num_columns)} == {"UNCOMPRESSED"}


def test_texts_are_read_and_counted_a_few_at_a_time(spark, tmp_path, monkeypatch):
    names, seen, write = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"), [], DataFrameWriter.parquet
    now = lambda: [int(spark.conf.get(k)) for k in names]

    def recorded(self, path, *args, **more):
        seen.append(now())
        return write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    before, path = now(), public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, f"text {i % 700} " * (i % 5)) for i in range(2000)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path, str(tmp_path / "cache"))
    assert now() == before and len(seen) == 3  # the empty cache, the counts, the rows' digests
    assert all(n <= 256 for at in seen[1:] for n in at)
    count = token_counts.counter(path)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {i: count(t) for i, t in rows}
