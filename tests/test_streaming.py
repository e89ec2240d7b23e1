"""Streams over files that are there already, drained."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from factloom.streaming import ingest, queue


def test_repeats_are_captured_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"channel": "c", "external_id": "1", "org": "o", "text": "a", "received_at": "2024-01-01T00:00:00Z"}] * 2 + [{"channel": "c", "org": "o", "text": "b", "received_at": "2024-01-01T00:01:00Z"}, {"channel": "c", "org": "o", "text": "c", "received_at": "2024-01-01T00:01:00Z"}]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    ingest.drained(ingest.captured_once(ingest.envelope_stream(spark, str(source))).select("org", "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_claims_fold_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    schema = "claim_key string, fact_id string, observed_at timestamp, source_item_id string, value string, confidence double"
    at = datetime(2024, 1, 1)
    for n, (value, confidence) in enumerate([("red", 0.9), ("Red", 0.8), ("blue", 0.95), ("green", 0.3)]):
        spark.createDataFrame([("k", f"f{n}", at, f"s{n}", value, confidence)], schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    ingest.drained(ingest.folded_claims(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["fact_id"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == ["f0", "f1", "f2", "f3"] and "new" in got.values()


def test_windows(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1, 1), "a", 1.0, 1), (datetime(2024, 1, 1, 2), "a", 2.0, 1), (datetime(2024, 1, 2), "a", 4.0, 1)], "ts timestamp, event_type string, value double, user_id int")
    assert sorted(r["n"] for r in ingest.tumbling(e).collect()) == [1, 2]
    assert ingest.sessions(e, "90 minutes").count() == 2


def test_queue(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    rows = [("a", "stored", 0, datetime(2024, 1, 1, 1)), ("b", "failed", 2, datetime(2024, 1, 1, 0)), ("c", "failed", 3, datetime(2024, 1, 1, 0)), ("d", "analyzing", 3, datetime(2024, 1, 1, 0)), ("e", "analyzing", 1, datetime(2024, 1, 1, 11, 55))]
    items = spark.createDataFrame(rows, "id string, status string, attempts int, received_at timestamp_ntz")
    assert [r["id"] for r in queue.claimable(items).collect()] == ["b", "a"]
    assert {r["id"]: r["status"] for r in queue.recovered(items, now).collect()} == {"a": "stored", "b": "stored", "c": "failed", "d": "failed", "e": "analyzing"}
    taken = queue.claimed(items, queue.claimable(items, limit=1))
    assert {r["id"]: (r["status"], r["attempts"]) for r in taken.collect()}["b"] == ("analyzing", 3)
