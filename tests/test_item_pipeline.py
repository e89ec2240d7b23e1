"""The item pipeline, claims of the queue, and feedback by timers."""

import json
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators.storage import BatchTable, Conflict, VersionedTable, create_once
from factloom.streaming import feedback, queue
from factloom.streaming.pipeline import RAW_ENTITIES, RAW_FACTS, TABLES, Catalogue, ItemPipeline

ITEM = "id string, channel string, sender string, subject string, body string, received_at timestamp, meta string, has_attachments boolean"


def item(i, body, sender="Ann Lee <ann@x.org>", meta="{}", day=1):
    return (i, "mail", sender, None, body, datetime(2024, 1, day), meta, False)


def extractor(prompts):
    """Says of 'NAME pays AMOUNT to COMPANY' what it says; fails the test if it is asked of an acknowledgement."""
    p = prompts.withColumn("m", F.expr(r"regexp_extract_all(text, '(\\w+) pays (\\d+) to (\\w+)', 0)")).where("size(m) > 0")
    part = lambda k: F.regexp_extract("text", r"(\w+) pays (\d+) to (\w+)", k)
    none = F.lit(None).cast("string")
    entity = lambda n, local, kind, k: p.select("extraction_id", F.lit(n).alias("ord"), F.lit(local).alias("local_id"), F.lit(kind).alias("kind"), part(k).alias("label"), none.alias("email"), none.alias("phone"), none.alias("invoice_no"))
    ents = entity(0, "p", "person", 1).unionByName(entity(1, "c", "company", 3))
    fact = lambda n, predicate, kind, number=F.lit(None), target=none, text=none: p.select(
        "extraction_id", F.lit(n).alias("ord"), F.lit("p").alias("subject"), F.lit(predicate).alias("predicate"), F.lit(kind).alias("value_type"), number.cast("double").alias("value_number"), none.alias("value_date"), target.alias("value_entity"), text.alias("value_text"),
        none.alias("unit"), F.lit("one").alias("cardinality"), F.lit(0.9).alias("confidence"), F.regexp_extract("text", r"\w+ pays \d+", 0).alias("snippet"))
    return ents, fact(0, "pays", "number", part(2)).unionByName(fact(1, "pays_to", "entity", target=F.lit("c"))).unionByName(fact(2, "mood", "text", text=F.lit("glad")))


def pipeline(spark, path, said=extractor):
    agents = spark.createDataFrame([("a1", "Payments", "who pays which company"), ("a2", "Gardens", "trees and flowers")], "agent_id string, name string, purpose string")
    vocabulary = spark.createDataFrame([("person", "pays"), ("person", "pays_to")], "kind string, predicate string")
    declared = spark.createDataFrame([("person", "pays", False)], "kind string, word string, many boolean")
    return ItemPipeline(spark, str(path), Catalogue(agents, spark.createDataFrame([("person",), ("company",)], "name string"), vocabulary, declared), said)


def contents(p):
    return {name: sorted(map(repr, p.read(name).collect())) for name in TABLES}


FIRST = [item("i1", "Ann pays 100 to Acme"), item("i2", "thanks!"), item("i3", "flowers please, 2 trees", meta=json.dumps({"agent_id": "a2"})), item("bad", "Bob pays 5 to Acme")]


def with_one_bad(prompts):
    ents, facts = extractor(prompts)
    return ents, facts.withColumn("predicate", F.when(F.col("extraction_id") == "bad", F.repeat(F.lit("x"), 90)).otherwise(F.col("predicate")))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Two batches as a stream; the second repeats an item."""
    path = tmp_path_factory.mktemp("vault")
    for n, rows in enumerate((FIRST, [item("i4", "Ann pays 250 to Acme", day=2), FIRST[0]])):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").json(str(path / "in"))
        stream = spark.readStream.schema(ITEM).json(str(path / "in"))
        p = pipeline(spark, path / "vault", with_one_bad)
        stream.writeStream.foreachBatch(p).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert p.tables["items"].last() == 1
    return p


def test_items_become_facts(run):
    items = {r["id"]: (r["status"], r["agent_id"], r["error"]) for r in run.read("items").collect()}
    assert set(items) == {"i1", "i2", "i3", "i4", "bad"} and items["i3"][:2] == ("analyzed", "a2") and items["i2"][:2] == ("analyzed", None)
    assert items["i1"][1] == "a1"  # routed by its words
    assert items["bad"][0] == "failed" and "predicate" in items["bad"][2] and items["i1"][2] is None
    names = {r["label"]: r["id"] for r in run.known_entities(None).collect()}
    assert set(names) == {"Ann", "Acme"}
    facts = {(r["predicate"], r["said"]): r for r in run.facts().collect()}
    assert facts["pays", "100.0"]["valid_to"] == datetime(2024, 1, 2) and facts["pays", "250.0"]["valid_to"] is None
    assert facts["pays_to", "c"]["object_id"] == names["Acme"] and facts["pays_to", "c"]["sources"] == 2
    assert {r["agent_id"] for r in run.read("observations").collect()} == {"a1"} and all(r["grounded"] for r in run.read("observations").collect())
    assert {r["item_id"] for r in run.read("chunks").collect()} == {"i1", "i3", "i4", "bad"}
    reviews = {(r["kind"], r["item_id"]) for r in run.read("reviews").collect()}
    assert reviews == {("extraction", "i1"), ("extraction", "i4"), ("off_template", "i1"), ("off_template", "i4")}


def never(prompts):
    raise AssertionError("asked again")


def test_a_batch_run_twice_changes_nothing(spark, run):
    before = contents(run)
    again = ItemPipeline(spark, run.tables["items"].path.rsplit("/", 1)[0], run.catalogue, never)
    again(spark.createDataFrame([item("i4", "Ann pays 250 to Acme", day=2), FIRST[0]], ITEM), 1)
    assert contents(again) == before


def test_a_batch_that_broke_goes_on(spark, run, tmp_path):
    p = pipeline(spark, tmp_path, with_one_bad)
    p._observed = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    first = spark.createDataFrame(FIRST, ITEM)
    with pytest.raises(RuntimeError):
        p(first, 0)
    pipeline(spark, tmp_path, never)(first, 0)  # what was said stays
    whole = {name: sorted(map(repr, run.read(name, only=0).collect())) for name in TABLES}
    assert contents(p) == whole


def test_files_are_created_once(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append((k, create_once(spark, f"{tmp_path}/log/1.json", f"{k}")))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [k for k, mine in won if mine]
    assert (tmp_path / "log" / "1.json").read_text() == str(winner)
    assert not create_once(spark, f"file://{tmp_path}/log/1.json", "late")


def test_two_writers_of_a_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path))
    t.write(spark.range(1).toDF("a"), "ann")
    assert t.write(spark.range(2).toDF("a"), "ann", expected=1) == 2
    with pytest.raises(Conflict):
        t.write(spark.range(3).toDF("a"), "bob", expected=1)
    assert t.last() == 2 and t.read().count() == 2
    calls = []

    def change(df):
        if not calls:
            t.write(df, "other")  # comes between
        calls.append(df.count())
        return df.union(df)

    assert t.update(change, "bob") == 4 and len(calls) == 2 and t.read().count() == 4


def test_claims_are_not_shared(spark, tmp_path):
    items = spark.createDataFrame([(f"i{k}", "stored", 0, datetime(2024, 1, 1, k)) for k in range(8)], "id string, status string, attempts int, received_at timestamp_ntz").cache()
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    taken, barrier = {}, threading.Barrier(3)

    def work(name):
        barrier.wait()
        taken[name] = queue.ClaimLog(spark, str(tmp_path)).claim(items, name, now, 2)

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(sum(taken.values(), [])) == [f"i{k}" for k in range(6)]  # each two, the oldest, none twice
    log = queue.ClaimLog(spark, str(tmp_path))
    log.finish(taken["w0"], "w0", now)
    log.finish(taken["w1"], "w1", now, "failed")
    state = {r["id"]: (r["status"], r["attempts"]) for r in log.state(items, now).collect()}
    assert all(state[i] == ("done", 1) for i in taken["w0"]) and all(state[i] == ("stored", 1) for i in taken["w1"]) and all(state[i] == ("analyzing", 1) for i in taken["w2"])
    later = F.lit("2024-01-02 00:30:00").cast("timestamp_ntz")
    assert sorted(log.claim(items, "w3", later, 10)) == sorted([*taken["w1"], *taken["w2"], "i6", "i7"])


def test_batches_are_numbered_once(spark, tmp_path):
    t = BatchTable(spark, str(tmp_path), "a bigint")
    assert t.read().count() == 0 and t.last() == -1
    assert t.write(spark.range(2).toDF("a"), 0) and not t.write(spark.range(9).toDF("a"), 0) and t.write(spark.range(3).toDF("a"), 1)
    assert t.read().count() == 5 and t.read(before=1).count() == 2 and t.read(only=1).count() == 3 and t.last() == 1


def test_silence_is_consent_after_a_day(spark, tmp_path):
    routed = "item_id string, agent_id string, subject string, preview string, at timestamp"
    verdict = "item_id string, agent_id string, verdict string, at timestamp"
    day = lambda d, h=0: datetime(2024, 1, d, h)
    steps = [
        ([("quiet", "a", "s", "long enough text", day(1)), ("judged", "a", "s", "long enough text", day(1)), ("short", "a", "", "hi", day(1)), ("late", "a", "s", "long enough text", day(1))], []),
        ([("quiet", "a", "s", "long enough text", day(1, 1))], [("judged", "b", "reject", day(1, 5))]),
        ([("other", "a", "s", "long enough text", day(3))], []),
        ([("other2", "a", "s", "long enough text", day(3, 1))], [("late", "a", "reject", day(3))]),
        ([("other3", "a", "s", "long enough text", day(3, 2))], []),
    ]
    for n, (items, verdicts) in enumerate(steps):
        spark.createDataFrame(items, routed).coalesce(1).write.json(str(tmp_path / "items" / f"d={n}"))
        spark.createDataFrame(verdicts, verdict).coalesce(1).write.json(str(tmp_path / "verdicts" / f"d={n}"))

    def drain(n):
        """The stream up to step n."""
        i = spark.readStream.schema(routed).json(str(tmp_path / "in_items"))
        v = spark.readStream.schema(verdict).json(str(tmp_path / "in_verdicts"))
        q = feedback.feedback_events(i, v).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r["item_id"], r["agent_id"], r["verdict"], r["source"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    import shutil

    for name in ("in_items", "in_verdicts"):
        (tmp_path / name).mkdir()
    for n in range(len(steps)):
        for name in ("items", "verdicts"):
            for k, f in enumerate((tmp_path / name / f"d={n}").glob("*.json")):
                shutil.copy(f, tmp_path / f"in_{name}" / f"{n}-{k}.json")
        got = drain(n)
    assert got == {("quiet", "a", "accept", "implicit"), ("judged", "b", "reject", "explicit"), ("late", "a", "accept", "implicit")}
