"""Reviews, extractions, answers, mail and loose functions on small worlds."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import loose
from factloom.functions import text as X
from factloom.operators import answer as A
from factloom.operators import extraction as E
from factloom.operators import knowledge as K
from factloom.operators import reviews as R
from factloom.functions.sections import split_text
from factloom.operators.search import named_in
from factloom.sources import mail

FACT = "id string, subject_id string, predicate string, object_id string, value_text string, value_num double, value_date date, unit string, cardinality string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, superseded_by string, source_item_id string, created_at timestamp_ntz"
ENTITY = "id string, kind string, label string, support int, created_at timestamp_ntz, merged_into string, natural_keys map<string,string>"


def fact(spark, rows):
    """(id, subject, predicate, object, text, valid_to, item)"""
    full = [(i, s, p, o, t, None, None, None, "one", 0.9, None, v, None, item, None) for i, s, p, o, t, v, item in rows]
    return spark.createDataFrame(full, FACT)


def world(spark):
    entities = spark.createDataFrame([("p1", "person", "Ada Stone", 1, None, None, {"email": "ada@x.org"}), ("p2", "person", "Ada S.", 1, None, "p1", {}), ("c1", "company", "Quarry Works", 2, None, None, {}), ("c2", "company", "Lone Mill", 1, None, None, {})], ENTITY)
    facts = fact(spark, [("f1", "p1", "works_at", "c1", None, None, "i1"), ("f2", "p1", "role", None, "engineer", None, "i1"), ("f3", "c1", "city", None, "Leeds", None, "i2"), ("f4", "p2", "nick", None, "ada", None, None)])
    return facts, entities


def test_view_and_stamps(spark):
    facts, entities = world(spark)
    shown, said = K.view(facts, entities)
    assert {r["id"]: r["edges"] for r in shown.collect()} == {"p1": 2, "c1": 2, "c2": 0}
    assert {(r["subject_id"], r["value"], r["ref"]) for r in said.collect()} >= {("p1", "Quarry Works", True), ("p1", "engineer", False)}
    items = spark.createDataFrame([("i1", '{"agent_id":"a7"}'), ("i2", '{"agent_id":"","routed_agent_id":"r2"}')], "id string, meta string")
    stamped = K.stamped(facts.withColumn("agent_id", F.lit(None).cast("string")), items)
    assert {r["id"]: r["agent_id"] for r in stamped.collect()} == {"f1": "a7", "f2": "a7", "f3": "r2", "f4": None}
    assert K.agent_lens(stamped, "a7").count() == 2
    assert [r["text"] for r in K.stale_embeddings(entities.where("id = 'p1'"), spark.createDataFrame([], "id string, embedding array<double>, model string"), "m").collect()] == ["person: Ada Stone (ada@x.org)"]


def test_search_answer_is_graph_first(spark):
    facts, entities = world(spark)
    passages = spark.createDataFrame([("c1", 0, "Quarry Works opened a new pit"), ("c2", 0, "nothing of quarry here"), ("p1", 1, "ada wrote this")], "entity_id string, seq int, text string")
    rows = spark.createDataFrame([("r1", {"name": "Quarry Works", "empty": ""}), ("r2", {"name": "Other"})], "id string, data map<string,string>")
    found = A.search(facts, entities, passages, ["quarry"], rows, {"name": "Name", "empty": "Empty"}, "Clients", answer=True)
    got = {r["n"]: r for r in found.evidence.collect()}
    assert sorted(got) == list(range(1, len(got) + 1))
    assert got[1]["line"].startswith('[1] Known company "Quarry Works": city Leeds')
    assert {r["type"] for r in got.values()} == {"entity", "row", "passage"}
    assert [r["line"].split("] ")[1] for r in got.values() if r["type"] == "row"] == ['Row in table "Clients": Name=Quarry Works']
    assert all(r["entity_id"] in ("c1", "p1") for r in got.values() if r["type"] == "passage")  # only within the neighbourhood
    plain = A.search(facts, entities, passages, ["quarry"])
    assert plain.evidence is None and {r["entity_id"] for r in plain.passages.collect()} == {"c1", "c2"}
    answers = spark.createDataFrame([("x", "so it is [2], and [1] [2]"), ("y", "no source")], "answer_id string, text string")
    sources = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 1)], "answer_id string, n int")
    assert [(r["answer_id"], r["n"]) for r in A.cited(answers, sources).orderBy("ord").collect()] == [("x", 2), ("x", 1)]
    assert [r["line"].split("\n")[0] for r in A.context(facts, entities, ["quarry"]).orderBy("ord").collect()][0] == "◆ Quarry Works (company)"
    assert A.context(facts, entities, ["leeds"]).collect()[0]["line"].startswith("◆ Quarry Works")


REVIEW = "id string, kind string, status string, confidence double, impact bigint, source_id string, target_id string, old_fact_id string, new_fact_id string, item_id string, detail map<string,string>, entity_ids array<string>, resolved_at timestamp_ntz"


def test_review_decisions(spark):
    facts, entities = world(spark)
    now = F.lit("2024-05-01").cast("timestamp_ntz")
    one = lambda *r: spark.createDataFrame([r], REVIEW)
    held = one("a", "fact_conflict", "pending", None, 1, None, None, "f2", "f3", None, {"held": "true"}, None, None)
    after = {r["id"]: (r["valid_to"] is None, r["superseded_by"]) for r in R.accept_conflicts(facts, held, now).collect()}
    assert after["f2"] == (False, "f3") and after["f3"] == (True, None)
    assert R.reject_conflicts(facts, held, now).exceptAll(facts).count() == 0
    sources = spark.createDataFrame([("f1", "i1"), ("f2", "i1"), ("f2", "i2"), ("f3", "i2")], "fact_id string, source_item_id string")
    left, kept = R.retract(facts, sources, one("b", "extraction", "pending", None, 1, None, None, None, None, "i1", {}, None, None))
    assert {r["id"] for r in left.collect()} == {"f2", "f3", "f4"} and kept.count() == 2
    prune = one("c", "orphan_prune", "pending", None, 2, None, None, None, None, None, {}, ["c1", "c2"], None)
    idle = entities.withColumn("has_body", F.lit(False)).withColumn("last_used_at", F.lit(None).cast("timestamp_ntz"))
    assert {r["id"] for r in R.accept_prunes(idle, facts, prune, now).collect()} == {"p1", "p2", "c1"}
    assert R.prunable(idle.withColumn("last_used_at", F.lit("2024-04-20").cast("timestamp_ntz")), facts, prune, now).count() == 0
    moved, ents = R.accept_merges(facts, entities, one("d", "entity_merge", "pending", 0.9, 1, "c2", "c1", None, None, None, {}, None, None))
    assert {r["id"]: r["merged_into"] for r in ents.collect()}["c2"] == "c1" and moved.count() == 4
    done = R.resolved(held, spark.createDataFrame([("a",)], "id string"), "accepted", now).collect()[0]
    assert done["status"] == "accepted" and done["resolved_at"] is not None


def test_extraction_contract(spark):
    ents = spark.createDataFrame([(1, 0, "a", "person", "Ada"), (1, 1, "b", "concept", "Person"), (1, 2, "c", "concept", "stone"), (1, 3, "d", "concept", "pits"), (1, 4, "e", "concept", "four"), (1, 5, "g", "concept", "five"), (1, 6, "h", "company", "Mill")], "extraction_id int, ord int, local_id string, kind string, label string")
    rows = [(1, 0, "a", "role", None, None, None, None, "engineer"), (1, 1, "a", "likes", "c", None, None, None, None), (1, 2, "a", "likes", "g", None, None, None, None), (1, 3, "a", "odd", None, 2.0, "kg", None, None), (1, 4, "zz", "role", None, None, None, None, "x")]
    facts = spark.createDataFrame(rows, "extraction_id int, ord int, subject string, predicate string, object string, num double, unit string, date string, text string").withColumn("confidence", F.lit(2.0)).withColumn("snippet", F.lit(None).cast("string"))
    kinds, words = spark.createDataFrame([("person",)], "name string"), spark.createDataFrame([("person", "role"), ("person", "likes")], "kind string, predicate string")
    kept, said, aside = E.restrained(ents, facts, kinds, words)
    assert {r["local_id"] for r in kept.collect()} == {"a", "c", "d", "e"}  # three concepts that don't name a kind; the company is untouched
    assert {r["ord"] for r in said.collect()} == {0, 1} and {r["ord"] for r in aside.collect()} == {3}
    shown = E.off_template_review(aside, ents, ents.select("extraction_id", F.lit("notes.txt").alias("doc_label")).distinct()).collect()[0]
    assert shown["n"] == 1 and shown["facts"][0]["value"] == "2.0 kg" and shown["doc_label"] == "notes.txt"
    found = [r["issue"] for r in E.issues(ents, facts).orderBy("ord").collect()]
    assert "facts.0.confidence" in found and len(found) == 5
    fine = facts.where("ord = 0").withColumn("confidence", F.lit(0.5))
    assert E.issues(ents, fine).count() == 0 and E.issues(ents, facts.where("ord = 4").withColumn("confidence", F.lit(0.5))).collect()[0]["issue"] == "facts.4.subjectLocalId"
    docs = spark.createDataFrame([("d1", "h", "a.pdf", "application/pdf", 10)], "id string, hash string, filename string, media string, size int")
    own, about = E.of_document(docs, spark.createDataFrame([("d1", "x", "person", "Ada")], "id string, local_id string, kind string, label string"))
    assert {r["local_id"] for r in own.collect()} == {"doc", "doc:x"} and {r["predicate"] for r in about.collect()} == {"file_type", "file_size", "mentions"}
    people = spark.createDataFrame([(1, "a", "person", "Ada Stone", {}), (1, "b", "person", "Bob", {})], "extraction_id int, local_id string, kind string, label string, natural_keys map<string,string>")
    keyed = E.with_sender(people, spark.createDataFrame([(1, "Ada Stone <ADA@x.org>")], "extraction_id int, sender string"))
    assert {r["local_id"]: r["natural_keys"] for r in keyed.collect()} == {"a": {"email": "ada@x.org"}, "b": {}}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0]["x"]
    assert [one(X.plural(F.lit(w))) for w in ("person", "city", "box", "day", "note")] == ["people", "cities", "boxes", "days", "notes"]
    assert one(X.active_mention(F.lit("hello @ad")))["query"] == "ad" and one(X.active_mention(F.lit("a@b"))) is None and one(X.active_mention(F.lit("@"))).start == 0
    assert one(X.active_mention(F.lit("hi @ada now"), 7))["query"] == "ada" and one(X.active_mention(F.lit("@a\nb"))) is None
    assert one(X.strip_mention(F.lit("hi @ada there"), F.lit(3), F.lit(7))) == "hi there"
    reply = lambda t, n: (lambda r: r and (r["index"], r["accept"]))(one(X.review_reply(F.lit(t), n)))
    assert [reply("1 yes", 2), reply("no 2", 2), reply("2n", 2), reply("yes", 1), reply("yes", 2), reply("3 yes", 2), reply("yes please do it right now", 1), reply("oui", 1)] == [(1, True), (2, False), (2, False), (1, True), None, None, None, (1, True)]
    assert one(X.transcript_body(F.lit(" s "), F.lit("t"))) == "s\n\n#### Transcript\n\nt" and one(X.transcript_body(F.lit(""), F.lit(" "))) is None
    assert "truncated" in one(X.transcript_body(F.lit(None).cast("string"), F.lit("x" * 9000)))
    shape = one(X.node_shape(F.lit("document"), F.lit("doc:1:a.webm"), F.lit("audio/x-own; q=1"), F.lit(None).cast("string"), F.lit("l")))
    assert shape["audio"] == "audio/webm" and shape["image"] is None
    assert one(X.node_shape(F.lit("bookmark"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(" HTTPS://x.org/a ")))["url"] == "HTTPS://x.org/a"


@pytest.mark.parametrize(("text", "want"), [
    ('{"a": 1}', {"a": 1}), ('So:\n```json\n{"a": [1, 2,],}\n```\nbye', {"a": [1, 2]}), ('prose {"a": "}{", "b": {"c": 1}} more {', {"a": "}{", "b": {"c": 1}}), ("[1, 2] tail", [1, 2]), ("none", None), ('{"a": "\\"}"}', {"a": '"}'}), (None, None), ("", None),
])
def test_loose_json(text, want):
    got = loose.loose_json(text)
    assert (json.loads(got) if got else None) == want


def test_registered_functions(spark):
    loose.register(spark)
    assert spark.sql("SELECT vault_strip_accents('éa') AS a, vault_fold_plural('boxes') AS b, vault_loose_json('x [1,]') AS c").collect()[0][:] == ("ea", "box", "[1]")
    spark.createDataFrame([("One. " * 400,)], "t string").createOrReplaceTempView("texts_to_chunk")
    assert spark.sql("SELECT seq, text FROM texts_to_chunk, LATERAL vault_chunk_text(t, 1200)").count() == len(split_text("One. " * 400))


def test_chunks_are_cut_past_forty_percent():
    text = "a" * 39 + ". " + "b" * 100
    assert split_text(text, 100)[0] == text[:100]  # the cut at 39 is too early
    text = "a" * 41 + ". " + "b" * 100
    assert split_text(text, 100)[0] == "a" * 41 + "."


def test_mail_and_blobs(spark):
    mails = spark.createDataFrame([(7, " ", "a@x", ["b@y"], "s", "t", None, "spf=pass; DMARC = Fail"), (8, "<m1>", "a@x", ["b@y"], "s", "t", None, "dmarc=pass"), (9, None, "a@x", None, None, None, None, None)], "uid int, message_id string, from_addr string, to_addrs array<string>, subject string, text string, html string, authentication_results string")
    kept = mail.accepted_mail(mails).withColumn("date", F.lit(None).cast("timestamp")).withColumn("attachments", F.lit(None).cast("array<string>"))
    assert {r["external_id"] for r in mail.envelopes_of_mail(kept, "imap").collect()} == {"imap:<m1>", "imap:uid-9"}
    blobs = spark.createDataFrame([(gzip.compress(b"abc"),), (b"plain",), (None,)], "c binary")
    assert [r["x"] and bytes(r["x"]) for r in blobs.select(mail.blob_content("c").alias("x")).collect()] == [b"abc", b"plain", None]
    long = spark.createDataFrame([(b"a" * 5000,)], "c binary").select(mail.stored_content("c").alias("s"))
    row = long.select("s", mail.blob_content("s").alias("x")).collect()[0]
    assert len(row["s"]) < 100 and bytes(row["x"]) == b"a" * 5000


def test_labels_in_long_texts(spark):
    texts = spark.createDataFrame([(1, "x" * 60_000 + " the Quarry Works "), (2, "quarry"), (3, None)], "text_id int, text string")
    labels = spark.createDataFrame([("a", "Quarry Works"), ("b", "qua"), ("c", "no")], "id string, label string")
    assert {tuple(r) for r in named_in(texts, labels).collect()} == {(1, "a"), (1, "b"), (2, "b")}


def test_centroids_fold_alike_however_they_are_cut(spark):
    import random

    from factloom.operators.resolve import fold_centroids

    rng, rows = random.Random(7), []
    for i in range(900):
        rows.append((rng.choice(["hot"] * 6 + ["a", "b", None]), None if i % 97 == 0 else [rng.random(), rng.random(), rng.random()] if i % 41 else [1.0], i % 50, f"{i:04d}"))
    rows += [("none", None, 1, "x"), ("none", [], 2, "y"), ("late", [1.0, 2.0], None, None), ("late", [3.0, 4.0], 1, "z")]
    want = {}
    for agent in {r[0] for r in rows}:
        mean, n = None, 0
        for _, v, _, _ in sorted((r for r in rows if r[0] == agent), key=lambda r: (r[2] is None, r[2] or 0, r[3] is None, r[3] or "")):
            if v and (mean is None or len(v) == len(mean)):
                w = min(n, 20)
                mean, n = (v if mean is None else [(m * w + x) / (w + 1) for m, x in zip(mean, v)]), n + 1
        want[agent] = (n, mean)
    df = spark.createDataFrame(rows, "agent_id string, embedding array<double>, created_at int, id string").repartition(5)
    for together in (0.05, 64):  # blocks of 50 places, or one
        got = {r["agent_id"]: (r["n"], r["centroid"]) for r in fold_centroids(df, 20, together).collect()}
        assert set(got) == set(want)
        for agent, (n, mean) in want.items():
            assert got[agent][0] == n and (got[agent][1] is None) == (mean is None)
            assert mean is None or got[agent][1] == pytest.approx(mean)
    loose.register(spark)
    df.createOrReplaceTempView("samples")
    by_sql = {r[0]: r[1] for r in spark.sql("SELECT agent_id, vault_centroid_fold(embedding, created_at, id) FROM samples WHERE agent_id IS NOT NULL GROUP BY 1").collect()}
    whole = {r["agent_id"]: r["centroid"] for r in fold_centroids(df).collect()}
    assert by_sql["hot"] == pytest.approx(whole["hot"]) and by_sql["none"] is None
