"""The consolidation pass and the futures of reviews."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import consolidate as C
from factloom.operators import futures as U
from factloom.operators import reviews as R

FACT = "id string, subject_id string, predicate string, object_id string, value_text string, value_num double, value_date date, unit string, cardinality string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, superseded_by string, source_item_id string, created_at timestamp_ntz"
ENTITY = "id string, kind string, label string, support int, created_at timestamp_ntz, merged_into string, natural_keys map<string,string>, has_body boolean, last_used_at timestamp_ntz"
T0 = datetime(2023, 1, 1)


def now():
    return F.lit("2024-01-01").cast("timestamp_ntz")



def fact(i, subject, predicate, target=None, text=None, to=None, by=None):
    return (i, subject, predicate, target, text, None, None, None, "one", 0.9, T0, to, by, None, T0)


@pytest.fixture(scope="module")
def vault(spark):
    names = ["Quarry Works", "Quarry Work", "Quarrys Works", "Stone Mason", "Stone Masons", "Baker Street", "Baker Streets", "Alone Again", "Twin", "Twin"]
    ents = [(f"e{i}", "company", n, 1 + i % 2, T0, None, {"email": "a@x.org"} if i == 3 else {"email": "b@x.org"} if i == 4 else {}, False, None) for i, n in enumerate(names)]
    facts = [fact("f1", "e0", "town", text="Leeds"), fact("f2", "e0", "owns", "e3"), fact("f3", "e5", "owns", "e6"), fact("f4", "e8", "owns", "e9"), fact("f5", "e1", "owns", "e5")] + [fact(f"g{i}", f"e{i}", "motto", text="on") for i in range(4)]
    vectors = [("e7", "m", [1.0, 0.0]), ("e5", "m", [0.99, 0.05]), ("e0", "old", [1.0, 0.0])]
    feedback = [(f"v{i}", "a", "accept" if i % 2 else "reject", ["stone", f"t{i}"], [float(i), 1.0], datetime(2023, 1, 1 + i)) for i in range(6)]
    return C.Vault(
        spark.createDataFrame(facts, FACT), spark.createDataFrame(ents, ENTITY), spark.createDataFrame(vectors, "id string, model string, embedding array<double>"), spark.createDataFrame([("e6", "e5")], "source_id string, target_id string"),
        spark.createDataFrame([("company", "town", "town", "field")], "kind string, word string, canonical string, role string"), spark.createDataFrame([("person",)], "name string"),
        spark.createDataFrame(feedback, "event_id string, agent_id string, verdict string, terms array<string>, embedding array<double>, created_at timestamp_ntz"),
    )


def embedder(df):
    return df.select("id", F.array(F.lit(0.0), F.length("text").cast("double")).alias("embedding"))


def judge(pairs):
    return pairs.withColumn("confidence", F.when(F.col("sim") >= 0.999, 0.95).when(F.col("sim") > 0.6, 0.7).otherwise(0.1))


def job(spark, path, budget, embed=None, said=judge):
    return C.Consolidation(spark, str(path), "m", embed, said, budget)


def contents(j):
    return {s: sorted(map(repr, j.read(s).collect())) for s in C.STAGES}


@pytest.fixture(scope="module")
def whole(spark, vault, tmp_path_factory):
    j = job(spark, tmp_path_factory.mktemp("whole"), C.Budget(*[None] * 8))
    j.run(vault, now())
    return j


def test_one_pass_does_each_stage(whole, vault):
    decided = {(r["source_id"], r["target_id"]): r["status"] for r in whole.read("decide").collect()}
    pairs = {frozenset(k) for k in decided}
    assert frozenset(("e8", "e9")) in pairs and frozenset(("e5", "e7")) in pairs and frozenset(("e0", "e1")) in pairs
    assert frozenset(("e5", "e6")) not in pairs  # asked before
    assert frozenset(("e3", "e4")) not in pairs  # their addresses contradict
    assert [k for k, v in decided.items() if v == "accepted"] == [("e8", "e9")] or [k for k, v in decided.items() if v == "accepted"] == [("e9", "e8")]
    facts, entities = whole.merged(vault)
    assert entities.where("merged_into is not null").count() == 1
    assert {r["subject_id"] for r in whole.read("slots").collect()} == {f"e{i}" for i in range(1, 10)} - {next(k[0] for k, v in decided.items() if v == "accepted")}
    assert [(r["kind"], r["predicate"], r["count"]) for r in whole.read("fields").orderBy("predicate").collect()] == [("company", "motto", 4), ("company", "owns", 4)]
    assert [r["kind"] for r in whole.read("categories").collect()] == ["company"]
    assert {r["id"] for r in whole.read("orphans").collect()} == {"e4"}  # e7 has support
    assert whole.read("routing").count() == 6


def test_small_budgets_come_to_the_same_in_two_passes(spark, vault, whole, tmp_path):
    """The first pass breaks in the middle and goes on without asking again."""
    asked = []

    def counted(pairs):
        asked.append(1)
        return judge(pairs)

    n = whole.read("decide").count()
    j = job(spark, tmp_path, C.Budget(embed=1, pairs=n, decide=n - 1, slots=5, fields=1, categories=1, orphans=1, routing=4), said=counted)
    kept, j._slots = j._slots, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        j.run(vault, now())
    j._slots = kept
    assert j.next_pass() == 0
    first = j.run(vault, now())
    assert len(asked) == 1 and j.next_pass() == 1
    assert (first["decide"], first["slots"], first["fields"], first["routing"]) == (n - 1, 5, 1, 4)
    j.run(vault, now())
    pairs = lambda x: {(frozenset((r["source_id"], r["target_id"])), r["status"]) for r in x.read("decide").collect()}
    assert pairs(j) == pairs(whole)
    for s in ("fields", "routing", "orphans", "categories", "slots"):
        assert contents(j)[s] == contents(whole)[s]
    (terms, centroids), (all_terms, all_centroids) = j.learned(vault), whole.learned(vault)
    assert sorted(map(repr, terms.collect())) == sorted(map(repr, all_terms.collect())) and centroids.collect() == all_centroids.collect()
    assert centroids.first()["n"] == 3


def test_embeddings_are_filled_in_and_used(spark, vault, tmp_path):
    j = job(spark, tmp_path, C.Budget(*[None] * 8), embedder, None)
    j.run(vault, now())
    assert {r["id"] for r in j.read("embed").collect()} == {f"e{i}" for i in range(10)} - {"e5", "e7"}
    assert all(r["status"] in ("pending", "rejected") for r in j.read("decide").collect())  # nothing merges where no model judges


REVIEW = "id string, kind string, status string, confidence double, impact bigint, source_id string, target_id string, old_fact_id string, new_fact_id string, item_id string, detail map<string,string>, entity_ids array<string>, resolved_at timestamp_ntz"


def review(i, kind, source=None, target=None, old=None, new=None, held=False, ids=None):
    return (i, kind, "pending", None, 1, source, target, old, new, None, {"held": "true"} if held else {}, ids, None)


def test_futures_are_what_acceptance_makes(spark, vault):
    facts = vault.facts.unionByName(spark.createDataFrame([fact("c1", "e5", "seat", "e0", to=T0, by="c2"), fact("c2", "e5", "seat", "e3"), fact("h1", "e6", "seat", "e0"), fact("h2", "e6", "seat", "e3", to=T0)], FACT))
    rows = [review("m", "entity_merge", "e1", "e0"), review("self", "entity_merge", "e5", "e1"), review("c", "fact_conflict", old="c1", new="c2"), review("h", "fact_conflict", old="h1", new="h2", held=True), review("o", "orphan_prune", ids=["e4", "e3"])]
    reviews = spark.createDataFrame(rows, REVIEW)
    got = {}
    for r in U.future_facts(reviews, facts, now()).collect():
        got.setdefault((r["review_id"], r["future"]), set()).add(tuple(r[c] for c in facts.columns))

    def touching(f, *ids):
        return {tuple(r) for r in f.where(F.col("subject_id").isin(*ids) | F.col("object_id").isin(*ids)).select(facts.columns).collect()}

    for r, center, ids in (("m", "e0", ["e0", "e1"]), ("self", "e1", ["e1", "e5"])):
        one = reviews.where(F.col("id") == r)
        assert got[r, "accept"] == touching(R.accept_merges(facts, vault.entities, one)[0], center)
        assert got[r, "refuse"] == touching(facts, *ids)
    for r, subject in (("c", "e5"), ("h", "e6")):
        one = reviews.where(F.col("id") == r)
        assert got[r, "accept"] == touching(R.accept_conflicts(facts, one, now()), subject)
        assert got[r, "refuse"] == touching(R.reject_conflicts(facts, one, now()), subject)
    left = {r["id"] for r in R.accept_prunes(vault.entities, facts, reviews, now()).collect()}
    there = {(r["future"], r["id"]) for r in U.future_entities(reviews, facts, vault.entities).where("review_id = 'o'").collect()}
    assert there == {("accept", i) for i in ("e3", "e4") if i in left} | {("refuse", "e3"), ("refuse", "e4")} and ("accept", "e4") not in there
    shown = {(r["review_id"], r["future"], r["id"], r["outgoing"]) for r in U.preview(reviews, facts, vault.entities, now()).collect()}
    assert ("m", "accept", "e5", True) in shown and ("m", "refuse", "e5", True) not in shown
    assert ("h", "accept", "e3", True) in shown and ("h", "refuse", "e0", True) in shown
    assert ("self", "accept", "e1", True) not in shown
