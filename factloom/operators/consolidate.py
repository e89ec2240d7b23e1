"""The consolidation pass as one budgeted, resumable job over a whole vault.

A pass has stages, each with a budget and a table of numbered batches: vectors
that are missing, candidate pairs, decisions on the most alike of them, empty
template slots, fields that templates lack, categories, orphans, and what
routing learns from feedback. A stage reads the vault and what passes have
written so far, takes what its budget allows, in a fixed order, and writes one
batch. What is over stays undone and is found by the next pass; what was decided
is never asked again. A pass that stopped goes on with its first stage that has
no batch, and stages that have one are neither run nor asked again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .facts import current, edge_counts, has_value, live
from .knowledge import stale_embeddings
from .ontology import category_proposals, field_proposals, health_facts, missing_slots
from .resolve import filter_pairs, fold_centroids, label_pairs, learn_terms, merge_entities, nearest_pairs, orphans, winners
from .storage import BatchTable
from .vector_index import build

TABLES = {
    "embed": "id string, model string, embedding array<double>",
    "pairs": "a_id string, b_id string, sim double",
    "decide": "source_id string, target_id string, sim double, confidence double, status string",
    "slots": "subject_id string, predicate string",
    "fields": "kind string, predicate string, count bigint, value_type string, unit string, alias_of string, as_relation boolean",
    "categories": "kind string, count bigint, samples string",
    "orphans": "id string, kind string, label string",
    "routing": "event_id string",
}
STAGES = tuple(TABLES)


@dataclass(frozen=True)
class Budget:
    """The most that a pass does of each; None for all there is."""

    embed: int | None = 50
    pairs: int | None = 40
    decide: int | None = 12
    slots: int | None = 1000
    fields: int | None = None
    categories: int | None = None
    orphans: int | None = None
    routing: int | None = 200


@dataclass
class Vault:
    """What a pass reads. entities: with natural_keys, support, created_at, has_body and last_used_at; vectors: id, model,
    embedding; reviews: source_id, target_id of merges asked before; vocabulary and names: of the registry; feedback:
    event_id, agent_id, verdict, terms (array), embedding, created_at."""

    facts: DataFrame
    entities: DataFrame
    vectors: DataFrame
    reviews: DataFrame
    vocabulary: DataFrame
    names: DataFrame
    feedback: DataFrame


def cautious(sim: Column) -> Column:
    """The confidence where no model judges: clear likeness is proposed, never merged by itself."""
    return F.when(sim >= 0.75, F.least(sim, F.lit(0.84))).otherwise(0.0)


class Consolidation:
    """Passes over one vault, kept under path.

    embed: from (id, text) to (id, embedding), or None; judge: from pairs
    (a_id, b_id, winner, loser, sim) to the same with a confidence.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, embed: Callable[[DataFrame], DataFrame] | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, budget: Budget = Budget(), auto: float = 0.85, propose: float = 0.55, label_floor: float = 0.55, vector_floor: float = 0.85):
        self.spark, self.model, self.embed, self.budget = spark, model, embed, budget
        self.judge = judge or (lambda pairs: pairs.withColumn("confidence", cautious(F.col("sim"))))
        self.auto, self.propose, self.label_floor, self.vector_floor = auto, propose, label_floor, vector_floor
        self.tables = {name: BatchTable(spark, f"{path.rstrip('/')}/{name}", schema) for name, schema in TABLES.items()}

    def read(self, stage: str) -> DataFrame:
        """What all passes have done of a stage."""
        return self.tables[stage].read()

    def next_pass(self) -> int:
        """The pass that is under way, or the one after the last."""
        return self.tables[STAGES[-1]].last() + 1

    def run(self, vault: Vault, now: Column) -> dict[str, int]:
        """One pass, from where it stopped; the rows of each stage."""
        n = self.next_pass()
        done = {}
        for stage in STAGES:
            if not self.tables[stage].has(n):
                self.tables[stage].write(getattr(self, f"_{stage}")(vault, n, now), n)
            done[stage] = self.tables[stage].read(only=n).count()
        return done

    def merged(self, vault: Vault) -> tuple[DataFrame, DataFrame]:
        """(facts, entities) after the merges that passes made by themselves."""
        merges = self.read("decide").where("status = 'accepted'").select(F.col("source_id").alias("loser"), F.col("target_id").alias("winner"))
        return merge_entities(vault.facts, vault.entities, merges)

    def _first(self, df: DataFrame, stage: str, *order: Column | str) -> DataFrame:
        most = {f.name: getattr(self.budget, f.name) for f in fields(Budget)}[stage]
        return df if most is None else df.orderBy(*order).limit(most)

    def _vectors(self, vault: Vault) -> DataFrame:
        return vault.vectors.select("id", "model", "embedding").unionByName(self.read("embed"))

    def _embed(self, vault: Vault, n: int, now: Column) -> DataFrame:
        if self.embed is None:
            return self.spark.createDataFrame([], TABLES["embed"])
        stale = stale_embeddings(self.merged(vault)[1], self._vectors(vault), self.model)
        made = self.embed(self._first(stale, "embed", "id"))
        return made.select("id", F.lit(self.model).alias("model"), F.col("embedding").cast("array<double>").alias("embedding"))

    def _pairs(self, vault: Vault, n: int, now: Column) -> DataFrame:
        """Labels and vectors that are alike, in one direction, not asked before and without contradicting keys; the most alike first."""
        entities = live(self.merged(vault)[1])
        ids = entities.select("id", "kind", "label")
        by_label = label_pairs(entities, self.label_floor)
        x, y = (ids.select("kind", F.col("label").alias(k), F.col("id").alias(i)) for k, i in (("x", "a_id"), ("y", "b_id")))
        alike = by_label.join(x, ["kind", "x"]).join(y, ["kind", "y"]).select("a_id", "b_id", "sim")
        # equal labels make no pair of labels: their entities meet the least of them
        same = ids.groupBy("kind", "label").agg(F.min("id").alias("a_id"), F.count("*").alias("n")).where("n > 1").join(ids, ["kind", "label"]).where("id <> a_id").select("a_id", F.col("id").alias("b_id"), F.lit(1.0).alias("sim"))
        vectors = self._vectors(vault).where(F.col("model") == self.model).join(entities.select("id", "kind"), "id")
        near = nearest_pairs(vectors, build(vectors), self.vector_floor)
        asked = vault.reviews.select("source_id", "target_id").unionByName(self.read("decide").select("source_id", "target_id"))
        asked = asked.select(F.col("source_id").alias("a_id"), F.col("target_id").alias("b_id"))
        found = filter_pairs(alike.unionByName(same).unionByName(near), asked, entities)
        return self._first(found, "pairs", F.desc("sim"), "a_id", "b_id")

    def _decide(self, vault: Vault, n: int, now: Column) -> DataFrame:
        pairs = self._first(self.tables["pairs"].read(only=n), "decide", F.desc("sim"), "a_id", "b_id")
        facts, entities = self.merged(vault)
        edges = edge_counts(facts.where(has_value()))
        known = entities.join(edges, "id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
        chosen = winners(pairs, known).select(F.least("winner", "loser").alias("a_id"), F.greatest("winner", "loser").alias("b_id"), "winner", "loser")
        judged = self.judge(pairs.join(chosen, ["a_id", "b_id"]))
        status = F.when(F.col("confidence") >= self.auto, "accepted").when(F.col("confidence") >= self.propose, "pending").otherwise("rejected")
        return judged.select(F.col("loser").alias("source_id"), F.col("winner").alias("target_id"), "sim", "confidence", status.alias("status"))

    def _slots(self, vault: Vault, n: int, now: Column) -> DataFrame:
        facts, entities = self.merged(vault)
        empty = missing_slots(entities, facts, vault.vocabulary).join(self.read("slots"), ["subject_id", "predicate"], "left_anti")
        return self._first(empty, "slots", "subject_id", "predicate")

    def _fields(self, vault: Vault, n: int, now: Column) -> DataFrame:
        facts, entities = self.merged(vault)
        found = field_proposals(health_facts(facts, entities), vault.vocabulary).join(self.read("fields").select("kind", "predicate"), ["kind", "predicate"], "left_anti")
        return self._first(found, "fields", F.desc("count"), "kind", "predicate").select("kind", "predicate", "count", "value_type", "unit", "alias_of", "as_relation")

    def _categories(self, vault: Vault, n: int, now: Column) -> DataFrame:
        found = category_proposals(self.merged(vault)[1], vault.names, self.read("categories").select("kind"))
        return self._first(found, "categories", F.desc("count"), "kind")

    def _orphans(self, vault: Vault, n: int, now: Column) -> DataFrame:
        facts, entities = self.merged(vault)
        edges = edge_counts(current(facts).where(has_value()))
        known = entities.join(edges, "id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
        found = orphans(known, now).join(self.read("orphans").select("id"), "id", "left_anti")
        return self._first(found, "orphans", "id").select("id", "kind", "label")

    def _routing(self, vault: Vault, n: int, now: Column) -> DataFrame:
        """The events that are taken now, the oldest first; what they teach follows from all that are taken."""
        events = vault.feedback.select("event_id", "created_at").join(self.read("routing"), "event_id", "left_anti")
        return self._first(events, "routing", "created_at", "event_id").select("event_id")

    def learned(self, vault: Vault) -> tuple[DataFrame, DataFrame]:
        """(term weights, centroids) of the agents, from the events that passes have taken."""
        events = vault.feedback.join(self.read("routing"), "event_id", "left_semi")
        terms = learn_terms(events.select("agent_id", F.struct("created_at", "event_id").alias("ord"), "verdict", "terms"))
        said = events.where("verdict = 'accept'").select("agent_id", "embedding", "created_at", F.col("event_id").alias("id"))
        return terms, fold_centroids(said)
