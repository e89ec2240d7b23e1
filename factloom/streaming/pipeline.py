"""One micro-batch of captured items, from the gate to the proposals, for ``foreachBatch``.

gate (acknowledgements go no further), route (to the agent that is addressed or
clearly wins), prime (the known entities that a text names), extract (a callable,
the only step that a language model takes), ingest (contract, restraint,
reconciliation, grounding, resolution, folding), chunk, stamp, propose.

Every sink is a table of numbered batches. A batch is made from the batches
before it only, and what the extractor said is its first sink, read back from
there; so a batch that is run again, after any step of it, writes what is
missing and changes nothing else. Items that were in an earlier batch are left
out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_key, worth_extracting
from ..operators.extraction import issues, mapped_entities, mapped_facts, off_template_review, restrained, with_sender
from ..operators.resolve import Adjudicator, ended, fold_facts, ground, reconcile_extraction, resolve, without_model
from ..operators.search import agent_profiles, chunked, named_in, route
from ..operators.storage import BatchTable, cut
from ..operators.vector_index import VectorIndex

#: The flat form in which an extractor hands in what it found.
RAW_ENTITIES = "extraction_id string, ord int, local_id string, kind string, label string, email string, phone string, invoice_no string"
RAW_FACTS = "extraction_id string, ord int, subject string, predicate string, value_type string, value_number double, value_date string, value_entity string, value_text string, unit string, cardinality string, confidence double, snippet string"

TABLES = {
    "said_entities": RAW_ENTITIES,
    "said_facts": RAW_FACTS,
    "items": "id string, channel string, sender string, received_at timestamp_ntz, status string, agent_id string, error string",
    "entities": "id string, kind string, label string, natural_keys map<string,string>, created_at timestamp_ntz, merged_into string, support int",
    "mentions": "item_id string, local_id string, entity_id string, tier string",
    "observations": "claim_key string, fact_id string, subject_id string, predicate string, object_id string, value_kind string, said string, value string, cardinality string, confidence double, observed_at timestamp_ntz, source_item_id string, agent_id string, grounded boolean",
    "chunks": "item_id string, seq bigint, page int, heading string, text string",
    "reviews": "id string, kind string, status string, confidence double, impact bigint, source_id string, target_id string, item_id string, detail map<string,string>",
}

Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class Catalogue:
    """What a vault's owner has set. agents: agent_id, name, purpose; kinds: name (of kinds and aliases, as slugs);
    vocabulary: kind, predicate (of templates); declared: kind, word, many (cardinalities); learned: agent_id, term, weight."""

    agents: DataFrame
    kinds: DataFrame
    vocabulary: DataFrame
    declared: DataFrame
    learned: DataFrame | None = None


def _no_keys() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


class ItemPipeline:
    """Items have id, channel, sender, subject, body, received_at, meta (JSON) and has_attachments.

    extractor: from prompts (extraction_id, text, subject, purpose, known: labels)
    to raw entities and facts.
    """

    def __init__(self, spark: SparkSession, path: str, catalogue: Catalogue, extractor: Extractor, adjudicate: Adjudicator = without_model, index: VectorIndex | None = None):
        self.spark, self.catalogue, self.extractor, self.adjudicate, self.index = spark, catalogue, extractor, adjudicate, index
        self.tables = {name: BatchTable(spark, f"{path.rstrip('/')}/{name}", schema) for name, schema in TABLES.items()}

    def read(self, name: str, before: int | None = None, only: int | None = None) -> DataFrame:
        return self.tables[name].read(before, only)

    def _put(self, name: str, df: DataFrame, batch_id: int) -> DataFrame:
        """The batch as it is stored, whether now or by an earlier run."""
        table = self.tables[name]
        if not table.has(batch_id):
            table.write(df.select(*table.read().columns), batch_id)
        return table.read(only=batch_id)

    def steered(self, items: DataFrame) -> DataFrame:
        """Items with worth, and the agent that is addressed in their meta or that routing clearly picks."""
        addressed = F.nullif(F.get_json_object("meta", "$.agent_id"), F.lit(""))
        text = F.concat_ws("\n", "subject", "body")
        out = items.withColumn("worth", worth_extracting(F.col("body"), F.col("subject"), F.coalesce("has_attachments", F.lit(False)))).withColumn("addressed", addressed)
        asked = out.where("worth and addressed is null").select(F.col("id").alias("message_id"), text.alias("text"))
        picked = route(asked, agent_profiles(self.catalogue.agents, self.catalogue.learned)).select(F.col("message_id").alias("id"), F.col("agent_id").alias("routed"))
        return out.join(picked, "id", "left").withColumn("agent_id", F.coalesce("addressed", "routed")).drop("addressed", "routed")

    def prompts(self, steered: DataFrame, entities: DataFrame, cap: int = 15) -> DataFrame:
        """What the extractor gets: each worthy item with its agent's purpose and the entities it names, the best supported first."""
        texts = steered.where("worth").select(F.col("id").alias("extraction_id"), F.coalesce("body", F.lit("")).alias("text"), "subject", "agent_id")
        named = named_in(texts.select(F.col("extraction_id").alias("text_id"), F.concat_ws("\n", "subject", "text").alias("text")), entities.select("id", "label"))
        w = Window.partitionBy("text_id").orderBy(F.desc("support"), "label", "id")
        first = named.join(entities.select("id", "label", "support"), "id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
        known = first.groupBy(F.col("text_id").alias("extraction_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("known"))  # cap labels
        purposes = self.catalogue.agents.select("agent_id", "purpose")
        return texts.join(purposes, "agent_id", "left").join(known, "extraction_id", "left").select("extraction_id", "text", "subject", "purpose", F.coalesce("known", F.array().cast("array<string>")).alias("known"))

    def known_entities(self, before: int | None) -> DataFrame:
        """One row for each entity, with its mentions as support."""
        support = self.read("mentions", before).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").cast("int").alias("n"))
        first = self.read("entities", before).dropDuplicates(["id"])
        return first.join(support, "id", "left").withColumn("support", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).drop("n")

    def facts(self, before: int | None = None) -> DataFrame:
        """The claims of all batches, folded: each fact with its validity, its value and its sources."""
        seen = self.read("observations", before)
        return ended(fold_facts(seen)).join(seen.drop("claim_key").dropDuplicates(["fact_id"]), "fact_id")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if all(t.has(batch_id) for t in self.tables.values()):
            return
        c, before = self.catalogue, batch_id
        items = batch.dropDuplicates(["id"]).join(self.read("items", before).select("id"), "id", "left_anti")
        entities = cut(self.known_entities(before))
        steered = cut(self.steered(items))

        if not (self.tables["said_entities"].has(batch_id) and self.tables["said_facts"].has(batch_id)):
            ents, facts = self.extractor(self.prompts(steered, entities))
            self._put("said_entities", ents, batch_id)
            self._put("said_facts", facts, batch_id)
        x, f = cut(mapped_entities(self.read("said_entities", only=batch_id))), cut(mapped_facts(self.read("said_facts", only=batch_id)))

        wrong = issues(x, f).groupBy("extraction_id").agg(F.array_join(F.array_sort(F.collect_list("issue")), "; ").alias("error"))  # a few issues for each
        state = steered.join(wrong.withColumnRenamed("extraction_id", "id"), "id", "left").withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("analyzed"))
        done = self._put("items", state.withColumn("received_at", F.col("received_at").cast("timestamp_ntz")), batch_id)
        sound = done.where("status = 'analyzed'").select(F.col("id").alias("extraction_id"))
        x, f = (t.join(sound, "extraction_id", "left_semi") for t in (x, f))
        x = with_sender(x, steered.select(F.col("id").alias("extraction_id"), "sender"))
        x, f, aside = map(cut, restrained(cut(x), cut(f), c.kinds, c.vocabulary))

        mentions = self._resolved(x, entities, done, batch_id)
        self._observed(x, f, mentions, steered, done, batch_id)
        self._put("chunks", chunked(steered.where("worth").select("id", "body"), "id", "body").withColumnRenamed("id", "item_id"), batch_id)
        self._proposed(aside, x, f, mentions, done, batch_id)

    def _resolved(self, x: DataFrame, entities: DataFrame, done: DataFrame, batch_id: int) -> DataFrame:
        """Whom each extracted entity is: a known one, or a new one, the same for all in the batch with its key."""
        wanted = x.withColumn("wanted_id", F.concat_ws("\x1f", "extraction_id", "local_id"))
        found = resolve(wanted.select("wanted_id", "kind", "label", "natural_keys"), entities, self.adjudicate)
        own = F.sha2(F.concat_ws("\x1f", "kind", normalized_key("label", F.col("natural_keys"))), 256)
        both = wanted.join(found.withColumnRenamed("id", "known_id"), "wanted_id").join(done.select(F.col("id").alias("extraction_id"), "received_at"), "extraction_id")
        both = both.withColumn("own_id", own).withColumn("entity_id", F.when(F.col("decision") == "merge", F.col("known_id")).otherwise(F.col("own_id")))
        new = both.where("entity_id = own_id").groupBy(F.col("own_id").alias("id")).agg(F.min_by(F.struct("kind", "label", "natural_keys"), F.struct("received_at", "extraction_id", "ord")).alias("e"), F.min("received_at").alias("created_at"))
        self._put("entities", new.join(entities.select("id"), "id", "left_anti").select("id", "e.*", "created_at", F.lit(None).cast("string").alias("merged_into"), F.lit(1).alias("support")), batch_id)
        mentions = self._put("mentions", both.select(F.col("extraction_id").alias("item_id"), "local_id", "entity_id", F.when(F.col("decision") == "propose", F.concat(F.lit("propose:"), "known_id")).otherwise(F.col("tier")).alias("tier")), batch_id)
        return mentions

    def _observed(self, x: DataFrame, f: DataFrame, mentions: DataFrame, steered: DataFrame, done: DataFrame, batch_id: int) -> None:
        """The facts that stand, grounded in their text and stamped with the item's agent, as observations of their claims."""
        kind = F.when(F.col("object").isNotNull(), "entity").when(F.col("num").isNotNull(), "number").when(F.col("date").isNotNull(), "date").otherwise("text")
        f = f.select("extraction_id", "ord", F.col("subject").alias("subject_local_id"), "predicate", kind.alias("value_kind"), F.col("object").alias("entity_local_id"), "num", "date", "text", "confidence", "snippet")
        kept = cut(reconcile_extraction(x, f, self.catalogue.declared))
        num = F.when(F.col("value_kind") == "number", F.col("value").cast("double"))
        grounded = ground(kept.withColumn("num", num), steered.select(F.col("id").alias("extraction_id"), F.concat_ws("\n", "subject", "body").alias("text")))
        ids = lambda k: mentions.select(F.col("item_id").alias("extraction_id"), F.col("local_id").alias(k), F.col("entity_id").alias(f"{k}_id"))
        subject = ids("subject_local_id").withColumnRenamed("subject_local_id_id", "subject_id")
        target = ids("value").withColumn("value_kind", F.lit("entity")).withColumnRenamed("value_id", "object_id")
        out = grounded.join(subject, ["extraction_id", "subject_local_id"]).join(target, ["extraction_id", "value", "value_kind"], "left").join(done.select(F.col("id").alias("extraction_id"), "agent_id", "received_at"), "extraction_id")
        said = F.coalesce("object_id", "value")
        base = F.concat_ws("::", "subject_id", "predicate")
        out = out.select(
            F.when(F.col("cardinality") == "many", F.concat_ws("::", base, F.concat(F.substring("value_kind", 1, 1), F.lit(":"), said))).otherwise(base).alias("claim_key"),
            F.concat_ws("|", "extraction_id", F.col("ord").cast("string"), "subject_id").alias("fact_id"), "subject_id", "predicate", "object_id", "value_kind", F.col("value").alias("said"), said.alias("value"), "cardinality", "confidence",
            F.col("received_at").alias("observed_at"), F.col("extraction_id").alias("source_item_id"), "agent_id", "grounded",
        )
        self._put("observations", out, batch_id)

    def _proposed(self, aside: DataFrame, x: DataFrame, f: DataFrame, mentions: DataFrame, done: DataFrame, batch_id: int) -> None:
        """Reviews: merges that are likely but not sure, facts outside the templates, and each item's extraction as a whole."""
        none, impact = F.lit(None).cast("string"), F.col("n").cast("bigint")
        likely = mentions.where("startswith(tier, 'propose:')").select(F.col("entity_id").alias("source_id"), F.substr("tier", F.lit(9)).alias("target_id"), "item_id").dropDuplicates(["source_id", "target_id"])
        merges = likely.select(F.concat_ws("|", F.lit("merge"), "source_id", "target_id").alias("id"), F.lit("entity_merge").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.lit(1).cast("bigint").alias("impact"), "source_id", "target_id", "item_id", _no_keys().alias("detail"))
        labels = done.select(F.col("id").alias("extraction_id"), F.coalesce("sender", F.lit("a message")).alias("doc_label"))
        off = off_template_review(aside, x, labels).select(F.concat_ws("|", F.lit("off"), "extraction_id").alias("id"), F.lit("off_template").alias("kind"), F.lit(None).cast("double").alias("confidence"), impact.alias("impact"), none.alias("source_id"), none.alias("target_id"), F.col("extraction_id").alias("item_id"), F.create_map(F.lit("facts"), F.to_json("facts"), F.lit("docLabel"), F.col("doc_label")).alias("detail"))
        whole = f.groupBy("extraction_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.min_by("snippet", "ord").alias("snippet"))
        whole = whole.select(F.concat_ws("|", F.lit("extraction"), "extraction_id").alias("id"), F.lit("extraction").alias("kind"), "confidence", impact.alias("impact"), none.alias("source_id"), none.alias("target_id"), F.col("extraction_id").alias("item_id"), F.create_map(F.lit("snippet"), F.coalesce("snippet", F.lit(""))).alias("detail"))
        self._put("reviews", merges.unionByName(off).unionByName(whole).withColumn("status", F.lit("pending")), batch_id)
