"""The knowledge view: entities with what is known of them, the agents' lens, and upkeep of their stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import begins, current, edge_counts, has_value, heads, labelled, live, value


def agent_lens(facts: DataFrame, agent: str | None) -> DataFrame:
    """The facts that one agent wrote; all of them without one. Entities are never filtered."""
    return facts.where(F.col("agent_id") == agent) if agent else facts


def stamped(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Facts with the agent of the item they came from (addressed before routed), where none is stamped yet.

    items: id, meta (JSON).
    """
    of = lambda k: F.nullif(F.get_json_object("meta", f"$.{k}"), F.lit(""))
    by_item = items.select(F.col("id").alias("source_item_id"), F.coalesce(of("agent_id"), of("routed_agent_id")).alias("from_item")).where("from_item is not null")
    return facts.join(by_item, "source_item_id", "left").withColumn("agent_id", F.coalesce("agent_id", "from_item")).drop("from_item")


def fact_views(facts: DataFrame, entities: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """subject_id, predicate, value, ref, ref_id, sources, confidence, valid_from, fact_id: the current facts as they are shown.

    sources: fact_id, one row for each source of a fact. Labels of merged or unknown objects are ?.
    """
    now, none = current(facts), F.lit(None).cast("bigint").alias("sources")
    columns = ["subject_id", "predicate", "value", "object_id", "confidence", "valid_from", "id"]
    # only facts with an object are dealt out for its label, and only those for their sources whose ids begin as a source's
    linked = labelled(now.where("object_id IS NOT NULL"), live(entities)).withColumn("value", F.coalesce("object_label", F.lit("?")))
    plain = now.where("object_id IS NULL").withColumn("value", value(F.lit(None).cast("string")))
    f = linked.select(*columns).unionByName(plain.select(*columns))
    if sources is None:
        f = f.select("*", none)
    else:
        n = sources.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("sources"))
        heard = F.coalesce(begins("id", heads(sources, "fact_id")), F.lit(False))
        f = f.where(heard).join(n, "id", "left").select(*columns, "sources").unionByName(f.where(~heard).select("*", none))
    return f.select("subject_id", "predicate", "value", F.col("object_id").isNotNull().alias("ref"), F.col("object_id").alias("ref_id"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "valid_from", F.col("id").alias("fact_id"))


def view(facts: DataFrame, entities: DataFrame, sources: DataFrame | None = None, agent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities with their edges, their facts as shown): the knowledge view, flat, so that a hot entity is no single row."""
    f = agent_lens(facts, agent)
    shown = live(entities).join(edge_counts(current(f)), "id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return shown, fact_views(f, entities, sources)


def touched(entities: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Entities with last_used_at moved up for those that a retrieval has surfaced."""
    hit = ids.select("id").where("id is not null").distinct().withColumn("hit", F.lit(True))
    return entities.join(hit, "id", "left").withColumn("last_used_at", F.when(F.col("hit"), now).otherwise(F.col("last_used_at"))).drop("hit")


def embed_text() -> Column:
    """kind: label (keys), the text that an entity is embedded by; keys in the order of their names."""
    keys = F.array_join(F.transform(F.array_sort(F.map_entries("natural_keys")), lambda e: e["value"]), ", ")
    return F.concat("kind", F.lit(": "), "label", F.when(F.coalesce(F.size("natural_keys"), F.lit(0)) > 0, F.concat(F.lit(" ("), keys, F.lit(")"))).otherwise(F.lit("")))


def stale_embeddings(entities: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(id, text): live entities without a vector of this model."""
    fresh = vectors.where((F.col("model") == model) & F.col("embedding").isNotNull()).select("id")
    return live(entities).join(fresh, "id", "left_anti").select("id", embed_text().alias("text"))


def documents(entities: DataFrame, bodies: DataFrame) -> DataFrame:
    """Live entities that are documents or notes, or have a body that isn't blank (bodies: id, body)."""
    written = bodies.where(F.trim("body") != "").select("id").distinct().withColumn("written", F.lit(True))
    return live(entities).join(written, "id", "left").where(F.col("kind").isin("document", "note") | F.col("written")).drop("written")


def unrouted(items: DataFrame, events: DataFrame) -> DataFrame:
    """Items without a routing event (events: item_id)."""
    return items.join(events.select(F.col("item_id").alias("id")), "id", "left_anti")


def unlinked(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Live entities that no fact with a value refers to."""
    ends = facts.where(has_value()).select(F.explode(F.array("subject_id", "object_id")).alias("id")).where("id is not null")
    return live(entities).join(ends, "id", "left_anti")


def inbox(items: DataFrame, limit: int = 5, most: int = 10, chars: int = 12_000) -> DataFrame:
    """Stored or failed items, the oldest first, their text cut."""
    out = items.where(F.col("status").isin("stored", "failed")).orderBy(F.asc_nulls_last("received_at"), "id").limit(max(1, min(limit, most)))
    return out.withColumn("text", F.substring("text", 1, chars))


def chat_thread(items: DataFrame, attachments: DataFrame, limit: int = 50) -> DataFrame:
    """The newest uploads made in the app, oldest of them first, each with its attachments' names."""
    own = items.where((F.col("channel") == "upload") & (F.get_json_object("meta", "$.via") == "app")).orderBy(F.desc("received_at"), F.desc("id")).limit(limit)
    files = attachments.join(own.select(F.col("id").alias("item_id")), "item_id", "left_semi").groupBy(F.col("item_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("filename")), ", ").alias("files"))
    return own.join(files, "id", "left").withColumn("files", F.coalesce("files", F.lit(""))).orderBy("received_at", "id")


def latest_activity(entities: DataFrame, limit: int | None = None) -> DataFrame:
    """(org, updated_at): each org's last change, the latest first."""
    out = entities.groupBy("org").agg(F.max("updated_at").alias("updated_at")).orderBy(F.desc("updated_at"), "org")
    return out.limit(limit) if limit else out


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first in this order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def totals(commits: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: facts added and changed over all commits, current facts, live entities and their kinds."""
    c = commits.agg(F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"))
    f = current(facts).agg(F.count("*").alias("facts"))
    e = live(entities).agg(F.count("*").alias("entities"), F.count_distinct("kind").alias("kinds"))
    # three frames of a single row
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(c).join(one(f), "one").join(one(e), "one").drop("one")
