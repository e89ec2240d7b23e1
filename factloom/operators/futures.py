"""What-if futures of reviews: an overlay of changes, read over the facts that a review touches and written nowhere.

A review's changes are a few rows: an entity that becomes another, entities that
go, facts that close or hold again. They are joined to the facts of the touched
entities only, each copy named by its review and future, so any number of
reviews is looked at in one plan and no review sees another's changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import begins, has_value, heads, live
from .reviews import pending

FUTURES = ("accept", "refuse")
_KEY = ["review_id", "future"]


def changes(reviews: DataFrame, facts: DataFrame) -> DataFrame:
    """review_id, future, center_id, touched (entities whose facts matter), from_id, to_id, gone (entities), closed, by, opened: one row for each future of a pending review.

    Of an orphan batch go those that are still unlinked, as when it is accepted.
    """
    r = pending(reviews).where("kind IN ('entity_merge', 'orphan_prune', 'fact_conflict')")
    subject = facts.select(F.col("id").alias("any_fact"), F.col("subject_id").alias("conflict_subject"))
    r = r.withColumn("any_fact", F.coalesce("new_fact_id", "old_fact_id"))
    asks = r.where("any_fact IS NOT NULL").select("any_fact").distinct()
    subject = subject.where(begins("any_fact", heads(asks, "any_fact"))).join(asks, "any_fact", "left_semi")
    r = r.join(subject, "any_fact", "left")
    r = r.select("*", F.explode(F.array(*map(F.lit, FUTURES))).alias("future"))
    accept, kind = F.col("future") == "accept", F.col("kind")
    merge = (kind == "entity_merge") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    prune = kind == "orphan_prune"
    conflict = (kind == "fact_conflict") & F.col("old_fact_id").isNotNull() & F.col("new_fact_id").isNotNull()
    held = F.coalesce(F.element_at("detail", "held") == "true", F.lit(False))
    forward, back = conflict & accept & held, conflict & ~accept & ~held
    ids = F.coalesce("entity_ids", F.array().cast("array<string>"))
    asked = pending(reviews).where("kind = 'orphan_prune'").select("id", F.explode("entity_ids").alias("entity"))
    linked = facts.where(has_value()).select(F.explode(F.array("subject_id", "object_id")).alias("entity")).where(begins("entity", heads(asked, "entity"))).distinct()
    loose = asked.join(linked, "entity", "left_anti").groupBy("id").agg(F.collect_set("entity").alias("loose"))
    r = r.join(loose, "id", "left")
    return r.select(
        F.col("id").alias("review_id"), "future", "kind",
        F.when(merge, F.col("target_id")).when(prune & ~accept, F.try_element_at(ids, F.lit(1))).when(kind == "fact_conflict", F.col("conflict_subject")).alias("center_id"),
        F.filter(F.when(prune, ids).when(merge, F.array("source_id", "target_id")).otherwise(F.array("conflict_subject")), lambda x: x.isNotNull()).alias("touched"),
        F.when(merge & accept, F.col("source_id")).alias("from_id"), F.when(merge & accept, F.col("target_id")).alias("to_id"),
        F.when(prune & accept, F.col("loose")).alias("gone"),
        F.when(forward, F.col("old_fact_id")).when(back, F.col("new_fact_id")).alias("closed"),
        F.when(forward, F.col("new_fact_id")).alias("by"),
        F.when(forward, F.col("new_fact_id")).when(back, F.col("old_fact_id")).alias("opened"),
    )


def future_facts(reviews: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """review_id, future, center_id and the columns of facts: the facts of the touched entities as each future has them."""
    out = _future_facts(changes(reviews, facts), facts, now)
    return out[0].unionByName(out[1]).drop("end")


def _future_facts(c: DataFrame, facts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Those whose subject is touched, and those that only have a touched object: each fact is joined by one end, so none is looked up again."""
    each = c.withColumn("end", F.explode(F.array_distinct("touched")))
    ends = heads(each.select("end"), "end")
    of = lambda end: facts.where(begins(end, ends)).join(each, F.col(end) == F.col("end"))
    return _as_there(of("subject_id"), facts, now), _as_there(of("object_id").where(~F.array_contains("touched", F.col("subject_id"))), facts, now)


def _as_there(f: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Facts beside what a future changes, as it has them."""
    is_ = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    moved = lambda end: F.when(is_(end, "from_id"), F.col("to_id")).otherwise(F.col(end)).alias(end)
    opened, closed = is_("id", "opened"), is_("id", "closed")
    kept = f.where(~F.coalesce(F.array_contains("gone", F.col("subject_id")) | F.array_contains("gone", F.col("object_id")), F.lit(False)))
    columns = {
        "subject_id": moved("subject_id"), "object_id": moved("object_id"),
        "valid_to": F.when(opened, F.lit(None)).when(closed, now).otherwise(F.col("valid_to")).cast(facts.schema["valid_to"].dataType).alias("valid_to"),
        "superseded_by": F.when(opened, F.lit(None)).when(closed, F.coalesce("by", "superseded_by")).otherwise(F.col("superseded_by")).alias("superseded_by"),
    }
    return kept.select("end", *_KEY, "center_id", *(columns.get(k, F.col(k)) for k in facts.columns))


def future_entities(reviews: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """review_id, future, id, label, kind, center, highlight: the touched entities that are there in each future, and which of them to point at."""
    c = changes(reviews, facts)
    each = c.select("*", F.explode("touched").alias("id")).join(live(entities).select("id", "label", F.col("kind").alias("entity_kind")), "id")
    there = ~F.coalesce((F.col("id") == F.col("from_id")) | F.array_contains("gone", F.col("id")), F.lit(False))
    return each.where(there).select(*_KEY, "id", "label", F.col("entity_kind").alias("kind"), F.coalesce(F.col("id") == F.col("center_id"), F.lit(False)).alias("center"), F.lit(True).alias("highlight")).distinct()


def preview(reviews: DataFrame, facts: DataFrame, entities: DataFrame, now: Column, cap: int = 5) -> DataFrame:
    """review_id, future, place, predicate, id, label, outgoing: what each future's centre is tied to, its own facts first, at most ``cap``."""
    c, firsts = changes(reviews, facts), []
    for f in _future_facts(c, facts.where("object_id IS NOT NULL"), now):
        f = f.where("valid_to IS NULL AND subject_id <> object_id AND (subject_id = center_id OR object_id = center_id)")
        back = F.col("subject_id") != F.col("center_id")
        each = f.select("end", *_KEY, F.when(back, F.col("subject_id")).otherwise(F.col("object_id")).alias("other"), back.alias("back"), "id", "predicate")
        # the rows of an end lie together after the join, so its first ones are found before they are dealt to reviews
        w = Window.partitionBy("end", *_KEY)
        each = each.withColumn("nth", F.row_number().over(Window.partitionBy("end", *_KEY, "other").orderBy("back", "id", "predicate"))).where("nth = 1")
        firsts.append(each.withColumn("nth", F.row_number().over(w.orderBy("back", "id", "predicate"))).where(F.col("nth") <= cap).drop("end", "nth"))
    own = Window.partitionBy(*_KEY, "other").orderBy("back", "id", "predicate")
    first = firsts[0].unionByName(firsts[1]).repartition(*_KEY).withColumn("nth", F.row_number().over(own)).where("nth = 1").select(*_KEY, "other", F.struct("back", "id", "predicate").alias("f"))
    top = first.withColumn("place", F.row_number().over(Window.partitionBy(*_KEY).orderBy("f"))).where(F.col("place") <= cap)
    labels = live(entities).select(F.col("id").alias("other"), "label")
    return top.join(labels, "other").select(*_KEY, "place", F.col("f.predicate").alias("predicate"), F.col("other").alias("id"), "label", (~F.col("f.back")).alias("outgoing"))
