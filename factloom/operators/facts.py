"""Facts: which hold, what they say, and how they hang together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import number_text

VALUES = ("object_id", "value_num", "value_date", "value_text")


def current(facts: DataFrame) -> DataFrame:
    return facts.where("valid_to is null")


def as_of(facts: DataFrame, day: str) -> DataFrame:
    """The facts that held at the end of a day (UTC)."""
    t = F.lit(f"{day} 23:59:59").cast("timestamp_ntz")
    return facts.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def live(entities: DataFrame) -> DataFrame:
    return entities.where("merged_into is null")


def has_value() -> Column:
    """False for template placeholders."""
    return F.coalesce(*(F.col(c).cast("string") for c in VALUES)).isNotNull()


def value_type() -> Column:
    return F.when(F.col("object_id").isNotNull(), "entity").when(F.col("value_num").isNotNull(), "number").when(F.col("value_date").isNotNull(), "date").otherwise("text")


def value(label: Column | str = "object_label") -> Column:
    """A fact's value as text: the object's label (? if unknown), number and unit, date, text, or —."""
    label = F.col(label) if isinstance(label, str) else label
    number = F.concat_ws(" ", number_text("value_num"), "unit")
    return F.when(F.col("object_id").isNotNull(), F.coalesce(label, F.lit("?"))).when(F.col("value_num").isNotNull(), number).when(F.col("value_date").isNotNull(), F.date_format("value_date", "yyyy-MM-dd")).otherwise(F.coalesce("value_text", F.lit("—")))


def labelled(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with their object's label and kind (null if it is unknown)."""
    objects = entities.select(F.col("id").alias("object_id"), F.col("label").alias("object_label"), F.col("kind").alias("object_kind"))
    return facts.join(objects, "object_id", "left")


def with_subject(facts: DataFrame, entities: DataFrame) -> DataFrame:
    subjects = entities.select(F.col("id").alias("subject_id"), F.col("label").alias("subject_label"), F.col("kind").alias("subject_kind"))
    return facts.join(subjects, "subject_id")


def find(facts: DataFrame, entities: DataFrame, *, subject: str | None = None, predicate: str | None = None, kind: str | None = None, day: str | None = None, limit: int | None = 40) -> DataFrame:
    """Facts by subject, predicate and kind (one at least), newest first."""
    if not (subject or predicate or kind):
        raise ValueError("subject, predicate or kind is needed")
    out = as_of(facts, day) if day else current(facts)
    if subject:
        out = out.where(F.col("subject_id") == subject)
    if predicate:
        out = out.where(F.col("predicate") == predicate)
    subjects = live(entities)
    if kind:
        subjects = subjects.where(F.col("kind") == kind)
    out = labelled(with_subject(out, subjects), entities).withColumn("value", value())
    out = out.orderBy(F.desc("valid_from"), "id")
    return out.limit(limit) if limit else out


def top_facts(facts: DataFrame, n: int = 4) -> DataFrame:
    """Each subject's n most confident facts that have a value."""
    w = Window.partitionBy("subject_id").orderBy(F.desc("confidence"), F.desc("created_at"), "id")
    return current(facts).where(has_value()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def edge_counts(facts: DataFrame, once: bool = False) -> DataFrame:
    """(id, edges): how many facts refer to an entity at either end.

    once: a fact between an entity and itself counts once, not twice.
    """
    ends = F.array("subject_id", "object_id")
    ends = F.array_distinct(ends) if once else ends
    return facts.select(F.explode(ends).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("edges"))


#: Ids of which the facts are looked up by a join; more than that, and all facts are counted.
FEW = 100_000


def edges_of(ids: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, edges) of these distinct ids (a table), as edge_counts has them; no other's facts are dealt out where they are few."""
    if ids.limit(FEW + 1).count() > FEW:
        counts = edge_counts(facts)
    else:
        ends = [facts.select(F.col(end).alias("id")).join(ids, "id", "left_semi") for end in ("subject_id", "object_id")]
        counts = ends[0].unionByName(ends[1]).groupBy("id").agg(F.count("*").alias("edges"))
    return ids.join(counts, "id", "left").select("id", F.coalesce("edges", F.lit(0)).alias("edges"))


#: Letters of an id that tell kinds of things apart.
HEAD = 3


def heads(df: DataFrame, column: str) -> Column:
    """What the ids of a column begin with, all of them in one array, as a subquery of the plan that asks."""
    return df.select(F.substring(column, 1, HEAD).alias("head")).agg(F.collect_set("head").alias("heads")).scalar()


def begins(column: str, with_: Column) -> Column:
    """Whether an id may be among those that begin so: a filter before a join deals rows out."""
    return F.array_contains(with_, F.substring(column, 1, HEAD))


def adjacency(facts: DataFrame) -> DataFrame:
    """(a, b, weight) in both directions: the facts that tie two entities; none with itself."""
    e = current(facts).where("object_id is not null and subject_id <> object_id")
    pairs = e.groupBy(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).agg(F.count("*").alias("weight"))
    return pairs.select(F.explode(F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))).alias("e")).select("e.*")


def slot() -> Column:
    """What a value is called in a claim of many."""
    return F.when(F.col("object_id").isNotNull(), F.concat(F.lit("e:"), "object_id")).when(F.col("value_num").isNotNull(), F.concat_ws(":", F.lit("n"), number_text("value_num"), "unit")).when(F.col("value_date").isNotNull(), F.concat(F.lit("d:"), F.date_format("value_date", "yyyy-MM-dd"))).otherwise(F.concat(F.lit("t:"), F.lower(F.trim(F.coalesce("value_text", F.lit(""))))))


def claim_key() -> Column:
    return F.when(F.col("cardinality") == "many", F.concat_ws("::", "subject_id", "predicate", slot())).otherwise(F.concat_ws("::", "subject_id", "predicate"))


def claim_violations(facts: DataFrame) -> DataFrame:
    """Claims with more than one current fact: none in a sound store."""
    return current(facts).groupBy(claim_key().alias("claim_key")).agg(F.count("*").alias("n")).where("n > 1")


def first_seen(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """When each (kind, predicate) first appeared, superseded facts included."""
    return with_subject(facts, entities).groupBy("subject_kind", "predicate").agg(F.min("created_at").alias("first_seen"))


def provenance(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Facts with where they came from; the channel is unknown where the item is."""
    i = items.select(F.col("id").alias("source_item_id"), "channel", "sender", "received_at")
    return facts.join(i, "source_item_id", "left").withColumn("channel", F.coalesce("channel", F.lit("unknown")))
