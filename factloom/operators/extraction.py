"""What an extractor hands in: mapping, validation and restraint, over many extractions at once.

Entities: extraction_id, ord, local_id, kind, label and the keys; facts:
extraction_id, ord, subject, predicate, the value's columns, confidence, snippet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import loose_date, whole_number
from ..functions.text import parse_sender, slugify


def mapped_entities(raw: DataFrame) -> DataFrame:
    """Flat entities (email, phone, invoice_no) with their natural keys; those without an id or a label are out, an unknown kind is a thing."""
    kept = raw.where((F.coalesce("local_id", F.lit("")) != "") & (F.trim(F.coalesce("label", F.lit(""))) != ""))
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("email", "phone", "invoice_no"))), lambda p: F.coalesce(p["value"], F.lit("")) != "")
    return kept.select("extraction_id", "ord", "local_id", F.coalesce(F.nullif("kind", F.lit("")), F.lit("thing")).alias("kind"), F.trim("label").alias("label"), F.map_from_entries(pairs).alias("natural_keys"))


def mapped_facts(raw: DataFrame) -> DataFrame:
    """Flat facts (value_type, value_number, value_date, value_entity, value_text) with one value each; a number or date left in the text is rescued, confidences are clamped, facts without a value are out."""
    kept = raw.where("coalesce(subject, '') <> '' and coalesce(predicate, '') <> '' and coalesce(value_type, '') <> ''")
    is_a = lambda k: F.col("value_type") == k
    text = F.nullif("value_text", F.lit(""))
    number = F.when(is_a("number"), F.coalesce(F.col("value_number").cast("double"), whole_number(text)))
    date = F.when(is_a("date"), F.coalesce(F.nullif("value_date", F.lit("")), loose_date(text)))
    entity = F.when(is_a("entity"), F.nullif("value_entity", F.lit("")))
    typed = number.isNotNull() | date.isNotNull() | entity.isNotNull()
    out = kept.select(
        "extraction_id", "ord", "subject", "predicate", number.alias("num"), F.when(number.isNotNull(), F.col("unit")).alias("unit"), date.alias("date"), entity.alias("object"), F.when(~typed, text).alias("text"),
        F.when(F.col("cardinality") == "many", "many").otherwise("one").alias("cardinality"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"), "snippet",
    )
    return out.where("num is not null or date is not null or object is not null or text is not null")


def issues(entities: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """extraction_id, ord, issue: what is wrong with each extraction, at most ``most`` of it; sound ones have no row.

    Limits: 60 entities, 200 facts; kinds 60, labels 300, predicates 80, texts
    2,000, units 20 and snippets 500 characters; confidences from 0 to 1; every
    fact refers to declared entities.
    """
    length = lambda c, low, high: (F.coalesce(F.length(c), F.lit(0)) < low) | (F.length(c) > high)
    ids = entities.select("extraction_id", F.col("local_id").alias("known")).distinct()
    path = lambda what, field: F.concat(F.lit(f"{what}."), F.col("ord").cast("string"), F.lit(f".{field}"))

    def of(df: DataFrame, what: str, field: str, bad: Column, place: int) -> DataFrame:
        return df.where(bad).select("extraction_id", F.lit(place).alias("place"), F.col("ord").alias("at"), path(what, field).alias("issue"))

    out = of(entities, "entities", "localId", length("local_id", 1, 40), 0)
    for field, column, low, high in (("kind", "kind", 1, 60), ("label", "label", 1, 300)):
        out = out.unionByName(of(entities, "entities", field, length(column, low, high), 1))
    out = out.unionByName(of(facts, "facts", "predicate", length("predicate", 1, 80), 3))
    out = out.unionByName(of(facts, "facts", "value.text", F.length("text") > 2000, 3)).unionByName(of(facts, "facts", "value.unit", F.length("unit") > 20, 3))
    out = out.unionByName(of(facts, "facts", "snippet", F.length("snippet") > 500, 3)).unionByName(of(facts, "facts", "confidence", (F.col("confidence") < 0) | (F.col("confidence") > 1), 3))
    out = out.unionByName(of(facts, "facts", "value.date", F.col("date").isNotNull() & ~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), 3))
    for field, column in (("subjectLocalId", "subject"), ("value.entityLocalId", "object")):
        dangling = facts.where(F.col(column).isNotNull()).join(ids, (facts["extraction_id"] == ids["extraction_id"]) & (F.col(column) == ids["known"]), "left_anti")
        out = out.unionByName(of(dangling, "facts", field, F.lit(True), 4))
    for df, what, cap in ((entities, "entities", 60), (facts, "facts", 200)):
        out = out.unionByName(df.groupBy("extraction_id").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("extraction_id", F.lit(2).alias("place"), F.lit(-1).cast("int").alias("at"), F.lit(what).alias("issue")))
    w = Window.partitionBy("extraction_id").orderBy("place", "at", "issue")
    return out.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most).select("extraction_id", "ord", "issue")


def restrained(entities: DataFrame, facts: DataFrame, kinds: DataFrame, vocabulary: DataFrame, concepts: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts, off-template facts) under the concept leash and the templates.

    The first ``concepts`` concepts that don't name a kind stay. A fact of a
    kind with a template (vocabulary: kind, predicate) that the template doesn't
    have is set aside. An entity stays if it is the first, a kept concept, or
    touched by a kept fact. kinds: name (of kinds and their aliases, as slugs).
    """
    e = entities.withColumn("slug", slugify("label")).join(kinds.select(F.col("name").alias("slug"), F.lit(True).alias("names_kind")).distinct(), "slug", "left")
    w = Window.partitionBy("extraction_id", F.col("kind") == "concept", F.coalesce("names_kind", F.lit(False))).orderBy("ord")
    e = e.withColumn("nth", F.row_number().over(w)).withColumn("first", F.col("ord") == F.min("ord").over(Window.partitionBy("extraction_id")))
    e = e.withColumn("concept_kept", (F.col("kind") == "concept") & F.col("names_kind").isNull() & (F.col("nth") <= concepts)).withColumn("dropped", (F.col("kind") == "concept") & ~F.col("concept_kept"))
    side = lambda name: e.select("extraction_id", F.col("local_id").alias(name), F.col("dropped").alias(f"{name}_dropped"), F.col("kind").alias(f"{name}_kind"))
    f = facts.join(side("subject"), ["extraction_id", "subject"]).join(side("object"), ["extraction_id", "object"], "left")
    f = f.where(~F.col("subject_dropped") & ~F.coalesce("object_dropped", F.lit(False)))
    templated = vocabulary.select(F.col("kind").alias("subject_kind"), F.lit(True).alias("templated")).distinct()
    allowed = vocabulary.select(F.col("kind").alias("subject_kind"), "predicate", F.lit(True).alias("allowed")).distinct()
    f = f.join(templated, "subject_kind", "left").join(allowed, ["subject_kind", "predicate"], "left")
    off = F.coalesce("templated", F.lit(False)) & F.col("allowed").isNull()
    kept, aside = f.where(~off).select(facts.columns), f.where(off).select(facts.columns)
    ends = kept.select("extraction_id", F.explode(F.array("subject", "object")).alias("local_id")).where("local_id is not null").distinct().withColumn("touched", F.lit(True))
    e = e.join(ends, ["extraction_id", "local_id"], "left")
    stays = F.when(F.col("kind") == "concept", F.col("concept_kept")).otherwise(F.col("first") | F.coalesce("touched", F.lit(False)))
    left = e.where(stays).select(entities.columns)
    known = left.select("extraction_id", F.col("local_id").alias("subject"))
    objects = left.select("extraction_id", F.col("local_id").alias("object"), F.lit(True).alias("met"))
    final = kept.join(known, ["extraction_id", "subject"], "left_semi").join(objects, ["extraction_id", "object"], "left").where("object is null or met").select(facts.columns)
    return left, final, aside


def off_template_review(aside: DataFrame, entities: DataFrame, items: DataFrame) -> DataFrame:
    """extraction_id, facts (subject, predicate, value, ref), n, doc_label: what a review of set-aside facts shows."""
    names = lambda k: entities.select("extraction_id", F.col("local_id").alias(k), F.col("label").alias(f"{k}_label"))
    f = aside.join(names("subject"), ["extraction_id", "subject"], "left").join(names("object"), ["extraction_id", "object"], "left")
    said = F.coalesce("object_label", F.concat_ws(" ", F.col("num").cast("string"), F.when(F.col("num").isNotNull(), F.col("unit"))), F.lit(""))
    said = F.when(F.col("object").isNotNull() | F.col("num").isNotNull(), said).otherwise(F.coalesce("date", "text", F.lit("—")))
    shown = f.groupBy("extraction_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("subject_label", F.lit("?")).alias("subject"), "predicate", said.alias("value"), F.col("object").isNotNull().alias("ref")))), lambda x: F.struct(x["subject"].alias("subject"), x["predicate"].alias("predicate"), x["value"].alias("value"), x["ref"].alias("ref"))).alias("facts"), F.count("*").alias("n"))
    return shown.join(items.select("extraction_id", F.coalesce("doc_label", F.lit("a document")).alias("doc_label")), "extraction_id", "left")


def of_document(documents: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, facts) of documents (id, hash, filename, media, size) and what was extracted from them (id, local_id, kind, label).

    A document's local ids are made its own, and it mentions each entity.
    """
    doc = documents.select(F.col("id").alias("extraction_id"), F.lit(0).alias("ord"), F.lit("doc").alias("local_id"), F.lit("document").alias("kind"), F.col("filename").alias("label"), F.create_map(F.lit("id"), F.concat_ws(":", F.lit("doc"), "hash", "filename")).alias("natural_keys"))
    own = mentions.select(F.col("id").alias("extraction_id"), (F.row_number().over(Window.partitionBy("id").orderBy("local_id"))).alias("ord"), F.concat(F.lit("doc:"), "local_id").alias("local_id"), "kind", "label", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("natural_keys"))
    none = F.lit(None).cast("string")

    def fact(df: DataFrame, predicate: str, place: Column, *, obj: Column = none, text: Column = none, num: Column = none) -> DataFrame:
        return df.select("extraction_id", place.alias("ord"), F.lit("doc").alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), text.alias("text"), num.cast("double").alias("num"))

    d = documents.withColumn("extraction_id", F.col("id"))
    facts = fact(d.where("media is not null"), "file_type", F.lit(0), text=F.col("media")).unionByName(fact(d.where("size is not null"), "file_size", F.lit(1), num=F.col("size")))
    facts = facts.unionByName(fact(own, "mentions", F.col("ord") + 1, obj=F.col("local_id")))
    return doc.unionByName(own), facts


def with_sender(entities: DataFrame, items: DataFrame) -> DataFrame:
    """Entities with the sender's address as a key of the one person whose label is the sender's name (items: extraction_id, sender)."""
    s = items.select("extraction_id", parse_sender("sender").alias("s")).where("s.email is not null and s.name is not null")
    e = entities.join(s, "extraction_id", "left")
    same = (F.col("kind") == "person") & (F.lower("label") == F.lower("s.name")) & F.element_at("natural_keys", "email").isNull()
    e = e.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("n", F.count_if("same").over(Window.partitionBy("extraction_id")))
    keys = F.when(F.col("same") & (F.col("n") == 1), F.map_concat("natural_keys", F.create_map(F.lit("email"), F.col("s.email")))).otherwise(F.col("natural_keys"))
    return e.withColumn("natural_keys", keys).select(entities.columns)
