"""Measures over facts, and the operational counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import month, number_text, round2
from ..functions.text import humanize
from .facts import current, has_value, labelled, live, value_type, with_subject

OPS = ("sum", "avg", "min", "max", "count")


def _op(op: str, c: str) -> Column:
    """sum and avg to two places; 0 for no rows."""
    if op not in OPS:
        raise ValueError(f"op is one of {OPS}")
    if op == "count":
        return F.count(c).cast("double")
    out = getattr(F, op)(c)
    return F.coalesce(round2(out) if op in ("sum", "avg") else out, F.lit(0.0))


def measures(facts: DataFrame, entities: DataFrame | None, measure: str, kind: str | None = None) -> DataFrame:
    """The current numeric facts of a predicate, of subjects of one kind if asked."""
    out = current(facts).where((F.col("predicate") == measure) & F.col("value_num").isNotNull())
    if kind:
        out = out.join(live(entities).where(F.col("kind") == kind).select(F.col("id").alias("subject_id")), "subject_id", "left_semi")
    return out.select("subject_id", "id", "valid_from", "value_num")


def group_labels(facts: DataFrame, entities: DataFrame, predicate: str) -> DataFrame:
    """(subject_id, group): of several values the last by (valid_from, id)."""
    g = labelled(current(facts).where(F.col("predicate") == predicate), entities)
    label = F.when(F.col("object_id").isNotNull(), F.coalesce("object_label", F.lit("?"))).otherwise(F.coalesce("value_text", number_text("value_num"), F.date_format("value_date", "yyyy-MM-dd"), F.lit("—")))
    return g.groupBy("subject_id").agg(F.max_by(label, F.struct("valid_from", "id")).alias("group"))


def aggregate(facts: DataFrame, entities: DataFrame, measure: str, op: str = "sum", group_by: str | None = None, kind: str | None = None) -> DataFrame:
    """group, value, count of a measure by another predicate of its subject, largest first."""
    m = measures(facts, entities, measure, kind)
    if group_by:
        m = m.join(group_labels(facts, entities, group_by), "subject_id", "left").withColumn("group", F.coalesce("group", F.lit("(unspecified)")))
    else:
        m = m.withColumn("group", F.lit("All"))
    return m.groupBy("group").agg(_op(op, "value_num").alias("value"), F.count("*").alias("count")).orderBy(F.desc("value"), "group")


def total(facts: DataFrame, entities: DataFrame, measure: str, op: str = "sum", kind: str | None = None) -> DataFrame:
    return measures(facts, entities, measure, kind).agg(_op(op, "value_num").alias("total"), F.count("*").alias("count"))


def monthly_series(facts: DataFrame, entities: DataFrame, measure: str, date: str, op: str = "sum", kind: str | None = None) -> DataFrame:
    """A measure by the month of a date predicate: a subject's last measure, once for each of its dates."""
    m = measures(facts, entities, measure, kind).groupBy("subject_id").agg(F.max_by("value_num", F.struct("valid_from", "id")).alias("value_num"))
    d = current(facts).where((F.col("predicate") == date) & F.col("value_date").isNotNull()).select("subject_id", month("value_date").alias("month"))
    return d.join(m, "subject_id").groupBy("month").agg(_op(op, "value_num").alias("value"), F.count("*").alias("count")).orderBy("month")


def list_measures(facts: DataFrame) -> DataFrame:
    """role (numeric or group_by), predicate, label, count: what can be measured and what by."""
    numeric, group = F.col("value_num").isNotNull(), F.col("object_id").isNotNull() | (F.coalesce("value_text", F.lit("")) != "")
    counts = current(facts).groupBy("predicate").agg(F.count_if(numeric).alias("numeric"), F.count_if(~numeric & group).alias("group_by"))
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("count")) for r in ("numeric", "group_by")))
    out = counts.select("predicate", F.explode(roles).alias("r")).select("r.role", "predicate", humanize("predicate").alias("label"), "r.count").where("count > 0")
    return out.orderBy("role", F.desc("count"), "predicate")


def headline(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """name, value: live entities by kind, all of them, and current facts."""
    kinds = live(entities).groupBy(F.concat(F.lit("kind:"), "kind").alias("name")).agg(F.count("*").alias("value"))
    return kinds.unionByName(live(entities).agg(F.lit("entities").alias("name"), F.count("*").alias("value"))).unionByName(current(facts).agg(F.lit("facts").alias("name"), F.count("*").alias("value")))


def usage_summary(usage: DataFrame, since: Column | None = None) -> DataFrame:
    """Per provider and model: calls, tokens, cost, whether any was estimated or without a price."""
    out = usage if since is None else usage.where(F.col("used_at") >= since)
    out = out.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.coalesce(F.floor(F.sum("cost_usd") * 1e6 + 0.5) / 1e6, F.lit(0.0)).alias("cost_usd"), F.bool_or("estimated").alias("estimated"), F.bool_or(F.col("cost_usd").isNull()).alias("unpriced"))
    return out.orderBy(F.desc("cost_usd"), F.desc("calls"), "provider", "model")


def month_to_date(usage: DataFrame, now: Column) -> DataFrame:
    start = F.date_trunc("month", now).cast("timestamp_ntz")
    return usage.where((F.col("used_at") >= start) & (F.col("used_at") <= now)).agg(F.coalesce(F.floor(F.sum("cost_usd") * 1e6 + 0.5) / 1e6, F.lit(0.0)).alias("spend"))


def prices(usage: DataFrame, price_list: DataFrame) -> DataFrame:
    """Usage with cost_usd by the longest model prefix in price_list (prefix, price_in, price_out a million); null without one.

    Each model name is matched once, so the prefix join is models by prices.
    """
    models = usage.select("model").distinct()
    match = models.join(F.broadcast(price_list), F.col("model").startswith(F.col("prefix"))).groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), F.length("prefix")).alias("p"))
    cost = F.floor((F.col("tokens_in") * F.col("p.price_in") + F.col("tokens_out") * F.col("p.price_out")) + 0.5) / 1e6
    return usage.join(match, "model", "left").withColumn("cost_usd", cost).drop("p")


def queue_counts(items: DataFrame, most_attempts: int = 3) -> DataFrame:
    """queued (stored, or failed with tries left), analyzing, stuck (failed without)."""
    failed = F.col("status") == "failed"
    return items.agg(F.count_if((F.col("status") == "stored") | (failed & (F.col("attempts") < most_attempts))).alias("queued"), F.count_if(F.col("status") == "analyzing").alias("analyzing"), F.count_if(failed & (F.col("attempts") >= most_attempts)).alias("stuck"))


def graph_summary(facts: DataFrame, entities: DataFrame, listed: int = 14) -> DataFrame:
    """kind, role (attr, out, in), predicate, count, sample, others: the schema as observed, the top of each role."""
    f = labelled(with_subject(current(facts), live(entities)), live(entities))
    attrs = f.where("object_id is null").groupBy(F.col("subject_kind").alias("kind"), "predicate").agg(F.count("*").alias("count"), F.substring(F.min_by(F.coalesce("value_text", number_text("value_num"), F.date_format("value_date", "yyyy-MM-dd"), F.lit("—")), "id"), 1, 60).alias("sample")).withColumn("role", F.lit("attr")).withColumn("others", F.lit(""))
    kinds = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "/")
    out = f.where("object_id is not null").groupBy(F.col("subject_kind").alias("kind"), "predicate").agg(F.count("*").alias("count"), kinds(F.coalesce("object_kind", F.lit("?"))).alias("others")).withColumn("role", F.lit("out")).withColumn("sample", F.lit(""))
    inn = f.where("object_kind is not null").groupBy(F.col("object_kind").alias("kind"), "predicate").agg(F.count("*").alias("count"), kinds("subject_kind").alias("others")).withColumn("role", F.lit("in")).withColumn("sample", F.lit(""))
    w = Window.partitionBy("kind", "role").orderBy(F.desc("count"), "predicate")
    return attrs.unionByName(out).unionByName(inn).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= listed).select("kind", "role", "predicate", "count", "sample", "others")


def observed(facts: DataFrame, entities: DataFrame, kind: str, attributes: int = 8, relations: int = 6) -> DataFrame:
    """A kind's most used attribute predicates, and relations by target kind; placeholders don't count."""
    f = labelled(with_subject(current(facts).where(has_value()), live(entities).where(F.col("kind") == kind)), entities)
    attrs = f.where("object_id is null").groupBy("predicate").agg(F.count("*").alias("count")).select(F.lit("attribute").alias("role"), "predicate", F.lit(None).cast("string").alias("target"), "count").orderBy(F.desc("count"), "predicate").limit(attributes)
    rels = f.where("object_kind is not null").groupBy("predicate", F.col("object_kind").alias("target")).agg(F.count("*").alias("count")).select(F.lit("relation").alias("role"), "predicate", "target", "count").orderBy(F.desc("count"), "predicate", "target").limit(relations)
    return attrs.unionByName(rels)


def value_types(facts: DataFrame) -> DataFrame:
    return current(facts).where(has_value()).groupBy("predicate", value_type().alias("value_type")).agg(F.count("*").alias("count"))
