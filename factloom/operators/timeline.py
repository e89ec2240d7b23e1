"""Timelines and commit logs over facts and captured items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import humanize
from .facts import labelled, value


def _ts(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def events(entities: DataFrame, facts: DataFrame, items: DataFrame, entity: str | None = None, basis: str = "received", limit: int | None = 200) -> DataFrame:
    """type, ts, date_only, title, detail, ref: messages, domain dates, changes and first sightings, newest first.

    A timestamped event comes before one of day precision at the same instant.
    """
    touches = (F.col("subject_id") == entity) | (F.col("object_id") == entity)
    own = facts.where(touches) if entity else facts
    names = entities.select(F.col("id").alias("subject_id"), F.col("label").alias("subject_label"))

    def newest(df: DataFrame, ts: Column | str) -> DataFrame:
        """The rows that may be among the last ``limit``: those not older than the limit-th instant (ties stay, the title decides among them)."""
        df = df.withColumn("ts", ts if isinstance(ts, Column) else F.col(ts))
        if not limit:
            return df
        last = df.select("ts").where("ts is not null").orderBy(F.desc("ts")).limit(limit)
        few, least = last.agg(F.count("*") < limit).scalar(), last.agg(F.min("ts")).scalar()
        return df.where((F.col("ts") >= least) | few)

    counts = own.where("source_item_id is not null").groupBy(F.col("source_item_id").alias("id")).agg(F.count("*").alias("n"))
    when = F.coalesce("sent_at", "received_at") if basis == "sent" else F.col("received_at")
    msgs = items.join(counts.select("id"), "id", "left_semi") if entity else items
    msgs = newest(msgs, when).join(counts, "id", "left")
    noted = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " fact extracted").otherwise(" facts extracted")))
    message = msgs.select(F.lit("message").alias("type"), "ts", F.lit(False).alias("date_only"), F.coalesce(F.nullif("preview", F.lit("")), F.lit("Message received")).alias("title"), F.nullif(F.concat_ws(" · ", "sender", noted), F.lit("")).alias("detail"), F.col("id").alias("ref"))
    dated = own.where("valid_to is null and value_date is not null").join(names.select("subject_id"), "subject_id", "left_semi")
    dated = newest(dated, F.col("value_date").cast("timestamp_ntz")).join(names, "subject_id")
    dates = dated.select(F.lit("date").alias("type"), "ts", F.lit(True).alias("date_only"), F.concat("subject_label", F.lit(" — "), humanize("predicate")).alias("title"), F.lit(None).cast("string").alias("detail"), F.col("id").alias("ref"))
    closed = own.where("valid_to is not null and superseded_by is not null").join(names.select("subject_id"), "subject_id", "left_semi")
    changed = labelled(newest(closed, "valid_to"), entities).withColumn("said", value()).join(names, "subject_id")
    after = labelled(facts.join(changed.select(F.col("superseded_by").alias("id")).distinct(), "id", "left_semi"), entities).select(F.col("id").alias("superseded_by"), value().alias("now"))
    change = changed.join(after, "superseded_by", "left").select(F.lit("change").alias("type"), "ts", F.lit(False).alias("date_only"), F.concat("subject_label", F.lit(" · "), humanize("predicate"), F.lit(" changed")).alias("title"), F.concat("said", F.lit(" → "), F.coalesce("now", F.lit("?"))).alias("detail"), F.col("id").alias("ref"))
    met = newest(entities.where(F.col("id") == entity) if entity else entities, "created_at")
    seen = met.select(F.lit("seen").alias("type"), "ts", F.lit(False).alias("date_only"), F.concat("label", F.lit(" first seen")).alias("title"), F.lit(None).cast("string").alias("detail"), F.col("id").alias("ref"))
    out = message.unionByName(dates).unionByName(change).unionByName(seen).orderBy(F.desc("ts"), "date_only", "title", "ref")
    return (out.limit(limit) if limit else out).withColumn("ts", _ts("ts"))


def diff_lines(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """item_id, ord, op, subject, predicate, value, was: what each item added or changed; changes first."""
    f = labelled(facts, entities).withColumn("said", value())
    before = f.where("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.max_by("said", "valid_from").alias("was"))
    lines = f.where("source_item_id is not null").join(before, "id", "left").join(entities.select(F.col("id").alias("subject_id"), F.col("label").alias("subject")), "subject_id", "left")
    lines = lines.withColumn("op", F.when(F.col("was").isNotNull(), "change").otherwise("add"))
    w = Window.partitionBy("source_item_id").orderBy(F.desc("op"), F.coalesce("subject", F.lit("")), "predicate", "id")
    return lines.select(F.col("source_item_id").alias("item_id"), F.row_number().over(w).alias("ord"), "op", "subject", "predicate", F.col("said").alias("value"), "was")


def commits(entities: DataFrame, facts: DataFrame, items: DataFrame, limit: int | None = 100) -> DataFrame:
    """item_id, ts, channel, sender, added, changed, lines: one row for each item that wrote facts, newest first."""
    line = F.concat(F.when(F.col("op") == "change", "~ ").otherwise("+ "), F.coalesce("subject", F.lit("?")), F.lit(" "), humanize("predicate"), F.lit(": "), F.when(F.col("op") == "change", F.concat("was", F.lit(" → "), "value")).otherwise(F.col("value")))
    own = diff_lines(entities, facts).groupBy("item_id").agg(F.count_if(F.col("op") == "add").alias("added"), F.count_if(F.col("op") == "change").alias("changed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    i = items.select(F.col("id").alias("item_id"), "received_at", "channel", "sender")
    out = own.join(i, "item_id").orderBy(F.desc("received_at"), "item_id")
    out = out.limit(limit) if limit else out
    return out.select("item_id", _ts("received_at").alias("ts"), "channel", "sender", "added", "changed", "lines")


def by_day(timeline: DataFrame, now: str) -> DataFrame:
    """Each event's day, or 'Upcoming' for what lies ahead, with its place within."""
    ahead = F.col("ts") > now
    out = timeline.withColumn("bucket", F.when(ahead, "Upcoming").otherwise(F.substring("ts", 1, 10)))
    w = Window.partitionBy("bucket").orderBy(F.when(ahead, F.col("ts")), F.desc("ts"), "title", "ref")
    return out.withColumn("place", F.row_number().over(w))
