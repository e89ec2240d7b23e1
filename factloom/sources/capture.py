"""Capturing messages: routing to an owner, idempotency, and content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview, strip_html
from ..operators.storage import cut

ENVELOPE = "channel string, external_id string, org string, recipients array<string>, handle string, sender string, subject string, text string, html string, received_at timestamp, attachments array<struct<filename string, media string, content binary>>"


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes as JSON lines, with a stated schema: no pass over the data to guess it."""
    return spark.read.schema(ENVELOPE).json(path)


def routed(env: DataFrame, addresses: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(with their owner, without one): the org named, else that of a recipient's address, else that of (channel, handle)."""
    keyed = env.withColumn("__n", F.monotonically_increasing_id())
    keyed = cut(keyed)
    by_mail = keyed.select("__n", F.posexplode("recipients").alias("p", "r")).join(addresses.select(F.lower("address").alias("r0"), F.col("org").alias("mail_org")), F.lower("r") == F.col("r0")).groupBy("__n").agg(F.min_by("mail_org", "p").alias("mail_org"))
    by_handle = sources.select("channel", "handle", F.col("org").alias("handle_org"))
    out = keyed.join(by_mail, "__n", "left").join(by_handle, ["channel", "handle"], "left").withColumn("org", F.coalesce("org", "mail_org", "handle_org")).drop("mail_org", "handle_org", "__n")
    return out.where("org is not null"), out.where("org is null").drop("org")


def new_only(env: DataFrame, stored: DataFrame) -> DataFrame:
    """Envelopes not captured before: one of each (org, channel, external_id), none that is stored; null ids are never equal."""
    key = ["org", "channel", "external_id"]
    named = env.where("external_id is not null").dropDuplicates(key).join(stored.select(key), key, "left_anti")
    return named.unionByName(env.where("external_id is null").select(named.columns))


def items(env: DataFrame) -> DataFrame:
    """Captured items: the text, else the HTML without its tags, with a preview and the body's digest."""
    body = F.coalesce(F.nullif("text", F.lit("")), strip_html("html"), F.lit(""))
    return env.select("org", "channel", "external_id", "sender", "subject", body.alias("body"), preview(body).alias("preview"), F.sha2(body.cast("binary"), 256).alias("body_hash"), F.lit("stored").alias("status"), F.lit(0).alias("attempts"), "received_at")


def failed(env: DataFrame, error: str) -> DataFrame:
    return env.withColumn("status", F.lit("failed")).withColumn("error", F.substring(F.lit(error), 1, 500))


def blobs(env: DataFrame) -> DataFrame:
    """(org, hash, size, media, content): each content once for an org."""
    a = env.select("org", F.explode("attachments").alias("a")).select("org", F.sha2("a.content", 256).alias("hash"), F.octet_length("a.content").alias("size"), "a.media", "a.content")
    return a.dropDuplicates(["org", "hash"])


def reference_counts(*references: DataFrame) -> DataFrame:
    """(org, hash, n) over tables of references; a blob without one is not there."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (r.select("org", "hash") for r in references)).where("hash is not null").groupBy("org", "hash").agg(F.count("*").alias("n"))


def item_text(stored: DataFrame, blob_texts: DataFrame) -> DataFrame:
    """Items with their body: the blob's text, else the HTML without its tags, else the preview."""
    return stored.join(blob_texts.select(F.col("hash").alias("body_hash"), F.col("text").alias("blob_text")), "body_hash", "left").withColumn("body", F.coalesce("blob_text", strip_html("html"), "preview")).drop("blob_text")


def advanced(cursor: DataFrame, seen: DataFrame) -> DataFrame:
    """(connector, uid): the high-water mark of each mailbox; it never goes back."""
    both = cursor.select("connector", "uid").unionByName(seen.select("connector", "uid"))
    return both.groupBy("connector").agg(F.max("uid").alias("uid"))


def pulled(messages: DataFrame, cursor: DataFrame) -> DataFrame:
    """Messages past their mailbox's mark; a mailbox without one takes nothing this time, and stops before its first rejected message."""
    m = messages.join(cursor.withColumnRenamed("uid", "mark"), "connector").where("uid > mark")
    first = m.where("rejected").groupBy("connector").agg(F.min("uid").alias("stop"))
    return m.join(first, "connector", "left").where("stop is null or uid < stop").drop("mark", "stop")
