"""How the relational tables become a vault: entities, and append-only bitemporal facts.

Each predicate is one branch of a union with the predicate as a literal, so a
filter on the predicate removes the other branches' scans at planning time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "2020-01-01 00:00:00"
def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def key(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), _s(c))


def _ntz(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def _epoch() -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, label, support, created_at, merged_into, natural_keys."""

    def of(df: DataFrame, kind: str, k: str, label: Column, created: Column | None = None) -> DataFrame:
        return df.select(
            key(kind, k).alias("id"), F.lit(kind).alias("kind"), label.alias("label"), (F.col(k) % 3 + 1).cast("int").alias("support"),
            (_epoch() if created is None else created).alias("created_at"), _none("string").alias("merged_into"),
            F.create_map(F.lit("external_id"), _s(k)).alias("natural_keys"),
        )

    t = lambda name: table(spark, sf_dir, name)
    return _union([
        of(t("region"), "region", "r_regionkey", F.col("r_name")),
        of(t("nation"), "nation", "n_nationkey", F.col("n_name")),
        of(t("customer"), "customer", "c_custkey", F.col("c_name")),
        of(t("supplier"), "supplier", "s_suppkey", F.col("s_name")),
        of(t("part"), "part", "p_partkey", F.col("p_name")),
        of(t("orders"), "invoice", "o_orderkey", F.concat(F.lit("ORD-"), _s("o_orderkey")), _ntz("o_orderdate")),
        of(t("documents"), "document", "doc_id", F.concat(F.lit("doc "), _s("doc_id"))),
        of(t("events").groupBy("user_id").agg(F.min("ts").alias("ts")), "user", "user_id", F.concat(F.lit("user "), _s("user_id")), _ntz("ts")),
    ])


def fact(df: DataFrame, kind: str, k: str, predicate: str, *, obj: Column | None = None, text: Column | None = None, num: Column | None = None, date: Column | None = None, unit: str | None = None, many: bool = False, fid: Column | None = None, since: Column | None = None, item: Column | None = None, until: Column | None = None, by: Column | None = None) -> DataFrame:
    null = _none
    since = _epoch() if since is None else since
    subject = key(kind, k)
    return df.select(
        (F.concat(F.lit(f"{predicate}|"), subject) if fid is None else fid).alias("id"), subject.alias("subject_id"), F.lit(predicate).alias("predicate"),
        (null("string") if obj is None else obj).alias("object_id"), (null("string") if text is None else text).alias("value_text"),
        (null("double") if num is None else num.cast("double")).alias("value_num"), (null("date") if date is None else date).alias("value_date"),
        F.lit(unit).cast("string").alias("unit"), F.lit("many" if many else "one").alias("cardinality"),
        (F.lit(0.5) + F.pmod(F.col(k), F.lit(5)) / 10).alias("confidence"), since.alias("valid_from"), (null("timestamp_ntz") if until is None else until).alias("valid_to"),
        (null("string") if by is None else by).alias("superseded_by"), (null("string") if item is None else item).alias("source_item_id"), since.alias("created_at"),
    )


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last_event_type facts of users: a new fact where the value changes, superseding the one before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", _ntz("ts").alias("ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = e.withColumn("last", F.lag("event_type").over(w)).where("last is null or last <> event_type")
    runs = runs.withColumn("next_ts", F.lead("ts").over(w)).withColumn("next_id", F.lead("event_id").over(w))
    return fact(runs, "user", "user_id", "last_event_type", text=F.col("event_type"), fid=F.concat(F.lit("ev|"), _s("event_id")), since=F.col("ts"), item=key("item", "event_id"), until=F.col("next_ts"), by=F.concat(F.lit("ev|"), _s("next_id")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, subject_id, predicate, object_id, value_text, value_num, value_date, unit, cardinality, confidence, valid_from, valid_to, superseded_by, source_item_id, created_at."""
    t = lambda name: table(spark, sf_dir, name)
    orders, lines = t("orders"), t("lineitem")
    when = _ntz("o_orderdate")
    contains = lines.select("l_orderkey", "l_partkey").distinct()
    shipped = lines.select("l_orderkey", "l_suppkey").distinct()
    pair = lambda p, a, b: F.concat(F.lit(f"{p}|invoice:"), _s(a), F.lit("|"), _s(b))
    return _union([
        fact(orders, "invoice", "o_orderkey", "amount", num=F.col("o_totalprice"), unit="USD", since=when),
        fact(orders, "invoice", "o_orderkey", "order_date", date=F.col("o_orderdate").cast("date"), since=when),
        fact(orders, "invoice", "o_orderkey", "status", text=F.col("o_orderstatus"), since=when),
        fact(orders, "invoice", "o_orderkey", "priority", text=F.col("o_orderpriority"), since=when),
        fact(orders, "invoice", "o_orderkey", "billed_to", obj=key("customer", "o_custkey"), since=when),
        fact(contains, "invoice", "l_orderkey", "contains", obj=key("part", "l_partkey"), many=True, fid=pair("contains", "l_orderkey", "l_partkey")),
        fact(shipped, "invoice", "l_orderkey", "shipped_by", obj=key("supplier", "l_suppkey"), many=True, fid=pair("shipped_by", "l_orderkey", "l_suppkey")),
        fact(t("customer"), "customer", "c_custkey", "acctbal", num=F.col("c_acctbal"), unit="USD"),
        fact(t("customer"), "customer", "c_custkey", "segment", text=F.col("c_mktsegment")),
        fact(t("customer"), "customer", "c_custkey", "located_in", obj=key("nation", "c_nationkey")),
        fact(t("supplier"), "supplier", "s_suppkey", "located_in", obj=key("nation", "s_nationkey")),
        fact(t("nation"), "nation", "n_nationkey", "part_of", obj=key("region", "n_regionkey")),
        fact(t("part"), "part", "p_partkey", "brand", text=F.col("p_brand")),
        fact(t("part"), "part", "p_partkey", "type", text=F.col("p_type")),
        fact(t("part"), "part", "p_partkey", "size", num=F.col("p_size")),
        fact(t("part"), "part", "p_partkey", "retail_price", num=F.col("p_retailprice"), unit="USD"),
        fact(t("documents"), "document", "doc_id", "lang", text=F.col("lang")),
        fact(t("documents"), "document", "doc_id", "source", text=F.col("source")),
        fact(t("documents"), "document", "doc_id", "n_chars", num=F.col("n_chars")),
        event_chain(spark, sf_dir),
    ])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured messages: the events. id, channel, sender, preview, received_at, sent_at, status, attempts."""
    e = table(spark, sf_dir, "events")
    return e.select(
        key("item", "event_id").alias("id"), F.col("event_type").alias("channel"), key("user", "user_id").alias("sender"), F.col("props").alias("preview"),
        _ntz("ts").alias("received_at"), (_ntz("ts") - F.expr("interval 1 hour")).alias("sent_at"),
        F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 11 == 0, "analyzing").when(F.col("event_id") % 3 == 0, "stored").otherwise("done").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempts"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, seq, text: the documents' lines that aren't blank."""
    d = table(spark, sf_dir, "documents")
    return d.select(key("document", "doc_id").alias("entity_id"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text")).where(F.trim("text") != "")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, embedding, model: every tenth vector has another model's stamp."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(key("emb", "vec_id").alias("id"), F.concat(F.lit("k"), _s("label")).alias("kind"), "embedding", F.when(F.col("vec_id") % 10 == 9, "m0").otherwise("m1").alias("model"), "vec_id")
