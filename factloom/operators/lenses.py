"""Folder lenses over filed documents, folder plans, and tree placement of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import month_name
from ..functions.text import file_slug, sanitize_folder_path

UNFILED = "unfiled"
#: The kinds that a lens on links groups by (fixed values).
LINK_KINDS = {"client": ("company", "organization", "client", "customer"), "person": ("person", "contact", "customer"), "project": ("project", "deal"), "topic": ("concept", "topic", "part")}


def type_name(kind: Column, media: Column) -> Column:
    m = F.lower(F.coalesce(media, F.lit("")))
    return (
        F.when(kind == "note", "notes").when(m.contains("pdf"), "pdfs").when(m.startswith("image/"), "images").when(m.startswith("audio/"), "audio")
        .when(m.rlike("spreadsheet|excel|csv"), "sheets").when(m.startswith("text/"), "text").when(kind == "document", "other files").otherwise(F.concat(kind, F.lit("s")))
    )


def lens_values(docs: DataFrame, lens: str) -> Column:
    """The folders of a document under a lens: docs has kind, media, channel, received_at, links (kind, label)."""
    if lens in LINK_KINDS:
        kinds = LINK_KINDS[lens]
        return F.array_distinct(F.transform(F.filter("links", lambda x: F.lower(x["kind"]).isin(*kinds)), lambda x: x["label"]))
    value = {"month": month_name("received_at"), "type": type_name(F.col("kind"), F.col("media")), "channel": F.col("channel")}[lens]
    return F.filter(F.array(value), lambda v: v.isNotNull())


def available(docs: DataFrame, lenses: list[str]) -> DataFrame:
    """(lens, folders): those with two folders, or one that doesn't take everything."""
    each = F.array(*(F.struct(F.lit(x).alias("lens"), lens_values(docs, x).alias("v")) for x in lenses))
    rows = docs.select(F.explode(each).alias("l")).select("l.lens", F.explode_outer("l.v").alias("v"))
    counts = rows.groupBy("lens").agg(F.count_distinct("v").alias("folders"), F.bool_or(F.col("v").isNull()).alias("unfiled"))
    return counts.where("folders >= 2 or (folders = 1 and unfiled)").select("lens", "folders")


def tree(docs: DataFrame, stack: list[str]) -> DataFrame:
    """(id, path): where documents lie under a stack of lenses; a folder of a single document has no folders below.

    A document of several values is in several folders; one of none is unfiled.
    """
    at = docs.withColumn("path", F.lit("")).withColumn("open", F.lit(True))
    for depth, lens in enumerate(stack):
        values = lens_values(docs, lens)
        names = F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(UNFILED)))
        below = at.where("open").withColumn("name", F.explode(names)).withColumn("path", F.when(F.lit(depth == 0), F.col("name")).otherwise(F.concat_ws("/", "path", "name")))
        below = below.withColumn("open", F.count("*").over(Window.partitionBy("path")) > 1).drop("name")
        at = below.unionByName(at.where(~F.col("open")))
    return at.select("id", "path")


def folders(placed: DataFrame) -> DataFrame:
    """(path, total): every folder with what it and those below hold, largest first in its parent, unfiled last."""
    parts = F.split("path", "/", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    out = placed.select("id", F.explode(up).alias("path")).distinct().groupBy("path").agg(F.count("*").alias("total"))
    return out.orderBy(F.element_at(F.split("path", "/"), -1) == UNFILED, F.desc("total"), "path")


def plan_files(documents: DataFrame) -> DataFrame:
    """(id, path, filename) from id, label, folder: safe folders; equal names in a folder get -2, -3 and so on."""
    out = documents.select("id", sanitize_folder_path("folder").alias("path"), file_slug("label", "", empty="document").alias("stem"))
    n = F.row_number().over(Window.partitionBy("path", "stem").orderBy("id"))
    return out.withColumn("n", n).select("id", "path", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".md")).alias("filename"))
