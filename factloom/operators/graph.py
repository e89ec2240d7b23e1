"""Graph views: the edges are current facts between two entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .facts import adjacency, current, edge_counts, labelled, live, with_subject
from .storage import cut


def with_edges(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Live entities with their edge count, most connected first by (edges, label, id)."""
    counts = edge_counts(current(facts))
    return live(entities).join(counts, "id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def vault_nodes(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """id, kind, label, degree: how many distinct neighbours."""
    degree = adjacency(facts).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return live(entities).join(degree, "id", "left").select("id", "kind", "label", F.coalesce("degree", F.lit(0)).alias("degree"))


def vault_edges(facts: DataFrame) -> DataFrame:
    """a < b, weight, predicates: one edge for each pair of entities."""
    e = current(facts).where("object_id is not null and subject_id <> object_id")
    return e.groupBy(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).agg(F.count("*").alias("weight"), F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"))


def _neighbours(adj: DataFrame, of: DataFrame) -> DataFrame:
    return adj.join(of.select(F.col("id").alias("a")), "a").select("a", F.col("b").alias("id"), "weight")


def ego(entities: DataFrame, facts: DataFrame, center: str, ring1: int = 14, ring2: int = 18, prefer: list[str] | None = None) -> DataFrame:
    """id, hop, rank, parent: the centre, its most connected neighbours, and theirs.

    Rank: preferred first, then edges, label, id. The parent of a node of the
    second ring is the first node of the first ring that it is tied to.
    """
    adj = cut(adjacency(facts))
    around = entities.sparkSession.createDataFrame([(center,)], "id string")
    for _ in range(2):  # the centre and all within two steps: only their edges are counted
        around = cut(around.unionByName(_neighbours(adj, around).select("id")).distinct())
    ends = current(facts).select(F.explode(F.array("subject_id", "object_id")).alias("id")).join(around, "id", "left_semi").groupBy("id").agg(F.count("*").alias("edges"))
    nodes = live(entities).join(around, "id", "left_semi").join(ends, "id", "left").select("id", "label", F.coalesce("edges", F.lit(0)).alias("edges"), F.col("id").isin(prefer or []).alias("preferred"))
    nodes = cut(nodes)
    order = (F.desc("preferred"), F.desc("edges"), "label", "id")
    start = nodes.where(F.col("id") == center).select("id")
    # a ring holds at most ring1 and ring2 nodes: its window sees one centre's candidates
    one = _neighbours(adj, start).select("id").join(nodes, "id").orderBy(*order).limit(ring1).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    one = cut(one.select("id", F.lit(1).alias("hop"), "rank", F.lit(center).alias("parent")))
    beyond = _neighbours(adj, one).join(one.select(F.col("id").alias("a"), F.col("rank").alias("parent_rank")), "a")
    beyond = beyond.groupBy("id").agg(F.min_by("a", "parent_rank").alias("parent")).join(one.select("id").unionByName(start), "id", "left_anti")
    two = beyond.join(nodes, "id").orderBy(*order).limit(ring2).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    zero = start.select("id", F.lit(0).alias("hop"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("parent"))
    return zero.unionByName(one).unionByName(two.select("id", F.lit(2).alias("hop"), "rank", "parent"))


def clustered_ring(entities: DataFrame, facts: DataFrame, center: str, ring: int = 14, per_kind: int = 3) -> DataFrame:
    """The first ring with its tail folded: kind, members (kept ones alone, then one row for each kind's rest), count, predicate.

    At most per_kind of a kind and ring in all are kept, by edges and label; a
    kind's single straggler takes a free place. A folded row has the predicate
    that ties most of its members to the centre.
    """
    nodes = with_edges(entities, facts)
    near = adjacency(facts).where(F.col("a") == center).select(F.col("b").alias("id")).join(nodes, "id")
    order = (F.desc("edges"), "label", "id")
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(*order)))
    fit = F.col("k") <= per_kind
    w = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    heads = ranked.where(fit).orderBy(*order).limit(ring).withColumn("rank", F.count("*").over(w)).select("id", "rank")
    heads = cut(heads)
    rest = ranked.join(heads.select("id"), "id", "left_anti")
    free = F.lit(ring) - heads.agg(F.count("*").alias("n")).first()["n"]
    tails = rest.groupBy("kind").agg(F.count("*").alias("count"), F.min("id").alias("one"), F.min(F.struct((-F.col("edges")).alias("less"), "label", "id")).alias("first"))
    lone = tails.where("count = 1").withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first"))).where(F.col("n") <= free)
    kept = heads.join(nodes.select("id", "kind"), "id").select("kind", F.col("id").alias("member"), F.lit(1).cast("bigint").alias("count"))
    kept = kept.unionByName(lone.select("kind", F.col("one").alias("member"), F.lit(1).cast("bigint").alias("count"))).withColumn("predicate", F.lit(None).cast("string"))
    folded = tails.join(lone.select("kind"), "kind", "left_anti")
    e = current(facts).where((F.col("subject_id") == center) | (F.col("object_id") == center))
    ties = e.select(F.when(F.col("subject_id") == center, F.col("object_id")).otherwise(F.col("subject_id")).alias("id"), "predicate").join(rest.select("id", "kind"), "id")
    ties = ties.groupBy("kind", "predicate").agg(F.count("*").alias("n")).groupBy("kind").agg(F.min_by("predicate", F.struct(-F.col("n"), "predicate")).alias("predicate"))
    folded = folded.join(ties, "kind", "left").select("kind", F.lit(None).cast("string").alias("member"), "count", "predicate")
    return kept.unionByName(folded)


def breadth_first(facts: DataFrame, center: str) -> DataFrame:
    """(id, depth) of all entities reachable from the centre, however deep; each level's rows, and what has been seen, are written before the next."""
    adj = cut(adjacency(facts).select("a", "b"))
    spark = facts.sparkSession
    level = spark.createDataFrame([(center,)], "id string")
    seen = level.withColumn("depth", F.lit(0))
    depth = 0
    while True:
        depth += 1
        level = cut(adj.join(level, adj["a"] == level["id"]).select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti"))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level.withColumn("depth", F.lit(depth)))
        if depth % 16 == 0:  # a deep graph's plan stays short
            seen = cut(seen)


def layered(entities: DataFrame, facts: DataFrame, center: str, fold: int = 7) -> DataFrame:
    """id, depth, parent, shown: each entity under the first parent of the level above; past ``fold`` children the rest are folded.

    Parents are ordered by their place in their own level; children by edges,
    label, id. A single child over the limit is shown, not folded.
    """
    depths = breadth_first(facts, center)
    nodes = cut(depths.join(with_edges(entities, facts).select("id", "label", "edges"), "id"))
    up = adjacency(facts).select(F.col("a").alias("id"), F.col("b").alias("parent"))
    deep = nodes.select(F.col("id"), "depth")
    ties = up.join(deep, "id").join(deep.select(F.col("id").alias("parent"), F.col("depth").alias("parent_depth")), "parent").where("parent_depth = depth - 1")
    placed = cut(nodes.where("depth = 0").select("id", "depth", F.lit(None).cast("string").alias("parent"), F.array(F.lit(1)).alias("place"), F.lit(True).alias("shown")))
    level, all_levels = placed, [placed]
    depth = 0
    while not level.isEmpty():
        depth += 1
        own = ties.where(F.col("depth") == depth).join(level.select(F.col("id").alias("parent"), "place"), "parent").groupBy("id").agg(F.min(F.struct("place", "parent")).alias("p"))
        own = own.join(nodes.select("id", "label", "edges"), "id")
        w = Window.partitionBy("p").orderBy(F.desc("edges"), "label", "id")
        own = own.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("p")))
        # a place is the path of child numbers from the centre: it orders a level without numbering it as a whole
        place = F.concat("p.place", F.array("k"))
        level = cut(own.select("id", F.lit(depth).alias("depth"), F.col("p.parent").alias("parent"), place.alias("place"), ((F.col("k") <= fold) | (F.col("n") == fold + 1)).alias("shown")))
        all_levels.append(level)
    return reduce(DataFrame.unionByName, all_levels).select("id", "depth", "parent", "shown")


def dataset_nodes(rows: DataFrame) -> DataFrame:
    """dataset, entity_id rows to nodes and contains edges; a dataset without rows of entities has no node."""
    r = rows.where("entity_id is not null").distinct()
    nodes = r.groupBy("dataset").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), F.concat(F.lit("dataset:"), "dataset").alias("a"), F.lit(None).cast("string").alias("b"), "n")
    edges = r.select(F.lit("contains").alias("what"), F.concat(F.lit("dataset:"), "dataset").alias("a"), F.col("entity_id").alias("b"), F.lit(1).cast("bigint").alias("n"))
    return nodes.unionByName(edges)


def sources_with_body(entities: DataFrame, facts: DataFrame, center: str, bodies: DataFrame, limit: int = 8) -> DataFrame:
    """The entities with a body that are linked either way to the centre, most connected first."""
    near = adjacency(facts).where(F.col("a") == center).select(F.col("b").alias("id"))
    return with_edges(entities, facts).join(near, "id", "left_semi").join(bodies, "id", "left_semi").orderBy(F.desc("edges"), "label", "id").limit(limit).select("id", "label", "edges")


def node_resolver(entities: DataFrame) -> DataFrame:
    """(name, id): the first entity, by (created_at, id), of each label in lower case."""
    name = F.lower(F.trim("label"))
    return live(entities).groupBy(name.alias("name")).agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def resolve_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows with a target name, and the entity it names (null if none)."""
    names = node_resolver(entities)
    return links.join(names, F.lower(F.trim(links["target"])) == names["name"], "left").drop("name").withColumnRenamed("id", "target_id")


def schema_graph(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """kind, predicate, target_kind, count: the relations between different kinds as used."""
    f = labelled(with_subject(current(facts).where("object_id is not null"), live(entities)), live(entities))
    return f.where("object_kind is not null and object_kind <> subject_kind").groupBy("subject_kind", "predicate", "object_kind").agg(F.count("*").alias("count"))


def dossier(entities: DataFrame, facts: DataFrame, center: str, limit: int = 500) -> DataFrame:
    """ord, subject_label, predicate, value, citation: the first ``limit`` facts within a hop, the entity's own first; sources are numbered as they appear."""
    from .facts import value

    near = adjacency(facts).where(F.col("a") == center).select(F.col("b").alias("subject_id")).unionByName(entities.sparkSession.createDataFrame([(center,)], "subject_id string"))
    f = labelled(with_subject(current(facts).join(near, "subject_id", "left_semi"), entities), entities)
    f = f.withColumn("own", F.col("subject_id") == center).withColumn("value", value())
    f = f.orderBy(F.desc("own"), "subject_label", "predicate", "id").limit(limit)
    f = f.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("own"), "subject_label", "predicate", "id")))
    first = f.where("source_item_id is not null").groupBy("source_item_id").agg(F.min("ord").alias("first"))
    cites = first.withColumn("citation", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("first"))).drop("first")
    return f.join(cites, "source_item_id", "left").select("ord", "subject_label", "predicate", "value", "citation")
