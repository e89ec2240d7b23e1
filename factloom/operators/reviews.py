"""Reviews: what waits for a decision, how it is shown, and what accepting or rejecting it does.

A review has id, kind, status, confidence, impact, source_id, target_id,
old_fact_id, new_fact_id, item_id, detail (a map), entity_ids (of an orphan
batch) and created_at. Decisions are plans over whole batches: each takes the
reviews decided alike and returns the facts, entities or sources after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import edge_counts, labelled, live, value
from .knowledge import unlinked
from .resolve import filter_pairs, merge_entities, orphans, winners

KINDS = ("entity_merge", "fact_conflict", "extraction", "off_template", "category_proposal", "field_proposal", "orphan_prune")


def triage() -> list[Column]:
    """The order of pending reviews: what matters most, then what is surest (unknown last)."""
    return [F.desc("impact"), F.desc_nulls_last("confidence"), F.col("id")]


def pending(reviews: DataFrame) -> DataFrame:
    return reviews.where("status = 'pending'")


def by_kind(reviews: DataFrame) -> DataFrame:
    """kind, place (of the kind, in the fixed order), n, first (the review to look at first); kinds without reviews are out."""
    w = Window.partitionBy("kind").orderBy(*triage())
    ranked = pending(reviews).withColumn("nth", F.row_number().over(w))
    return ranked.groupBy("kind").agg(F.count("*").alias("n"), F.min_by("id", "nth").alias("first")).withColumn("place", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))).select("kind", "place", "n", "first")


def merge_impact(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, impact): how many facts, current or not, refer to each of the entities; at both ends counts twice."""
    return ids.select("id").distinct().join(edge_counts(facts), "id", "left").select("id", F.coalesce("edges", F.lit(0)).alias("impact"))


def conflict_impact(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, impact): the sources of an old fact and one more."""
    n = sources.groupBy("fact_id").agg(F.count("*").alias("n"))
    return facts.select(F.col("id").alias("fact_id")).join(n, "fact_id", "left").select("fact_id", (F.coalesce("n", F.lit(0)) + 1).alias("impact"))


def _said(facts: DataFrame, entities: DataFrame, prefix: str) -> DataFrame:
    f = labelled(facts, entities)
    return f.select(F.col("id").alias(f"{prefix}_fact_id"), value().alias(prefix), F.col("subject_id").alias(f"{prefix}_subject"), F.col("predicate").alias(f"{prefix}_predicate"))


def shown(reviews: DataFrame, facts: DataFrame, entities: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """id, kind, title, was, now, note, impact, confidence: each pending review as its card says it, in triage order."""
    names = lambda k: entities.select(F.col("id").alias(f"{k}_id"), F.col("label").alias(f"{k}_label"))
    n = sources.groupBy("fact_id").agg(F.count("*").alias("n"))
    count = lambda k: n.select(F.col("fact_id").alias(f"{k}_fact_id"), F.col("n").alias(f"{k}_sources"))
    r = pending(reviews).join(names("source"), "source_id", "left").join(names("target"), "target_id", "left")
    for k in ("old", "new"):
        r = r.join(_said(facts, entities, k), f"{k}_fact_id", "left").join(count(k), f"{k}_fact_id", "left")
    r = r.join(entities.select(F.col("id").alias("new_subject"), F.col("label").alias("subject")), "new_subject", "left")
    r = r.join(items.select(F.col("id").alias("item_id"), "sender", "preview"), "item_id", "left")
    d = lambda k: F.nullif(F.element_at("detail", k), F.lit(""))
    sourced = lambda k: F.concat(F.coalesce(f"{k}_sources", F.lit(1)).cast("string"), F.when(F.coalesce(f"{k}_sources", F.lit(1)) == 1, " source").otherwise(" sources"))
    held = F.coalesce(d("held") == "true", F.lit(False))
    is_a = lambda k: F.col("kind") == k
    title = (
        F.when(is_a("entity_merge"), F.concat_ws(" = ", F.coalesce("source_label", d("parsedLabel"), F.lit("?")), F.coalesce("target_label", F.lit("?"))))
        .when(is_a("fact_conflict"), F.concat_ws(" · ", F.coalesce("subject", F.lit("?")), F.coalesce(d("predicate"), "new_predicate", F.lit("value"))))
        .when(is_a("extraction"), F.coalesce("sender", F.lit("a message")))
        .when(is_a("off_template"), F.coalesce(d("docLabel"), F.lit("a document")))
        .when(is_a("category_proposal"), F.coalesce(d("label"), d("proposedKind"), F.lit("New category")))
        .when(is_a("field_proposal"), F.concat_ws(".", F.coalesce(d("kind"), F.lit("thing")), F.coalesce(d("predicate"), F.lit("?"))))
        .otherwise(F.concat(F.coalesce(F.size("entity_ids"), F.lit(0)).cast("string"), F.lit(" unlinked")))
    )
    note = (
        F.when(is_a("entity_merge"), F.coalesce(d("reason"), F.lit("Similar name and overlapping identifiers.")))
        .when(is_a("fact_conflict") & held, F.lit("held"))
        .when(is_a("fact_conflict"), F.concat_ws(" / ", sourced("old"), sourced("new")))
        .when(is_a("extraction"), F.coalesce(d("snippet"), "preview", F.lit("")))
        .otherwise(F.coalesce(d("count"), F.lit("")))
    )
    conflict = is_a("fact_conflict")
    return r.select("id", "kind", title.alias("title"), F.when(conflict, F.coalesce("old", F.lit("?"))).alias("was"), F.when(conflict, F.coalesce("new", F.lit("?"))).alias("now"), note.alias("note"), "impact", "confidence").orderBy(*triage())


def _held() -> Column:
    return F.coalesce(F.element_at("detail", "held") == "true", F.lit(False))


def _moved(facts: DataFrame, closed: DataFrame, opened: DataFrame, now: Column) -> DataFrame:
    """Facts after some are closed (id, by) and some are current again (id)."""
    c = closed.groupBy("id").agg(F.min("by").alias("by")).withColumn("shut", F.lit(True))
    o = opened.select("id").distinct().withColumn("open", F.lit(True))
    out = facts.join(c, "id", "left").join(o, "id", "left")
    until = F.when(F.col("open"), F.lit(None)).when(F.col("shut"), now).otherwise(F.col("valid_to"))
    after = F.when(F.col("open"), F.lit(None)).when(F.col("shut"), F.coalesce("by", "superseded_by")).otherwise(F.col("superseded_by"))
    return out.withColumn("valid_to", until.cast(facts.schema["valid_to"].dataType)).withColumn("superseded_by", after).select(facts.columns)


def accept_conflicts(facts: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """Held conflicts are applied: the old fact is superseded by the new one. Others were applied when they came."""
    r = reviews.where(F.col("kind") == "fact_conflict").where(_held() & F.col("old_fact_id").isNotNull() & F.col("new_fact_id").isNotNull())
    return _moved(facts, r.select(F.col("old_fact_id").alias("id"), F.col("new_fact_id").alias("by")), r.select(F.col("new_fact_id").alias("id")), now)


def reject_conflicts(facts: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """Conflicts that were applied are taken back: the new fact is closed, the old one holds again. Held ones change nothing."""
    r = reviews.where(F.col("kind") == "fact_conflict").where(~_held() & F.col("old_fact_id").isNotNull() & F.col("new_fact_id").isNotNull())
    return _moved(facts, r.select(F.col("new_fact_id").alias("id"), F.lit(None).cast("string").alias("by")), r.select(F.col("old_fact_id").alias("id")), now)


def accept_merges(facts: DataFrame, entities: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, entities) after the merges that were accepted."""
    return merge_entities(facts, entities, reviews.where("kind = 'entity_merge' AND source_id IS NOT NULL AND target_id IS NOT NULL").select(F.col("source_id").alias("loser"), F.col("target_id").alias("winner")))


def prunable(entities: DataFrame, facts: DataFrame, reviews: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The entities of accepted orphan batches that are still unlinked, without a body, and not used of late (entities has has_body, last_used_at)."""
    asked = reviews.where("kind = 'orphan_prune'").select(F.explode("entity_ids").alias("id")).distinct()
    idle = F.col("last_used_at").isNull() | (F.col("last_used_at") < now - F.expr(f"INTERVAL {days} DAYS"))
    return unlinked(entities.join(asked, "id", "left_semi").where(~F.col("has_body") & idle), facts)


def accept_prunes(entities: DataFrame, facts: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    return entities.join(prunable(entities, facts, reviews, now).select("id"), "id", "left_anti")


def retract(facts: DataFrame, sources: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, sources) after extractions are rejected: their items' sources go, and facts of these items that no other source holds."""
    items = reviews.where("kind = 'extraction' AND item_id IS NOT NULL").select("item_id").distinct()
    left = sources.join(items, sources["source_item_id"] == items["item_id"], "left_anti")
    mine = facts.join(items, facts["source_item_id"] == items["item_id"], "left_semi").select("id")
    gone = mine.join(left.select(F.col("fact_id").alias("id")), "id", "left_anti")
    return facts.join(gone, "id", "left_anti"), left


def grown_vocabulary(vocabulary: DataFrame, reviews: DataFrame) -> DataFrame:
    """(kind, predicate, alias_of, as_relation) after field proposals are accepted; what is in a template already stays as it is."""
    d = lambda k: F.nullif(F.element_at("detail", k), F.lit(""))
    new = reviews.where("kind = 'field_proposal'").select(d("kind").alias("kind"), d("predicate").alias("predicate"), d("aliasOf").alias("alias_of"), F.coalesce(d("asRelation") == "true", F.lit(False)).alias("as_relation")).where("kind is not null and predicate is not null").dropDuplicates(["kind", "predicate"])
    known = vocabulary.select("kind", "predicate", "alias_of", "as_relation")
    return known.unionByName(new.join(known, ["kind", "predicate"], "left_anti").select(known.columns))


def resolved(reviews: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """The reviews with those of the ids that were pending decided."""
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    out = reviews.join(hit, "id", "left")
    done = F.coalesce(F.col("hit") & (F.col("status") == "pending"), F.lit(False))
    return out.withColumn("resolved_at", F.when(done, now).otherwise(F.col("resolved_at"))).withColumn("status", F.when(done, status).otherwise(F.col("status"))).select(reviews.columns)


def merge_reviews(pairs: DataFrame, reviewed: DataFrame, entities: DataFrame, propose: float = 0.75, auto: float = 0.85) -> DataFrame:
    """source_id, target_id, confidence, status: the consolidation pass over candidate pairs (a_id, b_id, sim) where no model judges.

    Alike labels are proposed, never merged by themselves (the confidence stays
    under the bound of automatic merges); the rest is settled as rejected, so
    that a pair is asked once. entities has natural_keys, edges, support and created_at.
    """
    asked = filter_pairs(pairs, reviewed, entities)
    chosen = winners(asked, entities)
    both = asked.join(chosen.select(F.least("winner", "loser").alias("a_id"), F.greatest("winner", "loser").alias("b_id"), "winner", "loser"), ["a_id", "b_id"])
    confidence = F.when(F.col("sim") >= propose, F.least(F.col("sim"), F.lit(auto - 0.01))).otherwise(0.0)
    return both.select(F.col("loser").alias("source_id"), F.col("winner").alias("target_id"), confidence.alias("confidence"), F.when(F.col("sim") >= propose, "pending").otherwise("rejected").alias("status"))


def orphan_reviews(entities: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """id, kind, label of the orphans that no batch has asked about, whatever became of it."""
    asked = reviews.where("kind = 'orphan_prune'").select(F.explode("entity_ids").alias("id")).distinct()
    return orphans(entities, now).join(asked, "id", "left_anti").select("id", "kind", "label")


def neighbours(facts: DataFrame, entities: DataFrame, centers: DataFrame, cap: int = 5) -> DataFrame:
    """center, place, predicate, id, label, outgoing: a preview of what each centre is tied to, its own facts first."""
    f = facts.where("valid_to is null and object_id is not null and subject_id <> object_id")
    out = f.select(F.col("subject_id").alias("center"), "predicate", F.col("object_id").alias("id"), F.lit(True).alias("outgoing"), F.col("id").alias("fact_id"))
    back = f.select(F.col("object_id").alias("center"), "predicate", F.col("subject_id").alias("id"), F.lit(False).alias("outgoing"), F.col("id").alias("fact_id"))
    each = out.unionByName(back).join(centers.select(F.col("id").alias("center")).distinct(), "center")
    first = each.groupBy("center", "id").agg(F.min(F.struct((~F.col("outgoing")).alias("back"), "fact_id", "predicate")).alias("f"))
    w = Window.partitionBy("center").orderBy("f")
    top = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    return top.join(live(entities).select("id", "label"), "id").select("center", "place", F.col("f.predicate").alias("predicate"), "id", "label", (~F.col("f.back")).alias("outgoing"))


def accepted_summary(proposals: DataFrame) -> DataFrame:
    """dataset, actor, adds, updates, summary: what accepting a set of proposals did to each table (dataset, kind, actor)."""
    p = proposals.groupBy("dataset").agg(F.count_if(F.col("kind") != "update").alias("adds"), F.count_if(F.col("kind") == "update").alias("updates"), F.min(F.coalesce("actor", F.lit("An agent"))).alias("least"), F.max(F.coalesce("actor", F.lit("An agent"))).alias("most"))
    actor = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("Agents")
    counted = lambda c, one, many: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, f" {one}").otherwise(f" {many}")))
    parts = F.concat_ws(", ", counted("adds", "row added", "rows added"), counted("updates", "change applied", "changes applied"))
    return p.select("dataset", actor.alias("actor"), "adds", "updates", F.concat(F.lit("Accepted "), actor, F.lit("'s update — "), parts).alias("summary"))


def pending_by_agent(proposals: DataFrame) -> DataFrame:
    """agent, changes, tables (names, sorted): what each agent has waiting (dataset, agent)."""
    return proposals.groupBy("agent").agg(F.count("*").alias("changes"), F.array_join(F.array_sort(F.collect_set("dataset")), ", ").alias("tables"))


def table_list(datasets: DataFrame, rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """dataset, name, accepted, proposed, versions, last_version, changed_at: each table with its counts, newest change first.

    rows: dataset, status, updated_at; snapshots: dataset, version.
    """
    n = rows.groupBy("dataset").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "proposed").alias("proposed"), F.max("updated_at").alias("changed_at"))
    v = snapshots.groupBy("dataset").agg(F.count("*").alias("versions"), F.max("version").alias("last_version"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = datasets.select("dataset", "name").join(n, "dataset", "left").join(v, "dataset", "left")
    return out.select("dataset", "name", zero("accepted"), zero("proposed"), zero("versions"), "last_version", "changed_at").orderBy(F.desc_nulls_last("changed_at"), "dataset")
