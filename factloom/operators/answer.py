"""Search as a whole: seeds, evidence with citation numbers, and the search's plain and answering modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snip
from .facts import live
from .graph import with_edges
from .search import SEED_SCORE, expand, keyword_passages, link_entities, merge_hits, merge_passages, search_entities, search_rows, top_vectors
from .storage import cut
from .vector_index import VectorIndex


def seeds(text: DataFrame, ann: DataFrame) -> DataFrame:
    """(id, ord): the distinct seeds, those found by text first, each leg in its own order (rank)."""
    both = text.select("id", F.lit(0).alias("leg"), "rank").unionByName(ann.select("id", F.lit(1).alias("leg"), "rank"))
    first = both.groupBy("id").agg(F.min(F.struct("leg", "rank")).alias("at"))
    return first.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at", "id")).alias("ord"))  # a few ids


def _cell(c: Column | str) -> Column:
    return snip(c, 80)


def entity_lines(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence of entities (id, kind, label, rank) with their facts (id, predicate, value, ref, place)."""
    said = F.concat(F.regexp_replace("predicate", "_", " "), F.when(F.col("ref"), " →").otherwise(""), F.lit(" "), "value")
    own = facts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))), lambda x: x["said"]), " · ").alias("said"))
    line = F.concat(F.lit("Known "), "kind", F.lit(' "'), "label", F.lit('"'), F.when(F.coalesce("said", F.lit("")) != "", F.concat(F.lit(": "), "said")).otherwise(F.lit("")))
    return hits.join(own, "id", "left").select(F.lit("entity").alias("type"), F.lit(0).alias("leg"), "rank", "label", line.alias("line"), F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("dataset"))


def row_lines(hits: DataFrame, labels: dict[str, str], dataset: str) -> DataFrame:
    """Evidence of table rows (id, data, entity_id, rank): the cells that aren't empty, by their columns' labels."""
    cells = F.filter(F.array(*(F.struct(F.lit(label).alias("k"), F.coalesce(F.element_at("data", key), F.lit("")).alias("v")) for key, label in labels.items())), lambda c: c["v"] != "")
    row = F.array_join(F.transform(cells, lambda c: F.concat(c["k"], F.lit("="), _cell(c["v"]))), " · ")
    first = F.coalesce(F.try_element_at(cells, F.lit(1))["v"], F.lit("row"))
    return hits.select(F.lit("row").alias("type"), F.lit(1).alias("leg"), "rank", F.concat(F.lit(f"{dataset} — "), _cell(first)).alias("label"), F.concat(F.lit(f'Row in table "{dataset}": '), row).alias("line"), "entity_id", F.lit(dataset).alias("dataset"))


def passage_lines(hits: DataFrame) -> DataFrame:
    """Evidence of passages (entity_id, label, page or null, text, rank)."""
    page = lambda before, after: F.coalesce(F.concat(F.lit(before), F.col("page").cast("string"), F.lit(after)), F.lit(""))
    return hits.select(F.lit("passage").alias("type"), F.lit(2).alias("leg"), "rank", F.concat("label", page(" · p.", "")).alias("label"), F.concat(F.lit('Passage from document "'), "label", F.lit('"'), page(" (page ", ")"), F.lit(': "'), "text", F.lit('"')).alias("line"), "entity_id", F.lit(None).cast("string").alias("dataset"))


def evidence(*legs: DataFrame, most: tuple[int, ...] = (8, 8, 5)) -> DataFrame:
    """n, type, label, line, entity_id, dataset: the numbered sources that an answer may cite, leg after leg."""
    out = None
    for df in legs:
        leg = df.where(F.col("rank") <= F.element_at(F.array(*map(F.lit, most)), F.col("leg") + 1))
        out = leg if out is None else out.unionByName(leg)
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("leg", "rank"))  # at most sum(most) rows
    return out.withColumn("n", n).select("n", "type", "label", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "line").alias("line"), "entity_id", "dataset")


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # reports of a few rows


def found_entities(facts: DataFrame, entities: DataFrame, terms: list[str], limit: int = 12) -> DataFrame:
    """id, kind, label, connections, ord: the entities that a query names, then those that its terms hit."""
    nodes = with_edges(entities, facts)
    named = _ranked(link_entities(nodes, terms), F.desc("score"), "label", "id").select("id", F.lit(0).alias("leg"), "rank")
    hits = _ranked(search_entities(facts, entities, terms, limit), F.desc("score"), "label", "id").select("id", F.lit(1).alias("leg"), "rank")
    first = named.unionByName(hits).groupBy("id").agg(F.min(F.struct("leg", "rank")).alias("at"))
    out = first.join(nodes, "id").select("id", "kind", "label", F.col("edges").alias("connections"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")).alias("ord"))
    return out.where(F.col("ord") <= limit)


def _none(df: DataFrame) -> Column:
    """True if a plan has no rows, as a subquery of the plan that asks."""
    return df.agg(F.count("*") == 0).scalar()


def context(facts: DataFrame, entities: DataFrame, terms: list[str], most_facts: int = 12) -> DataFrame:
    """ord, line: what is known around a query: its seeds' neighbourhood, or the best keyword hits where it names nothing."""
    known = live(entities)
    start = cut(link_entities(known, terms, facts=facts).select("id"))
    named = not start.isEmpty()
    if not named:
        start = search_entities(facts, entities, terms, 6).select("id")
    found = cut(expand(facts, known, start, 8, most_facts))
    if not named:  # keyword hits stand for themselves, without neighbours
        found = found.where(F.col("score") == SEED_SCORE)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("  - "), F.regexp_replace("predicate", "_", " "), F.lit(": "), "value").alias("l")))), lambda x: x["l"])
    out = found.groupBy("id", "label", "score").agg(lines.alias("lines")).join(live(entities).select("id", "kind"), "id")
    line = F.array_join(F.concat(F.array(F.concat(F.lit("◆ "), "label", F.lit(" ("), "kind", F.lit(")"))), "lines"), "\n")
    return _ranked(out, F.desc("score"), "label", "id").select(F.col("rank").alias("ord"), line.alias("line"))


@dataclass
class Found:
    """What a search gives: table rows, entities and passages; in answer mode the numbered evidence as well."""

    rows: DataFrame
    entities: DataFrame
    passages: DataFrame
    evidence: DataFrame | None = None


def search(
    facts: DataFrame, entities: DataFrame, passages: DataFrame, terms: list[str], rows: DataFrame | None = None, labels: dict[str, str] | None = None, dataset: str = "",
    passage_vectors: DataFrame | None = None, entity_vectors: DataFrame | VectorIndex | None = None, vector: list[float] | None = None, model: str = "", answer: bool = False,
) -> Found:
    """Keyword hits in rows, entities and passages, and passages by their vectors.

    With ``answer``, graph-first evidence: seeds by text and by vector, their
    neighbourhood, and the passages of both legs within it (everywhere, where
    the query names nothing). passages may have a page, which its citation then
    says. passage_vectors: entity_id, seq, embedding, model; entity_vectors: id,
    embedding, model, or an index of them.
    """
    paged = passages if "page" in passages.columns else passages.withColumn("page", F.lit(None).cast("int"))
    hits = search_rows(rows, terms, labels or {}, dataset) if rows is not None else None
    ents = search_entities(facts, entities, terms)
    columns = ("entity_id", "seq", "score", "text")
    word = keyword_passages(paged, terms).select(*columns)

    def semantic(scope: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if passage_vectors is None or vector is None:
            return word.limit(0)
        near = top_vectors(scope(passage_vectors).withColumn("id", F.concat_ws("#", "entity_id", F.lpad(F.col("seq").cast("string"), 12, "0"))), vector, model, 18, 0.2)
        return near.select("entity_id", "seq", F.col("sim").alias("score")).join(paged.select("entity_id", "seq", "text"), ["entity_id", "seq"]).select(*columns)

    if not answer:
        return Found(hits, ents, merge_passages(word, semantic(lambda df: df)))
    nodes = live(entities)
    start = _ranked(link_entities(nodes, terms, facts=facts), F.desc("score"), "label", "id").select("id", "rank")
    ann = start.limit(0)
    if entity_vectors is not None and vector is not None:
        ann = _ranked(top_vectors(entity_vectors, vector, model, 4, 0.35), F.desc("sim"), "id").select("id", "rank")
    graph = cut(expand(facts, nodes, seeds(start, ann)))
    merged = merge_hits(ents, graph)
    scope = graph.select(F.col("id").alias("entity_id")).distinct().withColumn("inside", F.lit(True))
    empty = _none(scope)

    def inside(df: DataFrame) -> DataFrame:
        return df.join(scope, "entity_id", "left").where(F.coalesce("inside", empty)).drop("inside")

    some = cut(merge_passages(inside(word), semantic(inside)))
    known = graph.select("id", "predicate", "value", F.lit(False).alias("ref"), F.col("rank").alias("place")).distinct()
    legs = [entity_lines(_ranked(merged.join(live(entities).select("id", "kind"), "id"), F.desc("score"), "label", "id"), known)]
    if hits is not None:
        legs.append(row_lines(_ranked(hits.withColumn("entity_id", F.lit(None).cast("string")), F.desc("score"), "id"), labels or {}, dataset))
    # a few passages: only what belongs to them is joined
    labels = entities.select(F.col("id").alias("entity_id"), "label").join(some, "entity_id", "left_semi")
    pages = paged.select("entity_id", "seq", "page").join(some, ["entity_id", "seq"], "left_semi")
    titles = some.join(labels, "entity_id", "left").withColumn("label", F.coalesce("label", "entity_id")).join(pages, ["entity_id", "seq"], "left")
    legs.append(passage_lines(_ranked(titles, F.desc("score"), "entity_id", "seq")))
    return Found(hits, ents, some, evidence(*legs))


def cited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources (answer_id, n, ...) that an answer's text cites as [n], by first mention; an answer that cites none has none."""
    marks = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    each = answers.select("answer_id", F.posexplode(F.array_distinct(marks)).alias("place", "n"))
    out = each.join(sources, ["answer_id", "n"])
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("answer_id").orderBy("place"))).drop("place")


