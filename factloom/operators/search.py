"""Keyword, vector and graph-first search, routing and chunk selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine, rounded, semantic_boost
from ..functions.sections import chunk_text
from ..functions.text import normalize_terms, snip
from .facts import begins, current, edges_of, heads, live, value
from .storage import cut
from .vector_index import VectorIndex


def term_hits(hay: Column, terms: list[str]) -> Column:
    """The terms that a text contains."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(hay, t))


def _hit_bits(hay: Column, terms: list[str]) -> Column:
    """A bit for each of the distinct terms (63 at most) that a text contains."""
    terms = list(dict.fromkeys(terms))
    if len(terms) > 63:
        raise ValueError("a query has 63 terms at most")
    out = F.lit(0).cast("bigint")
    for i, t in enumerate(terms):
        out = out.bitwiseOR(F.when(F.contains(hay, F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return out


def search_rows(rows: DataFrame, terms: list[str], labels: dict[str, str], name: str, data: str = "data", limit: int | None = 40) -> DataFrame:
    """Table rows by how many distinct terms a cell (with its column's label) or the table's name contains."""
    cells = [F.lower(F.concat(F.lit(f"{label} "), F.coalesce(F.element_at(F.col(data), key), F.lit("")))) for key, label in labels.items()]
    found = F.array_distinct(F.flatten(F.array(term_hits(F.lit(name.lower()), terms), *(term_hits(c, terms) for c in cells))))
    out = rows.withColumn("score", F.size(found)).where("score > 0").orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit else out


def search_entities(facts: DataFrame, entities: DataFrame, terms: list[str], limit: int | None = 20) -> DataFrame:
    """Live entities by the distinct terms in their label, kind and keys, and in their facts: id, label, score."""
    e = live(entities)
    keys = F.array_join(F.transform(F.map_entries("natural_keys"), lambda x: F.concat(x["key"], F.lit(" "), x["value"])), " ")
    # which terms hit, as bits: one partial aggregate instead of a distinct over (entity, term); the sign is an entity's own
    head = e.select("id", _hit_bits(F.lower(F.concat_ws(" ", "label", "kind", keys)), terms).bitwiseOR(F.lit(-(1 << 63))).alias("hits"))
    now = current(facts)
    links = now.where("object_id is not null").select("subject_id", "predicate", "object_id")
    objects = entities.select(F.col("id").alias("object_id"), F.col("label").alias("object_label"))
    if any(" " in t or t in "?" for t in terms):
        linked = links.join(objects, "object_id", "left").select(F.col("subject_id").alias("id"), _hit_bits(F.lower(F.concat_ws(" ", "predicate", F.coalesce("object_label", F.lit("?")))), terms).alias("hits"))
    else:
        # no term spans predicate and label, so only facts about objects whose label has one are joined
        named = objects.select("object_id", _hit_bits(F.lower("object_label"), terms).alias("hits")).where("hits <> 0")
        linked = links.where(begins("object_id", heads(named, "object_id"))).join(named, "object_id").select(F.col("subject_id").alias("id"), "hits")
        linked = linked.unionByName(links.select(F.col("subject_id").alias("id"), _hit_bits(F.lower("predicate"), terms).alias("hits")))
    plain = now.where("object_id is null").select(F.col("subject_id").alias("id"), _hit_bits(F.lower(F.concat_ws(" ", "predicate", value(F.lit(None).cast("string")))), terms).alias("hits"))
    both = head.unionByName(linked).unionByName(plain).where("hits <> 0")
    hits = both.groupBy("id").agg(F.bit_or("hits").alias("hits")).where("hits < 0")
    score = hits.select("id", F.bit_count(F.col("hits").bitwiseAND(F.lit((1 << 63) - 1))).cast("bigint").alias("score")).where("score > 0")
    if limit:
        score = _best(score, "score", limit)
    out = score.join(e.select("id", "label"), "id").orderBy(F.desc("score"), "label", "id")
    return out.limit(limit) if limit else out


def _best(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The rows that may be among the first n by a number, all ties with the last one among them, as a table."""
    rows = cut(rows)
    least = rows.select(by).orderBy(F.desc(by)).limit(n).agg(F.min(by)).scalar()
    return cut(rows.where(F.col(by) >= least))


def keyword_passages(passages: DataFrame, terms: list[str]) -> DataFrame:
    """entity_id, seq, text, score: the terms that a passage contains."""
    return passages.withColumn("score", F.size(term_hits(F.lower("text"), terms)).cast("double")).where("score > 0")


def top_vectors(vectors: DataFrame | VectorIndex, query: list[float], model: str, k: int, floor: float | None = None) -> DataFrame:
    """The k nearest vectors of the query's model, then those of at least ``floor`` (in this order).

    An index (of vectors without kinds) gives id and sim, by its probes instead of a scan.
    """
    if isinstance(vectors, VectorIndex):
        asked = vectors.spark.createDataFrame([("q", None, model, list(map(float, query)))], "id string, kind string, model string, embedding array<double>")
        return vectors.search(asked, k, floor).select("id", "sim")
    q = F.array(*map(F.lit, map(float, query)))
    out = vectors.where(F.col("model") == model).withColumn("sim", cosine("embedding", q)).orderBy(F.desc("sim"), "id").limit(k)
    return out.where(F.col("sim") >= floor) if floor is not None else out


def merge_passages(keyword: DataFrame, semantic: DataFrame, limit: int = 6, per_doc: int = 2) -> DataFrame:
    """Both legs' scores added up; at most per_doc passages of a document and limit in all, snippets cut."""
    both = keyword.unionByName(semantic).groupBy("entity_id", "seq").agg(F.sum("score").alias("score"), F.max("text").alias("text"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("score"), "seq")
    out = both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_doc).orderBy(F.desc("score"), "entity_id", "seq").limit(limit)
    return out.select("entity_id", "seq", "score", snip("text").alias("text"))


def link_score(label: Column, keys: Column, terms: list[str]) -> Column:
    """How much of a label a query names (prefixes from three letters on), and one more for a natural key in it."""
    tokens = F.filter(F.split(F.lower(label), "[^a-z0-9à-öø-ÿ]+", -1), lambda t: t != "")
    named = lambda t: F.exists(F.array(*map(F.lit, terms)), lambda q: (t == q) | ((F.length(q) >= 3) & F.startswith(t, q)) | ((F.length(t) >= 3) & F.startswith(q, t)))
    matched = F.size(F.filter(tokens, named))
    key_hit = F.exists(F.map_values(keys), lambda v: F.exists(F.array(*map(F.lit, terms)), lambda q: (F.lower(v) == q) | (F.contains(F.lower(v), q) & (F.length(q) >= 4))))
    coverage = F.when(F.size(tokens) > 0, matched / F.size(tokens)).otherwise(0.0)
    return F.when((matched == 0) & ~key_hit, 0.0).otherwise(coverage + key_hit.cast("int"))


def link_entities(entities: DataFrame, terms: list[str], limit: int = 5, facts: DataFrame | None = None) -> DataFrame:
    """The entities that a query names: id, label, score of a half or more.

    entities has edges; or, given the facts, only those are counted that the limit may hang on.
    """
    out = entities.withColumn("score", link_score(F.col("label"), F.col("natural_keys"), terms)).where("score >= 0.5")
    if facts is not None:
        out = _best(out.select("id", "label", "score"), "score", limit)
        out = out.join(edges_of(out.select("id"), current(facts)), "id")
    return out.orderBy(F.desc("score"), F.desc("edges"), "label", "id").limit(limit).select("id", "label", "score")


#: The score of an entity that a query names; its neighbours have less.
SEED_SCORE = 10


def expand(facts: DataFrame, entities: DataFrame, seeds: DataFrame, neighbours: int = 8, most_facts: int = 12) -> DataFrame:
    """Evidence rows id, label, score, predicate, value, matched, rank: the seeds' facts and those of the entities most tied to them.

    Facts that touch a seed come first, then the confident ones.
    """
    seeds = cut(seeds.select("id").distinct())
    now = current(facts)
    tied = now.where("object_id is not null and subject_id <> object_id")
    # from the seeds outwards: no other fact is dealt out
    beside = [tied.join(seeds.withColumnRenamed("id", a), a, "left_semi").select(F.col(b).alias("id")) for a, b in (("subject_id", "object_id"), ("object_id", "subject_id"))]
    ties = cut(beside[0].unionByName(beside[1]).join(seeds, "id", "left_anti").groupBy("id").agg(F.count("*").alias("tie")))
    ties = _best(ties.join(entities.select("id"), "id"), "tie", neighbours)
    near = ties.join(edges_of(ties.select("id"), now), "id").orderBy(F.desc("tie"), F.desc("edges"), "id").limit(neighbours).select("id", F.lit(4).alias("score"))
    chosen = cut(seeds.withColumn("score", F.lit(SEED_SCORE)).unionByName(near)).withColumnRenamed("id", "subject_id")
    f = now.join(chosen, "subject_id", "left_semi").join(seeds.select(F.col("id").alias("object_id"), F.lit(True).alias("matched")), "object_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    w = Window.partitionBy("subject_id").orderBy(F.desc("matched"), F.desc("confidence"), "id")
    f = cut(f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_facts))
    # a few facts: only their ends' labels are looked up
    ends = cut(f.select(F.explode(F.array("subject_id", "object_id")).alias("id")).where("id is not null").distinct())
    labels = cut(entities.join(ends, "id", "left_semi").select("id", "label", "merged_into"))
    objects = labels.select(F.col("id").alias("object_id"), F.col("label").alias("object_label"))
    f = f.join(live(labels).select(F.col("id").alias("subject_id"), F.col("label").alias("subject_label")), "subject_id").join(chosen, "subject_id").join(objects, "object_id", "left")
    return f.select(F.col("subject_id").alias("id"), F.col("subject_label").alias("label"), "score", "predicate", value().alias("value"), "matched", "rank")


def merge_hits(keyword: DataFrame, graph: DataFrame, limit: int = 8) -> DataFrame:
    """(id, label, score, leg): an entity's higher score; the graph's only where it is greater."""
    both = keyword.select("id", "label", F.col("score").cast("int").alias("score"), F.lit("keyword").alias("leg")).unionByName(graph.select("id", "label", F.col("score").cast("int").alias("score"), F.lit("graph").alias("leg")).distinct())
    best = both.groupBy("id").agg(F.max_by(F.struct("label", "score", "leg"), F.struct("score", "leg")).alias("h"))
    return best.select("id", "h.*").orderBy(F.desc("score"), "label", "id").limit(limit)


def primed(lexical: DataFrame, ann: DataFrame, cap: int = 15, floor: float = 0.3) -> DataFrame:
    """Known entities for a prompt: those named first (by support), then those near by meaning (kind, label, support, sim)."""
    ok = ann.where((F.col("sim") >= floor) & ((F.col("kind") == "concept") | (F.col("support") >= 2)))
    both = lexical.select("kind", "label", "support", F.lit(None).cast("double").alias("sim"), F.lit(0).alias("leg")).unionByName(ok.select("kind", "label", "support", "sim", F.lit(1).alias("leg")))
    order = (F.col("leg"), F.when(F.col("leg") == 0, -F.col("support")).otherwise(-F.col("sim")), F.col("label"))
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("kind", F.lower("label")).orderBy(*order))).where("n = 1")
    return first.orderBy(*order).limit(cap).select("kind", "label", "support", "sim", "leg")


def named_in(texts: DataFrame, labels: DataFrame, least: int = 3, grams: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """(text_id, id): the labels of ``least`` letters or more that a text contains.

    Candidates meet on a label's first characters, as many as the greatest of
    ``grams`` that the label has; then the containment is checked. No pair is
    made but by such a key.
    """
    low = F.lower("label")
    n = F.lit(min(least, *grams))
    for g in sorted(grams):
        n = F.when(F.length("label") >= g, g).otherwise(n)
    keyed = labels.where(F.length("label") >= least).select("id", low.alias("label"), F.substring(low, F.lit(1), n).alias("gram"))
    text = F.lower("text")

    def pieces_of(g: int) -> Column:
        # a look-ahead matches at every character, so this is linear in the text
        return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{g}}}))"), F.lit(1)))

    pieces = [pieces_of(g) for g in sorted({min(least, *grams), *grams})]
    starts = keyed.select("gram").distinct()
    near = texts.select("text_id", F.explode(F.concat(*pieces)).alias("gram")).join(starts, "gram", "left_semi").distinct().join(keyed, "gram")
    return near.join(texts.select("text_id", text.alias("body")), "text_id").where(F.contains("body", "label")).select("text_id", "id").distinct()


def agent_profiles(agents: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """(agent_id, name, term, weight): rare terms weigh more, those of the name twice; learned corrections are added."""
    name, both = F.array_distinct(normalize_terms("name")), F.array_distinct(normalize_terms(F.concat_ws(" ", "name", "purpose")))
    terms = agents.select("agent_id", "name", F.explode(both).alias("term"), name.alias("own")).withColumn("own", F.array_contains("own", F.col("term")))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    out = terms.join(df, "term").select("agent_id", "name", "term", (F.when(F.col("own"), 2.0).otherwise(1.0) / F.col("df")).alias("weight"))
    if learned is not None:
        more = learned.join(agents.select("agent_id", "name"), "agent_id").select("agent_id", "name", "term", "weight")
        out = out.unionByName(more).groupBy("agent_id", "name", "term").agg(F.sum("weight").alias("weight"))
    return out


def route(messages: DataFrame, profiles: DataFrame, least: float = 1.0, lead: float = 0.5, ratio: float = 1.5, boosts: DataFrame | None = None) -> DataFrame:
    """(message_id, agent_id, score, runner_up) of the messages that one agent clearly wins; profiles are few and small.

    Scores are compared at six places, so that the order of addition decides nothing.
    """
    terms = messages.select("message_id", F.explode(F.array_distinct(normalize_terms("text"))).alias("term"))
    scored = terms.join(profiles, "term").groupBy("message_id", "agent_id", "name").agg(F.sum("weight").alias("score"))
    if boosts is not None:
        names = profiles.select("agent_id", "name").distinct()
        scored = scored.unionByName(boosts.join(names, "agent_id").select("message_id", "agent_id", "name", F.col("boost").alias("score"))).groupBy("message_id", "agent_id", "name").agg(F.sum("score").alias("score"))
    scored = scored.withColumn("score", rounded("score", 6))
    w = Window.partitionBy("message_id").orderBy(F.desc("score"), "name", "agent_id")
    top = scored.withColumn("n", F.row_number().over(w)).withColumn("runner_up", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("n = 1")
    clear = (F.col("runner_up") <= 0) | ((F.col("score") - F.col("runner_up") >= lead) & (F.col("score") >= F.col("runner_up") * ratio))
    return top.where((F.col("score") >= least) & clear).select("message_id", "agent_id", "score", "runner_up")


#: Headings that raise and lower a chunk's worth (fixed values).
BOOSTED = r"(?i)\b(abstract|summary|overview|conclusion|conclusions|results|findings|performance|key\s+takeaways?|executive\s+summary|returns?|method(ology)?)\b"
DEMOTED = r"(?i)\b(references|bibliography|acknowledg\w*|disclaimer|disclosures?|appendix|table\s+of\s+contents|copyright|about\s+the\s+authors?)\b"


def chunk_score(text: Column, seq: Column, chunks: Column, terms: list[str], sim: Column | None = None) -> Column:
    """How much a chunk is worth for a prompt: headings, density of figures, key terms, place, nearness."""
    head = F.substring(text, 1, 120)
    signals = F.size(F.regexp_extract_all(text, F.lit("[0-9%€$£]"), F.lit(0)))
    place = F.when(chunks > 1, seq / (chunks - 1)).otherwise(0.0)
    out = F.when(head.rlike(DEMOTED), -3.0).otherwise(0.0) + F.when(head.rlike(BOOSTED), 2.0).otherwise(0.0)
    out = out + F.least(F.lit(2.0), signals / F.greatest(F.lit(1), F.length(text)) * 100 * 0.25)
    if terms:
        out = out + F.least(F.lit(3.0), F.size(term_hits(F.lower(text), terms)) * 0.5)
    out = out + F.when(place <= 0.1, 1.5).when(place >= 0.9, -0.5).otherwise(0.0)
    return out + (semantic_boost(sim) if sim is not None else F.lit(0.0))


def select_chunks(scored: DataFrame, budget: int = 24_000, always: int = 2) -> DataFrame:
    """(doc_id, seqs): each document's chunks that fit the budget: the first ``always`` before the best, skipping those that don't fit.

    The choice is greedy, so it is a fold over a document's ordered chunks.
    """
    first = F.col("seq") < always
    item = F.struct((~first).alias("late"), F.when(first, 0.0).otherwise(-F.col("score")).alias("less"), "seq", F.length("text").alias("n"))
    ordered = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("seqs"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["n"]).cast("bigint").alias("used"), F.concat(acc["seqs"], F.array(x["seq"].cast("bigint"))).alias("seqs"))).otherwise(acc)

    return ordered.select("doc_id", F.array_sort(F.aggregate("chunks", zero, step)["seqs"]).alias("seqs"))


def prompt_text(chunks: DataFrame, selected: DataFrame) -> DataFrame:
    """doc_id, text, dropped: the selected chunks in order, with a mark where some are left out between them (chunks: doc_id, seq, text, page or null)."""
    picked = selected.select("doc_id", F.explode("seqs").alias("seq"))
    said = F.when(F.col("page").isNotNull(), F.concat(F.lit("[p."), F.col("page").cast("string"), F.lit("] "), "text")).otherwise(F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("seq")
    own = chunks.join(picked, ["doc_id", "seq"]).withColumn("gap", F.col("seq") > F.lag("seq").over(w) + 1)
    part = F.concat(F.when(F.col("gap"), "[… less relevant passages omitted …]\n\n").otherwise(""), said)
    texts = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"), F.count("*").alias("kept"))
    every = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return every.join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def anchors(business: str | None, agents: DataFrame, kinds: DataFrame) -> DataFrame:
    """leg, place, text: what relevance is measured against: the business (600 characters), six agents (300), eight kinds (400).

    agents: place, name, purpose; kinds: place, kind, description, words (array).
    """
    own = agents.sparkSession.createDataFrame([(business or "",)], "text string").select(F.lit(0).alias("leg"), F.lit(0).alias("place"), F.substring(F.trim("text"), 1, 600).alias("text")).where("text <> ''")
    agent = F.trim(F.concat("name", F.lit(" — "), "purpose"))
    of_agents = agents.orderBy("place").limit(6).where(F.length(agent) > 3).select(F.lit(1).alias("leg"), "place", F.substring(agent, 1, 300).alias("text"))
    kind = F.trim(F.concat("kind", F.lit(": "), F.coalesce("description", F.lit("")), F.lit(" "), F.array_join("words", ", ")))
    of_kinds = kinds.orderBy("place").limit(8).where(F.length(kind) > F.length("kind") + 2).select(F.lit(2).alias("leg"), "place", F.substring(kind, 1, 400).alias("text"))
    return own.unionByName(of_agents).unionByName(of_kinds)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = 1200, most: int | None = None, pages_col: str | None = None) -> DataFrame:
    """(id, seq, page, heading, text): each text's chunks by page, by section or by paragraph, as a lateral join; null texts have none.

    pages_col: an array of (page, text) where the text came in pages.
    """
    pages = F.col(pages_col) if pages_col else F.lit(None)
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), pages.cast("array<struct<page:int,text:string>>").alias("__pages"))
    parts = chunk_text(F.col("__text").outer(), F.lit(target), F.col("__pages").outer(), F.lit(most or 0))
    return given.lateralJoin(parts).select(F.col("__id").alias(id_col), "seq", "page", "heading", "text")
