"""Entity resolution and consolidation: blocking, the ladder, merging, and folding claims into facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maps import keys_conflict, merged
from ..functions.numbers import age_days
from ..functions.text import normalized_key, trigrams
from .facts import current, has_value, live, slot
from .storage import cut
from .vector_index import VectorIndex, build


def trigram_pairs(a: DataFrame, b: DataFrame, floor: float) -> DataFrame:
    """(a_id, b_id, sim): labels of one kind (id, kind, label) with a trigram similarity of ``floor`` or more.

    Labels meet on the trigrams of a prefix: sorted by how rare they are, a
    label that is as similar as asked shares one of its rarest n - ceil(floor *
    n) + 1. So common trigrams make no pairs, and no pair is lost.
    """
    both = a.select("kind", "label").unionByName(b.select("kind", "label")).distinct().withColumn("grams", trigrams("label"))
    each = both.select("kind", "label", F.explode("grams").alias("gram"))
    df = each.groupBy("kind", "gram").agg(F.count("*").alias("df"))
    ordered = each.join(df, ["kind", "gram"]).groupBy("kind", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("grams"))
    ordered = cut(ordered)
    keep = F.size("grams") - F.ceil(F.lit(floor) * F.size("grams") - 1e-9).cast("int") + 1
    prefix = ordered.select("kind", "label", "grams", F.explode(F.slice("grams", 1, F.greatest(keep, F.lit(1)))).alias("gram"))
    x = prefix.select("kind", "gram", F.col("label").alias("x"), F.col("grams").alias("xg"))
    y = prefix.select("kind", "gram", F.col("label").alias("y"), F.col("grams").alias("yg"))
    shared = F.size(F.array_intersect("xg", "yg"))
    sim = shared / (F.size("xg") + F.size("yg") - shared)
    short = F.least(F.size("xg"), F.size("yg")) >= F.lit(floor) * F.greatest(F.size("xg"), F.size("yg")) - 1e-9
    # labels, not entities: equal labels make one pair however many entities have them
    near = x.join(y, ["kind", "gram"]).where(short).select("kind", "x", "y", sim.alias("sim")).where(F.col("sim") >= floor).distinct()
    left = a.select("kind", F.col("label").alias("x"), F.col("id").alias("a_id"))
    right = b.select("kind", F.col("label").alias("y"), F.col("id").alias("b_id"))
    return near.join(left, ["kind", "x"]).join(right, ["kind", "y"]).where("a_id <> b_id").select("kind", "a_id", "b_id", "sim")


def label_pairs(entities: DataFrame, floor: float = 0.55) -> DataFrame:
    """(kind, x, y, sim): pairs of different labels of live entities, x < y."""
    e = live(entities).select("kind", "label").distinct().withColumn("id", F.col("label"))
    return trigram_pairs(e, e, floor).where("a_id < b_id").select("kind", F.col("a_id").alias("x"), F.col("b_id").alias("y"), "sim")


def match_entities(wanted: DataFrame, entities: DataFrame, limit: int = 10, floor: float = 0.3) -> DataFrame:
    """(wanted_id, id, sim, rank): candidates of the same kind for labels to resolve."""
    pairs = trigram_pairs(wanted.select(F.col("wanted_id").alias("id"), "kind", "label"), live(entities).select("id", "kind", "label"), floor)
    w = Window.partitionBy("a_id").orderBy(F.desc("sim"), "b_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(F.col("a_id").alias("wanted_id"), F.col("b_id").alias("id"), "sim", "rank")


def nearest_pairs(queries: DataFrame, vectors: DataFrame | VectorIndex, floor: float = 0.85, exact: bool = True) -> DataFrame:
    """(a_id, b_id, sim): each query's nearest other vector of its kind and model (id, kind, model, embedding), if it is as near as floor.

    vectors: an index, or the vectors that one is built of. exact: of all cells
    that can hold such a vector; otherwise of the index's probes, by its recall.
    """
    index = vectors if isinstance(vectors, VectorIndex) else build(vectors)
    found = index.search(queries, 1, floor, exact=exact, others=True)
    return found.select(F.col("query_id").alias("a_id"), F.col("id").alias("b_id"), "sim")


Adjudicator = Callable[[Column], Column]
#: Labels as alike as this are the same without asking.
SURE = 0.92


def without_model(sim: Column) -> Column:
    """The decision where no model is asked: alike labels are proposed, others rejected; nothing merges by itself."""
    return F.when(sim >= 0.75, "propose").otherwise("reject")


def candidates(wanted: DataFrame, entities: DataFrame, index: VectorIndex | None = None, few: int = 5, recalled: int = 5, near: float = 0.5, judged: int = 3, exact: bool = False) -> DataFrame:
    """(wanted_id, id, sim, via, place): whom labels may be, best first: the most alike labels, and where fewer than ``few`` are, the nearest vectors.

    Nearness recalls and settles nothing: what it finds is judged like the rest.
    wanted has model and embedding where an index is given.
    """
    by_label = match_entities(wanted, entities, 10, 0.25).select("wanted_id", "id", "sim", F.lit("label").alias("via"))
    if index is not None:
        by_label = cut(by_label)
        alike = by_label.groupBy("wanted_id").agg(F.count_if(F.col("sim") >= 0.3).alias("n"), F.max("sim").alias("most"))
        asked = wanted.join(alike, "wanted_id", "left").where((F.coalesce("n", F.lit(0)) < few) & (F.coalesce("most", F.lit(0.0)) < SURE))
        found = index.search(asked.select(F.col("wanted_id").alias("id"), "kind", "model", "embedding"), recalled, near, exact=exact)
        found = found.select(F.col("query_id").alias("wanted_id"), "id", "sim", F.lit("vector").alias("via")).join(live(entities).select("id"), "id", "left_semi")
        by_label = by_label.unionByName(found.join(by_label, ["wanted_id", "id"], "left_anti").select(by_label.columns))
    w = Window.partitionBy("wanted_id").orderBy(F.desc("sim"), "id")
    return by_label.withColumn("place", F.row_number().over(w)).where(F.col("place") <= judged)


def resolve(wanted: DataFrame, entities: DataFrame, adjudicate: Adjudicator = without_model, index: VectorIndex | None = None, exact: bool = False) -> DataFrame:
    """(wanted_id, tier, id, decision): exact key, then near-equal labels, then what the adjudicator says of the best candidate.

    wanted: wanted_id, kind, label, natural_keys, and model and embedding where
    an index of the entities' vectors is given: it recalls candidates where
    labels find few. Each tier sees what the ones before left.
    """
    e = live(entities).select("kind", normalized_key("label", F.col("natural_keys")).alias("key"), "id").groupBy("kind", "key").agg(F.min("id").alias("id"))
    w = wanted.withColumn("key", normalized_key("label", F.col("natural_keys")))
    exact_match = w.join(e, ["kind", "key"]).select("wanted_id", F.lit("exact").alias("tier"), "id", F.lit("merge").alias("decision"))
    left = wanted.join(exact_match.select("wanted_id"), "wanted_id", "left_anti")
    top = candidates(left, entities, index, exact=exact).where("place = 1")
    sure = (F.col("via") == "label") & (F.col("sim") >= SURE)
    tier = F.when(sure, "label").when(F.col("via") == "label", "adjudicated").otherwise("recalled")
    near = top.select("wanted_id", tier.alias("tier"), "id", F.when(sure, "merge").otherwise(adjudicate(F.col("sim"))).alias("decision"))
    near = near.withColumn("id", F.when(F.col("decision") != "reject", F.col("id"))).withColumn("decision", F.when(F.col("decision") == "reject", "new").otherwise(F.col("decision")))
    rest = left.join(near.select("wanted_id"), "wanted_id", "left_anti").select("wanted_id", F.lit("none").alias("tier"), F.lit(None).cast("string").alias("id"), F.lit("new").alias("decision"))
    return exact_match.unionByName(near).unionByName(rest)


def filter_pairs(pairs: DataFrame, reviewed: DataFrame, keys: DataFrame) -> DataFrame:
    """Candidate pairs in one direction with their best similarity; those reviewed before, and those whose strong keys disagree, are out."""
    low, high = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    best = pairs.where("a_id <> b_id").groupBy(low.alias("a_id"), high.alias("b_id")).agg(F.max("sim").alias("sim"))
    done = reviewed.select(low.alias("a_id"), high.alias("b_id")).distinct()
    k = keys.select("id", "natural_keys")
    best = best.join(done, ["a_id", "b_id"], "left_anti")
    best = best.join(k.select(F.col("id").alias("a_id"), F.col("natural_keys").alias("ka")), "a_id").join(k.select(F.col("id").alias("b_id"), F.col("natural_keys").alias("kb")), "b_id")
    return best.where(~keys_conflict("ka", "kb")).select("a_id", "b_id", "sim")


def winners(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(winner, loser): more edges, then more support, then the older."""
    rank = F.struct("edges", "support", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"))
    e = entities.select("id", rank.alias("rank"))
    both = pairs.join(e.select(F.col("id").alias("a_id"), F.col("rank").alias("ra")), "a_id").join(e.select(F.col("id").alias("b_id"), F.col("rank").alias("rb")), "b_id")
    first = F.col("ra") >= F.col("rb")
    return both.select(F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("winner"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("loser"))


def remap(merges: DataFrame) -> DataFrame:
    """(loser, winner) with chains followed to their end; each round halves what is left of a chain."""
    m = cut(merges.select("loser", "winner").where("loser <> winner").groupBy("loser").agg(F.min("winner").alias("winner")))
    while True:
        up = m.select(F.col("loser").alias("winner"), F.col("winner").alias("above"))
        step = cut(m.join(up, "winner", "left").select("loser", F.coalesce("above", "winner").alias("winner"), F.col("above").isNotNull().alias("moved")))
        if step.where("moved and winner <> loser").isEmpty():
            return step.select("loser", "winner").where("loser <> winner")
        m = step.select("loser", "winner")


def merge_entities(facts: DataFrame, entities: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, entities) after merges: both ends of facts point to the winners, losers are tombstones, keys are united."""
    m = remap(merges)
    out = facts
    for end in ("subject_id", "object_id"):
        out = out.join(m.select(F.col("loser").alias(end), F.col("winner").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    lost = entities.join(m.select(F.col("loser").alias("id"), "winner"), "id").groupBy("winner").agg(F.array_sort(F.collect_list(F.struct("id", F.map_entries("natural_keys").alias("pairs")))).alias("lost"))
    united = F.aggregate("lost", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda acc, x: merged(F.map_from_entries(x["pairs"]), acc))
    keys = lost.select(F.col("winner").alias("id"), united.alias("more"))
    ents = entities.join(m.select(F.col("loser").alias("id"), "winner"), "id", "left").join(keys, "id", "left")
    ents = ents.withColumn("natural_keys", F.when(F.col("more").isNotNull(), merged("more", "natural_keys")).otherwise(F.col("natural_keys"))).withColumn("merged_into", F.coalesce("winner", "merged_into")).drop("winner", "more")
    return out.select(facts.columns), ents.select(entities.columns)


def orphans(entities: DataFrame, now: Column) -> DataFrame:
    """Entities that nothing refers to, that corroborated nothing, had time to, and were not used of late.

    entities has edges, has_body and last_used_at.
    """
    window = F.when(F.col("kind") == "concept", 7.0).otherwise(30.0)
    used = F.coalesce(age_days("last_used_at", now) <= window, F.lit(False))
    return live(entities).where(~F.col("kind").isin("document", "note") & (F.col("edges") == 0) & (F.col("support") <= 1) & ~F.col("has_body") & ~used & (age_days("created_at", now) > window))


CLAIM = "claim_key string, fact_id string, observed_at timestamp_ntz, source_item_id string, value string, confidence double"
FOLDED = "claim_key string, fact_id string, outcome string, kept_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, superseded_by string, sources int"


def fold_claim(rows: Iterator[tuple], state: tuple | None = None) -> tuple[list[list], tuple | None]:
    """One claim's observations in order, as outcomes: new, deduped, filled, held or superseded.

    rows: (fact_id, observed_at, source, value or None, confidence). state: (fact
    id, value, confidence, sources) of the current fact. A weaker value (by more
    than 0.2, or at all against two sources or more) is held.
    """
    out: list[list] = []
    at = {}
    if state is not None:
        state = (*state[:3], set(state[3]) if not isinstance(state[3], set) else state[3])
    for fact_id, when, source, value, confidence in rows:
        said = None if value is None else value.strip().lower()
        row = [fact_id, "new", fact_id, when, None, None, 1]
        if state is None:
            pass
        elif state[1] is None and said is not None:
            row[1] = "filled"
            if state[0] in at:
                at[state[0]][4:6] = [when, fact_id]
        elif said == state[1]:
            if source is not None:
                state[3].add(source)
            out.append([fact_id, "deduped", state[0], when, None, None, len(state[3])])
            state = (state[0], state[1], max(state[2], confidence), state[3])
            continue
        elif confidence < state[2] - 0.2 or (len(state[3]) >= 2 and confidence < state[2]):
            out.append([fact_id, "held", state[0], when, None, None, len(state[3])])
            continue
        else:
            row[1] = "superseded"
            if state[0] in at:
                at[state[0]][4:6] = [when, fact_id]
        out.append(row)
        at[fact_id] = row
        state = (fact_id, said, confidence, {source} if source is not None else set())
    return out, state


def fold_facts(claims: DataFrame) -> DataFrame:
    """Every observation's outcome, claim by claim in order of (observed_at, source, fact_id).

    A claim's rows arrive sorted and in batches, and only its current fact is
    kept between them, so a hot claim needs no more memory than another.
    """
    schema = T._parse_datatype_string("claim_key string, fact_id string, outcome string, kept_id string, observed_at timestamp_ntz, sources int")
    arrow = pa.schema([("claim_key", pa.string()), ("fact_id", pa.string()), ("outcome", pa.string()), ("kept_id", pa.string()), ("observed_at", pa.timestamp("us")), ("sources", pa.int32())])

    def run(batches):
        key, state = None, None
        for batch in batches:
            rows = []
            for claim, fact_id, when, source, value, confidence in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if claim != key:
                    key, state = claim, None
                done, state = fold_claim(iter([(fact_id, when, source, value, confidence)]), state)
                rows += [(claim, d[0], d[1], d[2], d[3], d[6]) for d in done]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types, strict=True)], schema=arrow) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in arrow.types], schema=arrow)

    ordered = claims.select("claim_key", "fact_id", "observed_at", "source_item_id", "value", "confidence").repartition("claim_key").sortWithinPartitions("claim_key", "observed_at", "source_item_id", "fact_id")
    return ordered.mapInArrow(run, schema)


def ended(outcomes: DataFrame) -> DataFrame:
    """The facts of fold_facts with valid_from, valid_to, superseded_by and sources."""
    made = outcomes.where(F.col("outcome").isin("new", "filled", "superseded"))
    w = Window.partitionBy("claim_key").orderBy("observed_at", "fact_id")
    chain = made.select("claim_key", "fact_id", F.col("observed_at").alias("valid_from"), F.lead("observed_at").over(w).alias("valid_to"), F.lead("fact_id").over(w).alias("superseded_by"))
    sources = outcomes.groupBy(F.col("kept_id").alias("fact_id")).agg(F.max("sources").alias("sources"))
    return chain.join(sources, "fact_id")


def reconcile_extraction(x_entities: DataFrame, x_facts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The facts of extractions that stand: known subjects and objects, no blanks or self references, repeats once, one value where one is declared.

    Repeats keep the greatest confidence and the first snippet. A predicate
    with several values that no template declares becomes many; where a
    template declares one, the most confident value (then the first) stays.
    """
    ents = x_entities.where(F.trim("label") != "").select("extraction_id", F.col("local_id").alias("subject_local_id"), F.col("kind").alias("subject_kind")).distinct()
    targets = ents.select("extraction_id", F.col("subject_local_id").alias("entity_local_id"), F.lit(True).alias("target"))
    f = x_facts.join(ents, ["extraction_id", "subject_local_id"]).join(targets, ["extraction_id", "entity_local_id"], "left")
    said = F.when(F.col("value_kind") == "entity", F.col("entity_local_id")).when(F.col("value_kind") == "number", F.col("num").cast("string")).when(F.col("value_kind") == "date", F.col("date")).otherwise(F.nullif(F.lower(F.trim("text")), F.lit("")))
    f = f.withColumn("said", said).where("said is not null and (value_kind <> 'entity' or (target and entity_local_id <> subject_local_id)) and not coalesce(isnan(num), false)")
    key = ["extraction_id", "subject_local_id", "predicate"]
    once = f.groupBy(*key, "subject_kind", "value_kind", "said").agg(F.max("confidence").alias("confidence"), F.min("ord").alias("ord"), F.min_by("snippet", "ord").alias("snippet"))
    v = vocabulary.select(F.col("kind").alias("subject_kind"), F.col("word").alias("predicate"), "many").distinct()
    w = Window.partitionBy(*key)
    once = once.join(v, ["subject_kind", "predicate"], "left").withColumn("n", F.count("*").over(w)).withColumn("best", F.row_number().over(w.orderBy(F.desc("confidence"), "ord")))
    out = once.where(F.coalesce("many", F.lit(True)) | (F.col("best") == 1))
    return out.select(*key, "value_kind", F.col("said").alias("value"), F.when(F.coalesce("many", F.col("n") > 1), "many").otherwise("one").alias("cardinality"), "confidence", "ord", "snippet")


def ground(x_facts: DataFrame, sources: DataFrame, cap: float = 0.35) -> DataFrame:
    """Facts with their confidence capped where the snippet, or a number of three digits or more in it, is not in the source text."""
    flat = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")
    f = x_facts.join(sources.select("extraction_id", F.col("text").alias("source_text")), "extraction_id", "left")
    quoted = F.contains(flat("source_text"), flat("snippet"))
    number = F.when(F.col("num").isNotNull(), digits(F.regexp_replace(F.col("num").cast("decimal(38,6)").cast("string"), r"\.?0+$", "")))
    counted = F.length(number) < 3
    counted = counted | F.contains(digits(F.col("source_text")), number)
    bad = (F.col("snippet").isNotNull() & ~F.coalesce(quoted, F.lit(True))) | ~F.coalesce(counted, F.lit(True))
    return f.withColumn("grounded", ~bad).withColumn("confidence", F.when(bad, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence"))).drop("source_text")


MAPS = "agent string, pos long, n long, scale double, shift array<double>, total array<double>"


def _maps(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    names = [f.split(" ")[0] for f in MAPS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _step_maps(memory: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of an agent's consecutive vectors (agent, pos, embedding), each as one affine map of the mean before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            agent, pos = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ends = [i + 1 for i in range(len(pos) - 1) if agent[i] != agent[i + 1] or pos[i] + 1 != pos[i + 1]]
            out = []
            for low, high in zip([0, *ends], [*ends, len(pos)], strict=True) if len(pos) else ():
                v = np.array(batch.column(2).slice(low, high - low).to_pylist(), float)
                weight = np.minimum(pos[low:high], memory)
                keep = weight / (weight + 1)  # of the mean so far, at each step
                after = np.append(np.cumprod(keep[:0:-1])[::-1], 1.0)  # what later steps leave of each
                out.append((agent[low], int(pos[low]), high - low, float(after[0] * keep[0]), ((after / (weight + 1))[:, None] * v).sum(0), v.sum(0)))
            yield _maps(out)

    return run


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maps of each agent, which come in order, as one; only that one is held."""
    import numpy as np

    held = None
    for batch in batches:
        out = []
        for agent, pos, n, scale, shift, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[0] == agent:
                held = (agent, held[1], held[2] + n, scale * held[3], scale * held[4] + np.array(shift), held[5] + np.array(total))
                continue
            if held is not None:
                out.append(held)
            held = (agent, pos, n, scale, np.array(shift), np.array(total))
        yield _maps(out)
    if held is not None:
        yield _maps([held])


def fold_centroids(samples: DataFrame, memory: int = 200, together: float = 64) -> DataFrame:
    """(agent_id, n, centroid, mean): the running mean of each agent's vectors in order, its memory capped, and their plain mean; vectors of another length than the first are left out.

    Every step is an affine map of the mean, and maps compose. A vector's place
    in its agent's order is known from the counts of the ranges before it, so runs
    become maps wherever they lie, and maps are composed by blocks of the order
    (``together`` thousand places) and then whole: a hot agent is many tasks.
    """
    order = lambda c: (F.col(c).isNull().alias(f"no_{c}"), F.col(c))
    rows = samples.select(F.col("agent_id").cast("string").alias("agent_id"), F.col("embedding").cast("array<double>").alias("embedding"), "created_at", "id")
    # the name of a null agent begins unlike all others
    rows = rows.withColumn("agent", F.coalesce(F.concat(F.lit("a"), "agent_id"), F.lit("")))
    some = rows.where(F.size("embedding") > 0)
    length = some.groupBy("agent").agg(F.min_by(F.size("embedding"), F.struct(*order("created_at"), *order("id"))).alias("length"))
    keys = ["agent", F.asc_nulls_last("created_at"), F.asc_nulls_last("id")]
    placed = some.join(length, "agent").where(F.size("embedding") == F.col("length")).select("agent", "embedding", "created_at", "id").repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(placed.select("agent", "embedding", F.monotonically_increasing_id().alias("at"))).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("agent", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("agent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = placed.join(counts.select("agent", "part", (before - F.col("first")).alias("shift")), ["agent", "part"]).select("agent", (F.col("at") + F.col("shift")).alias("pos"), "embedding")
    maps = known.sortWithinPartitions("agent", "pos").mapInArrow(_step_maps(memory), MAPS)
    # each block is an agent of its own at first, since a partition may hold blocks that do not follow each other
    named = maps.withColumn("agent", F.concat(F.floor(F.col("pos") / (together * 1000)).cast("string"), F.lit("|"), "agent"))
    blocks = named.repartition("agent").sortWithinPartitions("agent", "pos").mapInArrow(_composed, MAPS)
    whole = blocks.withColumn("agent", F.expr("substr(agent, instr(agent, '|') + 1)")).repartition("agent").sortWithinPartitions("agent", "pos").mapInArrow(_composed, MAPS)
    return rows.select("agent", "agent_id").distinct().join(whole, "agent", "left").select("agent_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("shift").alias("centroid"), F.transform("total", lambda x: x / F.col("n")).alias("mean"))


def learn_terms(events: DataFrame, step: float = 0.25, most: float = 1.0, keep: int = 24, least: float = 0.05) -> DataFrame:
    """(agent_id, term, weight) from feedback in order (agent_id, ord, verdict, terms): clamped at every step, the strongest kept."""
    each = events.select("agent_id", "ord", F.when(F.col("verdict") == "accept", step).otherwise(-step).alias("s"), F.explode(F.array_distinct("terms")).alias("term"))
    schema = T.StructType([each.schema["agent_id"], each.schema["term"], T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, key, weight = False, None, 0.0
        for batch in batches:
            done = []
            for agent, term, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if some and (agent, term) != key:
                    done.append((*key, weight))
                    weight = 0.0
                some, key = True, (agent, term)
                weight = min(most, max(-most, weight + s))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((*batch.schema.types[:2], pa.float64()))], schema.names)
            types = batch.schema.types
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, weight), (*types[:2], pa.float64()), strict=True)], schema.names)

    ordered = each.repartition("agent_id", "term").sortWithinPartitions("agent_id", "term", F.asc_nulls_last("ord"), "s")
    out = ordered.select("agent_id", "term", "s").mapInArrow(run, schema).where(F.abs("weight") >= least)
    w = Window.partitionBy("agent_id").orderBy(F.desc(F.abs("weight")), "term")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).drop("r")


def aligned_slots(facts: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(facts, incoming) with one cardinality for each slot (subject, predicate).

    A slot that has a list stays one, unless its template says one (incoming:
    subject_id, predicate, cardinality, declared). Where a list comes to a slot
    with a bare fact, that fact joins the list; it is closed if it is a
    placeholder, or if the list has its value already.
    """
    slot_keys = ["subject_id", "predicate"]
    held = current(facts)
    lists = held.where("cardinality = 'many'").select(*slot_keys, F.lit(True).alias("is_list")).distinct()
    sticky = F.col("is_list") & (F.coalesce("declared", F.lit("")) != "one")
    heard = incoming.join(lists, slot_keys, "left").withColumn("cardinality", F.when(F.coalesce(sticky, F.lit(False)), "many").otherwise(F.col("cardinality"))).drop("is_list")
    coming = heard.where("cardinality = 'many'").select(*slot_keys, F.lit(True).alias("coming")).distinct()
    values = held.where("cardinality = 'many'").select(*slot_keys, slot().alias("slot"), F.lit(True).alias("known")).distinct()
    out = facts.withColumn("slot", slot()).join(coming, slot_keys, "left").join(values, [*slot_keys, "slot"], "left")
    bare = F.col("valid_to").isNull() & (F.col("cardinality") == "one") & F.coalesce("coming", F.lit(False))
    gone = bare & (~has_value() | F.coalesce("known", F.lit(False)))
    out = out.withColumn("valid_to", F.when(gone, now).otherwise(F.col("valid_to"))).withColumn("cardinality", F.when(bare & ~gone, "many").otherwise(F.col("cardinality")))
    return out.select(facts.columns), heard.select(incoming.columns)
