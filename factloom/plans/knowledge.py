"""Queries: the knowledge view, reviews and their decisions, extractions, and search as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..functions.loose import parse_loose
from ..operators import answer as A
from ..operators import extraction as E
from ..operators import graph as G
from ..operators import knowledge as K
from ..operators import reviews as R
from ..operators import timeline as L
from ..operators.facts import current, live
from ..operators.resolve import aligned_slots
from ..operators.tables import ColumnDef, related
from ..registry import query
from ..sources.mail import sheet_text
from ..vault import adapter as V
from ..vault.oracle import ENTITIES, FACTS, ITEMS, PASSAGES, with_
from .analytics import VALUE
from .graph import EDGES
from .search import LINK, TERMS, _hits

NOW = "2024-03-01"


def _now():
    return F.lit(f"{NOW} 00:00:00").cast("timestamp_ntz")


NO_MAP = "map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"


def sources(s, d):
    """fact_id, source_item_id: each fact of a user came from its event's item, and was heard again from the one after it."""
    own = current_or_not(s, d)
    event = F.substring_index("source_item_id", ":", -1).try_cast("bigint")
    return own.select(F.col("id").alias("fact_id"), F.explode(F.array(F.col("source_item_id"), F.concat(F.lit("item:"), (event + 1).cast("string")))).alias("source_item_id"))


def current_or_not(s, d):
    return V.facts(s, d).where("source_item_id is not null")


def reviews(s, d):
    """A conflict for each superseded fact, a merge of each supplier into its nation's first, an extraction for each event, a batch of documents for each language, and a field for each predicate of a kind."""
    none, text = F.lit(None), lambda c: F.lit(c).cast("string")
    shape = lambda df, i, kind, status="pending", confidence=none, impact=F.lit(1), source=none, target=none, old=none, new=none, item=none, detail=F.expr(NO_MAP), ids=none: df.select(i.alias("id"), text(kind).alias("kind"), (F.lit(status) if isinstance(status, str) else status).alias("status"), confidence.cast("double").alias("confidence"), impact.cast("bigint").alias("impact"), source.cast("string").alias("source_id"), target.cast("string").alias("target_id"), old.cast("string").alias("old_fact_id"), new.cast("string").alias("new_fact_id"), item.cast("string").alias("item_id"), detail.alias("detail"), ids.cast("array<string>").alias("entity_ids"))  # noqa: E731, E501
    chain = V.event_chain(s, d).where("superseded_by is not null").withColumn("k", F.substring_index("id", "|", -1).try_cast("bigint"))
    held = F.create_map(F.lit("held"), F.when(F.col("k") % 3 == 0, "true").otherwise("false"))
    out = shape(chain, F.concat(F.lit("cf|"), "id"), "fact_conflict", F.when(F.col("k") % 4 == 3, "accepted").otherwise("pending"), F.when(F.col("k") % 2 == 0, (F.col("k") % 10) / 10), F.col("k") % 5 + 1, old=F.col("id"), new=F.col("superseded_by"), detail=held)
    sup = V.table(s, d, "supplier")
    first = sup.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    sup = sup.join(first, "s_nationkey").where("s_suppkey <> first")
    out = out.unionByName(shape(sup, F.concat(F.lit("mg|"), F.col("s_suppkey").cast("string")), "entity_merge", confidence=F.lit(0.8), impact=F.col("s_suppkey") % 4 + 1, source=V.key("supplier", "s_suppkey"), target=V.key("supplier", "first")))
    out = out.unionByName(shape(V.table(s, d, "events"), F.concat(F.lit("ex|"), F.col("event_id").cast("string")), "extraction", item=V.key("item", "event_id")))
    langs = V.table(s, d, "documents").groupBy("lang").agg(F.sort_array(F.collect_list(V.key("document", "doc_id"))).alias("ids"))
    out = out.unionByName(shape(langs, F.concat(F.lit("or|"), "lang"), "orphan_prune", impact=F.size("ids"), ids=F.col("ids")))
    used = V.facts(s, d).select(F.substring_index("subject_id", ":", 1).alias("k"), "predicate", F.col("object_id").isNotNull().alias("rel")).groupBy("k", "predicate").agg(F.count("*").alias("n"), F.max("rel").alias("rel"))
    detail = F.create_map(F.lit("kind"), F.col("k"), F.lit("predicate"), F.col("predicate"), F.lit("count"), F.col("n").cast("string"), F.lit("asRelation"), F.col("rel").cast("string"))
    return out.unionByName(shape(used, F.concat_ws("|", F.lit("fp"), "k", "predicate"), "field_proposal", impact=F.col("n"), detail=detail))


SOURCES = "sources AS (SELECT id AS fact_id, unnest([source_item_id, 'item:' || (CAST(split_part(source_item_id, ':', 2) AS BIGINT) + 1)]) AS source_item_id FROM facts WHERE source_item_id IS NOT NULL)"
REVIEWS = """chain AS (SELECT *, CAST(split_part(id, '|', 2) AS BIGINT) AS k FROM facts WHERE superseded_by IS NOT NULL),
sup AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first FROM supplier),
used AS (SELECT split_part(subject_id, ':', 1) AS k, predicate, count(*) AS n, bool_or(object_id IS NOT NULL) AS rel FROM facts GROUP BY 1, 2),
reviews AS (
  SELECT 'cf|' || id AS id, 'fact_conflict' AS kind, CASE WHEN k % 4 = 3 THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN k % 2 = 0 THEN (k % 10) / 10.0 END AS confidence, k % 5 + 1 AS impact, NULL AS source_id, NULL AS target_id, id AS old_fact_id, superseded_by AS new_fact_id, NULL AS item_id, k % 3 = 0 AS held, NULL AS n, NULL AS pred FROM chain
  UNION ALL SELECT 'mg|' || s_suppkey, 'entity_merge', 'pending', 0.8, s_suppkey % 4 + 1, 'supplier:' || s_suppkey, 'supplier:' || first, NULL, NULL, NULL, false, NULL, NULL FROM sup WHERE s_suppkey <> first
  UNION ALL SELECT 'ex|' || event_id, 'extraction', 'pending', NULL, 1, NULL, NULL, NULL, NULL, 'item:' || event_id, false, NULL, NULL FROM events
  UNION ALL SELECT 'or|' || lang, 'orphan_prune', 'pending', NULL, count(*), NULL, NULL, NULL, NULL, NULL, false, NULL, NULL FROM documents GROUP BY lang
  UNION ALL SELECT 'fp|' || k || '|' || predicate, 'field_proposal', 'pending', NULL, n, NULL, NULL, NULL, NULL, NULL, false, n, k || '.' || predicate FROM used
)"""


def _world(s, d):
    return V.facts(s, d), V.entities(s, d)


query("kn_21_view_entities", with_(ENTITIES, FACTS, EDGES, body="SELECT id, kind, label, edges FROM n"))(lambda s, d: K.view(*_world(s, d))[0].select("id", "kind", "label", "edges"))
query("kn_21_view_facts", with_(ENTITIES, FACTS, SOURCES, body=f"""
SELECT subject_id, predicate, {VALUE} AS value, f.object_id IS NOT NULL AS ref, f.object_id AS ref_id, coalesce(n, 0) AS sources, confidence, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, f.id AS fact_id
FROM facts f LEFT JOIN entities o ON o.id = f.object_id LEFT JOIN (SELECT fact_id, count(*) AS n FROM sources GROUP BY 1) c ON c.fact_id = f.id WHERE valid_to IS NULL"""))(
    lambda s, d: K.view(*_world(s, d), sources(s, d))[1].withColumn("valid_from", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss"))
)


def _with_agents(s, d):
    """Users' facts with the agent that their item's meta names: every third by its address, every second by routing."""
    e = F.substring_index("id", ":", -1).cast("bigint")
    meta = F.to_json(F.struct(F.when(e % 3 == 0, F.concat(F.lit("a"), (e % 5).cast("string"))).alias("agent_id"), F.when(e % 2 == 0, F.concat(F.lit("r"), (e % 7).cast("string"))).alias("routed_agent_id")))
    facts = V.facts(s, d).withColumn("agent_id", F.when(F.col("predicate") == "lang", "a1"))
    return K.stamped(facts, V.items(s, d).select("id", meta.alias("meta")))


_AGENTS = "stamped AS (SELECT f.*, CASE WHEN predicate = 'lang' THEN 'a1' WHEN e % 3 = 0 THEN 'a' || (e % 5) WHEN e % 2 = 0 THEN 'r' || (e % 7) END AS agent_id FROM (SELECT *, CAST(split_part(source_item_id, ':', 2) AS BIGINT) AS e FROM facts) f)"
query("jn_20_agent_stamps", with_(FACTS, _AGENTS, body="SELECT agent_id, predicate, count(*) AS n, min(id) AS first FROM stamped GROUP BY 1, 2"))(lambda s, d: _with_agents(s, d).groupBy("agent_id", "predicate").agg(F.count("*").alias("n"), F.min("id").alias("first")))
query("flt_08_agent_lens", with_(ENTITIES, FACTS, _AGENTS, body="SELECT e.id, e.kind, count(x.id) AS edges FROM entities e LEFT JOIN (SELECT subject_id AS id FROM stamped WHERE valid_to IS NULL AND agent_id = 'a1' UNION ALL SELECT object_id FROM stamped WHERE valid_to IS NULL AND agent_id = 'a1' AND object_id IS NOT NULL) x USING (id) GROUP BY 1, 2"))(
    lambda s, d: K.view(_with_agents(s, d), V.entities(s, d), agent="a1")[0].select("id", "kind", "edges")
)
query("kn_29_touched", with_(ENTITIES, FACTS, body="SELECT kind, count(*) AS n, count(t.id) AS touched FROM entities LEFT JOIN (SELECT DISTINCT object_id AS id FROM facts WHERE object_id IS NOT NULL) t USING (id) GROUP BY 1"))(
    lambda s, d: K.touched(V.entities(s, d).withColumn("last_used_at", F.lit(None).cast("timestamp_ntz")), V.facts(s, d).select(F.col("object_id").alias("id")), _now()).groupBy("kind").agg(F.count("*").alias("n"), F.count("last_used_at").alias("touched"))
)
query("kn_30_embed_text", with_(ENTITIES, body="SELECT id, kind || ': ' || label || ' (' || split_part(id, ':', 2) || ')' AS text FROM entities"))(lambda s, d: K.stale_embeddings(V.entities(s, d), V.vectors(s, d).select("id", "embedding", "model"), "m1"))
query("flt_22_documents", with_(ENTITIES, body="SELECT id FROM entities WHERE kind = 'document' OR (kind = 'part' AND id IN (SELECT 'part:' || p_partkey FROM part WHERE trim(p_brand) <> ''))"))(
    lambda s, d: K.documents(V.entities(s, d), V.table(s, d, "part").select(V.key("part", "p_partkey").alias("id"), F.col("p_brand").alias("body"))).select("id")
)
query("jn_06_unlinked", with_(ENTITIES, FACTS, body="SELECT id, kind FROM entities e WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE predicate NOT IN ('lang', 'source', 'n_chars') AND (f.subject_id = e.id OR f.object_id = e.id))"))(lambda s, d: K.unlinked(V.entities(s, d), V.facts(s, d).where("predicate not in ('lang', 'source', 'n_chars')")).select("id", "kind"))
query("jn_07_unrouted", with_(ITEMS, FACTS, body="SELECT id, channel FROM items i WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.source_item_id = i.id)"))(lambda s, d: K.unrouted(V.items(s, d), current_or_not(s, d).select(F.col("source_item_id").alias("item_id"))).select("id", "channel"))
query("flt_23_inbox", with_(ITEMS, body="SELECT id, substr(preview, 1, 12000) AS text FROM items WHERE status IN ('stored', 'failed') ORDER BY received_at NULLS LAST, id LIMIT 5"))(lambda s, d: K.inbox(V.items(s, d).withColumn("text", F.col("preview"))).select("id", "text"))
query("flt_24_chat_thread", "SELECT conv_id * 1000 + turn AS id, text, 'a' || turn || '.txt, b' || turn || '.txt' AS files FROM conversations WHERE role = 'user' ORDER BY conv_id * 1000 + turn DESC LIMIT 50")(
    lambda s, d: _thread(V.table(s, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")))
)


def _thread(c):
    own = c.select("id", "text", F.when(F.col("role") == "user", "upload").otherwise("email").alias("channel"), F.lit('{"via":"app"}').alias("meta"), F.col("id").alias("received_at"))
    files = c.select(F.col("id").alias("item_id"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("x"), "turn").select("item_id", F.concat("x", F.col("turn").cast("string"), F.lit(".txt")).alias("filename"))
    return K.chat_thread(own, files).select("id", "text", "files")


query("ag_24_latest_activity", "SELECT event_type AS org, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY 1")(lambda s, d: K.latest_activity(V.table(s, d, "events").select(F.col("event_type").alias("org"), F.col("ts").alias("updated_at"))).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")))
query("ag_25_first_by_key", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")(lambda s, d: K.first_by(V.table(s, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id"))
query("ag_30_totals", with_(ENTITIES, FACTS, body="SELECT (SELECT count(*) FROM facts WHERE source_item_id IS NOT NULL AND id NOT IN (SELECT superseded_by FROM facts WHERE superseded_by IS NOT NULL)) AS added, (SELECT count(*) FROM facts f WHERE source_item_id IS NOT NULL AND id IN (SELECT superseded_by FROM facts WHERE superseded_by IS NOT NULL)) AS changed, (SELECT count(*) FROM facts WHERE valid_to IS NULL) AS facts, (SELECT count(*) FROM entities) AS entities, (SELECT count(DISTINCT kind) FROM entities) AS kinds"))(
    lambda s, d: K.totals(L.commits(V.entities(s, d), V.facts(s, d), V.items(s, d), None), V.facts(s, d), V.entities(s, d))
)

# reviews
query("so_04_triage", with_(FACTS, REVIEWS, body="SELECT id, impact, confidence FROM reviews WHERE status = 'pending' ORDER BY impact DESC, confidence DESC NULLS LAST, id LIMIT 200"))(lambda s, d: R.pending(reviews(s, d)).orderBy(*R.triage()).limit(200).select("id", "impact", "confidence"))
query("ag_28_reviews_by_kind", with_(FACTS, REVIEWS, body=f"SELECT kind, list_position({list(R.KINDS)!r}, kind) AS place, n, first FROM (SELECT kind, count(*) AS n, arg_min(id, nth) AS first FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY impact DESC, confidence DESC NULLS LAST, id) AS nth FROM reviews WHERE status = 'pending') GROUP BY 1)"))(
    lambda s, d: R.by_kind(reviews(s, d)).withColumn("place", F.col("place").cast("int"))
)
query("ag_10_merge_impact", with_(FACTS, REVIEWS, body="SELECT i.id, count(f.id) AS impact FROM (SELECT source_id AS id FROM reviews WHERE kind = 'entity_merge' UNION SELECT target_id FROM reviews WHERE kind = 'entity_merge') i LEFT JOIN (SELECT subject_id AS id FROM facts UNION ALL SELECT object_id FROM facts) f USING (id) GROUP BY 1"))(
    lambda s, d: R.merge_impact(V.facts(s, d), reviews(s, d).where("kind = 'entity_merge'").select(F.explode(F.array("source_id", "target_id")).alias("id")))
)
query("ag_21_conflict_impact", with_(FACTS, SOURCES, body="SELECT f.id AS fact_id, count(s.fact_id) + 1 AS impact FROM facts f LEFT JOIN sources s ON s.fact_id = f.id WHERE superseded_by IS NOT NULL GROUP BY 1"))(lambda s, d: R.conflict_impact(sources(s, d), V.facts(s, d).where("superseded_by is not null")))
query("tm_09_pending_reviews", with_(ENTITIES, FACTS, ITEMS, SOURCES, REVIEWS, body="""
, c AS (SELECT fact_id, count(*) AS n FROM sources GROUP BY 1)
SELECT r.id, r.kind,
  CASE r.kind WHEN 'entity_merge' THEN s.label || ' = ' || t.label WHEN 'fact_conflict' THEN coalesce(e.label, '?') || ' · ' || nf.predicate WHEN 'extraction' THEN i.sender WHEN 'field_proposal' THEN pred ELSE impact || ' unlinked' END AS title,
  CASE WHEN r.kind = 'fact_conflict' THEN coalesce(old.value_text, '?') END AS was, CASE WHEN r.kind = 'fact_conflict' THEN coalesce(nf.value_text, '?') END AS now,
  CASE WHEN r.kind = 'entity_merge' THEN 'Similar name and overlapping identifiers.' WHEN r.kind = 'fact_conflict' AND held THEN 'held' WHEN r.kind = 'fact_conflict' THEN coalesce(co.n, 1) || ' source' || CASE WHEN coalesce(co.n, 1) = 1 THEN '' ELSE 's' END || ' / ' || coalesce(cn.n, 1) || ' source' || CASE WHEN coalesce(cn.n, 1) = 1 THEN '' ELSE 's' END
    WHEN r.kind = 'extraction' THEN coalesce(i.preview, '') ELSE coalesce(CAST(r.n AS VARCHAR), '') END AS note, r.impact, r.confidence
FROM reviews r LEFT JOIN entities s ON s.id = source_id LEFT JOIN entities t ON t.id = target_id LEFT JOIN facts old ON old.id = old_fact_id LEFT JOIN facts nf ON nf.id = new_fact_id LEFT JOIN entities e ON e.id = nf.subject_id
LEFT JOIN c co ON co.fact_id = old_fact_id LEFT JOIN c cn ON cn.fact_id = new_fact_id LEFT JOIN items i ON i.id = r.item_id WHERE r.status = 'pending'"""))(
    lambda s, d: R.shown(reviews(s, d), V.facts(s, d), V.entities(s, d), sources(s, d), V.items(s, d))
)


def _state(f):
    return f.where("source_item_id is not null").select("id", F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss").alias("valid_to"), "superseded_by")


_STATE = "strftime({}, '%Y-%m-%d %H:%M:%S')"
query("tm_10_accept_conflicts", with_(FACTS, REVIEWS, body=f"""
, h AS (SELECT * FROM reviews WHERE kind = 'fact_conflict' AND status = 'pending' AND held)
SELECT f.id, CASE WHEN f.id IN (SELECT new_fact_id FROM h) THEN NULL WHEN c.old_fact_id IS NOT NULL THEN '{NOW} 00:00:00' ELSE {_STATE.format('valid_to')} END AS valid_to,
  CASE WHEN f.id IN (SELECT new_fact_id FROM h) THEN NULL ELSE coalesce(c.new_fact_id, superseded_by) END AS superseded_by
FROM facts f LEFT JOIN h c ON c.old_fact_id = f.id WHERE source_item_id IS NOT NULL"""))(lambda s, d: _state(R.accept_conflicts(V.facts(s, d), R.pending(reviews(s, d)), _now())))
query("tm_11_reject_conflicts", with_(FACTS, REVIEWS, body=f"""
, h AS (SELECT * FROM reviews WHERE kind = 'fact_conflict' AND status = 'pending' AND NOT held)
SELECT f.id, CASE WHEN f.id IN (SELECT old_fact_id FROM h) THEN NULL WHEN f.id IN (SELECT new_fact_id FROM h) THEN '{NOW} 00:00:00' ELSE {_STATE.format('valid_to')} END AS valid_to,
  CASE WHEN f.id IN (SELECT old_fact_id FROM h) THEN NULL ELSE superseded_by END AS superseded_by FROM facts f WHERE source_item_id IS NOT NULL"""))(lambda s, d: _state(R.reject_conflicts(V.facts(s, d), R.pending(reviews(s, d)), _now())))
query("tm_11_retract", with_(FACTS, SOURCES, body="""
, gone AS (SELECT 'item:' || event_id AS item FROM events WHERE event_type = (SELECT min(event_type) FROM events)), kept AS (SELECT * FROM sources WHERE source_item_id NOT IN (FROM gone))
SELECT id, predicate FROM facts f WHERE source_item_id IS NOT NULL AND NOT (source_item_id IN (FROM gone) AND id NOT IN (SELECT fact_id FROM kept))"""))(
    lambda s, d: R.retract(current_or_not(s, d), sources(s, d), _of_type(s, d))[0].select("id", "predicate")
)


def _of_type(s, d):
    """Rejected extractions: those of the first type of event."""
    e = V.table(s, d, "events")
    least = e.agg(F.min("event_type").alias("event_type"))
    return e.join(least, "event_type").select(F.lit("extraction").alias("kind"), V.key("item", "event_id").alias("item_id"))


query("tm_10_accept_merges", with_(ENTITIES, FACTS, REVIEWS, body="SELECT coalesce(t.target_id, f.object_id) AS object_id, predicate, count(*) AS n FROM facts f LEFT JOIN (SELECT source_id, target_id FROM reviews WHERE kind = 'entity_merge') t ON t.source_id = f.object_id WHERE predicate = 'shipped_by' GROUP BY 1, 2"))(
    lambda s, d: R.accept_merges(V.facts(s, d), V.entities(s, d), reviews(s, d))[0].where("predicate = 'shipped_by'").groupBy("object_id", "predicate").agg(F.count("*").alias("n"))
)
query("kn_34_prunable", with_(ENTITIES, FACTS, body="SELECT id, kind FROM entities e WHERE kind = 'document' AND support <> 2 AND NOT EXISTS (SELECT 1 FROM facts f WHERE predicate NOT IN ('lang', 'source', 'n_chars') AND (f.subject_id = e.id OR f.object_id = e.id))"))(
    lambda s, d: R.prunable(V.entities(s, d).withColumn("has_body", F.col("support") == 2).withColumn("last_used_at", F.lit(None).cast("timestamp_ntz")), V.facts(s, d).where("predicate not in ('lang', 'source', 'n_chars')"), reviews(s, d), _now()).select("id", "kind")
)
query("kn_15_orphan_batch", with_(ENTITIES, FACTS, REVIEWS, body="SELECT id, kind, label FROM entities e WHERE kind NOT IN ('document', 'note') AND support <= 1 AND created_at < TIMESTAMP '2024-01-31' AND NOT EXISTS (SELECT 1 FROM facts f WHERE valid_to IS NULL AND predicate NOT IN ('brand', 'type', 'size', 'retail_price', 'contains') AND (f.subject_id = e.id OR f.object_id = e.id))"))(
    lambda s, d: R.orphan_reviews(G.with_edges(V.entities(s, d), V.facts(s, d).where("predicate not in ('brand', 'type', 'size', 'retail_price', 'contains')")).withColumn("has_body", F.lit(False)).withColumn("last_used_at", F.lit(None).cast("timestamp_ntz")), reviews(s, d), _now())
)
query("kn_12_merge_reviews", with_(ENTITIES, FACTS, REVIEWS, EDGES, body="""
, p AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, 0.6 + impact / 10.0 AS sim FROM reviews WHERE kind = 'entity_merge'),
q AS (SELECT p.*, ea.edges AS ae, eb.edges AS be, xa.support AS asup, xb.support AS bsup FROM p JOIN n ea ON ea.id = a JOIN n eb ON eb.id = b JOIN entities xa ON xa.id = a JOIN entities xb ON xb.id = b)
SELECT CASE WHEN (ae, asup) >= (be, bsup) THEN b ELSE a END AS source_id, CASE WHEN (ae, asup) >= (be, bsup) THEN a ELSE b END AS target_id, CASE WHEN sim >= 0.75 THEN least(sim, 0.84) ELSE 0 END AS confidence, CASE WHEN sim >= 0.75 THEN 'pending' ELSE 'rejected' END AS status FROM q"""))(
    lambda s, d: _merge_reviews(s, d)
)


def _merge_reviews(s, d):
    m = reviews(s, d).where("kind = 'entity_merge'")
    pairs = m.select(F.col("source_id").alias("a_id"), F.col("target_id").alias("b_id"), (F.lit(0.6) + F.col("impact") / 10).alias("sim"))
    pairs = pairs.unionByName(pairs.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), (F.col("sim") - 0.1).alias("sim")))
    ents = G.with_edges(V.entities(s, d), V.facts(s, d)).withColumn("natural_keys", F.expr(NO_MAP))
    return R.merge_reviews(pairs, pairs.select("a_id", "b_id").limit(0), ents).withColumn("confidence", N.rounded("confidence", 6))


query("gr_10_neighbours", with_(ENTITIES, FACTS, body="""
, x AS (SELECT subject_id AS center, predicate, object_id AS id, true AS outgoing, id AS fact_id FROM facts WHERE valid_to IS NULL AND object_id IS NOT NULL AND subject_id <> object_id UNION ALL SELECT object_id, predicate, subject_id, false, id FROM facts WHERE valid_to IS NULL AND object_id IS NOT NULL AND subject_id <> object_id),
f AS (SELECT *, row_number() OVER (PARTITION BY center, id ORDER BY NOT outgoing, fact_id) AS nth FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY NOT outgoing, fact_id, predicate) AS place FROM f WHERE nth = 1)
SELECT center, place, predicate, r.id, label, outgoing FROM r JOIN entities e ON e.id = r.id WHERE place <= 5 AND center IN (SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey FROM nation)"""))(
    lambda s, d: R.neighbours(V.facts(s, d), V.entities(s, d), V.entities(s, d).where("kind in ('customer', 'supplier', 'nation')"))
)


def _proposals(s, d):
    return V.table(s, d, "orders").select(F.col("o_orderpriority").alias("dataset"), F.when(F.col("o_orderstatus") == "O", "update").otherwise("add").alias("kind"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).otherwise("desk").alias("actor"), F.col("o_orderstatus").alias("agent"))


query("ag_20_accepted_summary", """
SELECT dataset, actor, adds, updates, 'Accepted ' || actor || '''s update — ' || concat_ws(', ', CASE WHEN adds > 0 THEN adds || CASE WHEN adds = 1 THEN ' row added' ELSE ' rows added' END END, CASE WHEN updates > 0 THEN updates || CASE WHEN updates = 1 THEN ' change applied' ELSE ' changes applied' END END) AS summary
FROM (SELECT o_orderpriority AS dataset, count(*) FILTER (o_orderstatus <> 'O') AS adds, count(*) FILTER (o_orderstatus = 'O') AS updates, CASE WHEN o_orderpriority = '5-LOW' THEN 'desk' WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) ELSE 'Agents' END AS actor FROM orders GROUP BY 1)""")(lambda s, d: R.accepted_summary(_proposals(s, d)))
query("ag_29_pending_by_agent", "SELECT o_orderstatus AS agent, count(*) AS changes, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS tables FROM orders GROUP BY 1")(lambda s, d: R.pending_by_agent(_proposals(s, d)))
query("tm_14_table_list", "SELECT o_orderpriority AS dataset, 'Orders ' || o_orderpriority AS name, count(*) FILTER (o_orderstatus <> 'P') AS accepted, count(*) FILTER (o_orderstatus = 'P') AS proposed, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE count(DISTINCT year(o_orderdate)) END AS versions, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE max(year(o_orderdate)) END AS last_version, strftime(max(o_orderdate), '%Y-%m-%d') AS changed_at FROM orders GROUP BY 1")(
    lambda s, d: _table_list(V.table(s, d, "orders"))
)


def _table_list(o):
    names = o.select(F.col("o_orderpriority").alias("dataset"), F.concat(F.lit("Orders "), "o_orderpriority").alias("name")).distinct()
    rows = o.select(F.col("o_orderpriority").alias("dataset"), F.when(F.col("o_orderstatus") == "P", "proposed").otherwise("accepted").alias("status"), F.col("o_orderdate").alias("updated_at"))
    versions = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("dataset"), F.year("o_orderdate").cast("bigint").alias("version")).distinct()
    return R.table_list(names, rows, versions).withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd"))


query("tm_10_grown_vocabulary", with_(FACTS, REVIEWS, body="SELECT k AS kind, predicate, NULL AS alias_of, rel AS as_relation FROM used WHERE predicate <> 'status' UNION ALL SELECT 'invoice', 'status', 'state', false"))(
    lambda s, d: R.grown_vocabulary(s.createDataFrame([("invoice", "status", "state", False)], "kind string, predicate string, alias_of string, as_relation boolean"), reviews(s, d))
)


# extractions: each order is one, with its customer and lines
def _extraction(s, d):
    o, lines = V.table(s, d, "orders"), V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_comment" if "l_comment" in V.table(s, d, "lineitem").columns else F.lit("").alias("l_comment"))
    none = F.lit(None).cast("string")
    head = o.select(F.col("o_orderkey").alias("extraction_id"), F.lit(0).alias("ord"), F.lit("o").alias("local_id"), F.lit("invoice").alias("kind"), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("label"))
    parts = lines.select(F.col("l_orderkey").alias("extraction_id"), F.col("l_linenumber").cast("int").alias("ord"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("local_id"), F.when(F.col("l_linenumber") % 2 == 0, "concept").otherwise("part").alias("kind"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("label"))
    ents = head.unionByName(parts)
    fact = lambda df, i, ord_, predicate, obj=none, num=F.lit(None).cast("double"): df.select(i.alias("extraction_id"), ord_.cast("int").alias("ord"), F.lit("o").alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), num.cast("double").alias("num"), none.alias("unit"), none.alias("date"), none.alias("text"), F.lit(0.9).alias("confidence"), none.alias("snippet"))
    facts = fact(o, F.col("o_orderkey"), F.lit(0), "amount", num=F.col("o_totalprice")).unionByName(fact(lines, F.col("l_orderkey"), F.col("l_linenumber"), "contains", obj=F.concat(F.lit("p"), F.col("l_linenumber").cast("string")))).unionByName(fact(lines, F.col("l_orderkey"), F.col("l_linenumber") + 10, "quantity", num=F.col("l_quantity")))
    return ents, facts


_LINES = "l AS (SELECT l_orderkey AS x, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber) AS nth FROM lineitem)"
query("flt_20_restrained_entities", f"WITH {_LINES} SELECT o_orderkey AS extraction_id, 0 AS ord FROM orders UNION ALL SELECT x, n FROM l WHERE n % 2 = 1 OR nth <= 3")(
    lambda s, d: E.restrained(*_extraction(s, d), *_templates(s))[0].select("extraction_id", "ord")
)
query("flt_20_off_template", "SELECT l_orderkey AS extraction_id, CAST(l_linenumber + 10 AS INTEGER) AS ord FROM lineitem")(lambda s, d: E.restrained(*_extraction(s, d), *_templates(s))[2].select("extraction_id", "ord"))
query("kn_27_off_template_review", "SELECT l_orderkey AS extraction_id, count(*) AS n, 'quantity' AS predicate FROM lineitem GROUP BY 1")(
    lambda s, d: (lambda e, f: E.off_template_review(E.restrained(e, f, *_templates(s))[2], e, e.select("extraction_id", F.lit("an order").alias("doc_label")).distinct()))(*_extraction(s, d)).select("extraction_id", "n", F.col("facts")[0]["predicate"].alias("predicate"))
)


def _templates(s):
    kinds = s.createDataFrame([("invoice",), ("part",)], "name string")
    return kinds, s.createDataFrame([("invoice", "amount"), ("invoice", "contains")], "kind string, predicate string")


query("kn_33_issues", "SELECT l_orderkey AS extraction_id, count(*) AS n, min('facts.' || (l_linenumber) || '.value.entityLocalId') AS first FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k <= 5 GROUP BY 1")(
    lambda s, d: (lambda e, f: E.issues(e.where("ord = 0"), f))(*_extraction(s, d)).groupBy("extraction_id").agg(F.count("*").alias("n"), F.min("issue").alias("first"))
)
query("kn_32_mapped_facts", """
SELECT event_id AS extraction_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) END AS num, CASE WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN event_id % 3 = 2 THEN event_type END AS text, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS confidence FROM events""")(lambda s, d: _mapped(V.table(s, d, "events")))


def _mapped(e):
    k, none = F.col("event_id") % 3, F.lit(None).cast("string")
    text = F.when(k == 0, F.concat(F.lit("$"), F.col("event_id").cast("string"))).when(k == 1, F.date_format("ts", "MMMM d, y")).otherwise(F.col("event_type"))
    raw = e.select(F.col("event_id").alias("extraction_id"), F.lit(0).alias("ord"), F.lit("u").alias("subject"), F.lit("said").alias("predicate"), F.when(k == 0, "number").when(k == 1, "date").otherwise("text").alias("value_type"), F.lit(None).cast("double").alias("value_number"), none.alias("value_date"), none.alias("value_entity"), text.alias("value_text"), none.alias("unit"), none.alias("cardinality"), F.when(F.col("event_id") % 2 == 0, 7.5).otherwise(-1.0).alias("confidence"), none.alias("snippet"))
    return E.mapped_facts(raw).select("extraction_id", "num", "date", "text", "confidence")


query("kn_32_mapped_entities", "SELECT user_id AS extraction_id, 'thing' AS kind, 'user ' || user_id AS label, 'u' || user_id || '@x.org' AS email FROM (SELECT DISTINCT user_id FROM events)")(
    lambda s, d: E.mapped_entities(V.table(s, d, "events").select("user_id").distinct().select(F.col("user_id").alias("extraction_id"), F.lit(0).alias("ord"), F.lit("u").alias("local_id"), F.lit("").alias("kind"), F.concat(F.lit("  user "), F.col("user_id").cast("string"), F.lit(" ")).alias("label"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.org")).alias("email"), F.lit("").alias("phone"), F.lit(None).cast("string").alias("invoice_no"))).select("extraction_id", "kind", "label", F.element_at("natural_keys", "email").alias("email"))
)

# search as a whole
query("st_09_seeds", with_(ENTITIES, FACTS, EDGES, body="SELECT id, row_number() OVER (ORDER BY leg, rank) AS ord FROM (SELECT id, min(leg) AS leg, min(rank) AS rank FROM (SELECT id, 0 AS leg, row_number() OVER (ORDER BY edges DESC, id) AS rank FROM n QUALIFY rank <= 5 UNION ALL SELECT id, 1, row_number() OVER (ORDER BY id) FROM n WHERE kind = 'region') GROUP BY 1)"))(
    lambda s, d: A.seeds(A._ranked(G.with_edges(V.entities(s, d), V.facts(s, d)).orderBy(F.desc("edges"), "id").limit(5), F.desc("edges"), "id").select("id", "rank"), A._ranked(V.entities(s, d).where("kind = 'region'"), "id").select("id", "rank"))
)
_LINKED = f"""x AS (SELECT n.*, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9à-öø-ÿ]+'), lambda t: t <> '') AS tok, split_part(id, ':', 2) AS key FROM n),
y AS (SELECT *, len(list_filter(tok, lambda t: len(list_filter({LINK!r}, lambda q: t = q OR (length(q) >= 3 AND starts_with(t, q)) OR (length(t) >= 3 AND starts_with(q, t)))) > 0)) AS m, len(list_filter({LINK!r}, lambda q: key = q OR (contains(key, q) AND length(q) >= 4))) > 0 AS kh FROM x),
linked AS (SELECT id, label, row_number() OVER (ORDER BY score DESC, label, id) AS rank FROM (SELECT id, label, edges, CASE WHEN m = 0 AND NOT kh THEN 0 ELSE CASE WHEN len(tok) > 0 THEN m / len(tok) ELSE 0 END + CAST(kh AS INTEGER) END AS score FROM y WHERE score >= 0.5 ORDER BY score DESC, edges DESC, label, id LIMIT 5))"""
_KEYWORD = f"""t AS (SELECT id, unnest({_hits("lower(label || ' ' || kind || ' external_id ' || split_part(id, ':', 2))", LINK)}) AS term FROM entities
 UNION SELECT f.subject_id, unnest({_hits(f"lower(predicate || ' ' || {VALUE})", LINK)}) FROM facts f LEFT JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL),
found AS (SELECT id, label, row_number() OVER (ORDER BY score DESC, label, id) AS rank FROM (SELECT id, count(DISTINCT term) AS score FROM t GROUP BY 1) JOIN entities USING (id) QUALIFY rank <= 12)"""
query("se_17_found_entities", with_(ENTITIES, FACTS, EDGES, _LINKED, _KEYWORD, body="""
, b AS (SELECT id, min((leg, rank)) AS p FROM (SELECT id, 0 AS leg, rank FROM linked UNION ALL SELECT id, 1, rank FROM found) GROUP BY 1)
SELECT id, n.kind, n.label, edges AS connections, row_number() OVER (ORDER BY p) AS ord FROM b JOIN n USING (id) QUALIFY ord <= 12"""))(lambda s, d: A.found_entities(V.facts(s, d), V.entities(s, d), LINK))
query("se_09_evidence", with_(ENTITIES, PASSAGES, body="""
, e AS (SELECT 0 AS leg, row_number() OVER (ORDER BY id) AS rank, 'entity' AS type, label, 'Known region "' || label || '": name ' || label AS line, id AS entity_id FROM entities WHERE kind = 'region'),
r AS (SELECT 1 AS leg, row_number() OVER (ORDER BY c_custkey) AS rank, 'row' AS type, 'Customers — ' || c_name AS label, 'Row in table "Customers": Name=' || c_name || ' · Segment=' || c_mktsegment AS line, NULL AS entity_id FROM customer),
p AS (SELECT 2 AS leg, row_number() OVER (ORDER BY entity_id, seq) AS rank, 'passage' AS type, entity_id || ' · p.' || (seq + 1) AS label, 'Passage from document "' || entity_id || '" (page ' || (seq + 1) || '): "' || text || '"' AS line, entity_id FROM passages),
u AS (FROM e WHERE rank <= 8 UNION ALL FROM r WHERE rank <= 8 UNION ALL FROM p WHERE rank <= 5)
SELECT n, type, label, '[' || n || '] ' || line AS line, entity_id FROM (SELECT *, row_number() OVER (ORDER BY leg, rank) AS n FROM u)"""))(lambda s, d: _evidence(s, d).drop("dataset"))


def _evidence(s, d):
    regions = A._ranked(V.entities(s, d).where("kind = 'region'"), "id")
    said = regions.select("id", F.lit("name").alias("predicate"), F.col("label").alias("value"), F.lit(False).alias("ref"), F.lit(1).alias("place"))
    rows = A._ranked(V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("data"), F.lit(None).cast("string").alias("entity_id")).orderBy("id").limit(20), "id")
    some = A._ranked(V.passages(s, d).orderBy("entity_id", "seq").limit(20), "entity_id", "seq").select("entity_id", F.col("entity_id").alias("label"), (F.col("seq") + 1).alias("page"), "text", "rank")
    return A.evidence(A.entity_lines(regions, said), A.row_lines(rows, {"name": "Name", "segment": "Segment"}, "Customers"), A.passage_lines(some))



# scalars
query("sc_11_plural", "SELECT DISTINCT p_type AS kind, CASE WHEN regexp_matches(lower(split_part(p_type, ' ', 3)), '[^aeiou]y$') THEN regexp_replace(lower(split_part(p_type, ' ', 3)), 'y$', 'ies') WHEN regexp_matches(lower(split_part(p_type, ' ', 3)), '(s|x|z|ch|sh)$') THEN lower(split_part(p_type, ' ', 3)) || 'es' ELSE lower(split_part(p_type, ' ', 3)) || 's' END AS many FROM part")(
    lambda s, d: V.table(s, d, "part").select(F.col("p_type").alias("kind"), X.plural(F.lower(F.split_part("p_type", F.lit(" "), F.lit(3)))).alias("many")).distinct()
)
query("sc_18_parse_loose", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda s, d: V.table(s, d, "events").select("event_id", F.get_json_object(parse_loose(F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` and so on"))), "$.k").alias("k")))
query("sc_27_likely_scans", "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) < 24 * 30 AS scan FROM documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", X.is_likely_scan("text", F.lit(30)).alias("scan")))
query("sc_19_review_replies", "SELECT event_id, CASE WHEN event_id % 12 + 1 <= 9 THEN CAST(event_id % 12 + 1 AS INTEGER) END AS idx, CASE WHEN event_id % 12 + 1 <= 9 THEN event_id % 2 = 0 END AS accept FROM events")(
    lambda s, d: V.table(s, d, "events").select("event_id", X.review_reply(F.concat(F.lit(" "), (F.col("event_id") % 12 + 1).cast("string"), F.when(F.col("event_id") % 2 == 0, " Yes").otherwise("n")), 9).alias("r")).select("event_id", F.col("r.index").alias("idx"), F.col("r.accept").alias("accept"))
)
query("flt_21_mentions", "SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'part') THEN 0 WHEN len(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda w: starts_with(w, 'part'))) > 0 THEN 1 WHEN contains(lower(p_name), 'part') THEN 2 END AS rank FROM part")(lambda s, d: V.table(s, d, "part").select("p_partkey", X.mention_rank("p_name", " Part ").alias("rank")))
query("gr_09_node_shapes", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'image/png' END AS image, CASE WHEN page_id % 3 = 1 THEN 'audio/ogg' END AS audio, CASE WHEN page_id % 3 = 2 AND regexp_matches(lower(url), '^https?://\\S+$') THEN url END AS url FROM pages")(
    lambda s, d: V.table(s, d, "pages").select("page_id", X.node_shape(F.when(F.col("page_id") % 3 == 2, "bookmark").otherwise("document"), F.concat(F.lit("doc:h:file."), F.when(F.col("page_id") % 3 == 0, "PNG").otherwise("opus")), F.lit(None).cast("string"), F.col("url"), F.lit("x")).alias("s")).select("page_id", "s.image", "s.audio", "s.url")
)
query("src_17_sheet_text", "SELECT c_mktsegment AS sheet, 'Name | Key' || chr(10) || string_agg(CASE WHEN nth <= 200 THEN c_name || ' | ' || c_custkey END, chr(10) ORDER BY nth) AS text, count(*) > 200 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS nth FROM customer) GROUP BY 1")(
    lambda s, d: _sheet(V.table(s, d, "customer"))
)


def _sheet(c):
    from pyspark.sql import Window

    rows = c.select(F.col("c_mktsegment").alias("sheet"), (F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1).alias("ord"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("key"), F.col("c_custkey").cast("string")).alias("data"))
    return sheet_text(rows, [("name", "Name"), ("key", "Key")])


# slots: a second segment for every customer, and a second status for every invoice whose template says one
query("kn_09_aligned_slots", with_(FACTS, body=f"""
SELECT predicate, CASE WHEN predicate IN ('segment', 'brand') THEN 'many' ELSE cardinality END AS cardinality, false AS closed, count(*) AS n FROM facts WHERE valid_to IS NULL AND predicate <> 'type' GROUP BY ALL
UNION ALL SELECT predicate, 'many', false, count(*) FROM facts WHERE predicate = 'type' AND valid_to IS NULL GROUP BY 1
UNION ALL SELECT 'type', 'one', true, count(*) FROM facts WHERE predicate = 'type' AND valid_to IS NULL"""))(lambda s, d: _aligned(s, d))


def _aligned(s, d):
    f = current(V.facts(s, d))
    twice = f.where("predicate = 'type'").withColumn("cardinality", F.lit("many")).withColumn("id", F.concat("id", F.lit("|list")))
    heard = f.where("predicate in ('segment', 'brand', 'status', 'type')").select("subject_id", "predicate", F.when(F.col("predicate") == "status", "one").otherwise("many").alias("cardinality"), F.lit("one").alias("declared"))
    out, _ = aligned_slots(f.unionByName(twice), heard, _now())
    return out.groupBy("predicate", "cardinality", F.col("valid_to").isNotNull().alias("closed")).agg(F.count("*").alias("n"))


query("jn_22_related_rows", "SELECT o_orderkey AS left_id, c_custkey AS right_id FROM orders JOIN customer ON c_custkey = o_custkey")(
    lambda s, d: related(V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("customer"), F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("data")), V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("key"), F.col("c_custkey").cast("string")).alias("data")), "customer", "key", [ColumnDef("customer", "Customer")], [ColumnDef("key", "Key")])
)
query("flt_19_live_after_merges", with_(ENTITIES, FACTS, REVIEWS, body="SELECT kind, count(*) AS n FROM entities WHERE id NOT IN (SELECT source_id FROM reviews WHERE kind = 'entity_merge') GROUP BY 1"))(
    lambda s, d: live(R.accept_merges(V.facts(s, d), V.entities(s, d), reviews(s, d))[1]).groupBy("kind").agg(F.count("*").alias("n"))
)
