"""Queries: timelines, ontology, resolution, lenses and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import graph as G
from ..operators import imports as I
from ..operators import lenses as L
from ..operators import ontology as O
from ..operators import resolve as R
from ..operators import timeline as M
from ..operators.facts import current
from ..operators.tables import ColumnDef
from ..registry import query
from ..vault import adapter as V
from ..vault.oracle import ENTITIES, FACTS, ITEMS, VECTORS, with_
from .search import _NT
from .analytics import VALUE
from .graph import _WORLD_FACTS, EDGES, world

FE = (ENTITIES, FACTS)
_TL = f""", f AS (SELECT f.*, e.label AS sl, {VALUE} AS said FROM facts f LEFT JOIN entities e ON e.id = f.subject_id LEFT JOIN entities o ON o.id = f.object_id),
n AS (SELECT source_item_id AS id, count(*) AS n FROM f WHERE source_item_id IS NOT NULL GROUP BY 1),
t AS (SELECT 'message' AS type, received_at AS ts, false AS date_only, coalesce(nullif(preview, ''), 'Message received') AS title, concat_ws(' · ', sender, CASE WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' fact extracted' ELSE ' facts extracted' END END) AS detail, id AS ref FROM items LEFT JOIN n USING (id)
UNION ALL SELECT 'date', CAST(value_date AS TIMESTAMP), true, sl || ' — ' || replace(predicate, '_', ' '), NULL, id FROM f WHERE valid_to IS NULL AND value_date IS NOT NULL AND sl IS NOT NULL
UNION ALL SELECT 'change', f.valid_to, false, sl || ' · ' || replace(predicate, '_', ' ') || ' changed', f.said || ' → ' || coalesce(g.gsaid, '?'), f.id FROM f LEFT JOIN (SELECT id AS gid, said AS gsaid FROM f) g ON g.gid = f.superseded_by WHERE f.valid_to IS NOT NULL AND superseded_by IS NOT NULL AND sl IS NOT NULL
UNION ALL SELECT 'seen', created_at, false, label || ' first seen', NULL, id FROM entities)
SELECT type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, date_only, title, detail, ref FROM t"""
query("tm_01_timeline", with_(*FE, ITEMS, body=_TL + " ORDER BY t.ts DESC, date_only, title, ref LIMIT 200"))(lambda s, d: M.events(V.entities(s, d), V.facts(s, d), V.items(s, d)))
query("st_01_timeline_families", with_(*FE, ITEMS, body=_TL.replace("SELECT type, strftime", "SELECT type, count(*) AS n FROM (SELECT type, strftime") + ") GROUP BY 1"))(lambda s, d: M.events(V.entities(s, d), V.facts(s, d), V.items(s, d), limit=None).groupBy("type").agg(F.count("*").alias("n")))
query("tm_02_commits", with_(*FE, ITEMS, body=f"""
, f AS (SELECT f.*, e.label AS subject, {VALUE} AS said FROM facts f LEFT JOIN entities e ON e.id = f.subject_id LEFT JOIN entities o ON o.id = f.object_id WHERE predicate = 'last_event_type'),
w AS (SELECT superseded_by AS id, said AS was FROM f WHERE superseded_by IS NOT NULL),
l AS (SELECT source_item_id AS item_id, was IS NOT NULL AS ch, CASE WHEN was IS NOT NULL THEN '~ ' ELSE '+ ' END || subject || ' ' || replace(predicate, '_', ' ') || ': ' || CASE WHEN was IS NOT NULL THEN was || ' → ' || said ELSE said END AS line FROM f LEFT JOIN w USING (id) WHERE source_item_id IS NOT NULL)
SELECT item_id, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS ts, channel, sender, count(*) FILTER (WHERE NOT ch) AS added, count(*) FILTER (WHERE ch) AS changed, string_agg(line, chr(10)) AS lines FROM l JOIN items i ON i.id = l.item_id GROUP BY item_id, received_at, channel, sender ORDER BY received_at DESC, item_id LIMIT 100"""))(lambda s, d: M.commits(V.entities(s, d), V.facts(s, d).where("predicate = 'last_event_type'"), V.items(s, d)))


def registry() -> O.Registry:
    r = O.Registry()
    r.add(O.Kind("invoice", "Invoice", ("bill",), (O.Field("amount", "number", aliases=("total",)), O.Field("order_date", "date"), O.Field("due_date", "date"), O.Field("priority")), (O.Relation("billed_to", "customer", many=False), O.Relation("contains", "part"))))
    r.add(O.Kind("customer", "Customer", ("client",), (O.Field("acctbal", "number"),), (O.Relation("located_in", "nation", many=False),)))
    r.add(O.Kind("part", "Part", (), (O.Field("part_size", "number"), O.Field("brand")), ()))
    r.add(O.Kind("user", "User", (), (), ()))
    return r


_VOC = "voc AS (SELECT * FROM (VALUES " + ", ".join(f"('{k.kind}', '{w}', '{f.key}')" for k in registry().kinds.values() for f in k.fields for w in (f.key, *f.aliases)) + ", " + ", ".join(f"('{k.kind}', '{w}', '{r.predicate}')" for k in registry().kinds.values() for r in k.relations for w in (r.predicate, *r.aliases)) + ") v(kind, word, canonical))"
_UNI = "(" + ", ".join(f"'{p}'" for p in O.UNIVERSAL) + ")"
_HF = "hf AS (SELECT predicate, e.kind, f.created_at, valid_to IS NULL AS cur, CASE WHEN object_id IS NOT NULL THEN 'entity' WHEN value_num IS NOT NULL THEN 'number' WHEN value_date IS NOT NULL THEN 'date' ELSE 'text' END AS value_type, unit FROM facts f JOIN entities e ON e.id = f.subject_id)"
query("ag_13_ontology_health", with_(*FE, _VOC, _HF, body=f"""
, p AS (SELECT kind, predicate, min(created_at) AS first, count(*) FILTER (WHERE cur) AS n FROM hf GROUP BY 1, 2 HAVING count(*) FILTER (WHERE cur) > 0),
q AS (SELECT p.*, predicate IN {_UNI} OR EXISTS (FROM voc WHERE voc.kind = p.kind AND word = predicate) AS ok, kind IN (SELECT kind FROM voc) AS reg, first >= TIMESTAMP '1998-06-01' - INTERVAL 7 DAY AS fresh FROM p)
SELECT kind, CAST(sum(n) AS BIGINT) AS fact_count, count(*) AS distinct_predicates, CASE WHEN bool_or(reg) THEN sum(CASE WHEN ok THEN n ELSE 0 END) / sum(n) END AS conformance,
 coalesce(string_agg(predicate, ',' ORDER BY predicate) FILTER (WHERE fresh), '') AS new_predicates, coalesce(string_agg(predicate, ',' ORDER BY n DESC, predicate) FILTER (WHERE reg AND NOT ok), '') AS off_template FROM q GROUP BY 1"""))(
    lambda s, d: O.health(O.health_facts(V.facts(s, d), V.entities(s, d)), registry().vocabulary(s).where("kind <> 'user'"), "1998-06-01")
)
query("ag_14_field_proposals", with_(*FE, _VOC, _HF, body=f"""
, p AS (SELECT kind, predicate, count(*) AS count, mode(value_type) AS value_type, mode(unit) AS unit FROM hf WHERE cur AND predicate NOT IN {_UNI} AND kind IN (SELECT kind FROM voc) AND NOT EXISTS (FROM voc WHERE voc.kind = hf.kind AND word = hf.predicate) GROUP BY 1, 2 HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, predicate) AS r FROM p),
a AS (SELECT r.*, (SELECT min(canonical) FROM voc v WHERE v.kind = r.kind AND (len(list_intersect(string_split(r.predicate, '_'), string_split(canonical, '_'))) IN (len(list_distinct(string_split(r.predicate, '_'))), len(list_distinct(string_split(canonical, '_')))) OR len(list_intersect(string_split(r.predicate, '_'), string_split(canonical, '_'))) / len(list_distinct(list_concat(string_split(r.predicate, '_'), string_split(canonical, '_')))) >= 0.5)) AS alias_of FROM r WHERE r <= 2)
SELECT kind, predicate, count, value_type, unit, alias_of, alias_of IS NULL AND value_type = 'entity' AS as_relation FROM a"""))(
    lambda s, d: O.field_proposals(O.health_facts(V.facts(s, d), V.entities(s, d)), registry().vocabulary(s))
)
query("kn_16_category_proposals", with_(ENTITIES, body="SELECT kind, count(*) AS count, string_agg(label, '; ' ORDER BY r) FILTER (WHERE r <= 5) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY support DESC, label, id) AS r FROM entities WHERE kind NOT IN ('invoice', 'customer', 'part', 'user')) GROUP BY 1 HAVING count(*) >= 3"))(
    lambda s, d: O.category_proposals(V.entities(s, d), registry().names(s))
)
query("kn_10_missing_slots", with_(ENTITIES, body="SELECT predicate, count(*) AS n FROM (SELECT id, 'due_date' AS predicate FROM entities WHERE kind = 'invoice' UNION ALL SELECT id, 'part_size' FROM entities WHERE kind = 'part') GROUP BY 1"))(
    lambda s, d: O.missing_slots(V.entities(s, d), V.facts(s, d), registry().vocabulary(s)).groupBy("predicate").agg(F.count("*").alias("n"))
)
query("kn_35_records", with_(*FE, _VOC, body=f"SELECT subject_id, predicate, CASE WHEN f.object_id IS NOT NULL THEN 'relation' WHEN EXISTS (FROM voc WHERE voc.kind = e.kind AND word = predicate) THEN 'field' ELSE 'other' END AS section, string_agg({VALUE}, '; ' ORDER BY {VALUE}) AS \"values\" FROM facts f JOIN entities e ON e.id = subject_id AND e.kind = 'customer' LEFT JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL GROUP BY ALL"))(
    lambda s, d: O.record(V.entities(s, d).where("kind in ('customer', 'nation')"), V.facts(s, d), registry().vocabulary(s)).where("subject_id like 'customer:%'")
)

_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_PAIRS = "l AS (SELECT label, " + _TRI.format(c="label") + " AS g FROM (SELECT DISTINCT p_name AS label FROM part)), pr AS (SELECT a.label AS x, b.label AS y, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS sim FROM l a JOIN l b ON a.label < b.label)"
query("jn_10_trigram_pairs", with_(_PAIRS, body="SELECT 'part' AS kind, x, y, sim FROM pr WHERE sim >= 0.55"))(lambda s, d: R.label_pairs(V.entities(s, d).where("kind = 'part'"), 0.55))
query("kn_01_match_entities", "WITH l AS (SELECT id, label, " + _TRI.format(c="label") + " AS g FROM (SELECT 'part:' || p_partkey AS id, p_name AS label FROM part)), w AS (SELECT id AS wanted_id, label, g FROM l WHERE CAST(split_part(id, ':', 2) AS INT) < 5), m AS (SELECT wanted_id, l.id, len(list_intersect(w.g, l.g)) / len(list_distinct(list_concat(w.g, l.g))) AS sim FROM w JOIN l ON w.wanted_id <> l.id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wanted_id ORDER BY sim DESC, id) AS rank FROM m WHERE sim >= 0.3) WHERE rank <= 10")(
    lambda s, d: R.match_entities(V.entities(s, d).where("kind = 'part' and cast(split(id, ':')[1] as int) < 5").select(F.col("id").alias("wanted_id"), "kind", "label"), V.entities(s, d).where("kind = 'part'"))
)
query("jn_11_nearest_pairs", with_(VECTORS, body="SELECT a_id, b_id, floor(sim*1e6+0.5)/1e6 AS sim FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) AS r FROM (SELECT a.id AS a_id, b.id AS b_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM vectors a JOIN vectors b ON a.kind = b.kind AND a.model = b.model AND a.id <> b.id WHERE a.vec_id % 50 = 0)) WHERE r = 1 AND sim >= 0.1"))(
    lambda s, d: R.nearest_pairs(V.vectors(s, d).where("vec_id % 50 = 0"), V.vectors(s, d), 0.1).withColumn("sim", N.rounded("sim", 6))
)
query("kn_13_winners", with_(ENTITIES, FACTS, EDGES, body="SELECT CASE WHEN (a.edges, ea.support) >= (b.edges, eb.support) THEN a.id ELSE b.id END AS winner, CASE WHEN (a.edges, ea.support) >= (b.edges, eb.support) THEN b.id ELSE a.id END AS loser FROM n a JOIN n b ON a.kind = 'part' AND b.kind = 'part' AND CAST(split_part(b.id, ':', 2) AS INT) = CAST(split_part(a.id, ':', 2) AS INT) + 1 JOIN entities ea ON ea.id = a.id JOIN entities eb ON eb.id = b.id"))(
    lambda s, d: R.winners(V.table(s, d, "part").select(V.key("part", "p_partkey").alias("a_id"), F.concat(F.lit("part:"), (F.col("p_partkey") + 1).cast("string")).alias("b_id")), G.with_edges(V.entities(s, d).where("kind = 'part'"), V.facts(s, d)))
)


def _merges(s, d):
    """Parts with a name that a lesser part has go into the next lesser one: chains."""
    p = V.table(s, d, "part").select("p_partkey", "p_name")
    from pyspark.sql import Window

    last = F.lag("p_partkey").over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return p.withColumn("w", last).where("w is not null").select(V.key("part", "p_partkey").alias("loser"), V.key("part", "w").alias("winner"))


query("kn_11_merge_chains", with_(FACTS, body="SELECT object_id, count(*) AS n FROM (SELECT 'part:' || min(p_partkey) OVER (PARTITION BY p_name) AS object_id FROM facts JOIN part ON object_id = 'part:' || p_partkey WHERE predicate = 'contains') GROUP BY 1"))(
    lambda s, d: R.merge_entities(V.facts(s, d).where("predicate = 'contains'"), V.entities(s, d).where("kind = 'part'"), _merges(s, d))[0].groupBy("object_id").agg(F.count("*").alias("n"))
)
query("kn_14_orphans", with_(ENTITIES, _WORLD_FACTS, EDGES, body="SELECT n.id FROM n JOIN entities e ON e.id = n.id WHERE n.kind NOT IN ('document', 'note') AND edges = 0 AND support <= 1"))(
    lambda s, d: R.orphans(G.with_edges(V.entities(s, d), world(s, d)).withColumn("has_body", F.lit(False)).withColumn("last_used_at", F.lit(None).cast("timestamp_ntz")), F.lit("2025-01-01").cast("timestamp_ntz")).select("id")
)


def _claims(s, d):
    e = V.table(s, d, "events")
    return e.select(V.key("user", "user_id").alias("claim_key"), F.concat(F.lit("ev|"), F.col("event_id").cast("string")).alias("fact_id"), F.col("ts").alias("observed_at"), V.key("item", "event_id").alias("source_item_id"), F.col("event_type").alias("value"), F.lit(0.9).alias("confidence"))


query("kn_08_fact_fold", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p IS NULL THEN 'new' WHEN p = event_type THEN 'deduped' ELSE 'superseded' END AS outcome FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, 'item:' || event_id) AS p FROM events)) GROUP BY 1")(
    lambda s, d: R.fold_facts(_claims(s, d)).groupBy("outcome").agg(F.count("*").alias("n"))
)
query("kn_08_fact_chain", with_(FACTS, body="SELECT id AS fact_id, superseded_by FROM facts WHERE predicate = 'last_event_type'"))(lambda s, d: R.ended(R.fold_facts(_claims(s, d))).select("fact_id", "superseded_by"))
query("ag_22_centroids", "SELECT 'k' || label AS agent_id, count(*) AS n, floor(list_first(list(a))*1e6+0.5)/1e6 AS first FROM (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) OVER (PARTITION BY label) AS a FROM embeddings) GROUP BY 1")(
    lambda s, d: R.fold_centroids(V.table(s, d, "embeddings").select(F.concat(F.lit("k"), F.col("label").cast("string")).alias("agent_id"), F.col("vec_id").alias("id"), F.lit(0).alias("created_at"), "embedding")).select("agent_id", "n", N.rounded(F.element_at("mean", 1), 6).alias("first"))
)
query("ag_23_learned_terms", f"""
WITH e AS (SELECT conv_id % 5 AS agent_id, conv_id * 1000 + turn AS ord, CASE WHEN role = 'user' THEN 0.25 ELSE -0.25 END AS s, unnest({_NT.format('text')}) AS term FROM conversations),
f AS (SELECT agent_id, term, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST(s AS DOUBLE) ORDER BY ord)), lambda a, x: greatest(-1.0, least(1.0, a + x))) AS weight FROM e GROUP BY 1, 2)
SELECT agent_id, term, weight FROM f WHERE abs(weight) >= 0.05 QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY abs(weight) DESC, term) <= 24""")(lambda s, d: R.learn_terms(V.table(s, d, "conversations").select((F.col("conv_id") % 5).alias("agent_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.when(F.col("role") == "user", "accept").otherwise("reject").alias("verdict"), X.normalize_terms("text").alias("terms"))))


def _filed(s, d):
    docs = V.table(s, d, "documents")
    return docs.select(V.key("document", "doc_id").alias("id"), F.lit("document").alias("kind"), F.when(F.col("doc_id") % 3 == 0, "application/pdf").otherwise("text/plain").alias("media"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("channel"), F.make_date(F.lit(2024), F.col("doc_id").cast("int") % 12 + 1, F.lit(3)).alias("received_at"), F.array(F.struct(F.lit("customer").alias("kind"), F.col("lang").alias("label"))).alias("links"))


query("ag_15_available_lenses", "SELECT 'client' AS lens, count(DISTINCT lang) AS folders FROM documents UNION ALL SELECT 'month', count(DISTINCT doc_id % 12) FROM documents UNION ALL SELECT 'type', count(DISTINCT doc_id % 3 = 0) FROM documents UNION ALL SELECT 'channel', count(DISTINCT CASE WHEN doc_id % 4 <> 0 THEN source END) FROM documents")(lambda s, d: L.available(_filed(s, d), ["client", "month", "type", "channel", "project"]))
query("tm_17_lens_tree", """
WITH a AS (SELECT 'document:' || doc_id AS id, lang AS p1, coalesce(CASE WHEN doc_id % 4 <> 0 THEN source END, 'unfiled') AS c, CASE WHEN doc_id % 3 = 0 THEN 'pdfs' ELSE 'text' END AS t FROM documents),
b AS (SELECT *, count(*) OVER (PARTITION BY p1) AS n1, count(*) OVER (PARTITION BY p1, c) AS n2 FROM a)
SELECT id, CASE WHEN n1 = 1 THEN p1 WHEN n2 = 1 THEN p1 || '/' || c ELSE p1 || '/' || c || '/' || t END AS path FROM b""")(lambda s, d: L.tree(_filed(s, d), ["client", "channel", "type"]))
query("wn_08_file_names", "SELECT doc_id AS id, lang AS path, source || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS filename FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)")(lambda s, d: L.plan_files(V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("label"), F.col("lang").alias("folder"))))

_CUST = [ColumnDef("c_name", "Name"), ColumnDef("c_mktsegment", "Company"), ColumnDef("c_acctbal", "Balance", "number"), ColumnDef("c_custkey", "customer_id", "number")]


def _import(s, d):
    rows = V.table(s, d, "customer")
    return I.graph_of_table(rows, I.infer_schema("customers", _CUST, rows, subject="c_name", roles={"c_custkey": "skip"}))


query("kn_22_import_entities", "SELECT 'person' AS kind, count(DISTINCT lower(c_name)) AS n FROM customer UNION ALL SELECT 'company', count(DISTINCT lower(c_mktsegment)) FROM customer")(lambda s, d: _import(s, d)[0].groupBy("kind").agg(F.count("*").alias("n")))
query("kn_22_import_facts", "SELECT 'c_mktsegment' AS predicate, count(*) AS n, count(DISTINCT c_mktsegment) AS targets FROM customer UNION ALL SELECT 'c_acctbal', count(*), 0 FROM customer")(lambda s, d: _import(s, d)[1].groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("targets")))
query("sc_08_kind_from", "SELECT DISTINCT p_type AS name, CASE WHEN regexp_matches(lower(p_type), '\\bbill\\b') THEN 'invoice' WHEN ends_with(lower(p_type), 'ies') THEN lower(p_type)[:-4] || 'y' ELSE lower(p_type) END AS kind FROM part WHERE NOT regexp_matches(lower(p_type), 'order|item|lead|s$')")(lambda s, d: V.table(s, d, "part").where("not lower(p_type) rlike 'order|item|lead|s$'").select(F.col("p_type").alias("name"), X.kind_from("p_type").alias("kind")).distinct())
query("sm_02_recovery", with_(ITEMS, body="SELECT CASE WHEN status = 'failed' AND attempts < 3 THEN 'stored' WHEN status = 'analyzing' AND attempts < 3 THEN 'stored' WHEN status = 'analyzing' THEN 'failed' ELSE status END AS status, count(*) AS n FROM items GROUP BY 1"))(lambda s, d: _recovered(s, d))


def _recovered(s, d):
    from ..streaming.queue import recovered

    return recovered(V.items(s, d), F.lit("2025-01-01").cast("timestamp_ntz")).groupBy("status").agg(F.count("*").alias("n"))


query("flt_19_superseded_left_out", with_(FACTS, body="SELECT count(*) AS n FROM facts WHERE valid_to IS NULL"))(lambda s, d: current(V.facts(s, d)).agg(F.count("*").alias("n")))
