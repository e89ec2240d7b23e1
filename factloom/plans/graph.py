"""Queries: graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.facts import adjacency
from ..registry import query
from ..vault import adapter as V
from ..vault.oracle import ENTITIES, FACTS, with_
from .analytics import VALUE

ADJ = "adj AS (SELECT a, b, count(*) AS weight FROM (SELECT subject_id AS a, object_id AS b FROM facts WHERE valid_to IS NULL AND object_id IS NOT NULL AND subject_id <> object_id UNION ALL SELECT object_id, subject_id FROM facts WHERE valid_to IS NULL AND object_id IS NOT NULL AND subject_id <> object_id) GROUP BY 1, 2)"
EDGES = "n AS (SELECT e.id, e.kind, e.label, count(x.id) AS edges FROM entities e LEFT JOIN (SELECT subject_id AS id FROM facts WHERE valid_to IS NULL UNION ALL SELECT object_id FROM facts WHERE valid_to IS NULL AND object_id IS NOT NULL) x USING (id) GROUP BY 1, 2, 3)"
# a small world: locations only, so that levels stay few and rings full
WORLD = "located_in", "part_of", "billed_to"
_WORLD_FACTS = FACTS.replace("facts AS (", "all_facts AS (", 1) + ",\nfacts AS (SELECT * FROM all_facts WHERE predicate IN ('located_in', 'part_of', 'billed_to'))"


def world(s, d):
    return V.facts(s, d).where(F.col("predicate").isin(*WORLD))


query("gr_01_adjacency", with_(ENTITIES, FACTS, ADJ, body="SELECT * FROM adj"))(lambda s, d: adjacency(V.facts(s, d)))
query("gr_07_vault_nodes", with_(ENTITIES, FACTS, ADJ, body="SELECT e.id, kind, label, count(b) AS degree FROM entities e LEFT JOIN adj ON a = e.id GROUP BY 1, 2, 3"))(lambda s, d: G.vault_nodes(V.entities(s, d), V.facts(s, d)))
query("gr_07_vault_edges", with_(FACTS, body="SELECT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, count(*) AS weight, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates FROM facts WHERE valid_to IS NULL AND object_id IS NOT NULL AND subject_id <> object_id GROUP BY 1, 2"))(lambda s, d: G.vault_edges(V.facts(s, d)))

query("gr_02_ego", with_(ENTITIES, _WORLD_FACTS, ADJ, EDGES, body="""
, one AS (SELECT n.id, row_number() OVER (ORDER BY edges DESC, label, n.id) AS rank FROM adj JOIN n ON n.id = adj.b WHERE a = 'nation:3' ORDER BY rank LIMIT 14),
two AS (SELECT b AS id, arg_min(a, one.rank) AS parent FROM adj JOIN one ON one.id = adj.a WHERE b <> 'nation:3' AND b NOT IN (SELECT id FROM one) GROUP BY 1),
ranked AS (SELECT two.id, parent, row_number() OVER (ORDER BY edges DESC, label, two.id) AS rank FROM two JOIN n ON n.id = two.id ORDER BY rank LIMIT 18)
SELECT 'nation:3' AS id, 0 AS hop, 0 AS rank, NULL AS parent UNION ALL SELECT id, 1, rank, 'nation:3' FROM one UNION ALL SELECT id, 2, rank, parent FROM ranked"""))(lambda s, d: G.ego(V.entities(s, d), world(s, d), "nation:3"))
query("gr_03_clustered_ring", with_(ENTITIES, _WORLD_FACTS, ADJ, EDGES, body="""
, r AS (SELECT n.*, row_number() OVER (PARTITION BY kind ORDER BY edges DESC, label, n.id) AS k FROM adj JOIN n ON n.id = b WHERE a = 'nation:3'),
heads AS (SELECT id, kind FROM r WHERE k <= 3 ORDER BY edges DESC, label, id LIMIT 14),
rest AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM heads)),
tails AS (SELECT kind, count(*) AS count, min(id) AS one, min((-edges, label, id)) AS first FROM rest GROUP BY 1),
lone AS (SELECT *, row_number() OVER (ORDER BY first) AS nth FROM tails WHERE count = 1 QUALIFY nth <= 14 - (SELECT count(*) FROM heads)),
ties AS (SELECT kind, predicate, count(*) AS n FROM (SELECT CASE WHEN subject_id = 'nation:3' THEN object_id ELSE subject_id END AS id, predicate FROM facts WHERE valid_to IS NULL AND (subject_id = 'nation:3' OR object_id = 'nation:3')) JOIN rest USING (id) GROUP BY 1, 2)
SELECT kind, id AS member, 1 AS count, NULL AS predicate FROM heads UNION ALL SELECT kind, one, 1, NULL FROM lone
UNION ALL SELECT kind, NULL, count, (SELECT predicate FROM ties t WHERE t.kind = x.kind ORDER BY n DESC, predicate LIMIT 1) FROM tails x WHERE kind NOT IN (SELECT kind FROM lone)"""))(lambda s, d: G.clustered_ring(V.entities(s, d), world(s, d), "nation:3"))
query("gr_04_breadth_first", with_(_WORLD_FACTS, ADJ, body="""
, l0 AS (SELECT 'region:1' AS id), l1 AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (FROM l0) EXCEPT FROM l0),
l2 AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (FROM l1) EXCEPT FROM l0 EXCEPT FROM l1), l3 AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (FROM l2) EXCEPT FROM l1 EXCEPT FROM l2),
l4 AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (FROM l3) EXCEPT FROM l2 EXCEPT FROM l3)
SELECT id, 0 AS depth FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3 UNION ALL SELECT id, 4 FROM l4"""))(lambda s, d: G.breadth_first(world(s, d).where("predicate <> 'x'"), "region:1"))
query("gr_04_layered_fold", with_(ENTITIES, _WORLD_FACTS.replace("'located_in', 'part_of', 'billed_to'", "'located_in', 'part_of'"), ADJ, EDGES, body="""
, l0 AS (SELECT 'region:1' AS id, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, [CAST(1 AS BIGINT)] AS place, true AS shown),
c1 AS (SELECT b AS id, min((place, l0.id)) AS p FROM adj JOIN l0 ON l0.id = a WHERE b NOT IN (SELECT id FROM l0) GROUP BY 1),
r1 AS (SELECT c1.id, p, row_number() OVER (PARTITION BY p ORDER BY edges DESC, label, c1.id) AS k, count(*) OVER (PARTITION BY p) AS m FROM c1 JOIN n ON n.id = c1.id),
l1 AS (SELECT id, 1 AS depth, p[2] AS parent, list_append(p[1], k) AS place, k <= 7 OR m = 8 AS shown FROM r1),
c2 AS (SELECT b AS id, min((place, l1.id)) AS p FROM adj JOIN l1 ON l1.id = a WHERE b NOT IN (SELECT id FROM l0) AND b NOT IN (SELECT id FROM l1) GROUP BY 1),
r2 AS (SELECT c2.id, p, row_number() OVER (PARTITION BY p ORDER BY edges DESC, label, c2.id) AS k, count(*) OVER (PARTITION BY p) AS m FROM c2 JOIN n ON n.id = c2.id),
l2 AS (SELECT id, 2 AS depth, p[2] AS parent, list_append(p[1], k) AS place, k <= 7 OR m = 8 AS shown FROM r2)
SELECT id, depth, parent, shown FROM l0 UNION ALL SELECT id, depth, parent, shown FROM l1 UNION ALL SELECT id, depth, parent, shown FROM l2"""))(lambda s, d: G.layered(V.entities(s, d), world(s, d).where("predicate <> 'billed_to'"), "region:1"))
query("gr_08_dataset_nodes", "SELECT 'node' AS what, 'dataset:segment ' || c_mktsegment AS a, CAST(NULL AS VARCHAR) AS b, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'contains', 'dataset:segment ' || c_mktsegment, 'customer:' || c_custkey, 1 FROM customer")(
    lambda s, d: G.dataset_nodes(V.table(s, d, "customer").select(F.concat(F.lit("segment "), "c_mktsegment").alias("dataset"), V.key("customer", "c_custkey").alias("entity_id")))
)
query("gr_11_sources_with_body", with_(ENTITIES, _WORLD_FACTS, ADJ, EDGES, body="SELECT n.id, label, edges FROM n JOIN adj ON adj.a = 'nation:3' AND adj.b = n.id WHERE n.kind = 'customer' ORDER BY edges DESC, label, n.id LIMIT 8"))(
    lambda s, d: G.sources_with_body(V.entities(s, d), world(s, d), "nation:3", V.entities(s, d).where("kind = 'customer'").select("id"))
)
query("gr_13_node_resolver", with_(ENTITIES, body="SELECT lower(trim(label)) AS name, arg_min(id, (created_at, id)) AS id FROM entities GROUP BY 1"))(lambda s, d: G.node_resolver(V.entities(s, d)))
query("gr_14_schema_graph", with_(ENTITIES, FACTS, body="SELECT e.kind AS subject_kind, predicate, o.kind AS object_kind, count(*) AS count FROM facts f JOIN entities e ON e.id = subject_id JOIN entities o ON o.id = object_id WHERE valid_to IS NULL AND o.kind <> e.kind GROUP BY 1, 2, 3"))(lambda s, d: G.schema_graph(V.facts(s, d), V.entities(s, d)))
query("gr_12_dossier", with_(ENTITIES, FACTS, ADJ, body=f"""
, x AS (SELECT f.*, e.label AS subject_label, f.subject_id = 'user:3' AS own, {VALUE} AS value FROM facts f JOIN entities e ON e.id = f.subject_id LEFT JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL AND (f.subject_id = 'user:3' OR f.subject_id IN (SELECT b FROM adj WHERE a = 'user:3'))),
y AS (SELECT *, row_number() OVER (ORDER BY own DESC, subject_label, predicate, id) AS ord FROM x QUALIFY ord <= 500),
c AS (SELECT source_item_id, dense_rank() OVER (ORDER BY min(ord)) AS citation FROM y WHERE source_item_id IS NOT NULL GROUP BY 1)
SELECT ord, subject_label, predicate, value, citation FROM y LEFT JOIN c USING (source_item_id)"""))(lambda s, d: G.dossier(V.entities(s, d), V.facts(s, d), "user:3"))
query("so_05_entities_by_edges", with_(ENTITIES, FACTS, EDGES, body="SELECT * FROM n ORDER BY edges DESC, label, id LIMIT 100"))(lambda s, d: G.with_edges(V.entities(s, d), V.facts(s, d)).orderBy(F.desc("edges"), "label", "id").limit(100).select("id", "kind", "label", "edges"))
