"""Queries: the resolution ladder with its vector tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import resolve as R
from ..operators.vector_index import Fit, build
from ..registry import query
from ..vault import adapter as V
from .vault import _TRI

# Benchmark items are known by the head of their text and the vector of their number; they are asked for by the same
# label, by a shorter one, or by one that says nothing, the vector then being all there is.
_HEAD = "trim(substr(text, 1, 60))"
_ASKED = f"CASE item_id % 3 WHEN 0 THEN {_HEAD} WHEN 1 THEN trim(substr(text, 1, 50)) ELSE 'zq' || item_id || 'jx' END"


def _named(s, d):
    items = V.table(s, d, "benchmark").select(F.col("item_id").alias("n"), "item_id", "text")
    near = V.table(s, d, "embeddings").select(F.col("vec_id").alias("n"), "embedding")
    none = F.create_map().cast("map<string,string>")
    made = items.join(near, "n").select(F.col("item_id").cast("string").alias("id"), F.lit("item").alias("kind"), F.expr(_HEAD).alias("label"), F.expr(_ASKED).alias("asked"), F.lit("m1").alias("model"), "embedding", none.alias("natural_keys"), F.lit(None).cast("string").alias("merged_into"))
    wanted = made.select(F.concat(F.lit("w"), "id").alias("wanted_id"), "kind", F.col("asked").alias("label"), "natural_keys", "model", "embedding")
    return wanted, made


_SQL = f"""
WITH e AS (SELECT item_id::VARCHAR AS id, {_HEAD} AS label, {_ASKED} AS asked, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
x AS (SELECT id, label, asked, CAST(embedding AS DOUBLE[]) AS v FROM e),
grams AS (SELECT said, {_TRI.format(c='said')} AS g FROM (SELECT label AS said FROM x UNION SELECT asked FROM x)),
sims AS (SELECT w.id AS wid, c.id, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS sim FROM x w JOIN grams a ON a.said = w.asked CROSS JOIN x c JOIN grams b ON b.said = c.label),
blocked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY sim DESC, id) AS r FROM sims WHERE sim >= 0.25) WHERE r <= 10),
few AS (SELECT x.id AS wid FROM x LEFT JOIN blocked ON wid = x.id GROUP BY 1 HAVING count(*) FILTER (sim >= 0.3) < 5 AND coalesce(max(sim), 0) < 0.92),
near AS (SELECT * FROM (SELECT w.id AS wid, c.id, list_cosine_similarity(w.v, c.v) AS sim, row_number() OVER (PARTITION BY w.id ORDER BY list_cosine_similarity(w.v, c.v) DESC, c.id) AS r FROM x w JOIN few ON few.wid = w.id CROSS JOIN x c) WHERE r <= 5 AND sim >= {{near}}),
both_ AS (SELECT wid, id, sim, 'label' AS via FROM blocked UNION ALL SELECT wid, id, sim, 'vector' FROM near WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.wid = near.wid AND b.id = near.id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY round(sim, 9) DESC, id)::INTEGER AS place FROM both_)"""


def _index(entities):
    return build(entities.select("id", "kind", "model", "embedding"), Fit(cells=16))


def _candidates(s, d):
    wanted, entities = _named(s, d)
    return R.candidates(wanted, entities, _index(entities), near=0.3, exact=True).withColumn("sim", rounded("sim", 6))


def _resolved(s, d):
    wanted, entities = _named(s, d)
    return R.resolve(wanted, entities, index=_index(entities), exact=True)


query("kn_02_candidates", _SQL.replace("{near}", "0.3") + " SELECT 'w' || wid AS wanted_id, id, floor(sim*1e6+0.5)/1e6 AS sim, via, place FROM placed WHERE place <= 3")(_candidates)
query("kn_02_resolved", _SQL.replace("{near}", "0.5") + """,
same AS (SELECT w.id AS wid, min(c.id) AS id FROM x w JOIN x c ON trim(regexp_replace(lower(w.asked), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(c.label), '[^a-z0-9]+', ' ', 'g')) GROUP BY 1)
SELECT 'w' || x.id AS wanted_id,
  CASE WHEN same.id IS NOT NULL THEN 'exact' WHEN p.id IS NULL THEN 'none' WHEN via = 'label' AND sim >= 0.92 THEN 'label' WHEN via = 'label' THEN 'adjudicated' ELSE 'recalled' END AS tier,
  CASE WHEN same.id IS NOT NULL THEN same.id WHEN sim >= 0.75 THEN p.id END AS id,
  CASE WHEN same.id IS NOT NULL OR (via = 'label' AND sim >= 0.92) THEN 'merge' WHEN sim >= 0.75 THEN 'propose' ELSE 'new' END AS decision
FROM x LEFT JOIN same ON same.wid = x.id LEFT JOIN placed p ON p.wid = x.id AND place = 1""")(_resolved)
