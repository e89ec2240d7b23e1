"""Queries: search as a whole with both vector legs, passages by page, futures of reviews, and a consolidation pass."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import answer as A
from ..operators import consolidate as C
from ..operators import futures as U
from ..operators import search as S
from ..operators.storage import shared_folder
from ..registry import query
from ..vault import adapter as V
from ..vault.oracle import ENTITIES, FACTS, PASSAGES, with_
from .analytics import VALUE
from .graph import ADJ, EDGES
from .search import LINK, TERMS, _hits, _Q, _vector
from .vault import _PAIRS

# chunks: a text is one block here, cut again and again at the last sentence end past 40 % of the window
_LAST = "greatest({})".format(", ".join(f"CASE WHEN contains(w, {m}) THEN length(w) - instr(reverse(w), reverse({m})) - {n} + 1 ELSE -1 END" for m, n in (("'. '", 2), ("'! '", 2), ("'? '", 2), ("chr(10)", 1))))
_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _chunks_sql(blocks: str, keys: str) -> str:
    """SQL for the chunks of blocks (keys, block)."""
    return rf"""
WITH RECURSIVE blocks AS ({blocks}),
cut AS (
  SELECT {keys}, 0 AS n, NULL::VARCHAR AS piece, trim(regexp_replace(block, '[ \t]+', ' ', 'g'), {_WS}) AS rest FROM blocks
  UNION ALL SELECT {keys}, n + 1, trim(substr(rest, 1, upto), {_WS}), CASE WHEN upto < length(rest) THEN substr(rest, upto + 1) END
  FROM (SELECT *, CASE WHEN length(rest) <= 1200 THEN length(rest) WHEN last > 480 THEN last + 1 ELSE 1200 END AS upto FROM (SELECT *, {_LAST} AS last FROM (SELECT *, substr(rest, 1, 1200) AS w FROM cut WHERE rest IS NOT NULL)))
)"""


query("se_15_chunks", _chunks_sql("SELECT doc_id, coalesce(text, '') AS block FROM documents", "doc_id") + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS seq, length(piece) AS n, sha256(piece) AS sha FROM cut WHERE piece <> ''")(
    lambda s, d: S.chunked(V.table(s, d, "documents")).select("doc_id", "seq", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))
)


def _paged(s, d):
    """Documents whose lines are their pages."""
    lines = F.split("text", "\n", -1)
    docs = V.table(s, d, "documents").select("doc_id", "text", F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("page"), x.alias("text"))).alias("pages"))
    return S.chunked(docs, pages_col="pages").select("doc_id", "seq", "page", F.sha2("text", 256).alias("sha"))


query("se_15_pages", _chunks_sql("SELECT doc_id, i AS page, lines[i] AS block FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))", "doc_id, page") + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, n) - 1 AS seq, page, sha256(piece) AS sha FROM cut WHERE piece <> ''")(_paged)


def _linked(terms: list[str]) -> str:
    """SQL for the entities that a query names, as ``start``, and the keyword hits ``k``."""
    return f"""
, x AS (SELECT n.*, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9à-öø-ÿ]+'), lambda t: t <> '') AS tok, split_part(id, ':', 2) AS key FROM n),
y AS (SELECT *, len(list_filter(tok, lambda t: len(list_filter({terms!r}, lambda q: t = q OR (length(q) >= 3 AND starts_with(t, q)) OR (length(t) >= 3 AND starts_with(q, t)))) > 0)) AS m, len(list_filter({terms!r}, lambda q: key = q OR (contains(key, q) AND length(q) >= 4))) > 0 AS kh FROM x),
start AS (SELECT id FROM (SELECT *, CASE WHEN m = 0 AND NOT kh THEN 0 ELSE CASE WHEN len(tok) > 0 THEN m / len(tok) ELSE 0 END + CAST(kh AS INTEGER) END AS score FROM y) WHERE score >= 0.5 ORDER BY score DESC, edges DESC, label, id LIMIT 5),
t AS (SELECT id, unnest({_hits("lower(label || ' ' || kind || ' external_id ' || split_part(id, ':', 2))", terms)}) AS term FROM entities
 UNION SELECT f.subject_id, unnest({_hits(f"lower(predicate || ' ' || {VALUE})", terms)}) FROM facts f LEFT JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL),
ks AS (SELECT id, label, score FROM (SELECT id, count(DISTINCT term) AS score FROM t GROUP BY 1) JOIN entities USING (id))"""


_EXPANDED = f""",
near AS (SELECT b AS id FROM (SELECT b, sum(weight) AS tie FROM adj WHERE a IN (SELECT id FROM seeds) AND b NOT IN (SELECT id FROM seeds) GROUP BY 1) JOIN n ON n.id = b ORDER BY tie DESC, edges DESC, n.id LIMIT 8),
chosen AS (SELECT DISTINCT id, 10 AS score FROM seeds UNION ALL SELECT id, 4 FROM near),
r AS (SELECT f.*, e.label AS sl, c.score, coalesce(f.object_id IN (SELECT id FROM seeds), false) AS matched FROM facts f JOIN entities e ON e.id = f.subject_id JOIN chosen c ON c.id = f.subject_id WHERE valid_to IS NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY matched DESC, confidence DESC, id) AS rank FROM r),
g AS (SELECT f.subject_id AS id, f.sl AS label, score, predicate, {VALUE} AS value, rank FROM q f LEFT JOIN entities o ON o.id = f.object_id WHERE rank <= 12)"""

query("se_18_context", with_(ENTITIES, FACTS, ADJ, EDGES, body=_linked(LINK) + ", seeds AS (SELECT id FROM start UNION ALL SELECT id FROM (SELECT * FROM ks ORDER BY score DESC, label, id LIMIT 6) WHERE NOT EXISTS (SELECT 1 FROM start))" + _EXPANDED + """
SELECT row_number() OVER (ORDER BY score DESC, label, id) AS ord, '◆ ' || label || ' (' || kind || ')' || chr(10) || lines AS line FROM (
  SELECT g.id, g.label, score, kind, string_agg('  - ' || replace(predicate, '_', ' ') || ': ' || value, chr(10) ORDER BY rank) AS lines FROM g JOIN entities USING (id) GROUP BY 1, 2, 3, 4)"""))(
    lambda s, d: A.context(V.facts(s, d), V.entities(s, d), LINK)
)


def _evidence_sql(terms: list[str], vectors: bool) -> str:
    ann = f"SELECT id FROM (SELECT 'document:' || vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) AS sim FROM embeddings ORDER BY sim DESC, id LIMIT 4) WHERE sim >= 0.35" if vectors else "SELECT NULL AS id WHERE false"
    near = f"SELECT entity_id, seq, sim AS score FROM (SELECT 'document:' || vec_id AS entity_id, 0 AS seq, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) AS sim FROM embeddings WHERE 'document:' || vec_id IN (SELECT id FROM g) ORDER BY sim DESC, entity_id LIMIT 18) WHERE sim >= 0.2" if vectors else "SELECT NULL AS entity_id, 0 AS seq, 0.0 AS score WHERE false"
    h = lambda x: _hits(x, terms)
    return with_(ENTITIES, FACTS, PASSAGES, ADJ, EDGES, body=_linked(terms) + f", ann AS ({ann}), seeds AS (SELECT id FROM start UNION SELECT id FROM ann)" + _EXPANDED + f""",
k AS (SELECT * FROM ks ORDER BY score DESC, label, id LIMIT 20),
b AS (SELECT id, score, 'keyword' AS leg FROM k UNION ALL SELECT DISTINCT id, score, 'graph' FROM g),
m AS (SELECT id, label, kind, row_number() OVER (ORDER BY score DESC, label, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, leg DESC) AS nth FROM b) JOIN entities USING (id) WHERE nth = 1),
said AS (SELECT id, string_agg(replace(predicate, '_', ' ') || ' ' || value, ' · ' ORDER BY rank, predicate) AS said FROM (SELECT DISTINCT id, predicate, value, rank FROM g) GROUP BY 1),
el AS (SELECT 0 AS leg, rank, 'entity' AS type, label, 'Known ' || kind || ' "' || label || '"' || coalesce(': ' || said, '') AS line, id AS entity_id, NULL AS dataset FROM m LEFT JOIN said USING (id) WHERE rank <= 8),
rl AS (SELECT 1 AS leg, row_number() OVER (ORDER BY score DESC, id) AS rank, 'row' AS type, 'Customers — ' || c_name AS label, 'Row in table "Customers": Name=' || c_name || ' · Segment=' || c_mktsegment AS line, NULL AS entity_id, 'Customers' AS dataset
  FROM (SELECT c_custkey AS id, c_name, c_mktsegment, len(list_distinct(list_concat({h("lower('Name ' || c_name)")}, {h("lower('Segment ' || c_mktsegment)")}, {h("'customers'")}))) AS score FROM customer) WHERE score > 0),
words AS (SELECT entity_id, seq, CAST(len({h('lower(text)')}) AS DOUBLE) AS score FROM passages WHERE len({h('lower(text)')}) > 0 AND entity_id IN (SELECT id FROM g)),
sums AS (SELECT entity_id, seq, sum(score) AS score FROM (SELECT * FROM words UNION ALL {near}) JOIN passages USING (entity_id, seq) GROUP BY 1, 2),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, seq) AS nth FROM sums) WHERE nth <= 2),
pl AS (SELECT 2 AS leg, row_number() OVER (ORDER BY score DESC, entity_id, seq) AS rank, 'passage' AS type, label || ' · p.' || (seq + 1) AS label, 'Passage from document "' || label || '" (page ' || (seq + 1) || '): "' || CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END || '"' AS line, entity_id, NULL AS dataset
  FROM few JOIN passages USING (entity_id, seq) JOIN entities e ON e.id = entity_id),
every AS (SELECT * FROM el UNION ALL SELECT * FROM rl WHERE rank <= 8 UNION ALL SELECT * FROM pl WHERE rank <= 5)
SELECT n, type, label, '[' || n || '] ' || line AS line, entity_id, dataset FROM (SELECT *, row_number() OVER (ORDER BY leg, rank) AS n FROM every)""")


def _search(s, d, terms, vectors):
    customers = V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("data"))
    passages = V.passages(s, d).withColumn("page", (F.col("seq") + 1).cast("int"))
    more = {}
    if vectors:
        e = V.table(s, d, "embeddings").select(V.key("document", "vec_id").alias("id"), F.lit("m").alias("model"), "embedding")
        more = {"entity_vectors": e, "passage_vectors": e.select(F.col("id").alias("entity_id"), F.lit(0).alias("seq"), "model", "embedding"), "vector": _vector(s, d), "model": "m"}
    return A.search(V.facts(s, d), V.entities(s, d), passages, terms, customers, {"name": "Name", "segment": "Segment"}, "Customers", answer=True, **more).evidence


NAMED = ["doc", "7", "the"]
query("se_16_search_answer", _evidence_sql(TERMS, False))(lambda s, d: _search(s, d, TERMS, False))
query("se_16_answer_by_vectors", _evidence_sql(NAMED, True))(lambda s, d: _search(s, d, NAMED, True))


def _merge_reviews(s, d):
    """Every part may be the next one."""
    p = V.table(s, d, "part")
    none = F.lit(None).cast("string")
    detail = F.create_map().cast("map<string,string>").alias("detail")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("entity_merge").alias("kind"), F.lit("pending").alias("status"), V.key("part", "p_partkey").alias("source_id"), F.concat(F.lit("part:"), (F.col("p_partkey") + 1).cast("string")).alias("target_id"), none.alias("old_fact_id"), none.alias("new_fact_id"), F.lit(None).cast("array<string>").alias("entity_ids"), detail)


query("gr_10_merge_futures", with_(ENTITIES, FACTS, body="""
, e AS (SELECT id, subject_id AS a, object_id AS b, predicate FROM facts WHERE valid_to IS NULL AND object_id IS NOT NULL),
r AS (SELECT p_partkey::VARCHAR AS review_id, 'part:' || p_partkey AS s, 'part:' || (p_partkey + 1) AS t FROM part),
ends AS (SELECT review_id, 'accept' AS future, t, e.id, predicate, CASE WHEN a = s THEN t ELSE a END AS a, CASE WHEN b = s THEN t ELSE b END AS b FROM r JOIN e ON a IN (s, t) UNION
 SELECT review_id, 'accept', t, e.id, predicate, CASE WHEN a = s THEN t ELSE a END, CASE WHEN b = s THEN t ELSE b END FROM r JOIN e ON b IN (s, t) UNION
 SELECT review_id, 'refuse', t, e.id, predicate, a, b FROM r JOIN e ON a = t UNION SELECT review_id, 'refuse', t, e.id, predicate, a, b FROM r JOIN e ON b = t),
sides AS (SELECT review_id, future, id AS fact, predicate, b AS other, false AS back FROM ends WHERE a = t AND b <> t UNION ALL SELECT review_id, future, id, predicate, a, true FROM ends WHERE b = t AND a <> t),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, future, other ORDER BY back, fact, predicate) AS nth FROM sides) WHERE nth = 1),
tops AS (SELECT *, row_number() OVER (PARTITION BY review_id, future ORDER BY back, fact, predicate) AS place FROM firsts)
SELECT review_id, future, place, predicate, other AS id, label, NOT back AS outgoing FROM tops JOIN entities e ON e.id = other WHERE place <= 5"""))(
    lambda s, d: U.preview(_merge_reviews(s, d), V.facts(s, d), V.entities(s, d), F.lit("2024-01-01").cast("timestamp_ntz"))
)


def _pass(s, d):
    """One pass without budgets over the parts, whose names repeat (their numbers, which are keys, left out)."""
    parts = V.entities(s, d).where("kind = 'part'").withColumn("natural_keys", F.create_map().cast("map<string,string>")).withColumn("has_body", F.lit(False)).withColumn("last_used_at", F.lit(None).cast("timestamp_ntz"))
    none = lambda schema: s.createDataFrame([], schema)
    vault = C.Vault(
        V.facts(s, d), parts, none("id string, model string, embedding array<double>"), none("source_id string, target_id string"), none("kind string, word string, canonical string, role string"),
        parts.select(F.col("kind").alias("name")).distinct(), none("event_id string, agent_id string, verdict string, terms array<string>, embedding array<double>, created_at timestamp_ntz"),
    )
    job = C.Consolidation(s, f"{shared_folder(s)}/pass-{uuid4().hex}", "m1", budget=C.Budget(*[None] * 8), label_floor=0.75)
    job.run(vault, F.lit("2024-01-01").cast("timestamp_ntz"))
    return job.read("decide").select("source_id", "target_id", rounded("sim", 6).alias("sim"), rounded("confidence", 6).alias("confidence"), "status")


query("kn_12_pass", with_(ENTITIES, FACTS, EDGES, body="""
, """ + _PAIRS + """,
p AS (SELECT e.id, e.label, e.support, edges FROM entities e JOIN n USING (id) WHERE e.kind = 'part'),
cand AS (SELECT a, b, 1.0 AS sim FROM (SELECT min(id) OVER (PARTITION BY label) AS a, id AS b FROM p) WHERE a <> b UNION ALL SELECT x.id, y.id, sim FROM pr JOIN p x ON x.label = pr.x JOIN p y ON y.label = pr.y WHERE sim >= 0.75),
u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim FROM cand GROUP BY 1, 2)
SELECT CASE WHEN first THEN b ELSE a END AS source_id, CASE WHEN first THEN a ELSE b END AS target_id, floor(sim*1e6+0.5)/1e6 AS sim, floor(least(sim, 0.84)*1e6+0.5)/1e6 AS confidence, 'pending' AS status
FROM (SELECT u.*, (x.edges, x.support) >= (y.edges, y.support) AS first FROM u JOIN p x ON x.id = a JOIN p y ON y.id = b)"""))(_pass)
