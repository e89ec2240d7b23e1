"""Queries: search, retrieval, routing and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import graph as G
from ..operators import search as S
from ..operators.facts import live
from ..registry import query
from ..vault import adapter as V
from ..vault.oracle import ENTITIES, FACTS, PASSAGES, VECTORS, with_
from .analytics import VALUE
from .graph import ADJ, EDGES

TERMS = ["building", "3", "nation_1"]


def _hits(hay: str, terms=TERMS) -> str:
    return f"list_filter([{', '.join(repr(t) for t in terms)}], lambda t: contains({hay}, t))"


query("se_01_search_rows", f"SELECT id, score FROM (SELECT c_custkey AS id, len(list_distinct(list_concat({_hits("lower('Name ' || c_name)")}, {_hits("lower('Segment ' || c_mktsegment)")}, {_hits("'customers'")}))) AS score FROM customer) WHERE score > 0 ORDER BY score DESC, id LIMIT 40")(
    lambda s, d: S.search_rows(V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("data")), TERMS, {"name": "Name", "segment": "Segment"}, "Customers").select("id", F.col("score").cast("bigint").alias("score"))
)
query("se_02_search_entities", with_(ENTITIES, FACTS, body=f"""
, t AS (SELECT id, unnest({_hits("lower(label || ' ' || kind || ' external_id ' || split_part(id, ':', 2))")}) AS term FROM entities
 UNION SELECT f.subject_id, unnest({_hits(f"lower(predicate || ' ' || {VALUE})")}) FROM facts f LEFT JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL)
SELECT id, label, score FROM (SELECT id, count(DISTINCT term) AS score FROM t GROUP BY 1) JOIN entities USING (id) ORDER BY score DESC, label, id LIMIT 20"""))(lambda s, d: S.search_entities(V.facts(s, d), V.entities(s, d), TERMS))

WORDS = ["the", "ering", "das"]
query("se_03_keyword_passages", with_(PASSAGES, body=f"SELECT entity_id, seq, CAST(len({_hits('lower(text)', WORDS)}) AS DOUBLE) AS score FROM passages WHERE len({_hits('lower(text)', WORDS)}) > 0"))(lambda s, d: S.keyword_passages(V.passages(s, d), WORDS).select("entity_id", F.col("seq").cast("bigint").alias("seq"), "score"))

_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)"


def _vector(s, d, i=7):
    return list(V.table(s, d, "embeddings").where(F.col("vec_id") == i).first()["embedding"])


query("so_06_top_vectors", with_(VECTORS, body=f"SELECT id, floor(sim*1e6+0.5)/1e6 AS sim FROM (SELECT id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) AS sim FROM vectors WHERE model = 'm1' ORDER BY sim DESC, id LIMIT 12) WHERE sim >= 0.35"))(
    lambda s, d: S.top_vectors(V.vectors(s, d), _vector(s, d), "m1", 12, 0.35).select("id", N.rounded("sim", 6).alias("sim"))
)


def _semantic(s, d):
    top = S.top_vectors(V.vectors(s, d), _vector(s, d), "m1", 18, 0.2)
    return top.select(F.concat(F.lit("document:"), (F.col("vec_id") % 50).cast("string")).alias("entity_id"), F.lit(0).alias("seq"), N.rounded("sim", 6).alias("score"), F.lit("").alias("text"))


query("se_05_merged_passages", with_(PASSAGES, VECTORS, body=f"""
, k AS (SELECT entity_id, seq, CAST(len({_hits('lower(text)', WORDS)}) AS DOUBLE) AS score, text FROM passages WHERE len({_hits('lower(text)', WORDS)}) > 0),
sem AS (SELECT 'document:' || (vec_id % 50) AS entity_id, 0 AS seq, floor(sim*1e6+0.5)/1e6 AS score, '' AS text FROM (SELECT vec_id, id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) AS sim FROM vectors WHERE model = 'm1' ORDER BY sim DESC, id LIMIT 18) WHERE sim >= 0.2),
b AS (SELECT entity_id, seq, floor(sum(score)*1e6+0.5)/1e6 AS score, max(text) AS text FROM (SELECT * FROM k UNION ALL SELECT * FROM sem) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, seq) AS n FROM b)
SELECT entity_id, seq, score, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS text FROM r WHERE n <= 2 ORDER BY score DESC, entity_id, seq LIMIT 6"""))(
    lambda s, d: S.merge_passages(S.keyword_passages(V.passages(s, d), WORDS).select("entity_id", "seq", "score", "text"), _semantic(s, d)).withColumn("score", N.rounded("score", 6)).withColumn("seq", F.col("seq").cast("bigint"))
)
LINK = ["customer", "000000007", "nation", "ord"]
query("se_06_link_entities", with_(ENTITIES, FACTS, EDGES, body=f"""
, x AS (SELECT n.*, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9à-öø-ÿ]+'), lambda t: t <> '') AS tok, split_part(id, ':', 2) AS key FROM n),
y AS (SELECT *, len(list_filter(tok, lambda t: len(list_filter({LINK!r}, lambda q: t = q OR (length(q) >= 3 AND starts_with(t, q)) OR (length(t) >= 3 AND starts_with(q, t)))) > 0)) AS m, len(list_filter({LINK!r}, lambda q: key = q OR (contains(key, q) AND length(q) >= 4))) > 0 AS kh FROM x)
SELECT id, label, CASE WHEN m = 0 AND NOT kh THEN 0 ELSE CASE WHEN len(tok) > 0 THEN m / len(tok) ELSE 0 END + CAST(kh AS INTEGER) END AS score FROM y WHERE score >= 0.5 ORDER BY score DESC, edges DESC, label, id LIMIT 5"""))(
    lambda s, d: S.link_entities(G.with_edges(V.entities(s, d), V.facts(s, d)), LINK)
)
query("se_07_expand_seeds", with_(ENTITIES, FACTS, ADJ, EDGES, body=f"""
, seeds AS (SELECT 'customer:1' AS id UNION ALL SELECT 'customer:2'),
near AS (SELECT b AS id FROM (SELECT b, sum(weight) AS tie FROM adj WHERE a IN (FROM seeds) AND b NOT IN (FROM seeds) GROUP BY 1) t JOIN n ON n.id = t.b ORDER BY tie DESC, edges DESC, n.id LIMIT 8),
chosen AS (SELECT id, 10 AS score FROM seeds UNION ALL SELECT id, 4 FROM near),
r AS (SELECT f.*, e.label AS sl, o.label AS ol, c.score, coalesce(f.object_id IN (FROM seeds), false) AS matched FROM facts f JOIN entities e ON e.id = f.subject_id JOIN chosen c ON c.id = f.subject_id LEFT JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY matched DESC, confidence DESC, id) AS rank FROM r)
SELECT f.subject_id AS id, f.sl AS label, score, predicate, {VALUE} AS value, matched, rank FROM q f LEFT JOIN entities o ON o.id = f.object_id WHERE rank <= 12"""))(
    lambda s, d: S.expand(V.facts(s, d), G.with_edges(V.entities(s, d), V.facts(s, d)), s.createDataFrame([("customer:1",), ("customer:2",)], "id string"))
)
query("se_08_merge_hits", with_(ENTITIES, FACTS, ADJ, EDGES, body=f"""
, t AS (SELECT id, unnest({_hits("lower(label || ' ' || kind || ' external_id ' || split_part(id, ':', 2))")}) AS term FROM entities
 UNION SELECT f.subject_id, unnest({_hits(f"lower(predicate || ' ' || {VALUE})")}) FROM facts f LEFT JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL),
k AS (SELECT id, label, score FROM (SELECT id, count(DISTINCT term) AS score FROM t GROUP BY 1) JOIN entities USING (id) ORDER BY score DESC, label, id LIMIT 20),
near AS (SELECT b AS id FROM (SELECT b, sum(weight) AS tie FROM adj WHERE a = 'customer:1' AND b <> 'customer:1' GROUP BY 1) JOIN n ON n.id = b ORDER BY tie DESC, edges DESC, n.id LIMIT 8),
g AS (SELECT DISTINCT f.subject_id AS id, CASE WHEN f.subject_id = 'customer:1' THEN 10 ELSE 4 END AS score FROM facts f WHERE valid_to IS NULL AND (f.subject_id = 'customer:1' OR f.subject_id IN (FROM near))),
b AS (SELECT id, score, 'keyword' AS leg FROM k UNION ALL SELECT id, score, 'graph' FROM g)
SELECT id, label, score, leg FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, leg DESC) AS nth FROM b) JOIN entities USING (id) WHERE nth = 1 ORDER BY score DESC, label, id LIMIT 8"""))(
    lambda s, d: S.merge_hits(S.search_entities(V.facts(s, d), V.entities(s, d), TERMS), S.expand(V.facts(s, d), G.with_edges(V.entities(s, d), V.facts(s, d)), s.createDataFrame([("customer:1",)], "id string")))
)
query("jn_21_labels_in_text", r"""WITH l AS (SELECT 'word:' || w AS id, w AS label FROM (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{9,}')) AS w FROM benchmark) WHERE w <> '')
SELECT doc_id AS text_id, id FROM documents JOIN l ON contains(lower(text), label)""")(lambda s, d: S.named_in(V.table(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), _labels(s, d)))


def _labels(s, d):
    """Names to look for in the documents: each benchmark item's first long word."""
    w = V.table(s, d, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]{9,}", 0)).alias("label")).where("label <> ''").distinct()
    return w.select(F.concat(F.lit("word:"), "label").alias("id"), "label")


def _agents(s, d):
    return V.table(s, d, "benchmark").select(F.col("item_id").alias("agent_id"), F.concat(F.lit("agent "), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("purpose"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.PURPOSE_STOP) + "]"
_NT = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9à-öø-ÿ]+'), lambda t: length(t) >= 3 AND NOT list_contains(" + _STOP + ", t)), lambda t: CASE WHEN length(t) > 4 AND regexp_matches(t, '(s|x|z|ch|sh)es$') THEN regexp_replace(t, 'es$', '') WHEN length(t) > 3 AND regexp_matches(t, '[^s]s$') THEN regexp_replace(t, 's$', '') ELSE t END))"
query("se_11_route_messages", f"""
WITH a AS (SELECT item_id AS agent_id, 'agent ' || item_id AS name, text AS purpose FROM benchmark),
t AS (SELECT agent_id, name, unnest({_NT.format("name || ' ' || purpose")}) AS term, {_NT.format("name")} AS own FROM a),
p AS (SELECT agent_id, name, term, CASE WHEN list_contains(own, term) THEN 2.0 ELSE 1.0 END / count(*) OVER (PARTITION BY term) AS weight FROM t),
m AS (SELECT conv_id * 1000 + turn AS message_id, unnest({_NT.format("text")}) AS term FROM conversations),
s AS (SELECT message_id, agent_id, name, floor(sum(weight)*1e6+0.5)/1e6 AS score FROM m JOIN p USING (term) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, name, agent_id) AS n, coalesce(lead(score) OVER (PARTITION BY message_id ORDER BY score DESC, name, agent_id), 0) AS runner_up FROM s)
SELECT message_id, agent_id, score, runner_up FROM r WHERE n = 1 AND score >= 1 AND (runner_up <= 0 OR (score - runner_up >= 0.5 AND score >= runner_up * 1.5))""")(
    lambda s, d: S.route(V.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text"), S.agent_profiles(_agents(s, d))).withColumn("score", N.rounded("score", 6)).withColumn("runner_up", N.rounded("runner_up", 6))
)
_ACK = "[" + ", ".join(f"'{w}'" for w in X.ACKNOWLEDGEMENTS) + "]"
query("flt_18_worth_extracting", f"""SELECT message, worth, count(*) AS n FROM (SELECT length(m) AS message, CASE WHEN m = '' THEN false WHEN length(m) > 80 THEN true WHEN regexp_matches(m, '[0-9€$£%#@?]|https?://|www\\.') THEN true
 WHEN len(tok) = 0 THEN false WHEN len(tok) > 6 THEN true ELSE len(list_filter(tok, lambda t: NOT list_contains({_ACK}, t))) > 0 END AS worth
FROM (SELECT trim(text) AS m, list_filter(regexp_split_to_array(regexp_replace(lower(translate(trim(text), '{X.ACCENTED}', '{X.PLAIN}')), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '') AS tok FROM conversations)) GROUP BY 1, 2""")(
    lambda s, d: V.table(s, d, "conversations").select(F.length(F.trim("text")).cast("bigint").alias("message"), X.worth_extracting("text").alias("worth")).groupBy("message", "worth").agg(F.count("*").alias("n"))
)
query("se_12_chunk_scores", with_(PASSAGES, body=f"""
, c AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS chunks, row_number() OVER (PARTITION BY entity_id ORDER BY seq) - 1 AS i FROM passages)
SELECT entity_id, i AS seq, floor((CASE WHEN chunks > 1 AND i / (chunks - 1) > 0.1 THEN CASE WHEN i / (chunks - 1) >= 0.9 THEN -0.5 ELSE 0 END ELSE 1.5 END + least(2.0, len(regexp_extract_all(text, '[0-9%€$£]')) / greatest(1, length(text)) * 100 * 0.25) + least(3.0, len({_hits('lower(text)', WORDS)}) * 0.5)) * 1e6 + 0.5) / 1e6 AS score FROM c"""))(
    lambda s, d: _chunk_scores(s, d).select("entity_id", F.col("i").cast("bigint").alias("seq"), N.rounded("score", 6).alias("score"))
)


def _chunk_scores(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id")
    c = V.passages(s, d).withColumn("chunks", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("seq")) - 1)
    return c.withColumn("score", S.chunk_score(F.col("text"), F.col("i"), F.col("chunks"), WORDS))


# greedy choice as a fold: the chunks of a document in order, the characters taken so far and the places kept
query("wn_06_budget_selection", with_(PASSAGES, body=f"""
, c AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS chunks, row_number() OVER (PARTITION BY entity_id ORDER BY seq) - 1 AS i FROM passages),
q AS (SELECT entity_id, i, length(text) AS n, i >= 2 AS late, CASE WHEN i < 2 THEN 0 ELSE -(CASE WHEN chunks > 1 AND i / (chunks - 1) > 0.1 THEN CASE WHEN i / (chunks - 1) >= 0.9 THEN -0.5 ELSE 0 END ELSE 1.5 END + least(2.0, len(regexp_extract_all(text, '[0-9%€$£]')) / greatest(1, length(text)) * 100 * 0.25) + least(3.0, len({_hits('lower(text)', WORDS)}) * 0.5)) END AS less FROM c),
o AS (SELECT entity_id, list({{'late': late, 'n': n, 'seqs': [i]}} ORDER BY late, less, i) AS l FROM q GROUP BY 1)
SELECT entity_id AS doc_id, array_to_string(list_sort(list_reduce(list_prepend({{'late': false, 'n': 0, 'seqs': CAST([] AS BIGINT[])}}, l), lambda a, x: CASE WHEN a.n + x.n <= 900 THEN {{'late': false, 'n': a.n + x.n, 'seqs': list_concat(a.seqs, x.seqs)}} ELSE a END).seqs), ',') AS seqs FROM o"""))(lambda s, d: S.select_chunks(_chunk_scores(s, d).select(F.col("entity_id").alias("doc_id"), F.col("i").alias("seq"), "score", "text"), 900).select("doc_id", F.array_join("seqs", ",").alias("seqs")))
query("se_13_prompt_text", with_(PASSAGES, body="""
, c AS (SELECT entity_id AS doc_id, seq, text, row_number() OVER (PARTITION BY entity_id ORDER BY seq) - 1 AS i FROM passages),
g AS (SELECT *, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 1 AS gap FROM c WHERE i % 3 <> 1)
SELECT c.doc_id, coalesce(t, '') AS text, n - coalesce(k, 0) AS dropped FROM (SELECT doc_id, count(*) AS n FROM c GROUP BY 1) c
LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN gap THEN '[… less relevant passages omitted …]' || chr(10) || chr(10) ELSE '' END || '[p.' || i || '] ' || text, chr(10) || chr(10) ORDER BY i) AS t, count(*) AS k FROM g GROUP BY 1) x USING (doc_id)"""))(lambda s, d: _prompts(s, d))


def _prompts(s, d):
    """Every document's lines but each second of three."""
    c = _chunk_scores(s, d).select(F.col("entity_id").alias("doc_id"), F.col("i").alias("seq"), "text", F.col("i").alias("page"))
    return S.prompt_text(c, c.where("seq % 3 <> 1").groupBy("doc_id").agg(F.collect_list("seq").alias("seqs")))


query("se_14_anchors", "SELECT 0 AS leg, 0 AS place, 'We sell parts' AS text UNION ALL SELECT 1, n_nationkey, n_name || ' — ' || 'sells in ' || n_regionkey FROM nation WHERE n_nationkey < 6 UNION ALL SELECT 2, r_regionkey, r_name || ': a region name, key' FROM region WHERE r_regionkey < 8")(
    lambda s, d: S.anchors(" We sell parts ", V.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("place"), F.col("n_name").alias("name"), F.concat(F.lit("sells in "), F.col("n_regionkey").cast("string")).alias("purpose")), V.table(s, d, "region").select(F.col("r_regionkey").cast("int").alias("place"), F.col("r_name").alias("kind"), F.lit("a region").alias("description"), F.array(F.lit("name"), F.lit("key")).alias("words")))
)

_QSTOP = "[" + ", ".join(f"'{w}'" for w in X.QUERY_STOP) + "]"
query("sc_03_tokenize", f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9@._$-]+'), lambda t: length(t) >= 2 AND NOT list_contains({_QSTOP}, t)))) AS n FROM documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", F.size(X.tokenize("text")).cast("bigint").alias("n")))
query("sc_04_normalize_terms", f"SELECT item_id, array_to_string(list_sort({_NT.format('text')}), ' ') AS terms FROM benchmark")(lambda s, d: V.table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(X.normalize_terms("text"))), " ").alias("terms")))
query("sc_05_key_terms", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9%€$]+'), lambda t: length(t) >= 4))), ' ') AS terms FROM benchmark")(lambda s, d: V.table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(X.key_terms("text")), " ").alias("terms")))
query("sc_09_strip_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")(lambda s, d: V.table(s, d, "pages").select("page_id", X.strip_html("html").alias("text")))
query("sc_01_slug_key", "SELECT DISTINCT p_type AS raw, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM part")(lambda s, d: V.table(s, d, "part").select(F.col("p_type").alias("raw"), X.slug_key("p_type").alias("slug")).distinct())
query("sc_02_normalized_key", f"SELECT DISTINCT c_name AS label, trim(regexp_replace(lower(translate(c_name, '{X.ACCENTED}', '{X.PLAIN}')), '[^a-z0-9]+', ' ', 'g')) AS key FROM customer")(lambda s, d: V.table(s, d, "customer").select(F.col("c_name").alias("label"), X.normalized_label("c_name").alias("key")).distinct())
query("sc_32_age_days", "SELECT event_id, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0 * 1e6 + 0.5) / 1e6 AS days FROM events")(lambda s, d: V.table(s, d, "events").select("event_id", N.rounded(N.age_days("ts", F.lit("2024-02-01").cast("timestamp_ntz")), 6).alias("days")))
query("sc_31_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m %b') AS lens, count(*) AS n FROM orders GROUP BY 1, 2")(lambda s, d: V.table(s, d, "orders").groupBy(N.month("o_orderdate").alias("month"), N.month_name("o_orderdate").alias("lens")).agg(F.count("*").alias("n")))
query("sc_65_json_path", "SELECT event_id, props->>'$.k' AS k FROM events")(lambda s, d: V.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")))
query("sc_49_digests", "SELECT item_id, sha256(text) AS sha, md5(text) AS md5 FROM benchmark")(lambda s, d: V.table(s, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha"), F.md5(F.col("text").cast("binary")).alias("md5")))
query("sc_40_round2", "SELECT o_custkey AS k, floor(avg(o_totalprice)*100+0.5)/100 AS v FROM orders GROUP BY 1")(lambda s, d: V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(N.round2(F.avg("o_totalprice")).alias("v")))
query("so_12_top_concepts", with_(ENTITIES, body="SELECT id, support FROM entities WHERE kind = 'part' ORDER BY support DESC, id LIMIT 30"))(lambda s, d: live(V.entities(s, d)).where("kind = 'part'").orderBy(F.desc("support"), "id").limit(30).select("id", "support"))
