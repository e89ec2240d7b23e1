"""Queries: filters, joins and aggregates over facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import facts as O
from ..registry import query
from ..vault import adapter as V
from ..vault.oracle import ENTITIES, FACTS, ITEMS, with_

NUM = "regexp_replace(regexp_replace(CAST(CAST(value_num AS DECIMAL(38,6)) AS VARCHAR), '0+$', ''), '\\.$', '')"
VALUE = f"CASE WHEN f.object_id IS NOT NULL THEN coalesce(o.label, '?') WHEN value_num IS NOT NULL THEN concat_ws(' ', {NUM}, unit) WHEN value_date IS NOT NULL THEN strftime(value_date, '%Y-%m-%d') ELSE coalesce(value_text, '—') END"
FE = (ENTITIES, FACTS)


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def ents(s, d):
    return V.entities(s, d)


def fcts(s, d):
    return V.facts(s, d)


def _agg(name: str, op: str, measure: str, by: str | None, kind: str | None) -> None:
    val = {"sum": "floor(sum(m.value_num)*100+0.5)/100", "avg": "floor(avg(m.value_num)*100+0.5)/100", "min": "min(m.value_num)", "max": "max(m.value_num)", "count": "CAST(count(*) AS DOUBLE)"}[op]
    semi = f"AND subject_id IN (SELECT id FROM entities WHERE kind = '{kind}')" if kind else ""
    label = f"CASE WHEN f.object_id IS NOT NULL THEN coalesce(o.label, '?') ELSE coalesce(value_text, {NUM}, strftime(value_date, '%Y-%m-%d'), '—') END"
    groups = f", g AS (SELECT subject_id, arg_max({label}, (f.valid_from, f.id)) AS grp FROM facts f LEFT JOIN entities o ON o.id = f.object_id WHERE predicate = '{by}' AND valid_to IS NULL GROUP BY 1)" if by else ""
    group, join = ("coalesce(g.grp, '(unspecified)')", "LEFT JOIN g USING (subject_id)") if by else ("'All'", "")
    sql = with_(*FE, body=f", m AS (SELECT subject_id, value_num FROM facts WHERE predicate = '{measure}' AND value_num IS NOT NULL AND valid_to IS NULL {semi}){groups} SELECT {group} AS \"group\", {val} AS value, count(*) AS count FROM m {join} GROUP BY 1")
    query(name, sql)(lambda s, d: A.aggregate(fcts(s, d), ents(s, d), measure, op, by, kind))


_agg("ag_01_sum_by_target", "sum", "amount", "billed_to", "invoice")
_agg("ag_01_avg_by_text", "avg", "amount", "priority", "invoice")
_agg("ag_01_min_by_date", "min", "amount", "order_date", None)
_agg("ag_01_max_all", "max", "acctbal", None, "customer")
_agg("ag_01_count_by_text", "count", "acctbal", "segment", "customer")
_agg("ag_02_unspecified_group", "count", "retail_price", "segment", None)
_agg("ag_02_last_of_many", "sum", "amount", "shipped_by", "invoice")


@query("ag_01_total", with_(*FE, body="SELECT floor(sum(value_num)*100+0.5)/100 AS total, count(*) AS count FROM facts WHERE predicate = 'amount' AND valid_to IS NULL AND subject_id IN (SELECT id FROM entities WHERE kind = 'invoice')"))
def _(s, d):
    return A.total(fcts(s, d), ents(s, d), "amount", "sum", "invoice")


@query("ag_03_monthly_series", with_(*FE, body="""SELECT strftime(dd.value_date, '%Y-%m') AS month, floor(sum(m.value_num)*100+0.5)/100 AS value, count(*) AS count
FROM facts dd JOIN (SELECT subject_id, arg_max(value_num, (valid_from, id)) AS value_num FROM facts WHERE predicate = 'amount' AND valid_to IS NULL AND value_num IS NOT NULL GROUP BY 1) m USING (subject_id)
WHERE dd.predicate = 'order_date' AND dd.valid_to IS NULL AND dd.value_date IS NOT NULL GROUP BY 1"""))
def _(s, d):
    return A.monthly_series(fcts(s, d), ents(s, d), "amount", "order_date", "sum", "invoice")


@query("ag_04_list_measures", with_(*FE, body="""SELECT role, predicate, replace(predicate, '_', ' ') AS label, count FROM (
SELECT 'numeric' AS role, predicate, count(*) FILTER (WHERE value_num IS NOT NULL) AS count FROM facts WHERE valid_to IS NULL GROUP BY 2
UNION ALL SELECT 'group_by', predicate, count(*) FILTER (WHERE value_num IS NULL AND (object_id IS NOT NULL OR coalesce(value_text, '') <> '')) FROM facts WHERE valid_to IS NULL GROUP BY 2) WHERE count > 0"""))
def _(s, d):
    return A.list_measures(fcts(s, d))


@query("ag_05_headline", with_(*FE, body="SELECT 'kind:' || kind AS name, count(*) AS value FROM entities GROUP BY 1 UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'facts', count(*) FROM facts WHERE valid_to IS NULL"))
def _(s, d):
    return A.headline(fcts(s, d), ents(s, d))


USAGE_SQL = "u AS (SELECT event_type AS provider, 'model-' || (user_id % 4) AS model, event_id % 900 AS tokens_in, event_id % 70 AS tokens_out, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 97 AS DOUBLE) / 1000 END AS cost_usd, event_id % 5 = 0 AS estimated, ts AS used_at FROM events)"


def usage(s, d):
    e = V.table(s, d, "events")
    return e.select(F.col("event_type").alias("provider"), F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string")).alias("model"), (F.col("event_id") % 900).alias("tokens_in"), (F.col("event_id") % 70).alias("tokens_out"), F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 97).cast("double") / 1000).alias("cost_usd"), (F.col("event_id") % 5 == 0).alias("estimated"), F.col("ts").alias("used_at"))


@query("ag_07_usage_summary", with_(USAGE_SQL, body="SELECT provider, model, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, coalesce(floor(sum(cost_usd)*1e6+0.5)/1e6, 0) AS cost_usd, bool_or(estimated) AS estimated, bool_or(cost_usd IS NULL) AS unpriced FROM u WHERE used_at >= TIMESTAMP '2024-01-01 02:00:00' GROUP BY 1, 2"))
def _(s, d):
    return A.usage_summary(usage(s, d), F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"))


@query("ag_08_month_to_date", with_(USAGE_SQL, body="SELECT coalesce(floor(sum(cost_usd)*1e6+0.5)/1e6, 0) AS spend FROM u WHERE used_at >= TIMESTAMP '2024-01-01' AND used_at <= TIMESTAMP '2024-01-20'"))
def _(s, d):
    return A.month_to_date(usage(s, d), F.lit("2024-01-20").cast("timestamp_ntz"))


@query("sc_46_price_by_prefix", with_(USAGE_SQL, body="""SELECT provider, u.model, tokens_in, tokens_out, floor((tokens_in * p.price_in + tokens_out * p.price_out) + 0.5) / 1e6 AS cost_usd, estimated, strftime(used_at, '%Y-%m-%d %H:%M:%S') AS used_at
FROM u LEFT JOIN (SELECT model, arg_max(price_in, length(prefix)) AS price_in, arg_max(price_out, length(prefix)) AS price_out FROM (SELECT DISTINCT model FROM u) JOIN (VALUES ('model', 1.0, 2.0), ('model-1', 3.0, 5.0), ('other', 9.0, 9.0)) p(prefix, price_in, price_out) ON starts_with(model, prefix) GROUP BY 1) p ON p.model = u.model"""))
def _(s, d):
    prices = s.createDataFrame([("model", 1.0, 2.0), ("model-1", 3.0, 5.0), ("other", 9.0, 9.0)], "prefix string, price_in double, price_out double")
    return A.prices(usage(s, d), prices).withColumn("used_at", ts("used_at")).select("provider", "model", "tokens_in", "tokens_out", "cost_usd", "estimated", "used_at")


@query("ag_09_edge_counts", with_(*FE, body="SELECT id, count(*) AS edges FROM (SELECT subject_id AS id FROM facts WHERE valid_to IS NULL UNION ALL SELECT object_id FROM facts WHERE valid_to IS NULL AND object_id IS NOT NULL) GROUP BY 1"))
def _(s, d):
    return O.edge_counts(O.current(fcts(s, d)))


@query("jn_09_or_join_edge_counts", with_(*FE, body="SELECT id, count(*) AS edges FROM (SELECT subject_id AS id, id AS f FROM facts UNION SELECT object_id, id FROM facts WHERE object_id IS NOT NULL) GROUP BY 1"))
def _(s, d):
    return O.edge_counts(fcts(s, d), once=True)


@query("ag_11_observed_predicates", with_(*FE, body="""(SELECT 'attribute' AS role, predicate, CAST(NULL AS VARCHAR) AS target, count(*) AS count FROM facts JOIN entities e ON e.id = subject_id AND e.kind = 'invoice' WHERE valid_to IS NULL AND object_id IS NULL GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 8)
UNION ALL (SELECT 'relation', predicate, o.kind, count(*) FROM facts f JOIN entities e ON e.id = subject_id AND e.kind = 'invoice' JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL GROUP BY 2, 3 ORDER BY 4 DESC, 2, 3 LIMIT 6)"""))
def _(s, d):
    return A.observed(fcts(s, d), ents(s, d), "invoice")


@query("ag_12_graph_summary", with_(*FE, body=f""", f AS (SELECT f.*, e.kind AS sk, e.label AS sl, o.kind AS ok FROM facts f JOIN entities e ON e.id = f.subject_id LEFT JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL),
a AS (SELECT sk AS kind, 'attr' AS role, predicate, count(*) AS count, substr(arg_min(coalesce(value_text, {NUM}, strftime(value_date, '%Y-%m-%d'), '—'), id), 1, 60) AS sample, '' AS others FROM f WHERE object_id IS NULL GROUP BY 1, 3
 UNION ALL SELECT sk, 'out', predicate, count(*), '', string_agg(DISTINCT coalesce(ok, '?'), '/' ORDER BY coalesce(ok, '?')) FROM f WHERE object_id IS NOT NULL GROUP BY 1, 3
 UNION ALL SELECT ok, 'in', predicate, count(*), '', string_agg(DISTINCT sk, '/' ORDER BY sk) FROM f WHERE ok IS NOT NULL GROUP BY 1, 3)
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY kind, role ORDER BY count DESC, predicate) AS r FROM a) WHERE r <= 14"""))
def _(s, d):
    return A.graph_summary(fcts(s, d), ents(s, d))


@query("ag_17_queue_counts", with_(ITEMS, body="SELECT count(*) FILTER (WHERE status = 'stored' OR (status = 'failed' AND attempts < 3)) AS queued, count(*) FILTER (WHERE status = 'analyzing') AS analyzing, count(*) FILTER (WHERE status = 'failed' AND attempts >= 3) AS stuck FROM items"))
def _(s, d):
    return A.queue_counts(V.items(s, d))


@query("ag_18_kind_legend", with_(ENTITIES, body="SELECT kind, count(*) AS count FROM entities GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"))
def _(s, d):
    return O.live(ents(s, d)).groupBy("kind").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "kind").limit(8)


@query("flt_01_current", with_(FACTS, body="SELECT id, subject_id, value_text FROM facts WHERE valid_to IS NULL AND predicate = 'last_event_type'"))
def _(s, d):
    return O.current(fcts(s, d)).where("predicate = 'last_event_type'").select("id", "subject_id", "value_text")


@query("flt_02_as_of", with_(FACTS, body="SELECT id, subject_id, value_text FROM facts WHERE predicate = 'last_event_type' AND valid_from <= TIMESTAMP '2024-01-01 23:59:59' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-01 23:59:59')"))
def _(s, d):
    return O.as_of(fcts(s, d).where("predicate = 'last_event_type'"), "2024-01-01").select("id", "subject_id", "value_text")


@query("flt_03_find_facts", with_(*FE, body=f"SELECT f.id, e.label AS subject_label, predicate, {VALUE} AS value FROM facts f JOIN entities e ON e.id = f.subject_id AND e.kind = 'invoice' LEFT JOIN entities o ON o.id = f.object_id WHERE predicate = 'billed_to' AND valid_to IS NULL ORDER BY valid_from DESC, f.id LIMIT 40"))
def _(s, d):
    return O.find(fcts(s, d), ents(s, d), predicate="billed_to", kind="invoice").select("id", "subject_label", "predicate", "value")


@query("flt_04_value_types", with_(FACTS, body="SELECT predicate, CASE WHEN object_id IS NOT NULL THEN 'entity' WHEN value_num IS NOT NULL THEN 'number' WHEN value_date IS NOT NULL THEN 'date' ELSE 'text' END AS value_type, count(*) AS count FROM facts WHERE valid_to IS NULL AND coalesce(object_id, CAST(value_num AS VARCHAR), CAST(value_date AS VARCHAR), value_text) IS NOT NULL GROUP BY 1, 2"))
def _(s, d):
    return A.value_types(fcts(s, d))


@query("flt_06_formatted_values", with_(*FE, body=f"SELECT f.id, {VALUE} AS value FROM facts f LEFT JOIN entities o ON o.id = f.object_id WHERE valid_to IS NULL"))
def _(s, d):
    return O.labelled(O.current(fcts(s, d)), ents(s, d)).select("id", O.value().alias("value"))


@query("wn_01_top_facts", with_(FACTS, body="SELECT subject_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, created_at DESC, id) AS rank FROM facts WHERE valid_to IS NULL) WHERE rank <= 4"))
def _(s, d):
    return O.top_facts(fcts(s, d)).select("subject_id", "id", "rank")


@query("wn_05_first_seen", with_(*FE, body="SELECT kind AS subject_kind, predicate, strftime(min(f.created_at), '%Y-%m-%d %H:%M:%S') AS first_seen FROM facts f JOIN entities e ON e.id = f.subject_id GROUP BY 1, 2"))
def _(s, d):
    return O.first_seen(fcts(s, d), ents(s, d)).withColumn("first_seen", ts("first_seen"))


@query("jn_14_provenance", with_(FACTS, ITEMS, body="SELECT coalesce(i.channel, 'unknown') AS channel, count(*) AS n, count(i.sender) AS with_sender FROM facts f LEFT JOIN items i ON i.id = f.source_item_id GROUP BY 1"))
def _(s, d):
    return O.provenance(fcts(s, d), V.items(s, d)).groupBy("channel").agg(F.count("*").alias("n"), F.count("sender").alias("with_sender"))


@query("st_claim_invariant", with_(FACTS, body="SELECT 'x' AS claim_key, 1 AS n FROM facts WHERE false"))
def _(s, d):
    return O.claim_violations(fcts(s, d)).withColumn("n", F.col("n").cast("int"))
