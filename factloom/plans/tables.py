"""Queries: user tables, projections, snapshots and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maps import canonical_json
from ..operators import tables as T
from ..registry import query
from ..vault import adapter as V
from ..vault.oracle import ENTITIES, FACTS, with_

CUSTOMER = [T.ColumnDef("name", "Name"), T.ColumnDef("segment", "Segment"), T.ColumnDef("balance", "Balance", "number")]


def _row(key, name, segment, balance):
    return F.create_map(F.lit("key"), F.col(key).cast("string"), F.lit("name"), F.col(name), F.lit("segment"), segment, F.lit("balance"), F.regexp_replace(F.regexp_replace(balance.cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", ""))


def customers(s, d):
    return V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).alias("created_at"), _row("c_custkey", "c_name", F.col("c_mktsegment"), F.col("c_acctbal")).alias("data"))


BAL = "regexp_replace(regexp_replace(CAST(CAST({} AS DECIMAL(38,6)) AS VARCHAR), '0+$', ''), '\\.$', '')"

query("flt_09_quick_filter", "SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build') OR contains(lower(CAST(c_acctbal AS VARCHAR)), 'build')")(lambda s, d: T.quick_filter(customers(s, d), CUSTOMER, " Build ").select("id"))
query("so_01_typed_sort", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")(lambda s, d: T.sorted_rows(customers(s, d), CUSTOMER[2], True).limit(50).select("id", F.element_at("data", "balance").cast("double").alias("balance")))
query("so_02_page", "SELECT c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")(lambda s, d: T.page(customers(s, d), 100, 50).select("id"))
query("ag_06_accepted_counts", "SELECT o_orderpriority AS dataset_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")(lambda s, d: T.accepted_counts(V.table(s, d, "orders").select(F.col("o_orderpriority").alias("dataset_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("proposed").alias("status"))))
query("ag_26_numeric_columns", "SELECT 'c_name' AS \"column\", count(*) FILTER (WHERE try_cast(c_name AS DOUBLE) IS NULL) = 0 AS \"numeric\" FROM customer UNION ALL SELECT 'c_acctbal', true UNION ALL SELECT 'c_mktsegment', count(*) FILTER (WHERE try_cast(c_mktsegment AS DOUBLE) IS NULL) = 0 FROM customer")(lambda s, d: T.numeric_columns(V.table(s, d, "customer").select("c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment")))

_CELLS = "cells AS (SELECT 'customer' AS t, 'nation' AS c, CAST(c_nationkey AS VARCHAR) AS v FROM customer UNION ALL SELECT 'customer', 'segment', c_mktsegment FROM customer UNION ALL SELECT 'nation', 'key', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'nation', 'name', n_name FROM nation UNION ALL SELECT 'supplier', 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT 'region', 'key', CAST(r_regionkey AS VARCHAR) FROM region)"


def _cells(s, d):
    t = lambda n: V.table(s, d, n)
    parts = [T.unpivoted(t("customer").selectExpr("c_nationkey AS nation", "c_mktsegment AS segment"), ["nation", "segment"], "customer"), T.unpivoted(t("nation").selectExpr("n_nationkey AS key", "n_name AS name"), ["key", "name"], "nation"), T.unpivoted(t("supplier").selectExpr("s_nationkey AS nation"), ["nation"], "supplier"), T.unpivoted(t("region").selectExpr("r_regionkey AS key"), ["key"], "region")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


query("jn_19_suggest_relations", with_(_CELLS, body="""
, v AS (SELECT DISTINCT t, c, lower(trim(v)) AS v FROM cells WHERE trim(v) <> ''), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT a.t AS at_, a.c AS ac, b.t AS bt, b.c AS bc, count(*) AS overlap, any_value(na.n) AS an, any_value(nb.n) AS bn FROM v a JOIN v b ON a.v = b.v AND a.t < b.t JOIN n na ON na.t = a.t AND na.c = a.c JOIN n nb ON nb.t = b.t AND nb.c = b.c GROUP BY 1, 2, 3, 4)
SELECT CASE WHEN f THEN at_ ELSE bt END AS from_table, CASE WHEN f THEN ac ELSE bc END AS from_column, CASE WHEN f THEN bt ELSE at_ END AS to_table, CASE WHEN f THEN bc ELSE ac END AS to_column, overlap, score
FROM (SELECT *, overlap / an >= overlap / bn AS f, greatest(overlap / an, overlap / bn) AS score FROM p) WHERE score >= 0.5 ORDER BY score DESC, overlap DESC, 1, 2, 3, 4 LIMIT 6"""))(lambda s, d: T.suggest_relations(_cells(s, d)))


def _before(s, d):
    c = V.table(s, d, "customer").where("c_custkey % 7 <> 0")
    return c.select(_row("c_custkey", "c_name", F.col("c_mktsegment"), F.col("c_acctbal")).alias("data"))


def _after(s, d):
    c = V.table(s, d, "customer").where("c_custkey % 11 <> 0")
    return c.select(_row("c_custkey", "c_name", F.col("c_mktsegment"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).alias("data"))


query("tm_06_snapshot_diff", "SELECT change, identity FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'added' ELSE 'changed' END AS change, CAST(c_custkey AS VARCHAR) AS identity FROM customer WHERE c_custkey % 11 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 5 = 0) UNION ALL SELECT 'removed', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0)")(lambda s, d: T.diff_snapshots(_before(s, d), _after(s, d), "key").select("change", "identity"))
query("jn_17_sheet_reconcile", "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'add' ELSE 'update' END AS action, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS target_id FROM customer WHERE c_custkey % 11 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 5 = 0)")(
    lambda s, d: T.reconcile(_before(s, d).withColumn("id", F.element_at("data", "key").cast("bigint")).withColumn("created_at", F.lit(0)), _after(s, d), "key").select("action", "target_id")
)
_PENDING = "SELECT o_orderkey AS id, o_custkey % 5 AS batch_id, CASE WHEN o_orderkey % 3 = 0 THEN 'add' ELSE 'update' END AS kind, o_orderkey % 3 <> 0 AND o_custkey % 4 = 0 AS conflict, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE CAST(o_orderkey % 2 AS INTEGER) END AS cells FROM orders"


def _rows(s, d):
    o = V.table(s, d, "orders")
    accepted = o.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("t"), "o_orderkey").alias("id"), F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("target_row_id"), F.lit(None).cast("bigint").alias("batch_id"), (F.col("o_custkey") % 4 == 0).alias("human_edited"), F.create_map(F.lit("s"), F.lit("0")).alias("data"))
    proposed = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("proposed").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("t"), "o_orderkey")).alias("target_row_id"), (F.col("o_custkey") % 5).alias("batch_id"), F.lit(False).alias("human_edited"), F.create_map(F.lit("s"), F.when(F.col("o_orderkey") % 3 == 0, "1").otherwise((F.col("o_orderkey") % 2).cast("string"))).alias("data"))
    return accepted.unionByName(proposed)


_S = [T.ColumnDef("s", "S")]
query("tm_08_pending_changes", _PENDING)(lambda s, d: T.pending_changes(_rows(s, d), _S).select(F.col("id").cast("bigint").alias("id"), "batch_id", "kind", "conflict", F.size("cells").alias("cells")))
query("ag_19_batch_rollup", f"SELECT batch_id, count(*) FILTER (WHERE kind = 'add') AS adds, count(*) FILTER (WHERE kind = 'update') AS updates, count(*) FILTER (WHERE conflict) AS conflicts FROM ({_PENDING}) GROUP BY 1")(lambda s, d: T.batch_rollup(T.pending_changes(_rows(s, d), _S)))
query("tm_07_accept_proposals", "SELECT data, human_edited, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE CAST(o_orderkey % 2 AS VARCHAR) END AS data, false AS human_edited FROM orders) GROUP BY 1, 2")(
    lambda s, d: T.accept(_rows(s, d), _rows(s, d).where("status = 'proposed'").select("id")).groupBy(F.element_at("data", "s").alias("data"), "human_edited").agg(F.count("*").alias("n"))
)
query("tm_07_reject_proposals", "SELECT 'accepted' AS status, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0")(lambda s, d: T.reject(_rows(s, d), _rows(s, d).select("id")).groupBy("status").agg(F.count("*").alias("n")))

_PARTS = [T.ColumnDef("name", "Name"), T.ColumnDef("brand", "Brand"), T.ColumnDef("size", "Size", "number")]
query("kn_17_project_kind", with_(ENTITIES, FACTS, body="SELECT e.id AS entity_id, e.label AS name, b.value_text AS brand, z.value_num AS size FROM entities e LEFT JOIN facts b ON b.subject_id = e.id AND b.predicate = 'brand' LEFT JOIN facts z ON z.subject_id = e.id AND z.predicate = 'size' WHERE e.kind = 'part'"))(lambda s, d: T.project(V.facts(s, d), V.entities(s, d), "part", _PARTS, "name"))
query("kn_17_multi_value_cells", with_(ENTITIES, FACTS, body="SELECT e.id AS entity_id, s.c AS shipped_by, strftime(od.value_date, '%Y-%m-%d') AS order_date FROM entities e LEFT JOIN (SELECT subject_id, string_agg(DISTINCT o.label, ', ' ORDER BY o.label) AS c FROM facts f JOIN entities o ON o.id = f.object_id WHERE predicate = 'shipped_by' GROUP BY 1) s ON s.subject_id = e.id LEFT JOIN facts od ON od.subject_id = e.id AND od.predicate = 'order_date' WHERE e.kind = 'invoice'"))(
    lambda s, d: T.project(V.facts(s, d), V.entities(s, d), "invoice", [T.ColumnDef("shipped_by", "Shipped by"), T.ColumnDef("order_date", "Date", "date")])
)
_SPEC = [(T.ColumnDef("name", "Name"), T.Source("label")), (T.ColumnDef("balance", "Balance", "number"), T.Source("attr", "acctbal")), (T.ColumnDef("country", "Country"), T.Source("relation", "located in", "out")), (T.ColumnDef("invoices", "Invoices", "number"), T.Source("relation", "billed_to", "in", "count"))]
query("kn_20_derived_table", with_(ENTITIES, FACTS, body=f"SELECT e.id AS entity_id, e.label AS name, {BAL.format('b.value_num')} AS balance, n.label AS country, CAST(coalesce(i.c, 0) AS VARCHAR) AS invoices FROM entities e LEFT JOIN facts b ON b.subject_id = e.id AND b.predicate = 'acctbal' LEFT JOIN facts l ON l.subject_id = e.id AND l.predicate = 'located_in' LEFT JOIN entities n ON n.id = l.object_id LEFT JOIN (SELECT object_id, count(*) AS c FROM facts WHERE predicate = 'billed_to' GROUP BY 1) i ON i.object_id = e.id WHERE e.kind = 'customer'"))(
    lambda s, d: T.derived_table(V.facts(s, d), V.entities(s, d), "customer", _SPEC)
)
query("sc_62_canonical_json", "SELECT c_custkey AS id, '{\"balance\":\"' || " + BAL.format("c_acctbal") + " || '\",\"key\":\"' || c_custkey || '\",\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' AS json FROM customer")(lambda s, d: customers(s, d).select("id", canonical_json("data").alias("json")))
