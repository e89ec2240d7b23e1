"""The same mapping as DuckDB SQL: common table expressions that the oracles begin with."""

from __future__ import annotations

_E = "TIMESTAMP '2020-01-01'"


def _entity(source: str, kind: str, k: str, label: str, created: str = _E) -> str:
    return f"SELECT '{kind}:' || {k} AS id, '{kind}' AS kind, {label} AS label, CAST({k} % 3 + 1 AS INTEGER) AS support, {created} AS created_at, CAST(NULL AS VARCHAR) AS merged_into FROM {source}"


ENTITIES = "entities AS (\n  " + "\n  UNION ALL ".join([
    _entity("region", "region", "r_regionkey", "r_name"),
    _entity("nation", "nation", "n_nationkey", "n_name"),
    _entity("customer", "customer", "c_custkey", "c_name"),
    _entity("supplier", "supplier", "s_suppkey", "s_name"),
    _entity("part", "part", "p_partkey", "p_name"),
    _entity("orders", "invoice", "o_orderkey", "'ORD-' || o_orderkey", "o_orderdate"),
    _entity("documents", "document", "doc_id", "'doc ' || doc_id"),
    _entity("(SELECT user_id, min(ts) AS ts FROM events GROUP BY 1)", "user", "user_id", "'user ' || user_id", "ts"),
]) + "\n)"


def _fact(source: str, kind: str, k: str, predicate: str, *, obj: str = "NULL", text: str = "NULL", num: str = "NULL", date: str = "NULL", unit: str | None = None, many: bool = False, fid: str | None = None, since: str = _E, item: str = "NULL", until: str = "NULL", by: str = "NULL") -> str:
    unit = f"'{unit}'" if unit else "NULL"
    return (
        f"SELECT {fid or f"'{predicate}|{kind}:' || {k}"} AS id, '{kind}:' || {k} AS subject_id, '{predicate}' AS predicate, CAST({obj} AS VARCHAR) AS object_id, CAST({text} AS VARCHAR) AS value_text, "
        f"CAST({num} AS DOUBLE) AS value_num, CAST({date} AS DATE) AS value_date, CAST({unit} AS VARCHAR) AS unit, '{'many' if many else 'one'}' AS cardinality, "
        f"CAST(0.5 AS DOUBLE) + CAST({k} % 5 AS DOUBLE) / 10 AS confidence, {since} AS valid_from, CAST({until} AS TIMESTAMP) AS valid_to, CAST({by} AS VARCHAR) AS superseded_by, CAST({item} AS VARCHAR) AS source_item_id, {since} AS created_at FROM {source}"
    )


_RUNS = """(SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS NULL OR last <> event_type)"""
FACTS = "facts AS (\n  " + "\n  UNION ALL ".join([
    _fact("orders", "invoice", "o_orderkey", "amount", num="o_totalprice", unit="USD", since="o_orderdate"),
    _fact("orders", "invoice", "o_orderkey", "order_date", date="o_orderdate", since="o_orderdate"),
    _fact("orders", "invoice", "o_orderkey", "status", text="o_orderstatus", since="o_orderdate"),
    _fact("orders", "invoice", "o_orderkey", "priority", text="o_orderpriority", since="o_orderdate"),
    _fact("orders", "invoice", "o_orderkey", "billed_to", obj="'customer:' || o_custkey", since="o_orderdate"),
    _fact("(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)", "invoice", "l_orderkey", "contains", obj="'part:' || l_partkey", many=True, fid="'contains|invoice:' || l_orderkey || '|' || l_partkey"),
    _fact("(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)", "invoice", "l_orderkey", "shipped_by", obj="'supplier:' || l_suppkey", many=True, fid="'shipped_by|invoice:' || l_orderkey || '|' || l_suppkey"),
    _fact("customer", "customer", "c_custkey", "acctbal", num="c_acctbal", unit="USD"),
    _fact("customer", "customer", "c_custkey", "segment", text="c_mktsegment"),
    _fact("customer", "customer", "c_custkey", "located_in", obj="'nation:' || c_nationkey"),
    _fact("supplier", "supplier", "s_suppkey", "located_in", obj="'nation:' || s_nationkey"),
    _fact("nation", "nation", "n_nationkey", "part_of", obj="'region:' || n_regionkey"),
    _fact("part", "part", "p_partkey", "brand", text="p_brand"),
    _fact("part", "part", "p_partkey", "type", text="p_type"),
    _fact("part", "part", "p_partkey", "size", num="p_size"),
    _fact("part", "part", "p_partkey", "retail_price", num="p_retailprice", unit="USD"),
    _fact("documents", "document", "doc_id", "lang", text="lang"),
    _fact("documents", "document", "doc_id", "source", text="source"),
    _fact("documents", "document", "doc_id", "n_chars", num="n_chars"),
    _fact(_RUNS, "user", "user_id", "last_event_type", text="event_type", fid="'ev|' || event_id", since="ts", item="'item:' || event_id", until="next_ts", by="'ev|' || next_id"),
]) + "\n)"

ITEMS = """items AS (
  SELECT 'item:' || event_id AS id, event_type AS channel, 'user:' || user_id AS sender, props AS preview, ts AS received_at, ts - INTERVAL 1 HOUR AS sent_at,
    CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'analyzing' WHEN event_id % 3 = 0 THEN 'stored' ELSE 'done' END AS status, CAST(event_id % 4 AS INTEGER) AS attempts
  FROM events
)"""
PASSAGES = r"""passages AS (
  SELECT 'document:' || doc_id AS entity_id, i - 1 AS seq, lines[i] AS text
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
  WHERE trim(lines[i]) <> ''
)"""
VECTORS = "vectors AS (SELECT 'emb:' || vec_id AS id, 'k' || label AS kind, embedding, CASE WHEN vec_id % 10 = 9 THEN 'm0' ELSE 'm1' END AS model, vec_id FROM embeddings)"


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body
