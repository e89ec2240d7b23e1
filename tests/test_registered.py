"""Registered queries against their SQL where the given tables are too small or too plain to tell them apart."""

import math
from collections import Counter
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def agrees(spark, tmp_path):
    """Checks a query's rows, each as often, against its SQL over sf0.001 with some tables replaced."""

    def check(name, **tables):
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for f in Path(DATA).glob("*.parquet"):
            own = tmp_path / f.name
            if f.stem in tables:
                tables[f.stem].write.parquet(str(own))
            else:
                own.symlink_to(f)
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{own}{'/*.parquet' if own.is_dir() else ''}'")
        said = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
        got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        rows = Counter(tuple(map(said, r)) for r in got.select(*want.columns).collect())
        assert rows == Counter(tuple(map(said, r)) for r in want.fetchall())
        return rows

    return check


def test_centroids_of_more_vectors_than_a_memory(spark, agrees):
    rows = [(i, [math.sin(i) + i / 300, 1.0], i % 2) for i in range(700)]
    assert len(agrees("ag_22_centroids", embeddings=spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))) == 2


def test_routing_compares_rounded_scores(spark, agrees):
    # ten words of a tenth each make just under one in floating point
    words = [f"word{c}" for c in "abcdefghij"]
    agents = [(0, " ".join(words))] + [(1 + 9 * i + k, w) for i, w in enumerate(words) for k in range(9)]
    tables = {"benchmark": spark.createDataFrame(agents, "item_id bigint, text string"), "conversations": spark.createDataFrame([(1, 0, "user", " ".join(words))], "conv_id bigint, turn bigint, role string, text string")}
    assert len(agrees("se_11_route_messages", **tables)) == 1


def test_only_what_is_asked_for_is_dealt_out(spark):
    """Edges of a few ids and keyword hits never join or count all facts."""
    from factloom.operators.facts import current, edge_counts, edges_of
    from factloom.operators.search import search_entities
    from factloom.operators.storage import cut
    from factloom.vault import adapter

    f, e = adapter.facts(spark, DATA), adapter.entities(spark, DATA)
    ids = cut(spark.createDataFrame([("nation:3",), ("customer:1",), ("none",)], "id string"))
    want = {r["id"]: r["edges"] for r in edge_counts(current(f)).where("id IN ('nation:3', 'customer:1')").collect()}
    assert {r["id"]: r["edges"] for r in edges_of(ids, current(f)).collect()} == want | {"none": 0}
    plan = search_entities(f, e, ["customer"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan


@pytest.fixture
def dealt(spark):
    """Rows that a query's exchanges write over sf0.001 without broadcasts, and its rows."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def run(name):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            before, rows = written(), len(entry.queries()[name](spark, DATA).collect())
            return written() - before, rows
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    return run


def test_merge_futures_deal_facts_out_once(spark, agrees, dealt):
    agrees("gr_10_merge_futures")
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert dealt("gr_10_merge_futures")[0] < 6 * lines


def test_shown_facts_deal_out_what_has_objects_or_sources(spark, agrees, dealt):
    agrees("kn_21_view_facts")
    records, rows = dealt("kn_21_view_facts")
    assert records < 1.8 * rows


def test_cosines_are_the_sqls_to_the_last_bit(spark):
    from factloom.functions.numbers import cosine

    path = "/root/testdata/sf0.001/embeddings.parquet"
    pairs = spark.read.parquet(path).where("vec_id < 40").selectExpr("vec_id AS a", "embedding AS x").crossJoin(spark.read.parquet(path).where("vec_id < 10").selectExpr("vec_id AS b", "embedding AS y"))
    got = {(r["a"], r["b"]): r["sim"] for r in pairs.select("a", "b", cosine("x", "y").alias("sim")).collect()}
    want = duckdb.sql(f"SELECT a.vec_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) FROM '{path}' a, '{path}' b WHERE a.vec_id < 40 AND b.vec_id < 10").fetchall()
    assert got == {(a, b): sim for a, b, sim in want} and all(got[i, i] == 1.0 for i in range(10))
