"""The vector index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import vector_index as I

SCHEMA = "id string, kind string, model string, embedding array<double>"


def crowd(n, size=12, centres=9, seed=3):
    """Vectors around centres, a third of them copies of one."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, size))
    rows = [(f"v{i:04d}", f"k{i % 2}", "m", (c[i % centres] + rng.normal(size=size) * 0.4).tolist()) for i in range(n)]
    return rows + [(f"w{i:04d}", "k0", "m", rows[0][3]) for i in range(n // 2)]


def brute(queries, rows, k, floor=None, others=False):
    out = set()
    for qid, kind, model, q in queries:
        near = []
        for vid, vkind, vmodel, v in rows:
            if (kind or "", model or "") == (vkind or "", vmodel or "") and v and q and len(v) == len(q) and any(v) and any(q) and not (others and vid == qid):
                near.append((-round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9), vid))
        out |= {(qid, vid, -s, r) for r, (s, vid) in enumerate(sorted(near)[:k], 1) if floor is None or -s >= floor}
    return out


def rounded(found):
    return {(r["query_id"], r["id"], round(r["sim"], 9), r["rank"]) for r in found.collect()}


@pytest.fixture(scope="module")
def world(spark):
    rows = crowd(400)
    return rows, I.build(spark.createDataFrame(rows, SCHEMA), I.Fit(cells=14, part_rows=40, block_rows=16))


def test_exact_search_is_all_pairs(spark, world):
    rows, index = world
    queries = rows[::20]
    asked = spark.createDataFrame(queries, SCHEMA)
    assert rounded(index.search(asked, 5, exact=True)) == brute(queries, rows, 5)
    assert rounded(index.search(asked, 4, 0.8, exact=True, others=True)) == brute(queries, rows, 4, 0.8, True)


def test_a_floor_prunes_cells(spark, world):
    rows, index = world
    asked = spark.createDataFrame(rows[:100], SCHEMA)
    all_cells = index._probing(asked, None, None, True).count()
    assert index._probing(asked, 0.9, None, True).count() < all_cells / 2


def test_probes_reach_their_recall(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{i:05d}", f"k{i % 3}", "m", rng.normal(size=16).tolist()) for i in range(3000)]  # of no cluster at all
    index = I.build(spark.createDataFrame(rows, SCHEMA), I.Fit(cells=40))
    queries = rows[::50]
    (space,) = index.spaces
    assert space.recall >= 0.95 and 0 < space.probes < 40
    truth = {(q, v) for q, v, _, _ in brute(queries, rows, 10)}
    found = {(q, v) for q, v, _, _ in rounded(index.search(spark.createDataFrame(queries, SCHEMA), 10))}
    assert len(truth & found) >= 0.9 * len(truth)
    assert I.recall(index.search(spark.createDataFrame(queries, SCHEMA), 10, probes=40), index.search(spark.createDataFrame(queries, SCHEMA), 10, exact=True)) == 1.0


def test_every_row_is_indexed_and_copies_are_one_vector(world):
    rows, index = world
    assert index.members.count() == len(rows)
    assert index.vectors.count() == len({(r[1], tuple(r[3])) for r in rows})
    assert index.vectors.groupBy("space", "cell", "part").count().agg(F.max("count")).first()[0] <= 80


def test_odd_vectors(spark):
    rows = [("a", None, None, [1.0, 0.0]), ("b", None, None, [0.0, 0.0]), ("c", None, None, None), ("d", None, None, []), ("e", "k", "other/model", [1.0]), ("f", None, None, [2.0, 0.0]), ("g", None, None, [float("nan"), 1.0]), ("a", None, None, [1.0, 0.0])]
    index = I.build(spark.createDataFrame(rows, SCHEMA))
    got = rounded(index.search(spark.createDataFrame([("q", None, None, [3.0, 0.0]), ("r", "k", "other/model", [-1.0]), ("s", "k", "unseen", [1.0]), ("t", None, None, None)], SCHEMA), 3, exact=True))
    assert {(q, i, s) for q, i, s, _ in got} == {("q", "a", 1.0), ("q", "f", 1.0), ("r", "e", -1.0)}
    empty = I.build(spark.createDataFrame([], SCHEMA))
    assert empty.search(spark.createDataFrame(rows, SCHEMA), 3).collect() == []
