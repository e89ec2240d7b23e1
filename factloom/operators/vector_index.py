"""An inverted-file index over vectors: cells around centroids, probed by a join, ranked by the exact cosine.

Every vector is in the index, under its nearest centroid's cell; only the
centroids are fitted to a bounded sample. Equal vectors of a kind are one row
with their ids beside it, and a large cell is dealt into parts, so neither
copies nor a crowded region are one task's. Queries are written to the cells
they probe, in blocks, and each (cell, part, block) is one product of two bounded
matrices.

Two ways to probe. ``exact``: all cells that can hold a vector within the floor,
by the triangle inequality of angles, so nothing is lost. Otherwise so many
nearest cells as reached the asked recall when the index was built, where a
bounded set of queries was held against all rows; ``recall`` says what was reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, sqrt
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut, shared_folder

#: Added to angles before they decide what can be left out.
_SLACK = 1e-6


@dataclass(frozen=True)
class Fit:
    """cells: of each space; None for the root of its rows, most_cells at most.

    sample: vectors that centroids are fitted to, about; asked: queries (of the
    sample) by which probes are chosen, so that recall of the k nearest is target.
    part_rows, block_rows: vectors and queries that meet in one product at most.
    """

    cells: int | None = None
    most_cells: int = 2048
    sample: int = 65_536
    asked: int = 200
    k: int = 10
    target: float = 0.95
    part_rows: int = 16_384
    block_rows: int = 2_048
    seed: int = 7


@dataclass(frozen=True)
class Space:
    """What vectors of one model and length share: unit centroids, each cell's least cosine to its centroid, and its parts."""

    model: str
    size: int
    centroids: np.ndarray
    least: np.ndarray
    parts: np.ndarray
    probes: int
    recall: float


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-300)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size))


def _usable(vectors: DataFrame) -> DataFrame:
    """id, kind, model, n, embedding of the vectors that have a direction; a kind or model that is null, or not there at all, is ''."""
    v = vectors.select("id", *((F.coalesce(F.col(c), F.lit("")) if c in vectors.columns else F.lit("")).alias(c) for c in ("kind", "model")), F.size("embedding").alias("n"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return v.where(F.col("embedding").isNotNull() & (F.col("n") > 0) & finite)


def _code(embedding: str = "embedding") -> Column:
    """A name for a vector's exact values."""
    return F.sha2(F.concat_ws(",", F.transform(embedding, lambda x: x.cast("string"))).cast("binary"), 256)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession = field(repr=False)
    path: str = ""
    spaces: tuple[Space, ...] = ()
    fit: Fit = Fit()

    @property
    def vectors(self) -> DataFrame:
        """kind, code, first_id, embedding, part, space (its place in spaces), cell; partitioned by the last two."""
        return self.spark.read.schema("kind string, code string, first_id string, embedding array<double>, part int, space int, cell int").parquet(f"{self.path}/vectors")

    @property
    def members(self) -> DataFrame:
        return self.spark.read.schema("model string, kind string, code string, id string").parquet(f"{self.path}/members")

    def search(self, queries: DataFrame, k: int, floor: float | None = None, probes: int | None = None, exact: bool = False, others: bool = False) -> DataFrame:
        """(query_id, id, sim, rank): each query's k nearest of its kind and model, then those of at least floor.

        queries: id, kind, model, embedding. others: without the query's own id.
        A query of a model or length that the index has not finds nothing.
        """
        if not self.spaces:
            return self.spark.createDataFrame([], "query_id string, id string, sim double, rank int")
        codes = k + (1 if others else 0)
        asked = cut(self._probing(queries, floor, probes, exact))
        # a cell's queries in blocks: its vectors are read once for each block
        blocks = asked.groupBy("space", "cell").agg(F.ceil(F.count("*") / self.fit.block_rows).cast("int").alias("blocks"))
        at = ["space", "cell"]
        left = asked.join(blocks, at).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")
        right = self.vectors.join(blocks, at).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        keys = [*at, "part", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(codes), "query_id string, kind string, model string, code string, first_id string, sim double")
        w = Window.partitionBy("query_id")
        best = cut(found.withColumn("r", F.row_number().over(w.orderBy(F.desc("sim"), "first_id"))).where(F.col("r") <= codes))
        # of a hot vector's ids only the least can be among the k
        wanted = best.select("model", "kind", "code").distinct()
        few = self.members.join(wanted, ["model", "kind", "code"]).withColumn("m", F.row_number().over(Window.partitionBy("model", "kind", "code").orderBy("id"))).where(F.col("m") <= codes)
        rows = best.join(few, ["model", "kind", "code"]).select("query_id", "id", "sim")
        if others:
            rows = rows.where(F.col("query_id") != F.col("id"))
        out = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= k)
        return out.where(F.col("sim") >= floor) if floor is not None else out

    def _probing(self, queries: DataFrame, floor: float | None, probes: int | None, exact: bool) -> DataFrame:
        """A row for each query and cell that it probes, with the cell's parts."""
        spaces = {(s.model, s.size): (i, s) for i, s in enumerate(self.spaces)}  # most_cells centroids each
        schema = T._parse_datatype_string("query_id string, kind string, model string, n int, embedding array<double>, space int, cell int, parts int")

        def cells(s: Space, cosine: np.ndarray) -> np.ndarray:
            if exact:
                if floor is None:
                    return np.arange(len(cosine))
                away = np.arccos(np.clip(cosine, -1, 1)) - np.arccos(np.clip(s.least, -1, 1))
                return np.flatnonzero(away <= np.arccos(np.clip(floor, -1, 1)) + _SLACK)
            return np.argsort(-cosine, kind="stable")[: probes or s.probes]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, space, cell, parts = [], [], [], []
                for i, (model, n) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    if (model, n) in spaces:
                        place, s = spaces[model, n]
                        mine = cells(s, s.centroids @ unit(batch.column(4)[i].values.to_numpy()))
                        of += [i] * len(mine)
                        space += [place] * len(mine)
                        cell += mine.tolist()
                        parts += s.parts[mine].tolist()
                if of:
                    rows = batch.take(pa.array(of, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, pa.int32()) for c in (space, cell, parts))], schema.names)

        return _usable(queries).select(F.col("id").cast("string").alias("query_id"), "kind", "model", "n", "embedding").mapInArrow(run, schema)


def _nearest(k: int):
    """The k nearest vectors of each query of a block, among those of its kind in one part of a cell."""
    names = ["query_id", "kind", "model", "code", "first_id", "sim"]
    kinds = [*[pa.string()] * 5, pa.float64()]

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if queries.num_rows and rows.num_rows:
            size = queries["n"][0].as_py()
            sim = _matrix(queries["embedding"], size) @ _matrix(rows["embedding"], size).T
            both = pa.concat_arrays([queries["kind"].combine_chunks(), rows["kind"].combine_chunks()]).dictionary_encode().indices.to_numpy()
            sim[both[: len(sim), None] != both[None, len(sim) :]] = -np.inf
            code, first = np.array(rows["code"].to_pylist(), object), np.array(rows["first_id"].to_pylist(), object)
            ids, kind, model = (queries[c].to_pylist() for c in ("query_id", "kind", "model"))
            for i, row in enumerate(sim):
                near = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, -k)[-k])  # with all ties of the last
                for j in sorted((j for j in near if row[j] > -np.inf), key=lambda j: (-row[j], first[j]))[:k]:
                    for column, x in zip(out, (ids[i], kind[i], model[i], code[j], first[j], float(row[j])), strict=True):
                        column.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return run


def _centroids(vectors: DataFrame, rows: int, fit: Fit) -> np.ndarray:
    """Unit centroids of one space, by spherical k-means over the sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = fit.cells or max(1, min(fit.most_cells, ceil(sqrt(rows))))
    sample = cut(_sampled(vectors, rows, fit.sample, "code").select(array_to_vector("embedding").alias("features"))) if cells > 1 else None
    if sample is None or sample.count() < 2:
        return unit(np.array([vectors.select("embedding").first()[0]]))
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=8, initSteps=2, seed=fit.seed).fit(sample)
    return unit(np.array(model.clusterCenters()))


def _sampled(rows: DataFrame, n: int, about: int, by: str) -> DataFrame:
    """About that many of n rows, by a digest: the same ones each time, and never gathered."""
    return rows if n <= about else rows.where(F.pmod(F.xxhash64(F.lit("sample"), by), F.lit(1 << 20)) < int(about / n * (1 << 20)) + 1)


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with their nearest cell and the cosine to its centroid."""
    schema = T.StructType([*vectors.schema, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])
    at = vectors.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = _matrix(batch.column(at), centroids.shape[1]) @ centroids.T
                cell = cosine.argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(cosine[np.arange(len(cell)), cell])], schema.names)

    return vectors.mapInArrow(run, schema)


def _probes(placed: DataFrame, centroids: np.ndarray, rows: int, fit: Fit) -> tuple[int, float]:
    """The least probes that find ``target`` of the k nearest of the asked vectors among all rows, and what they find."""
    asked = _sampled(placed.select("code", "kind", "embedding"), rows, fit.asked, "code").limit(2 * fit.asked).collect()  # fit.asked vectors, about
    q, names, kind = unit(np.array([r["embedding"] for r in asked])), [r["code"] for r in asked], np.array([r["kind"] for r in asked], object)
    order = np.argsort(-(q @ centroids.T), axis=1, kind="stable")
    at_place = np.argsort(order, axis=1)
    k, size = fit.k, q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sim = q @ _matrix(batch.column(0), size).T
            sim[kind[:, None] != np.array(batch.column(1).to_pylist(), object)[None, :]] = -np.inf
            code, cell = np.array(batch.column(3).to_pylist(), object), batch.column(2).to_numpy()
            out: list[list] = [[], [], []]
            for i, row in enumerate(sim):
                row[code == names[i]] = -np.inf
                for j in np.argsort(-row, kind="stable")[:k]:
                    if row[j] > -np.inf:
                        for column, x in zip(out, (i, float(row[j]), int(at_place[i, cell[j]])), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int32())], ["q", "sim", "place"])

    near = placed.select("embedding", "kind", "cell", "code").mapInArrow(run, "q int, sim double, place int")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "place"))).where(F.col("r") <= k)
    places = {r["place"]: r["n"] for r in best.groupBy("place").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    total, found = sum(places.values()), 0
    if not total:
        return len(centroids), 1.0
    for place in range(len(centroids)):
        found += places.get(place, 0)
        if found >= fit.target * total:
            return place + 1, found / total
    return len(centroids), 1.0


def build(vectors: DataFrame, fit: Fit = Fit(), path: str | None = None) -> VectorIndex:
    """The index of vectors (id, kind, model, embedding) as tables at path (in the shared folder where none is named).

    Vectors without values, without a direction, or with a null or NaN in them are left out.
    """
    spark = vectors.sparkSession
    path = path or f"{shared_folder(spark)}/vectors-{uuid4().hex}"
    v = cut(_usable(vectors).withColumn("id", F.col("id").cast("string")).withColumn("code", _code()))
    v.select("model", "kind", "code", "id").write.parquet(f"{path}/members")
    distinct = cut(v.groupBy("model", "n", "kind", "code").agg(F.min("id").alias("first_id"), F.first("embedding").alias("embedding")))
    spaces = []
    for s in distinct.groupBy("model", "n").agg(F.count("*").alias("rows")).orderBy("model", "n").collect():  # a row for each model and length
        mine = distinct.where((F.col("model") == s["model"]) & (F.col("n") == s["n"]))
        centroids = _centroids(mine, s["rows"], fit)
        placed = cut(_assigned(mine, centroids))
        probes, recall = _probes(placed, centroids, s["rows"], fit)
        least, parts = np.ones(len(centroids)), np.ones(len(centroids), np.int32)
        for r in placed.groupBy("cell").agg(F.min("near").alias("least"), F.count("*").alias("n")).collect():  # a row for each cell
            least[r["cell"]], parts[r["cell"]] = r["least"], ceil(r["n"] / fit.part_rows)
        of = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("cell") + 1)
        dealt = placed.select("kind", "code", "first_id", "embedding", F.pmod(F.xxhash64("code"), of).cast("int").alias("part"), F.lit(len(spaces)).alias("space"), "cell").repartition("cell", "part")
        dealt.write.mode("append").partitionBy("space", "cell").parquet(f"{path}/vectors")
        spaces.append(Space(s["model"], s["n"], centroids, least, parts, probes, recall))
    return VectorIndex(spark, path, tuple(spaces), fit)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of (query_id, id) in truth that found has."""
    both = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    got = both.agg(F.count("hit").alias("hits"), F.count("*").alias("n")).first()
    return got["hits"] / got["n"] if got["n"] else 1.0
