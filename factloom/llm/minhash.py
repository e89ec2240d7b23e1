"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification.

A document's set holds its distinct shingles (hashed to 64 bits). Two
permutations of the 2^32 universe give the whole signature: the first shuffles
the shingles, the second, circularly shifted by k, gives coordinate k. Bands of
the signature name buckets.

Documents with equal sets are one node (they are linked whatever else holds),
so copies never make pairs. Candidates come in two steps that together lose
none, without all pairs of a bucket where its members are linked already:

1. neighbours in the order of buckets and their members' further bands are
   candidates; each node's best of them are verified on full sets and linked
   (the order is cut into ranges of rows, so a large bucket is many tasks');
2. where those links leave nodes of one bucket apart, and enough bands agree,
   the bucket gets the full sets of such nodes, and a task counts their
   intersections through an index of their shingles. It returns a link only
   where two components meet: never pairs, always fewer than it has nodes.
   Nodes of a bucket's largest component are never compared with each other.

Full sets travel only for nodes of candidate pairs. Links become components by
star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import long, written
from ._text import BLOCK_BYTES, U64, mix64, shingle_hashes, short_hash, word_blocks
from .components import components

U32 = np.uint32


@dataclass(frozen=True)
class NearDup:
    """percent: links have 100 * intersection >= percent * union. bands * rows is the signature's length.

    In step 2 the nodes of a bucket are cut into chunks of about bucket_rows nodes
    and bucket_items shingles, and pairs of chunks are groups of their own, so no
    task holds more than two chunks of a bucket (or a single longer set).
    """

    percent: int = 80
    width: int = 5
    bands: int = 28
    rows: int = 4
    bucket_rows: int = 2048
    bucket_items: int = 2_000_000

    @property
    def least_common_bands(self) -> int:
        """Pairs at the threshold have fewer bands in common once in 100,000 times."""
        p, n, below = (self.percent / 100) ** self.rows, self.bands, 0.0
        for k in range(n):
            below += comb(n, k) * p**k * (1 - p) ** (n - k)
            if below > 1e-5:
                return max(1, k)
        return n


def document_sets(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """The sets of a column's texts, a block of texts at a time: sorted distinct shingle hashes."""
    for _, _, words, at in word_blocks(column, lower=True, block_bytes=BLOCK_BYTES // 2):
        shingles, sets = shingle_hashes(words, width), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                sets.append(np.unique(shingles[a : b - width + 1]))
            else:
                sets.append(np.array([short_hash(words[a:b])], U64) if b > a else np.zeros(0, U64))
        yield sets


def set_key(items: np.ndarray) -> int:
    """A 64-bit name for a set."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([items.sum(dtype=U64) * U64(0x9E3779B97F4A7C15) + (np.bitwise_xor.reduce(items) ^ U64(len(items)))], U64)).view(np.int64)[0])


def _sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation of the universe; the second one is in signatures()."""
    x = (x >> U64(32)).astype(U32)
    x ^= x >> U32(16)
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    return x ^ (x >> U32(16))


def signatures(sets: list[np.ndarray], length: int) -> np.ndarray:
    """One row of ``length`` coordinates for each (non-empty) set."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    placed = _sigma(np.concatenate(sets))
    out, x, y = np.empty((len(sets), length), U32), np.empty_like(placed), np.empty_like(placed)
    for k in range(length):
        np.add(placed, U32(k), out=x)  # the circular shift: the sum wraps around the universe
        np.multiply(x, U32(0x9E3779B1), out=x)
        np.right_shift(x, U32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, U32(0x2C1B3C6D), out=x)
        np.right_shift(x, U32(12), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, U32(0x297A2D39), out=x)
        np.right_shift(x, U32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _signed(docs: DataFrame, o: NearDup, id_col: str, text_col: str) -> DataFrame:
    """id, the text's digest, n_shingles, node (0 for an empty set) and bands, a hash for each band."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("digest", T.BinaryType()), *long("n_shingles", "node"), T.StructField("bands", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for sets in document_sets(batch.column(1), o.width):
                bands: list[bytes | None] = [None] * len(sets)
                if full := [i for i, s in enumerate(sets) if len(s)]:
                    signed = signatures([sets[i] for i in full], o.bands * o.rows).astype(U64).reshape(len(full), o.bands, o.rows)
                    total = np.zeros((len(full), o.bands), U64)
                    for r in range(o.rows):
                        total = mix64(total * U64(0xD6E8FEB86659FD93) + signed[:, :, r] + U64(1))
                    for i, row in zip(full, total, strict=True):
                        bands[i] = row.tobytes()
                ids, digests = (batch.column(i).slice(low, len(sets)) for i in (0, 2))
                low += len(sets)
                yield pa.RecordBatch.from_arrays([ids, digests, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else 0 for s in sets], pa.int64()), pa.array(bands, pa.binary())], schema.names)

    return docs.select(id_col, text_col, _digest(text_col)).mapInArrow(run, schema)


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


_MEMBER = T.StructType([*long("bucket", "node"), T.StructField("tags", T.BinaryType())])


def _members(nodes: DataFrame, o: NearDup) -> DataFrame:
    """A row for each node and band: the bucket, and a byte of each band beginning with this one (which the bucket shares)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                hashes = np.frombuffer(b"".join(part.column(1).to_pylist()), U64).reshape(-1, o.bands)
                tags = (hashes >> U64(56)).astype(np.uint8)
                tags = np.concatenate([tags, tags], axis=1)
                for k in range(o.bands):
                    turned = np.ascontiguousarray(tags[:, k : k + o.bands])
                    buckets = mix64(hashes[:, k] + U64(k)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(buckets), part.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(o.bands), len(turned), [None, pa.py_buffer(turned)]).cast(pa.binary())], _MEMBER.names)

    return nodes.select("node", "bands").mapInArrow(run, _MEMBER)


def _common(a: pa.Array, b: pa.Array, bands: int) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, bands) for c in (a, b))
    return (x == y).sum(axis=1)


_SHARED = T.StructType([*_MEMBER, *long("next"), T.StructField("next_tags", T.BinaryType())])


def _shared(members: DataFrame) -> DataFrame:
    """The members that share a bucket, each with the next one of its bucket, in ranges of the order (bucket, tags, node).

    A range's first and last row stay whatever they share, and have no neighbour
    in the range beside; step 2 sees to these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, with_last = None, True  # the row before, which waits for its neighbour; whether it is to stay anyway
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            bucket, n = rows.column(0).to_numpy(), rows.num_rows
            same = bucket[1:] == bucket[:-1]
            stays = same | np.concatenate([[with_last], same[:-1]]) if n > 1 else same
            following = rows.slice(1)
            nexts = [pa.array(following.column(1).to_numpy(), mask=~same), pa.array(following.column(2).to_pylist(), pa.binary(), mask=~same)]
            done = pa.Table.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.slice(0, n - 1).columns), *nexts], _SHARED.names)
            yield from done.filter(pa.array(stays)).combine_chunks().to_batches()
            with_last = bool(same[-1]) if n > 1 else True
            last = rows.slice(n - 1).to_batches()[0]
        if last is not None:
            yield pa.RecordBatch.from_arrays([*last.columns, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], _SHARED.names)

    return members.repartitionByRange("bucket", "tags", "node").sortWithinPartitions("bucket", "tags", "node").mapInArrow(run, _SHARED)


_PAIR = T.StructType(long("a", "b", "common"))


def _neighbours(shared: DataFrame, o: NearDup) -> DataFrame:
    """Candidate pairs of step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = _common(batch.column(1), batch.column(3), o.bands)
            a, b = (batch.column(i).to_numpy() for i in (0, 2))
            ok = common >= o.least_common_bands
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(common[ok].astype(np.int64))], _PAIR.names)

    return shared.where("next is not null").select("node", "tags", "next", "next_tags").mapInArrow(run, _PAIR).distinct()


_HELD = T.StructType([*long("bucket", "node", "label"), T.StructField("tags", T.BinaryType())])
_LINK = T.StructType(long("a", "b"))


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one bucket (column 0) at a time; they arrive in order."""
    at, held = None, []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if held and at != bucket[low]:
                yield held
                held = []
            at = bucket[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield held


def _ranks(labels: np.ndarray) -> np.ndarray:
    """A number for each row by its label, the largest group's greatest: that group is compared with, never from."""
    values, place, counts = np.unique(labels, return_inverse=True, return_counts=True)
    order = np.argsort(counts, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return rank[place]


def _apart(shared: DataFrame, labels: DataFrame, o: NearDup) -> DataFrame:
    """The nodes of step 2 by bucket (or pair of its chunks): of another label than some node there with which enough bands agree.

    labels: node, label, size. A bucket's largest component is cut into its own
    chunks, and the rest into theirs. Each of the rest meets all chunks of both;
    a node of the largest component only those of the rest.
    """
    at = shared.select("bucket", "node", "tags").join(labels, "node")
    by_label = at.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed = by_label.groupBy("bucket").agg(F.max(F.struct("n", "size", "label")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("n") > F.col("top.n"))
    chunks = lambda n, size: F.ceil(F.greatest(n / o.bucket_rows, size / o.bucket_items)).cast("int")
    mixed = mixed.select("bucket", F.col("top.label").alias("top"), chunks(F.col("top.n"), F.col("top.size")).alias("of_top"), chunks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("of_rest"))
    at = at.join(mixed, "bucket").withColumn("is_top", F.col("label") == F.col("top"))
    at = at.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("of_top")).otherwise(F.col("of_rest"))).cast("int"))
    chunk = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda kind, x, y: F.xxhash64("bucket", F.lit(kind), x, y)
    with_top = F.transform(chunk("of_rest"), lambda i: group("top", i, F.col("own")))
    with_rest = F.concat(
        F.transform(chunk("of_rest"), lambda i: group("rest", F.least(i, F.col("own")), F.greatest(i, F.col("own")))),
        F.transform(chunk("of_top"), lambda j: group("top", F.col("own"), j)),
    )
    mixed = at.select(F.explode(F.when(F.col("is_top"), with_top).otherwise(with_rest)).alias("bucket"), "node", "label", "tags")
    mixed = mixed.repartition("bucket").sortWithinPartitions("bucket", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _in_buckets(batches):
            rows = pa.Table.from_batches(held).combine_chunks()
            tags = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(-1, o.bands)
            rank = _ranks(rows.column(2).to_numpy())
            hit = np.zeros(len(rank), bool)
            for i in np.flatnonzero(rank < rank.max()):
                near = (rank > rank[i]) & ((tags == tags[i]).sum(axis=1) >= o.least_common_bands)
                if near.any():
                    hit |= near
                    hit[i] = True
            yield from rows.filter(pa.array(hit)).to_batches()

    return mixed.mapInArrow(run, _HELD)


def _bridges(apart: DataFrame, sets: DataFrame, o: NearDup) -> DataFrame:
    """(a, b): pairs of labels that a link joins, verified on full sets; in each bucket at most its labels less one."""
    ordered = apart.join(sets, "node").select("bucket", "node", "label", "items").repartition("bucket").sortWithinPartitions("bucket", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _in_buckets(batches):
            rows = pa.Table.from_batches(held).combine_chunks()
            labels, sets = rows.column(2).to_numpy(), [np.frombuffer(x, U64) for x in rows.column(3).to_pylist()]
            rank, sizes = _ranks(labels), np.array(list(map(len, sets)))
            # the index: for each shingle, the rows that have it
            owner = np.repeat(np.arange(len(sets)), sizes)
            _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
            order = np.argsort(shingle, kind="stable")
            starts = np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
            owners, ends = owner[order], np.cumsum(sizes)
            root = {int(x): int(x) for x in labels}

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            found = []
            for i in np.flatnonzero(rank < rank.max()):
                own = shingle[ends[i] - sizes[i] : ends[i]]
                common = np.bincount(np.concatenate([owners[starts[s] : starts[s + 1]] for s in own]), minlength=len(sets))
                linked = (rank > rank[i]) & (100 * common >= o.percent * (sizes[i] + sizes - common))
                for other in np.unique(labels[linked]).tolist():
                    a, b = find(int(labels[i])), find(other)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        found.append((min(a, b), max(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], _LINK.names)

    return ordered.mapInArrow(run, _LINK)


#: Bits of the map of wanted ids that goes to every executor: 2 MB, whatever the input.
_MAP_BITS = 1 << 24


def _sets_of(docs: DataFrame, ids: DataFrame, o: NearDup, id_col: str, text_col: str) -> DataFrame:
    """(node, items) of the documents whose id is in ids, and of some others.

    Which documents to encode again is told by a bit map of fixed size: a bit
    that others share makes a few more sets, never fewer.
    """
    hashed = F.xxhash64(F.col(id_col))
    place = F.pmod(hashed, F.lit(_MAP_BITS))
    marked = ids.select(place.alias("p")).distinct().select((F.col("p") / 65536).cast("int").alias("block"), (F.col("p") % 65536).cast("int").alias("p"))

    def block(key, table):
        bits = np.zeros(65536, np.uint8)
        bits[table.column("p").to_numpy()] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    parts = marked.groupBy("block").applyInArrow(block, "block int, bits binary").collect()  # at most 256 rows of 8 KB
    wanted = np.zeros(_MAP_BITS // 8, np.uint8)
    for row in parts:
        wanted[row["block"] * 8192 : (row["block"] + 1) * 8192] = np.frombuffer(row["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(wanted.tobytes())
    schema = T.StructType([*long("node"), T.StructField("items", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            p = batch.column(0).to_numpy()
            kept = batch.filter(pa.array((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1))
            for sets in document_sets(kept.column(1), o.width):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema.names)

    return docs.select(place.alias("p"), text_col).mapInArrow(run, schema)


def _full_sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, o: NearDup, id_col: str, text_col: str) -> DataFrame:
    """(node, items) of the nodes asked for."""
    ids = nodes.join(asked, "node", "left_semi").select("id").withColumnRenamed("id", id_col)
    return written(_sets_of(docs, ids, o, id_col, text_col).join(asked, "node", "left_semi").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, o: NearDup, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked."""
    sets = _full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs, o, id_col, text_col)
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                linked = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                    common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= o.percent * max(len(x), len(y)) else 0
                    linked.append(100 * common >= o.percent * (len(x) + len(y) - common))
                yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, _LINK)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs that are among the k with most common bands for one of their nodes."""
    w = Window.partitionBy("node").orderBy(F.desc("common"), "a", "b")
    each = pairs.select("*", F.explode(F.array("a", "b")).alias("node"))
    return each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("a", "b").distinct()


def _grouped(docs: DataFrame, o: NearDup, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and (node, label): for each node the least of its component."""
    signed = written(_signed(docs, o, id_col, text_col))
    nodes = written(signed.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("bands").alias("bands"), F.max("n_shingles").alias("size")))
    shared = written(_shared(_members(nodes, o)))
    labels = written(components(_verified(written(_best(_neighbours(shared, o), 3)), nodes, docs, o, id_col, text_col)))
    sized = nodes.select("node", "size").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "size")
    apart = written(_apart(shared, sized, o))
    if not apart.isEmpty():
        sets = _full_sets(apart.select("node").distinct(), nodes, docs, o, id_col, text_col)
        joined = written(_bridges(apart, sets, o))
        if not joined.isEmpty():
            over = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
            own = nodes.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            labels = written(own.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
    named = nodes.select("node").join(labels, "node", "left")
    return signed, named.select("node", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, o: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (the least id reachable, its own included), kept (id = component_id).

    A null or wordless text has an empty set and is linked with nothing. A
    text of fewer words than a shingle has one item, its whole sequence.
    Repeated rows are in one component; all rows of its least id are kept.
    Null ids count as greater than all others. An empty table gives an empty
    result. Only the id and text columns are read.
    """
    signed, named = _grouped(docs, o, id_col, text_col)
    least = signed.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("id")).join(named, "node").groupBy("label").agg(F.min("id").alias("component_id"))
    by_node = named.join(least, "label").select("node", "component_id")
    out = signed.join(by_node, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, o: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each group of near-duplicates: that of the least id (and then text digest).

    Of rows with equal id and text one stays, the first by its other columns as
    JSON; rows with empty sets all stay.
    """
    signed, named = _grouped(docs, o, id_col, text_col)
    rows = signed.where("n_shingles > 0").groupBy("id", "digest").agg(F.max("node").alias("node"), F.count("*").alias("n"))
    rows = written(rows.join(named, "node").withColumn("order", F.struct(F.col("id").isNull(), "id", "digest")).drop("node"))
    first = rows.groupBy("label").agg(F.min("order").alias("first"))
    gone = rows.join(first, "label").where(F.col("order") > F.col("first")).select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    kept = docs.toDF(*names).withColumn("digest", _digest(text))
    kept = kept.join(gone, (F.col("digest") == F.col("gone_digest")) & F.col(own).eqNullSafe(F.col("gone_id")), "left_anti")
    if not rows.where("n > 1").isEmpty():
        words = F.col(text).rlike(r"[^\x20\x09-\x0D]")
        nth = F.row_number().over(Window.partitionBy(own, "digest").orderBy(F.to_json(F.struct(*names))))
        kept = kept.withColumn("nth", nth).where((F.col("nth") == 1) | ~F.coalesce(words, F.lit(False)))
    return kept.select(*names).toDF(*docs.columns)
