"""A hierarchical Pitman-Yor language model of three words, its seating sampled by Gibbs.

Restaurants: every context of two words seen in training has one of its own;
those that share the later word share that word's restaurant as parent; all of
these share the unigram restaurant, whose base is uniform over the V words met
in training and one unknown. Texts begin with two start marks.

How it is dealt out: a part of the corpus is what follows a set of words, so a
word's restaurant, its children and all their cells (context and next word) are
in one shard. Only unigram cells are needed by all; they lie in shards by word,
and shards send each other numbers of tables and customers of the words that
both have. Two bounded lists keep frequent contexts from being one task's:

- a word with 1/1024 of the training tokens or more is hot: its children are
  dealt out by themselves, and its own cells by their next word, with the
  unigram ones;
- a context of two words with as many is hot as well: its cells are dealt out
  by their next word.

The totals of hot restaurants (2,048 at most) go by way of the driver; those of
all others never leave their shard. The lists decide where cells lie, and no
more: which cells there are and what they count doesn't depend on them.

A round: every shard sweeps its cells some times, bottom up, each half of a
restaurant's cells given the other half's new tables, and sends the words their
customers; then the words' shards sweep theirs, and send them back. A cell's
number of tables is drawn exactly from its conditional by generalised Stirling
numbers, its own tables taken out of the parent, for cells of up to ``exact``
customers; larger cells seat their customers in turn, in blocks that grow with
those seated. Shards draw against what the others had in the round before, the
usual distributed approximation. Predictive probabilities are averaged over the
rounds after the burn-in rounds, if any (a round's sweeps come before its
sample); the log likelihood of the training tokens is traced in each.

Scoring deals out each document's tokens the same way. What a shard cannot know
(a next word that none of its contexts had) it passes to the word's shard with
the weights of backing off. A document's log10 probability is the sum over its
tokens of log10 of the averaged predictive probability.

Defined cases: a null text counts as empty and has its end token alone;
repeated rows each count in training and each get their score; a null id is
trained on (crc32 of null is null). An empty training set scores by the uniform
base. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._frames import long, settings, shared_folder, written
from ._text import U64, mix64, word_chunks

#: Words are known by 48 bits of their hash: two of a million words share one once in 500 corpora.
_CUT = U64(16)
#: The hashes of the end token and the start mark.
END, START = (mix64(np.array([x], U64))[0] >> _CUT for x in (0xE0D, 0x57A7))
#: Texts are counted in chunks of about this many bytes.
_CHUNK = 24 << 20
#: So many words at most are sent as places, which are a few bits where hashes are some four bytes.
_COMMON = 1 << 17
#: So many pairs of cell and text at most wait in a shard to be passed on together, and so many bytes of messages to be answered together.
_WAITING, _WAITING_BYTES = 1 << 20, 4 << 20
_NONE = np.zeros(0, U64)


@dataclass(frozen=True)
class Model:
    """hot_share: see above. discounts and strengths: of contexts of two words, of one, and of the unigram restaurant. sweeps: of a shard in a round."""

    hot_share: int = 1024
    discounts: tuple[float, float, float] = (0.85, 0.8, 0.8)
    strengths: tuple[float, float, float] = (1.0, 2.0, 50.0)
    burn_in: int = 0
    samples: int = 2
    sweeps: int = 3
    exact: int = 32
    words_per_shard: int = 1_400_000
    seed: int = 17


# ---- drawing tables


def stirling_logs(discount: float, most: int) -> np.ndarray:
    """log S(c, t) for c, t up to most: generalised Stirling numbers of type (-1, -discount, 0)."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = s[c, t] + np.log(np.maximum(c - t * discount, 0))
        s[c + 1, t] = np.logaddexp(stay, s[c, t - 1])
    return s


@dataclass
class Parent:
    """The parent's cells without the children's own tables: customers, tables, the mass of backing off, all customers and strength."""

    c: np.ndarray
    t: np.ndarray
    back: np.ndarray
    mass: np.ndarray
    discount: float

    def probability(self, added: int = 0) -> np.ndarray:
        """Of the word, once ``added`` more customers have been sent."""
        c = self.c + added
        return (np.where(c > 0, np.maximum(c - self.discount * np.maximum(self.t, 1), 0), 0) + self.back) / (self.mass + added)

    def take(self, at: np.ndarray) -> Parent:
        return Parent(self.c[at], self.t[at], self.back[at], self.mass[at], self.discount)


def draw_tables(c: np.ndarray, base: np.ndarray | Parent, others: np.ndarray, discount: float, strength: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells of c customers, given the parent (a fixed probability, or one that grows with each table sent) and the tables of the restaurant's other cells."""
    t = np.minimum(c, 1)
    exact = len(stirling) - 1
    order = np.argsort(c, kind="stable")
    counts = c[order]
    for n in np.flatnonzero(np.bincount(counts[(counts >= 2) & (counts <= exact)])).tolist():
        low, high = np.searchsorted(counts, [n, n + 1])
        for a in range(low, high, 32768):
            cell = order[a : min(high, a + 32768)]
            parent = base.take(cell) if isinstance(base, Parent) else base[cell]
            tables, weights = strength + discount * others[cell], np.ones((n, len(cell)))
            for k in range(1, n):  # of k + 1 tables against k
                np.multiply(tables + discount * k, parent.probability(k) if isinstance(base, Parent) else parent, out=weights[k])
                weights[k] *= np.exp(stirling[n, k + 1] - stirling[n, k])
            if n <= 8:  # few enough factors for a float's range
                np.cumprod(weights, axis=0, out=weights)
            else:
                logs = np.cumsum(np.log(weights, out=weights), axis=0, out=weights)
                weights = np.exp(logs - logs.max(axis=0))
            p = np.cumsum(weights, axis=0, out=weights)
            t[cell] = 1 + (p < rng.random(len(cell)) * p[-1]).sum(axis=0)
    large = order[np.searchsorted(counts, exact + 1) :]
    if len(large):
        fixed = base.take(large).probability() if isinstance(base, Parent) else base[large]
        t[large] = seat_in_turn(c[large], fixed, others[large], discount, strength, rng)
    return t


def seat_in_turn(c: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each cell's customers in turn; a block is one customer or 1/32 of those seated."""
    t = np.ones(len(c), np.int64)
    order = np.argsort(-c, kind="stable")
    ascending = -c[order]
    seated = 1
    while True:
        n = int(np.searchsorted(ascending, -seated, "left"))
        if not n:
            return t
        cell = order[:n]
        block = np.minimum(c[cell], seated + max(1, seated // 32)) - seated
        new = (strength + discount * (others[cell] + t[cell])) * base[cell]
        old = np.maximum(seated - discount * t[cell], 1e-12)
        t[cell] += rng.binomial(block, new / (new + old))
        seated += max(1, seated // 32)


# ---- rows that carry arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: whole numbers in as few bytes as hold them, byte by byte, compressed."""
    head, body = [], []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype.kind in "iu" and a.dtype != U64:
            most = int(a.max()) if len(a) else 0
            a = a.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(k).max))
        head.append((ord(a.dtype.kind), a.dtype.itemsize, len(a)))
        body.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes())
    return zstandard.compress(np.array([len(head), *np.ravel(head)], np.int64).tobytes() + b"".join(body), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays again; whole numbers as int64 (hashes as uint64)."""
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(-1, 3), 8 + 24 * n, []
    for kind, size, length in head.tolist():
        a = np.empty((length, size), np.uint8)
        for k, row in enumerate(np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)):
            a[:, k] = row
        a = a.view(f"{chr(kind)}{size}").ravel()
        at += size * length
        out.append(a if chr(kind) == "f" or (chr(kind), size) == ("u", 8) else a.astype(np.int64))
    return out


#: key: the shard that a row goes to; origin: the one (or the chunk) that it comes from.
_ROW = T.StructType([*long("key"), T.StructField("kind", T.StringType()), *long("origin"), T.StructField("blob", T.BinaryType()), *long("a", "b"), T.StructField("x", T.DoubleType())])
_ARROW = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r, *[None] * (7 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in full], kind) for k, kind in enumerate(_ARROW)], _ROW.names)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Each key (column 0, in order) with its rows, one at a time."""
    each = (dict(zip(batch.schema.names, row, strict=True)) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, rows in groupby(each, lambda r: r["key"]):
        yield key, rows


def _by_key(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "key").sortWithinPartitions("key", "origin")


#: Of tables of blobs: these are compressed already, and a page and a row group are closed after a few of them, where 100 rows or 128 MB would be held otherwise.
_BLOBS = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1"}


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """df as a table in the shared folder that joins by key find dealt out already."""
    name = f"factloom_{uuid4().hex}"
    df.write.options(**_BLOBS).format("parquet").bucketBy(n, "key").option("path", f"{shared_folder(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def _settings(spark: SparkSession) -> AbstractContextManager[None]:
    """Within, a query's shuffle files go when it has ended (what later ones need is in tables), and blobs are read a few at a time."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.columnarReaderBatchSize": "64"})


# ---- tokens and where they lie


@dataclass
class Layout:
    """Hot words and hot contexts (sorted hashes), the number of shards, and some common words that are sent as their places."""

    words: np.ndarray
    pairs: np.ndarray
    n: int
    common: np.ndarray = field(default_factory=lambda: _NONE)

    def shard(self, v: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of the cells of context (x, v) and word w."""
        hot, route = np.flatnonzero(_is_in(v, self.words)), v.copy()
        route[hot] = pair = pair_hash(v[hot], x[hot])
        split = np.flatnonzero(_is_in(pair, self.pairs))  # of a hot context the word is hot
        route[hot[split]] = mix64(pair[split] + w[hot[split]] * U64(0x9E3779B97F4A7C15))
        return shard_of(route, self.n)


def pair_hash(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mix64(v * U64(0xD6E8FEB86659FD93) + x)


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((mix64(hashes) >> U64(33)) % U64(n)).astype(np.int64)


def _place(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each value is in the sorted array, -1 where it is not."""
    if not len(among):
        return np.full(len(values), -1)
    place = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[place] == values, place, -1)


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each hash is in the sorted array; a table of low bits passes over most that are not."""
    table = np.zeros(1 << 16, bool)
    table[among.view(np.int64) & 0xFFFF] = True
    found = table[values.view(np.int64) & 0xFFFF]
    at = np.flatnonzero(found)
    found[at] = _place(values[at], among) >= 0
    return found


def order_of(values: np.ndarray, most: int) -> np.ndarray:
    """The stable order of whole numbers from 0 to most: sorted with their places in the low bits, several times as fast as argsort."""
    n, bits = len(values), len(values).bit_length()
    shift = max(0, most.bit_length() + bits - 64)
    packed = (values.astype(U64) >> U64(shift) << U64(bits)) | np.arange(n, dtype=U64)
    order = (np.sort(packed) & U64((1 << bits) - 1)).astype(np.int64)
    if shift:  # different numbers may be alike in the bits kept
        ordered = values[order]
        if (ordered[1:] < ordered[:-1]).any():
            return np.argsort(values, kind="stable")
    return order


def distinct(values: np.ndarray) -> np.ndarray:
    """As np.unique, which hashes and is many times slower where most values differ."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes, if they fit: a shard holds many arrays of its cells' length."""
    return a.astype(np.int32) if not len(a) or max(int(a.max()), -int(a.min())) <= np.iinfo(np.int32).max else a


def places_of(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (0 to most), sorted, and where each value is among them."""
    order = order_of(values, most)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    places = np.empty(len(values), np.int64)
    places[order] = np.cumsum(new) - 1
    return ordered[new], places


def tokens_of(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some texts (each text's words, then its end): text, place in the text (2 for all from the third on) and w."""
    n = len(at) - 1
    ends, starts = at[1:] + np.arange(n), at[:-1] + np.arange(n)
    w = np.empty(len(words) + n, U64)
    is_end = np.zeros(len(w), bool)
    is_end[ends] = True
    w[is_end], w[~is_end] = END, words >> _CUT
    place = np.full(len(w), 2, np.int8)
    place[starts[ends > starts] + 1] = 1
    place[starts] = 0
    return np.repeat(np.arange(n, dtype=np.int32), np.diff(at) + 1), place, w


def contexts_of(at: np.ndarray | slice, place: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and v of the tokens at these places."""
    at = np.arange(*at.indices(len(w))) if isinstance(at, slice) else at
    return np.where(place[at] < 2, START, w[np.maximum(at - 2, 0)]), np.where(place[at] < 1, START, w[np.maximum(at - 1, 0)])


@dataclass
class Part:
    """What some texts have of a shard: the distinct cells (x, v, w as places in ``names``), and the tokens' texts, cell after cell."""

    shard: int
    names: np.ndarray
    x: np.ndarray
    v: np.ndarray
    w: np.ndarray
    starts: np.ndarray
    texts: np.ndarray

    def packed(self, *more: np.ndarray, common: np.ndarray = _NONE) -> bytes:
        names = [self.names.view(np.int64)]
        if len(common):
            place = _place(self.names, common)
            names = [names[0][place < 0], place[place >= 0]]
        return pack(*(np.diff(k, prepend=0) for k in names), self.x, self.v, self.w, *more)


def named(arrays: list[np.ndarray], common: np.ndarray = _NONE) -> list[np.ndarray]:
    """The arrays of a packed part, the names (sent as differences, those of common words as their places) first."""
    names = np.cumsum(arrays[0]).astype(U64)
    if not len(common):
        return [names, *arrays[1:]]
    return [np.sort(np.concatenate([names, common[np.cumsum(arrays[1])]])), *arrays[2:]]


def by_cell(x: np.ndarray, v: np.ndarray, w: np.ndarray, d: int) -> np.ndarray:
    """The order of tokens by v, x and w (places among d names); equal ones stay in order."""
    if (d**3).bit_length() + len(w).bit_length() <= 64:
        return order_of((v.astype(U64) * U64(d) + x.astype(U64)) * U64(d) + w.astype(U64), d**3)
    order = order_of(w, d)
    return order[order_of((v * d + x)[order], d * d)]


def parts_of(words: np.ndarray, at: np.ndarray, layout: Layout) -> Iterator[Part]:
    text, place, w = tokens_of(words, at)
    shard = np.empty(len(w), np.uint16 if layout.n <= 65536 else np.int64)
    for low in range(0, len(w), 1 << 18):
        some = slice(low, min(len(w), low + (1 << 18)))
        x, v = contexts_of(some, place, w)
        shard[some] = layout.shard(v, x, w[some])
    order = narrow(np.argsort(shard, kind="stable"))
    cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=layout.n)))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[s] : cuts[s + 1]]
        x, v = contexts_of(own, place, w)
        names, places = places_of(np.concatenate([x, v, w[own]]), (1 << 48) - 1)
        x, v, ws = np.split(places, 3)
        cell = by_cell(x, v, ws, len(names))
        x, v, ws = x[cell], v[cell], ws[cell]
        starts = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(v, prepend=-1) != 0) | (np.diff(ws, prepend=-1) != 0))
        yield Part(s, names, x[starts], v[starts], ws[starts], starts, text[own[cell]])


def _perhaps(hashes: np.ndarray, share: int, n: int) -> np.ndarray:
    """Those that may hold the share of n, by how often their low bits occur: the others need no sorting."""
    low = hashes.view(np.int64) & 0xFFFF
    return hashes[(np.bincount(low, minlength=1 << 16) * share >= n)[low]]


def _layout(train: DataFrame, m: Model, text_col: str) -> tuple[Layout, int]:
    """Hot words and contexts, summed over the chunks in which they hold the share; and the number of training tokens.

    Common words are those that the first texts repeat: they shorten what is sent, and nothing depends on which they are.
    """

    def hot_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() < 4
        for batch in batches:
            for _, _, words, at in word_chunks(batch.column(0), lower=True, chunk_bytes=_CHUNK // 4):
                _, place, w = tokens_of(words, at)
                if first:
                    value, n = np.unique(w, return_counts=True)
                    some = np.argsort(-n, kind="stable")[: min(_COMMON, int((n > 1).sum()))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), 3)), pa.array(value[some].view(np.int64)), pa.array(n[some])], ["kind", "hash", "n"])
                    first = False
                x, v = contexts_of(slice(None), place, w)
                value, n = np.unique(_perhaps(v, m.hot_share, len(w)), return_counts=True)
                heavy = n * m.hot_share >= len(w)
                own = _is_in(v, value[heavy])
                pairs, k = np.unique(_perhaps(pair_hash(v[own], x[own]), m.hot_share, len(w)), return_counts=True)
                ok = k * m.hot_share >= len(w)
                kinds = [0] + [1] * int(heavy.sum()) + [2] * int(ok.sum())
                hashes = np.concatenate([[0], value[heavy].view(np.int64), pairs[ok].view(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(hashes.astype(np.int64)), pa.array(np.concatenate([[len(w)], n[heavy], k[ok]]).astype(np.int64))], ["kind", "hash", "n"])

    rows = written(train.select(text_col).mapInArrow(hot_of, T.StructType(long("kind", "hash", "n"))).groupBy("kind", "hash").agg(F.sum("n").alias("n")))
    total = int(rows.where("kind = 0").agg(F.sum("n")).first()[0] or 0)
    hot = rows.where(F.col("kind").isin(1, 2) & (F.col("n") * m.hot_share >= total)).collect()  # hot_share rows of each kind at most
    lists = [np.sort(np.array([r["hash"] for r in hot if r["kind"] == k], np.int64).view(U64)) for k in (1, 2)]
    common = rows.where("kind = 3").orderBy(F.col("n").desc(), "hash").limit(_COMMON).select("hash").toArrow().column(0).to_numpy()
    return Layout(*lists, max(16, -(-total // m.words_per_shard)), np.sort(common.astype(np.int64).view(U64))), total


def _counted(train: DataFrame, layout: Layout, text_col: str) -> DataFrame:
    """Every shard's cells with their customers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, at in word_chunks(batch.column(0), lower=True, chunk_bytes=_CHUNK):
                for p in parts_of(words, at, layout):
                    yield _rows([(p.shard, "count", 0, p.packed(np.diff(p.starts, append=len(p.texts)), common=layout.common))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_key(batches):
            yield _rows(all_cells(shard, (named(unpack(r["blob"]), layout.common) for r in rows)))

    return _bucketed(_by_key(train.select(text_col).mapInArrow(count, _ROW), layout.n).mapInArrow(merge, _ROW), layout.n)


def _counted_from(asks: DataFrame, layout: Layout) -> DataFrame:
    """As _counted, from what the texts will ask: they are read, hashed and dealt out once for both."""

    def merge(rows: pa.Table) -> pa.Table:
        parts = (trained_on(named(unpack(blob.as_py()), layout.common)) for blob in rows.column("blob"))
        return pa.Table.from_batches([_rows(all_cells(rows.column("key")[0].as_py(), parts))])

    return _bucketed(asks.where("kind = 'ask'").select("key", "blob").groupBy("key").applyInArrow(merge, _ROW), layout.n)


def trained_on(ask: list[np.ndarray]) -> list[np.ndarray]:
    """The cells of an ask that training texts have, with their customers there."""
    names, x, v, w, *_, n = ask
    own = n > 0
    if own.all():
        return [names, x, v, w, n]
    x, v, w, n = x[own], v[own], w[own], n[own]
    used = np.zeros(len(names), bool)
    for k in (x, v, w):
        used[k] = True
    at = np.cumsum(used) - 1
    return [names[used], at[x], at[v], at[w], n]


def all_cells(shard: int, parts: Iterator[list[np.ndarray]]) -> list[tuple]:
    """The row of a shard's cells put together; none if it has none."""
    held, waiting, size = None, [], 0
    for part in parts:
        waiting.append(part)
        size += len(part[4])
        if size > 1_000_000 and size > (len(held[4]) if held else 0):
            held, waiting, size = merged([*([held] if held else []), *waiting]), [], 0
    if size:
        held = merged([*([held] if held else []), *waiting])
    return [(shard, "cells", 0, pack(np.diff(held[0].view(np.int64), prepend=0), *held[1:]))] if held else []


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Cells (words, places of x, v and w, customers) put together, sorted by v, x and w."""
    words = distinct(np.concatenate([p[0] for p in parts]))
    maps = [np.searchsorted(words, p[0]) for p in parts]
    x, v, w = (np.concatenate([m[p[k]] for m, p in zip(maps, parts, strict=True)]) for k in (1, 2, 3))
    n = np.concatenate([p[4] for p in parts])
    d = len(words)
    order = by_cell(x, v, w, d)
    x, v, w = x[order], v[order], w[order]
    first = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(v, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
    return [words, x[first], v[first], w[first], np.add.reduceat(n[order], first)]


# ---- sampling


@dataclass
class Totals:
    """Customers and tables of the unigram restaurant, of hot words and of hot contexts; V, the words met."""

    unigram: tuple[int, int] = (0, 0)
    words: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    n_words: int = 0

    def word_probability(self, c: np.ndarray, t: np.ndarray, m: Model) -> np.ndarray:
        d, a = m.discounts[2], m.strengths[2]
        return (np.maximum(c - d * t, 0) + (a + d * self.unigram[1]) / (self.n_words + 1)) / (a + self.unigram[0])


class Shard:
    """A shard's cells, and the state of its restaurants.

    r: the restaurant of each cell; b: its parent cell (v, w); the parent cells
    have their word (place in ``next``) and restaurant (place in ``own``).
    """

    def __init__(self, blob: bytes, layout: Layout, seated: bool = True):
        """seated: with one table a cell; else a state is restored before anything else."""
        words, x, v, w, n = named(unpack(blob))
        self.n, d = narrow(n), len(words)
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (x[1:] != x[:-1])
        self.r = narrow(np.cumsum(new) - 1)
        self.r_pair = pair_hash(words[v[new]], words[x[new]])
        self.hot_pair = narrow(_place(self.r_pair, layout.pairs))
        pairs = v * d + w
        del x, v, w, n, new  # each as long as the cells
        keys, b = places_of(pairs, d * d)
        self.b = narrow(b)
        del pairs, b
        own, own_at = places_of(keys // d, d)
        following, next_at = places_of(keys % d, d)
        self.own_at, self.next_at = narrow(own_at), narrow(next_at)
        self.own, self.next = words[own], words[following]
        hot = narrow(_place(self.own, layout.words))
        self.hot_cell = hot[self.own_at]  # -1: the cell is the shard's own
        self.local = self.hot_cell < 0
        self.hot = hot
        # what goes to each shard of words: their order, and that of hot cells
        self.word_shard = shard_of(self.next, layout.n)
        self.word_order = narrow(np.argsort(self.word_shard.astype(np.min_scalar_type(layout.n)), kind="stable"))  # few bytes sort by radix
        cells = np.flatnonzero(~self.local)
        self.hot_order = narrow(cells[np.argsort(self.word_shard[self.next_at[cells]], kind="stable")])
        self.receivers = np.flatnonzero(np.bincount(self.word_shard))
        self.customers = np.bincount(self.r, self.n, len(self.r_pair))
        if seated:
            self.restore(np.minimum(self.n, 1), np.ones(len(keys), np.int64))

    def sent(self, first: bool) -> list[tuple[int, bytes]]:
        """For each shard of words: the words' customers from here and the hot cells' customers (with their names, the first time)."""
        up = np.bincount(self.next_at[self.local], self.t2[self.local], len(self.next)).astype(np.int64)
        tokens = np.bincount(self.next_at[self.b], self.n, len(self.next)).astype(np.int64) if first else None
        out = []
        for q, words, cells in self.receiving():
            arrays = [up[words], self.c2[cells]]
            if first:
                arrays += [self.next[words], tokens[words], self.hot_cell[cells], np.searchsorted(self.next[words], self.next[self.next_at[cells]])]
            out.append((q, pack(*arrays)))
        return out

    def receiving(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard of words, places of words, hot cells): how messages to and from it are ordered."""
        of_word, of_cell = self.word_shard[self.word_order], self.word_shard[self.next_at[self.hot_order]]
        for q in self.receivers.tolist():
            a, b = np.searchsorted(of_word, [q, q + 1])
            e, f = np.searchsorted(of_cell, [q, q + 1])
            yield q, self.word_order[a:b], self.hot_order[e:f]

    def restore(self, t: np.ndarray, t2: np.ndarray) -> None:
        """Takes a state, and sums what restaurants and parent cells have of it; draws keep the sums up to date."""
        self.t, self.t2 = narrow(t), narrow(t2)
        self.c2 = np.bincount(self.b, t, len(self.own_at)).astype(np.int64)
        self.tables = np.bincount(self.r, t, len(self.r_pair)).astype(np.int64)
        self.own_customers = np.bincount(self.own_at, self.c2, len(self.own)).astype(np.int64)
        self.own_tables = np.bincount(self.own_at, t2, len(self.own)).astype(np.int64)

    def hear(self, told: dict[int, bytes], totals: Totals, m: Model) -> None:
        """Takes in what the words' shards tell: unigram cells, and the hot cells (whose customers come from many shards)."""
        c1, t1 = np.zeros(len(self.next)), np.zeros(len(self.next))
        self.hot_c, self.hot_t, self.tokens = np.zeros(len(self.own_at)), np.zeros(len(self.own_at)), np.zeros(len(self.next))
        for q, words, cells in self.receiving():
            c1[words], t1[words], self.hot_c[cells], self.hot_t[cells], self.tokens[words] = unpack(told[q])
        self.p1, self.totals = totals.word_probability(c1, t1, m), totals
        self.heard_c2, self.heard_tables, self.heard_own = self.c2.copy(), self.tables.copy(), self.own_customers.copy()

    def level_two(self, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Customers and tables of the cells (v, w) at these places, then of all their restaurants, wherever they lie."""
        local, own = self.local[at], self.c2[at]
        c2 = np.where(local, own, self.hot_c[at] + own - self.heard_c2[at])
        t2 = np.where(local, self.t2[at], self.hot_t[at])
        customers, tables = self.own_customers.astype(float), self.own_tables.astype(float)
        if len(self.totals.words):
            known = np.flatnonzero(self.hot >= 0)
            whole = self.totals.words[self.hot[known]]
            customers[known], tables[known] = whole[:, 0] + customers[known] - self.heard_own[known], whole[:, 1]
        return c2, t2, customers, tables

    def level_three(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the contexts of two words."""
        customers, tables = self.customers.astype(float), self.tables.astype(float)
        known = np.flatnonzero(self.hot_pair >= 0)
        if len(known):
            whole = self.totals.pairs[self.hot_pair[known]]
            customers[known] = whole[:, 0]
            tables[known] += whole[:, 1] - self.heard_tables[known]
        return customers, tables

    def sweep(self, m: Model, rng: np.random.Generator, stirling: list[np.ndarray]) -> None:
        """Draws the tables of all cells anew: contexts of two words, then the shard's own of one, each in two halves."""
        (d3, d2, _), (a3, a2, _) = m.discounts, m.strengths
        active = np.flatnonzero(self.n > 1)
        half = rng.random(len(active)) < 0.5
        for at in (active[half], active[~half]):
            b = self.b[at]
            c2, t2, c_own, t_own = self.level_two(b)
            tables, o, old = self.level_three()[1], self.own_at[b], self.t[at]
            c0 = c2 - old
            parent = Parent(c0, np.minimum(t2, c0), (a2 + d2 * t_own[o]) * self.p1[self.next_at[b]], a2 + c_own[o] - old, d2)
            self.t[at] = draw_tables(self.n[at], parent, np.maximum(tables[self.r[at]] - old, 0), d3, a3, stirling[0], rng)
            moved = np.flatnonzero(more := self.t[at] - old)
            more = more[moved]
            np.add.at(self.c2, b[moved], more)
            np.add.at(self.tables, self.r[at[moved]], more)
            np.add.at(self.own_customers, o[moved], more)
        fewer = np.flatnonzero(self.local & (self.t2 > self.c2))
        np.subtract.at(self.own_tables, self.own_at[fewer], self.t2[fewer] - self.c2[fewer])
        self.t2[fewer] = self.c2[fewer]
        active = np.flatnonzero(self.local & (self.c2 > 1))
        half = rng.random(len(active)) < 0.5
        for at in (active[half], active[~half]):
            o, old = self.own_at[at], self.t2[at]
            self.t2[at] = draw_tables(self.c2[at], self.p1[self.next_at[at]], np.maximum(self.own_tables[o] - old, 0), d2, a2, stirling[1], rng)
            np.add.at(self.own_tables, o, self.t2[at] - old)

    def probabilities(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the cells and of the parent cells; and the weights of backing off, from contexts of two words and of one."""
        (d3, d2, _), (a3, a2, _) = m.discounts, m.strengths
        c2, t2, c_own, t_own = self.level_two()
        back2 = (a2 + d2 * t_own) / (a2 + c_own)
        p2 = np.maximum(c2 - d2 * t2, 0) / (a2 + c_own[self.own_at]) + back2[self.own_at] * self.p1[self.next_at]
        customers, tables = self.level_three()
        back3 = (a3 + d3 * tables) / (a3 + customers)
        p3 = self.t * -d3  # step by step, in place
        p3 += self.n
        np.maximum(p3, 0, out=p3)
        p3 /= (a3 + customers)[self.r]
        more = back3[self.r]
        more *= p2[self.b]
        p3 += more
        return p3, p2, back3, back2


class Words:
    """A shard of words: unigram cells, and the cells of hot words; for each shard that has some of them, which."""

    def __init__(self, arrays: list[np.ndarray]):
        self.words, self.tokens, self.hot, self.hot_at, self.origins = arrays[:5]
        self.maps = {s: (arrays[5 + 2 * k], arrays[6 + 2 * k]) for k, s in enumerate(self.origins.tolist())}

    @staticmethod
    def first(told: dict[int, bytes]) -> Words:
        parts = {s: unpack(x) for s, x in told.items()}
        words = distinct(np.concatenate([p[2] for p in parts.values()]))
        d, tokens, keys, places = len(words), np.zeros(len(words), np.int64), [], {}
        for s, p in parts.items():
            places[s] = np.searchsorted(words, p[2])
            tokens[places[s]] += p[3]
            keys.append(p[4] * d + places[s][p[5]])
        cells = distinct(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        maps = [a for s, k in zip(parts, keys, strict=True) for a in (places[s], np.searchsorted(cells, k))]
        return Words([words, tokens, cells // d, cells % d, np.array(list(parts)), *maps])

    def packed(self) -> bytes:
        return pack(self.words, self.tokens, self.hot, self.hot_at, self.origins, *(a for s in self.origins.tolist() for a in self.maps[s]))

    def hear(self, told: dict[int, bytes]) -> None:
        self.up, self.c2 = np.zeros(len(self.words), np.int64), np.zeros(len(self.hot), np.int64)
        for s, x in told.items():
            up, c2 = unpack(x)[:2]
            self.up[self.maps[s][0]] += up
            self.c2[self.maps[s][1]] += c2

    def customers(self) -> np.ndarray:
        return self.up + np.bincount(self.hot_at, self.t2, len(self.words)).astype(np.int64)

    def sweep(self, totals: Totals, m: Model, rng: np.random.Generator, stirling: list[np.ndarray]) -> None:
        (_, d2, d1), (_, a2, a1) = m.discounts, m.strengths
        self.t2 = np.minimum(self.t2, self.c2)
        c1 = self.customers()
        p1 = totals.word_probability(c1, np.minimum(self.t1, c1), m)
        if len(self.hot):
            self.t2 = draw_tables(self.c2, p1[self.hot_at], np.maximum(totals.words[self.hot, 1] - self.t2, 0), d2, a2, stirling[1], rng)
        c1 = self.customers()
        uniform = np.full(len(self.words), 1 / (totals.n_words + 1))
        self.t1 = draw_tables(c1, uniform, np.maximum(totals.unigram[1] - self.t1, 0), d1, a1, stirling[2], rng)

    def rows(self, q: int, layout: Layout) -> list[tuple]:
        """State, what each shard is told, and this shard's share of the totals."""
        c1 = self.customers()
        out = [(q, "words", q, pack(self.t1, self.t2)), (-1, "total", q, None, int(c1.sum()), int(self.t1.sum())), (-2, "total", q, None, len(self.words), 0)]
        for s, (words, cells) in self.maps.items():
            out.append((s, "told", q, pack(c1[words], self.t1[words], self.c2[cells], self.t2[cells], self.tokens[words])))
        customers, tables = (np.bincount(self.hot, x, len(layout.words)).astype(np.int64) for x in (self.c2, self.t2))
        return out + [(int(i), "total", q, None, int(customers[i]), int(tables[i])) for i in np.flatnonzero(customers)]


def _summed(frames: list[DataFrame], layout: Layout) -> Totals:
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows = rows.where("kind = 'total'").groupBy("key").agg(F.sum("a"), F.sum("b")).collect()  # 2 * hot_share + 2 rows at most
    got = {r[0]: (r[1], r[2]) for r in rows}
    n = len(layout.words)
    words = np.array([got.get(i, (0, 0)) for i in range(n)], float).reshape(-1, 2)
    pairs = np.array([got.get(n + i, (0, 0)) for i in range(len(layout.pairs))], float).reshape(-1, 2)
    return Totals(got.get(-1, (0, 0)), words, pairs, got.get(-2, (0, 0))[0])


@dataclass
class Trained:
    """layout and tables of the cells and words; for each sample, its states with what was told and its totals; the trace of log10 likelihoods."""

    layout: Layout
    train_tokens: int
    cells: DataFrame
    words: DataFrame
    samples: list[tuple[DataFrame, DataFrame, Totals]]
    trace: list[float]


def train(docs: DataFrame, m: Model = Model(), text_col: str = "text") -> Trained:
    """The model of all texts of docs."""
    layout, total = _layout(docs, m, text_col)
    return _fitted(layout, total, _counted(docs, layout, text_col), m)


def _fitted(layout: Layout, total: int, cells: DataFrame, m: Model) -> Trained:
    n = layout.n
    tables = lambda: [stirling_logs(d, m.exact) for d in m.discounts]

    def pair_totals(s: Shard) -> list[tuple]:
        hot = np.flatnonzero(s.hot_pair >= 0)
        return [(len(layout.words) + int(s.hot_pair[i]), "total", 0, None, int(s.customers[i]), int(s.tables[i])) for i in hot]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_key(batches):
            s = Shard(next(rows)["blob"], layout)
            yield _rows([(key, "state", key, pack(s.t, s.t2)), *((q, "up", key, x) for q, x in s.sent(True)), *pair_totals(s)])

    def begin_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, rows in by_key(batches):
            yield _rows([(q, "lexicon", 0, Words.first({r["origin"]: r["blob"] for r in rows}).packed())])

    def sweep_shard(turn: int, totals: Totals):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            key, s = left.column("key")[0].as_py(), Shard(left.column("blob")[0].as_py(), layout, seated=False)
            told = {r["origin"]: r["blob"] for r in right.to_pylist() if r["kind"] == "told"}
            s.restore(*unpack(next(r["blob"] for r in right.to_pylist() if r["kind"] == "state")))
            s.hear(told, totals, m)
            rng, stirling = np.random.default_rng([m.seed, turn, key]), tables()
            likelihood = float(s.n @ np.log10(s.probabilities(m)[0]))
            for _ in range(m.sweeps):
                s.sweep(m, rng, stirling)
            rows = [(key, "state", key, pack(s.t, s.t2)), *((q, "up", key, x) for q, x in s.sent(False)), *pair_totals(s), (key, "trace", key, None, None, None, likelihood)]
            return pa.Table.from_batches([_rows(rows)])

        return run

    def sweep_words(turn: int, totals: Totals | None):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            q, w = left.column("key")[0].as_py(), Words(unpack(left.column("blob")[0].as_py()))
            w.hear({r["origin"]: r["blob"] for r in right.to_pylist() if r["kind"] == "up"})
            if totals is None:
                w.t2, w.t1 = np.minimum(w.c2, 1), np.ones(len(w.words), np.int64)
            else:
                w.t1, w.t2 = unpack(next(r["blob"] for r in right.to_pylist() if r["kind"] == "words"))
                w.sweep(totals, m, np.random.default_rng([m.seed, turn, q, 1]), tables())
            return pa.Table.from_batches([_rows(w.rows(q, layout))])

        return run

    spark, names = cells.sparkSession, {}

    def saved(df: DataFrame) -> DataFrame:
        df.write.options(**_BLOBS).saveAsTable(name := f"factloom_{uuid4().hex}")
        names[id(out := spark.table(name))] = name
        return out

    def dropped(*frames: DataFrame) -> None:
        for f in frames:
            spark.sql(f"DROP TABLE {names.pop(id(f))}")

    def beside(left: DataFrame, right: DataFrame, f) -> DataFrame:
        return saved(left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(f, _ROW))

    up = saved(cells.mapInArrow(begin, _ROW))
    words = _bucketed(_by_key(up.where("kind = 'up'"), n).mapInArrow(begin_words, _ROW), n)
    told = beside(words, up.where("kind = 'up'"), sweep_words(0, None))
    totals, trace, samples = _summed([up, told], layout), [], []
    for turn in range(1, m.burn_in + m.samples + 1):
        before = up, told
        up = beside(cells, up.where("kind = 'state'").unionByName(told.where("kind = 'told'")), sweep_shard(turn, totals))
        told = beside(words, up.where("kind = 'up'").unionByName(told.where("kind = 'words'")), sweep_words(turn, totals))
        trace.append(up.where("kind = 'trace'").agg(F.sum("x")).first()[0] or 0.0)
        totals = _summed([up, told], layout)
        if turn - 1 <= m.burn_in:  # no sample needs what came before
            dropped(*before)
        if turn > m.burn_in:
            samples.append((up, told, totals))
    return Trained(layout, total, cells, words, samples, trace)


# ---- scoring


def _answer(per_cell: np.ndarray, texts: np.ndarray, times: np.ndarray, tokens: np.ndarray, base: np.ndarray, p: np.ndarray) -> bytes:
    """For each of the texts (as differences) that have the cells: known tokens, base score in negative billionths, and score."""
    present = np.flatnonzero(np.bincount(texts))
    sums = [np.bincount(texts, np.repeat(x, per_cell) * times)[present] for x in ((tokens > 0).astype(float), base, np.log10(p))]
    return pack(np.diff(present, prepend=0), sums[0].astype(np.int64), np.round(-1e9 * sums[1]).astype(np.int64), sums[2].astype(np.float32))


def answered(blob: bytes) -> list[np.ndarray]:
    """The texts, known tokens, base scores and scores of an answer."""
    texts, known, base, score = unpack(blob)
    return [np.cumsum(texts), known, base * -1e-9, score.astype(np.float64)]


def each_of(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each of some small whole numbers that occurs, and where."""
    order = np.argsort(values.astype(np.min_scalar_type(values.max(initial=0))), kind="stable")  # few bytes sort by radix
    cuts = np.append(0, np.cumsum(np.bincount(values)))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


def _select(at: np.ndarray, per_cell: np.ndarray, *pairs: np.ndarray) -> list[np.ndarray]:
    """per_cell and the pairs of the cells at these places, in their order."""
    starts, sizes = (np.cumsum(per_cell) - per_cell)[at], per_cell[at]
    each = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return [sizes, *(x[each] for x in pairs)]


class Asked:
    """A shard that answers: for each sample its probabilities, and where its contexts and cells are."""

    def __init__(self, blob: bytes | None, states: dict[int, bytes], told: dict[tuple[int, int], bytes], layout: Layout, totals: list[Totals], m: Model):
        self.layout, self.m, self.totals, self.samples, self.waiting, self.n_waiting = layout, m, totals, [], [], 0
        self.words = self.own = np.zeros(0, U64)
        self.d, self.context, self.cell, self.pair, self.cell_pair, self.first = 1, *[np.zeros(0, np.int64)] * 5
        self.p3, self.tokens, self.base = np.zeros(0), np.zeros(0), None
        if blob is None:  # nothing of this shard was met in training
            return
        s = Shard(blob, layout, seated=False)
        for k, t in enumerate(totals):
            s.restore(*unpack(states[k]))
            s.hear({q: b for (i, q), b in told.items() if i == k}, t, m)
            p3, *others = s.probabilities(m)
            self.p3 = self.p3 + p3 / len(totals) if k else p3 / len(totals)
            self.samples.append([x.astype(np.float32) for x in others])
        self.p3 = self.p3.astype(np.float32)
        self.tokens, self.own, self.cell_pair, r = s.tokens[s.next_at], s.own, s.b, s.r
        own_at, next_at, following = s.own_at, s.next_at, s.next
        del s  # its state has served: the keys come after it
        self.words, x, v, w, _ = named(unpack(blob))
        self.d = len(self.words)
        self.pair = np.searchsorted(self.words, self.own)[own_at] * self.d + np.searchsorted(self.words, following)[next_at]
        self.first = np.flatnonzero(np.diff(r, prepend=-1))
        self.context = v[self.first] * self.d + x[self.first]
        self.cell = r.astype(np.int64)
        self.cell *= self.d
        self.cell += w

    def rows(self, blob: bytes, chunk: int, base_of: Callable, more: bool = False) -> list[tuple]:
        """The answer, and what is passed on to the shards of words with the weights of backing off to them; if more chunks ask, what is passed on waits for theirs."""
        names, x, v, w, per_cell, texts, times, *_ = named(unpack(blob), self.layout.common)
        place = _place(names, self.words)
        xi, vi, wi = place[x], place[v], place[w]
        new = np.ones(len(v), bool)  # cells of one context follow each other
        new[1:] = (v[1:] != v[:-1]) | (x[1:] != x[:-1])
        context = self.find((xi[new] >= 0) & (vi[new] >= 0), vi[new] * self.d + xi[new], self.context)[np.cumsum(new) - 1]
        cell = self.cells_of(context, wi)
        met, rest = np.flatnonzero(cell >= 0), np.flatnonzero(cell < 0)
        pair, p = np.full(len(w), -1), np.zeros(len(w))
        if len(met):
            pair[met], p[met] = self.cell_pair[cell[met]], self.p3[cell[met]]
        if len(rest):
            pair[rest] = self.find((vi[rest] >= 0) & (wi[rest] >= 0), vi[rest] * self.d + wi[rest], self.pair)
            p[rest], hot, weights = self.backed_off(names[x[rest]], names[v[rest]], context[rest], pair[rest])
        out = []
        if self.base is None:
            self.base = base_of(self.tokens)
        if len(at := np.flatnonzero(pair >= 0)):
            mine = (per_cell, texts, times) if len(at) == len(pair) else _select(at, per_cell, texts, times)
            out.append((0, "answer", chunk, _answer(*mine, self.tokens[pair[at]], self.base[pair[at]], p[at])))
        if len(far := np.flatnonzero(pair[rest] < 0)):
            rest, hot, weights = rest[far], hot[far], [x[far] for x in weights]
            self.waiting.append([np.full(len(rest), chunk), names[w[rest]], hot + 1, *_select(rest, per_cell, texts, times), *(x.astype(np.float32) for x in weights)])
            self.n_waiting += len(self.waiting[-1][4])
        return out if more and self.n_waiting < _WAITING else out + self.passed_on()

    @staticmethod
    def find(ok: np.ndarray, key: np.ndarray, among: np.ndarray) -> np.ndarray:
        out, at = np.full(len(ok), -1), np.flatnonzero(ok)
        out[at] = _place(key[at], among)
        return out

    def cells_of(self, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where the cells of these contexts and words are: most contexts have one cell, their first."""
        cell, at = np.full(len(w), -1), np.flatnonzero((context >= 0) & (w >= 0))
        first, key = self.first[context[at]], context[at] * self.d + w[at]
        same = self.cell[first] == key
        cell[at[same]] = first[same]
        other = np.flatnonzero(~same)
        other = other[np.append(self.first, len(self.cell))[context[at[other]] + 1] - first[other] > 1]
        cell[at[other]] = _place(key[other], self.cell)
        return cell

    def backed_off(self, x: np.ndarray, v: np.ndarray, context: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of cells that training never met: probabilities by the parent cells (where known here), places of hot words, and each sample's weights of backing off."""
        (d3, _, _), (a3, _, _) = self.m.discounts, self.m.strengths
        own, hot = (_place(v, k) for k in (self.own, self.layout.words))
        hot_pair = np.where(context < 0, _place(pair_hash(v, x), self.layout.pairs), -1)
        p, weights = np.zeros(len(v)), []
        for k, totals in enumerate(self.totals):
            by_three = np.ones(len(v))
            if len(totals.pairs):  # a hot context none of whose cells is here still takes its share
                c, t = totals.pairs[hot_pair].T
                by_three = np.where(hot_pair >= 0, (a3 + d3 * t) / (a3 + c), by_three)
            if not self.samples:
                weights.append(by_three)
                continue
            p2, back3, back2 = self.samples[k]
            by_three = np.where(context >= 0, back3[context], by_three)
            p += np.where(pair >= 0, by_three * p2[pair], 0) / len(self.samples)
            weights.append(by_three * np.where((own >= 0) & (hot < 0), back2[own], 1.0))
        return p, hot, weights

    def passed_on(self) -> list[tuple]:
        """What waits, in one row for each shard of words: a row for each chunk as well would be their number times the shards' squared."""
        if not self.waiting:
            return []
        chunk, names, hot, per_cell, texts, times, *weights = map(np.concatenate, zip(*self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        chunks, place = np.unique(chunk, return_inverse=True)
        out = []
        for q, at in each_of(shard_of(names, self.layout.n)):
            out.append((q, "defer", int(chunks[0]), pack(chunks, place[at], names[at], hot[at], *_select(at, per_cell, texts, times), *(x[at] for x in weights))))
        return out


class AskedWords:
    """A shard of words that answers: for each sample the probabilities of its words and of hot words' cells."""

    def __init__(self, words: Words | None, states: dict[int, bytes], up: dict[tuple[int, int], bytes], totals: list[Totals], m: Model):
        self.w, self.totals, self.m, self.samples = words, totals, m, []
        self.cells = words.hot * len(words.words) + words.hot_at if words else None
        self.unknown = [t.word_probability(np.zeros(1), np.zeros(1), m)[0] for t in totals]
        for k, t in enumerate(totals if words else []):
            words.t1, words.t2 = unpack(states[k])
            words.hear({s: b for (i, s), b in up.items() if i == k})
            p1 = t.word_probability(words.customers(), words.t1, m)
            d, a = m.discounts[1], m.strengths[1]
            customers, tables = t.words[words.hot].T if len(words.hot) else np.zeros((2, 0))
            self.samples.append((p1, (np.maximum(words.c2 - d * words.t2, 0) + (a + d * tables) * p1[words.hot_at]) / (a + customers)))

    def row(self, blob: bytes, chunk: int, base_of: Callable) -> tuple:
        """The answer to a message of this chunk alone."""
        return next(r for r in self.rows([blob], base_of) if r[2] == chunk)

    def rows(self, blobs: list[bytes], base_of: Callable) -> list[tuple]:
        """The answer to each chunk that these messages are from."""
        parts = [unpack(b) for b in blobs]
        chunk = np.concatenate([p[0][p[1]] for p in parts])
        names, hot, per_cell, texts, times, *weights = (np.concatenate([p[k] for p in parts]) for k in range(2, len(parts[0])))
        hot = hot - 1
        n, d, a = len(names), self.m.discounts[1], self.m.strengths[1]
        at = _place(names, self.w.words) if self.w else np.full(n, -1)
        cell = np.full(n, -1)
        if self.w:
            wide = len(self.w.words)
            ok = (hot >= 0) & (at >= 0)
            cell[ok] = _place(hot[ok] * wide + at[ok], self.cells)
        tokens, p = np.where(at >= 0, self.w.tokens[at], 0) if self.w else np.zeros(n), np.zeros(n)
        for k, t in enumerate(self.totals):
            one = np.full(n, self.unknown[k])
            if self.w:
                one = np.where(at >= 0, self.samples[k][0][at], one)
            if len(t.words):
                customers, tables = t.words[hot].T
                one = np.where(hot >= 0, (a + d * tables) / (a + customers) * one, one)
            if self.w and len(self.w.hot):
                one = np.where(cell >= 0, self.samples[k][1][cell], one)
            p += weights[k] * one / len(self.totals)
        chunks, place = np.unique(chunk, return_inverse=True)
        base = base_of(tokens)
        return [(0, "answer", int(chunks[k]), _answer(*_select(at, per_cell, texts, times), tokens[at], base[at], p[at])) for k, at in each_of(place)]


def score(docs: DataFrame, m: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score, and perplexity by the model trained on those not held out."""
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    with _settings(docs.sparkSession):
        layout, total = _layout(docs.where(~held_out), m, text_col)
        asks, name = _asked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out")), layout)
        out = scored(asks, name, _fitted(layout, total, _counted_from(asks, layout), m), m)
        return out.withColumnRenamed("id", id_col)


def _asked(docs: DataFrame, layout: Layout) -> tuple[DataFrame, str]:
    """For each chunk of texts what it asks of each shard (distinct cells, the texts that have them, and customers of training), and its documents; and the name of the table that has this, by shard."""
    schema = T.StructType([*_ROW, *(T.StructField(k, docs.schema[k].dataType) for k in ("id", "held_out"))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            trained = ~batch.column(2).to_numpy(zero_copy_only=False)
            for low, high, words, at in word_chunks(batch.column(1), lower=True, chunk_bytes=_CHUNK):
                for p in parts_of(words, at, layout):
                    cell = np.repeat(np.arange(len(p.starts)), np.diff(p.starts, append=len(p.texts)))
                    pair = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(p.texts, prepend=-1) != 0))
                    customers = np.bincount(cell, trained[low:high][p.texts], len(p.starts)).astype(np.int64)
                    blob = p.packed(np.bincount(cell[pair], minlength=len(p.starts)), p.texts[pair], np.diff(pair, append=len(p.texts)), customers, common=layout.common)
                    yield _with_docs(_rows([(p.shard, "ask", chunk, blob)]), schema)
                n = high - low
                docs_rows = _rows([((chunk + i) % layout.n, "doc", chunk, None, i, int(k)) for i, k in enumerate(np.diff(at) + 1)])
                yield pa.RecordBatch.from_arrays([*docs_rows.columns, batch.column(0).slice(low, n), batch.column(2).slice(low, n)], schema.names)
                chunk += 1

    rows = docs.mapInArrow(ask, schema).repartition(layout.n, "key")
    rows.write.options(**_BLOBS).format("parquet").bucketBy(layout.n, "key").saveAsTable(name := f"factloom_{uuid4().hex}")
    return docs.sparkSession.table(name), name


def _with_docs(rows: pa.RecordBatch, schema: T.StructType) -> pa.RecordBatch:
    """Rows that are no document's, with that's columns."""
    return pa.RecordBatch.from_arrays([*rows.columns, *(pa.nulls(rows.num_rows, to_arrow_type(f.dataType)) for f in schema.fields[len(_ROW) :])], schema.names)


def scored(asks: DataFrame, name: str, model: Trained, m: Model) -> DataFrame:
    """The documents' scores; the asks' table is dropped when it has been answered."""
    layout, totals, train_tokens = model.layout, [t for _, _, t in model.samples], model.train_tokens
    n_words = totals[-1].n_words
    base_of = lambda c: np.log10((c + 0.5) / (train_tokens + 0.5 * (n_words + 1)))
    schema = asks.schema
    arrow_schema = pa.schema([pa.field(n, k) for n, k in zip(schema.names, [*_ARROW, *(to_arrow_type(f.dataType) for f in schema.fields[len(_ROW) :])], strict=True)])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """A shard's cells, what is asked of it and some documents, which pass through, beside its states and what it was told."""
        of = lambda rows, kind: rows.filter(pa.array(np.array(rows.column("kind").to_pylist(), object) == kind, pa.bool_()))
        told = {(r["a"], r["origin"]): r["blob"] for r in of(right, "told").to_pylist()}
        states = {r["a"]: r["blob"] for r in of(right, "state").to_pylist()}
        cells, shard, out = of(left, "cells").column("blob").to_pylist(), None, of(left, "doc").cast(arrow_schema).to_batches()
        asked = of(left, "ask")
        for i, (origin, blob) in enumerate(zip(*(asked.column(c) for c in ("origin", "blob")), strict=True)):
            shard = shard or Asked(cells[0] if cells else None, states, told, layout, totals, m)
            out.append(_with_docs(_rows(shard.rows(blob.as_py(), origin.as_py(), base_of, i + 1 < asked.num_rows)), schema))
        return pa.Table.from_batches(out, arrow_schema)

    def answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            words, states, up, shard, waiting, size = None, {}, {}, None, [], 0
            for r in rows:
                if r["kind"] == "lexicon":
                    words = Words(unpack(r["blob"]))
                elif r["kind"] == "words":
                    states[r["a"]] = r["blob"]
                elif r["kind"] == "up":
                    up[r["a"], r["origin"]] = r["blob"]
                else:
                    shard = shard or AskedWords(words, states, up, totals, m)
                    waiting.append(r["blob"])
                    size += len(r["blob"])
                    if size > _WAITING_BYTES:
                        yield _with_docs(_rows(shard.rows(waiting, base_of)), schema)
                        waiting, size = [], 0
            if waiting:
                yield _with_docs(_rows(shard.rows(waiting, base_of)), schema)

    heard = [_marked(df.where(f"kind = '{kind}'"), k, kind, _ROW) for k, (up, told, _) in enumerate(model.samples) for df, kind in ((up, "state"), (told, "told"))]
    # cells and asks are bucketed by key: only the rest moves
    dealt = asks.unionByName(_marked(model.cells, 0, "cells", schema))
    answers = written(dealt.groupBy("key").cogroup(reduce(DataFrame.unionByName, heard).groupBy("key")).applyInArrow(answer, schema), **_BLOBS)
    asks.sparkSession.sql(f"DROP TABLE {name}")
    deferred = answers.where("kind = 'defer'").select(*_ROW.names).unionByName(_marked(model.words, 0, "lexicon", _ROW))
    for k, (up, told, _) in enumerate(model.samples):
        deferred = deferred.unionByName(_marked(told.where("kind = 'words'"), k, "words", _ROW)).unionByName(_marked(up.where("kind = 'up'"), k, "up", _ROW))
    from_words = _in_order(deferred, ("lexicon", "words", "up", "defer"), layout.n).mapInArrow(answer_words, schema)

    out_schema = T.StructType([schema["id"], T.StructField("held_out", T.BooleanType()), *long("n_tokens", "n_known"), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the answers to each chunk: they come before its documents, which come in order."""
        at, sums = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                chunk = batch.column(2)[i].as_py()
                if chunk != at:
                    at, sums = chunk, [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
                if batch.column(3)[i].is_valid:
                    texts, *parts = answered(batch.column(3)[i].as_py())
                    if texts[-1] >= len(sums[0]):
                        sums = [np.append(x, np.zeros(int(texts[-1]) + 1 - len(x), x.dtype)) for x in sums]
                    for x, part in zip(sums, parts, strict=True):
                        x[texts] += part
                else:
                    place = batch.column(4)[i].as_py()
                    out.append((i, batch.column(5)[i].as_py(), *(x[place] for x in sums)))
            if out:
                rows = pa.array([r[0] for r in out])
                yield pa.RecordBatch.from_arrays([batch.column(7).take(rows), batch.column(8).take(rows), *(pa.array([r[k] for r in out], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64())))], out_schema.names)

    every = answers.where("kind <> 'defer'").unionByName(from_words)
    out = every.repartition("origin").sortWithinPartitions("origin", F.col("blob").isNull(), "a").mapInArrow(gather, out_schema)
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _in_order(rows: DataFrame, kinds: tuple[str, ...], n: int) -> DataFrame:
    """The rows by key, in each key by kind in this order."""
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return rows.repartition(n, "key").sortWithinPartitions("key", order, "origin")


def _marked(df: DataFrame, sample: int, kind: str, schema: T.StructType) -> DataFrame:
    """df's rows as ones of this schema, of a kind and a sample (column a)."""
    values = {"kind": F.lit(kind), "a": F.lit(sample).cast("bigint")}
    return df.select(*(values.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
