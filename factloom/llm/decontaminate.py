"""Benchmark decontamination by latent semantic retrieval.

The passages of the corpus (windows of words that don't overlap) are rows of a
TF-IDF matrix A over hashed words: every word of the corpus is in one of
2^feature_bits features, weighed by how many passages have it. One pass counts
these, a second one makes the randomised sketch S A, in which each passage is
added with a random sign to one of sketch_rows rows. Both have a fixed size and
are summed over the tasks. The singular vectors of the sketch, joined by the
benchmark items of a block (rows of the matrix as well, weighed up so that the
latent space tells them apart), span the latent space, of rank ``rank``, below
the number of items of a full block.

The last pass folds windows of each text into the latent space and takes the
items near by cosine as candidates. A candidate is confirmed by the longest
common subsequence of words with the item (a window with too few of its words
can have none that is long enough); where that is short of a near-verbatim
share, the item's answer (its last sentence) must be found as well.

What goes to every executor is at most ``pass_blocks`` blocks of ``block_items``
items and ``block_words`` words, with a latent space each (about 60 MB), whatever
the corpus; there is one search pass for so many items.

Defined cases: null and empty texts are clean; items without a word are left
out; equal items each count; repeated rows each get their verdict; empty tables
give empty or all-clean results. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import long
from ._text import U64, word_blocks

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SENTENCE = re.compile(r"[.!?]+(?=[\x20\x09-\x0D]|$)")


@dataclass(frozen=True)
class Leaks:
    """window and stride are in words (a window is some strides). An item is leaked from near_share of its words in order on, or from least_share with answer_share of its answer's."""

    window: int = 64
    stride: int = 32
    feature_bits: int = 14
    sketch_rows: int = 128
    rank: int = 96
    item_weight: float = 10.0
    least_cosine: float = 0.5
    near_share: float = 0.8
    least_share: float = 0.6
    answer_share: float = 0.75
    block_items: int = 256
    block_words: int = 50_000
    pass_blocks: int = 8
    seed: int = 7


@dataclass
class Block:
    """A block of items: their words and answers (hashed), the distinct words with who has them, the folding of features and the items' latent places."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    has: np.ndarray
    fold: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    items: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


@dataclass
class Corpus:
    """idf of each feature, and the sketch of all passages."""

    idf: np.ndarray
    sketch: np.ndarray


def answer_of(text: str) -> str:
    """The last sentence with at least three words; the whole text if there is none."""
    parts = [p for p in _SENTENCE.split(text) if len(_WORDS.findall(p)) >= 3]
    return parts[-1] if len(parts) > 1 else text


def hashed(texts: list[str]) -> list[np.ndarray]:
    out = []
    for low, high, words, at in word_blocks(pa.array(texts, pa.large_string()), lower=True):
        out += [words[at[i] : at[i + 1]] for i in range(high - low)]
    return out


def blocks(benchmark: DataFrame, o: Leaks, item_col: str, text_col: str) -> Iterator[Block]:
    """The items in id order, block by block; pass_blocks at a time are with the driver."""
    held: list[tuple] = []
    n_words = 0

    def made() -> Block:
        words = hashed([t for _, t in held])
        vocabulary = np.unique(np.concatenate(words))
        has = np.zeros((len(held), len(vocabulary) + 1), bool)  # the last column stands for all other words
        for i, w in enumerate(words):
            has[i, np.searchsorted(vocabulary, w)] = True
        return Block([i for i, _ in held], words, hashed([answer_of(t) for _, t in held]), vocabulary, has)

    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).orderBy(item_col, text_col).toLocalIterator():
        n = len(_WORDS.findall(row[1]))
        if not n:
            continue
        if held and (len(held) == o.block_items or n_words + n > o.block_words):
            yield made()
            held, n_words = [], 0
        held.append((row[0], row[1]))
        n_words += n
    if held:
        yield made()


def features_of(words: np.ndarray, o: Leaks) -> np.ndarray:
    return (words >> U64(64 - o.feature_bits)).astype(np.int64)


def cells(words: np.ndarray, at: np.ndarray, o: Leaks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The term counts of all passages of the texts, sorted by passage: passage, feature, count; and the number of passages."""
    lengths = np.diff(at)
    n = -(-lengths // o.window)
    text = np.repeat(np.arange(len(lengths)), lengths)
    passage = (np.cumsum(n) - n)[text] + (np.arange(len(words)) - at[:-1][text]) // o.window
    key = np.sort(passage << o.feature_bits | features_of(words, o))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] >> o.feature_bits, key[first] & ((1 << o.feature_bits) - 1), np.diff(first, append=len(key)), int(n.sum())


def weights(row: np.ndarray, col: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with rows of unit length."""
    w = (1 + np.log(count)) * idf[col]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    if not len(starts):
        return w
    norm = np.sqrt(np.maximum(np.add.reduceat(w * w, starts), 1e-12))
    return w / np.repeat(norm, np.diff(starts, append=len(row)))


def inverse_frequency(n_passages: int, df: np.ndarray) -> np.ndarray:
    return np.log((n_passages + 1) / (df + 1)) + 0.1


def corpus(docs: DataFrame, o: Leaks, text_col: str) -> Corpus:
    """Two passes over all passages."""
    n_features = 1 << o.feature_bits

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(n_features, np.int64), 0
        for batch in batches:
            for _, _, words, at in word_blocks(batch.column(0), lower=True):
                _, col, _, n = cells(words, at, o)
                seen += np.bincount(col, minlength=n_features)
                total += n
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(seen[hit], total))], ["feature", "n"])

    counts = docs.select(text_col).mapInArrow(frequencies, T.StructType(long("feature", "n"))).groupBy("feature").agg(F.sum("n").alias("n")).collect()  # a row for each feature at most
    df = np.zeros(n_features + 1)
    for f, n in counts:
        df[f] = n
    idf = inverse_frequency(df[-1], df[:-1])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([o.seed, part])
        g = np.zeros(o.sketch_rows * n_features, np.float32)
        for batch in batches:
            for _, _, words, at in word_blocks(batch.column(0), lower=True):
                row, col, count, n = cells(words, at, o)
                place, sign = rng.integers(0, o.sketch_rows, n), rng.choice(np.array([-1.0, 1.0]), n)
                np.add.at(g, place[row] * n_features + col, (weights(row, col, count, idf) * sign[row]).astype(np.float32))
        for i, x in enumerate(g.reshape(o.sketch_rows, -1)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part // 64], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["row", "salt", "part"])

    parts = docs.select(text_col).mapInArrow(sketched, "row bigint, salt bigint, part binary")
    sketch = np.zeros((o.sketch_rows, n_features), np.float32)
    for row in add_up(add_up(parts).withColumn("salt", F.lit(0).cast("bigint"))).collect():  # sketch_rows rows of a fixed size
        sketch[row["row"]] = np.frombuffer(row["part"], np.float32)
    return Corpus(idf, sketch)


def add_up(parts: DataFrame) -> DataFrame:
    """Sums of float32 vectors by row and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a key's vectors come together: one sum is held
        at, g = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([g.astype(np.float32).tobytes()], pa.binary())], ["row", "salt", "part"])

        for batch in batches:
            for row, salt, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(part, np.float32)
                if (row, salt) != at:
                    if at is not None:
                        yield made()
                    at, g = (row, salt), x.astype(np.float64)
                else:
                    g += x
        if at is not None:
            yield made()

    return parts.repartition("row", "salt").sortWithinPartitions("row", "salt").mapInArrow(run, parts.schema)


def fit(c: Corpus, b: Block, o: Leaks) -> Block:
    """The block with its latent space: the first right singular vectors of the corpus's sketch and the items, weighed up."""
    bounds = np.cumsum([0, *map(len, b.words)])
    key = np.sort(np.repeat(np.arange(len(b.words)), np.diff(bounds)) << o.feature_bits | features_of(np.concatenate(b.words), o))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    row, col, count = key[first] >> o.feature_bits, key[first] & ((1 << o.feature_bits) - 1), np.diff(first, append=len(key))
    items = np.zeros((len(b.words), 1 << o.feature_bits), np.float32)
    items[row, col] = weights(row, col, count, c.idf)
    size = np.linalg.norm(c.sketch) or 1.0
    m = np.concatenate([c.sketch, items * np.float32(o.item_weight * size / max(np.linalg.norm(items), 1e-9))])
    values, vectors = np.linalg.eigh((m @ m.T).astype(np.float64))
    top = np.argsort(-values)[: o.rank]
    top = top[values[top] > values.max() * 1e-6]
    b.fold = ((m.T @ vectors[:, top]) / np.sqrt(values[top]) * c.idf[:, None]).astype(np.float32)
    b.items = unit(np.stack([b.fold[features_of(w, o)].sum(axis=0) for w in b.words]))
    return b


def unit(z: np.ndarray) -> np.ndarray:
    return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-20)).astype(np.float32)


def folded(words: np.ndarray, at: np.ndarray, fold: np.ndarray, o: Leaks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, one for each stride: the text, the first word and the latent place."""
    lengths = np.diff(at)
    n = -(-lengths // o.stride)
    text = np.repeat(np.arange(len(lengths)), n)
    start = at[:-1][text] + (np.arange(len(text)) - (np.cumsum(n) - n)[text]) * o.stride
    features, steps = features_of(words, o), np.empty((len(start), fold.shape[1]), np.float32)
    ends = np.append(start[1:], len(words)) if len(start) else start
    for low in range(0, len(start), 256):  # some thousand words at once
        high = min(len(start), low + 256)
        steps[low:high] = np.add.reduceat(fold[features[start[low] : ends[high - 1]]], start[low:high] - start[low], axis=0)
    z = steps.copy()
    for k in range(1, o.window // o.stride):
        same = np.flatnonzero(text[:-k] == text[k:])
        z[same] += steps[same + k]
    return text, start, unit(z)


def common_in_order(item: np.ndarray, text: np.ndarray) -> int:
    """The length of the longest common subsequence, bit-parallel over the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def verdict(item: np.ndarray, answer: np.ndarray, text: np.ndarray, o: Leaks) -> float:
    """The share of the item's words found in order, negative if that is no leak."""
    share = common_in_order(item, text) / len(item)
    leaked = share >= o.near_share or share >= o.least_share and common_in_order(answer, text) >= o.answer_share * len(answer)
    return share if leaked else -share


def search(words: np.ndarray, at: np.ndarray, b: Block, o: Leaks) -> Iterator[tuple[int, int, float]]:
    """(text, item, share of its words in order) for every leak."""
    doc, start, z = folded(words, at, b.fold, o)
    place = np.minimum(np.searchsorted(b.vocabulary, words), len(b.vocabulary) - 1)
    place = np.where(b.vocabulary[place] == words, place, len(b.vocabulary))
    best: dict[tuple[int, int], float] = {}
    for low in range(0, len(start), 4096):
        near, item = np.nonzero(z[low : low + 4096] @ b.items.T >= o.least_cosine)
        for r, i in zip((near + low).tolist(), item.tolist(), strict=True):
            d, n = int(doc[r]), len(b.words[i])
            # the window, widened for an item that begins before or ends behind it, but little longer than the item
            wide = max(0, n - o.stride)
            x, y = max(at[d], start[r] - wide), min(at[d + 1], start[r] + o.window + wide)
            if np.count_nonzero(b.has[i][place[x:y]]) < o.least_share * n or best.get((d, i), -1.0) == 1.0:
                continue
            best[d, i] = max(best.get((d, i), -1.0), verdict(b.words[i], b.answers[i], words[x:y], o))
    for (d, i), share in best.items():
        if share > 0:
            yield d, i, share


def leaks(docs: DataFrame, benchmark: DataFrame, o: Leaks = Leaks(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: contaminated, n_items (leaked items), item_id (the one found fullest, then least), lcs_share."""
    out = _searched(docs.select(id_col, text_col), benchmark, o, text_col, item_col, item_text_col, drop=False)
    return out.select(F.col(id_col), (F.col("__n") > 0).alias("contaminated"), F.col("__n").alias("n_items"), F.col("__item").alias("item_id"), F.col("__share").alias("lcs_share"))


def clean(docs: DataFrame, benchmark: DataFrame, o: Leaks = Leaks(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without a leak, with all their columns as they are."""
    return _searched(docs, benchmark, o, text_col, item_col, item_text_col, drop=True)


def _searched(docs: DataFrame, benchmark: DataFrame, o: Leaks, text_col: str, item_col: str, item_text_col: str, drop: bool) -> DataFrame:
    """Some blocks of items at a time are one more pass over the rows, without a shuffle."""
    text_at = docs.columns.index(text_col)
    item_type = benchmark.schema[item_col].dataType
    if not drop:
        docs_in, docs = docs, docs.select("*", F.lit(0).cast("bigint").alias("__n"), F.lit(None).cast(item_type).alias("__item"), F.lit(0.0).alias("__share"))
    else:
        docs_in = docs
    made, whole = blocks(benchmark, o, item_col, item_text_col), None
    while some := list(islice(made, o.pass_blocks)):
        whole = whole or corpus(docs_in, o, text_col)
        sent = docs.sparkSession.sparkContext.broadcast([fit(whole, b, o) for b in some])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: dict[int, list[tuple]] = {}
                for low, _, words, at in word_blocks(batch.column(text_at), lower=True):
                    for k, b in enumerate(sent.value):
                        for d, i, share in search(words, at, b, o):
                            found.setdefault(low + d, []).append((-share, k, i))
                if drop:
                    kept = np.ones(batch.num_rows, bool)
                    kept[list(found)] = False
                    yield batch.filter(pa.array(kept))
                    continue
                columns = batch.columns
                n, item, share = (c.to_pylist() for c in columns[-3:])
                for d, hits in found.items():
                    n[d] += len(hits)
                    top, k, i = min(hits)
                    if -top > share[d]:
                        share[d], item[d] = -top, sent.value[k].ids[i]
                columns[-3:] = [pa.array(x, c.type) for x, c in zip((n, item, share), columns[-3:], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        docs = docs.mapInArrow(run, docs.schema)
    return docs

