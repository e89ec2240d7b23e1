"""Best-fit packing of token sequences by exact complements.

Documents become ids and an end id; one longer than a sequence is cut into whole
sequences and a shorter last piece. How pieces fill sequences depends on nothing
but how many pieces of each length there are, so the plan is made on these
counts, of which there are at most ``size``:

- the longest piece left opens a sequence, and the gap is looked up in an index
  of the sums of one, two and three lengths that are still there; a combination
  that fills it exactly is used as often as its lengths' counts allow,
- with no such combination the longest piece that fits goes in (best fit for
  what then remains), and the smaller gap is looked up again, until nothing fits.

Every pattern found so uses up a length or all but a few of its pieces, so
patterns are few at any number of documents. A pattern used m times is m
sequences; it takes a run of consecutive ranks of each of its lengths.

How it runs on Spark. Tasks encode and number their pieces within each length. A
table of counts by (task, length) gives each task's first rank of every length
by a running sum, pieces join that by (task, length), and a rank finds its
pattern by ``searchsorted`` in the runs, which are broadcast. Their number is
bounded by the sequence size (about ``size * sqrt(2 * size)``), not by the data.
The driver sees the counts of lengths and nothing else.

Ids are those of the library ``tokenizers``. For files of the usual form (lower
case, white space dropped, words with an end mark), texts of Latin letters run
on the same ranks in ``tiktoken``, the mark being one more byte behind each word,
several times as fast and tested for equality; texts with other characters, or
with a special token's string, run in the library, and so do all other files.

Defined cases: a null or empty text is the end id alone; a null id keeps its
pieces; repeated rows are packed each; an empty table gives an empty result.
Only the id and text columns are read, whatever they and the others are called.
Very long texts are encoded whole, one at a time.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import SLICE_ROWS, long, written
from .token_counts import byte_alphabet

#: Texts on which lower-casing, white space and the pattern's classes are the same here and in the library, and that no composition changes.
_PLAIN = re.compile(r"[\x09\x0A\x0D\x20-\x7E\xA1-\xAC\xAE-\xB1\xB4-\xB8\xBA\xBB\xBF-ž‐-‧‰-›€]*")
#: The splitting pattern of such files (fixed value of that format), and the same for plain texts in the words of ``re``.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ž"
_PLAIN_SPLIT = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s0-9{_LETTERS}]+")
#: Ends a word where its ids are looked for; plain texts have no such character.
_END = "\0"


@dataclass(frozen=True)
class Packing:
    """size: most tokens of a sequence. end: the id after a document."""

    size: int = 2048
    end: int = 0


def _is_usual(spec: dict) -> bool:
    """Lower case, white space dropped, words split by SPLIT and merged byte by byte with an end mark, each merge making the next id."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [s["type"] for s in split] == ["Split", "ByteLevel"]
        and split[0]["pattern"] == {"Regex": SPLIT} and split[0]["behavior"] == "Removed" and split[0]["invert"]
        and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        and [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]] == list(range(512, 512 + len(model["merges"])))
        and sorted(model["vocab"].values()) == list(range(512 + len(model["merges"])))
        and len(_word_ranks(model["vocab"])) == len(model["vocab"])
    )


def _word_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Ranks of byte strings, the end mark being one more byte: a byte with the mark has the next rank after the bytes', so these two are joined first."""
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in t.removesuffix("</w>")) + (_END.encode() if t.endswith("</w>") else b""): rank for t, rank in vocabulary.items()}


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A text's ids by the file at path, without added special tokens; made once in each Python worker."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def whole(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _is_usual(spec):
        return whole
    import tiktoken

    special = {t["content"] for t in spec["added_tokens"]}
    merged = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=_word_ranks({t: i for t, i in spec["model"]["vocab"].items() if t not in special}), special_tokens={})
    words = _PLAIN_SPLIT.findall

    def encode(text: str) -> np.ndarray:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return whole(text)
        return np.array(merged.encode_ordinary(_END.join([*words(text.lower()), ""])), np.uint32)

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, p: Packing = Packing(), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) of every piece, and (task, nth): its number among the task's pieces of its length."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *long("start", "length", "ids_crc32", "task", "nth"),
        *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        met = [0] * (p.size + 1)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                of: list[int] = []
                rows: list[tuple] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(p.end)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), p.size)):
                        mine = ids[start : start + p.size]
                        of.append(i)
                        rows.append((k, start, len(mine), crc32(mine.tobytes()), task, met[len(mine)], *([mine.astype(np.int64)] if with_ids else [])))
                        met[len(mine)] += 1
                kinds = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *columns], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class _Left:
    """Pieces left by length, with the lengths that have any in order, and sums of them looked up."""

    def __init__(self, counts: dict[int, int], size: int) -> None:
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.counts)
        self._mask = (1 << (size + 1)) - 1
        self._sums: list[int] = []

    def sums(self, k: int) -> int:
        """Bit n is set if n is a sum of k + 1 lengths; made anew when a length is used up."""
        if not self._sums:
            bits = sum(1 << n for n in self.lengths)
            self._sums = [bits]
            for _ in range(2):
                before, after = self._sums[-1], 0
                for n in self.lengths:
                    after |= before << n
                self._sums.append(after & self._mask)
        return self._sums[k]

    def take(self, n: int, times: int) -> None:
        self.counts[n] -= times
        if not self.counts[n]:
            del self.counts[n]
            del self.lengths[bisect_left(self.lengths, n)]
            self._sums = []

    def longest(self, most: int) -> int:
        """The longest of at most that many tokens; 0 if there is none."""
        i = bisect_right(self.lengths, most)
        return self.lengths[i - 1] if i else 0

    def _has(self, *parts: int) -> bool:
        return all(self.counts.get(n, 0) >= parts.count(n) for n in parts)

    def _pair(self, gap: int, most: int) -> tuple[int, ...] | None:
        """Two lengths of that sum, of which the longer is as long as can be but at most ``most``."""
        if not self.sums(1) >> gap & 1:
            return None
        for i in range(bisect_right(self.lengths, min(most, gap - 1)) - 1, -1, -1):
            a = self.lengths[i]
            if 2 * a < gap:
                return None
            if self._has(a, gap - a):
                return a, gap - a
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths of exactly that sum, the longest first."""
        if self._has(gap):
            return (gap,)
        if found := self._pair(gap, gap):
            return found
        if not self.sums(2) >> gap & 1:
            return None
        for i in range(bisect_right(self.lengths, gap - 2) - 1, -1, -1):
            a = self.lengths[i]
            if 3 * a < gap:
                return None
            found = self._pair(gap - a, a)
            if found and self._has(a, *found):
                return a, *found
        return None


def packing_plan(counts: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(times, ((length, how many), ...)) of every pattern, lengths descending; all pieces are used, and no pattern is over size."""
    left, plan = _Left(counts, size), []
    while left.lengths:
        pattern: dict[int, int] = {}
        gap = size

        def add(n: int) -> None:
            nonlocal gap
            left.take(n, 1)
            pattern[n] = pattern.get(n, 0) + 1
            gap -= n

        add(left.longest(size))
        while gap and left.lengths and left.lengths[0] <= gap:
            for n in left.complement(gap) or (left.longest(gap),):
                add(n)
        more = min(left.counts.get(n, 0) // k for n, k in pattern.items())
        for n, k in pattern.items():
            if more:
                left.take(n, more * k)
        plan.append((1 + more, tuple(sorted(pattern.items(), reverse=True))))
    return plan


def _runs(plan: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[str, np.ndarray]:
    """A run of ranks of one length for each pattern that has it, sorted by (length, first rank)."""
    rows, used, base = [], {}, 0
    for times, pattern in plan:
        offset = 0
        for n, k in pattern:
            rows.append((n, used.get(n, 0), base, k, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "each", "offset"), table.T, strict=True))


def packed(found: DataFrame, p: Packing = Packing(), id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset. found: what ``pieces`` gave, as a table that reads the same again."""
    spark = found.sparkSession
    counts = written(found.groupBy("task", "length").agg(F.count("*").alias("n")))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # p.size rows at most
    runs = spark.sparkContext.broadcast(_runs(packing_plan(by_length, p.size)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = found.join(counts.select("task", "length", before.alias("before")), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    columns = ["id", "piece", "start", "length", "ids_crc32", *[c for c in ("ids",) if c in found.columns]]
    ranked = ranked.select(*columns, "rank")
    schema = T.StructType([*(found.schema[c] for c in columns), *long("sequence_id", "offset")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        lows = np.searchsorted(r["length"], np.arange(p.size + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                low, high = lows[n], lows[n + 1]
                at[mine] = low + np.searchsorted(r["first"][low:high], rank[mine], "right") - 1
            nth, each = rank - r["first"][at], r["each"][at]
            places = [r["base"][at] + nth // each, r["offset"][at] + nth % each * length]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, places)], schema.names)

    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def pack(docs: DataFrame, tokenizer_path: str, p: Packing = Packing(), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, (ids,) sequence_id and offset."""
    return packed(written(pieces(docs, tokenizer_path, p, with_ids, id_col, text_col)), p, id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the sequences themselves, from pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # p.size tokens at most
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
