"""Token counts through a digest cache.

A text's content is its UTF-8 bytes after the tokenizer's own normaliser, where
the file has one that leaves its results as they are (texts with a special
token's string keep theirs). Each content's digest (SHA-256) and the tokenizer's
version digest (SHA-256 of its file) are joined to stored counts. Only distinct
misses are encoded, and their counts are appended to the cache. Copies are met
once in each task before the shuffle, so a hot text costs a row a task.

The counts come back to the rows by a join on the digest. Digests with 1/1024
of the rows or more, of which there are 1,024 at most, are looked up in a
broadcast instead, so copies of one text never land in one task.

The counts are those of the library ``tokenizers`` for the file, special tokens
neither added nor truncated, their strings inside a text taken as the tokens
they name. Files of byte-level BPE with the usual splitting pattern and no
normalizer run on the same ranks in ``tiktoken``, several times as fast and
tested for equality; all other files run in the library itself.

A null text counts as empty; repeated rows each get their count; an empty table
gives an empty result; null ids stay. Only the id and text columns are read,
whatever they and the others are called. Very long texts are encoded whole, one
at a time. A task holds the digests of its own partition. An append that runs
twice stores a count twice, which reading folds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import SLICE_ROWS, arrow, long, settings, shared_folder, string, written

#: A digest of 1 / _HOT of the rows or more is hot.
_HOT = 1024
#: Texts are read, and sent to Python, so many rows at a time; thousands of long ones would be several copies of some 30 MB in each task.
_FEW = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxRecordsPerBatch": "256"}
#: The pattern of the byte-level pre-tokenizer (fixed value of that format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def version_digest(path: str) -> str:
    with open(path, "rb") as f:
        return sha256(f.read()).hexdigest()


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such files: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _same_in_ranks(spec: dict) -> bool:
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        and _merges_in_rank_order(model, {t["content"] for t in spec["added_tokens"]})
    )


def _merges_in_rank_order(model: dict, added: set[str]) -> bool:
    """Each merge makes a later id than the one before, and all ids but the single bytes' are made by one: then ranks decide as merges do."""
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return made == sorted(set(made)) and len(made) + 256 == len(model["vocab"].keys() - added)


@cache
def counter(path: str) -> Callable[[str], int]:
    """Counts a text's tokens with the file at path; made once in each Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _same_in_ranks(spec):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        return lambda text: len(library.encode(text, add_special_tokens=False))
    import tiktoken

    alphabet = byte_alphabet()
    added = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(alphabet[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in added}
    whole = tiktoken.Encoding("whole", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # equal on texts without two white-space characters in a row, and much faster without look-ahead
    plain = tiktoken.Encoding("plain", pat_str=BYTE_LEVEL_PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    double = re.compile(r"\s\s")
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    firsts = {t[:2] for t in added}

    def one(text: str) -> int:
        return len((whole if double.search(text) else plain)(text))

    def count(text: str) -> int:
        if not any(x in text for x in firsts):
            return one(text)
        parts = special.split(text)
        return sum(map(one, parts)) + len(parts) - 1

    return count


@cache
def normaliser(path: str) -> Callable[[str], str] | None:
    """What the tokenizer makes of a text before anything else; None where its file has no normaliser."""
    if path.endswith(".model"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") is None:
        return None
    from tokenizers import Tokenizer

    rule = Tokenizer.from_file(path).normalizer
    added = [t["content"] for t in spec["added_tokens"]]

    def normal(text: str) -> str:
        out = rule.normalize_str(text)
        if any(t in text or t in out for t in added) or rule.normalize_str(out) != out:
            return text
        return out

    return normal


def contents(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, content) of every row."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if normaliser(tokenizer_path) is None:
        return docs.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").alias("content"))
    schema = T.StructType([docs.schema["id"], *long("n_bytes"), *string("content")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = normaliser(tokenizer_path)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(list(map(normal, texts)), pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose digest (column 0) this task has not met."""
    met: set[bytes] = set()
    for batch in batches:
        new = []
        for d in batch.column(0).to_pylist():
            new.append(d not in met)
            met.add(d)
        yield batch.filter(pa.array(new, pa.bool_()))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit (n_tokens > limit).

    cache_path is a table of (tokenizer, digest, n_tokens) that grows; the
    default lies in the shared folder.
    """
    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_folder(spark)}/token_counts"
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    at = f"{cache_path}/tokenizer={version_digest(tokenizer_path)}"
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(at)  # the table is there from now on
    stored = spark.read.schema(schema).parquet(at)

    digest = F.unhex(F.sha2(F.col("content").cast("binary"), 256)).alias("digest")
    all_contents = contents(docs, tokenizer_path, id_col, text_col)
    met = all_contents.select(digest, "content")
    misses = met.mapInArrow(_firsts, met.schema).join(stored.select("digest").distinct(), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in _firsts(batches):
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                n = pa.array([count(x) for x in part.column(1).to_pylist()], arrow(T.LongType()))
                yield pa.RecordBatch.from_arrays([part.column(0), n], schema.names)

    with settings(spark, _FEW):
        misses.repartition("digest").mapInArrow(encode, schema).write.mode("append").parquet(at)
        rows = written(all_contents.select("id", "n_bytes", digest))
    counts = spark.read.schema(schema).parquet(at).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    hot = rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") * _HOT >= rows.count()).select("digest")
    hot = spark.createDataFrame(counts.join(hot, "digest").collect(), schema)  # _HOT rows at most
    often = rows.join(F.broadcast(hot), "digest")
    rare = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(counts, "digest", "left")
    out = often.unionByName(rare)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
