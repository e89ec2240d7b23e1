"""Byte-level BPE by monoid tree reduction.

A text is halved until its pieces are small, each leaf is encoded, and
neighbours are joined up the tree. A join encodes a window around the seam anew
and keeps the tokens outside it. The window grows, doubling, until both edges
are cuts at which the splitting pattern always begins a new piece whatever
stands around: before a single space between two characters that aren't white
space. No match of the pattern can run across such a place (only runs of white
space hold a space behind their first character), so the tokens outside are
proven stable and the join is associative. Decoding concatenates up the tree.

A null text counts as empty and gives no tokens; repeated rows each get theirs;
an empty table gives an empty result. Only the id and text columns are read. A
text without any such cut is encoded whole at the root.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import tiktoken
from pyspark.sql import DataFrame

from ._frames import long, per_text, string

_DOUBLE = re.compile(r"\s\s")


@dataclass(frozen=True)
class Vocabulary:
    """A file of base64 tokens and ranks, and the pattern that splits text before the merges; leaves of the tree have at most leaf_chars characters."""

    ranks_path: str
    pattern: str
    leaf_chars: int = 64
    first_window: int = 16


class Codec:
    """Encodes and decodes with one vocabulary; made once in each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        with open(vocabulary.ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        whole = tiktoken.Encoding("whole", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        self._whole = whole.encode_ordinary
        # Without look-ahead the pattern runs much faster. It differs only in how it splits a run of
        # white space of two characters or more, so it serves the pieces that have none.
        plain = vocabulary.pattern.replace(r"|\s+(?!\S)", "")
        self._plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if plain != vocabulary.pattern else self._whole
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.lengths = [len(t) for t in self.token_bytes]
        self.decimal = [str(i) for i in range(len(self.token_bytes))]

    def leaf(self, text: str) -> list[int]:
        return (self._whole if _DOUBLE.search(text) else self._plain)(text)

    def encode(self, text: str) -> list[int]:
        """Every text longer than a leaf goes through the tree."""
        return self._tree(text, 0, len(text)) if text else []

    def _tree(self, text: str, low: int, high: int) -> list[int]:
        """The tokens of text[low:high], encoded as a text of its own."""
        if high - low <= self.v.leaf_chars:
            return self.leaf(text[low:high])
        middle = (low + high) // 2
        return self._joined(text, low, middle, high, self._tree(text, low, middle), self._tree(text, middle, high))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The tokens of left + right from the tokens of both."""
        return self._joined(left + right, 0, len(left), len(left) + len(right), left_ids, right_ids)

    def _joined(self, text: str, low: int, seam: int, high: int, left_ids: list[int], right_ids: list[int]) -> list[int]:
        """The tokens of text[low:high] from those of both sides of the seam: the window's edges move outwards until both are cuts."""
        size, a = self.v.first_window, None
        while a is None:
            edge = max(low, seam - size)
            a = self._cut_before(text, edge, seam, low)
            if a is None and edge == low:
                a = low
            size *= 2
        size, b = self.v.first_window, None
        while b is None:
            edge = min(high, seam + size)
            b = self._cut_behind(text, seam, edge, high)
            if b is None and edge == high:
                b = high
            size *= 2
        window = self.leaf(text[a:b])
        keep = len(left_ids) if a == seam else self._tokens(left_ids, text[a:seam], from_end=True)
        skip = 0 if b == seam else self._tokens(right_ids, text[seam:b], from_end=False)
        if keep < len(left_ids):
            del left_ids[keep:]
        left_ids += window
        left_ids += right_ids[skip:] if skip else right_ids
        return left_ids

    @staticmethod
    def _cut_before(text: str, edge: int, seam: int, low: int) -> int | None:
        """The last place from edge on that is a cut of text[low:seam]."""
        at = seam - 1
        while True:
            at = text.rfind(" ", edge, at)
            if at < 0:
                return None
            if at > low and not text[at - 1].isspace() and not text[at + 1].isspace():
                return at

    @staticmethod
    def _cut_behind(text: str, seam: int, edge: int, high: int) -> int | None:
        """The first place before edge that is a cut of text[seam:high]."""
        at = seam
        while True:
            at = text.find(" ", at + 1, edge)
            if at < 0:
                return None
            if at + 1 < high and not text[at - 1].isspace() and not text[at + 1].isspace():
                return at

    def _tokens(self, ids: list[int], part: str, from_end: bool) -> int:
        """Where in ids the bytes of part, at the end or the start of the text, begin or end."""
        n_bytes, at, step, lengths = len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass")), 0, 0, self.lengths
        for i in reversed(ids) if from_end else ids:
            if at >= n_bytes:
                break
            at += lengths[i]
            step += 1
        if at != n_bytes:
            raise AssertionError("a token runs across a stable cut")
        return len(ids) - step if from_end else step

    def decode(self, ids: list[int]) -> bytes:
        """Leaves of the tree are runs of ids; concatenation is the monoid's operation, and associative, so all runs join at once."""
        leaf = self.v.leaf_chars
        return b"".join(b"".join(map(self.token_bytes.__getitem__, ids[low : low + leaf])) for low in range(0, len(ids), leaf))


@cache
def codec(vocabulary: Vocabulary) -> Codec:
    return Codec(vocabulary)


def digests(text: str, vocabulary: Vocabulary) -> tuple[int, str, str]:
    c = codec(vocabulary)
    ids = c.encode(text)
    return len(ids), sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(), sha256(c.decode(ids)).hexdigest()


def bpe_digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its number of tokens, and digests of its ids and of their decoding."""
    return per_text(docs, lambda text: digests(text, vocabulary), [*long("n_tokens"), *string("ids_sha256", "decoded_sha256")], id_col, text_col)


def bpe_encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: token_ids."""
    from pyspark.sql import types as T

    return per_text(docs, lambda text: (codec(vocabulary).encode(text),), [T.StructField("token_ids", T.ArrayType(T.LongType()))], id_col, text_col)


def bpe_decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row per row of token ids (null: none): the text; bytes that are no UTF-8 become U+FFFD."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([encoded.schema[id_col], *string("text")])

    def run(batches):
        for batch in batches:
            texts = [codec(vocabulary).decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)

