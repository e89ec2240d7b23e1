"""Arrow-batch text helpers shared by the operators of this subpackage.

Words are maximal runs of bytes other than space and ``\\x09-\\x0D``; all of
these are ASCII, so the runs are the same in bytes and in code points. Each
word becomes a 64-bit hash, computed for a block of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Texts are hashed in blocks of about this many bytes, so memory is bounded by
#: the block and the longest single text.
BLOCK_BYTES = 2 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_EXACT = _stream(11, 256)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_powers = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15 | 1, U64))
#: Bytes that are hashed by their places in the block, each word's sum divided by the power of where it begins: the same hash, without a place in the word for each byte.
_SHORT = 1 << 19
_ROOT = pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_by_place: list[np.ndarray] = []
_WORDS = {False: np.where(_SPACE, U64(0), _EXACT), True: np.where(_SPACE, U64(0), _LOWER)}


def _place_powers() -> list[np.ndarray]:
    """The powers by place in a block, and their inverses; made when first needed."""
    if not _by_place:
        down = np.full(_SHORT, _ROOT, U64)
        down[0] = 1
        _by_place.extend([np.multiply.accumulate(np.full(_SHORT, _powers[0], U64)), np.multiply.accumulate(down)])
    return _by_place


def _power_table(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.multiply.accumulate(np.full(1 << (n - 1).bit_length(), _powers[0], U64))
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls as empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hash_words(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and for each text where its words begin (n + 1)."""
    full = at[:-1][at[1:] > at[:-1]]
    if not len(raw):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    word = ~_SPACE[raw]
    first = np.ones(len(raw), bool)
    first[1:] = ~word[:-1]
    first[full] = True
    first &= word
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    if len(raw) <= _SHORT:
        up, down = _place_powers()
        value = _WORDS[lower][raw]
        value *= up[: len(raw)]
        hashes = np.add.reduceat(value, starts)
        hashes *= down[starts]
        return mix64(hashes), np.searchsorted(starts, at)
    spans = np.diff(starts, append=len(raw))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    value = (_LOWER if lower else _EXACT)[raw[starts[0] :]]
    value *= _power_table(int(spans.max()) + 1)[place]
    value[~word[starts[0] :]] = 0
    hashes = np.add.reduceat(value, starts - starts[0])
    return mix64(hashes), np.searchsorted(starts, at)


def word_blocks(column: pa.Array, lower: bool, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word bounds) for runs of rows of about block_bytes."""
    raw, at = utf8(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + block_bytes, "right")) - 1)
        high = min(high, n)
        yield low, high, *hash_words(raw[at[low] : at[high]], at[low : high + 1] - at[low], lower)
        low = high


def word_chunks(column: pa.Array, lower: bool, chunk_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As word_blocks, for larger runs of rows; the bytes are still hashed a block at a time."""
    _, at = utf8(column)
    parts: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def joined() -> tuple[int, int, np.ndarray, np.ndarray]:
        shifts = np.cumsum([0, *(len(p[2]) for p in parts)])
        bounds = [p[3][:-1] + k for p, k in zip(parts, shifts, strict=False)]
        return parts[0][0], parts[-1][1], np.concatenate([p[2] for p in parts]), np.concatenate([*bounds, shifts[-1:]])

    for part in word_blocks(column, lower, 256 << 10):  # what fits a core's cache
        parts.append(part)
        if at[part[1]] - at[parts[0][0]] >= chunk_bytes:
            out, parts = joined(), []  # the blocks are not kept beside it
            yield out
    if parts:
        yield joined()


def hash_of(word: str, lower: bool = True) -> int:
    """The hash that word_blocks gives a single word."""
    return int(next(word_blocks(pa.array([word]), lower))[2][0])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; the runs may cross texts, callers cut them."""
    if len(words) < width:
        return np.zeros(0, U64)
    factors = _stream(23, width) | U64(1)
    total = np.zeros(len(words) - width + 1, U64)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * factors[k]
    return mix64(total)


def short_hash(words: np.ndarray) -> int:
    """A hash for a whole sequence of fewer words than a shingle has."""
    total = U64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            total = total * U64(0xD6E8FEB86659FD93) + w
    return int(mix64(np.array([total], U64))[0])
