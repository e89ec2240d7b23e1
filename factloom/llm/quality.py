"""Quality rules: bands of zstandard compression ratio, over whole texts and fixed chunks.

Text that compresses far too well repeats itself; text that hardly compresses
is random. Short texts compress less than long ones, so each length class has
limits of its own. Fixed chunks catch a text of which a part is one or the
other while the whole still looks ordinary; every byte is in a chunk, the last,
shorter one is judged by its own length's class.

The limits are general ones (``Bands()``), or are fitted to a corpus by
``calibrated``: from all labelled rows it takes, for each length class, the range
of ratios that good texts have, by exact quantiles.

Defined cases: a null text counts as empty; an empty or very short text passes
the bands (the base rule rejects it); repeated rows each get their verdict; an
empty table gives an empty result; without labels of a class its general limits
hold. Only the id and text columns are read. Time is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, replace
from functools import cache, reduce
from math import floor, log2
from operator import or_

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import boolean, double, filter_texts, long, per_text, written

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


#: (from this many bytes on, least ratio, greatest ratio), ascending.
GENERAL = ((0, 0.0, 1e9), (64, 0.5, 4.0), (256, 0.9, 4.0), (512, 1.15, 4.2), (1024, 1.4, 4.5), (4096, 1.5, 5.5))


@dataclass(frozen=True)
class Bands:
    """Limits of raw bytes over compressed bytes.

    A text is judged by the limits of its length's class, and so is each chunk of
    chunk_bytes and the last, shorter one, their limits widened by chunk_slack. A
    text fails outside its limits, or when more than chunk_share of its bytes are
    in chunks outside theirs.
    """

    classes: tuple[tuple[int, float, float], ...] = GENERAL
    chunk_bytes: int = 2048
    chunk_share: float = 0.25
    chunk_slack: float = 1.05
    level: int = 3

    def allows(self, n_bytes: int, packed: int, slack: float = 1.0) -> bool:
        _, least, most = self.classes[bisect_right(self.classes, (n_bytes, 1e300)) - 1]
        return least / slack <= n_bytes / max(packed, 1) <= most * slack


@dataclass(frozen=True)
class Calibration:
    """How limits are fitted: from all labelled good texts, for each class of ``steps`` to an octave with at least
    least_rows of them, between the quantiles ``tail`` and 1 - tail, widened by slack."""

    steps: int = 2
    least_rows: int = 50
    tail: float = 0.002
    slack: float = 1.02


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _WORDS.findall(text)
    n_symbols = len(_SYMBOLS.findall(text))
    seen: set[str] = set()
    n_dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            n_dup_lines += 1
        elif _WORDS.search(line):
            seen.add(line)
    counts: dict[tuple[str, str, str], int] = {}
    windows = list(zip(words, words[1:], words[2:], strict=False))
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    n_repeat_words, covered = 0, 0
    if len(counts) < len(windows):
        for i, w in enumerate(windows):
            if counts[w] > 1:
                n_repeat_words += i + 3 - max(covered, i)
                covered = i + 3
    return len(words), sum(map(len, words)), n_symbols, n_dup_lines, n_repeat_words


def band_figures(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """The whole text's ratio, its chunks, the chunks outside their band, and the verdict."""
    n = len(raw)
    packed = len(packer.compress(raw))
    chunks = [raw[i : i + bands.chunk_bytes] for i in range(0, n, bands.chunk_bytes)]
    outside = [len(c) for c in chunks if not bands.allows(len(c), len(packer.compress(c)), bands.chunk_slack)] if len(chunks) > 1 else []
    return n / max(packed, 1), len(chunks), len(outside), bands.allows(n, packed) and sum(outside) <= bands.chunk_share * n


@cache
def _packer(level: int) -> zstandard.ZstdCompressor:
    """One for each Python worker; it cannot travel there."""
    return zstandard.ZstdCompressor(level=level, write_checksum=False)


def judged(text: str, bands: Bands) -> tuple:
    """The base counts, base_failed, kept, ratio, chunks and chunks outside their band."""
    counts = base_counts(text)
    n_words, n_repeat = counts[0], counts[4]
    failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    ratio, chunks, outside, passed = band_figures(text.encode("utf-8", "surrogatepass"), bands, _packer(bands.level))
    return *counts, failed, passed and not failed, ratio, chunks, outside


def calibrated(docs: DataFrame, labels: DataFrame, bands: Bands = Bands(), c: Calibration = Calibration(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Bands:
    """The bands with limits fitted to the texts that labels (id, 1 for good) call good and the base rule keeps.

    A class with too few such texts has general limits. Labels of null ids, and labels without a text, tell nothing.
    Every text is measured where it lies, so that only an id, a class and a ratio of each go to meet the labels.
    """
    first = 8 * c.steps  # classes begin at 256 bytes

    def row_of(text: str) -> tuple[int | None, float | None]:
        raw = text.encode("utf-8", "surrogatepass")
        counts = base_counts(text)
        if len(raw) < 256 or counts[0] < 50 or 100 * counts[4] > 50 * counts[0]:
            return None, None
        return min(floor(log2(len(raw)) * c.steps), 14 * c.steps), len(raw) / max(1, len(_packer(bands.level).compress(raw)))

    figures = per_text(docs, row_of, [*long("class"), *double("ratio")], id_col, text_col).where(F.col("class") >= first)
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("good"))
    figures = figures.join(good, F.col(id_col) == F.col("good"), "left_semi")
    limits = quantiles(figures, (c.tail, 1 - c.tail)).where(F.col("n") >= c.least_rows).collect()  # a row for each class
    fitted = {round(2 ** (r["class"] / c.steps)): (r["q"][0] / c.slack, r["q"][1] * c.slack) for r in limits}
    starts = sorted({k[0] for k in bands.classes} | {round(2 ** (k / c.steps)) for k in range(first, 14 * c.steps + 1)})
    general = {n: [k for k in bands.classes if k[0] <= n][-1][1:] for n in starts}
    return replace(bands, classes=tuple((n, *fitted.get(n, general[n])) for n in starts))


def quantiles(figures: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """For each class its rows (n) and the exact quantiles of ratio (q), as ``percentile`` has them of all rows.

    No task holds a class: equal ratios are one row with their number, and what lies in steps of 1/1024 octave without
    a quantile is one value for each step.
    """
    counts = written(figures.groupBy("class", "ratio").agg(F.count("*").alias("n"))).withColumn("step", F.floor(F.log2("ratio") * 1024))
    steps = counts.groupBy("class", "step").agg(F.sum("n").alias("here"), F.min("ratio").alias("least"))
    of_class = Window.partitionBy("class")  # a row for each step that occurs
    steps = steps.withColumn("upto", F.sum("here").over(of_class.orderBy("step"))).withColumn("last", F.sum("here").over(of_class) - 1)
    holds = [(F.col("upto") - F.col("here") <= F.ceil(F.col("last") * s)) & (F.floor(F.col("last") * s) < F.col("upto")) for s in shares]
    steps = steps.withColumn("exact", reduce(or_, holds)).select("class", "step", "least", "exact")
    return (
        counts.join(steps, ["class", "step"])
        .groupBy("class", F.when(F.col("exact"), F.col("ratio")).otherwise(F.col("least")).alias("ratio"))
        .agg(F.sum("n").alias("n"))
        .groupBy("class")
        .agg(F.sum("n").alias("n"), F.percentile("ratio", F.array(*map(F.lit, shares)), F.col("n")).alias("q"))
    )


def quality_figures(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, base_failed, kept, and the band figures."""
    fields = [*long("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), *boolean("base_failed", "kept"), *double("zstd_ratio"), *long("n_chunks", "n_chunks_outside")]
    return per_text(docs, lambda text: judged(text, bands), fields, id_col, text_col)


def quality_filter(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns as they are."""
    return filter_texts(docs, lambda text: judged(text, bands)[6], text_col)
