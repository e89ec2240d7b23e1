"""Personal data: fixed shapes as seeds, and bootstrapped contextual extraction.

Seeds (e-mail, IP, card and phone matches) and other identifier-like strings
are occurrences. Each has lexical patterns: the word or two before it, whatever
its own shape. Spark scores the graph of patterns and instances in rounds: a
pattern's confidence is the belief in its distinct instances as a (smoothed)
share of these and of the places, in texts where it has an instance, at which
another word follows it, so that a word found before anything is no pattern; an
instance's belief is that of the trusted patterns around it taken together.
Instances believed in one round are seeds of the next. Patterns of high
confidence and enough seeds then mark the strings that no fixed shape covers
(kind ``context``).

Spans are kind:start:end in code points, end exclusive. A null text counts as
empty; an empty text has no spans; repeated rows each get theirs; an empty
table gives an empty result. Only the id and text columns are read. Every
scan is linear in the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import SLICE_ROWS, long, string, written

KINDS = ("email", "ip", "card", "phone", "context")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Groups of digits (numbers of phones, accounts, cards), or a word of letters, digits and joints.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9])(?:[+(]{0,2}[0-9](?:[\x20().\x2F-]{0,2}[0-9]){4,31}(?![A-Za-z0-9_@])|[@#]?[A-Za-z0-9][A-Za-z0-9._/@-]{2,63}(?![A-Za-z0-9._/@-]))")
_MARK = re.compile(r"[0-9@_]")
_BEFORE = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; a pattern is trusted from least_seeds distinct believed instances and least_confidence on, an instance believed from least_confidence on; smoothing is added to its instances."""

    rounds: int = 2
    least_seeds: int = 3
    least_confidence: float = 0.7
    smoothing: float = 1.0
    context_chars: int = 80


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def _octets(value: str) -> bool:
    return all(len(p := part.lstrip("0") or "0") <= 3 and int(p) <= 255 for part in value.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *s) for s in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def patterns(text: str, start: int, context_chars: int) -> list[str]:
    """The lexical patterns of an occurrence: the last word before it, and the last two."""
    before = _plain(_BEFORE.findall(text[max(0, start - context_chars) : start])[-4:])[-2:]
    return [" ".join(before[-n:]) for n in (1, 2) if len(before) >= n]


def _plain(words: list[str]) -> list[str]:
    return [x for w in words if (x := w.strip(".,;:!?()[]\"'|#=").lower())]


def followed_by_others(text: str, seen: list[dict]) -> list[dict]:
    """For each pattern of the text's occurrences, at how many more places of the text it stands."""
    if not seen:
        return []
    words = _plain(_BEFORE.findall(text))
    places = Counter(words)
    places.update(map(" ".join, zip(words, words[1:], strict=False)))
    used = Counter(p for o in seen for p in o["patterns"])
    return [{"pattern": p, "n": places[p] - n} for p, n in used.items() if places[p] > n]


def occurrences(text: str, b: Bootstrap) -> tuple[list[tuple[str, int, int]], list[dict]]:
    """The base spans; and these and the candidates outside them, each with its patterns."""
    base = base_spans(text)
    seen = [{"kind": k, "start": s, "end": e, "instance": text[s:e], "patterns": patterns(text, s, b.context_chars)} for k, s, e in base]
    low = 0
    for stop, after in sorted((s, e) for _, s, e in base) + [(len(text), len(text))]:
        for m in _CANDIDATE.finditer(text, low, max(low, stop)):
            value = m[0].rstrip("._/@-")
            if len(value) < 4 or not _MARK.search(value):
                continue
            if p := patterns(text, m.start(), b.context_chars):
                seen.append({"kind": None, "start": m.start(), "end": m.start() + len(value), "instance": value, "patterns": p})
        low = max(low, after)
    return base, seen


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


_SEEN = T.ArrayType(T.StructType([*string("kind"), *long("start", "end"), *string("instance"), T.StructField("patterns", T.ArrayType(T.StringType()))]))
_SEEN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
_OTHERS = T.ArrayType(T.StructType([*string("pattern"), *long("n")]))
_OTHERS_ARROW = pa.list_(pa.struct([("pattern", pa.string()), ("n", pa.int64())]))
_COUNTS = ("n_email", "n_ip", "n_card", "n_phone")


def scan(docs: DataFrame, b: Bootstrap, id_col: str, text_col: str) -> DataFrame:
    schema = T.StructType([docs.schema[id_col], *long(*_COUNTS), *string("base_sha256", "base"), T.StructField("seen", _SEEN), T.StructField("others", _OTHERS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                texts = [x or "" for x in part.column(1).to_pylist()]
                rows = [occurrences(x, b) for x in texts]
                others = pa.array([followed_by_others(x, seen) for x, (_, seen) in zip(texts, rows, strict=True)], _OTHERS_ARROW)
                spans = [joined(base) for base, _ in rows]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS[:4]]
                digests = pa.array([sha256(s.encode()).hexdigest() for s in spans], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array(spans, pa.string()), pa.array([seen for _, seen in rows], _SEEN_ARROW), others], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pattern_scores(seen: DataFrame, others: DataFrame, b: Bootstrap = Bootstrap()) -> DataFrame:
    """(pattern, confidence, seeds) from rows of kind (null: no seed), instance, pattern, and of pattern, n: places where it has no instance."""
    edges = seen.groupBy("pattern", "instance").agg(F.max(F.col("kind").isNotNull().cast("int")).alias("seed"))
    edges = written(edges)
    others = written(others.groupBy("pattern").agg(F.sum("n").alias("others")))
    belief = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("belief"))
    for i in range(b.rounds):
        believed = F.sum((F.col("belief") >= b.least_confidence).cast("int"))
        scored = edges.join(belief, "instance").groupBy("pattern").agg(F.sum("belief").alias("belief"), F.count("*").alias("n"), believed.alias("seeds")).where(F.col("seeds") >= b.least_seeds)
        share = F.col("belief") / (F.col("n") + F.coalesce("others", F.lit(0)) + F.lit(b.smoothing))
        scored = written(scored.join(others, "pattern", "left").select("pattern", share.alias("confidence"), "seeds"))
        if i + 1 < b.rounds:
            trusted = scored.where(F.col("confidence") >= b.least_confidence).select("pattern", "confidence")
            doubt = F.exp(F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))
            belief = edges.join(trusted, "pattern", "left").groupBy("instance").agg(F.when(F.max("seed") == 1, F.lit(1.0)).otherwise(1 - doubt).alias("belief"))
    return scored


def personal_data(docs: DataFrame, b: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the fixed shapes, a digest of their spans, and all spans."""
    rows = written(scan(docs, b, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()))
    each = rows.select("__row", F.explode("seen").alias("o"))
    edges = each.select("o.kind", "o.instance", F.explode("o.patterns").alias("pattern"))
    others = rows.select(F.explode("others").alias("o")).select("o.pattern", "o.n")
    trusted = pattern_scores(edges, others, b).where(F.col("confidence") >= b.least_confidence).select("pattern")
    unseen = each.where(F.col("o.kind").isNull()).select("__row", "o.start", "o.end", F.explode("o.patterns").alias("pattern"))
    found = unseen.join(trusted, "pattern", "left_semi").select("__row", "start", "end").distinct()
    found = found.groupBy("__row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end"))), lambda s: F.concat(F.lit("context:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",").alias("more"), F.count("*").alias("n_context"))
    out = rows.join(found, "__row", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more")
    return out.select(id_col, *_COUNTS, F.coalesce("n_context", F.lit(0)).alias("n_context"), "base_sha256", spans.alias("spans"))
