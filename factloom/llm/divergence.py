"""Source divergence audit: which sources of a language use its words unlike the others, and by which words.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased.
A language keeps the terms that enough of its documents have. Each source of
the language, and the language itself, gives each kept term a smoothed share in
parts of 10^9; two of them differ by the sum over kept terms of
``(p - q)^2 / (p + q)``, each quotient rounded down. All arithmetic is in
integers.

How it runs. One scan counts terms by (language, source) within a task's block
of texts, and a partial aggregate adds the blocks up. Ranges of the sorted
(language, term) order then become integer dictionaries: in each range the kept
terms are a sorted array, a row's term becomes an id by ``searchsorted``, and
``bincount`` makes one dense vector for each source and chunk of ids. Ids ascend
with the terms' UTF-8 bytes, across chunks too, so ties are broken by comparing
ids. Chunks are worked on one by one: each gives its part of every pair's sum and
its best terms of every source.

Bounds: a task holds ``block_terms`` distinct terms in the scan, then
``cells`` counts of a chunk; a chunk has fewer terms where a language has more
sources. Copies, hot sources and hot words are added up before any shuffle, so a
term is a row for each task and source at most. Nothing goes to the driver but
the greatest number of sources of a language.

Defined cases: null text, language or source count as ''; a source without terms
has its row in every pair; a language without kept terms gives pairs of value 0
and no terms; a language's only source has no pairs; repeated rows count each
time; an empty table gives an empty result. Only the three named columns are
read. A very long text is counted in pieces and its distinct terms are held.
Counts are exact to 2^53, shares to 9 x 10^15 occurrences in a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import SLICE_ROWS, written

#: A byte of a term as it counts, or a space for a byte of none.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: A text is split into terms so many bytes at a time.
_PIECE = 1 << 20
#: Rows of the sorted order that a task turns into chunks at once.
_SORTED_ROWS = 1 << 17
#: Bits of an id that are its place in a chunk; those of a chunk's number in its range.
_PLACE_BITS, _NUMBER_BITS = 12, 32


@dataclass(frozen=True)
class Audit:
    """min_docs: documents of its language that a kept term is in. top: terms listed for a source.

    scale, smooth: a share is ``1 + floor(scale * (count + smooth) / (N + smooth * V))``.
    """

    min_docs: int = 10
    top: int = 10
    scale_thousands: int = 3
    smooth: int = 2
    block_terms: int = 300_000
    cells: int = 1 << 22


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time; a term is never cut."""
    plain, low = text.translate(_TERM_BYTES), 0
    while low < len(plain):
        high = plain.find(b" ", low + _PIECE)
        high = len(plain) if high < 0 else high
        yield plain[low:high].split()
        low = high


def _counted(docs: DataFrame, a: Audit) -> DataFrame:
    """(lang, source, term, n, df), added up within blocks; each group of a block has a row of the empty term."""

    def flushed(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in groups.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()), pa.array([b"", *terms], pa.binary()),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, terms)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "df"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                    before, met = len(n), set()
                    for terms in terms_of(text):
                        n.update(terms)
                        met.update(terms)
                    df.update(met)
                    held += len(n) - before + 1
                    if held > a.block_terms:
                        yield from flushed(groups)
                        groups, held = {}, 0
        yield from flushed(groups)

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, df long")


def _chunks(counts: DataFrame, a: Audit, chunk_terms: int) -> DataFrame:
    """(lang, chunk, source, n, counts, terms) for each chunk and source that has terms in it.

    A row without a source is the language's own and has the chunk's terms. Rows
    of counts come sorted by (lang, term), one task to a range.
    """

    def vectors(rows: pa.Table, number: int) -> Iterator[tuple]:
        """Chunks of whole terms of one language."""
        term = rows["term"].combine_chunks().dictionary_encode()
        source = rows["source"].combine_chunks().dictionary_encode()
        code, who = term.indices.to_numpy(), source.indices.to_numpy()
        n, df = rows["n"].to_numpy(), rows["df"].to_numpy()
        first = np.flatnonzero(np.diff(code, prepend=-1))
        kept = np.flatnonzero(np.add.reduceat(df, first) >= a.min_docs)  # codes ascend with the terms
        for low in range(0, len(kept), chunk_terms):
            mine = kept[low : low + chunk_terms]
            ids = np.minimum(np.searchsorted(mine, code), len(mine) - 1)
            here = mine[ids] == code
            dense = np.bincount(who[here] * len(mine) + ids[here], n[here], len(source.dictionary) * len(mine)).astype(np.int64).reshape(-1, len(mine))
            yield number, None, dense.sum(0), term.dictionary.take(pa.array(mine)).to_pylist()
            for i in np.flatnonzero(dense.any(1)):
                yield number, source.dictionary[int(i)].as_py(), dense[i], None
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _NUMBER_BITS
        held: pa.Table | None = None

        def cut(rows: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
            """Tables of whole terms, one for each language, and the rows of the last term, which may go on."""
            lang, term = (rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
            at = np.flatnonzero(np.diff(lang))
            ends = [0, *(int(i) + 1 for i in at), rows.num_rows]
            whole = [rows.slice(i, j - i) for i, j in zip(ends, ends[1:], strict=False)]
            if last:
                return whole, None
            changes = np.flatnonzero(np.diff(term[ends[-2] :]))
            start = int(changes[-1]) + 1 if len(changes) else 0
            whole[-1:] = [whole[-1].slice(0, start)] if start else []
            return whole, rows.slice(ends[-2] + start)

        def out(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for rows in tables:
                lang = rows["lang"][0].as_py()
                for number_, source, dense, terms in vectors(rows, number):
                    number = number_ + 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang], pa.string()), pa.array([number_], pa.int64()), pa.array([source], pa.string()), pa.array([int(dense.sum())], pa.int64()),
                            pa.array([dense], pa.list_(pa.int64())), pa.array([terms], pa.list_(pa.binary())),
                        ],
                        ["lang", "chunk", "source", "n", "counts", "terms"],
                    )

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= _SORTED_ROWS:
                whole, held = cut(held, False)
                yield from out(whole)
        if held is not None and held.num_rows:
            yield from out(cut(held, True)[0])

    return counts.mapInArrow(run, "lang string, chunk long, source string, n long, counts array<long>, terms array<binary>")


def shares(counts: np.ndarray, n: np.ndarray | int, v: int, a: Audit = Audit()) -> np.ndarray:
    """1 + floor(1000^k * (count + smooth) / (n + smooth * v)), by long division, three decimal digits at a time."""
    over = n + a.smooth * v
    rest, share = counts + a.smooth, 0
    for _ in range(a.scale_thousands):
        digits, rest = np.divmod(rest * 1000, over)
        share = share * 1000 + digits
    return share + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compared(frame: DataFrame, a: Audit) -> DataFrame:
    """Each chunk's part of all pairs (source < item), and its first terms of each source."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("source")
        own = rows["terms"].is_valid().to_numpy(zero_copy_only=False)
        head = rows.filter(pa.array(own)).slice(0, 1).to_pylist()[0]
        groups = rows.filter(pa.array(~own))
        sources, width = groups["source"].to_pylist(), len(head["counts"])
        counts = np.zeros((len(sources), width), np.int64)
        for i, c in enumerate(groups["counts"]):
            if c.is_valid:
                counts[i] = c.values.to_numpy()
        p = shares(counts, groups["total"].to_numpy()[:, None], head["v"], a)
        q = shares(np.array(head["counts"], np.int64), head["total"], head["v"], a)
        out: dict[str, list] = {c: [] for c in ("source", "part", "item", "value", "id")}

        def add(source: str, part: str, items: list, values: np.ndarray, ids: list) -> None:
            for column, cells in zip(out.values(), ([source] * len(items), [part] * len(items), items, values.tolist(), ids), strict=True):
                column.extend(cells)

        for i, source in enumerate(sources):
            pairs = differences(p[i + 1 :], p[i]).sum(1)
            add(source, "pair", [s.encode() for s in sources[i + 1 :]], pairs, [None] * len(pairs))
            more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            values = differences(p[i, more], q[more])
            best = np.lexsort((more, -values))[: a.top]
            add(source, "term", [head["terms"][k] for k in more[best]], values[best], [(head["chunk"] << _PLACE_BITS) + int(k) for k in more[best]])
        lang = pa.array([head["lang"]] * len(out["source"]), pa.string())
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([lang, *(pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True))], ["lang", *out])

    return frame.groupBy("lang", "chunk").applyInArrow(run, "lang string, source string, part string, item binary, value long, id long")


def source_divergence(docs: DataFrame, a: Audit = Audit(), lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` has the source's difference from each other source of its
    language; part ``term`` its first terms with a greater share than the
    language has. Ranks begin at 1 for each source and part, by descending value
    and then the item's UTF-8 bytes.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = written(_counted(rows, a).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    no_term = F.octet_length("term") == 0
    groups = counts.where(no_term).select("lang", "source")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    chunk_terms = max(1, min(1 << _PLACE_BITS, a.cells // most))
    ranges = counts.where(~no_term).repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    chunks = written(_chunks(ranges, a, chunk_terms))

    of_lang = chunks.where(F.col("source").isNull())
    langs = of_lang.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("v"), F.sum("n").alias("lang_total"))
    totals = groups.join(chunks.where(F.col("source").isNotNull()).groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    heads = of_lang.join(langs, "lang").select("lang", "chunk", "source", F.col("lang_total").alias("total"), "v", "counts", "terms")
    vectors = chunks.where(F.col("source").isNotNull()).select("lang", "chunk", "source", "counts")
    members = of_lang.select("lang", "chunk").join(totals, "lang").join(vectors, ["lang", "chunk", "source"], "left")
    members = members.select("lang", "chunk", "source", "total", F.lit(None).cast("long").alias("v"), "counts", F.lit(None).cast("array<binary>").alias("terms"))
    parts = written(_compared(heads.unionByName(members), a))

    pairs = parts.where(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("item", F.col("item").cast("string"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    bare = groups.join(langs, "lang", "left_anti")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    in_group = Window.partitionBy("lang", "source")
    ranked = both.unionByName(none).withColumn("rank", F.row_number().over(in_group.orderBy(F.desc("value"), "item")))
    terms = parts.where(F.col("part") == "term").withColumn("rank", F.row_number().over(in_group.orderBy(F.desc("value"), "id"))).where(F.col("rank") <= a.top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("item", F.col("item").cast("string")).select(*columns))


#: The same in DuckDB over ``documents``, with the parameters of ``Audit()``.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM docs),
terms AS (SELECT k, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shared AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM cells JOIN sizes USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q FROM cells JOIN sizes USING (lang) GROUP BY lang, term, v),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shared JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM best))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
