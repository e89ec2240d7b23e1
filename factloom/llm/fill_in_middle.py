"""Fill-in-middle: texts cut at two units and laid out as prefix, suffix and middle, all in DataFrame functions.

Units are ``[A-Za-z]+|[^A-Za-z]``, matched left to right over code points; a
text of n units is cut after two ordinals drawn from a digest of its id.

How it runs. A text is matched in runs of ``run_units`` units, so an ordinal's
run is known by division. Runs are exploded with their ordinal, and a window's
running sum of their lengths gives where each begins. Cut requests, a row for
each text and cut, meet their run by its ordinal; these runs are exploded into
units (``posexplode`` of the matches), where a running sum of unit lengths gives
the offset of the unit asked for. Units that no cut can fall on are not made
rows. Offsets are gathered for each text, which ``substr`` then cuts.

Rows have a number of their own, so equal or null ids stay apart and no key is
hot. Texts are dealt by that number, once for all branches of the plan. A text's
runs are rows: no task holds more than one text and its runs at once. The rows' numbers follow the scan, so docs must read the same when
they are read again (a table does); ``written`` docs always do.

Defined cases: a null text is empty; a null id is drawn as the empty id; an empty
text, or one with a mark in it, or one that the digest leaves alone, is plain;
a cut at 0 or n gives empty parts; repeated rows each get theirs; an empty table
gives an empty result. Only the id and text columns are read, whatever they and
the others are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: A form by its place here, while it is a number.
_FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True)
class Fim:
    """Of 100 texts, rate are transformed, spm_rate of 100 of these with the suffix first. seed: what the digest is of, before the id."""

    rate: int = 90
    spm_rate: int = 20
    seed: str = "1:"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    run_units: int = 64

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _draws(id_text: Column, c: Fim) -> list[Column]:
    """The first four 8-digit groups of the digest, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(c.seed), id_text).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _runs(text: Column, c: Fim) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?:[A-Za-z]++|[^A-Za-z]){{1,{c.run_units}}}+"), F.lit(0))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text), dealt by row."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartition("row")


def _cuts(texts: DataFrame, c: Fim) -> DataFrame:
    """row, n, form, runs, and asked: the units before the first and the second cut (nulls where the text is plain)."""
    h1, h2, h3, h4 = _draws(F.coalesce(F.col("id").cast("string"), F.lit("")), c)
    plain = (F.col("text") == "") | (h3 % 100 >= c.rate)
    for mark in c.marks:
        plain = plain | F.col("text").contains(mark)
    form = F.when(plain, _FORMS.index("plain")).when(h4 % 100 < c.spm_rate, _FORMS.index("spm")).otherwise(_FORMS.index("psm"))
    last = F.regexp_count(F.element_at("runs", -1), F.lit(UNIT))
    n = F.when(F.size("runs") > 0, (F.size("runs") - 1) * c.run_units + last).otherwise(0).cast("long")
    cuts = texts.select("row", form.alias("form"), h1.alias("h1"), h2.alias("h2"), _runs(F.col("text"), c).alias("runs")).withColumn("n", n)
    a, b = (F.when(F.col("form") > 0, F.col(h) % (F.col("n") + 1)) for h in ("h1", "h2"))
    return cuts.select("row", "n", "form", "runs", F.array(F.least(a, b), F.greatest(a, b)).alias("asked"))


def cut_offsets(texts: DataFrame, c: Fim = Fim()) -> DataFrame:
    """row, n, form, low, high: of each text its units, its form, and the code points before each cut (null where that is the text's end).

    A cut after k units is where unit k begins.
    """
    cuts, size = _cuts(texts, c), c.run_units
    of_text = Window.partitionBy("row").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # outer generators: a filter that Spark infers from the others would be pushed below the exchange, and texts be dealt once for each branch
    runs = (
        cuts.select("row", F.transform("asked", lambda k: F.floor(k / size).cast("int")).alias("wanted"), F.posexplode_outer(F.when(F.col("form") > 0, F.col("runs"))).alias("run", "part"))
        # only a run that is cut keeps its characters
        .select("row", "run", F.char_length("part").alias("length"), F.when(F.array_contains("wanted", F.col("run")), F.col("part")).alias("part"))
        .withColumn("start", F.coalesce(F.sum("length").over(of_text), F.lit(0)))
        .where(F.col("part").isNotNull())
        .select("row", "run", "start", "part")
    )
    requests = cuts.select("row", "n", "form", F.posexplode_outer("asked").alias("which", "ordinal")).withColumn("run", F.floor(F.col("ordinal") / size).cast("int"))
    of_run = Window.partitionBy("row", "run", "which").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    units = (
        requests.join(runs, ["row", "run"], "left")
        .select("row", "run", "which", "n", "form", "ordinal", "start", F.posexplode_outer(F.regexp_extract_all("part", F.lit(UNIT), F.lit(0))).alias("pos", "unit"))
        .select("row", "run", "which", "n", "form", "ordinal", "start", "pos", F.char_length("unit").alias("length"))
        .withColumn("before", F.col("start") + F.coalesce(F.sum("length").over(of_run), F.lit(0)))
    )
    here = F.col("ordinal") == F.col("run") * size + F.col("pos")
    low, high = (F.max(F.when(here & (F.col("which") == k), F.col("before"))) for k in range(2))
    return units.groupBy("row").agg(F.max("n").alias("n"), F.element_at(F.array(*map(F.lit, _FORMS)), F.max("form") + 1).alias("form"), low.alias("low"), high.alias("high"))


def laid_out(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column, c: Fim = Fim()) -> Column:
    p, s, m = (F.lit(x) for x in c.marks)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(form: Column, output: Column, c: Fim = Fim()) -> Column:
    """The text again, from its output and form: texts with a mark are plain, so each mark is there once."""

    def between(after: str, before: str | None) -> Column:
        rest = F.substr(output, F.locate(after, output) + len(after))
        return F.substr(rest, F.lit(1), F.locate(before, rest) - 1) if before else rest

    psm = F.concat(between(c.prefix, c.suffix), between(c.middle, None), between(c.suffix, c.middle))
    spm = F.concat(between(c.prefix, c.middle), between(c.middle, None), between(c.suffix, c.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, c: Fim = Fim(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n, form, prefix_chars and middle_chars (null if plain), and output, the transformed text."""
    texts = _numbered(docs, id_col, text_col)
    offsets = cut_offsets(texts, c)
    whole = F.char_length("text").cast("long")
    rows = texts.join(offsets.hint("shuffle_hash"), "row").select(
        "id", "text", "n", "form", whole.alias("whole"),
        *(F.when(F.col("form") != "plain", F.coalesce(F.col(k).cast("long"), whole)).alias(k) for k in ("low", "high")),
    )
    text, low, high = F.col("text"), F.col("low").cast("int"), F.col("high").cast("int")
    parts = F.substr(text, F.lit(1), low), F.substr(text, low + 1, high - low), F.substr(text, high + 1)
    return rows.select(
        F.col("id").alias(id_col), "n", "form", F.col("low").alias("prefix_chars"), (F.col("high") - F.col("low")).alias("middle_chars"),
        laid_out(F.col("form"), *parts, text, c).alias("output"),
    )


def digests(docs: DataFrame, c: Fim = Fim(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the figures, with digests of the output and of the text restored from it."""
    out = fill_in_middle(docs, c, id_col, text_col)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select(F.col(id_col), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"), c)).alias("restored_sha256"))


#: The same in DuckDB over ``documents``, with the parameters of ``Fim()``.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM docs),
cut AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
