"""User tables: rows are maps of text by column key; types come from the columns' definitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maps import canonical_json, merged
from ..functions.numbers import number_from_text
from ..functions.text import slug_key
from .facts import current, labelled, live, value, with_subject


@dataclass(frozen=True)
class ColumnDef:
    key: str
    label: str
    type: str = "text"


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def coerce(raw: Column, kind: str) -> Column:
    """An edited cell: '' is null; a number column takes numbers and else keeps the text."""
    raw = F.nullif(raw, F.lit(""))
    if kind == "number":
        n = raw.try_cast("double")
        return F.when(n.isNotNull(), F.regexp_replace(F.regexp_replace(n.cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", "")).otherwise(raw)
    return raw


def display(c: Column, kind: str) -> Column:
    """— for empty cells; numbers in groups of three with at most three places."""
    text = c
    if kind == "number":
        n = c.try_cast("double")
        grouped = F.regexp_replace(F.regexp_replace(F.format_number(n, 3), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        text = F.when(n.isNotNull(), grouped).otherwise(c)
    return F.when(is_empty(c), "—").otherwise(text)


def quick_filter(rows: DataFrame, columns: list[ColumnDef], query: str, data: str = "data") -> DataFrame:
    """The rows of which a visible, filled, formatted cell contains the query; all rows for an empty query."""
    q = query.strip().lower()
    if not q:
        return rows
    hit = F.lit(False)
    for c in columns:
        cell = F.element_at(F.col(data), c.key)
        hit = hit | F.coalesce(~is_empty(cell) & F.contains(F.lower(display(cell, c.type)), F.lit(q)), F.lit(False))
    return rows.where(hit)


def sort_keys(cell: Column, kind: str, descending: bool = False) -> list[Column]:
    """Numbers before other text in number columns, text without regard to case, empty cells last either way."""
    cell = F.nullif(cell, F.lit(""))
    flip = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    if kind == "number":
        n = cell.try_cast("double")
        return [cell.isNull().asc(), n.isNull().asc(), flip(n), flip(F.lower(cell))]
    return [cell.isNull().asc(), flip(F.lower(cell)), flip(cell)]


def sorted_rows(rows: DataFrame, column: ColumnDef, descending: bool = False, data: str = "data", tie: str = "id") -> DataFrame:
    return rows.orderBy(*sort_keys(F.element_at(F.col(data), column.key), column.type, descending), tie)


def page(rows: DataFrame, offset: int, limit: int, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def ordered_columns(columns: list[ColumnDef], order: list[str], hidden: set[str]) -> list[ColumnDef]:
    """Saved order first, the rest as defined, hidden ones out; all hidden shows all."""
    by_key = {c.key: c for c in columns}
    first = [by_key[k] for k in dict.fromkeys(order) if k in by_key]
    every = first + [c for c in columns if c not in first]
    return [c for c in every if c.key not in hidden] or every


def view_config(raw: object) -> dict:
    """A saved view, field by field; whatever isn't of its type falls away."""
    raw = raw if isinstance(raw, dict) else {}
    texts = lambda v: [x for x in v if isinstance(x, str)] if isinstance(v, list) else []
    sort = raw.get("sort")
    ok = isinstance(sort, dict) and isinstance(sort.get("key"), str) and sort.get("dir") in ("asc", "desc")
    return {"order": texts(raw.get("order")), "hidden": texts(raw.get("hidden")), "sort": {"key": sort["key"], "dir": sort["dir"]} if ok else None}


def same_value(a: Column, b: Column) -> Column:
    """Null is '', equal numbers are equal however written, else equal text."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    na, nb = a.try_cast("double"), b.try_cast("double")
    return F.when(na.isNotNull() & nb.isNotNull(), na == nb).otherwise(a == b)


def provenance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("provenance", F.when(F.col("human_edited") | F.col("created_by").isNotNull(), "human").otherwise("agent"))


def header_keys(labels: list[str]) -> list[str]:
    """Slugs of the headers; later equal ones get _2, _3 and so on, empty ones their place."""
    import re

    out: list[str] = []
    for i, label in enumerate(labels):
        base = re.sub("^_|_$", "", re.sub("[^a-z0-9]+", "_", label.strip().lower())) or f"column_{i + 1}"
        key, n = base, 2
        while key in out:
            key, n = f"{base}_{n}", n + 1
        out.append(key)
    return out


def numeric_columns(df: DataFrame) -> DataFrame:
    """(column, numeric): whether all filled cells of a text column are numbers, and one is filled."""
    checks = [F.struct(F.lit(c).alias("column"), ((F.count_if(F.trim(c) != "") > 0) & (F.count_if((F.trim(c) != "") & F.regexp_replace(c, "[, ]", "").try_cast("double").isNull()) == 0)).alias("numeric")) for c in df.columns]
    return df.agg(F.array(*checks).alias("all")).select(F.explode("all").alias("c")).select("c.*")


def unpivoted(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.lit(table).alias("table"), F.explode(cells).alias("c")).select("table", "c.column", "c.value")


def suggest_relations(cells: DataFrame, existing: DataFrame | None = None, limit: int | None = 6, least_score: float = 0.5, least_overlap: int = 1) -> DataFrame:
    """Links between columns (table, column, value rows) of different tables whose distinct values contain each other.

    The side of greater containment refers to the other. Values meet in one
    shuffle by value; a value's columns are at most as many as there are.
    """
    norm = F.lower(F.trim("value"))
    values = cells.where(norm != "").select("table", "column", norm.alias("v")).distinct()
    sizes = values.groupBy("table", "column").agg(F.count("*").alias("n")).where("n >= 2")
    a, b = (values.select(F.col("table").alias(f"{x}_table"), F.col("column").alias(f"{x}_column"), "v") for x in "ab")
    overlap = a.join(b, "v").where(F.col("a_table") < F.col("b_table")).groupBy("a_table", "a_column", "b_table", "b_column").agg(F.count("*").alias("overlap"))
    for x in "ab":
        overlap = overlap.join(sizes.select(F.col("table").alias(f"{x}_table"), F.col("column").alias(f"{x}_column"), F.col("n").alias(f"{x}_n")), [f"{x}_table", f"{x}_column"])
    ca, cb = F.col("overlap") / F.col("a_n"), F.col("overlap") / F.col("b_n")
    forward = ca >= cb
    side = lambda x, y, c: F.when(forward, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}"))
    out = overlap.withColumn("score", F.greatest(ca, cb)).where((F.col("overlap") >= least_overlap) & (F.col("score") >= least_score))
    out = out.select(side("a", "b", "table").alias("from_table"), side("a", "b", "column").alias("from_column"), side("b", "a", "table").alias("to_table"), side("b", "a", "column").alias("to_column"), "overlap", "score")
    if existing is not None:
        keys = ["from_table", "from_column", "to_table", "to_column"]
        flipped = existing.select(F.col("to_table").alias("from_table"), F.col("to_column").alias("from_column"), F.col("from_table").alias("to_table"), F.col("from_column").alias("to_column"))
        out = out.join(existing.select(*keys).unionByName(flipped), keys, "left_anti")
    out = out.orderBy(F.desc("score"), F.desc("overlap"), "from_table", "from_column", "to_table", "to_column")
    return out.limit(limit) if limit else out


def identity(cell: Column) -> Column:
    return F.nullif(F.lower(F.trim(cell)), F.lit(""))


def diff_snapshots(before: DataFrame, after: DataFrame, key: str | None, data: str = "data") -> DataFrame:
    """(change, identity, row): added and changed rows of ``after``, removed ones of ``before``; rows without identity compare as a whole."""
    def side(df: DataFrame) -> DataFrame:
        cell = F.element_at(F.col(data), key) if key else F.lit(None).cast("string")
        return df.select(F.coalesce(F.concat(F.lit("k:"), identity(cell)), F.concat(F.lit("j:"), canonical_json(data))).alias("k"), identity(cell).alias("identity"), canonical_json(data).alias("row"))

    a, b = side(before), side(after)
    last = a.groupBy("k").agg(F.max("row").alias("old"))
    new = b.join(last, "k", "left").withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("old") != F.col("row"), "changed")).where("change is not null").select("change", "identity", "row")
    return new.unionByName(a.join(b.select("k").distinct(), "k", "left_anti").select(F.lit("removed").alias("change"), "identity", "row"))


def reconcile(existing: DataFrame, incoming: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(action, target_id, data): sheet rows that are new, or change the row with their key; blank keys are always new.

    Of several rows with a key the last by (created_at, id) is matched.
    """
    cell = F.coalesce(F.lower(F.trim(F.element_at(F.col(data), key))), F.lit(""))
    old = existing.withColumn("k", cell).where("k <> ''").groupBy("k").agg(F.max_by(F.struct("id", F.col(data).alias("data")), F.struct("created_at", "id")).alias("old"))
    new = incoming.withColumn("k", cell)
    joined = new.join(old, "k", "left")
    both = merged(F.col("old.data"), F.col(data))
    action = F.when(F.col("old").isNull(), "add").when(canonical_json(both) != canonical_json("old.data"), "update")
    return joined.withColumn("action", action).where("action is not null").select("action", F.col("old.id").alias("target_id"), F.when(F.col("action") == "add", F.col(data)).otherwise(both).alias("data"))


def pending_changes(rows: DataFrame, columns: list[ColumnDef], data: str = "data") -> DataFrame:
    """Proposals with their target: kind, conflict (the target was edited by a person), and the columns that differ."""
    targets = rows.where("status = 'accepted'").select(F.col("id").alias("target_row_id"), F.col(data).alias("was"), F.col("human_edited").alias("target_edited"))
    p = rows.where("status = 'proposed'").join(targets, "target_row_id", "left")
    cells = F.filter(F.array(*(F.when(~same_value(F.element_at("was", c.key), F.element_at(F.col(data), c.key)), F.lit(c.key)) for c in columns)), lambda x: x.isNotNull())
    kind = F.when(F.col("was").isNull(), "add").otherwise("update")
    return p.select("id", "batch_id", kind.alias("kind"), F.coalesce(F.col("target_edited"), F.lit(False)).alias("conflict"), cells.alias("cells"))


def batch_rollup(pending: DataFrame) -> DataFrame:
    return pending.groupBy("batch_id").agg(F.count_if(F.col("kind") == "add").alias("adds"), F.count_if(F.col("kind") == "update").alias("updates"), F.count_if("conflict").alias("conflicts"))


def accept(rows: DataFrame, ids: DataFrame, data: str = "data") -> DataFrame:
    """The rows after accepting proposals: additions become rows, updates replace their target's data; both leave the queue."""
    taken = rows.join(ids, "id", "left_semi").where("status = 'proposed'")
    changes = taken.where("target_row_id is not null").groupBy("target_row_id").agg(F.max_by(F.col(data), "id").alias("new")).withColumnRenamed("target_row_id", "changed_id")
    left = rows.join(taken.select("id"), "id", "left_anti").join(changes, F.col("id") == F.col("changed_id"), "left")
    left = left.withColumn(data, F.coalesce("new", F.col(data))).withColumn("human_edited", F.col("human_edited") & F.col("new").isNull()).select(rows.columns)
    added = taken.where("target_row_id is null").withColumn("status", F.lit("accepted")).select(rows.columns)
    return left.unionByName(added)


def reject(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.join(rows.where("status = 'proposed'").select("id"), "id"), "id", "left_anti")


def project(facts: DataFrame, entities: DataFrame, kind: str, columns: list[ColumnDef], label_column: str | None = None) -> DataFrame:
    """entity_id and a column for each key: a kind's facts as a table.

    Text cells join their distinct values by ', '; number and date cells take
    the last by (valid_from, id).
    """
    e = live(entities).where(F.col("kind") == kind)
    keys = [c.key for c in columns if c.key != label_column]
    f = labelled(with_subject(current(facts), e), entities).withColumn("key", slug_key("predicate")).where(F.col("key").isin(keys))
    cell = {c.key: c.type for c in columns}
    v, order = value(), F.struct("valid_from", "id")
    aggs = []
    for k in keys:
        own = F.col("key") == k
        if cell[k] == "number":
            aggs.append(F.max_by(F.when(own, F.col("value_num")), F.when(own & F.col("value_num").isNotNull(), order)).alias(k))
        elif cell[k] == "date":
            aggs.append(F.max_by(F.when(own, F.date_format("value_date", "yyyy-MM-dd")), F.when(own & F.col("value_date").isNotNull(), order)).alias(k))
        else:
            aggs.append(F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(own, v))), ", "), F.lit("")).alias(k))
    wide = f.groupBy("subject_id").agg(*aggs) if aggs else f.select("subject_id").distinct()
    out = e.select(F.col("id").alias("subject_id"), *([F.col("label").alias(label_column)] if label_column else [])).join(wide, "subject_id", "left")
    return out.withColumnRenamed("subject_id", "entity_id")


def projection_status(projected: DataFrame, rows: DataFrame) -> DataFrame:
    """(entity_id, status) of projected rows with a ``data`` map against a table's rows: insert, update, unchanged, or skip where a person edited or a proposal waits."""
    p = projected.select("entity_id", canonical_json("data").alias("new"))
    r = rows.select(F.col("subject_entity_id").alias("entity_id"), canonical_json("data").alias("old"), "human_edited", (F.col("status") == "proposed").alias("waiting")).groupBy("entity_id").agg(F.max("old").alias("old"), F.bool_or(F.col("human_edited") | F.col("waiting")).alias("held"))
    return p.join(r, "entity_id", "left").select("entity_id", F.when(F.col("old").isNull(), "insert").when(F.col("held"), "skip").when(F.col("old") == F.col("new"), "unchanged").otherwise("update").alias("status"))


@dataclass(frozen=True)
class Source:
    """Where a derived column's cells come from: label, kind, attr, or relation (direction out, in, any; agg list, count)."""

    origin: str
    predicate: str | None = None
    direction: str = "any"
    agg: str = "list"


def derived_table(facts: DataFrame, entities: DataFrame, kind: str, columns: list[tuple[ColumnDef, Source]]) -> DataFrame:
    """One row for each live entity of a kind, each column from one aggregation over a single scan of its facts."""
    e = live(entities)
    subjects = e.where(F.col("kind") == kind)
    f = labelled(current(facts), e).withColumn("key", slug_key("predicate"))
    ends = with_subject(f, e)
    own = ends.where(F.col("subject_kind") == kind).select(F.col("subject_id").alias("entity_id"), "key", F.when(F.col("object_id").isNull(), "attr").otherwise("out").alias("role"), value().alias("v"))
    inn = ends.where(F.col("object_kind") == kind).select(F.col("object_id").alias("entity_id"), "key", F.lit("in").alias("role"), F.col("subject_label").alias("v"))
    wanted = {slug(s.predicate) for _, s in columns if s.predicate}
    both = own.unionByName(inn).where(F.col("key").isin(sorted(wanted)))
    aggs = []
    for c, s in columns:
        if s.origin in ("label", "kind"):
            continue
        roles = ["attr"] if s.origin == "attr" else {"out": ["out"], "in": ["in"], "any": ["in", "out"]}[s.direction]
        hit = (F.col("key") == slug(s.predicate)) & F.col("role").isin(roles)
        if s.agg == "count" and s.origin != "attr":
            aggs.append(F.count_if(hit).cast("string").alias(c.key))
            continue
        values = F.array_sort(F.collect_list(F.when(hit, F.struct((F.col("role") == "in").alias("r"), "v"))))
        joined = F.nullif(F.array_join(F.transform(values, lambda x: x["v"]), "; "), F.lit(""))
        if c.type == "number":
            first = number_from_text(F.element_at(F.transform(values, lambda x: x["v"]), 1))
            joined = F.when(F.size(values) > 0, F.coalesce(F.regexp_replace(F.regexp_replace(first.cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", ""), joined))
        aggs.append(joined.alias(c.key))
    out = subjects.select(F.col("id").alias("entity_id"), "label", "kind")
    if aggs:
        out = out.join(both.groupBy("entity_id").agg(*aggs), "entity_id", "left")
    picked = [F.col("label" if s.origin == "label" else "kind").alias(c.key) if s.origin in ("label", "kind") else (F.coalesce(c.key, F.lit("0")).alias(c.key) if s.agg == "count" else F.col(c.key)) for c, s in columns]
    return out.select("entity_id", *picked)


def slug(text: str) -> str:
    import re

    return re.sub("^_|_$", "", re.sub("[^a-z0-9]+", "_", text.strip().lower()))


def accepted_counts(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'accepted'").groupBy("dataset_id").agg(F.count("*").alias("n"))


def top_per(df: DataFrame, by: str, n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def related(left: DataFrame, right: DataFrame, left_column: str, right_column: str, left_columns: list[ColumnDef], right_columns: list[ColumnDef]) -> DataFrame:
    """(left_id, right_id): the rows of two tables that a relation links by equal cells; both columns must be there, empty cells link nothing."""
    for column, columns in ((left_column, left_columns), (right_column, right_columns)):
        if column not in {c.key for c in columns}:
            raise ValueError(f"no column {column}")
    cell = lambda c: F.nullif(F.trim(F.element_at("data", c)), F.lit(""))
    a = left.select(F.col("id").alias("left_id"), cell(left_column).alias("v")).where("v is not null")
    b = right.select(F.col("id").alias("right_id"), cell(right_column).alias("v")).where("v is not null")
    return a.join(b, "v").select("left_id", "right_id")
