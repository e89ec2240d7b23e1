"""Kinds as templates: vocabulary, health, growth, and canonical names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import predicates_look_alike
from .facts import current, has_value, live, value_type, with_subject
from .tables import ColumnDef

#: Predicates that fit any kind (fixed values).
UNIVERSAL = ("mentions", "about", "author", "file_type", "file_name", "created", "source")


@dataclass(frozen=True)
class Field:
    key: str
    type: str = "text"
    label: str = ""
    unit: str | None = None
    required: bool = False
    many: bool = False
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relation:
    predicate: str
    target: str
    label: str = ""
    many: bool = True
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Kind:
    kind: str
    label: str = ""
    aliases: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    relations: tuple[Relation, ...] = ()


@dataclass
class Registry:
    """The kinds of a vault: a small, named catalogue that travels with plans as literals."""

    kinds: dict[str, Kind] = field(default_factory=dict)

    def add(self, kind: Kind) -> Kind:
        """Adds a kind; a slug that is taken gets _2, _3 and so on."""
        slug, n = kind.kind, 2
        while slug in self.kinds:
            slug, n = f"{kind.kind}_{n}", n + 1
        kind = Kind(slug, kind.label or slug, kind.aliases, kind.fields, kind.relations)
        self.kinds[slug] = kind
        return kind

    def update(self, kind: Kind) -> None:
        if kind.kind not in self.kinds:
            raise KeyError(kind.kind)
        self.kinds[kind.kind] = kind

    def delete(self, slug: str) -> None:
        del self.kinds[slug]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """(kind, word, canonical, role, many) of all fields, relations and their aliases."""
        rows = [(k.kind, w, f.key, "field", f.many) for k in self.kinds.values() for f in k.fields for w in (f.key, *f.aliases)]
        rows += [(k.kind, w, r.predicate, "relation", r.many) for k in self.kinds.values() for r in k.relations for w in (r.predicate, *r.aliases)]
        return spark.createDataFrame(rows, "kind string, word string, canonical string, role string, many boolean")

    def names(self, spark: SparkSession) -> DataFrame:
        rows = [(a.lower(), k.kind) for k in self.kinds.values() for a in (k.kind, k.label, *k.aliases) if a]
        return spark.createDataFrame(list(dict(reversed(rows)).items()), "name string, kind string")


def columns_of(kind: Kind) -> list[ColumnDef]:
    """A kind's table: a name column, its fields, its relations as text."""
    return [ColumnDef("name", "Name"), *(ColumnDef(f.key, f.label or f.key.replace("_", " "), f.type) for f in kind.fields), *(ColumnDef(r.predicate, r.label or r.predicate.replace("_", " ")) for r in kind.relations)]


def fields_of(columns: list[ColumnDef], relations: set[str] = frozenset()) -> tuple[Field, ...]:
    return tuple(Field(c.key, c.type, c.label) for c in columns if c.key != "name" and c.key not in relations)


def synced(kind: Kind, columns: list[ColumnDef]) -> tuple[Kind, set[str], set[str]]:
    """The kind with its fields as the columns have them, and the keys that came and went."""
    relations = {r.predicate for r in kind.relations}
    old, new = {f.key: f for f in kind.fields}, {f.key: f for f in fields_of(columns, relations)}
    fields = tuple(Field(f.key, f.type, f.label, old[f.key].unit, old[f.key].required, old[f.key].many, old[f.key].aliases) if f.key in old else f for f in new.values())
    return Kind(kind.kind, kind.label, kind.aliases, fields, kind.relations), new.keys() - old.keys(), old.keys() - new.keys()


def health_facts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """predicate, kind, created_at, current, value_type, unit; placeholders are left out."""
    f = with_subject(facts.where(has_value()), live(entities))
    return f.select("predicate", F.col("subject_kind").alias("kind"), "created_at", F.col("valid_to").isNull().alias("current"), value_type().alias("value_type"), "unit")


def health(facts: DataFrame, vocabulary: DataFrame, now: str, window_days: int = 7) -> DataFrame:
    """Per kind: fact_count, distinct_predicates, conformance (null outside the registry), new_predicates, off_template; worst first."""
    first = facts.groupBy("kind", "predicate").agg(F.min("created_at").alias("first"), F.count_if("current").alias("n")).where("n > 0")
    known = vocabulary.select("kind", F.col("word").alias("predicate")).distinct().withColumn("known", F.lit(True))
    registered = vocabulary.select("kind").distinct().withColumn("registered", F.lit(True))
    p = first.join(known, ["kind", "predicate"], "left").join(registered, "kind", "left")
    conforms = F.col("predicate").isin(*UNIVERSAL) | F.coalesce("known", F.lit(False))
    fresh = F.col("first") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {window_days} days")
    p = p.withColumn("off", ~conforms & F.coalesce("registered", F.lit(False)))
    w = Window.partitionBy("kind", "off").orderBy(F.desc("n"), "predicate")
    p = p.withColumn("r", F.row_number().over(w))
    out = p.groupBy("kind").agg(
        F.sum("n").alias("fact_count"), F.count("*").alias("distinct_predicates"),
        F.when(F.bool_or(F.coalesce("registered", F.lit(False))), F.sum(F.when(conforms, F.col("n")).otherwise(0)) / F.sum("n")).alias("conformance"),
        F.array_join(F.array_sort(F.collect_set(F.when(fresh, F.col("predicate")))), ",").alias("new_predicates"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("off") & (F.col("r") <= 8), F.struct("r", "predicate")))), lambda x: x["predicate"]), ",").alias("off_template"),
    )
    return out.orderBy(F.asc_nulls_last("conformance"), F.desc("fact_count"), "kind")


def overall(facts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """conformance over the registry's kinds, and how many predicates there are."""
    known = vocabulary.select("kind", F.col("word").alias("predicate")).distinct().withColumn("known", F.lit(True))
    registered = vocabulary.select("kind").distinct().withColumn("registered", F.lit(True))
    f = facts.where("current").groupBy("kind", "predicate").agg(F.count("*").alias("n")).join(known, ["kind", "predicate"], "left").join(registered, "kind", "left")
    conforms = F.col("predicate").isin(*UNIVERSAL) | F.coalesce("known", F.lit(False))
    return f.agg((F.sum(F.when(F.col("registered") & conforms, F.col("n"))) / F.sum(F.when(F.col("registered"), F.col("n")))).alias("conformance"), F.count_distinct("predicate").alias("distinct_predicates"))


def field_proposals(facts: DataFrame, vocabulary: DataFrame, least: int = 3, per_kind: int = 2) -> DataFrame:
    """kind, predicate, count, value_type, unit, alias_of, as_relation: off-template predicates that a template should have."""
    registered = vocabulary.select("kind").distinct()
    known = vocabulary.select("kind", F.col("word").alias("predicate")).distinct()
    f = facts.where("current").where(~F.col("predicate").isin(*UNIVERSAL)).join(registered, "kind", "left_semi").join(known, ["kind", "predicate"], "left_anti")
    kinds = f.groupBy("kind", "predicate", "value_type", "unit").agg(F.count("*").alias("n"))
    types = kinds.groupBy("kind", "predicate", "value_type").agg(F.sum("n").alias("n")).groupBy("kind", "predicate").agg(F.sum("n").alias("count"), F.min_by("value_type", F.struct(-F.col("n"), "value_type")).alias("value_type"))
    units = kinds.where("unit is not null").groupBy("kind", "predicate", "unit").agg(F.sum("n").alias("n")).groupBy("kind", "predicate").agg(F.min_by("unit", F.struct(-F.col("n"), "unit")).alias("unit"))
    w = Window.partitionBy("kind").orderBy(F.desc("count"), "predicate")
    top = types.where(F.col("count") >= least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_kind).join(units, ["kind", "predicate"], "left")
    keys = vocabulary.select("kind", "canonical").distinct()
    alike = top.join(keys, "kind").where(predicates_look_alike("predicate", "canonical")).groupBy("kind", "predicate").agg(F.min("canonical").alias("alias_of"))
    out = top.join(alike, ["kind", "predicate"], "left")
    return out.select("kind", "predicate", "count", "value_type", "unit", "alias_of", (F.col("alias_of").isNull() & (F.col("value_type") == "entity")).alias("as_relation"))


def category_proposals(entities: DataFrame, names: DataFrame, asked: DataFrame | None = None, least: int = 3, samples: int = 5) -> DataFrame:
    """(kind, count, samples): unregistered kinds with enough live entities that were never proposed."""
    e = live(entities).join(names.select(F.col("name").alias("kind")), "kind", "left_anti")
    if asked is not None:
        e = e.join(asked.select("kind"), "kind", "left_anti")
    w = Window.partitionBy("kind").orderBy(F.desc("support"), "label", "id")
    ranked = e.withColumn("r", F.row_number().over(w))
    return ranked.groupBy("kind").agg(F.count("*").alias("count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= samples, F.struct("r", "label")))), lambda x: x["label"]), "; ").alias("samples")).where(F.col("count") >= least)


def canonical(x_entities: DataFrame, x_facts: DataFrame, names: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted entities with kinds, and facts with predicates, by their registered names (others stay)."""
    n = names.select(F.col("name").alias("said"), F.col("kind").alias("registered"))
    ents = x_entities.join(n, F.lower(F.trim("kind")) == F.col("said"), "left").withColumn("kind", F.coalesce("registered", F.lower(F.trim("kind")))).drop("said", "registered")
    kinds = ents.select("extraction_id", F.col("local_id").alias("subject_local_id"), F.col("kind").alias("subject_kind"))
    v = vocabulary.select(F.col("kind").alias("subject_kind"), F.col("word").alias("predicate"), "canonical").distinct()
    fs = x_facts.join(kinds, ["extraction_id", "subject_local_id"], "left").join(v, ["subject_kind", "predicate"], "left").withColumn("predicate", F.coalesce("canonical", "predicate")).drop("canonical", "subject_kind")
    return ents, fs


def missing_slots(entities: DataFrame, facts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(subject_id, predicate): template fields of live entities that no current fact holds, placeholder or not."""
    fields = vocabulary.where("role = 'field' and word = canonical").select("kind", F.col("word").alias("predicate"))
    slots = live(entities).select(F.col("id").alias("subject_id"), "kind").join(fields, "kind").select("subject_id", "predicate")
    return slots.join(current(facts).select("subject_id", "predicate"), ["subject_id", "predicate"], "left_anti")


def record(entities: DataFrame, facts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(subject_id, predicate, section, values): template fields, then other attributes, then relations by predicate."""
    from .facts import labelled, value

    f = labelled(with_subject(current(facts).where(has_value()), live(entities)), entities).withColumn("said", value())
    known = vocabulary.where("role = 'field'").select(F.col("kind").alias("subject_kind"), F.col("word").alias("predicate"), F.lit(True).alias("field")).distinct()
    f = f.join(known, ["subject_kind", "predicate"], "left")
    section = F.when(F.col("object_id").isNotNull(), "relation").when(F.col("field"), "field").otherwise("other")
    return f.groupBy("subject_id", "predicate", section.alias("section")).agg(F.array_join(F.array_sort(F.collect_list("said")), "; ").alias("values"))
