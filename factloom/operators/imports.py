"""Tables and note vaults as graphs: entities and facts from rows and files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import KIND_RULES
from .tables import ColumnDef

#: Column names that name another entity (fixed values).
REFERENCE = re.compile("company|client|vendor|account|organi|org|person|contact|owner|assignee|customer|supplier|manager|lead|attendee|traveler|traveller|host|recipient|(^|_)by$|^for$|(^|_)from$|(^|_)to$", re.I)
#: Column names whose values identify a row (fixed values).
NATURAL_KEYS = ((r"^e?mail$|_email$", "email"), (r"phone|mobile|^tel$", "phone"), (r"invoice.*(no|num|#)|^invoice$|^inv$", "invoice_no"), (r"^id$|_id$|reference|ref_no|^ref$", "external_id"))


def kind_of_name(name: str) -> str:
    low = name.lower()
    for pattern, kind in KIND_RULES:
        if re.search(pattern, low):
            return kind
    word = low.strip()
    irregular = {"people": "person", "companies": "company", "entries": "entry", "parties": "party"}
    if word in irregular:
        return irregular[word]
    for ending, cut, add in (("ies", 3, "y"), *((e, 2, "") for e in ("ses", "xes", "zes", "ches", "shes"))):
        if word.endswith(ending):
            return word[:-cut] + add
    return (word[:-1] if word.endswith("s") and not word.endswith("ss") else word) or "record"


@dataclass
class Schema:
    """What a table's rows are: the kind, the column that names them, references (column, kind), attributes, natural keys."""

    kind: str
    subject: str
    references: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)


def infer_schema(table: str, columns: list[ColumnDef], rows: DataFrame, known_labels: DataFrame | None = None, kind: str | None = None, subject: str | None = None, roles: dict[str, str] | None = None) -> Schema:
    """roles: column to reference, attribute or skip. Without one, names decide, then whether half of the distinct values are known labels."""
    roles = roles or {}
    text = [c for c in columns if c.type not in ("number", "date")]
    named = lambda c: bool(REFERENCE.search(c.key) or REFERENCE.search(c.label))
    subject = subject or next((c.key for c in text if not named(c)), text[0].key if text else columns[0].key)
    out = Schema(kind or kind_of_name(table), subject)
    unsure = [c.key for c in text if c.key != subject and not named(c) and c.key not in roles]
    hits: set[str] = set()
    if known_labels is not None and unsure:
        cells = F.array(*(F.struct(F.lit(c).alias("c"), F.lower(F.trim(F.col(c).cast("string"))).alias("v")) for c in unsure))
        values = rows.select(F.explode(cells).alias("x")).select("x.*").where("v <> ''").distinct()
        known = known_labels.select(F.lower(F.trim("label")).alias("v")).distinct().withColumn("known", F.lit(1))
        shares = values.join(known, "v", "left").groupBy("c").agg((F.count("known") / F.count("*")).alias("share"))  # a row for each column
        hits = {r["c"] for r in shares.where("share >= 0.5").collect()}
    for c in columns:
        for pattern, key in NATURAL_KEYS:
            if re.search(pattern, c.key, re.I) or re.search(pattern, c.label, re.I):
                out.keys.setdefault(key, c.key)
                break
        role = roles.get(c.key) or ("reference" if c.type not in ("number", "date") and (named(c) or c.key in hits) else "attribute")
        if c.key == subject or role == "skip":
            continue
        if role == "reference":
            out.references[c.key] = kind_of_name(c.label)
        else:
            out.attributes[c.key] = c.type if c.type in ("number", "date") else "text"
    return out


def entity_id(kind: Column, label: Column) -> Column:
    """A surrogate from what an entity is: equal kind and label are one entity."""
    return F.substring(F.sha2(F.concat_ws("\x1f", kind, F.lower(F.trim(label))), 256), 1, 24)


def graph_of_table(rows: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(entities, facts) of a table: rows without a name are left out, references become entities, each once."""
    label = F.trim(F.col(schema.subject).cast("string"))
    base = rows.withColumn("__label", label).where("__label <> ''").withColumn("__id", entity_id(F.lit(schema.kind), F.col("__label")))
    keys = F.map_filter(F.create_map(*(x for k, c in schema.keys.items() for x in (F.lit(k), F.trim(F.col(c).cast("string"))))), lambda _, v: v != "") if schema.keys else F.create_map().cast("map<string,string>")
    cell = lambda c: F.trim(F.col(c).cast("string"))
    refs = [F.when(cell(c) != "", F.struct(F.lit(k).alias("kind"), cell(c).alias("label"))) for c, k in schema.references.items()]
    subjects = base.groupBy(F.col("__id").alias("id")).agg(F.lit(schema.kind).alias("kind"), F.min("__label").alias("label"), F.max_by(keys, F.to_json(keys)).alias("natural_keys"))
    entities = subjects
    if refs:
        named = base.select(F.explode(F.filter(F.array(*refs), lambda x: x.isNotNull())).alias("r")).select(entity_id(F.col("r.kind"), F.col("r.label")).alias("id"), "r.kind", "r.label")
        named = named.groupBy("id").agg(F.min("kind").alias("kind"), F.min("label").alias("label")).withColumn("natural_keys", F.create_map().cast("map<string,string>"))
        entities = subjects.unionByName(named.join(subjects.select("id"), "id", "left_anti"))
    fact = lambda p, obj=None, num=None, date=None, text=None: F.struct(F.lit(p).alias("predicate"), *((F.lit(None).cast(k) if v is None else v.cast(k)).alias(n) for n, v, k in (("object_id", obj, "string"), ("value_num", num, "double"), ("value_date", date, "date"), ("value_text", text, "string"))))
    made = [F.when(cell(c) != "", fact(c, obj=entity_id(F.lit(k), cell(c)))) for c, k in schema.references.items()]
    for c, kind in schema.attributes.items():
        if kind == "number":
            n = F.col(c).try_cast("double")
            made.append(F.when(n.isNotNull() & ~F.isnan(n), fact(c, num=n)))
        elif kind == "date":
            made.append(F.when(cell(c) != "", fact(c, date=F.substring(cell(c), 1, 10).try_cast("date"))))
        else:
            made.append(F.when(cell(c) != "", fact(c, text=F.col(c).cast("string"))))
    facts = base.select(F.col("__id").alias("subject_id"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("f")).select("subject_id", "f.*")
    return entities, facts


def combined(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several tables' graphs as one: an entity of equal kind and label is one, with all its keys."""
    ents = reduce(DataFrame.unionByName, (e for e, _ in graphs))
    ents = ents.groupBy("id", "kind").agg(F.min("label").alias("label"), F.max_by("natural_keys", F.size("natural_keys")).alias("natural_keys"))
    return ents, reduce(DataFrame.unionByName, (f for _, f in graphs)).distinct()


def preview(rows: DataFrame, schema: Schema, known: DataFrame) -> DataFrame:
    """(column, kind, known, new): how many distinct references exist already (id, kind, label rows)."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.lower(F.trim(F.col(c).cast("string"))).alias("label")) for c, k in schema.references.items()))
    values = rows.select(F.explode(cells).alias("x")).select("x.*").where("label <> ''").distinct()
    k = known.select("kind", F.lower(F.trim("label")).alias("label")).distinct().withColumn("hit", F.lit(1))
    return values.join(k, ["kind", "label"], "left").groupBy("column", "kind").agg(F.count("hit").alias("known"), (F.count("*") - F.count("hit")).alias("new"))


NOTE = T.StructType([T.StructField("title", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("props", T.MapType(T.StringType(), T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("body", T.StringType())])


def front_matter(text: str) -> tuple[dict[str, str | list[str]], str]:
    """The keys of a note's leading --- block (scalars, [a, b] and dashed lists), and the rest."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text
    out: dict[str, str | list[str]] = {}
    key = None
    plain = lambda s: s.strip().strip("\"'")
    for line in m[1].splitlines():
        if (item := re.match(r"\s*-\s+(.*)", line)) and key:
            held = out.get(key)
            out[key] = [*(held if isinstance(held, list) else []), plain(item[1])]
        elif pair := re.match(r"([A-Za-z][\w -]*):\s*(.*)$", line):
            key, value = pair[1].strip().lower(), pair[2].strip()
            out[key] = [plain(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else plain(value)
    return out, text[m.end() :]


def parse_note(path: str, text: str) -> dict:
    props, body = front_matter(text)
    listed = lambda k: [x for v in (props.get(k, []),) for x in (v if isinstance(v, list) else re.split(r"[,\s]+", v)) if x]
    tags = [t.lstrip("#").lower() for t in listed("tags") + listed("tag")] + [t.lower() for t in re.findall(r"(?:^|\s)#([A-Za-z][\w/-]*)", body)]
    links = [x.strip() for x in re.findall(r"\[\[([^\]|#\n]+)", body)]
    stem = re.sub(r"\.md$", "", path.rsplit("/", 1)[-1])
    rest = {k: v if isinstance(v, str) else ", ".join(v) for k, v in props.items() if k not in ("tags", "tag", "aliases", "alias", "title") and v}
    title = props.get("title")
    return {"title": title if isinstance(title, str) and title else stem, "folder": path.rsplit("/", 1)[0] if "/" in path else "", "props": rest, "tags": list(dict.fromkeys(tags)), "aliases": listed("aliases") + listed("alias"), "links": list(dict.fromkeys(links)), "body": body.strip()}


def notes(files: DataFrame, path_col: str = "path", text_col: str = "value") -> DataFrame:
    """A note vault's files (path, text), parsed in the tasks that read them."""
    import pyarrow as pa

    schema = T.StructType([T.StructField("path", T.StringType()), *NOTE])
    kinds = {"props": pa.map_(pa.string(), pa.string()), "tags": pa.list_(pa.string()), "aliases": pa.list_(pa.string()), "links": pa.list_(pa.string())}

    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            parsed = [parse_note(p or "", t or "") for p, t in zip(paths, batch.column(1).to_pylist(), strict=True)]
            columns = [pa.array([list(x[f.name].items()) if f.name == "props" else x[f.name] for x in parsed], kinds.get(f.name, pa.string())) for f in NOTE]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return files.select(path_col, text_col).mapInArrow(run, schema)


def vault_stats(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("notes"), F.sum(F.size("links")).alias("links"), F.count_distinct("folder").alias("folders"), F.sum(F.size("props")).alias("facts"))


def folder_shapes(parsed: DataFrame, least_notes: int = 3, share: float = 0.6, least_keys: int = 2) -> DataFrame:
    """(folder, keys): folders whose notes share properties: they are tables."""
    n = parsed.groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") >= least_notes)
    keys = parsed.select("folder", F.explode(F.map_keys("props")).alias("key")).groupBy("folder", "key").agg(F.count("*").alias("used"))
    return keys.join(n, "folder").where(F.col("used") >= F.lit(share) * F.col("n")).groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"), F.count("*").alias("c")).where(F.col("c") >= least_keys).drop("c")
