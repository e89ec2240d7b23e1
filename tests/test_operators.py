"""Operators on small worlds of our own."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.operators import imports as I
from factloom.operators import lenses as L
from factloom.operators import ontology as O
from factloom.functions.sections import split_text
from factloom.operators import resolve as R
from factloom.operators import search as S
from factloom.operators import tables as T
from factloom.operators.storage import VersionedTable
from factloom.sources import capture, outbound, sheets

FACT = "id string, subject_id string, predicate string, object_id string, value_text string, value_num double, value_date date, unit string, cardinality string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, superseded_by string, source_item_id string, created_at timestamp_ntz"
ENTITY = "id string, kind string, label string, support int, created_at timestamp_ntz, merged_into string, natural_keys map<string,string>"
T0 = datetime(2024, 1, 1)


def world(spark):
    ents = [("acme", "company", "Acme", 2, T0, None, {}), *((f"p{i}", "person", f"P{i}", 1, T0, None, {"email": f"p{i}@x.org"}) for i in range(6)), ("i1", "invoice", "INV-1", 1, T0, None, {}), ("d1", "document", "Doc", 1, T0, None, {}), ("x", "note", "Alone", 1, T0, None, {})]
    rel = [(f"p{i}", "works_at", "acme") for i in range(6)] + [("i1", "issued_by", "acme"), ("d1", "about", "i1"), ("p0", "knows", "p1"), ("p0", "knows", "p2"), ("p1", "knows", "p2")]
    facts = [(f"f{n}", s, p, o, None, None, None, None, "many", 0.5 + n / 100, T0, None, None, None, T0) for n, (s, p, o) in enumerate(rel)]
    facts.append(("fa", "i1", "amount", None, None, 12000.0, None, "USD", "one", 0.9, T0, None, None, None, T0))
    return spark.createDataFrame(ents, ENTITY), spark.createDataFrame(facts, FACT)


def test_ego_caps_and_parents(spark):
    e, f = world(spark)
    rows = {r["id"]: (r["hop"], r["rank"], r["parent"]) for r in G.ego(e, f, "acme", ring1=3).collect()}
    assert rows["acme"] == (0, 0, None)
    assert [k for k, v in sorted(rows.items(), key=lambda x: x[1][1]) if v[0] == 1] == ["i1", "p0", "p1"]
    assert G.ego(e, f, "nobody").count() == 0


def test_clustered_ring_folds(spark):
    e, f = world(spark)
    rows = G.clustered_ring(e, f, "acme", ring=4, per_kind=3).collect()
    assert {r["member"] for r in rows if r["member"]} == {"p0", "p1", "p2", "i1"}
    assert [(r["kind"], r["count"], r["predicate"]) for r in rows if not r["member"]] == [("person", 3, "works_at")]


def test_breadth_first_and_layers(spark):
    e, f = world(spark)
    assert {r["id"]: r["depth"] for r in G.breadth_first(f, "acme").collect()} == {"acme": 0, **{f"p{i}": 1 for i in range(6)}, "i1": 1, "d1": 2}
    rows = {r["id"]: (r["parent"], r["shown"]) for r in G.layered(e, f, "acme", fold=5).collect()}
    assert rows["d1"] == ("i1", True) and sum(not s for _, s in rows.values()) == 2


def test_link_and_expand(spark):
    e, f = world(spark)
    n = G.with_edges(e, f)
    assert [r["id"] for r in S.link_entities(n, ["acme"]).collect()] == ["acme"]
    assert [r["id"] for r in S.link_entities(n, ["p3@x.org"]).collect()] == ["p3"]
    hits = S.expand(f, n, spark.createDataFrame([("i1",)], "id string"))
    assert {(r["id"], r["score"]) for r in hits.collect()} >= {("i1", 10), ("d1", 4)}
    assert S.expand(f, n, spark.createDataFrame([], "id string")).count() == 0


def test_routing_needs_a_clear_winner(spark):
    agents = spark.createDataFrame([(1, "Invoices", "supplier bills and payments"), (2, "Travel", "flights hotels bills")], "agent_id int, name string, purpose string")
    p = S.agent_profiles(agents)
    msgs = spark.createDataFrame([(1, "an invoice and payment"), (2, "bills"), (3, "hello")], "message_id int, text string")
    assert [(r["message_id"], r["agent_id"]) for r in S.route(msgs, p).collect()] == [(1, 1)]


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("d", 0, 0.0, "a" * 10), ("d", 1, 0.0, "b" * 10), ("d", 2, 5.0, "c" * 100), ("d", 3, 4.0, "e" * 5)], "doc_id string, seq int, score double, text string")
    assert S.select_chunks(df, budget=30).first()["seqs"] == [0, 1, 3]


def test_chunks_lose_nothing():
    text = "\n\n".join(["Sentence one. " * 200, "short", "x" * 3000])
    parts = split_text(text, 1200)
    assert all(len(p) <= 1200 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_typed_sort_keeps_empties_last(spark):
    rows = spark.createDataFrame([(1, {"n": "10"}), (2, {"n": ""}), (3, {"n": "9"}), (4, {"n": "abc"}), (5, {})], "id int, data map<string,string>")
    c = T.ColumnDef("n", "N", "number")
    assert [r["id"] for r in T.sorted_rows(rows, c).collect()] == [3, 1, 4, 2, 5]
    assert [r["id"] for r in T.sorted_rows(rows, c, True).collect()][:2] == [1, 3]


def test_snapshot_diff_without_identity(spark):
    a = spark.createDataFrame([({"k": "1", "v": "x"},), ({"v": "lost"},)], "data map<string,string>")
    b = spark.createDataFrame([({"k": "1", "v": "y"},), ({"k": "2"},), ({"v": "new"},)], "data map<string,string>")
    got = sorted(((r["change"], r["identity"]) for r in T.diff_snapshots(a, b, "k").collect()), key=str)
    assert got == [("added", "2"), ("added", None), ("changed", "1"), ("removed", None)]


def test_view_helpers():
    assert T.header_keys(["Name", "name ", "", "Name"]) == ["name", "name_2", "column_3", "name_3"]
    cols = [T.ColumnDef("a", "A"), T.ColumnDef("b", "B")]
    assert [c.key for c in T.ordered_columns(cols, ["b", "z"], {"a"})] == ["b"]
    assert len(T.ordered_columns(cols, [], {"a", "b"})) == 2
    assert T.view_config({"order": ["a", 1], "sort": {"key": "a", "dir": "up"}}) == {"order": ["a"], "hidden": [], "sort": None}


def test_fold_holds_fills_and_dedupes():
    t = T0
    made, state = R.fold_claim(iter([("a", t, "s1", None, 0.0), ("b", t, "s2", "Red", 0.8), ("c", t, "s3", " red ", 0.6), ("d", t, "s4", "blue", 0.7), ("e", t, "s5", "blue", 0.9)]))
    assert [m[1] for m in made] == ["new", "filled", "deduped", "held", "superseded"]
    assert state[:3] == ("e", "blue", 0.9)
    assert [m[1] for m in R.fold_claim(iter([("a", t, "s", "x", 0.9), ("b", t, "t", "y", 0.6)]))[0]] == ["new", "held"]


def test_fold_of_many_batches_is_one_fold(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [("k", f"f{i:02}", T0, f"s{i:02}", "ab"[i // 5 % 2], 0.9) for i in range(20)]
    out = R.fold_facts(spark.createDataFrame(rows, R.CLAIM))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["outcome"] for r in out.collect()).count("superseded") == 3


def test_merge_follows_chains_and_unites_keys(spark):
    e, f = world(spark)
    merges = spark.createDataFrame([("p2", "p1"), ("p1", "p0")], "loser string, winner string")
    facts, ents = R.merge_entities(f, e, merges)
    assert facts.where("subject_id in ('p1', 'p2') or object_id in ('p1', 'p2')").count() == 0
    rows = {r["id"]: r for r in ents.collect()}
    assert rows["p2"]["merged_into"] == "p0" and rows["p0"]["natural_keys"] == {"email": "p0@x.org"}


def test_pairs_and_winner(spark):
    e, _ = world(spark)
    e = e.withColumn("edges", F.when(F.col("id") == "p1", 5).otherwise(1))
    pairs = spark.createDataFrame([("p0", "acme", 0.9), ("acme", "p0", 0.95), ("p0", "p1", 0.8)], "a_id string, b_id string, sim double")
    left = R.filter_pairs(pairs, spark.createDataFrame([], "a_id string, b_id string"), e)
    assert [(r["a_id"], r["b_id"], r["sim"]) for r in left.collect()] == [("acme", "p0", 0.95)]
    assert [(r["winner"], r["loser"]) for r in R.winners(pairs.limit(3).where("b_id = 'p1'"), e).collect()] == [("p1", "p0")]


def test_resolution_tiers(spark):
    e = spark.createDataFrame([("c1", "company", "Acme Incorporated", 1, T0, None, {}), ("c2", "company", "Globex", 1, T0, None, {})], ENTITY)
    w = spark.createDataFrame([("w1", "company", "acme  incorporated", {}), ("w2", "company", "Acme Incorporate", {}), ("w3", "company", "Zzz", {})], "wanted_id string, kind string, label string, natural_keys map<string,string>")
    got = {r["wanted_id"]: (r["tier"], r["id"], r["decision"]) for r in R.resolve(w, e).collect()}
    assert got["w1"] == ("exact", "c1", "merge") and got["w2"] == ("adjudicated", "c1", "propose") and got["w3"] == ("none", None, "new")


def test_reconcile_extraction(spark):
    v = O.Registry()
    v.add(O.Kind("person", fields=(O.Field("born", "date"), O.Field("email", many=True))))
    ents = spark.createDataFrame([("x", "s", "person", "Ann"), ("x", "o", "person", " ")], "extraction_id string, local_id string, kind string, label string")
    row = lambda n, p, t, c, obj=None: ("x", n, "s", p, "entity" if obj else "text", t, None, None, obj, c, "snip")
    facts = spark.createDataFrame([row(1, "born", "2001", 0.5), row(2, "born", "2002", 0.9), row(3, "email", "a@b", 0.5), row(4, "email", "A@B ", 0.7), row(5, "tag", "x", 0.5), row(6, "tag", "y", 0.5), row(7, "knows", None, 0.5, "o"), row(8, "note", "  ", 0.5)], "extraction_id string, ord int, subject_local_id string, predicate string, value_kind string, text string, num double, date string, entity_local_id string, confidence double, snippet string")
    got = {(r["predicate"], r["value"], r["cardinality"], r["confidence"]) for r in R.reconcile_extraction(ents, facts, v.vocabulary(spark)).collect()}
    assert got == {("born", "2002", "one", 0.9), ("email", "a@b", "many", 0.7), ("tag", "x", "many", 0.5), ("tag", "y", "many", 0.5)}


def test_grounding_caps(spark):
    f = spark.createDataFrame([("x", "paid 1,250 euros", 1250.0, 0.9), ("x", "never said", None, 0.9), ("x", None, 777.0, 0.9)], "extraction_id string, snippet string, num double, confidence double")
    s = spark.createDataFrame([("x", "They Paid  1,250 euros today")], "extraction_id string, text string")
    assert sorted(r["confidence"] for r in R.ground(f, s).collect()) == [0.35, 0.35, 0.9]


def test_learned_terms_clamp_at_each_step(spark):
    rows = [(1, i, "accept", ["a"]) for i in range(6)] + [(1, 9, "reject", ["a", "b"])]
    got = {r["term"]: r["weight"] for r in R.learn_terms(spark.createDataFrame(rows, "agent_id int, ord int, verdict string, terms array<string>")).collect()}
    assert got == {"a": 0.75, "b": -0.25}


def test_registry_and_columns():
    r = O.Registry()
    k = r.add(O.Kind("task", fields=(O.Field("due", "date", required=True),), relations=(O.Relation("for", "person"),)))
    assert r.add(O.Kind("task")).kind == "task_2"
    cols = O.columns_of(k)
    new, came, went = O.synced(k, [c for c in cols if c.key != "due"] + [T.ColumnDef("size", "Size", "number")])
    assert (came, went) == ({"size"}, {"due"}) and [f.key for f in new.fields] == ["size"]


def test_import_reads_a_table_as_a_graph(spark):
    rows = spark.createDataFrame([("Deal 1", "Acme", 10.0, "d@x.org"), ("Deal 2", "acme ", None, ""), (" ", "Zed", 1.0, "z")], "title string, client string, value double, email string")
    cols = [T.ColumnDef("title", "Title"), T.ColumnDef("client", "Client"), T.ColumnDef("value", "Value", "number"), T.ColumnDef("email", "Email")]
    s = I.infer_schema("deals", cols, rows)
    assert (s.kind, s.subject, s.references, s.keys) == ("project", "title", {"client": "person"}, {"email": "email"})
    ents, facts = I.graph_of_table(rows, s)
    assert sorted((r["kind"], r["label"].lower()) for r in ents.collect()) == [("person", "acme"), ("project", "deal 1"), ("project", "deal 2")]
    assert facts.where("predicate = 'client'").select("object_id").distinct().count() == 1
    known = spark.createDataFrame([("person", "ACME")], "kind string, label string")
    assert [tuple(r)[2:] for r in I.preview(rows.where("client <> 'Zed'"), s, known).collect()] == [(1, 0)]


def test_notes(spark):
    text = "---\ntitle: Plan\ntags: [a, b]\nstatus: open\naliases:\n  - P\n---\nSee [[Ann|her]] #c and [[Ann]]"
    n = I.parse_note("work/plan.md", text)
    assert (n["title"], n["folder"], n["tags"], n["aliases"], n["links"], n["props"]) == ("Plan", "work", ["a", "b", "c"], ["P"], ["Ann"], {"status": "open"})
    df = I.notes(spark.createDataFrame([("work/plan.md", text), ("x.md", "no front matter"), (None, None)], "path string, value string"))
    assert I.vault_stats(df).first()["notes"] == 3


def test_lens_tree_stops_at_single_documents(spark):
    docs = spark.createDataFrame([(1, "document", "application/pdf", "mail", None, []), (2, "document", None, "mail", None, []), (3, "note", None, "chat", None, [])], "id int, kind string, media string, channel string, received_at date, links array<struct<kind:string,label:string>>")
    assert {(r["id"], r["path"]) for r in L.tree(docs, ["channel", "type"]).collect()} == {(1, "mail/pdfs"), (2, "mail/other files"), (3, "chat")}


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path))
    t.write(spark.range(3).toDF("a"), "ann", "first")
    t.write(spark.range(5).toDF("a"), "bob")
    assert t.read().count() == 5 and t.read(1).count() == 3
    assert t.restore(1, "ann") == 3 and t.read().count() == 3 and t.log().count() == 3
    with pytest.raises(ValueError):
        t.read(9)


def test_capture(spark):
    rows = [("mail", "1", None, ["A@x.org"], None, "s", "t", "<p>Hi <b>you</b></p>"), ("mail", "1", None, ["a@x.org"], None, "s", "t", ""), ("chat", None, None, [], "h1", "s", "t", ""), ("chat", None, None, [], "no", "s", "t", "")]
    env = spark.createDataFrame([(*r[:7], None, r[7], None, []) for r in rows], capture.ENVELOPE)
    ok, lost = capture.routed(env, spark.createDataFrame([("a@X.org", "o1")], "address string, org string"), spark.createDataFrame([("chat", "h1", "o2")], "channel string, handle string, org string"))
    assert lost.count() == 1 and sorted(r["org"] for r in ok.collect()) == ["o1", "o1", "o2"]
    new = capture.new_only(ok, spark.createDataFrame([], "org string, channel string, external_id string"))
    assert new.count() == 2
    stored = capture.items(ok).select("org", "channel", "external_id")
    assert capture.new_only(ok, stored.where("external_id is not null")).count() == 1


def test_cursor_stops_before_rejected(spark):
    m = spark.createDataFrame([("c", 1, False), ("c", 2, False), ("c", 3, True), ("c", 4, False), ("new", 9, False)], "connector string, uid int, rejected boolean")
    cur = spark.createDataFrame([("c", 1)], "connector string, uid int")
    assert [(r["connector"], r["uid"]) for r in capture.pulled(m, cur).collect()] == [("c", 2)]


def test_workbook_round_trip(spark):
    df = spark.createDataFrame([("x & y", 1.5, None), ("z", 2.0, "t")], "a string, b double, c string")
    content = sheets.workbook({"First": df, "first": df})
    columns, back = sheets.read_workbook(spark, content)
    assert [(c.key, c.type) for c in columns] == [("a", "text"), ("b", "number"), ("c", "text")]
    assert [tuple(r) for r in back.collect()] == [("x & y", 1.5, None), ("z", 2.0, "t")]
    assert sheets.sheet_names(["a" * 40, "a" * 40, "b/c"]) == ["a" * 31, "a" * 29 + " 2", "b c"]
    assert sheets.archive({"f": b"1"}) == sheets.archive({"f": b"1"})
    assert zipfile.ZipFile(io.BytesIO(content)).testzip() is None


def test_outbound_plan(spark):
    cols = [T.ColumnDef("name", "N"), T.ColumnDef("amount", "A", "number"), T.ColumnDef("day", "D", "date")]
    p = outbound.plan("2024 Sales!", cols)
    assert p.create.startswith('CREATE TABLE IF NOT EXISTS "t2024_sales"') and len(p.add_columns) == 3 and 'ON CONFLICT (dm_id) DO UPDATE SET "name" = excluded."name"' in p.upsert
    rows = spark.createDataFrame([("1", {"name": "", "amount": "$1,200.50", "day": "2024-02-03T00:00"}), ("2", {"amount": "n/a"})], "id string, data map<string,string>")
    assert [tuple(map(str, r)) for r in outbound.params(rows, cols).collect()] == [("1", "None", "1200.5", "2024-02-03"), ("2", "None", "None", "None")]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_agents_fold_in_order_without_holding_their_rows(spark):
    import random

    rng = random.Random(4)
    rows = [(a, i, rng.choice([None, 1, 2, 3]), [rng.random() for _ in range(rng.choice([3, 3, 3, 2]))]) for a in ("x", "y", None) for i in range(40)] + [("z", 1, 1, None)]
    got = R.fold_centroids(spark.createDataFrame(rows, "agent_id string, id long, created_at int, embedding array<double>"), memory=5)
    assert "FlatMapGroups" not in plan_of(got)
    want = {"z": (0, None)}
    for a in ("x", "y", None):
        mean, n = None, 0
        for r in sorted((r for r in rows if r[0] == a), key=lambda r: (r[2] is None, r[2] or 0, r[1])):
            if mean is None or len(r[3]) == len(mean):
                k = min(n, 5)
                mean, n = ([(m * k + v) / (k + 1) for m, v in zip(mean, r[3], strict=True)] if mean else r[3]), n + 1
        want[a] = (n, pytest.approx(mean))
    assert {r["agent_id"]: (r["n"], r["centroid"]) for r in got.collect()} == want


def test_terms_fold_in_order_without_lists_of_steps(spark):
    import random

    rng = random.Random(5)
    rows = [(i % 2, rng.randrange(1000), rng.choice(["accept", "reject"]), rng.sample("abcd", 2)) for i in range(120)]
    got = R.learn_terms(spark.createDataFrame(rows, "agent_id int, ord int, verdict string, terms array<string>"))
    assert "collect_list" not in plan_of(got)
    want = {}
    for a, _, s, terms in sorted((a, o, 0.25 if v == "accept" else -0.25, t) for a, o, v, t in rows):
        for t in terms:
            want[a, t] = max(-1.0, min(1.0, want.get((a, t), 0.0) + s))
    assert {(r["agent_id"], r["term"]): r["weight"] for r in got.collect()} == {k: w for k, w in want.items() if abs(w) >= 0.05}
