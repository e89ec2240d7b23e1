"""Text, number and map functions on small cases."""

from pyspark.sql import functions as F

from factloom.functions import maps, numbers
from factloom.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def each(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r["x"] for r in df.select("i", f("c").alias("x")).orderBy("i").collect()]


def test_slugs(spark):
    assert each(spark, X.slug_key, ["  Total Amount! ", "été", "__a__"]) == ["total_amount", "t", "a"]
    assert each(spark, X.slugify, ["Été à Paris", None]) == ["ete_a_paris", None]


def test_terms(spark):
    assert each(spark, X.tokenize, ["How much did I invoice Acme, Acme?"]) == [["invoice", "acme"]]
    assert each(spark, X.normalize_terms, ["Track all the boxes and invoices of glass"]) == [["box", "invoice", "glass"]]
    assert each(spark, X.key_terms, ["The 12% total, TOTAL price$"]) == [["total", "price$"]]


def test_singular(spark):
    assert each(spark, X.singularize, ["People", "parties", "boxes", "glass", "notes"]) == ["person", "party", "box", "glass", "note"]
    assert each(spark, X.fold_concept_key, ["Growth Strategies", "data analysis", "glass", "campus"]) == ["growth strategy", "data analysis", "glass", "campus"]


def test_kind_from(spark):
    assert each(spark, X.kind_from, ["Customers", "Vendors", "Invoices", "Line items", "recipes", ""]) == ["person", "company", "invoice", "product", "recipe", "record"]


def test_gate(spark):
    cases = ["ok", "thanks!", "", "👍", "see you at 5", "merci, c'est parfait", "the contract was signed", "x" * 81]
    assert each(spark, X.worth_extracting, cases) == [False, False, False, False, True, False, True, True]


def test_normalisers(spark):
    assert each(spark, X.normalize_phone, ["+1 (555) 010-2030", "555-0102 ext. 12", "12"]) == ["+15550102030", "555-0102 ext. 12", "12"]
    assert each(spark, X.normalize_url, ["HTTPS://Ex.COM/a/?utm_source=x&id=2", "https://ex.com/?gclid=1", "no url"]) == ["https://ex.com/a?id=2", "https://ex.com", "no url"]
    assert each(spark, X.normalize_unit, ["$", "euros", "usd", "pct", "kilos"]) == ["USD", "EUR", "USD", "%", "kilos"]
    assert [tuple(r) for r in each(spark, X.parse_sender, ['"Ann Lee" <Ann@X.org>', "bob@y.org"])] == [("Ann Lee", "ann@x.org"), (None, "bob@y.org")]


def test_numbers(spark):
    assert each(spark, numbers.number_from_text, ["12,000 USD", "about -3.5", "none"]) == [12000.0, -3.5, None]
    assert each(spark, numbers.whole_number, ["1,234.5", "$20", "20 apples", "1,23"]) == [1234.5, 20.0, None, None]
    assert one(spark, numbers.round2("v"), v=-2.505) == -2.5
    assert one(spark, numbers.round2("v"), v=1.005) in (1.0, 1.01)
    assert each(spark, numbers.loose_date, ["2026-1-2", "January 5, 2024", "3rd March 2021", "next week", "5 May"]) == ["2026-01-02", "2024-01-05", "2021-03-03", None, None]


def test_cosine_degenerate(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(numbers.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "x map<string,string>, y map<string,string>")
    r = df.select(maps.merged("x", "y").alias("m"), maps.canonical_json("x").alias("j"), maps.keys_conflict("x", "y").alias("c"), maps.with_key("y", "z", "9").alias("w"), maps.without_key("x", "a").alias("o")).first()
    assert r["m"] == {"a": "1", "b": "3"} and r["j"] == '{"a":"1","b":"2"}' and r["c"] is True and r["w"] == {"b": "3", "z": "9"} and r["o"] == {"b": "2"}


def test_citations_and_links(spark):
    df = spark.createDataFrame([("so [2] and [1], [2], [9]", [1, 2])], "t string, k array<int>")
    assert df.select(X.cited_sources("t", "k")).first()[0] == [2, 1]
    assert each(spark, X.wikilinks, ["[[A]] and [[B|b]] [[A]]"]) == [["A", "B"]]
    assert each(spark, X.safe_link, ["javascript:x", "https://a.b", "/local", "mailto:a@b"]) == [None, "https://a.b", "/local", "mailto:a@b"]


def test_look_alike(spark):
    df = spark.createDataFrame([("invoice_amount", "amount"), ("due_date", "order_date"), ("a_b_c", "d_e")], "a string, b string")
    assert [r[0] for r in df.select(X.predicates_look_alike("a", "b")).collect()] == [True, False, False]


def test_trigrams(spark):
    df = spark.createDataFrame([("word", "words")], "a string, b string").select(X.similarity(X.trigrams("a"), X.trigrams("b")).alias("s"), F.size(X.trigrams("a")).alias("n"))
    assert tuple(df.first()) == (4 / 7, 5)
