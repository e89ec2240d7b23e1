"""Fill-in-middle against a version by string slices."""

import random
import re
from hashlib import sha256

from factloom.llm import fill_in_middle as fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text, c=fim.Fim()):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = sha256(f"{c.seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in c.marks) or h3 % 100 >= c.rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < c.spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    alphabet = ["word", "a", "Zz", " ", "\n", "1", "é", "中", "🙂", ".", "<", ">", "<P", "S>", "<M>"]
    random_ones = ["".join(rng.choices(alphabet[: rng.choice([12, 14, 15])], k=rng.choice([0, 1, 2, 63, 64, 65, 128, 500]))) for _ in range(250)]
    return [None, "", "x", "<P>", "a" * 100_000, "é" * 5_000, ("word " * 30_000), "🙂", "\r\n", *random_ones]


def test_against_slices(spark):
    rows = list(enumerate(texts())) + [(None, "null id"), (None, None), (7, "again and again"), (7, "again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in (fim.Fim(), fim.Fim(run_units=3)):
        got = [tuple(r) for r in fim.fill_in_middle(docs, c).collect()]
        assert sorted(map(repr, got)) == sorted(repr(brute(i, t, c)) for i, t in rows)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}
    sha = lambda x: sha256((x or "").encode()).hexdigest()
    digests = fim.digests(docs).collect()
    assert sorted((r["output_sha256"], r["restored_sha256"]) for r in digests) == sorted((sha(brute(i, t)[5]), sha(t)) for i, t in rows)


def test_odd_frames(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [("one", "two three four", 1, 2, 3, "x")] * 3
    docs = spark.createDataFrame(rows, "row string, runs string, n int, low int, form int, id string")
    got = fim.fill_in_middle(docs, fim.Fim(rate=100), "row", "runs").collect()
    assert [tuple(r) for r in got] == [brute("one", "two three four", fim.Fim(rate=100))] * 3


def test_texts_are_dealt_once(spark):
    """One exchange of the texts serves all three branches."""
    docs = spark.range(10).selectExpr("id AS doc_id", "repeat('ab c', 50) AS text")
    out = fim.digests(docs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("monotonically_increasing_id()") == 1
