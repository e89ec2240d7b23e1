"""Source divergence against a version by dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from factloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, a):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        of_lang = [d for d in docs if d[0] == lang]
        df = Counter(t for d in of_lang for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= a.min_docs), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, terms in of_lang:
            counts[source].update(terms)
        whole = Counter(t for d in of_lang for t in d[2])

        def p(c):
            over = sum(c[t] for t in kept) + a.smooth * len(kept)
            return {t: 1 + 1000**a.scale_thousands * (c[t] + a.smooth) // over for t in kept}

        q, shares = p(whole), {s: p(c) for s, c in counts.items()}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in counts:
            pairs = sorted((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((-f(shares[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and shares[s][t] > q[t])[: a.top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(ranked, 1)}
    return out


def check(spark, docs, a, monkeypatch=None):
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    got = [tuple(r) for r in divergence.source_divergence(frame, a).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, a)
    return got


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [*"aa bb Cc éa zz ÀB straße 中文 nn oo pp".split(), "x" * 400]
    docs = [(rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "é", "", None]), " ".join(rng.choices(words, range(1, 13), k=rng.randrange(40)))) for _ in range(300)]
    docs += [("en", "bare", None), ("en", "bare", ""), ("fr", "digits", "1 2 3"), ("xx", "only", "aa"), ("yy", "one", "aa"), ("yy", "two", "bb")]
    check(spark, docs, divergence.Audit(min_docs=4, top=3))
    # small blocks and chunks, so that terms meet again across them
    check(spark, docs, divergence.Audit(min_docs=4, top=3, block_terms=10, cells=12))


def test_ties_repeats_and_odd_frames(spark):
    docs = [("en", s, t) for s in ("a", "b") for t in ("one two", "one two", "three")] + [("en", "c", "two one three")] * 3
    check(spark, docs, divergence.Audit(min_docs=2))
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(empty).collect() == []
    clash = spark.createDataFrame([(t, l, s, 1, "p", 2) for l, s, t in docs], "term string, n string, df string, rank int, part string, item int")
    got = divergence.source_divergence(clash, divergence.Audit(min_docs=2), "n", "df", "term")
    assert {tuple(r) for r in got.collect()} == brute(docs, divergence.Audit(min_docs=2))


def test_long_texts_and_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 7)
    text = ("Ab1cd" * 50 + "é" * 30 + " x").encode()
    assert [t for terms in divergence.terms_of(text) for t in terms] == [t.lower().encode() for t in TERM.findall(text.decode())]


def test_shares_do_not_overflow():
    counts = np.array([0, 5_000_000_000_000, 7], np.int64)
    n, v = int(counts.sum()), 3
    assert divergence.shares(counts, n, v).tolist() == [1 + 10**9 * (int(c) + 2) // (n + 2 * v) for c in counts]
