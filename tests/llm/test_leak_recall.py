"""Recall of leaked items against all pairs, verbatim and paraphrased."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate as D


@pytest.mark.parametrize("replaced", [0.0, 0.3])
def test_recall_against_all_pairs(spark, replaced):
    """Items of rare words planted in texts, verbatim and with words replaced: 0.9 of what comparing all pairs finds."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else f"r{i}q{k}" for k in range(45)) + ".") for i in range(120)]
    rows = []
    for i, text in items:
        words = [rng.choice(common) if rng.random() < replaced else w for w in text.split()]
        rows.append((i, " ".join(rng.choices(common, k=rng.randrange(90))) + " " + " ".join(words) + " " + " ".join(rng.choices(common, k=90))))
    rows += [(500 + i, " ".join(rng.choices(common, k=300))) for i in range(200)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    o = D.Leaks()
    got = {r["doc_id"] for r in D.leaks(docs, bench, o).where(F.col("contaminated")).collect()}
    words, answers = D.hashed([t for _, t in items]), D.hashed([D.answer_of(t) for _, t in items])
    texts = D.hashed([t for _, t in rows])
    want = {doc for (doc, _), text in zip(rows, texts) if any(D.verdict(w, a, text[x : x + 130], o) > 0 for w, a in zip(words, answers) for x in range(0, len(text), o.stride))}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= (20 if replaced else 120)
