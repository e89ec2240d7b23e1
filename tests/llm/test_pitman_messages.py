"""What shards of the Pitman-Yor model send each other: as much as there is to say, in few messages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from factloom.llm import _text, pitman_yor
from factloom.llm._text import U64
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(40)]


def test_chunks_that_ask_a_shard_share_their_messages():
    """40 chunks passed on 40 messages to each shard of words before; each chunk still gets all its answers."""
    layout, m, rng = pitman_yor.Layout(np.zeros(0, U64), np.zeros(0, U64), 3), pitman_yor.Model(), random.Random(3)
    totals = [pitman_yor.Totals((10, 5), np.zeros((0, 2)), np.zeros((0, 2)), 7)] * 2
    asked, sent, tokens = pitman_yor.Asked(None, {}, {}, layout, totals, m), [], {}
    for chunk in range(40):
        texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(20))) for _ in range(5)]
        _, _, words, at = next(_text.word_chunks(pa.array(texts), True, 1 << 20))
        parts = list(pitman_yor.parts_of(words, at, layout))
        tokens[chunk] = np.diff(at) + 1
        for k, p in enumerate(parts):
            blob = p.packed(np.diff(p.starts, append=len(p.texts)), p.texts, np.ones(len(p.texts), int))
            sent += asked.rows(blob, chunk, lambda c: c * 0.0, more=chunk < 39 or k + 1 < len(parts))
    assert all(r[1] == "defer" for r in sent) and sorted(r[0] for r in sent) == [0, 1, 2]
    words = pitman_yor.AskedWords(None, {}, {}, totals, m)
    answers = words.rows([r[3] for r in sent], lambda c: c - 1.0)
    assert sorted(r[2] for r in answers) == list(range(40))
    unknown = np.log10(totals[0].word_probability(np.zeros(1), np.zeros(1), m)[0])
    for _, kind, chunk, blob in answers:
        texts, known, base, score = pitman_yor.answered(blob)
        assert kind == "answer" and texts.tolist() == list(range(5)) and not known.any()
        assert base == pytest.approx(-tokens[chunk]) and score == pytest.approx(tokens[chunk] * unknown, rel=1e-5)


def test_cells_counted_from_asks_are_those_of_training_texts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["hot"] * 4 + WORDS) for _ in range(rng.randrange(12)))) for i in range(120)] + [(200, None), (None, "null id")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    held_out = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    layout, _ = pitman_yor._layout(docs.where(~held_out), pitman_yor.Model(hot_share=8, words_per_shard=40), "text")
    asks, name = pitman_yor._asked(docs.select(F.col("doc_id").alias("id"), "text", held_out.alias("held_out")), layout)

    def cells(table):
        out = []
        for r in table.collect():
            words, x, v, w, n = pitman_yor.named(pitman_yor.unpack(r["blob"]))
            assert set(range(len(words))) == {*x.tolist(), *v.tolist(), *w.tolist()}
            out += [(r["key"], *cell) for cell in zip(words[x].tolist(), words[v].tolist(), words[w].tolist(), n.tolist(), strict=True)]
        return sorted(out)

    got = cells(pitman_yor._counted_from(asks, layout))
    assert got and got == cells(pitman_yor._counted(docs.where(~held_out), layout, "text"))
    assert asks.where("kind = 'doc'").count() == len(rows)
    spark.sql(f"DROP TABLE {name}")


def test_hashes_by_place_in_the_block_are_those_by_place_in_the_word(monkeypatch):
    rng = random.Random(1)
    for _ in range(40):
        texts = [bytes(rng.choice(b" \n\tABCabcxyz\x80\xff09") for _ in range(rng.choice([0, 1, 3, 40, 500]))) for _ in range(rng.randrange(1, 9))]
        raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts])
        for lower in (False, True):
            both = []
            for most in (1 << 19, -1):
                monkeypatch.setattr(_text, "_SHORT", most)
                both.append(_text.hash_words(raw, at, lower))
                monkeypatch.undo()
            assert all((a == b).all() for a, b in zip(*both, strict=True))
