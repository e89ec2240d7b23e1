"""Packing: ids as the library gives them, pieces whole, sequences gapless and few."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from factloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = ["", " ", "It's  THE\tend\n", "don't 've 'S ''s!!'s", "naïve ÀÉÎ Œuvre İstanbul ŉ", "Σίσυφος ΟΔΟΣ", "中文 字", "🙂!?", "<|endoftext|> a<|startoftext|>", "<| x", "x\x1cy\x85z\xa0w", "é Ω", "½ ² 12 345", "a\x0bb\x0cc", "“quoted” – it’s…", "x" * 3000, "straße ẞ ﬁ"]


def test_ids_are_the_librarys(library):
    rng, encode = random.Random(1), packing.encoder(PATH)
    chars = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(160, 383), 0x2019, 0x201C, 0x20AC]]
    texts = ODD + ["".join(rng.choices(chars, k=rng.randrange(60))) for _ in range(3000)] + ["".join(rng.choices("abcdeST '’!1\n", k=40)) for _ in range(2000)]
    for text in texts:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def check(rows, docs, library, p):
    """Whole documents in gapless sequences; gives the number of sequences and the least that could do."""
    want = Counter()
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, p.end]
        for k, start in enumerate(range(0, len(ids), p.size)):
            part = np.array(ids[start : start + p.size], "<u4")
            want[doc_id, k, start, len(part), crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= p.size
    return len(held), -(-sum(r["length"] for r in rows) // p.size)


def test_pieces_and_sequences(spark, library):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["one", "two", "unusualness", "3", "é!"], k=int(rng.paretovariate(0.7)) % 400))) for i in range(600)]
    docs += [(7, "the same"), (7, "the same"), (None, "no id"), (None, None), (5000, None)] + [(9000 + i, "copies of one text") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    p = packing.Packing(size=64)
    rows = packing.pack(frame, PATH, p).collect()
    used, least = check(rows, docs, library, p)
    assert used <= least + 1
    placed = packing.pack(frame, PATH, p, with_ids=True)
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    assert sum(map(len, got.values())) == sum(r["length"] for r in rows) and max(map(len, got.values())) <= 64
    assert sum(x == p.end for ids in got.values() for x in ids) >= len(docs)


def test_odd_frames(spark, library):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    frame = spark.createDataFrame([("a", "b c", 1, 2, 3)], "key string, rank string, task int, length int, id int")
    (row,) = packing.pack(frame, PATH, id_col="key", text_col="rank").collect()
    assert (row["key"], row["piece"], row["length"], row["offset"]) == ("a", 0, 3, 0)


def most_sequences(counts, size):
    """Best fit decreasing, piece by piece."""
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(size - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_uses_all_and_packs_as_best_fit_or_better(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 50, 128])
    counts = {n: rng.randrange(1, 9) for n in rng.sample(range(1, size + 1), rng.randrange(1, size))}
    plan, used = packing.packing_plan(counts, size), Counter()
    for times, pattern in plan:
        assert times > 0 and sum(n * k for n, k in pattern) <= size
        for n, k in pattern:
            used[n] += times * k
    assert used == counts
    total = sum(times for times, _ in plan)
    assert total <= most_sequences(counts, size) + 1


def test_complements_are_exact():
    plan = packing.packing_plan({60: 2, 40: 1, 25: 1, 15: 1}, 100)
    assert sorted(plan) == [(1, ((60, 1), (25, 1), (15, 1))), (1, ((60, 1), (40, 1)))]
    assert packing.packing_plan({70: 10**12, 10: 3 * 10**12}, 100) == [(10**12, ((70, 1), (10, 3)))]
    assert packing.packing_plan({}, 100) == []


def test_plans_of_many_lengths_are_made_quickly():
    rng = random.Random(4)
    counts = {n: rng.randrange(1, 10**9) for n in range(1, 2049)}
    plan = packing.packing_plan(counts, 2048)
    assert sum(t for t, _ in plan) <= -(-sum(n * c for n, c in counts.items()) // 2048) * 1.02
    assert len(plan) < 20_000
