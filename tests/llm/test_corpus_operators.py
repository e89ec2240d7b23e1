"""Operators over a whole corpus, against brute force on small fixtures."""

import random
from collections import Counter
from math import log10
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import _text, components, decontaminate, line_dedup, minhash, pitman_yor

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i) if sets[i] else ("empty", d), []).append(d)
    return {d: min((x for x in groups[find(i) if sets[i] else ("empty", d)] if x is not None), default=None) for i, (d, _) in enumerate(rows)}


def corpus():
    """Copies, a chain in which only neighbours are alike, near copies around a base, short and empty texts."""
    rng = random.Random(5)
    rows = [(i, prose(rng, 60)) for i in range(10)]
    rows += [(100 + i, rows[3][1].upper()) for i in range(8)]
    words = prose(rng, 90).split()
    for i in range(25):
        words[(i * 3) % 90] = f"edit{i}"
        rows.append((200 + i, " ".join(words)))
    base = prose(rng, 120).split()
    for i in range(30):
        near = list(base)
        near[rng.randrange(120)] = f"near{i}"
        rows.append((300 + i, " ".join(near)))
    return rows + [(400, "two words"), (401, "Two  WORDS"), (402, ""), (403, None), (404, ""), (405, " \n")]


@pytest.mark.parametrize(("percent", "bucket_rows"), [(80, 2048), (85, 2048), (80, 3)])
def test_near_duplicates_as_brute_force(spark, percent, bucket_rows):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), minhash.NearDup(percent=percent, bucket_rows=bucket_rows)).collect()
    want = brute_components(rows, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(shingles(t)) for d, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = [(*r, "x", True) for r in corpus()] + [(3, corpus()[3][1], "again", False), (None, corpus()[3][1], "n", None)]
    docs = spark.createDataFrame(rows, DOCS + ", digest string, kept boolean")
    out = minhash.without_near_duplicates(docs)
    got = [r["doc_id"] for r in out.collect()]
    want = brute_components([(d, t) for d, t, *_ in rows if d is not None], 80)
    assert out.columns == docs.columns and sorted(got) == sorted({c for d, c in want.items()})
    empty = spark.createDataFrame([], DOCS)
    assert minhash.without_near_duplicates(empty).count() == 0 and minhash.near_duplicates(empty).count() == 0


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(1000 * share)
        a, b = x[:1000], np.concatenate([x[:n], x[1000 : 2000 - n]])
        s = minhash.signatures([np.unique(a), np.unique(b)], 512)
        assert (s[0] == s[1]).mean() == pytest.approx(n / (2000 - n), abs=0.09)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}}


def test_line_windows_as_sql(spark):
    rng = random.Random(3)
    shared = ["alpha beta", "gamma", "", "delta"]
    rows = [(i, "\n".join([prose(rng, 3), *(shared if i % 2 else shared[:3]), prose(rng, 2)])) for i in range(8)]
    rows += [(20, "\n\n\n\n"), (21, "a\nb\nc\na\nb\nc\na"), (22, None), (23, ""), (24, "a\nb"), (25, "x\n" * 30), (25, "x\n" * 30), (7, "other text\nof the same\nid")]
    got = line_dedup.line_dedup_digests(spark.createDataFrame(rows, DOCS)).collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    r = c.sql(line_dedup.ORACLE_SQL)
    want = [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]
    key = lambda x: (x["doc_id"], x["n_lines"], x["n_removed"], x["kept_md5"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert line_dedup.line_dedup_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_line_windows_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "k", 1), (2, "z\na\nb\nc\ny", "k", 2), (None, "a\nb\nc", "k", 3)], DOCS + ", at string, key int")
    out = {r["key"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {1: "", 2: "z\ny", 3: "a\nb\nc"}


def test_leaks_are_found_and_others_left(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 25) + f". The answer number {i} is {prose(rng, 6)}.") for i in range(12)]
    clean = [(i, prose(rng, rng.randrange(5, 400))) for i in range(40)]
    dirty = [(100 + i, f"{prose(rng, 150)} {t} {prose(rng, 200)}") for i, t in items]
    para = items[0][1].split()
    for k in range(2, 22, 6):
        para[k] = "changed"
    rows = [*clean, *dirty, (200, prose(rng, 40) + " " + " ".join(para)), (201, None), (202, ""), (100, dirty[0][1])]
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS)
    for options in (decontaminate.Leaks(), decontaminate.Leaks(block_items=5)):
        got = decontaminate.leaks(docs, bench, options).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"] for r in got if r["contaminated"]} == {d for d, _ in dirty} | {200}
        assert {r["doc_id"]: r["item_id"] for r in got if 100 <= r["doc_id"] < 200} == {100 + i: i for i, _ in items}
    kept = decontaminate.clean(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", __n int"), bench)
    assert kept.columns == ["doc_id", "text", "__n"] and {r["doc_id"] for r in kept.collect()} == {d for d, _ in clean} | {201, 202}
    assert decontaminate.leaks(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0
    assert decontaminate.leaks(spark.createDataFrame([], DOCS), bench).count() == 0


def test_recall_of_paraphrases_against_all_pairs(spark):
    """Every window of every text against every item, without the latent space; the latent space has fewer ranks than items."""
    rng = random.Random(21)
    items = [(i, prose(rng, rng.randrange(18, 45)) + f". So the answer is {prose(rng, 7)}.") for i in range(60)]
    rows = [(i, prose(rng, rng.randrange(5, 300))) for i in range(100)]
    for i, t in items * 3:
        words = t.split()
        for k in rng.sample(range(len(words)), int(len(words) * rng.choice([0.1, 0.2, 0.3, 0.38]))):
            words[k] = rng.choice(WORDS)
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), prose(rng, 3))
        rows.append((1000 + len(rows), f"{prose(rng, rng.randrange(120))} {' '.join(words)} {prose(rng, rng.randrange(120))}"))
    o = decontaminate.Leaks(rank=24, sketch_rows=48)
    got = {r["doc_id"]: (r["contaminated"], r["n_items"]) for r in decontaminate.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), o).collect()}
    words, answers = decontaminate.hashed([t for _, t in items]), decontaminate.hashed([decontaminate.answer_of(t) for _, t in items])
    want, met = 0, 0
    for d, t in rows:
        text, n = decontaminate.hashed([t])[0], 0
        for w, a in zip(words, answers, strict=True):
            wide = max(0, len(w) - o.stride)
            n += any(decontaminate.verdict(w, a, text[max(0, x - wide) : x + o.window + wide], o) > 0 for x in range(0, len(text), o.stride))
        assert got[d][1] <= n and got[d][0] == (got[d][1] > 0)
        want, met = want + n, met + got[d][1]
    assert want > 100 and met >= 0.9 * want


def test_sketch_counts_every_passage(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 300))) for i in range(30)] + [(99, None)]
    o = decontaminate.Leaks(sketch_rows=400, feature_bits=8)
    c = decontaminate.corpus(spark.createDataFrame(rows, DOCS).repartition(3), o, "text")
    passages = [w[k : k + o.window] for w in decontaminate.hashed([t or "" for _, t in rows]) for k in range(0, len(w), o.window)]
    df = np.zeros(256)
    for w in passages:
        df[np.unique(decontaminate.features_of(w, o))] += 1
    assert c.idf == pytest.approx(decontaminate.inverse_frequency(len(passages), df))
    assert np.linalg.norm(c.sketch) == pytest.approx(len(passages) ** 0.5, rel=0.2)  # rows of unit length, few of which share a row of the sketch


def test_common_subsequence():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in "ab")
        assert decontaminate.common_in_order(np.array(a), np.array(b)) == brute(a, b)


def test_stirling_numbers_count_seatings():
    d = 0.5
    s = np.exp(pitman_yor.stirling_logs(d, 4))
    assert s[2, 1] == pytest.approx(1 - d) and s[3, 2] == pytest.approx(3 * (1 - d)) and s[4, 4] == pytest.approx(1)


def test_exact_draws_follow_the_conditional():
    """Two customers: P(two tables) against one, from the seating probabilities themselves."""
    m, rng, n = pitman_yor.stirling_logs(0.6, 8), np.random.default_rng(2), 40_000
    base, others = 0.02, 10
    t = pitman_yor.draw_tables(np.full(n, 2), np.full(n, base), np.full(n, others), 0.6, 1.5, m, rng)
    two, one = (1.5 + 0.6 * (others + 1)) * base, 1 - 0.6
    assert (t == 2).mean() == pytest.approx(two / (one + two), abs=0.01)


def test_model_is_a_distribution_and_beats_the_base(spark):
    rng = random.Random(8)
    follow = {w: [rng.choice(WORDS[:60]) for _ in range(3)] for w in WORDS[:60]}
    rows = []
    for i in range(300):
        w, out = rng.choice(WORDS[:60]), []
        for _ in range(60):
            out.append(w)
            w = rng.choice(follow[w])
        rows.append((i, " ".join(out).replace("w1 ", "W1 ")))
    rows += [(1000, None), (1001, ""), (1002, "never met words"), (5, rows[5][1])]
    got = {}
    for r in pitman_yor.score(spark.createDataFrame(rows, DOCS), pitman_yor.Model(words_per_shard=2000)).collect():
        got[r["doc_id"]] = r
    train = [(d, t) for d, t in rows if crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for _, t in train for w in [*(t or "").encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    for d, t in rows:
        words, r = [*(t or "").encode().lower().split(), None], got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(w in counts for w in words), total, crc32(str(d).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words))
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 20 * len(held)
    trained = pitman_yor.train(spark.createDataFrame(train, DOCS), pitman_yor.Model(words_per_shard=2000))
    assert len(trained.trace) == 2 and all(x > sum(got[d]["base_score"] for d, _ in train) for x in trained.trace)
    assert pitman_yor.score(spark.createDataFrame([], DOCS)).count() == 0


def brute_cells(rows):
    """Customers of every cell (x, v, w) by plain loops; None is the start mark, '' the end."""
    out = Counter()
    for _, t in rows:
        words = [None, None, *(t or "").split(), ""]
        out.update(zip(words, words[1:], words[2:]))
    return out


def hash_name(w):
    return int(pitman_yor.START) if w is None else int(pitman_yor.END) if w == "" else _text.hash_of(w) >> 16


@pytest.mark.parametrize("hot_share", [2, 8, 1024])
def test_cells_do_not_depend_on_how_texts_are_dealt_out(spark, hot_share):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["hot"] * 6 + WORDS[:12]) for _ in range(rng.randrange(12)))) for i in range(150)] + [(200, None), (201, "one")]
    want = {tuple(map(hash_name, k)): n for k, n in brute_cells(rows).items()}
    m = pitman_yor.Model(hot_share=hot_share, words_per_shard=100)
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, DOCS).repartition(parts)
        layout, total = pitman_yor._layout(docs, m, "text")
        assert total == sum(want.values()) and (hot_share != 8 or (hash_name("hot") in layout.words and len(layout.pairs)))
        got = {}
        for r in pitman_yor._counted(docs, layout, "text").collect():
            words, x, v, w, n = pitman_yor.named(pitman_yor.unpack(r["blob"]))
            for cell in zip(words[x].tolist(), words[v].tolist(), words[w].tolist(), n.tolist()):
                assert cell[:3] not in got  # a cell lies in one shard
                got[cell[:3]] = cell[3]
        assert got == want


def sampled(rows, m, layout, turns):
    """The model trained without Spark, shard by shard: shards, shards of words, what the latter tell, and the totals."""
    table = pa.array([t for _, t in rows], pa.string())
    cells = {}
    for _, _, words, at in _text.word_chunks(table, True, 1 << 20):
        for p in pitman_yor.parts_of(words, at, layout):
            cells.setdefault(p.shard, []).append([p.names, p.x, p.v, p.w, np.diff(p.starts, append=len(p.texts))])
    packed = lambda c: pitman_yor.pack(np.diff(c[0].view(np.int64), prepend=0), *c[1:])
    blobs = {s: packed(pitman_yor.merged(p)) for s, p in cells.items()}
    shards = {s: pitman_yor.Shard(b, layout) for s, b in blobs.items()}
    stirling = [pitman_yor.stirling_logs(d, m.exact) for d in m.discounts]
    words, totals, rng, told = None, None, np.random.default_rng(5), {}
    for turn in range(turns + 1):
        up = {}
        for k, s in shards.items():
            if turn:
                s.hear(told[k], totals, m)
                s.sweep(m, rng, stirling)
            for q, x in s.sent(not turn):
                up.setdefault(q, {})[k] = x
        words = words or {q: pitman_yor.Words(pitman_yor.unpack(pitman_yor.Words.first(x).packed())) for q, x in up.items()}
        told, sums = {}, Counter()
        for q, w in words.items():
            w.hear(up[q])
            if turn:
                w.sweep(totals, m, rng, stirling)
            else:
                w.t2, w.t1 = np.minimum(w.c2, 1), np.ones(len(w.words), np.int64)
            for key, kind, _, blob, *ab in w.rows(q, layout):
                if kind == "told":
                    told.setdefault(key, {})[q] = blob
                elif kind == "total":
                    sums.update({(key, 0): ab[0], (key, 1): ab[1]})
        pairs = np.zeros((len(layout.pairs), 2))
        for s in shards.values():
            hot = np.flatnonzero(s.hot_pair >= 0)
            pairs[s.hot_pair[hot]] += np.stack([s.customers[hot], np.bincount(s.r, s.t, len(s.r_pair))[hot]], axis=1)
        both = lambda k: (sums[k, 0], sums[k, 1])
        totals = pitman_yor.Totals(both(-1), np.array([both(i) for i in range(len(layout.words))], float).reshape(-1, 2), pairs, sums[-2, 0])
    return blobs, shards, words, told, up, totals


@pytest.mark.parametrize("hot", [False, True])
def test_predictive_probabilities_add_up(hot):
    """After any context (met or not, hot or not) the probabilities of all words and one unknown add up to 1."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["hot", "hot", "hot", *WORDS[:9]]) for _ in range(rng.randrange(9)))) for i in range(120)]
    names = np.sort(np.array([hash_name("hot"), int(pitman_yor.START)], np.uint64))
    pair = lambda v, x: pitman_yor.pair_hash(np.array([hash_name(v)], np.uint64), np.array([hash_name(x)], np.uint64))
    pairs = np.sort(np.concatenate([pair("hot", "hot"), pair(None, None)]))
    none = np.zeros(0, np.uint64)
    layout, m = pitman_yor.Layout(*((names, pairs) if hot else (none, none)), 3), pitman_yor.Model()
    blobs, shards, words, told, up, totals = sampled(rows, m, layout, 3)
    every = np.array([hash_name(w) for w in sorted({w for k in brute_cells(rows) for w in k if w is not None})] + [12345], np.uint64)
    assert totals.n_words == len(every) - 1
    for x, v in ((None, None), (None, "hot"), ("hot", "hot"), (WORDS[1], WORDS[2]), ("hot", WORDS[3]), (WORDS[3], "hot"), ("never", WORDS[4]), ("never", "ever"), ("never", "hot"), (WORDS[5], None)):
        n = len(every)
        vs, xs = np.full(n, hash_name(v), np.uint64), np.full(n, hash_name(x), np.uint64)
        at, p = layout.shard(vs, xs, every), np.zeros(n)
        for s in range(layout.n):
            own = np.flatnonzero(at == s)
            if not len(own):
                continue
            dictionary, place = np.unique(np.concatenate([xs[own], vs[own], every[own]]), return_inverse=True)
            blob = pitman_yor.pack(np.diff(dictionary.view(np.int64), prepend=0), *np.split(place, 3), np.ones(len(own), int), own, np.ones(len(own), int))
            state = {0: pitman_yor.pack(shards[s].t, shards[s].t2)} if s in shards else {}
            asked = pitman_yor.Asked(blobs.get(s), state, {(0, q): b for q, b in told.get(s, {}).items()}, layout, [totals], m)
            for key, kind, _, answer in asked.rows(blob, 0, np.log10):
                if kind == "defer":
                    w = words.get(key)
                    shard = pitman_yor.AskedWords(w, {0: pitman_yor.pack(w.t1, w.t2)} if w else {}, {(0, k): b for k, b in up.get(key, {}).items()}, [totals], m)
                    answer = shard.row(answer, 0, lambda c: c * 0.0)[3]
                texts, _, _, log = pitman_yor.answered(answer)
                p[texts] += 10**log
        assert (p > 0).all() and p.sum() == pytest.approx(1, abs=1e-5), (x, v)


def test_draws_follow_all_seatings_with_a_parent():
    """Every seating of four customers, a table at a time, against the drawn numbers of tables."""
    d, strength, others, n = 0.7, 1.3, 3, 60_000
    parent = pitman_yor.Parent(np.full(n, 2.0), np.full(n, 1.0), np.full(n, 0.05), np.full(n, 9.0), 0.6)
    one, weight = parent.take(np.zeros(1, int)), Counter()

    def seat(tables, w):
        if sum(tables) == 4:
            weight[len(tables)] += w
            return
        for i, size in enumerate(tables):
            seat([*tables[:i], size + 1, *tables[i + 1 :]], w * (size - d))
        seat([*tables, 1], w * (strength + d * (others + len(tables))) * float(one.probability(len(tables))[0]))

    seat([], 1.0)
    t = pitman_yor.draw_tables(np.full(n, 4), parent, np.full(n, others), d, strength, pitman_yor.stirling_logs(d, 8), np.random.default_rng(3))
    for k in range(1, 5):
        assert (t == k).mean() == pytest.approx(weight[k] / sum(weight.values()), abs=0.01)


def test_arrays_come_back():
    rng = np.random.default_rng(1)
    arrays = [np.zeros(0, np.int64), np.arange(300), rng.integers(0, 1 << 40, 50), rng.integers(0, 1 << 63, 50).astype(np.uint64), rng.random(7), rng.random(5).astype(np.float32)]
    for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)


def test_orders_and_places_are_numpys():
    rng = np.random.default_rng(6)
    for most, n in ((5, 1000), (1 << 17, 3000), ((1 << 48) - 1, 200_000), ((1 << 62) - 1, 5000), (1, 0)):
        a = rng.integers(0, most, n, endpoint=True)
        a = np.append(a, a[: n // 3] ^ 1) if most > 5 else a  # nearly equal ones, too
        assert np.array_equal(pitman_yor.order_of(a, most), np.argsort(a, kind="stable"))
        for got, want in zip(pitman_yor.places_of(a.astype(np.uint64), most), np.unique(a, return_inverse=True), strict=True):
            assert np.array_equal(got, want)
        assert np.array_equal(pitman_yor.distinct(a), np.unique(a))
    for d in (30, 1 << 19, 1 << 21):
        x, v, w = rng.integers(0, d, (3, 4000)) // rng.integers(1, d, 4000)
        assert np.array_equal(pitman_yor.by_cell(x, v, w, d), np.lexsort((w, x, v)))


def test_common_words_are_sent_as_places():
    names = np.sort(np.unique(np.random.default_rng(2).integers(0, 1 << 48, 40_000)).astype(np.uint64))
    some = np.arange(5)
    part = pitman_yor.Part(0, names, some, some, some, some, some)
    plain = part.packed(some)
    for common in (names[::2], names, np.array([3], np.uint64), np.sort(np.append(names[:9], np.uint64(7)))):
        blob = part.packed(some, common=common)
        for a, b in zip(pitman_yor.named(pitman_yor.unpack(blob), common), pitman_yor.named(pitman_yor.unpack(plain)), strict=True):
            assert np.array_equal(a, b)
    assert len(part.packed(some, common=names[::2])) < 0.7 * len(plain)


def test_training_leaves_only_the_tables_of_its_samples(spark):
    before = len(spark.catalog.listTables())
    rows = [(i, f"the cat {i % 7} sat on the mat {i % 3}") for i in range(60)]
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_to = spark.conf.get(option, None)
    m = pitman_yor.Model(words_per_shard=100, burn_in=1, samples=2)
    assert pitman_yor.score(spark.createDataFrame(rows, DOCS), m).count() == 60
    assert len(spark.catalog.listTables()) - before == 2 + 2 * m.samples
    assert spark.conf.get(option, None) == set_to
