"""Operators on single texts, against brute force and the libraries themselves."""

import base64
import random
import re
from hashlib import sha256
from math import log2

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import _text, bpe_tree, licences, pii, quality, secrets, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
MULTI = bpe_tree.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = ["", " ", "\n\n", "a", "  a  b ", "a" * 5000, "é" * 300, "x y " * 2000, "tab\tnew\nline\r\n", "中文字" * 50, "'s 're it's", " nbsp em", "🙂🙃 " * 40]
texts = st.text(alphabet="ab c.\n\t'sé中1-_@:=\"+()" , max_size=200)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@given(st.lists(texts, max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_are_hashed_alike(batch):
    seen = {}
    for low, high, hashes, at in _text.word_blocks(pa.array(batch, pa.string()), True, 64):
        for i in range(low, high):
            words = batch[i].encode().lower().split()
            got = hashes[at[i - low] : at[i - low + 1]].tolist()
            assert len(got) == len(words)
            for w, h in zip(words, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_base_counts(text):
    words = [w for w in text.encode().split()]
    n_words, chars, symbols, dup, repeat = quality.base_counts(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    assert n_words == len(words) and chars == sum(len(w.decode()) for w in words)
    assert symbols == sum(c in "#*$%&|<>" for c in text)
    assert dup == sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines)) and repeat == len(covered)


def test_bands():
    rng, words = random.Random(1), ["plain", "words", "about", "something", "that", "varies", "a", "little", "over", "time"]
    prose = " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(3000))
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(6000))
    b = quality.Bands()
    assert quality.judged(prose, b)[6]
    assert not quality.judged("the same line again and again. " * 300, b)[6]
    assert not quality.band_figures(noise.encode(), b, quality._packer(3))[3]


def test_the_last_chunk_is_judged_too():
    rng, b = random.Random(3), quality.Bands(chunk_bytes=4096)
    clean = " ".join(rng.choice(["plain", "words", "about", "things", "that", "vary"]) + str(rng.randrange(99)) for _ in range(900))[:4096]
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4096))
    repeat = ("the same line again and again. " * 140)[:4000]
    _, chunks, outside, passed = quality.band_figures((clean + noise + repeat).encode(), b, quality._packer(3))
    assert (chunks, outside, passed) == (3, 2, False)
    assert quality.band_figures((clean + repeat).encode(), b, quality._packer(3))[1:3] == (2, 1)
    assert quality.band_figures((clean + clean[::-1] + repeat[:500]).encode(), b, quality._packer(3))[1:] == (3, 1, True)


def test_quality_cases(spark):
    rows = [(1, None), (2, ""), (3, "short"), (None, "short"), (3, "short")]
    got = quality.quality_figures(frame(spark, rows)).collect()
    assert len(got) == 5 and all(r["base_failed"] and not r["kept"] for r in got)
    assert quality.quality_figures(frame(spark, [])).count() == 0
    extra = frame(spark, [(1, "x " * 3, 7, True)], "doc_id long, text string, n_words int, kept boolean")
    assert quality.quality_filter(extra).columns == extra.columns and quality.quality_filter(extra).count() == 0


def windows_entropy(value, n):
    def h(w):
        return -sum(w.count(c) / len(w) * log2(w.count(c) / len(w)) for c in set(w))

    n = min(n, len(value))
    return max((h(value[i : i + n]) for i in range(len(value) - n + 1)), default=0.0) if n else 0.0


@given(st.text(alphabet="abc123", max_size=60), st.integers(1, 25))
@settings(max_examples=200, deadline=None)
def test_incremental_entropy(value, n):
    assert secrets.top_window_entropy(value, n) == pytest.approx(windows_entropy(value, n), abs=1e-9)


def test_secret_shapes():
    found = secrets.scanned("Password = 'hunter22' AKIA" + "A1B2" * 4 + " deadbeef" * 3 + " token:abc", secrets.Scan())
    assert found[:3] == (1, 1, 0)
    assert secrets.base_spans("a" * 23 + " " + "0f" * 12) == [("hex", 24, 48)]
    assert secrets.base_spans("token: token: abcdefg") == []  # the failing match takes the second key word
    scan = secrets.Scan()
    assert secrets.entropy_spans("id 123e4567-e89b-12d3-a456-426614174000", scan) == []
    assert [s[0] for s in secrets.entropy_spans("k=Zx8Kq2Lm9Rt5Vw1Yb7Nc", scan)] == ["entropy"]
    assert secrets.scanned("", scan)[4] == sha256(b"").hexdigest()


def test_secret_cases(spark):
    rows = [(1, None), (1, None), (None, "password=abcdef"), (2, "secret=" + "z" * 100_000)]
    got = secrets.secret_scan(frame(spark, rows)).collect()
    assert sorted(r["n_assign"] for r in got) == [0, 0, 1, 1]
    assert secrets.secret_scan(frame(spark, [])).count() == 0


@given(texts)
@settings(max_examples=150, deadline=None)
def test_tree_encodes_as_the_whole(text):
    small = small_codec()
    ids = small.encode(text * 3)
    assert ids == small._whole(text * 3) and small.decode(ids) == (text * 3).encode()


def test_calibrated_bands_reject_what_the_base_keeps(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(words) + rng.choice(["###", "%%%", "&&&"]) for _ in range(n))
    rows = [(i, prose(250)) for i in range(200)] + [(200 + i, junk(190)) for i in range(20)] + [(300, None), (301, "")]
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(200, 0), (None, 1)], "doc_id int, quality int")
    bands = quality.calibrated(frame(spark, rows), labels, c=quality.Calibration(least_rows=20))
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_figures(frame(spark, rows), bands).collect()}
    assert sum(got[i] == (False, True) for i in range(200)) >= 196
    assert all(got[200 + i] == (False, False) for i in range(20))
    general = {r["doc_id"]: r["kept"] for r in quality.quality_figures(frame(spark, rows)).collect()}
    assert all(general[200 + i] for i in range(20))  # what the fitted limits add
    none = quality.calibrated(frame(spark, []), labels.limit(0))
    assert {c[1:] for c in none.classes} == {c[1:] for c in quality.GENERAL}


def test_limits_come_from_all_labelled_texts(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 7))) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words[: rng.randrange(100, 4000)], k=rng.randrange(51, 60)))) for i in range(22_000)]
    ratios = np.array([len(t) / len(quality._packer(3).compress(t.encode())) for _, t in rows if 256 <= len(t) < 363 and 2 * quality.base_counts(t)[4] <= len(t.split())])
    assert len(ratios) > 20_000
    c = quality.Calibration(tail=0.03)
    bands = quality.calibrated(frame(spark, rows), spark.createDataFrame([(i, 1) for i, _ in rows] * 2, "doc_id long, quality int"), c=c)
    low, high = np.quantile(ratios, [c.tail, 1 - c.tail])
    assert next(b for b in bands.classes if b[0] == 256)[1:] == pytest.approx((low / c.slack, high * c.slack), rel=1e-12)


def test_quantiles_are_those_of_all_rows(spark):
    rng = np.random.default_rng(4)
    values = {1: rng.uniform(0.5, 9, 3001), 2: np.round(rng.normal(2, 0.1, 500), 2), 3: np.full(70, 1.5), 4: np.array([2.0]), 5: np.append(np.full(400, 1.0), 8.0)}
    shares = (0.002, 0.5, 0.998)
    got = quality.quantiles(frame(spark, [(k, float(x)) for k, v in values.items() for x in v], "class long, ratio double"), shares).collect()
    assert {r["class"]: r["n"] for r in got} == {k: len(v) for k, v in values.items()}
    for r in got:
        assert r["q"] == pytest.approx(np.quantile(values[r["class"]], shares).tolist(), rel=1e-12)


def test_every_byte_is_judged_by_a_chunk():
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(700))
    tail = base64.b64encode(rng.randbytes(1400)).decode()
    text = (prose[:3900] + " " + tail).encode()
    ratio, chunks, outside, kept = quality.band_figures(text, quality.Bands(), quality._packer(3))
    assert chunks == -(-len(text) // 2048) and outside >= 1 and not kept


def test_names_and_named_digests_are_no_secrets():
    scan = secrets.Scan()
    rng = random.Random(6)
    digest = rng.randbytes(32).hex().upper()
    for text in ("/usr/local/lib/python3/site-packages/numpy", "getUserAccountByExternalIdentifier", f"SHA256: {digest}", f"sha256:{digest}", "123e4567-e89b-12d3-a456-426614174000", "MAX_CONNECTION_RETRY_COUNT_V2", "abcdefghijklmnopqrstuvwxyz0123", "this-is-a-long-slug-of-words-2024-05-01"):
        assert secrets.entropy_spans(f"see {text} here", scan) == []
    key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(32))
    for text in (f"Authorization Bearer {key} sent", f"ghp_{key}", f"upper {digest} alone", base64.b64encode(rng.randbytes(30)).decode()):
        base = secrets.base_spans(text)
        assert base == [] and len(secrets.entropy_spans(text, scan, base)) == 1
    inside = f'token = "{key}"'
    assert len(secrets.base_spans(inside)) == 1 and secrets.entropy_spans(inside, scan, secrets.base_spans(inside)) == []


def test_every_longer_text_goes_through_the_tree():
    joins = []
    codec = bpe_tree.Codec(MULTI)
    joined = codec._joined
    codec._joined = lambda *a: joins.append(1) or joined(*a)
    codec.encode("a text of some more than sixty-four characters, so that it has two leaves")
    assert joins == [1]


def small_codec(made=[]):  # noqa: B006
    if not made:
        made.append(bpe_tree.Codec(bpe_tree.Vocabulary(MULTI.ranks_path, MULTI.pattern, leaf_chars=16, first_window=2)))
    return made[0]


def test_tree_on_odd_texts(spark):
    for t in ODD:
        assert small_codec().encode(t) == small_codec()._whole(t)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (0, ODD[0])]
    got = bpe_tree.bpe_digests(frame(spark, rows), MULTI).collect()
    whole = bpe_tree.codec(MULTI)._whole
    for r in got:
        t = dict(rows)[r["doc_id"]] or ""
        assert r["ids_sha256"] == sha256(",".join(map(str, whole(t))).encode()).hexdigest() and r["decoded_sha256"] == sha256(t.encode()).hexdigest()
    back = bpe_tree.bpe_decode(bpe_tree.bpe_encode(frame(spark, rows), MULTI), MULTI)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t in rows)


def test_counts_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, count, rng = Tokenizer.from_file(path), token_counts.counter(path), random.Random(2)
    pieces = ["a", "the", " ", "  ", "\n", "'s", "<|endoftext|>", "<|", "é", "中", "1", ".", " ", "\x1c", "🙂"]
    cases = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(500)]
    assert [count(t) for t in cases] == [len(library.encode(t, add_special_tokens=False)) for t in cases]


def test_digest_cache_encodes_only_misses(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    docs = frame(spark, [(1, "one two"), (2, "one two"), (3, None), (4, "three")])
    first = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, path, cache, limit=1).collect()}
    assert first == {1: (7, 2, True), 2: (7, 2, True), 3: (0, 0, False), 4: (5, 1, False)}
    stored = spark.read.parquet(cache)
    assert stored.count() == 3
    more = docs.unionByName(frame(spark, [(5, "five")]))
    assert token_counts.token_counts(more, path, cache, limit=1).count() == 5
    assert spark.read.parquet(cache).count() == 4
    assert token_counts.token_counts(frame(spark, []), path, str(tmp_path / "none")).count() == 0


def test_normalised_contents_share_a_count(spark, tmp_path):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    rows = [(1, "One  TWO"), (2, "one two"), (3, None), (None, "x" * 200_000), (4, "a <|startoftext|> B"), (4, "a <|startoftext|> B"), (5, "a <|STARTOFTEXT|> b")]
    docs = frame(spark, rows).selectExpr("*", "'clash' AS content", "'clash' AS digest")
    got = token_counts.token_counts(docs, path, cache).collect()
    want = {(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows}
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == len(rows)
    assert spark.read.parquet(cache).count() == 5  # the first two are one content


def test_copies_of_one_text_are_looked_up(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "the same text") for i in range(3000)] + [(3000 + i, f"text {i}") for i in range(3000)]
    got = token_counts.token_counts(frame(spark, rows), path, str(tmp_path / "cache")).collect()
    count = token_counts.counter(path)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: count(t) for i, t in rows} and len(got) == 6000


@given(st.text(alphabet="ab1.@-_ +2:", max_size=60))
@settings(max_examples=300, deadline=None)
def test_emails_as_the_pattern(text):
    import re

    assert pii.emails(text) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


@given(st.text(alphabet="0123456789.- +()", max_size=60))
@settings(max_examples=300, deadline=None)
def test_numbers_as_the_patterns(text):
    import re

    got = pii.base_spans(text)
    ips = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    cards = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    phones = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    assert [s[1:] for s in got if s[0] == "ip"] == ips and [s[1:] for s in got if s[0] == "card"] == cards and [s[1:] for s in got if s[0] == "phone"] == phones


def test_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"please call my phone +1 555 010 20{i:02} today") for i in range(6)]
    rows = [*seeds, *((20 + i, f"see user ident a{i}@x{i}.org now") for i in range(5)), (50, "see user ident bob99@localhost9 now"), (60, "room number 12345 is free"), (61, None), (62, "")]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert all(got[i]["n_phone"] == 1 for i in range(6)) and got[20]["n_email"] == 1
    assert got[60]["n_context"] == 0 and got[61]["spans"] == "" and len(got) == len(rows)
    at = dict(rows)[50].index("bob99")
    assert got[50]["spans"] == f"context:{at}:{at + len('bob99@localhost9')}"
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_words_found_before_anything_are_no_patterns(spark):
    rows = [(i, f"the mail of the staff went to the a{i}@mail{i}.org and the rest of the day was the same") for i in range(40)]
    rows += [(90, "it was the b77@intra7 that the others saw"), (91, "contact the 020 7946 0958 now")]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[0]["spans"].startswith("email:") and got[0]["n_context"] == 0
    assert got[90]["n_context"] == 0 and got[91]["n_context"] == 0


def scores_by_hand(seen, others, b):
    """Pattern confidences by plain loops."""
    edges = {(p, i) for _, i, p in seen}
    seeds = {i for k, i, _ in seen if k}
    belief = {i: float(i in seeds) for _, i in edges}
    for _ in range(b.rounds):
        out = {}
        for p in {p for p, _ in edges}:
            own = [belief[i] for q, i in edges if q == p]
            if sum(x >= b.least_confidence for x in own) >= b.least_seeds:
                out[p] = sum(own) / (len(own) + sum(n for q, n in others if q == p) + b.smoothing)
        for i in belief:
            doubt = 1.0
            for q, j in edges:
                if j == i and out.get(q, 0) >= b.least_confidence:
                    doubt *= 1 - min(out[q], 0.999)
            belief[i] = 1.0 if i in seeds else 1 - doubt
    return out


def test_pattern_scores_by_hand(spark):
    rng = random.Random(4)
    seen = [(rng.choice(["email", None, None]), f"i{rng.randrange(30)}", f"p{rng.randrange(8)}") for _ in range(200)]
    seen += [("email", f"s{k}", "good") for k in range(9)] + [(None, "i1", "good"), (None, "i2", "good")]
    others = [(f"p{rng.randrange(8)}", rng.randrange(1, 5)) for _ in range(6)] + [("good", 1), ("good", 1)]
    b = pii.Bootstrap(rounds=3, least_confidence=0.6)
    got = {r["pattern"]: r["confidence"] for r in pii.pattern_scores(spark.createDataFrame(seen, "kind string, instance string, pattern string"), spark.createDataFrame(others, "pattern string, n long"), b).collect()}
    assert got == pytest.approx(scores_by_hand(seen, others, b))


def test_context_finds_identifiers_of_other_forms(spark):
    rows = [(i, f"write to staff contact: a{i}@mail{i}.org at once") for i in range(60)]
    rows += [(100 + i, f"staff contact: EMP-77{i}0 is away") for i in range(12)]  # believed after the first round
    rows += [(200 + i, f"shown on passport EMP-77{i}0 today") for i in range(12)]
    rows += [(300, "shown on passport X12345678 today"), (301, "staff contact 020 7946 0958 now"), (302, "staff contact @dana_k now"), (303, "room 12345 and hall 777 are free")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, rows)).collect()}
    for i, value in ((100, "EMP-7700"), (300, "X12345678"), (301, "020 7946 0958"), (302, "@dana_k")):
        at = dict(rows)[i].index(value)
        assert got[i] == f"context:{at}:{at + len(value)}"
    assert got[303] == "" and got[0].startswith("email:") and "context" not in got[0]


def test_licence_own_and_inherited(spark):
    rows = [
        ("a/LICENSE", 1, "Released under the MIT License."), ("a/b/c/x.txt", 2, "nothing here"), ("a/b/LICENSE.txt", 3, "Licensed under the Apache License, Version 2.0."),
        ("a/d/y.txt", 4, "prose before\nLicensed under CC BY-NC 4.0.\nand prose after it goes on and on for a while"), ("z/q.txt", 5, None), (None, 6, "All rights reserved."), ("a/e/w.txt", 7, ""), ("a/e/w.txt", 7, ""),
    ]
    got = {r["doc_id"]: (r["own"], r["inherited"], r["licence"], r["from_dir"]) for r in licences.licences(frame(spark, rows, "path string, doc_id int, text string")).collect()}
    assert got[2] == (None, "Apache-2.0", "Apache-2.0", "a/b") and got[4] == ("CC-BY-NC-4.0", None, "CC-BY-NC-4.0", None)
    assert got[5] == (None, None, None, None) and got[6][0] == "proprietary" and got[7] == (None, "MIT", "MIT", "a")
    assert licences.licences(frame(spark, [], "path string, doc_id int, text string")).count() == 0


def test_licence_cosine_by_brute_force():
    t = licences.Templates()
    sets = [licences.words_of(n[1]) for n in t.notices]
    idf = lambda w: 1 + np.log(len(sets) / sum(w in s for s in sets)) if any(w in s for s in sets) else 1 + np.log(len(sets))
    vector = lambda words: {w: words.count(w) * idf(w) for w in words}
    for line in ("Licensed under the MIT License", "All rights are reserved here.", "The Mozilla public licence", "Licensed under the Apache License, Version 2.0"):
        v = vector(licences.words_of(line))
        norm = lambda x: np.sqrt(sum(y * y for y in x.values()))
        allowed = [s for s, (_, _, needs, bars) in zip(sets, t.notices, strict=True) if (not needs or re.search(needs, line.lower())) and not (bars and re.search(bars, line.lower()))]
        best = max(sum(v.get(w, 0) * x for w, x in vector(s).items()) / norm(v) / norm(vector(s)) for s in allowed)
        assert licences.nearest(licences.counted(licences.words_of(line)), line, t)[0] == pytest.approx(best if best >= t.least_cosine else 0)


@pytest.mark.parametrize(("text", "want"), [
    ("GNU General Public License, version 2", "GPL-2.0"), ("GNU General Public License, version 3", "GPL-3.0"), ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("Released under the ISC License.", "ISC"), ("Released under the BSD 2-Clause License.", "BSD-2-Clause"), ("No rights reserved.", None), ("plain prose of no licence at all", None),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    (licences._BSD.replace(": ", ":\n\n* ").replace(". Redis", ".\n\n* Redis") + "\n\n" + licences._BSD_WARRANTY, "BSD-2-Clause"),
    (licences._BSD.replace(": ", ":\n\n* ").replace(". Redis", ".\n\n* Redis") + "\n\n* " + licences._BSD_NAMES + "\n\n" + licences._BSD_WARRANTY, "BSD-3-Clause"),
])
def test_licences_are_told_from_their_neighbours(text, want):
    assert licences.own_licence(text, licences.Templates())[0] == want
