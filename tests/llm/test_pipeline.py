"""The pipeline's stages on a small corpus, each judged on its own input."""

import random
from hashlib import sha256

import corpus_pipeline
from factloom.llm import bpe_tree, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(900)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = "\n".join(line(20) for _ in range(3))
    items = [(i, line(30) + ".") for i in range(5)]
    texts = [f"{line(40)}\n{line(30)}" for _ in range(12)]
    texts += [f"{line(40)}\n{passage}\n{line(40)}" for _ in range(2)]
    texts += [texts[0] + " more", "too short", "again and again " * 100, f"{line(60)} {items[2][1]} {line(60)}", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        seen.append({r["doc_id"]: r for r in docs.collect()})
    rules, lines, near, clean, ids = seen
    assert rules.keys() == {i for i, t in enumerate(texts) if quality.judged(t or "", quality.Bands())[6]} >= set(range(15))
    assert passage in lines[12]["text"] and passage not in lines[13]["text"] and lines[13]["n_chars"] == len(lines[13]["text"])
    assert {i: r["text"] for i, r in lines.items() if i != 13} == {i: r["text"] for i, r in rules.items() if i != 13}
    assert near.keys() == lines.keys() - {14}
    assert clean.keys() == near.keys() - {17}
    codec = bpe_tree.codec(bpe_tree.Vocabulary(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN))
    for i, r in ids.items():
        assert r["ids_sha256"] == sha256(",".join(map(str, codec.encode(clean[i]["text"]))).encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids)


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, nulls, and columns whose names the stages might use themselves."""
    rng = random.Random(3)
    text = "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(4))
    schema = SCHEMA + ", n_removed_0 int, n_lines_0 int, __n int, key string, digest string, node long"
    extra = (1, 2, 3, "k", "d", 4)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, text, "en", "s", len(text), *extra), (1, text, "en", "s", len(text), *extra), (1, text, "en", "other", len(text), *extra), (None, text + " and more", None, None, None, *[None] * 6), (2, None, None, None, None, *[None] * 6), (3, "", "en", "s", 0, *extra)]
    kept = {"quality rules": 4, "line dedup": 6, "MinHash near-dedup": 3, "benchmark decontamination": 6}
    for some in ([], rows):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() == (kept[name] if some else 0), name
        assert corpus_pipeline.token_ids(spark, docs, str(tmp_path)).count() == len(some)
