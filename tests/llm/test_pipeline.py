"""The pipeline's stages, each against brute force on the stage's own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from runweave.llm import simhash, toxicity
from tests_support import brute_kept, brute_mix, brute_removed, split

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    inputs = []
    for k, (_, stage) in enumerate(cp.STAGES):
        inputs.append(docs)
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == cp._COLUMNS
    raw, clean, unique, cut, mixed = ([r.asDict() for r in d.collect()] for d in inputs)
    scores = {r.doc_id: r.toxicity for r in toxicity.score(inputs[0], toxicity.learnable(spark.read.parquet(f"{DATA}/labels.parquet"))).collect()}
    assert sorted(r["doc_id"] for r in clean) == sorted(d for d, s in scores.items() if s < 0.5) and 0 < len(clean) < len(raw)
    assert sorted(r["doc_id"] for r in unique) == sorted(clean[i]["doc_id"] for i in brute_kept([(r["doc_id"], r["text"]) for r in clean]))
    order = sorted(unique, key=lambda r: r["doc_id"])
    texts = [r["text"].encode() for r in order]
    after = {r["doc_id"]: r for r in cut}
    for r, t, hit in zip(order, texts, brute_removed(texts, 100)):
        left = np.frombuffer(t, np.uint8)[~hit].tobytes().decode("utf-8", "ignore")
        assert after[r["doc_id"]]["text"] == left and after[r["doc_id"]]["n_chars"] == len(left)
    times = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in cut])
    count = {}
    for r in mixed:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {r["doc_id"]: n for r, n in zip(cut, times) if n}
    packed = docs.collect()
    assert sum(r["size"] for r in packed) == sum(len(split(r["text"])) for r in mixed)
    bins = {}
    for r in packed:
        bins.setdefault(r.bin, []).append(r)
    for rows in bins.values():
        assert sum(r["size"] for r in rows) <= 2048 and len({r.cluster for r in rows}) == len(rows)


def test_clashing_columns_and_long_texts(spark):
    """Columns that stages use inside do no harm; very long texts go through every stage."""
    long = " ".join(f"q{i}" for i in range(40_000))
    rows = [(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (None, "some words here", "en", None, 1), (None, "other words there", "en", None, 1), (4, "x" * 300_000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("ord", "sub", "key", "fp", "node", "id", "text_hash", "same", "size", "shard", "toxicity", "gone", "pos", "n"):
        docs = docs.withColumn(name, F.lit("x"))
    near = cp.drop_near_duplicates(spark, docs, DATA)
    assert near.columns == cp._COLUMNS
    kept = [(r.doc_id, r.text[:5]) for r in near.collect()]
    assert sorted(kept, key=str) == sorted([(1, "q0 q1"), (None, "some "), (None, "other"), (4, "xxxxx")], key=str)
    for name, stage in cp.STAGES:
        if name != "near-dedup":
            out = stage(spark, docs, DATA)
            assert out.count() >= 3 and (stage is cp.pack_bins or out.columns == cp._COLUMNS)


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 3000, "en", None, 1), (None, "other text", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in cp.STAGES:
        stage(spark, docs, DATA).collect()
        stage(spark, docs.where(F.lit(False)), DATA).collect()
    kept = cp.drop_near_duplicates(spark, docs, DATA)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3]
    assert simhash.near_duplicates(docs, 5, 7).count() == 5
