"""Near copies of the pipeline against brute force over exact shingle sets."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from runweave.llm import resemblance
from runweave.llm.common import prepare
from tests_support import brute_kept

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("share,pivots", [(512, 16), (3, 2), (4, 0)])
def test_similar_texts(spark, share, pivots):
    prepare(spark)
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((30, 200, 900)))]
        for _ in range(6):
            copy = list(words)
            for at in rng.sample(range(len(copy)), int(len(copy) * rng.choice((0, 0.01, 0.02, 0.03, 0.06)))):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((1000 + len(rows), " ".join(copy)))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = resemblance.first_of_each(docs, 5, share, pivots).collect()
    assert sorted(r.id for r in got) == sorted(rows[i][0] for i in brute_kept(rows))


def test_far_bits_but_similar(spark):
    """Copies of similarity 0.8 and over whose fingerprints differ in more than 7 bits go; nearer bits below 0.8 stay."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("doc_id").isin(145, 6, 177, 1, 192, 155))
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, DATA).collect()) == [1, 6, 155, 192]


def test_null_and_reused_ids(spark):
    """Unrelated texts under a null or reused doc_id stay; a row that repeats id and text is one."""
    say = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, say("a")), (None, say("b")), (7, say("c")), (7, say("d")), (7, say("d")), (8, say("a") + " end")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    kept = cp.drop_near_duplicates(spark, docs, DATA).collect()
    assert sorted((r.doc_id or -1, r.text[0]) for r in kept) == [(-1, "a"), (-1, "b"), (7, "c"), (7, "d")]
