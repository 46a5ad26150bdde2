"""The deobfuscating search against all readings, and held-out accuracy on the labels."""

import random
from math import inf

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.llm import toxicity
from runweave.llm.common import prepare

DATA = "/root/testdata/sf0.1"


def model(seed):
    counts = np.random.default_rng(seed).integers(0, 40, (29, 29, 29))
    return toxicity.log_probabilities(counts).tolist()


def brute(d, span):
    """The best log probability over all readings, one by one."""
    best = -inf

    def go(k, a, b, last, total):
        nonlocal best
        if k == len(span):
            best = max(best, total + d.logp[a][b][0])
            return
        for x, cost in d.readings(span[k]):
            if x == "":
                go(k + 1, a, b, last, total + cost)
                continue
            c = int(toxicity._CLASS[ord(x)]) if ord(x) < 128 else 27
            go(k + 1, b, c, x, total + cost + d.logp[a][b][c])
            if x == last and 0 < c < 28:
                go(k + 1, a, b, last, total + cost + d.drop_repeat)

    go(0, 0, 0, "", 0.0)
    return best


@pytest.mark.parametrize("settle", [4096, 2])
def test_search_finds_the_best_reading(settle):
    rng = random.Random(1)
    for trial in range(150):
        d = toxicity.Decoder(model(trial % 5), settle=settle)
        span = "".join(rng.choice("ab1i!l@$.- ~ééoo0ss") for _ in range(rng.randrange(1, 10)))
        text, total = d.search(span)
        assert total == pytest.approx(brute(d, span), abs=1e-9)


def test_long_spans_are_read_as_a_whole():
    table = model(3)
    rng = random.Random(2)
    span = "".join(rng.choice("abcdef01!3$.-i") for _ in range(3000))
    whole, total = toxicity.Decoder(table).search(span)
    pieced, same = toxicity.Decoder(table, settle=50).search(span)
    assert whole == pieced and total == same
    raw = [("x1" * 400).encode(), b" ".join(b"abcdefgh"[k % 8 : k % 8 + 1] for k in range(90)), b"q w"]
    offs = np.cumsum([0, *map(len, raw)])
    assert toxicity.suspicious(np.frombuffer(b"".join(raw), np.uint8), offs) == [(0, 800), (800, 979)]


def test_trigrams_do_not_run_over_rows(spark):
    prepare(spark)
    d = spark.createDataFrame([("ab",), ("cd",), (None,), ("",)], "text string")
    one, many = (toxicity.trigram_counts(d.repartition(n)) for n in (1, 4))
    assert (one == many).all() and one[1, 2, 3] == 0 and one[0, 1, 2] == 1 and one[3, 4, 0] == 1


def test_held_out_labels(spark):
    prepare(spark)
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).where("toxic is not null")
    rows = toxicity.score(docs.select("doc_id", "text"), toxicity.learnable(labels)).join(held, "doc_id").collect()
    hit = sum(r.toxicity >= 0.5 and r.toxic == 1 for r in rows)
    toxic, said = sum(r.toxic == 1 for r in rows), sum(r.toxicity >= 0.5 for r in rows)
    assert toxic > 50 and hit >= 0.85 * toxic and hit >= 0.95 * said
