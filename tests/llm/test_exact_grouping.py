"""Texts whose polynomial hashes are equal under every seed lose nothing; hot keys are worked in parts."""

import numpy as np
import pytest

from runweave.llm import substring, suffix
from runweave.llm.common import prepare, span_hash, word_ids
from runweave.llm.windows import not_first, same_spans
from tests_support import brute_removed, split

DATA = "/root/testdata/sf0.001"


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_colliding_words_and_bytes(spark):
    prepare(spark)
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    raw = np.frombuffer((x + y).encode(), np.uint8)
    for seed in (*substring._SEEDS, *suffix._SEEDS):
        h = span_hash(raw, np.array([0, 2048]), np.array([2048, 4096]), seed)
        assert h[0] == h[1]  # the hash alone would take them for equal
    same = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"{same} {x}")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup_words(docs).collect()} == {1: 0, 2: 0, 3: 20}
    texts = [x, y, x]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = [int(h.sum()) for h in brute_removed([t.encode() for t in texts], 100)]
    for options in ({}, {"crowded": 2}, {"shard": 3000}):
        got = {r.doc_id: r.n_removed for r in suffix.dedup_bytes(docs, **options).collect()}
        assert [got[i] for i in range(3)] == want


def test_classes_split_where_entries_differ():
    text = b"aabbaabbccaa"
    start = np.array([0, 2, 4, 6, 8, 10])
    z = np.zeros(6, np.uint64)
    found = not_first(np.arange(6), np.zeros(6, int), np.zeros(6, int), z, z, same_spans(text, start, start + 2))
    assert sorted(found.tolist()) == [2, 3, 5]


def test_word_names():
    words = [b"a", b"a\0", b"\0", b"abcdefgh", b"abcdefghi", b"x" * 15, b"x" * 16, b"x" * 300, b"y" * 300, b"a"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    low, high = word_ids(data, ends - [len(w) for w in words], ends)
    assert len(set(zip(low.tolist(), high.tolist()))) == 9 and (low[0], high[0]) == (low[9], high[9])


@pytest.mark.parametrize("options", [{"split": 2}, {"held_bytes": 2000}, {"split": 2, "held_bytes": 500}])
def test_hot_keys(spark, options):
    prepare(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    line = " ".join(f"v{i % 7}" for i in range(64))
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, f"x{i} {line} y{i % 3}") for i in range(60)], "doc_id bigint, text string"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    units = [split(t) for _, t in rows]
    got = {r.doc_id: r for r in substring.dedup_words(docs.repartition(6), **options).collect()}
    for (doc, _), u, hit in zip(rows, units, brute_removed(units, 20)):
        assert (got[doc].n_removed, got[doc].kept) == (int(hit.sum()), b" ".join(w for w, h in zip(u, hit) if not h).decode())
