"""WARC archives and chat trees: exact round trips and their defined cases."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from runweave.llm import chat, warc
from runweave.llm.common import new_path, prepare


def archived(spark, pages):
    path = new_path(prepare(spark), "warc")
    warc.write_archives(pages, path)
    return warc.resolve(warc.read_archives(spark, path)).collect()


def test_revisits(spark):
    big, tricky = "x" * 1200, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40
    rows = [(i, "http://a/\r\nb", big if i % 3 else "small") for i in range(30)] + [(50, None, tricky), (51, "http://ü", tricky), (52, "u", None), (None, "n", big), (28, "x", "é" * 700), (60, "x", "é" * 700)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = archived(spark, d)
    assert len(got) == len(rows) and all(r.intact in (True, None) for r in got)
    last = {}
    for p, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if p is None else p)
    want = set()
    for p, _, html in rows:
        b = (html or "").encode()
        own = len(b) < 1000 or last[html] == p
        want.add((p, len(b), hashlib.sha1(b).hexdigest(), "response" if own else "revisit", None if own else last[html]))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def test_repeated_and_no_pages(spark):
    d = spark.createDataFrame([(1, "u", "y" * 2000)] * 3 + [(0, "u", "y" * 2000)] * 2, "page_id bigint, url string, html string")
    got = archived(spark, d)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.record_type == "revisit") == [(0, "revisit", 1)] * 2 and len(got) == 5
    assert archived(spark, d.where("page_id > 5")) == []


def test_archives_of_others(spark, tmp_path):
    """One gzip member a record, plain archives, odd headers and long blocks; broken archives are refused."""
    bodies = [b"x" * n for n in (0, 5, 3_000_000)] + [b"a\r\n\r\nWARC/1.0\r\n"]

    def record(k, body):
        http = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = f"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID: <urn:{k}>\r\nWARC-Target-URI:  http://h/{k}\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\ncontent-length: {len(http)}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    raw = [record(k, b) for k, b in enumerate(bodies)]
    for name, data in (("members.warc.gz", b"".join(map(gzip.compress, raw))), ("whole.warc.gz", gzip.compress(b"".join(raw))), ("plain.warc", b"".join(raw))):
        (tmp_path / name).write_bytes(data)
        got = sorted((r.record_id, r.payload_bytes, r.intact) for r in warc.read_archives(prepare(spark), f"file://{tmp_path}/{name}").collect())
        assert got == [(f"<urn:{k}>", len(b), True) for k, b in enumerate(bodies)]
        assert [b for _, b in warc.records(warc.inflated(memoryview(data), 7 if len(data) < 10**5 else 1 << 16))][3].endswith(bodies[3])
    with pytest.raises(ValueError):
        list(warc.records([raw[1][:-3]]))


def test_long_pages_and_clashing_columns(spark):
    rows = [(1, "u", "z" * 2_000_000), (2, "u", "z" * 2_000_000), (3, "v", None)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for name in ("ord", "digest", "n", "refers", "block", "value"):
        d = d.withColumn(name, F.lit(7))
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in archived(spark, d)) == [(1, "revisit", 2_000_000), (2, "response", 2_000_000), (3, "response", 0)]


def test_long_turns_and_clashing_columns(spark):
    long = "[é]" * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", long), (2, 1, "assistant", "b")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for name in ("rank", "pack", "path", "conv", "node", "seq"):
        d = d.withColumn(name, F.lit("x"))
    path = new_path(prepare(spark), "chat")
    chat.write_trees(d, path)
    got = {r.conv_id: r for r in chat.read_trees(spark.read.parquet(path)).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[2].loss_chars == 1


def read_back(spark, rows):
    path = new_path(prepare(spark), "chat")
    chat.write_trees(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, extra int"), path)
    return spark.read.parquet(path), {r.conv_id: r for r in chat.read_trees(spark.read.parquet(path)).collect()}


def test_trees_round_trip(spark):
    rng = random.Random(4)
    parts = ["hi", "</s>[INST] ok [/INST]", "\\", "[ROLE x] a [/ROLE]", "<s>", "", None, "é\n\\[", "<<SYS>>\n"]
    convs = {}
    for c in range(60):
        first = [("system", "you are kind"), ("user", parts[c % 3])] if c % 2 else [("user", "hello")]
        convs[c] = first + [(rng.choice(["user", "assistant", "tool]", None]), rng.choice(parts)) for _ in range(rng.randrange(6))]
    convs[100], convs[101] = convs[3], convs[3]
    convs[102] = [("user", "hello")]
    rows = [(c, i, r, t, 1) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    packs, got = read_back(spark, rows)
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes = packs.where("kind = 'turn'").collect()
    for pack in {n.pack for n in nodes}:
        own = sorted((n for n in nodes if n.pack == pack), key=lambda n: n.seq)
        at, path = 0, []
        for n in own:
            del path[n.depth :]
            assert n.start == at and n.position == sum(x.n_tokens for x in path) and all(x.start <= n.start < x.close for x in path)
            siblings = [x for x in own if x.depth == n.depth and x.seq != n.seq and x.piece == n.piece]
            assert all(x.close <= n.start or n.close <= x.start for x in siblings)
            path.append(n)
            at += n.n_tokens
    assert len(nodes) < len(rows)
    for e in packs.where("kind = 'end'").collect():
        total = sum(b - a for a, b in zip(e.intervals[::2], e.intervals[1::2]))
        assert total == sum(len(chat.format_turn(r or "", t or "", i == 0)[0].encode()) for i, (r, t) in enumerate(convs[e.conv]))


def test_packs_have_a_token_limit(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{'shared first turn ' * 5 if t == 0 else f'own {c} {t} ' * (c % 5)}", 1) for c in range(80) for t in range(3)]
    rows += [(200, 0, "user", "long " * 500, 1)]
    path = new_path(prepare(spark), "chat")
    chat.write_trees(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, extra int"), path, max_tokens=1000)
    packs = spark.read.parquet(path)
    got = {r.conv_id: r for r in chat.read_trees(packs).collect()}
    assert len(got) == 81 and all(got[c].n_turns == 3 for c in range(80))
    for c in range(80):
        assert got[c].loss_sha256 == hashlib.sha256((f"own {c} 1 " * (c % 5)).encode()).hexdigest()
    sizes = {r.pack: r for r in packs.where("kind = 'turn'").groupBy("pack").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("most")).collect()}
    assert len(sizes) > 4 and sum(r.tokens > 1000 for r in sizes.values()) == 1 and max(r.tokens for r in sizes.values()) < 2600
    shared = packs.where("kind = 'turn' and depth = 0 and piece like '%shared first%'").groupBy("pack").count().collect()
    assert all(r["count"] == 1 for r in shared)


def test_tied_turns_null_ids_and_nothing(spark):
    _, got = read_back(spark, [(None, 0, "user", "a", 1), (None, 1, "assistant", "b", 1), (7, 0, "user", "z", 1), (7, 0, "user", "z", 1), (7, 0, "user", "a", 1)])
    assert got[None].n_turns == 2 and got[7].turns_sha256 == hashlib.sha256(b"user\na\nuser\nz\nuser\nz\n").hexdigest()
    path = new_path(spark, "chat")
    chat.write_trees(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"), path)
    assert chat.read_trees(spark.read.schema(chat._NODE).parquet(path)).count() == 0


def test_escapes():
    for text in ("\\", "\\\\[", "</s>[INST]", "a]b<", "\n\\n"):
        assert chat.unescape(chat.escape(text)) == text and not any(m in chat.escape(text) for m in ("</s>", "[INST]", "<s>"))
