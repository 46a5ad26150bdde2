"""The operators on documents against brute force, and their defined cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.llm import countmin, fingerprint, mixing, packing, quality, simhash, substring, suffix, toxicity
from runweave.llm.common import prepare
from runweave.llm.induced import InducedSorter
from runweave.llm.windows import ranges, sliding_min
from tests_support import brute_fingerprint, brute_mix, brute_removed, split

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeats and columns whose names clash."""
    prepare(spark)
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(300), say(60)
    texts = [base, base, base.replace(" w1", " x1", 2), base + " tail", None, "", "  \t ", "one", "two words", passage, say(40) + " " + passage + " " + say(30), passage + "\n" + passage]
    texts += [say(n) for n in (3, 4, 5, 19, 20, 21, 99, 500)] + [say(30000), "a" * 5000, "ab" * 900, "é" * 300 + " ü ", "Ünï cödé " * 40]
    rows = [(i * 3, t, "en", rng.choice(["s1", "s2", "s3", None]), 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[9]]
    d = spark.createDataFrame(rows, SCHEMA)
    for name in ("ord", "sub", "key", "fp", "n", "size", "host", "line", "cluster", "bin", "words", "score", "_order", "toxicity_"):
        d = d.withColumn(name, F.lit(7))
    return d


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- SimHash


@pytest.mark.parametrize("tau,dense,crowded", [(4, 24, 4096), (4, 1, 2), (7, 1, 4096), (7, 1, 2)])
def test_simhash(spark, odd, tau, dense, crowded):
    docs = odd.select("doc_id", "text", "fp").unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(1).alias("fp")))
    rows = [(r.doc_id, brute_fingerprint(r.text, 4)) for r in docs.collect()]
    parent = {i: i for i in range(len(rows))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= tau:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    want = sorted((d, fp, least[root(i)]) for i, (d, fp) in enumerate(rows))
    got = simhash.near_duplicates(docs, 4, tau, dense, crowded).collect()
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_thresholds_are_unequal_and_complete():
    both = np.full((64, 64), 250.0)
    both[np.diag_indices(64)] = 500
    for m in (2, 3, 4, 5):
        groups = simhash.group_bits(1000, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, ts = simhash.allot(1000, both, groups, 4)
        assert sum(t + 1 for t in ts) == 5


# ---------------------------------------------------------------- toxicity


def test_decoder_restores():
    counts = np.zeros((29, 29, 29), np.int64)
    for word in ("idiot", "stupid", "loser", "trash", "the", "and", "moron"):
        c = [0, 0, *(ord(x) - 96 for x in word), 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            counts[a, b, d] += 50
    d = toxicity.Decoder(toxicity.log_probabilities(counts).tolist())
    for given, want in [("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuuupid", "stupid"), ("l o s e r", "loser"), ("tr4sh", "trash"), ("m.o.r.o.n", "moron")]:
        assert d.decode(given) == want


def test_toxicity_learns(spark):
    rng = random.Random(2)
    plain = ["sun", "tree", "river", "stone", "cloud", "house", "green", "walk", "slow", "idle", "total", "light"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["idiot", "1d10t", "i d i o t", "idiooot"]) if i > 40 else "idiot"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, toxicity.learnable(marks)).collect()}
    assert sum((got[i] >= 0.5) != bool(t) for i, t in labels) <= 4


def test_toxicity_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (6, None), (0, 0)], "doc_id bigint, toxic int")
    got = toxicity.score(odd, labels)
    assert got.columns == [*odd.columns, "toxicity"] and got.count() == odd.count()
    assert got.where("not (toxicity between 0 and 1)").count() == 0
    assert toxicity.score(nothing, labels).count() == 0
    assert toxicity.score(odd, labels.where("toxic > 5")).where("toxicity > 0.01").count() == 0


def test_restored_offsets():
    d = toxicity.Decoder(np.full((29, 29, 29), -3.0).tolist())
    texts = ["plain text here", "", "a stuuuupid one", "x y z end", "1d10t"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    data, moved = toxicity.restore(np.frombuffer(b"".join(raw), np.uint8), offs, d)
    got = [data[a:b].tobytes().decode() for a, b in zip(moved, moved[1:])]
    assert got[0] == texts[0] and got[1] == "" and got[2].startswith("a stu") and got[2].endswith(" one") and len(got) == 5


# ---------------------------------------------------------------- fingerprints


def test_edited_and_next(spark, odd, nothing):
    unique = odd.dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in unique.collect())
    got = {r.doc_id: r for r in fingerprint.edited_and_next(unique).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (edited == text) and (r.near_next == 1) >= (after == text)
        if len(split(text)) > 2000:
            a, b = ({b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (split(text), split(edited)))
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.05
    assert fingerprint.edited_and_next(nothing).count() == 0
    assert fingerprint.edited_and_next(odd).count() == odd.count()
    alone = fingerprint.edited_and_next(unique.where("doc_id = 0")).first()
    assert alone.near_next == 1


def brute_sketch(text):
    w = split(text)
    found = {hashlib.md5(b" ".join(w[i : i + 5])).hexdigest()[:16] for i in range(max(1, len(w) - 4))} if w else set()
    return sorted(h for h in found if h < "2"), min(found, default=None)


def brute_like(a, b):
    (a, least_a), (b, least_b) = brute_sketch(a), brute_sketch(b)
    return len(set(a) & set(b)) / len({*a, *b}) if a or b else float(least_a == least_b)


def test_sketches_are_exact(spark, odd):
    docs = odd.dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fingerprint.edited_and_next(docs).collect()}
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        kept, least = brute_sketch(text)
        assert got[doc].fingerprint == ("".join(kept) or (f"~{least}" if least else ""))
        assert got[doc].near_edited == pytest.approx(brute_like(text, edited)) and got[doc].near_next == pytest.approx(brute_like(text, after))


def test_sketches_merge(spark):
    """The sketch of a union is the union of the sketches, for short texts as well."""
    rng = random.Random(8)
    rows = [(" ".join(f"a{rng.randrange(900)}" for _ in range(n)), " ".join(f"b{rng.randrange(900)}" for _ in range(m))) for n, m in [(3000, 1000), (5, 5), (6, 9), (12, 40), (5, 2000)] * 6]
    d = spark.createDataFrame(rows, "a string, b string")
    d = fingerprint.with_sketch(fingerprint.with_sketch(d, "a", "x"), "b", "y").withColumn("m", fingerprint.merge("x", "y"))
    for r in d.select("a", "b", "x", "m", fingerprint.containment("x", "m").alias("c")).collect():
        (x, least_x), (y, least_y) = brute_sketch(r.a), brute_sketch(r.b)
        assert (r.m.kept, r.m.least) == (sorted({*x, *y}), min(least_x, least_y)) and r.c == 1.0
        assert all(h < "2" for h in r.m.kept)


def test_ranges_of_one_id(spark):
    """Rows under one id, null among them, are cut into ranges by their texts."""
    rows = [(None, f"text {i} " + "w " * (i % 7)) for i in range(300)] + [(i, f"other {i}") for i in range(100)] + [(50, "tie")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = fingerprint.with_next(d, rows_in_range=8).collect()
    assert len(got) == len(rows) and all(r.next_text is not None for r in got)
    assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)  # one round through all
    after = {r.text: r.next_text for r in got}
    assert [after[f"other {i}"] for i in range(48)] == [f"other {i + 1}" for i in range(48)]
    slim = d.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_order"), F.xxhash64("text").alias("_tie"))
    cuts = fingerprint._splits(slim, 40)
    assert sum(o == -(2**63) for o, _ in cuts) > 10


# ---------------------------------------------------------------- quality


def test_base_counts(spark, odd, nothing):
    got = quality.judge(odd).collect()
    assert len(got) == odd.count() and quality.judge(nothing).count() == 0
    by = {r.doc_id: r for r in got}
    for row in odd.collect():
        t = row.text or ""
        words = [w.decode() for w in split(t)]
        seen = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = by[row.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and (not r.base_failed or not r.kept)


def test_frequent_lines(spark):
    letters = lambda n: chr(97 + n % 26) + chr(97 + n // 26)
    own = lambda i: " ".join(f"d{letters(i)}w{letters(k)}" for k in range(30))
    rows = [(i, f"Share this 20{i:02d} page\n{own(i)}", "h1") for i in range(60)] + [(100 + i, own(0), "h1") for i in range(60)]
    rows += [(200 + i, "share THIS 2000 page\n" * 12 + f"few words {letters(i)}", "h1") for i in range(40)] + [(300, "Share this 2001 page\n" + own(9), "h2")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality.judge(d, most_docs=20, most_share=0.01).collect()}
    assert all(got[i].n_removed_lines == 1 and got[i].kept for i in range(60))
    assert all(got[100 + i].n_removed_lines == 0 and got[100 + i].kept for i in range(60))  # copies are one document
    assert all(got[200 + i].n_removed_lines == 12 and got[200 + i].depleted for i in range(40))
    assert got[300].n_removed_lines == 0


# ---------------------------------------------------------------- mixing


def test_mix(spark, odd, nothing):
    docs = odd.unionByName(spark.read.parquet(f"{DATA}/documents.parquet"), allowMissingColumns=True)
    got = mixing.mix(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows) and mixing.mix(nothing).count() == 0
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(split(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        left, w = total - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        share = {s: left * weight[s] / w for s in names if s not in capped}
        over = {s: 3.0 * size[s] for s in share if share[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = share | capped
    assert all(r.taken <= 3 * r["size"] and r.taken == r.epochs * r["size"] for r in got)
    assert sum(r.taken for r in got) <= total and total - sum(r.taken for r in got) <= max(r["size"] for r in got)
    assert {round(r.target, 4) for r in got} <= {round(t, 4) for t in target.values()}
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.text_hash, r.same, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sent = mixing.mixed_documents(docs)
    assert sent.columns == docs.columns and sent.count() == sum(r.epochs for r in got)
    largest = max(r["size"] for r in got)
    for s in names:  # each source comes near its target
        taken = sum(r.taken for r in got if abs(r.target - target[s]) < 1e-6 and r.source_size == size[s])
        same = sum(1 for x in names if size[x] == size[s] and abs(target[x] - target[s]) < 1e-6)
        assert abs(taken - same * target[s]) <= 2 * largest


def test_mix_by_hand(spark):
    """The first rows by virtual finish time, one by one; clashing columns come through."""
    rng = random.Random(6)
    rows = [(i if i % 9 else None, " ".join(f"t{i}" for _ in range(rng.randrange(0, 30))), rng.choice(["a", "b", "c", "d", None]), i, i, i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, text_hash int, same int, _epochs int")
    want = {i: n for i, n in enumerate(brute_mix([r[:3] for r in rows])) if n}
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        assert (r.doc_id, r.text, r.source, r.text_hash, r.same, r._epochs) == rows[r.same]
        got[r.same] = got.get(r.same, 0) + 1
    assert got == want


# ---------------------------------------------------------------- substrings


def test_dedup_words(spark, odd, nothing):
    unique = odd.dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text) for r in unique.collect())
    units = [split(t) for _, t in rows]
    got = {r.doc_id: r for r in substring.dedup_words(unique).collect()}
    for (doc, _), u, hit in zip(rows, units, brute_removed(units, 20)):
        r = got[doc]
        assert (r.n_words, r.n_removed, r.kept) == (len(u), int(hit.sum()), b" ".join(w for w, h in zip(u, hit) if not h).decode())
    assert substring.dedup_words(odd).count() == odd.count() and substring.dedup_words(nothing).count() == 0


@pytest.mark.parametrize("crowded", [20000, 2])
def test_dedup_bytes(spark, odd, nothing, crowded):
    unique = odd.dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in unique.collect())
    got = {r.doc_id: r for r in suffix.dedup_bytes(unique, crowded=crowded).collect()}
    for (doc, u), hit in zip(rows, brute_removed([u for _, u in rows], 100)):
        r = got[doc]
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(u), int(hit.sum()), spans)
        assert bytes(r.kept) == np.frombuffer(u, np.uint8)[~hit].tobytes()
    assert suffix.dedup_bytes(odd).count() == odd.count() and suffix.dedup_bytes(nothing).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n, k = int(rng.integers(1, 150)), int(rng.integers(1, 5))
        t = bytes(rng.integers(97, 97 + k, n).astype(np.uint8)) * int(rng.integers(1, 4))
        cap = int(rng.choice([5, 12, 100]))
        got = list(InducedSorter(np.frombuffer(t, np.uint8), cap, int(rng.choice([50, 1 << 20])), int(rng.choice([3, 1000]))).order())
        pos, lcp = (np.concatenate(x).tolist() for x in zip(*got))
        assert sorted(pos) == list(range(len(t)))
        for i in range(1, len(pos)):
            a, b = t[pos[i - 1] :][:cap], t[pos[i] :][:cap]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert b <= a and lcp[i] == same


def test_sketch_never_underestimates():
    rng = np.random.default_rng(2)
    cells = np.unique(rng.integers(0, 1 << 20, 5000))
    assert (countmin.decode_gaps(countmin.encode_gaps(cells)) == cells).all()
    assert ranges(np.array([5, 9, 2]), np.array([2, 0, 3])).tolist() == [5, 6, 2, 3, 4]
    x = rng.integers(0, 1000, 200)
    assert sliding_min(x, 53).tolist() == [min(x[i : i + 53]) for i in range(148)]


# ---------------------------------------------------------------- packing


def test_packing(spark, odd, nothing):
    got = packing.pack(odd, capacity=256, per_source=2, shard_docs=16).collect()
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r["size"]
    want = {}
    for r in odd.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(split(r.text))
    assert size == want and packing.pack(nothing).count() == 0
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: (r.bin_offset, r["size"])):
            assert r.bin_offset == at
            at += r["size"]
        assert at <= 256 and len({r.cluster for r in rows}) == len(rows)
        for s in {r.source for r in rows}:
            assert sum(r.source == s for r in rows) <= 2


def plain_best_fit(pieces, capacity, per_source):
    """(bin, offset) of pieces (size, source, cluster) in order: of all bins that may take one, the fullest."""
    bins, out = [], []
    for size, source, group in pieces:
        fits = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins)]
        fits = [(r, k) for r, k in fits if r >= size and all(x[2] != group for x in bins[k]) and sum(x[1] == source for x in bins[k]) < per_source]
        k = min(fits, default=(0, len(bins)))[1]
        if k == len(bins):
            bins.append([])
        out.append((k, sum(x[0] for x in bins[k])))
        bins[k].append((size, source, group))
    return out


def test_packing_is_best_fit(spark, odd):
    """Each shard's bins are those of plain best fit; null and repeated ids are spread over shards."""
    rng = random.Random(7)
    rows = [(None if i % 3 else i // 2, f"t{rng.randrange(40)} " * rng.randrange(0, 70), rng.choice(["a", "b", None])) for i in range(400)] + [(None, "same text", "a")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("shard", F.lit("x")).withColumn("copy", F.lit("y"))
    got = packing.pack(docs, capacity=100, per_source=2, shard_docs=50).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.bin >> 32, []).append(r)
    assert sum(r["size"] for r in got) == sum(len(split(t)) for _, t, _ in rows) and len(shards) == 14
    assert max(len(x) for x in shards.values()) < 120
    null_first = lambda x: (x is not None, x if x is not None else 0)
    for own in shards.values():
        own.sort(key=lambda r: (-r["size"], null_first(r.doc_id), r.cluster, null_first(r.source), r.bin, r.bin_offset))
        want = plain_best_fit([(r["size"], r.source, r.cluster) for r in own], 100, 2)
        assert sorted(want) == sorted((r.bin & 0xFFFFFFFF, r.bin_offset) for r in own)
    again = packing.pack(docs.repartition(7), capacity=100, per_source=2, shard_docs=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_best_fit_takes_the_tightest():
    b = packing.Bins(100, 1)
    assert [b.place(60, "a", 1), b.place(50, "b", 2), b.place(40, "c", 3)] == [(0, 0), (1, 0), (0, 60)]
    assert b.place(50, "b", 4) == (2, 0)  # the bin with room has this source
    assert b.place(50, "c", 5) == (1, 50) and b.place(10, "d", 4) == (3, 0)  # that cluster is in bin 2
