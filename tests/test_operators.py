"""Properties, golden values and the reference's scenarios."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runweave.functions import hashing, scalar
from runweave.operators import bloom, policy, resolve, runs, stats, telemetry, workload
from runweave.plans import maintenance
from runweave.sources import files, oplog
from runweave.sources import runs as store

LOG = "key bigint, seq bigint, op string, value string"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["PUT", "PUT", "DELETE"]), st.text("abc", max_size=3)), max_size=60))
def test_resolution_is_a_dict(spark, ops):
    d = {}
    for key, op, value in ops:
        if op == "PUT":
            d[key] = value
        else:
            d.pop(key, None)
    log = spark.createDataFrame([(k, i, op, v if op == "PUT" else None) for i, (k, op, v) in enumerate(ops)], LOG)
    assert {r.key: r.value for r in resolve.live(log).collect()} == d
    assert [(r.key, r.value) for r in resolve.scan(log, 3, 9).collect()] == sorted((k, v) for k, v in d.items() if 3 <= k <= 9)
    flushed = runs.flush(log, 7).withColumn("level", (F.col("run_id") % 3).cast("int"))
    for compacted in (runs.merge(flushed), runs.compact_level(flushed, 0), runs.compact_tier(flushed, 1, 1)):
        assert {r.key: r.value for r in resolve.live(compacted).collect()} == d
    meta = runs.metadata(flushed, "level", "run_id")
    assert {r.key: r.value for r in resolve.live(runs.compact_range(flushed, meta, 0, 2, 5)).collect()} == d
    assert {r.key for r in runs.merge(flushed, bottom=True).collect()} == set(d)


def test_empty_value_is_a_value_and_absent_delete_is_kept(spark):
    log = spark.createDataFrame([(1, 1, "PUT", ""), (2, 2, "DELETE", None)], LOG)
    assert [(r.key, r.value) for r in resolve.live(log).collect()] == [(1, "")]
    assert [r.key for r in resolve.deleted(log).collect()] == [2]


def test_ordered_memtable(spark):
    puts = [(k, k, "PUT", f"v{k}") for k in range(1, 2001)]
    log = spark.createDataFrame(puts + [(k, 3000 + k, "DELETE", None) for k in range(1, 101)], LOG)
    assert resolve.live(log).count() == 1900
    assert resolve.get(log, 50).count() == 0
    assert [r.key for r in resolve.scan(log, 500, 600).collect()] == list(range(500, 601))
    many = {r.key: r.found for r in resolve.get_many(log, spark.createDataFrame([(50,), (500,), (9999,)], "key bigint")).collect()}
    assert many == {50: False, 500: True, 9999: False}


def test_key_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(k, k, "PUT", "v") for k in range(100)], LOG).write.parquet(path)
    plan = resolve.scan(spark.read.parquet(path), 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,10)" in plan and "LessThanOrEqual(key,20)" in plan


def test_hash_golden(spark):
    d = hashing.with_hash64(spark.createDataFrame([(1,), (42,), (123456789,)], "key bigint"), "key", "h")
    got = {r.key: r.t for r in d.withColumn("t", hashing.unsigned_text(F.col("h"))).collect()}
    assert got == {1: "6238072747940578789", 42: "12058926934050108962", 123456789: "17445968401720671584"}
    random.seed(3)
    keys = [random.randrange(-(2**63), 2**63) for _ in range(300)]
    d = hashing.with_hash64(spark.createDataFrame([(k,) for k in keys], "key bigint"), "key", "h", hashing.SALT_STEP)
    d = d.withColumn("m", hashing.unsigned_mod(F.col("h"), 12345))

    def model(x):
        x = (x ^ hashing.SALT_STEP) % 2**64
        x ^= x >> 30
        x = x * hashing.MULTIPLY_1 % 2**64
        x ^= x >> 27
        x = x * hashing.MULTIPLY_2 % 2**64
        return x ^ x >> 31

    for r in d.collect():
        assert r.h % 2**64 == model(r.key % 2**64) and r.m == model(r.key % 2**64) % 12345


def test_filter_rates(spark):
    members = spark.range(1, 10001).withColumnRenamed("id", "key")
    others = spark.range(10001, 60001).withColumnRenamed("id", "key")
    blocks = bloom.blocks_for(150000)
    f = bloom.build(members, blocks, 8)
    assert bloom.test(f, members, blocks, 8).where("not maybe").count() == 0
    assert bloom.test(f, others, blocks, 8).where("maybe").count() < 0.05 * 50000


@pytest.mark.parametrize(("counts", "budget"), [
    ([1000, 5000, 25000, 125000, 625000, 3125000, 0], 2147483648), ([100, 200, 300], 2560), ([50000], 83886080),
    ([0, 0, 5000, 0, 0], 2147483648), ([1000, 2000, 3000], 1536), ([500 * 2**i for i in range(12)] + [0, 0, 0], 2147483648),
])
def test_allocation_keeps_its_budget(spark, counts, budget):
    d = spark.createDataFrame(list(enumerate(counts)), "level int, entries bigint")
    got = bloom.allocate(d, budget).collect()
    assert sum(r.bits for r in got) <= budget and all(r.bits >= 512 and r.bits % 512 == 0 for r in got)
    if sum(counts) and len([c for c in counts if c]) == len(counts):
        assert budget - sum(r.bits for r in got) < 512


def test_allocation_rejects_too_little(spark):
    d = spark.createDataFrame([(0, 100), (1, 200), (2, 300)], "level int, entries bigint")
    with pytest.raises(Exception, match="below one block"):
        bloom.allocate(d, 1024).collect()


def test_bloom_k(spark):
    assert {r.b: r.k for r in spark.createDataFrame([(0,), (10,), (14,), (100,)], "b int").select("b", scalar.bloom_k(F.col("b")).alias("k")).collect()} == {0: 1, 10: 7, 14: 10, 100: 20}


@pytest.mark.parametrize(("signals", "h", "want"), [
    ([(2000, 0.1, True)], 2, [("TIERING", "velocity+saturation")]),
    ([(2000, 0.1, True)] + [(0, 0.8, False)] * 3, 2, [("TIERING", "velocity+saturation"), ("TIERING", "cooldown=2"), ("TIERING", "cooldown=1"), ("LEVELING", "high_skew")]),
    ([(1000, 0.5, True)], 2, [("HYBRID", "default")]),
    ([(2000, 0.9, False)], 0, [("LEVELING", "high_skew")]),
    ([(0, 0.9, True), (0, 0.1, True)], 0, [("LEVELING", "high_skew"), ("HYBRID", "default")]),
    ([(0, 0.1, False), (0, 0.6, False), (5000, 0.9, True)], 1, [("HYBRID", "default"), ("LEVELING", "high_skew"), ("LEVELING", "cooldown=1")]),
])
def test_policy_scenarios(spark, signals, h, want):
    d = spark.createDataFrame([("s", i, float(v), s, f, 1000.0, 0.5, h) for i, (v, s, f) in enumerate(signals)], "stream string, i bigint, velocity double, skew double, any_full boolean, tau double, skew_limit double, hysteresis int")
    assert [(r.new_strategy, r.reason) for r in policy.trace(d, "stream").orderBy("i").collect()] == want


def test_gini(spark):
    g = lambda xs: telemetry.gini(spark.createDataFrame([(x,) for x in xs], "n bigint")).first()[0]
    assert g([5, 5, 5]) == 0 and g([100]) == 0 and g([]) == 0
    xs = sorted([1] * 90 + [50] * 10)
    want = sum((2 * i - len(xs) - 1) * x for i, x in enumerate(xs, 1)) / (len(xs) * sum(xs))
    assert abs(g(xs) - want) < 1e-12


@pytest.mark.parametrize("mix", workload.MIXES, ids=lambda m: m[0])
def test_mixes(spark, mix):
    name, _, read, update, insert, scan, delete = mix
    got = {r.op: r.n / 20000 for r in workload.generate(spark, name, 20000).groupBy("op").agg(F.count("*").alias("n")).collect()}
    want = {"READ": read, "UPDATE": update, "INSERT": insert, "SCAN": scan, "DELETE": delete, "RMW": 1 - read - update - insert - scan - delete}
    for op, share in want.items():
        assert abs(got.get(op, 0) - share) < 0.015
    assert all(v > 1e-9 for v in got.values())


def test_statistics(spark):
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in [(3, 1), (5, 2), (9, 4), (4, 4)]], "g string, a double, b double")
    r = stats.paired_p(rows, "g").first()
    assert abs(r.mean_diff - 2.5) < 1e-12 and abs(r.t - 2.5 / (math.sqrt(13 / 3) / 2)) < 1e-9
    assert abs(r.p - scalar.t_two_tailed(r.t, 3)) < 1e-12
    assert abs(scalar.t_two_tailed(2.776, 4) - 0.05) < 1e-3 and abs(scalar.t_two_tailed(12.706, 1) - 0.05) < 1e-3
    flat = spark.createDataFrame([("g", 2.0, 1.0), ("g", 3.0, 2.0)], "g string, a double, b double")
    assert stats.paired_p(flat, "g").first().p == 0.0001
    x = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (2, 2.0), (2, 3.0), (2, 5.0)], "side int, v double")
    r = stats.rank_sum_p(x, "v", "side").first()
    assert r.u == 1.0 and 0.0001 <= r.p <= 1
    a = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, value double")
    with pytest.raises(Exception, match="pairing"):
        stats.pair(a, a, "k").collect()


def test_store_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    log = spark.createDataFrame([(i % 50, i, "DELETE" if i % 7 == 0 else "PUT", f"v{i}") for i in range(400)], LOG)
    want = {r.key: r.value for r in resolve.live(log).collect()}
    for k in range(8):
        maintenance.flush_log(log.where(F.col("seq").between(50 * k, 50 * k + 49)), root, k)
    config = maintenance.Config(memtable_keys=10, levels=3)
    for _ in range(3):
        assert {r.key: r.value for r in resolve.live(store.read_runs(spark, root)).collect()} == want
        maintenance.round_once(spark, root, "LEVELING", config)
    assert {r.key: r.value for r in resolve.live(store.read_runs(spark, root)).collect()} == want
    part = resolve.live(store.read_runs(spark, root, start=10, end=20))
    assert {r.key: r.value for r in part.collect()} == {k: v for k, v in want.items() if 10 <= k <= 20}
    assert store.collect_garbage(spark, root) > 0
    assert {r.key: r.value for r in resolve.live(store.read_runs(spark, root)).collect()} == want


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\nnum_ops = 100 # inline\nname = A=B\n\n")
    got = {r.name: r.value for r in files.read_settings(spark, str(tmp_path / "a.txt")).collect()}
    assert got == {"num_ops": "100", "name": "A=B"}
    (tmp_path / "r.csv").write_text("scale,run_id,workload,throughput_kops,p50_us,p99_us,elapsed_s,ok\n100,1,A,1.5,1,2,3,1\nbad,row\n")
    assert files.read_results(spark, str(tmp_path / "r.csv"), files.EXTERNAL).count() == 1
    assert "spark" in files.markdown(files.run_info(spark))


def test_commits(spark):
    log = spark.createDataFrame([(1, i, "PUT", "abc") for i in range(130)], LOG)
    assert [(r.batch, r.records, r.bytes) for r in oplog.group_commits(log).orderBy("batch").collect()] == [(0, 64, 1024), (1, 64, 1024), (2, 2, 32)]


@pytest.mark.parametrize("n", [1500, 0xDCDFEFF4, 0x7F80C2BF])
def test_packed_filters_keep_bytes_like_utf8(spark, n):
    """Numbers and words whose bytes look like characters of two to four bytes."""
    words = [[0x05DC, 0xC3A9, 0xE282AC, 0xF09F9880, 0xA9C3, 0xAC82E2, 0x80989FF0, 2**64 - 2], [0] * 7 + [1 << 63]]
    have = [(block, [64 * i + b for i, w in enumerate(row) for b in range(64) if w >> b & 1]) for block, row in enumerate(words)]
    packed = bloom.pack(spark.createDataFrame(have, "block bigint, have array<bigint>"), 10, n, 2)
    assert bytes(packed.first()[0]) == b"".join(x.to_bytes(4, "little") for x in (10, n, 2)) + b"".join(w.to_bytes(8, "little") for row in words for w in row)
    r = bloom.unpack(packed).first()
    assert (r.k, r.n, r.blocks) == (10, n, 2)
    assert [w % 2**64 for w in r.words] == [w for row in words for w in row]


def test_exact_percentiles_do_not_depend_on_estimates(spark, monkeypatch):
    """Quantiles that come out otherwise each time, as those of many values do; nulls and NaN are at the end."""
    noise = F.udf(lambda cuts: cuts and [x + random.SystemRandom().uniform(-300, 300) for x in cuts], "array<double>")
    estimate = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: noise(estimate(*a)))
    d = spark.range(0, 30_000, 1, 4).select((F.col("id") % 3).alias("k"), F.expr("CAST(xxhash64(id) % 1000000007 AS DOUBLE) / 1000").alias("v"))
    odd = [(k, v) for k in (2, 7) for v in [None] * 200 + [math.nan] * 150 + [1.0] * (k - 2)]
    d = d.unionByName(spark.createDataFrame([*odd, (8, None), (None, 2.0)], "k bigint, v double"))
    own = {}
    for r in d.collect():
        own.setdefault(r.k, []).append(r.v)
    for v in own.values():
        v.sort(key=lambda x: (x is None, x is not None and math.isnan(x), x if x is not None and x == x else 0.0))
    percents = [0.0, 3.0, 25.0, 50.0, 75.0, 97.5, 99.0, 99.999, 100.0]
    want = {(k, p): str(v[min(int(p / 100 * len(v)), len(v) - 1)]) for k, v in own.items() for p in percents}
    got = telemetry.exact_percentiles(d, "v", percents, "k").collect()
    assert len(got) == len(want) and {(r.k, r.percent): str(r.value) for r in got} == want
    every = telemetry.exact_percentiles(d.where("k < 2"), "v", [50.0]).collect()
    assert [r.value for r in every] == [sorted(own[0] + own[1])[10_000]]


def test_rank_sums_of_millions(spark):
    """n1 * n2 * (n1 + n2 + 1) beyond 64 bits."""
    d = spark.range(0, 4_200_000, 1, 4).select((F.col("id") % 50 + F.when(F.col("id") % 1000 == 0, 1).otherwise(0)).alias("v"), (F.pmod(F.xxhash64("id"), F.lit(2)) + 1).alias("side"))
    counts = sorted((r.v, r.c1, r.c2) for r in d.groupBy("v").agg(F.count_if(F.col("side") == 1).alias("c1"), F.count_if(F.col("side") == 2).alias("c2")).collect())
    n1, n2 = sum(r[1] for r in counts), sum(r[2] for r in counts)
    assert n1 * n2 * (n1 + n2 + 1) > 2**63
    below, twice_r1 = 0, 0
    for _, c1, c2 in counts:
        twice_r1 += c1 * (2 * below + c1 + c2 + 1)
        below += c1 + c2
    twice_u = min(twice_r1 - n1 * (n1 + 1), 2 * n1 * n2 - twice_r1 + n1 * (n1 + 1))
    z = (twice_u - n1 * n2) / 2 / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    r = stats.rank_sum_p(d, "v", "side").first()
    assert (r.n1, r.n2, r.u) == (n1, n2, twice_u / 2)
    assert abs(r.z - z) < 1e-9 and abs(r.p - max(0.0001, math.erfc(-z / math.sqrt(2)))) < 1e-9 and 0.0001 < r.p < 1
