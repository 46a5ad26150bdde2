"""The store: recovery, safe publishing and collecting, maintenance; joins and places without a single task."""

import random

import pytest
from pyspark.sql import functions as F

from runweave.operators import bloom, policy, resolve, runs, telemetry
from runweave.operators.order import in_ranges, ranked
from runweave.plans import maintenance, reports
from runweave.sources import external
from runweave.sources import runs as store
from runweave.streaming import latest

LOG = "key bigint, seq bigint, op string, value string"


def log_of(spark, n=400):
    return spark.createDataFrame([(i % 50, i, "DELETE" if i % 7 == 0 else "PUT", f"v{i}") for i in range(n)], LOG)


def live(d):
    return {r.key: r.value for r in d.collect()}


def test_recovery(spark, tmp_path):
    """Whatever of append, flush and truncation was done before a stop, the store opens with the same state."""
    root, log = f"file://{tmp_path}/s", log_of(spark)
    for k in range(4):
        part = log.where(F.col("seq").between(100 * k, 100 * k + 99))
        maintenance.append(part, root)
        maintenance.append(part, root)  # delivered again
        if k in (0, 2):
            assert maintenance.flush(spark, root)["num_entries"] == 50
        assert live(maintenance.state(spark, root)) == live(resolve.live(log.where(F.col("seq") < 100 * k + 100)))
    assert store.flushed_seq(spark, root) == 299 and maintenance._slices(spark, root) == [(300, 399)]
    maintenance.append(log.where("seq < 100"), root)  # a slice that was flushed and not yet deleted
    assert live(maintenance.state(spark, root)) == live(resolve.live(log))
    assert maintenance.truncate(spark, root) == 1 and maintenance.flush(spark, root) is not None and maintenance.flush(spark, root) is None


def test_another_spelling_of_the_root(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    maintenance.flush_log(log_of(spark), root, 0)
    for spelt in (f"{tmp_path}/s", f"file://{tmp_path}/s/", f"file:{tmp_path}/./s"):
        assert store.collect_garbage(spark, spelt) == 0
        assert live(resolve.live(store.read_runs(spark, spelt))) == live(resolve.live(log_of(spark)))


def test_unpublished_runs_stay(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    maintenance.flush_log(log_of(spark), root, 3)
    store.write_run(log_of(spark, 10), root, 0, 4)
    store.write_run(log_of(spark, 10), root, 0, 1)
    assert store.collect_garbage(spark, root) == 1
    assert store._names(spark, f"{root}/runs/level=0") and store.read_paths(spark, root, ["runs/level=0/run_id=4"]).count() == 10


def test_a_lost_race_fails(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    maintenance.flush_log(log_of(spark), root, 0)
    m = store.manifest(spark, root)
    store.publish(spark, root, m, after=0)
    with pytest.raises(RuntimeError):
        store.publish(spark, root, m, after=0)
    assert store.versions(spark, root) == [0, 1]


def test_rounds(spark, tmp_path):
    root, log = f"file://{tmp_path}/s", log_of(spark)
    for k in range(4):
        maintenance.append(log.where(F.col("seq").between(100 * k, 100 * k + 99)), root)
        maintenance.flush(spark, root)
    m = maintenance.Maintenance(spark, root, maintenance.Config(memtable_keys=10, hysteresis=1, velocity_threshold=100.0))
    m.flushed(10_000, 1.0)
    first = m.round(skew=0.9)
    assert (first["strategy"], first["reason"], first["transition"]) == ("TIERING", "velocity+saturation", True) and m.switches == 1
    assert m.round(skew=0.9)["reason"] == "cooldown=1"
    filters = first["filters"].collect()
    assert filters and {r.k for r in filters} == {10} and bloom.wrong_hash_counts(first["filters"], 14).count() == 0
    assert live(maintenance.state(spark, root)) == live(resolve.live(log))
    work = maintenance.Background(lambda: m.round(skew=0.9))
    work.request()
    work.stop()
    assert maintenance.compact_range(spark, root, 5, 0, 10) is None
    level = store.manifest(spark, root).agg(F.max("level")).first()[0]
    assert maintenance.compact_range(spark, root, level, 0, 10) is not None
    assert live(maintenance.state(spark, root)) == live(resolve.live(log))


def test_ranks_and_ranges(spark):
    rng = random.Random(3)
    values = [rng.randrange(-(10**12), 10**12) for _ in range(900)] + [7] * 50 + list(range(100))
    got = ranked(spark.createDataFrame([(v,) for v in values], "v bigint").repartition(5), "v", "at", rows_in_range=16).collect()
    assert [r.v for r in sorted(got, key=lambda r: r["at"])] == sorted(values) and sorted(r["at"] for r in got) == list(range(len(values)))
    spans = [(i, a, a + rng.choice([-1, 0, 5, 1000, 10**6, 10**11])) for i, a in enumerate(rng.sample(values, 60))]
    ranges = spark.createDataFrame(spans, "id bigint, a bigint, b bigint")
    hit = in_ranges(spark.createDataFrame([(v,) for v in values], "v bigint"), ranges, "v", "a", "b", buckets=64)
    want = sorted((v, i) for v in values for i, a, b in spans if a <= v <= b)
    assert sorted((r.v, r.id) for r in hit.collect()) == want
    assert "Cartesian" not in hit._jdf.queryExecution().toString() and "NestedLoop" not in hit._jdf.queryExecution().toString()


def test_filter_plans_stay_small(spark):
    """No hash is worked out in a filter on the scan."""
    keys = spark.range(100).select((F.col("id") % 9).alias("key")).distinct()
    plan = bloom.build(keys, 5, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "shift" in line for line in plan.splitlines())


def test_exact_percentiles_by_sort(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randrange(40)) if k else rng.random()) for k in (0, 1, None) for _ in range(700)] + [(9, 1.0)]
    got = telemetry.exact_percentiles(spark.createDataFrame(rows, "k int, v double"), "v", [0.0, 50.0, 99.0, 100.0], "k").collect()
    assert len(got) == 16
    for r in got:
        own = sorted(v for k, v in rows if k == r.k)
        assert r.value == own[min(int(r.percent / 100 * len(own)), len(own) - 1)]


def test_policy_fold_by_hand(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.random(), rng.random(), rng.random() < 0.7) for s in ("a", "b", None) for i in range(200)]
    d = spark.createDataFrame(rows, "stream string, i bigint, velocity double, skew double, any_full boolean").withColumn("tau", F.lit(0.5)).withColumn("skew_limit", F.lit(0.5)).withColumn("hysteresis", F.lit(2))
    got = {(r.stream, r.i): (r.prev_strategy, r.new_strategy) for r in policy.trace(d.repartition(7), "stream").collect()}
    for s in ("a", "b", None):
        state, cooldown = "HYBRID", 0
        for _, i, v, k, full in [r for r in rows if r[0] == s]:
            new, cooldown, _, _ = policy.step(state, cooldown, v > 0.5, k > 0.5, full, 2)
            assert got[(s, i)] == (state, new)
            state = new


def test_streaming_compaction(spark, tmp_path):
    src, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    log_of(spark).repartition(4).write.parquet(src)
    latest.start(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src), root).awaitTermination()
    want = live(resolve.live(log_of(spark)))
    latest.compaction(spark, root, 2)
    assert live(latest.state(spark, root)) == want
    latest.compaction(spark, root, 3)
    assert live(latest.state(spark, root)) == want and latest._runs(spark, root).select("batch").distinct().count() == 1


def test_external_store_and_reports(spark, tmp_path):
    with pytest.raises(RuntimeError):
        external.ExternalStore()
    folder = str(tmp_path)

    def connect():
        import json
        import os

        class Files:
            def insert(self, key, value):
                with open(f"{folder}/{key}", "w") as f:
                    json.dump(value, f)

            def search(self, key):
                return json.load(open(f"{folder}/{key}")) if os.path.exists(f"{folder}/{key}") else None

            def delete(self, key):
                if os.path.exists(f"{folder}/{key}"):
                    os.remove(f"{folder}/{key}")

            def scan(self, start, end):
                return ((k, self.search(k)) for k in range(start, end + 1) if self.search(k) is not None)

            def close(self):
                pass

        return Files()

    other, want = external.ExternalStore(connect), live(resolve.live(log_of(spark)))
    assert other.apply(log_of(spark)) == 400
    assert live(other.search(spark.range(60).toDF("key"))) == want and dict(other.scan(10, 20)) == {k: v for k, v in want.items() if 10 <= k <= 20}
    text = reports.markdown(spark.createDataFrame([(1, 2.5, None, True)], "a int, b double, c string, d boolean"), "Main")
    assert text.splitlines()[-1] == "| 1 | 2.50 | N/A | **Yes** |"


def test_lookup_stops_at_tombstones(spark):
    rows = [(0, 5, 1, "PUT", "a", 9), (0, 4, 1, "DELETE", None, 8), (1, 3, 1, "PUT", "b", 3), (0, 5, 9, "PUT", "z", 7), (1, 3, 2, "DELETE", None, 2), (1, 3, 9, "PUT", "y", 1)]
    d = spark.createDataFrame(rows, "level int, run_id bigint, key bigint, op string, value string, seq bigint")
    got = {r.key: r for r in runs.probe_path(d, runs.metadata(d, "level", "run_id"), spark.createDataFrame([(1,), (2,), (40,)], "key bigint")).collect()}
    assert (got[1].found_level, got[1].found_run, got[1].op, got[1].level_probes, got[1].run_probes) == (0, 5, "PUT", 1, 1)
    assert (got[2].found_level, got[2].op, got[2].level_probes) == (1, "DELETE", 2) and got[40].found_run is None and got[40].run_probes == 0
