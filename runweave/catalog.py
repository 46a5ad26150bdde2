"""The registered queries of the engine, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runweave.functions import hashing, scalar
from runweave.operators import bloom, policy, resolve, runs, stats, telemetry, workload
from runweave.plans import maintenance, reports
from runweave.session import ship_code
from runweave.sources import files, oplog
from runweave.sources import runs as store
from runweave.streaming import latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of the event log in one flushed run.
RUN = 1000


#: SQL that needs text defined further down; filled in at the end.
_LATER: dict[str, Callable[[], str]] = {}


def query(sql: str | Callable[[], str] | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if callable(sql):
            _LATER[f.__name__] = sql
        elif sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.from_events(_t(spark, sf_dir, "events"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flushed runs of the event log; every third run is of level 0, the next of level 1, then 2."""
    r = runs.flush(_log(spark, sf_dir), RUN)
    return r.withColumn("level", (F.col("run_id") % 3).cast("int"))


LOG = "log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, event_type AS value FROM events)"
LAST = f"WITH {LOG}, last AS (SELECT key, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"
FLUSHED = f"""WITH {LOG}, runs AS (SELECT run_id, key, op, value, seq, CAST(run_id % 3 AS INTEGER) AS level FROM (
    SELECT seq // {RUN} AS run_id, key, op, value, seq, row_number() OVER (PARTITION BY seq // {RUN}, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"""
META = f"""{FLUSHED}, meta AS (SELECT run_id, min(level) AS level, min(key) AS min_key, max(key) AS max_key, count(*) AS num_entries,
    count(*) FILTER (WHERE op = 'DELETE') AS tombstones FROM runs GROUP BY run_id)"""


def _newest(rows: str) -> str:
    return f"SELECT key, op, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {rows}) WHERE rn = 1"


# --------------------------------------------------------------------------- reads


@query(f"{LAST} SELECT key, value FROM last WHERE op = 'PUT'")
def latest_live(spark, sf_dir):
    return resolve.live(_log(spark, sf_dir))


@query(f"{LAST} SELECT key, value FROM last WHERE op = 'PUT' AND key = 42")
def point_get(spark, sf_dir):
    return resolve.get(_log(spark, sf_dir), 42)


@query(f"{LAST} SELECT k.key, l.value, l.key IS NOT NULL AS found FROM (SELECT range * 7 AS key FROM range(0, 100)) k LEFT JOIN (SELECT * FROM last WHERE op = 'PUT') l ON k.key = l.key")
def multi_get(spark, sf_dir):
    return resolve.get_many(_log(spark, sf_dir), spark.range(0, 100).select((F.col("id") * 7).alias("key")))


@query(f"{LAST} SELECT k.range * 7 AS key FROM range(0, 100) k WHERE k.range * 7 NOT IN (SELECT key FROM last WHERE op = 'PUT')")
def missing_keys(spark, sf_dir):
    return resolve.missing(_log(spark, sf_dir), spark.range(0, 100).select((F.col("id") * 7).alias("key")))


@query(f"{LAST} SELECT key, value FROM last WHERE op = 'PUT' AND key BETWEEN 20 AND 80")
def range_scan(spark, sf_dir):
    return resolve.scan(_log(spark, sf_dir), 20, 80)


@query(f"{LAST} SELECT s.range AS scan_id, l.key, l.value FROM range(0, 20) s JOIN last l ON l.op = 'PUT' AND l.key BETWEEN s.range * 5 AND s.range * 5 + 10")
def multi_scan(spark, sf_dir):
    ranges = spark.range(0, 20).select(F.col("id").alias("scan_id"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 10).alias("end"))
    return resolve.scan_many(_log(spark, sf_dir), ranges)


@query(f"{LAST} SELECT key FROM last WHERE op = 'DELETE'")
def tombstones(spark, sf_dir):
    return resolve.deleted(_log(spark, sf_dir))


@query("SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY o_custkey")
def order_latest(spark, sf_dir):
    return resolve.live(oplog.from_orders(_t(spark, sf_dir, "orders")))


@query("SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders WHERE o_custkey BETWEEN 100 AND 600 GROUP BY o_custkey")
def order_scan(spark, sf_dir):
    return resolve.scan(oplog.from_orders(_t(spark, sf_dir, "orders")), 100, 600)


@query("""SELECT key, value FROM (SELECT l_orderkey AS key, l_returnflag AS value, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def line_latest(spark, sf_dir):
    return resolve.live(oplog.from_lineitem(_t(spark, sf_dir, "lineitem")))


@query(f"""WITH {LOG}, b AS (SELECT key, max(seq) AS base FROM log WHERE value <> 'click' GROUP BY key),
    n AS (SELECT b.key, b.base, count(l.seq) AS n FROM b LEFT JOIN log l ON l.key = b.key AND l.value = 'click' AND l.seq > b.base GROUP BY b.key, b.base)
    SELECT n.key, l.value || repeat('_u', CAST(n.n AS INTEGER)) AS value FROM n JOIN log l ON l.key = n.key AND l.seq = n.base WHERE l.op = 'PUT'""")
def rmw_fold(spark, sf_dir):
    return resolve.fold_rmw(_log(spark, sf_dir), F.col("value") == "click")


@query("SELECT count(DISTINCT user_id) AS unique_keys, count(DISTINCT user_id) >= 100 AS is_full FROM events")
def memtable_full(spark, sf_dir):
    return resolve.memtable_full(_log(spark, sf_dir), 100)


# --------------------------------------------------------------------------- runs


@query(f"{FLUSHED} SELECT run_id, key, op, value, seq FROM runs")
def flush_runs(spark, sf_dir):
    return runs.flush(_log(spark, sf_dir), RUN)


@query(f"{META} SELECT run_id, min_key, max_key, num_entries, tombstones FROM meta")
def run_metadata(spark, sf_dir):
    return runs.metadata(runs.flush(_log(spark, sf_dir), RUN))


@query(f"{META} SELECT k.key, m.run_id FROM (SELECT range * 3 AS key FROM range(0, 80)) k JOIN meta m ON k.key BETWEEN m.min_key AND m.max_key")
def zone_probe(spark, sf_dir):
    meta = runs.metadata(_runs(spark, sf_dir))
    return runs.zone_probe(meta, spark.range(0, 80).select((F.col("id") * 3).alias("key")))


@query(f"{META} SELECT run_id, min_key, max_key FROM meta WHERE max_key >= 10 AND min_key <= 50")
def zone_overlap(spark, sf_dir):
    return runs.overlapping(runs.metadata(_runs(spark, sf_dir)), 10, 50).select("run_id", "min_key", "max_key")


def _lookup(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return runs.probe_path(r, runs.metadata(r, "level", "run_id"), spark.range(0, 80).select((F.col("id") * 3).alias("key")))


@query(lambda: f"{LOOKUP} SELECT * FROM looked")
def probe_path(spark, sf_dir):
    return _lookup(spark, sf_dir)


@query(f"""{FLUSHED} SELECT level, run_id, key, op, value, seq FROM runs WHERE level = 2 UNION ALL
    SELECT 1, (SELECT max(run_id) FROM runs WHERE level <= 1), * FROM ({_newest('(SELECT * FROM runs WHERE level <= 1)')})""")
def merge_level(spark, sf_dir):
    return runs.compact_level(_runs(spark, sf_dir), 0)


@query(f"""{FLUSHED} SELECT level, run_id, key, op, value, seq FROM runs WHERE level <> 0 UNION ALL
    SELECT 1, (SELECT max(run_id) FROM runs WHERE level = 0), * FROM ({_newest('(SELECT * FROM runs WHERE level = 0)')})""")
def merge_tier(spark, sf_dir):
    return runs.compact_tier(_runs(spark, sf_dir), 0, 1)


@query(f"{FLUSHED} SELECT level, run_id, key, op, value, seq FROM runs")
def merge_tier_declined(spark, sf_dir):
    return runs.compact_tier(_runs(spark, sf_dir), 0, 1_000_000)


@query(f"""{FLUSHED} SELECT level, run_id, key, op, value, seq FROM runs WHERE level = 0 UNION ALL
    SELECT 2, (SELECT max(run_id) FROM runs WHERE level >= 1), * FROM ({_newest('(SELECT * FROM runs WHERE level >= 1)')}) WHERE op <> 'DELETE'""")
def merge_hybrid_last(spark, sf_dir):
    return runs.compact_hybrid(_runs(spark, sf_dir), 1, 2, 2)


@query(f"""{META}, chosen AS (SELECT run_id FROM meta WHERE max_key >= 10 AND min_key <= 50 AND level = 0)
    SELECT level, run_id, key, op, value, seq FROM runs WHERE run_id NOT IN (SELECT run_id FROM chosen) UNION ALL
    SELECT 1, (SELECT max(run_id) FROM chosen), * FROM ({_newest('(SELECT * FROM runs WHERE run_id IN (SELECT run_id FROM chosen))')})""")
def merge_subrange(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return runs.compact_range(r, runs.metadata(r), 0, 10, 50)


@query(f"{FLUSHED} SELECT * FROM ({_newest('runs')}) WHERE op <> 'DELETE'")
def tombstone_gc(spark, sf_dir):
    return runs.merge(_runs(spark, sf_dir), bottom=True)


@query(f"""{META} SELECT level, sum(num_entries)::BIGINT AS entries, count(*) AS runs,
    sum(num_entries) > 100 * (level + 1) * 4 OR count(*) > 4 AS is_full FROM meta GROUP BY level""")
def level_full(spark, sf_dir):
    return runs.level_full(runs.metadata(_runs(spark, sf_dir), "level", "run_id"), 100, "HYBRID")


@query("SELECT * FROM (VALUES ('LEVELING', 2, 3), ('HYBRID', 4, 4), ('TIERING', 8, 8)) v(strategy, max_runs, multiplier)")
def level_params(spark, sf_dir):
    return spark.createDataFrame(runs.STRATEGIES, "strategy string, max_runs int, multiplier int")


@query(f"{META} SELECT sum(num_entries)::BIGINT AS physical_keys FROM meta")
def physical_keys(spark, sf_dir):
    return runs.physical_keys(runs.metadata(_runs(spark, sf_dir)))


# --------------------------------------------------------------------------- hashes and filters

_TWO64 = "18446744073709551616"


def _h(x: str, salt: int = 0) -> str:
    """DuckDB text of the 64-bit hash of an UBIGINT expression."""
    a = f"xor({x}, {salt}::UBIGINT)" if salt else x
    for shift, c in ((30, hashing.MULTIPLY_1), (27, hashing.MULTIPLY_2)):
        a = f"((xor({a}, {a} >> {shift})::UHUGEINT * {c}::UHUGEINT) % {_TWO64}::UHUGEINT)::UBIGINT"
    return f"xor({a}, {a} >> 31)"


KEYS = "keys AS (SELECT DISTINCT user_id AS key FROM events)"


@query(f"WITH {KEYS} SELECT key, CAST({_h('key::UBIGINT')} AS VARCHAR) AS h, CAST({_h('key::UBIGINT', hashing.SALT_B)} AS VARCHAR) AS hb FROM keys")
def hash_keys(spark, sf_dir):
    d = hashing.with_hash64b(hashing.with_hash64(_log(spark, sf_dir).select("key").distinct(), "key", "h"), "key", "hb")
    return d.select("key", hashing.unsigned_text(F.col("h")).alias("h"), hashing.unsigned_text(F.col("hb")).alias("hb"))


@query(f"""WITH {KEYS} SELECT key, CAST((({_h('key::UBIGINT')})::UHUGEINT + 3::UHUGEINT * ({_h('key::UBIGINT', hashing.SALT_B)})::UHUGEINT) % {_TWO64}::UHUGEINT AS VARCHAR) AS h3 FROM keys""")
def nth_hash(spark, sf_dir):
    d = hashing.with_hash64b(hashing.with_hash64(_log(spark, sf_dir).select("key").distinct(), "key", "h"), "key", "hb")
    return d.select("key", hashing.unsigned_text(hashing.nth_hash(F.col("h"), F.col("hb"), 3)).alias("h3"))


@query(f"WITH {KEYS} SELECT ({_h('key::UBIGINT')} % 32)::BIGINT AS part, count(*) AS keys FROM keys GROUP BY 1")
def hash_partition(spark, sf_dir):
    d = hashing.with_hash64(_log(spark, sf_dir).select("key").distinct(), "key", "h")
    return d.groupBy(hashing.partition_of(F.col("h")).alias("part")).agg(F.count("*").alias("keys"))


def _probe_sql(keys: str, blocks: int, k: int) -> str:
    return f"""SELECT key, ({_h('key::UBIGINT')} % {blocks})::BIGINT AS block, i.range AS i,
        ((({_h('key::UBIGINT', hashing.SALT_B)} % 512)::BIGINT + i.range * (({_h('key::UBIGINT', hashing.SALT_STEP)} | 1) % 512)::BIGINT) % 512)::BIGINT AS bit
        FROM {keys}, range(0, {k}) i"""


def _level_probe_sql(rows: str) -> str:
    """level, key, block, bit for rows with level, key and the level's number of blocks."""
    return f"""SELECT level, key, ({_h('key::UBIGINT')} % blocks::UBIGINT)::BIGINT AS block,
        ((({_h('key::UBIGINT', hashing.SALT_B)} % 512)::BIGINT + i.range * (({_h('key::UBIGINT', hashing.SALT_STEP)} | 1) % 512)::BIGINT) % 512)::BIGINT AS bit
        FROM {rows}, range(0, 10) i"""


LOOKUP = f"""{META}, keys AS (SELECT range * 3 AS key FROM range(0, 80)), lv AS (SELECT level, greatest(1, ceil(count(*) * 14 / 512.0))::BIGINT AS blocks FROM runs GROUP BY level),
    have AS (SELECT DISTINCT level, block, bit FROM ({_level_probe_sql('(SELECT r.level, r.key, lv.blocks FROM runs r JOIN lv ON lv.level = r.level)')})),
    hits AS (SELECT r.*, row_number() OVER (PARTITION BY key ORDER BY level, run_id DESC) AS turn FROM runs r JOIN keys USING (key)),
    found AS (SELECT k.key, h.level AS found_level, h.run_id AS found_run, h.op FROM keys k LEFT JOIN hits h ON h.key = k.key AND h.turn = 1),
    asked AS (SELECT f.*, lv.level, lv.blocks FROM found f, lv WHERE f.found_level IS NULL OR lv.level <= f.found_level),
    tested AS (SELECT p.key, p.level, count(h.bit) = count(*) AS maybe FROM ({_level_probe_sql('asked')}) p LEFT JOIN have h ON h.level = p.level AND h.block = p.block AND h.bit = p.bit GROUP BY p.key, p.level),
    steps AS (SELECT a.key, a.found_level, a.found_run, a.op, a.level, t.maybe, (SELECT count(*) FROM meta m WHERE m.level = a.level AND a.key BETWEEN m.min_key AND m.max_key
        AND (a.found_level IS NULL OR a.level < a.found_level OR m.run_id >= a.found_run)) AS runs FROM asked a JOIN tested t ON t.key = a.key AND t.level = a.level),
    looked AS (SELECT key, any_value(found_level) AS found_level, any_value(found_run) AS found_run, any_value(op) AS op, count(*) AS level_probes,
        coalesce(sum(runs) FILTER (WHERE maybe), 0)::BIGINT AS run_probes, count(*) FILTER (WHERE maybe AND (found_level IS NULL OR level < found_level)) AS false_positives FROM steps GROUP BY key)"""


@query(f"WITH {KEYS} SELECT key, block, bit FROM ({_probe_sql('keys', 5, 10)})")
def bloom_probe(spark, sf_dir):
    return bloom.probe_rows(_log(spark, sf_dir).select("key").distinct(), 5, 10)


_MEMBERS = f"{KEYS}, probes AS (SELECT range AS key FROM range(0, 4000)), have AS (SELECT DISTINCT block, bit FROM ({_probe_sql('keys', 5, 10)}))"
_TESTED = f"tested AS (SELECT p.key, count(h.bit) = count(*) AS maybe FROM ({_probe_sql('probes', 5, 10)}) p LEFT JOIN have h ON h.block = p.block AND h.bit = p.bit GROUP BY p.key)"


@query(f"WITH {_MEMBERS} SELECT block, count(*) AS bits_set FROM have GROUP BY block")
def bloom_build(spark, sf_dir):
    f = bloom.build(_log(spark, sf_dir).select("key").distinct(), 5, 10)
    return bloom.deserialize(bloom.serialize(f)).select("block", F.size("have").cast("bigint").alias("bits_set"))


@query(f"WITH {_MEMBERS}, {_TESTED} SELECT key, maybe FROM tested")
def bloom_test(spark, sf_dir):
    f = bloom.build(_log(spark, sf_dir).select("key").distinct(), 5, 10)
    return bloom.test(f, spark.range(0, 4000).select(F.col("id").alias("key")), 5, 10)


@query(f"""WITH {_MEMBERS}, {_TESTED} SELECT count(*) FILTER (WHERE maybe AND k.key IS NULL) AS false_positives, count(*) FILTER (WHERE NOT maybe AND k.key IS NOT NULL) AS false_negatives,
    round(count(*) FILTER (WHERE maybe AND k.key IS NULL)::DOUBLE / count(*), 6) AS rate FROM tested t LEFT JOIN keys k ON k.key = t.key""")
def bloom_observed_fpr(spark, sf_dir):
    keys = _log(spark, sf_dir).select("key").distinct()
    t = bloom.test(bloom.build(keys, 5, 10), spark.range(0, 4000).select(F.col("id").alias("key")), 5, 10)
    t = t.join(keys.withColumn("member", F.lit(True)), "key", "left")
    fp = F.count_if(F.col("maybe") & F.col("member").isNull())
    return t.agg(
        fp.alias("false_positives"), F.count_if(~F.col("maybe") & F.col("member")).alias("false_negatives"),
        F.round(telemetry.observed_fpr(fp, F.count("*")), 6).alias("rate"),
    )


@query("SELECT range AS bits_per_key, CAST(least(greatest(floor(0.693147 * range + 0.5), 1), 20) AS INTEGER) AS k FROM range(0, 41)")
def bloom_k(spark, sf_dir):
    return spark.range(0, 41).select(F.col("id").alias("bits_per_key"), scalar.bloom_k(F.col("id")).alias("k"))


@query(f"""{META} SELECT run_id, num_entries, round(pow(1 - exp(-10.0::DOUBLE * num_entries / (ceil(num_entries * 14 / 512.0) * 512)), 10), 9) AS fpr FROM meta""")
def bloom_theory(spark, sf_dir):
    m = runs.metadata(_runs(spark, sf_dir))
    bits = F.ceil(F.col("num_entries") * 14 / 512) * 512
    return m.select("run_id", "num_entries", F.round(bloom.false_positive_rate(F.lit(10.0), F.col("num_entries"), bits), 9).alias("fpr"))


def _levels(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("level").agg(F.count("*").alias("entries"))


_LEVELS = f"{FLUSHED}, lv AS (SELECT level, count(*) AS entries FROM runs GROUP BY level)"


def _alloc_sql(weight: str, budget: int) -> str:
    return f"""w AS (SELECT level, entries, {weight} AS w FROM lv), i AS (SELECT *, ({budget} // 512 - count(*) OVER ()) AS rest, ({budget} // 512 - count(*) OVER ()) * (w / sum(w) OVER ()) AS ideal FROM w),
    e AS (SELECT *, floor(ideal)::BIGINT AS extra FROM i), r AS (SELECT *, rest - sum(extra) OVER () AS spare, row_number() OVER (ORDER BY ideal - extra DESC, level) AS turn FROM e)
    SELECT level, entries, (1 + extra + CASE WHEN turn <= spare THEN 1 ELSE 0 END)::BIGINT AS blocks, ((1 + extra + CASE WHEN turn <= spare THEN 1 ELSE 0 END) * 512)::BIGINT AS bits FROM r"""


@query(f"{_LEVELS}, {_alloc_sql('entries::DOUBLE / sum(entries) OVER () * (1 + 0.1::DOUBLE * level)', 100_000)}")
def alloc_weighted(spark, sf_dir):
    return bloom.allocate(_levels(spark, sf_dir), 100_000)


_STRUCTURAL = "(SELECT least(greatest(sum(entries) * 14, count(*) * 512), 2147483648)::BIGINT FROM lv)"
_W = "entries::DOUBLE / sum(entries) OVER () * (1 + 0.1::DOUBLE * level)"
_HEAT = "(1 + 0.1::DOUBLE * ((level + 1) / 6.0::DOUBLE))"
#: The frequency step deals out the bits that the structural one has: whole blocks of its budget.
_AGAIN = f"({_STRUCTURAL} // 512 * 512)"


def _accesses(spark):
    return spark.range(3).select(F.col("id").cast("int").alias("level"), (F.col("id") + 1).alias("n"))


@query(f"SELECT *, 10 AS k FROM ({_LEVELS}, {_alloc_sql(_W, _STRUCTURAL)})")
def alloc_structural(spark, sf_dir):
    return bloom.reallocate_structural(_levels(spark, sf_dir), 14, 256 << 23)


@query(f"SELECT *, 10 AS k FROM ({_LEVELS}, {_alloc_sql(f'{_W} * {_HEAT}', _AGAIN)})")
def alloc_frequency(spark, sf_dir):
    return bloom.reallocate_frequency(bloom.reallocate_structural(_levels(spark, sf_dir), 14, 256 << 23), _accesses(spark), 14)


@query(f"""SELECT *, 10 AS k, true AS adaptive FROM ({_LEVELS}, {_alloc_sql(f'{_W} * {_HEAT}', _AGAIN)}) UNION ALL BY NAME
    SELECT *, 10 AS k, false AS adaptive FROM ({_LEVELS} SELECT level, entries, ceil(greatest(512, entries * 14) / 512.0)::BIGINT AS blocks, greatest(512, entries * 14)::BIGINT AS bits FROM lv)""")
def alloc_dispatch(spark, sf_dir):
    both = [bloom.reallocate(_levels(spark, sf_dir), _accesses(spark), 14, 256 << 23, mode).withColumn("adaptive", F.lit(mode)) for mode in (True, False)]
    return both[0].unionByName(both[1])


@query(f"{_LEVELS} SELECT count(*) AS levels, 0::BIGINT AS wrong FROM lv")
def bloom_invariant(spark, sf_dir):
    levels = bloom.reallocate_structural(_levels(spark, sf_dir), 14, 256 << 23)
    return levels.agg(F.count("*").alias("levels")).crossJoin(bloom.wrong_hash_counts(levels, 14).agg(F.count("*").alias("wrong")))  # one row each


@query("SELECT range AS k, least(greatest(range, 1), 32) AS clamped FROM range(-3, 41)")
def bloom_clamp(spark, sf_dir):
    return spark.createDataFrame([(k, bloom.clamp_hashes(k)) for k in range(-3, 41)], "k bigint, clamped bigint")


@query(f"""WITH {_MEMBERS} SELECT 10::BIGINT AS k, (SELECT count(*) FROM keys) AS n, 5::BIGINT AS blocks, 40::BIGINT AS words, (SELECT count(*) FROM have) AS bits_set
    UNION ALL SELECT 10, 0, 1, 0, 0""")
def bloom_header(spark, sf_dir):
    """A filter packed with its header and unpacked, and one that is too short."""
    keys = _log(spark, sf_dir).select("key").distinct()
    packed = bloom.pack(bloom.build(keys, 5, 10), 10, keys.count(), 5)
    both = bloom.unpack(packed.unionByName(packed.select(F.substring("filter", 1, 11).alias("filter"))))
    ones = F.aggregate(F.transform("words", lambda w: F.bit_count(w)), F.lit(0), lambda a, x: a + x).cast("bigint")
    return both.select("k", "n", "blocks", F.size("words").cast("bigint").alias("words"), ones.alias("bits_set"))


@query(f"{_LEVELS} SELECT level, entries, least(greatest(512, entries * 14), 20000)::BIGINT AS bits, ceil(least(greatest(512, entries * 14), 20000) / 512.0)::BIGINT AS blocks FROM lv")
def alloc_uniform(spark, sf_dir):
    return bloom.allocate_uniform(_levels(spark, sf_dir), 14, 20_000)


# --------------------------------------------------------------------------- telemetry


@query("SELECT event_id // 1000 AS \"window\", user_id AS key, count(*) AS n FROM events GROUP BY 1, 2")
def heat_window(spark, sf_dir):
    return bloom.heat_windows(_log(spark, sf_dir), "seq", 1000)


@query("SELECT \"window\", max(n) AS hottest FROM (SELECT event_id // 1000 AS \"window\", user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def heat_hottest(spark, sf_dir):
    return bloom.hottest(bloom.heat_windows(_log(spark, sf_dir), "seq", 1000))


@query("SELECT (event_id - 500) // 1000 AS \"window\", user_id AS key, count(*) AS n FROM events WHERE event_id >= 500 GROUP BY 1, 2")
def heat_reset(spark, sf_dir):
    """Windows that begin anew after access 500."""
    return bloom.heat_windows(_log(spark, sf_dir), "seq", 1000, 500)


@query("""WITH c AS (SELECT user_id, count(*) AS x FROM (SELECT user_id FROM events ORDER BY event_id DESC LIMIT 2048) GROUP BY 1),
    r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM c)
    SELECT round(sum((2 * i - n - 1) * x)::DOUBLE / (max(n) * sum(x)), 9) AS gini FROM r""")
def gini_tail(spark, sf_dir):
    return telemetry.gini(telemetry.last_accesses(_log(spark, sf_dir), "seq")).select(F.round("gini", 9).alias("gini"))


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def hot_keys(spark, sf_dir):
    return telemetry.hot_keys(_log(spark, sf_dir), 10)


def _daily(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.sum("value").alias("velocity"), F.count("*").alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    return e.withColumn("i", F.row_number().over(W.orderBy("day")).cast("bigint"))  # a row a day


DAILY = """daily AS (SELECT row_number() OVER (ORDER BY day) AS i, velocity, rows, errors FROM (SELECT CAST(ts AS DATE) AS day, sum(value) AS velocity, count(*) AS rows,
    count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1))"""


@query(f"""WITH RECURSIVE {DAILY}, v(i, v) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT d.i, 0.3 * d.velocity + 0.7 * v.v FROM v JOIN daily d ON d.i = v.i + 1)
    SELECT 'all' AS stream, round(v, 6) AS velocity FROM v WHERE i = (SELECT max(i) FROM daily)""")
def ewma_velocity(spark, sf_dir):
    d = _daily(spark, sf_dir).select(F.lit("all").alias("stream"), "i", "velocity", F.lit(1.0).alias("dt"))
    return telemetry.ewma(d, "stream", "i", "velocity", "dt").select("stream", F.round("velocity", 6).alias("velocity"))


NS = "CAST(round(value * 1000) AS BIGINT)"


@query(f"SELECT CASE WHEN {NS} // 100 <= 0 THEN 0 ELSE least(length(bin({NS} // 100)), 255) END::INTEGER AS bucket, count(*) AS n FROM events GROUP BY 1")
def latency_hist(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ns", F.round(F.col("value") * 1000).cast("bigint"))
    return telemetry.latency_histogram(e, "ns")


@query(f"""WITH h AS (SELECT CASE WHEN {NS} // 100 <= 0 THEN 0 ELSE least(length(bin({NS} // 100)), 255) END AS b, count(*) AS n FROM events GROUP BY 1),
    c AS (SELECT b, sum(n) OVER (ORDER BY b) AS reached, sum(n) OVER () AS total FROM h), p AS (SELECT unnest([50.0, 99.0, 99.9])::DOUBLE AS percent)
    SELECT percent, (CASE WHEN min(b) = 0 THEN 100 ELSE pow(2, min(b) - 1) * 100 END)::BIGINT AS ns FROM p JOIN c ON reached >= floor(percent / 100 * total) GROUP BY percent""")
def latency_percentile(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ns", F.round(F.col("value") * 1000).cast("bigint"))
    return telemetry.latency_percentiles(telemetry.latency_histogram(e, "ns"), [50.0, 99.0, 99.9])


@query("""SELECT p.percent, (CASE WHEN n = 0 THEN 0 WHEN floor(p.percent / 100 * n) = 0 THEN 100 ELSE 819200 END)::BIGINT AS ns, n
    FROM (SELECT unnest([0, 1, 3])::BIGINT AS n), (SELECT unnest([0.0, 50.0, 99.0])::DOUBLE AS percent) p""")
def latency_few(spark, sf_dir):
    """Percentiles of no, one and three samples of a millisecond."""
    parts = [
        telemetry.latency_percentiles(telemetry.latency_histogram(spark.range(n).select(F.lit(1_000_000).cast("bigint").alias("ns")), "ns"), [0.0, 50.0, 99.0]).withColumn("n", F.lit(n).cast("bigint"))
        for n in (0, 1, 3)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {LOG}, reads AS (SELECT range * 7 AS key FROM range(0, 100)), last AS (SELECT key, arg_max(op, seq) AS op FROM log GROUP BY key)
    SELECT (SELECT count(*) FROM log WHERE op = 'PUT') AS puts, (SELECT count(*) FROM log WHERE op = 'DELETE') AS deletes, (SELECT count(DISTINCT key) FROM log) AS keys,
    count(*) AS reads, count(*) FILTER (WHERE l.op = 'PUT') AS hits FROM reads r LEFT JOIN last l ON l.key = r.key""")
def engine_counters(spark, sf_dir):
    log = _log(spark, sf_dir)
    return telemetry.counters(log, resolve.get_many(log, spark.range(0, 100).select((F.col("id") * 7).alias("key"))))


@query(f"WITH {LOG} SELECT seq % 8 AS thread, count(*) AS ops, count(*) FILTER (WHERE op = 'PUT') AS writes FROM log GROUP BY 1")
def thread_totals(spark, sf_dir):
    return telemetry.by_thread(_log(spark, sf_dir), 8)


@query(f"""{FLUSHED}, merged AS ({_newest('(SELECT * FROM runs WHERE level <= 1)')}), l AS (SELECT sum(12 + length(value)) AS logical, sum(13 + length(value)) AS wal FROM log),
    f AS (SELECT sum(13 + length(value)) AS flush FROM runs), c AS (SELECT sum(13 + length(value)) AS compaction FROM merged)
    SELECT logical::BIGINT AS logical, wal::BIGINT AS wal, flush::BIGINT AS flush, compaction::BIGINT AS compaction, round((wal + flush + compaction)::DOUBLE / logical, 9) AS waf FROM l, f, c""")
def write_parts(spark, sf_dir):
    r = _runs(spark, sf_dir)
    found = telemetry.write_parts(_log(spark, sf_dir), r, runs.merge(r.where("level <= 1")))
    return found.withColumn("waf", F.round("waf", 9))


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    p AS (SELECT unnest([50.0, 99.0])::DOUBLE AS percent) SELECT event_type, percent, value FROM s, p WHERE i = least(floor(percent / 100 * n), n - 1)""")
def exact_percentile(spark, sf_dir):
    return telemetry.exact_percentiles(_t(spark, sf_dir, "events"), "value", [50.0, 99.0], "event_type")


@query("SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def latency_mean(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query(f"""{FLUSHED}, l AS (SELECT sum(12 + length(value)) AS logical, sum(13 + length(value)) AS wal FROM log), s AS (SELECT sum(13 + length(value)) AS sst FROM runs)
    SELECT logical::BIGINT AS logical, wal::BIGINT AS wal, sst::BIGINT AS sst, round((wal + sst)::DOUBLE / logical, 9) AS waf FROM l, s""")
def waf_parts(spark, sf_dir):
    log, size = _log(spark, sf_dir), F.octet_length("value")
    a = log.agg(F.sum(12 + size).alias("logical"), F.sum(oplog.RECORD_BYTES + size).alias("wal"))
    b = runs.flush(log, RUN).agg(F.sum(oplog.RECORD_BYTES + size).alias("sst"))
    return a.crossJoin(b).withColumn("waf", F.round(telemetry.write_amplification(F.col("wal"), F.col("sst"), F.col("logical")), 9))  # one row each


@query(f"{FLUSHED}, last AS ({_newest('log')}) SELECT (SELECT count(*) FROM runs) AS physical, (SELECT count(*) FROM last WHERE op = 'PUT') AS live, round((SELECT count(*) FROM runs)::DOUBLE / (SELECT count(*) FROM last WHERE op = 'PUT'), 9) AS saf")
def space_ratio(spark, sf_dir):
    log = _log(spark, sf_dir)
    a = runs.flush(log, RUN).agg(F.count("*").alias("physical"))
    b = resolve.live(log).agg(F.count("*").alias("live"))
    return a.crossJoin(b).withColumn("saf", F.round(telemetry.space_amplification(F.col("physical"), F.col("live")), 9))  # one row each


@query(lambda: f"""{LOOKUP} SELECT sum(run_probes)::BIGINT AS candidate_run_probes, round(sum(run_probes) / 80.0::DOUBLE, 9) AS raf,
    sum(false_positives)::BIGINT AS false_positives, round(sum(false_positives)::DOUBLE / sum(level_probes), 9) AS fpr FROM looked""")
def read_ratio(spark, sf_dir):
    total = _lookup(spark, sf_dir).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("run_probes", "false_positives", "level_probes")])
    return total.select(
        F.col("run_probes").alias("candidate_run_probes"), F.round(telemetry.read_amplification(F.col("run_probes"), F.lit(80.0)), 9).alias("raf"),
        "false_positives", F.round(telemetry.observed_fpr(F.col("false_positives"), F.col("level_probes")), 9).alias("fpr"),
    )


# --------------------------------------------------------------------------- policy


def _signals(spark, sf_dir):
    return _daily(spark, sf_dir).select("i", "velocity", (F.col("errors") / F.col("rows")).alias("skew"), (F.col("rows") % 2 == 0).alias("any_full"))


def _middle(spark, sf_dir, share: float) -> float:
    """The mean daily velocity: a threshold that both sides of the comparison meet."""
    return _daily(spark, sf_dir).agg(F.avg("velocity")).first()[0] * share


FSM = f"""WITH RECURSIVE {DAILY}, s AS (SELECT i, velocity > (SELECT avg(velocity) FROM daily) AS fast, errors::DOUBLE / rows > (SELECT avg(errors::DOUBLE / rows) FROM daily) AS skewed, rows % 2 = 0 AS full FROM daily),
    f(i, prev, state, cool_before, cool, transition, reason) AS (
        SELECT 0::BIGINT, 'HYBRID'::VARCHAR, 'HYBRID'::VARCHAR, 0::INTEGER, 0::INTEGER, false, ''::VARCHAR UNION ALL
        SELECT s.i, f.state, CASE WHEN f.cool > 0 THEN f.state WHEN s.fast AND s.full THEN 'TIERING' WHEN s.skewed THEN 'LEVELING' ELSE 'HYBRID' END, f.cool,
            CASE WHEN f.cool > 0 THEN f.cool - 1 WHEN f.state <> (CASE WHEN s.fast AND s.full THEN 'TIERING' WHEN s.skewed THEN 'LEVELING' ELSE 'HYBRID' END) THEN 2 ELSE 0 END,
            f.cool = 0 AND f.state <> (CASE WHEN s.fast AND s.full THEN 'TIERING' WHEN s.skewed THEN 'LEVELING' ELSE 'HYBRID' END),
            CASE WHEN f.cool > 0 THEN 'cooldown=' || f.cool WHEN s.fast AND s.full THEN 'velocity+saturation' WHEN s.skewed THEN 'high_skew' ELSE 'default' END
        FROM f JOIN s ON s.i = f.i + 1)"""


def _decisions(spark, sf_dir):
    s = _signals(spark, sf_dir)
    skew = s.agg(F.avg("skew")).first()[0]
    s = s.withColumn("tau", F.lit(_middle(spark, sf_dir, 1.0))).withColumn("skew_limit", F.lit(skew)).withColumn("hysteresis", F.lit(2)).withColumn("stream", F.lit("all"))
    return policy.trace(s, "stream").drop("stream")


@query(f"{FSM} SELECT i, prev AS prev_strategy, state AS new_strategy, cool_before AS cooldown, transition, reason FROM f WHERE i > 0")
def policy_trace(spark, sf_dir):
    return _decisions(spark, sf_dir).select("i", "prev_strategy", "new_strategy", "cooldown", "transition", "reason")


@query(f"{FSM} SELECT i, prev AS prev_strategy, state AS new_strategy FROM f WHERE i > 0 AND transition")
def policy_switches(spark, sf_dir):
    return policy.switches(_decisions(spark, sf_dir)).select("i", "prev_strategy", "new_strategy")


@query(f"{FSM} SELECT i, state AS new_strategy, reason FROM f ORDER BY i DESC LIMIT 1")
def policy_last(spark, sf_dir):
    return policy.last_decision(_decisions(spark, sf_dir)).select("i", "new_strategy", "reason")


@query(f"{FSM} SELECT count(*) FILTER (WHERE transition) AS total, count(*) FILTER (WHERE transition AND i > 10) AS delta, arg_max(state, i) AS current FROM f WHERE i > 0")
def policy_counts(spark, sf_dir):
    """All switches, those not reported after decision 10, and the strategy at the end."""
    return policy.counts(_decisions(spark, sf_dir), 10)


@query(f"""{FSM.replace('FROM f JOIN s ON s.i = f.i + 1', "FROM (SELECT i, CASE WHEN i = 14 THEN 'HYBRID' ELSE state END AS state, CASE WHEN i = 14 THEN 0 ELSE cool END AS cool FROM f) f JOIN s ON s.i = f.i + 1")}
    SELECT i, prev AS prev_strategy, state AS new_strategy, cool_before AS cooldown FROM f WHERE i > 0""")
def policy_reset(spark, sf_dir):
    """The policy is set back to HYBRID before decision 15."""
    s = policy.with_resets(_signals(spark, sf_dir), [15])
    skew = s.agg(F.avg("skew")).first()[0]
    s = s.withColumn("tau", F.lit(_middle(spark, sf_dir, 1.0))).withColumn("skew_limit", F.lit(skew)).withColumn("hysteresis", F.lit(2))
    return policy.trace(s, "era").select("i", "prev_strategy", "new_strategy", "cooldown")


@query(f"""WITH RECURSIVE {DAILY}, p AS (SELECT t.range AS t, h.h FROM range(1, 5) t, (SELECT unnest([0, 1, 2, 3, 5, 8])::BIGINT AS h) h),
    s AS (SELECT p.t, p.h, i, velocity > (SELECT avg(velocity) FROM daily) * p.t * 0.4::DOUBLE AS fast, errors::DOUBLE / rows > 0.2 AS skewed, rows % 2 = 0 AS full FROM daily, p),
    f(t, h, i, state, cool, transition) AS (SELECT t, h, 0::BIGINT, 'HYBRID'::VARCHAR, 0::BIGINT, false FROM p UNION ALL
        SELECT s.t, s.h, s.i, CASE WHEN f.cool > 0 THEN f.state WHEN s.fast AND s.full THEN 'TIERING' WHEN s.skewed THEN 'LEVELING' ELSE 'HYBRID' END,
            CASE WHEN f.cool > 0 THEN f.cool - 1 WHEN f.state <> (CASE WHEN s.fast AND s.full THEN 'TIERING' WHEN s.skewed THEN 'LEVELING' ELSE 'HYBRID' END) THEN s.h ELSE 0 END,
            f.cool = 0 AND f.state <> (CASE WHEN s.fast AND s.full THEN 'TIERING' WHEN s.skewed THEN 'LEVELING' ELSE 'HYBRID' END)
        FROM f JOIN s ON s.i = f.i + 1 AND s.t = f.t AND s.h = f.h)
    SELECT t AS tau_step, h AS hysteresis, count(*) FILTER (WHERE transition) AS switches FROM f GROUP BY t, h""")
def policy_sweep(spark, sf_dir):
    mean = _middle(spark, sf_dir, 1.0)
    taus = [mean * t * 0.4 for t in range(1, 5)]
    d = policy.sweep(_signals(spark, sf_dir), taus, [0, 1, 2, 3, 5, 8], 0.2)
    step = F.array_position(F.array(*[F.lit(t) for t in taus]), F.col("tau"))
    return d.select(step.alias("tau_step"), F.col("hysteresis").cast("bigint").alias("hysteresis"), "switches")


# --------------------------------------------------------------------------- log


@query(f"WITH {LOG} SELECT seq // 64 AS batch, count(*) AS records, sum(13 + length(value))::BIGINT AS bytes FROM log GROUP BY 1")
def group_commit(spark, sf_dir):
    return oplog.group_commits(_log(spark, sf_dir), 64)


@query(f"WITH {LOG} SELECT key, seq, op, value FROM log WHERE seq > 9000")
def wal_tail(spark, sf_dir):
    return oplog.tail(_log(spark, sf_dir), 9000)


@query(f"WITH {LOG} SELECT sum(13 + length(value))::BIGINT AS bytes, count(DISTINCT seq // 64) AS commits, count(*) AS records FROM log")
def wal_totals(spark, sf_dir):
    return oplog.totals(_log(spark, sf_dir))


# --------------------------------------------------------------------------- workloads


_MIX_SQL = "(VALUES " + ", ".join(str(m) for m in workload.MIXES) + ') v(name, theta, read, "update", "insert", scan, "delete")'


@query(f"""SELECT name, theta::DOUBLE AS theta, s.n AS num_ops, s.n // 2 AS record_count, greatest(1000000, s.n * 2) AS key_space,
    round((1 - read - "update" - "insert" - scan - "delete")::DOUBLE, 6) AS rmw FROM {_MIX_SQL}, (SELECT unnest([{', '.join(map(str, workload.SCALES))}])::BIGINT AS n) s""")
def workload_mix(spark, sf_dir):
    return workload.configs(ship_code(spark)).select("name", "theta", "num_ops", "record_count", "key_space", F.abs(F.round("rmw", 6)).alias("rmw"))


@query("SELECT theta, round(sum(1 / pow(i.range, theta)), 6) AS zeta FROM range(1, 10001) i, (SELECT unnest([0.5, 0.8, 0.9, 0.99])::DOUBLE AS theta) GROUP BY theta")
def zipf_mass(spark, sf_dir):
    d = spark.range(1, 10001).withColumn("theta", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.8, 0.9, 0.99)])))
    return d.groupBy("theta").agg(F.round(F.sum(1 / F.pow(F.col("id"), F.col("theta"))), 6).alias("zeta"))


def _draw(seed: int) -> str:
    return f"(({_h(f'(range * 1048576 + {seed})::UBIGINT')} >> 11)::DOUBLE / 9007199254740992.0::DOUBLE)"


def _stream_sql(name: str, ops: int, seed: int = 42, theta: float | None = None) -> str:
    """The seeded stream of a mix as SQL."""
    _, own, *mix = next(m for m in workload.MIXES if m[0] == name)
    theta = own if theta is None else theta
    space, edge, cases = max(1_000_000, 2 * ops), 0.0, ""
    for op, share in zip(("READ", "UPDATE", "INSERT", "SCAN", "DELETE"), mix):
        edge += share
        cases += f"WHEN r < {edge!r}::DOUBLE THEN '{op}' "
    zeta_2, alpha = 1 + 0.5**theta, 1 / (1 - theta)
    rest = f"floor({space} * pow(eta * u - eta + 1, {alpha!r}::DOUBLE))"
    rank = f"floor(u * {space})" if theta == 0 else f"least(CASE WHEN u * z < 1 THEN 0 WHEN u * z < {zeta_2!r}::DOUBLE THEN 1 ELSE {rest} END, {space - 1})"
    eta = f"(1 - {(2 / space) ** (1 - theta)!r}::DOUBLE) / (1 - {zeta_2!r}::DOUBLE / z)"
    return f"""WITH zeta AS (SELECT sum(1 / pow(range, {theta}::DOUBLE)) AS z FROM range(1, {space + 1})), c AS (SELECT z, {eta} AS eta FROM zeta),
        d AS (SELECT range AS seq, {_draw(seed)} AS r, {_draw(seed + 1)} AS u, {_draw(seed + 2)} AS w FROM range(0, {ops})),
        k AS (SELECT seq, r, w, CAST({rank} AS BIGINT) AS rank FROM d, c),
        o AS (SELECT seq, w, CASE {cases} ELSE 'RMW' END AS op, ({_h('rank::UBIGINT')} % {space})::BIGINT + 1 AS key FROM k)
        SELECT seq, op, key, (CASE WHEN op = 'SCAN' THEN key + 1 + floor(w * 100) ELSE 0 END)::BIGINT AS scan_end FROM o"""


def _load_sql(ops: int, seed: int = 99) -> str:
    return f"SELECT range AS seq, 'INSERT' AS op, (floor({_draw(seed)} * {max(1_000_000, 2 * ops)}) + 1)::BIGINT AS key FROM range(0, {ops // 2})"


@query(_stream_sql("RSW", 100_000))
def workload_generate(spark, sf_dir):
    return workload.generate(ship_code(spark), "RSW", 100_000)


@query(_load_sql(100_000))
def workload_load(spark, sf_dir):
    return workload.load(ship_code(spark), 100_000)


def _run_sql(name: str, ops: int) -> str:
    kinds = ", ".join(f"(SELECT count(*) FROM ops WHERE op = '{k}') AS {k.lower()}" for k in ("READ", "UPDATE", "INSERT", "SCAN", "DELETE", "RMW"))
    quoted = kinds.replace("AS update", 'AS "update"').replace("AS insert", 'AS "insert"').replace("AS delete", 'AS "delete"').replace("AS scan", 'AS "scan"').replace("AS read", 'AS "read"')
    return f"""WITH ops AS ({_stream_sql(name, ops)}), load AS ({_load_sql(ops)}),
        every AS (SELECT key, seq, op FROM load UNION ALL SELECT key, seq + {ops // 2}, op FROM ops),
        seen AS (SELECT *, last_value(CASE WHEN op IN ('INSERT', 'UPDATE', 'DELETE') THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM every),
        newest AS (SELECT key, arg_max(op, seq) AS op FROM every WHERE op IN ('INSERT', 'UPDATE', 'DELETE') GROUP BY key)
        SELECT {quoted}, (SELECT count(*) FROM seen WHERE op IN ('READ', 'RMW') AND last <> 'DELETE') AS hits, (SELECT count(*) FROM newest WHERE op <> 'DELETE') AS live_keys, '{name}' AS name, {ops} AS num_ops"""


def _runs_of(spark, names_and_ops: list[tuple[str, int]]) -> DataFrame:
    out = None
    for name, ops in names_and_ops:
        one = workload.run(ship_code(spark), name, ops)
        out = one if out is None else out.unionByName(one)
    return out


@query(" UNION ALL BY NAME ".join(f"SELECT * FROM ({_run_sql(n, 20_000)})" for n in "ACDF"))
def workload_runs(spark, sf_dir):
    """Runs of four mixes over their load."""
    return _runs_of(spark, [(n, 20_000) for n in "ACDF"])


@query(" UNION ALL BY NAME ".join(f"SELECT * FROM ({_run_sql('A', n)})" for n in (10_000, 100_000)))
def workload_scale(spark, sf_dir):
    """One mix at two scales."""
    return _runs_of(spark, [("A", n) for n in (10_000, 100_000)])


@query(f"SELECT seq // 1000 AS epoch, count(*) FILTER (WHERE op = 'RMW') AS velocity, round(count(*) FILTER (WHERE op = 'READ')::DOUBLE / count(*), 9) AS skew FROM ({_stream_sql('F', 100_000)}) GROUP BY 1")
def workload_signals(spark, sf_dir):
    """The signals of mix F at 100K operations, epoch by epoch."""
    d = workload.generate(ship_code(spark), "F", 100_000)
    return d.groupBy(F.floor(F.col("seq") / 1000).alias("epoch")).agg(F.count_if(F.col("op") == "RMW").alias("velocity"), F.round(F.count_if(F.col("op") == "READ") / F.count("*"), 9).alias("skew"))


_THETAS = (0.0, 0.8, 0.9, 0.99)


@query(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS theta, count(DISTINCT key) AS keys, max(n) AS most FROM (SELECT key, count(*) AS n FROM ({_stream_sql('A', 20_000, theta=t)}) GROUP BY key)" for t in _THETAS))
def workload_theta(spark, sf_dir):
    """How skewed mix A is at four thetas: distinct keys and the most frequent one's count."""
    out = None
    for t in _THETAS:
        counts = workload.generate(ship_code(spark), "A", 20_000, theta=t).groupBy("key").agg(F.count("*").alias("n"))
        one = counts.agg(F.lit(t).alias("theta"), F.count("*").alias("keys"), F.max("n").alias("most"))
        out = one if out is None else out.unionByName(one)
    return out


@query(lambda: f"""WITH RECURSIVE s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY e) AS i, v > 500 AS fast, k > 0.5 AS skewed, v % 2 = 0 AS full FROM (
        SELECT seq // 1000 AS e, count(*) FILTER (WHERE op = 'RMW') AS v, count(*) FILTER (WHERE op = 'READ')::DOUBLE / count(*) AS k FROM ({_stream_sql('F', 100_000)}) GROUP BY 1)), {FSM[FSM.index('f(i, prev'):]}
    SELECT i, prev AS prev_strategy, state AS new_strategy, reason FROM f WHERE i > 0 AND transition""")
def workload_switches(spark, sf_dir):
    """The switch log of the policy over mix F at 100K operations."""
    d = workload.generate(ship_code(spark), "F", 100_000).groupBy(F.floor(F.col("seq") / 1000).alias("epoch")).agg(
        F.count_if(F.col("op") == "RMW").alias("velocity"), (F.count_if(F.col("op") == "READ") / F.count("*")).alias("skew"))
    s = d.select((F.col("epoch") + 1).alias("i"), "velocity", "skew", (F.col("velocity") % 2 == 0).alias("any_full"), F.lit(500).alias("tau"), F.lit(0.5).alias("skew_limit"), F.lit(2).alias("hysteresis"), F.lit("F").alias("stream"))
    return policy.switches(policy.trace(s, "stream")).select("i", "prev_strategy", "new_strategy", "reason")


@query(f"""SELECT name AS workload, label AS scale, count(*) AS settings FROM {_MIX_SQL}, (SELECT unnest(['100K', '500K', '1M', '5M', '10M', '15M']) AS label), range(0, 12) GROUP BY 1, 2""")
def workload_files(spark, sf_dir):
    """The settings files of all mixes and scales, written and read back."""
    root = new_root(spark, "settings")
    files.write_settings(workload.configs(ship_code(spark)), root)
    found = files.read_settings(spark, root)
    parts = [F.regexp_extract("file", f"{c}=([^/]+)/", 1).alias(c) for c in ("workload", "scale")]
    return found.groupBy(*parts).agg(F.count("*").alias("settings"))


# --------------------------------------------------------------------------- statistics


@query("SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS sd FROM lineitem GROUP BY 1, 2")
def mean_sd(spark, sf_dir):
    d = stats.mean_sd(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus")
    return d.select("l_returnflag", "l_linestatus", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def _sides(spark, sf_dir):
    """Mean quantity per ship mode half and line number: 7 matched pairs a return flag."""
    d = _t(spark, sf_dir, "lineitem").where("l_linenumber <= 7").withColumn("side", F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(2))
    g = d.groupBy("l_returnflag", "l_linenumber", "side").agg(F.avg("l_quantity").alias("value"))
    return stats.pair(g.where("side = 1"), g.where("side = 2"), "l_returnflag", "l_linenumber")


_SIDES = """p AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) FILTER (WHERE l_suppkey % 2 = 0) AS a, avg(l_quantity) FILTER (WHERE l_suppkey % 2 <> 0) AS b
    FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1, 2), g AS (SELECT l_returnflag, count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM p GROUP BY 1)"""
_TCRIT = "[" + ", ".join(map(str, scalar.T_CRITICAL)) + "]"


@query(f"WITH {_SIDES} SELECT l_returnflag, n, round(m, 6) AS mean_diff, round(sd, 6) AS sd_diff, round(m / (sd / sqrt(n)), 4) AS t FROM g")
def paired_diff(spark, sf_dir):
    d = stats.paired(_sides(spark, sf_dir), "l_returnflag")
    return d.select("l_returnflag", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("sd_diff", 6).alias("sd_diff"), F.round("t", 4).alias("t"))


@query(f"WITH {_SIDES} SELECT l_returnflag, round(m - {_TCRIT}[n - 1] * sd / sqrt(n), 5) AS ci_low, round(m + {_TCRIT}[n - 1] * sd / sqrt(n), 5) AS ci_high FROM g")
def ci95(spark, sf_dir):
    d = stats.paired(_sides(spark, sf_dir), "l_returnflag")
    return d.select("l_returnflag", F.round("ci_low", 5).alias("ci_low"), F.round("ci_high", 5).alias("ci_high"))


#: Two-tailed probability of t at an even number f of degrees of freedom, in closed form.
_T_EVEN = """(SELECT 1 - sin(a) * list_sum(list_transform(range(0, CAST(f // 2 AS BIGINT)), lambda j: pow(cos(a), 2 * j) * list_product([1.0::DOUBLE] || list_transform(range(1, j + 1), lambda m: (2 * m - 1) / (2.0::DOUBLE * m)))))
    FROM (SELECT atan(abs({t}) / sqrt({f})) AS a, {f} AS f))"""


@query(lambda: f"""WITH {_SIDES}, t AS (SELECT l_returnflag, n, m / (sd / sqrt(n)) AS t FROM g)
    SELECT l_returnflag, n, round(greatest(0.0001::DOUBLE, least(1.0::DOUBLE, {_T_EVEN.format(t='t', f='(n - 1)')})), 9) AS p FROM t""")
def t_p_value(spark, sf_dir):
    return stats.paired_p(_sides(spark, sf_dir), "l_returnflag").select("l_returnflag", "n", F.round("p", 9).alias("p"))


_RANKS = """x AS (SELECT l_returnflag, l_quantity AS v, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS side FROM lineitem),
    r AS (SELECT l_returnflag, side, rank() OVER (PARTITION BY l_returnflag ORDER BY v) + (count(*) OVER (PARTITION BY l_returnflag, v) - 1) / 2.0::DOUBLE AS rk FROM x),
    s AS (SELECT l_returnflag, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2, coalesce(sum(rk) FILTER (WHERE side = 1), 0) AS r1 FROM r GROUP BY 1)"""


@query(f"WITH {_RANKS} SELECT l_returnflag, n1, n2, round(least(r1 - n1 * (n1 + 1) / 2.0::DOUBLE, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0::DOUBLE)), 3) AS u FROM s")
def rank_sum(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").withColumn("side", F.when(F.col("l_linestatus") == "O", 1).otherwise(2))
    return stats.rank_sums(d, "l_quantity", "side", "l_returnflag").select("l_returnflag", "n1", "n2", F.round(F.col("u").cast("double"), 3).alias("u"))


def _erf_terms(n: int = 90) -> str:
    """2^k / (1 * 3 * ... * (2 k + 1)): the terms of the series of erf that are all positive."""
    out, c = [], 1.0
    for k in range(n):
        out.append(repr(c))
        c *= 2 / (2 * k + 3)
    return "[" + ", ".join(out) + "]::DOUBLE[]"


@query(lambda: f"""WITH {_RANKS}, u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2.0::DOUBLE, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0::DOUBLE)) AS u FROM s),
    z AS (SELECT *, abs((u - n1 * n2 / 2.0::DOUBLE) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0::DOUBLE)) / sqrt(2.0::DOUBLE) AS x FROM u),
    e AS (SELECT *, CASE WHEN x > 5 THEN 1.0::DOUBLE ELSE 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 90), lambda k: ({_erf_terms()})[k + 1] * pow(x, 2 * k + 1))) END AS erf FROM z)
    SELECT l_returnflag, n1, n2, round(CASE WHEN n1 < 2 OR n2 < 2 THEN 1.0::DOUBLE ELSE greatest(0.0001::DOUBLE, least(1.0::DOUBLE, 1 - erf)) END, 7) AS p FROM e""")
def rank_sum_p(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").withColumn("side", F.when(F.col("l_linestatus") == "O", 1).otherwise(2))
    return stats.rank_sum_p(d, "l_quantity", "side", "l_returnflag").select("l_returnflag", "n1", "n2", F.round("p", 7).alias("p"))


@query(f"""WITH x AS (SELECT l_orderkey, l_quantity AS v, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS side FROM lineitem),
    r AS (SELECT l_orderkey, side, rank() OVER (PARTITION BY l_orderkey ORDER BY v) + (count(*) OVER (PARTITION BY l_orderkey, v) - 1) / 2.0::DOUBLE AS rk FROM x),
    s AS (SELECT l_orderkey, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2, coalesce(sum(rk) FILTER (WHERE side = 1), 0) AS r1 FROM r GROUP BY 1),
    u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2.0::DOUBLE, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0::DOUBLE)) AS u FROM s WHERE n1 <= 3 AND n2 <= 3)
    SELECT l_orderkey, n1, n2, round(u, 3) AS u, (CASE WHEN n1 < 2 OR n2 < 2 THEN 1.0 {" ".join(f"WHEN u <= {u} THEN {p}" for u, p in stats.SMALL_SIDES)} ELSE 1.0 END)::DOUBLE AS p FROM u""")
def rank_sum_small(spark, sf_dir):
    """The orders with at most three lines of odd and of even number: tabled values, and 1 where a side has less than two."""
    d = _t(spark, sf_dir, "lineitem").withColumn("side", F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2))
    p = stats.rank_sum_p(d, "l_quantity", "side", "l_orderkey").where("n1 <= 3 and n2 <= 3")
    return p.select("l_orderkey", "n1", "n2", F.round(F.col("u").cast("double"), 3).alias("u"), "p")


@query("""SELECT l_returnflag, count(*) FILTER (WHERE abs(l_extendedprice - m) > 2 * sd) AS outliers, count(*) AS n FROM (SELECT l_returnflag, l_extendedprice,
    avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m, stddev_samp(l_extendedprice) OVER (PARTITION BY l_returnflag) AS sd FROM lineitem) GROUP BY 1""")
def outliers(spark, sf_dir):
    d = stats.outliers(_t(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", "l_returnflag")
    return d.groupBy("l_returnflag").agg(F.count_if("outlier").alias("outliers"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ablation_cube(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT n.range AS n, CASE WHEN n.range >= 1000000 THEN (n.range // 1000000) || 'M' WHEN n.range >= 1000 THEN (n.range // 1000) || 'K' ELSE n.range::VARCHAR END AS label FROM range(0, 20000000, 250500) n")
def scale_labels(spark, sf_dir):
    return spark.range(0, 20_000_000, 250_500).select(F.col("id").alias("n"), scalar.scale_label(F.col("id")).alias("label"))


# --------------------------------------------------------------------------- reports


def _results(spark, sf_dir):
    """Benchmark rows from lineitem: workload by return flag, configuration by supplier, seven runs by line number."""
    d = _t(spark, sf_dir, "lineitem")
    by = [F.lit(1_000_000).alias("scale"), F.col("l_returnflag").alias("workload"), F.when(F.col("l_suppkey") % 2 == 0, "base").otherwise("other").alias("config"), F.col("l_linenumber").alias("run_id")]
    return d.groupBy(*by).agg(F.avg("l_quantity").alias("throughput"), F.avg("l_tax").alias("raf"))


def _external(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    return d.groupBy(F.lit(1_000_000).alias("scale"), F.col("l_returnflag").alias("workload"), F.lit("throughput").alias("metric")).agg(F.avg("l_linenumber").alias("value"))


_RESULTS = """results AS (SELECT l_returnflag AS workload, CASE WHEN l_suppkey % 2 = 0 THEN 'base' ELSE 'other' END AS config, l_linenumber AS run_id, avg(l_quantity) AS throughput, avg(l_tax) AS raf FROM lineitem GROUP BY 1, 2, 3),
    long AS (SELECT workload, config, run_id, 'throughput' AS metric, throughput AS value FROM results UNION ALL SELECT workload, config, run_id, 'raf', raf FROM results),
    sides AS (SELECT workload, metric, avg(value) FILTER (WHERE config = 'base') AS bm, coalesce(stddev_samp(value) FILTER (WHERE config = 'base'), 0) AS bs,
        avg(value) FILTER (WHERE config = 'other') AS om, coalesce(stddev_samp(value) FILTER (WHERE config = 'other'), 0) AS os FROM long GROUP BY 1, 2),
    diffs AS (SELECT b.workload, b.metric, count(*) AS n, avg(o.value - b.value) AS m, stddev_samp(o.value - b.value) AS sd FROM long b JOIN long o ON o.workload = b.workload AND o.metric = b.metric AND o.run_id = b.run_id
        AND b.config = 'base' AND o.config = 'other' GROUP BY 1, 2),
    ext AS (SELECT l_returnflag AS workload, 'throughput' AS metric, avg(l_linenumber) AS em FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)"""


@query(lambda: f"""WITH {_RESULTS}, t AS (SELECT *, m / (sd / sqrt(n)) AS t FROM diffs), p AS (SELECT *, greatest(0.0001::DOUBLE, least(1.0::DOUBLE, {_T_EVEN.format(t='t', f='(n - 1)')})) AS p FROM t)
    SELECT s.workload, s.metric, '1M' AS scale_label, round(bm, 6) AS base_mean, round(bs, 6) AS base_sd, round(om, 6) AS other_mean, round(os, 6) AS other_sd, round((om - bm) / bm * 100, 5) AS diff_pct, p.n, round(p.p, 6) AS p,
        p.p < 0.05 AS significant, round(em, 6) AS external_mean, round((om - em) / em * 100, 5) AS external_pct
    FROM sides s JOIN p ON p.workload = s.workload AND p.metric = s.metric LEFT JOIN ext e ON e.workload = s.workload AND e.metric = s.metric""")
def main_table(spark, sf_dir):
    d = reports.main_table(_results(spark, sf_dir), ["throughput", "raf"], "base", "other", _external(spark, sf_dir))
    six = [F.round(c, 6).alias(c) for c in ("base_mean", "base_sd", "other_mean", "other_sd", "p", "external_mean")]
    return d.select("workload", "metric", "scale_label", *six, F.round("diff_pct", 5).alias("diff_pct"), "n", "significant", F.round("external_pct", 5).alias("external_pct"))


@query("""WITH c AS (SELECT l_returnflag AS memtable, l_linestatus AS compaction, l_linenumber % 2 AS filter, count(*) AS n, avg(l_quantity) AS mean, coalesce(stddev_samp(l_quantity), 0) AS sd FROM lineitem GROUP BY 1, 2, 3)
    SELECT memtable, compaction, filter, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round((mean / first_value(mean) OVER (ORDER BY memtable, compaction, filter) - 1) * 100, 5) AS change_pct FROM c""")
def ablation_table(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("memtable"), F.col("l_linestatus").alias("compaction"), (F.col("l_linenumber") % 2).alias("filter"), "l_quantity")
    d = reports.ablation_table(d, ["memtable", "compaction", "filter"], "l_quantity")
    return d.select("memtable", "compaction", "filter", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("change_pct", 5).alias("change_pct"))


@query("""SELECT 1000000 AS scale, '1M' AS scale_label, l_returnflag AS workload, l_linenumber AS hysteresis, round(avg(l_quantity), 6) AS throughput, round(avg(l_tax), 6) AS waf, round(avg(l_suppkey), 6) AS switches FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def sweep_table(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select(
        F.lit(1_000_000).alias("scale"), F.col("l_returnflag").alias("workload"), F.col("l_linenumber").alias("hysteresis"), F.lit(5000.0).alias("tau"),
        F.col("l_suppkey").alias("switches"), F.col("l_quantity").alias("throughput"), F.col("l_tax").alias("waf"),
    )
    six = [F.round(c, 6).alias(c) for c in ("switches", "throughput", "waf")]
    return reports.sweep_table(d).select("scale", "scale_label", "workload", "hysteresis", *six)


# --------------------------------------------------------------------------- store


def new_root(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="runweave-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _third(log: DataFrame, k: int) -> DataFrame:
    """The log in three slices at thirds of its span of seq."""
    edge = log.agg(F.min("seq"), F.max("seq")).first()
    width = (edge[1] - edge[0] + 3) // 3
    return log.where(F.col("seq").between(edge[0] + k * width, edge[0] + (k + 1) * width - 1))


def _stored(spark, sf_dir) -> str:
    """A store that has flushed two slices of the log and holds a third in its log."""
    log, root = _log(spark, sf_dir), new_root(spark, "store")
    for k in range(3):
        maintenance.append(_third(log, k), root)
        if k < 2:
            maintenance.flush(spark, root)
    return root


@query(f"{LAST} SELECT key, value FROM last WHERE op = 'PUT'")
def store_recovery(spark, sf_dir):
    """Two flushed runs and a log, opened again: the live state is that of the whole log."""
    return maintenance.state(spark, _stored(spark, sf_dir))


@query("""WITH e AS (SELECT min(event_id) AS a, max(event_id) AS b FROM events), w AS (SELECT a, (b - a + 3) // 3 AS w FROM e)
    SELECT a + 2 * w - 1 AS flushed, 2::BIGINT AS runs, (SELECT count(*) FROM events, w WHERE event_id >= a + 2 * w) AS in_log FROM w""")
def store_truncated(spark, sf_dir):
    """What a store says after two flushes: the flushed seq, its runs, and the records left in its log."""
    root = _stored(spark, sf_dir)
    m = store.manifest(spark, root).agg(F.lit(store.flushed_seq(spark, root)).cast("bigint").alias("flushed"), F.count("*").alias("runs"))
    return m.crossJoin(spark.read.parquet(f"{root}/log/*").agg(F.count("*").alias("in_log")))  # one row each


@query("""SELECT i.range AS iteration, 300::BIGINT AS found, 1100::BIGINT AS scanned, 500::BIGINT AS live, 100::BIGINT AS updated FROM range(1, 4) i""")
def store_smoke(spark, sf_dir):
    """Three times 500 writes, 300 reads, 100 updates and 100 scans of eleven keys through a store."""
    out = None
    for iteration in range(1, 4):
        root = new_root(spark, "smoke")
        row = lambda seq, text: [F.col("id").alias("key"), seq.alias("seq"), F.lit("PUT").alias("op"), F.concat(F.lit(text), F.col("id").cast("string")).alias("value")]
        for part in range(2):
            maintenance.append(spark.range(250 * part + 1, 250 * part + 251).select(*row(F.col("id"), "val_")), root)
            maintenance.flush(spark, root)
        found = resolve.get_many(maintenance.opened(spark, root), spark.range(1, 301).toDF("key")).agg(F.count_if("found").alias("found"))
        maintenance.append(spark.range(1, 101).select(*row(F.col("id") + 1000, "upd_")), root)
        ranges = spark.range(1, 101).select(F.col("id").alias("scan_id"), F.col("id").alias("start"), (F.col("id") + 10).alias("end"))
        scanned = resolve.scan_many(maintenance.opened(spark, root), ranges).agg(F.count("*").alias("scanned"))
        state = maintenance.state(spark, root).agg(F.count("*").alias("live"), F.count_if(F.col("value").startswith("upd_")).alias("updated"))
        one = found.crossJoin(scanned).crossJoin(state).withColumn("iteration", F.lit(iteration).cast("bigint"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{LAST} SELECT key, value FROM last WHERE op = 'PUT'")
def store_round(spark, sf_dir):
    """The same after rounds of maintenance under a small memtable: leveling, then the state."""
    root = _stored(spark, sf_dir)
    maintenance.flush(spark, root)
    m = maintenance.Maintenance(spark, root, maintenance.Config(memtable_keys=10, hysteresis=0, skew_threshold=0.1))
    while m.round(skew=0.5)["version"] is not None and store.manifest(spark, root).agg(F.max("level")).first()[0] < 3:
        pass
    return maintenance.state(spark, root)


# --------------------------------------------------------------------------- streaming


@query(f"{LAST} SELECT key, value FROM last WHERE op = 'PUT'")
def stream_latest(spark, sf_dir):
    """The event log as a file stream, flushed batch by batch, then resolved."""
    root = new_root(spark, "stream")
    schema = _t(spark, sf_dir, "events").schema
    # a single file is listed by its folder and name
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    latest.start(oplog.from_events(source), root).awaitTermination()
    return latest.state(spark, root)


for _name, _sql in _LATER.items():
    ORACLES[_name] = _sql()
