"""A store of sorted runs and a log: opening with recovery, flushing, rounds of maintenance.

The log is a folder of Parquet slices, each named by its first and last seq. What a store
holds is its runs and the log after the flushed seq; a flush writes that tail as a run of
level 0, publishes it with the new flushed seq and then deletes the slices it covers, so a
crash in between loses nothing and repeats nothing.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.operators import bloom, policy, resolve
from runweave.operators import runs as ops
from runweave.sources import runs as store


@dataclass(frozen=True)
class Config:
    """Settings of the store (defaults are those of the published runs)."""

    memtable_keys: int = 4096
    levels: int = 7
    bits_per_key: int = 14
    filter_cap_bytes: int = 256 << 20
    velocity_threshold: float = 5000.0
    skew_threshold: float = 0.5
    hysteresis: int = 3
    alpha: float = 0.3
    commit_records: int = 64
    adaptive_filters: bool = True


def first_full_level(spark: SparkSession, root: str, strategy: str, config: Config) -> int | None:
    full = ops.level_full(store.manifest(spark, root), config.memtable_keys, strategy).where("is_full")
    return full.agg(F.min("level")).first()[0]


def _publish(spark: SparkSession, root: str, kept: DataFrame, made: list[dict], flushed: int | None = None) -> int:
    rows = [tuple(m[c] for c in kept.columns) for m in made]
    return store.publish(spark, root, kept.unionByName(spark.createDataFrame(rows, kept.schema)), flushed)


def _merge_into(spark: SparkSession, root: str, inputs: DataFrame, level: int, bottom: bool) -> int:
    """Merges the runs of a part of the manifest into one run of level and publishes."""
    m = store.manifest(spark, root)
    paths = [r.path for r in inputs.select("path").collect()]  # a row a run
    run_id = 1 + m.agg(F.max("run_id")).first()[0]
    made = store.write_run(ops.merge(store.read_paths(spark, root, paths), bottom), root, level, run_id)
    return _publish(spark, root, m.where(~F.col("path").isin(paths)), [made] if made["num_entries"] else [])


def round_once(spark: SparkSession, root: str, strategy: str = "HYBRID", config: Config | None = None) -> int | None:
    """Compacts the first full level and publishes; None if no level is full or nothing was merged."""
    config = config or Config()
    level = first_full_level(spark, root, strategy, config)
    if level is None:
        return None
    m = store.manifest(spark, root)
    leveling = strategy == "LEVELING" or strategy == "HYBRID" and level + 1 >= config.levels - 1
    here = m.where(F.col("level") == level)
    if not leveling:  # few and small runs stay as they are
        most_runs = next(n for name, n, _ in ops.STRATEGIES if name == strategy)
        size = here.agg(F.count("*"), F.sum("num_entries")).first()
        if size[0] < most_runs and size[1] <= size[0] * 4000:
            return None
    bottom = leveling and m.where(F.col("level") > level + 1).count() == 0
    return _merge_into(spark, root, m.where(F.col("level").isin(level, level + 1)) if leveling else here, level + 1, bottom)


def compact_range(spark: SparkSession, root: str, level: int, start: int, end: int) -> int | None:
    """Merges the runs of level that overlap [start, end] into one of the next level and publishes."""
    chosen = ops.overlapping(store.manifest(spark, root), start, end).where(F.col("level") == level)
    return _merge_into(spark, root, chosen, level + 1, False) if chosen.count() else None


def append(log: DataFrame, root: str) -> tuple[int, int]:
    """Appends a slice (key, seq, op, value) to the log; returns its first and last seq."""
    edge = log.agg(F.min("seq"), F.max("seq")).first()
    if edge[0] is None:
        return -1, -1
    log.select("key", "seq", "op", "value").write.mode("overwrite").parquet(f"{root}/log/{edge[0]}-{edge[1]}")  # a slice written again replaces itself
    return edge[0], edge[1]


def _slices(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    return sorted(tuple(map(int, n.split("-"))) for n in store._names(spark, f"{root}/log"))


def log_tail(spark: SparkSession, root: str) -> DataFrame:
    """What recovery replays: the log after the flushed seq."""
    flushed = store.flushed_seq(spark, root)
    paths = [f"{root}/log/{a}-{b}" for a, b in _slices(spark, root) if b > flushed]
    if not paths:
        return spark.createDataFrame([], "key bigint, seq bigint, op string, value string")
    return spark.read.parquet(*paths).where(F.col("seq") > flushed)


def opened(spark: SparkSession, root: str) -> DataFrame:
    """All versions that the store holds (key, seq, op, value): its runs and the tail of its log."""
    return store.read_runs(spark, root).select("key", "seq", "op", "value").unionByName(log_tail(spark, root))


def state(spark: SparkSession, root: str) -> DataFrame:
    """(key, value) of the live keys."""
    return resolve.live(opened(spark, root))


def truncate(spark: SparkSession, root: str) -> int:
    """Deletes the slices of the log that are flushed as a whole; returns how many."""
    flushed, gone = store.flushed_seq(spark, root), 0
    for a, b in _slices(spark, root):
        if b <= flushed:
            p, fs = store._fs(spark, f"{root}/log/{a}-{b}")
            gone += bool(fs.delete(p, True))
    return gone


def flush(spark: SparkSession, root: str) -> dict | None:
    """Writes the tail of the log as a run of level 0, publishes and truncates; the run's row and its seconds."""
    began = time.time()
    tail = log_tail(spark, root)
    last = tail.agg(F.max("seq")).first()[0]
    if last is None:
        return None
    m = store.manifest(spark, root)
    run_id = 1 + (m.agg(F.max("run_id")).first()[0] if m.count() else -1)
    made = store.write_run(ops.merge(tail), root, 0, run_id)
    written = time.time()
    _publish(spark, root, m, [made], last)
    truncate(spark, root)
    return made | {"write_s": written - began, "total_s": time.time() - began}


def flush_log(log: DataFrame, root: str, run_id: int, parts: int | None = None) -> int:
    """Writes a log slice as a run of level 0 and publishes it."""
    spark = log.sparkSession
    made = store.write_run(ops.merge(log), root, 0, run_id, parts)
    return _publish(spark, root, store.manifest(spark, root), [made])


@dataclass
class Maintenance:
    """Rounds over a store: signals, the policy's step, one compaction, then the filters anew."""

    spark: SparkSession
    root: str
    config: Config = field(default_factory=Config)
    strategy: str = "HYBRID"
    cooldown: int = 0
    switches: int = 0
    velocity: float = 0.0

    def flushed(self, size_bytes: int, seconds: float) -> None:
        """Takes a flush into the smoothed write velocity."""
        if seconds > 0:
            self.velocity = self.config.alpha * size_bytes / seconds + (1 - self.config.alpha) * self.velocity

    def round(self, skew: float, accesses: DataFrame | None = None) -> dict:
        """One round; the decision, the published version if any, and the filters (level, entries, blocks, bits, k)."""
        c = self.config
        full = first_full_level(self.spark, self.root, self.strategy, c)
        self.strategy, self.cooldown, change, why = policy.step(
            self.strategy, self.cooldown, self.velocity > c.velocity_threshold, skew > c.skew_threshold, full is not None, c.hysteresis
        )
        self.switches += change
        version = round_once(self.spark, self.root, self.strategy, c)
        return {"strategy": self.strategy, "reason": why, "transition": change, "version": version, "filters": self.filters(accesses)}

    def filters(self, accesses: DataFrame | None = None) -> DataFrame:
        levels = store.manifest(self.spark, self.root).groupBy("level").agg(F.sum("num_entries").alias("entries"))
        none = self.spark.createDataFrame([], "level int, n bigint")
        return bloom.reallocate(levels, none if accesses is None else accesses, self.config.bits_per_key, self.config.filter_cap_bytes * 8, self.config.adaptive_filters)


class Background:
    """Runs a round of maintenance whenever one is asked for, one at a time, until stopped."""

    def __init__(self, work) -> None:
        self.work, self.done, self.failed = work, 0, None
        self._asked, self._stop = threading.Event(), False
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def request(self) -> None:
        self._asked.set()

    def _loop(self) -> None:
        while True:
            self._asked.wait()
            self._asked.clear()
            if self._stop:
                return
            try:
                self.work()
                self.done += 1
            except Exception as e:  # kept for stop(), which raises it
                self.failed = e
                return

    def stop(self) -> None:
        self._stop = True
        self._asked.set()
        self._thread.join()
        if self.failed is not None:
            raise self.failed
