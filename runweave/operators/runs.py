"""Sorted runs: flushing, metadata, pruning, compaction and level state.

A run is a set of versions with a run_id (later runs are newer) and a level. Merging keeps,
per key, the version of the greatest seq; tombstones stay unless the output is the lowest
level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators import bloom
from runweave.operators.order import in_ranges

#: Strategy, most runs a level, capacity multiplier (fixed values).
STRATEGIES = [("LEVELING", 2, 3), ("HYBRID", 4, 4), ("TIERING", 8, 8)]


def flush(log: DataFrame, rows_per_run: int) -> DataFrame:
    """One version per key and run; the run of a row is seq div rows_per_run."""
    run = F.floor(F.col("seq") / rows_per_run).cast("bigint")
    won = log.withColumn("run_id", run).groupBy("run_id", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("v"), F.max("seq").alias("seq"))
    return won.select("run_id", "key", "v.op", "v.value", "seq")


def metadata(runs: DataFrame, *by: str) -> DataFrame:
    """min_key, max_key, num_entries and tombstones of each run."""
    return runs.groupBy(*(by or ["run_id"])).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("num_entries"), F.count_if(F.col("op") == "DELETE").alias("tombstones"),
    )


def zone_probe(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, run_id) of runs whose key range holds the key, by buckets of keys."""
    return in_ranges(keys.select("key"), meta.select("run_id", "min_key", "max_key"), "key", "min_key", "max_key").select("key", "run_id")


def overlapping(meta: DataFrame, start: int, end: int) -> DataFrame:
    return meta.where((F.col("max_key") >= start) & (F.col("min_key") <= end))


def level_filters(runs: DataFrame, bits_per_key: int) -> tuple[DataFrame, DataFrame]:
    """(level, entries, blocks) and the filters (level, block, have) over all keys of each level, tombstones too."""
    levels = runs.groupBy("level").agg(F.count("*").alias("entries"))
    levels = levels.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("entries") * bits_per_key / bloom.BLOCK_BITS)).cast("bigint"))
    k = bloom.best_hashes(bits_per_key)
    keys = runs.select("level", "key").join(F.broadcast(levels.select("level", "blocks")), "level")  # a row a level
    return levels, bloom.build(keys, F.col("blocks"), k, "level")


def probe_path(runs: DataFrame, meta: DataFrame, keys: DataFrame, bits_per_key: int = 14) -> DataFrame:
    """What a lookup of each key does: levels from the first, the level's filter, then its runs newest first.

    key, found_level, found_run, op (null if absent), level_probes, run_probes, false_positives.
    A run is probed if its key range holds the key. The first version found ends the search,
    a tombstone too; a level whose filter says maybe and has no version is a false positive.
    meta: level, run_id, min_key, max_key.
    """
    levels, filters = level_filters(runs, bits_per_key)
    hits = runs.join(keys.select("key").distinct(), "key", "left_semi").select("key", "level", "run_id", "op")
    first = hits.groupBy("key").agg(F.min_by(F.struct("level", "run_id", "op"), F.struct("level", -F.col("run_id"))).alias("hit"))
    found = keys.select("key").distinct().join(first, "key", "left").select("key", "hit.level", "hit.run_id", "hit.op").toDF("key", "found_level", "found_run", "op")
    asked = found.crossJoin(F.broadcast(levels.select("level", "blocks")))  # a row a level
    asked = asked.where("found_level is null or level <= found_level").select("key", "level", "blocks", "found_level")
    tested = bloom.test(filters, asked, F.col("blocks"), bloom.best_hashes(bits_per_key), "level")
    inside = in_ranges(found, meta.select("level", "run_id", "min_key", "max_key"), "key", "min_key", "max_key")
    inside = inside.where("found_level is null or level < found_level or (level = found_level and run_id >= found_run)")
    probed = inside.groupBy("key", "level").agg(F.count("*").alias("runs"))
    steps = tested.join(probed, ["key", "level"], "left").groupBy("key").agg(
        F.count("*").alias("level_probes"), F.coalesce(F.sum(F.when(F.col("maybe"), F.col("runs"))), F.lit(0)).cast("bigint").alias("run_probes"),
        F.count_if(F.col("maybe") & (F.col("found_level").isNull() | (F.col("level") < F.col("found_level")))).alias("false_positives"),
    )
    return found.join(steps, "key")


def merge(runs: DataFrame, bottom: bool = False) -> DataFrame:
    """key, op, value, seq of the newest version of each key; tombstones go only at the bottom."""
    won = runs.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("v"), F.max("seq").alias("seq"))
    out = won.select("key", "v.op", "v.value", "seq")
    return out.where("op <> 'DELETE'") if bottom else out


def compact_level(runs: DataFrame, level: int, bottom: bool = False) -> DataFrame:
    """All runs of level and the next merged into one run of the next; others unchanged."""
    both = F.col("level").isin(level, level + 1)
    return _replaced(runs, both, level + 1, bottom)


def compact_tier(runs: DataFrame, level: int, most_runs: int, most_mean: int = 4000) -> DataFrame:
    """The level's runs merged into one further run of the next level, if there are most_runs or they are large.

    Whether to merge is decided in the plan, from an aggregate of one row.
    """
    here = F.col("level") == level
    size = runs.where(here).agg(F.countDistinct("run_id").alias("n"), F.count("*").alias("rows"))
    fires = size.select(((F.col("n") >= most_runs) | (F.col("rows") > F.col("n") * most_mean)).alias("fires"))
    tagged = runs.crossJoin(F.broadcast(fires))  # one row
    merged = _as_run(merge(tagged.where(here & F.col("fires"))), tagged.where(here & F.col("fires")), level + 1)
    return tagged.where(~(here & F.col("fires"))).select("level", "run_id", "key", "op", "value", "seq").unionByName(merged)


def compact_hybrid(runs: DataFrame, level: int, last_level: int, most_runs: int) -> DataFrame:
    """Tiering on all levels but the last, leveling into the last."""
    return compact_level(runs, level, bottom=True) if level + 1 >= last_level else compact_tier(runs, level, most_runs)


def compact_range(runs: DataFrame, meta: DataFrame, level: int, start: int, end: int) -> DataFrame:
    """Whole runs of level that overlap [start, end] (both included) merged into one of the next level."""
    chosen = overlapping(meta, start, end).select("run_id").withColumn("_in", F.lit(True))
    tagged = runs.join(chosen, "run_id", "left")
    return _replaced(tagged, (F.col("level") == level) & F.coalesce("_in", F.lit(False)), level + 1, False)


def _as_run(merged: DataFrame, inputs: DataFrame, level: int) -> DataFrame:
    newest = inputs.agg(F.max("run_id").alias("run_id"))
    return merged.crossJoin(F.broadcast(newest)).select(F.lit(level).alias("level"), "run_id", "key", "op", "value", "seq")  # one row


def _replaced(runs: DataFrame, chosen, level: int, bottom: bool) -> DataFrame:
    inputs = runs.where(chosen)
    rest = runs.where(~chosen).select("level", "run_id", "key", "op", "value", "seq")
    return rest.unionByName(_as_run(merge(inputs, bottom), inputs, level))


def level_full(meta: DataFrame, capacity: int, strategy: str = "HYBRID") -> DataFrame:
    """entries, runs and is_full of each level: capacity grows linearly with the level."""
    _, most_runs, times = next(s for s in STRATEGIES if s[0] == strategy)
    by = meta.groupBy("level").agg(F.sum("num_entries").alias("entries"), F.count("*").alias("runs"))
    full = (F.col("entries") > F.lit(capacity) * (F.col("level") + 1) * times) | (F.col("runs") > most_runs)
    return by.withColumn("is_full", full)


def physical_keys(meta: DataFrame) -> DataFrame:
    return meta.agg(F.sum("num_entries").alias("physical_keys"))
