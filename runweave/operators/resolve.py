"""Resolution of versions and the reads on top of it.

An operation log has key, seq (unique in a key), op (PUT or DELETE) and value. The newest
version of a key wins; a DELETE hides it. Filters on key may stand before or after
resolution (Catalyst pushes them through the aggregate); filters on value must not stand
before it, as they could expose an older version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.operators.order import in_ranges


def latest(log: DataFrame, *carry: str) -> DataFrame:
    """The newest version of each key: key, op, value and carry. Partial aggregates before the shuffle."""
    cols = ["op", "value", *carry]
    won = log.groupBy("key").agg(F.max_by(F.struct(*cols), "seq").alias("v"))
    return won.select("key", *[F.col(f"v.{c}").alias(c) for c in cols])


def live(log: DataFrame) -> DataFrame:
    return latest(log).where("op <> 'DELETE'").select("key", "value")


def get(log: DataFrame, key: int) -> DataFrame:
    """The live value of one key; no row if it is absent or deleted."""
    return live(log).where(F.col("key") == key)


def get_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, value, found for every requested key. The join is Catalyst's choice: keys are broadcast if small."""
    keys = keys.select("key").distinct()
    hits = live(log.join(keys, "key", "left_semi"))
    return keys.join(hits.withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scan(log: DataFrame, start: int, end: int) -> DataFrame:
    """Live keys in [start, end], in order."""
    return live(log).where(F.col("key").between(start, end)).orderBy("key")


def scan_many(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """(scan_id, key, value) of live keys in each of ranges (scan_id, start, end): a range join by buckets of keys."""
    return in_ranges(live(log), ranges, "key", "start", "end").select("scan_id", "key", "value")


def missing(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The requested keys that are absent or deleted: an anti-join."""
    keys = keys.select("key").distinct()
    return keys.join(live(log.join(keys, "key", "left_semi")), "key", "left_anti")


def deleted(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a DELETE."""
    return latest(log).where("op = 'DELETE'").select("key")


def fold_rmw(log: DataFrame, is_rmw: Column, suffix: str = "_u") -> DataFrame:
    """Live values after ordered PUT, DELETE and read-modify-write operations.

    A read-modify-write of a live key appends suffix to its value and does nothing
    otherwise. So a live value is that of the last PUT or DELETE, with suffix once for each
    later RMW: two aggregates, each partial before its shuffle; a key of any size takes one row.
    """
    tagged = log.select("key", "seq", "op", "value", is_rmw.alias("rmw"))
    base = tagged.where("not rmw").groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("b"), F.max("seq").alias("base_seq"))
    later = tagged.where("rmw").select("key", "seq").join(base.select("key", "base_seq"), "key").where("seq > base_seq").groupBy("key").agg(F.count("*").alias("n"))
    got = base.join(later, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return got.where("b.op = 'PUT'").select("key", F.concat("b.value", F.repeat(F.lit(suffix), F.col("n").cast("int"))).alias("value"))


def memtable_full(log: DataFrame, capacity: int) -> DataFrame:
    """unique_keys and is_full of a memtable that holds the whole log."""
    return log.agg(F.countDistinct("key").alias("unique_keys")).withColumn("is_full", F.col("unique_keys") >= capacity)
