"""Benchmark workloads: the mixes, seeded operation streams and Zipf key draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runweave.functions.hashing import hash64, unsigned_mod

# name, theta, read, update, insert, scan, delete; what is left is read-modify-write (fixed values).
# E is the effective mix of the published runs; E_intended is the one its label names.
MIXES = [
    ("A", 0.99, 0.5, 0.5, 0.0, 0.0, 0.0),
    ("B", 0.99, 0.95, 0.05, 0.0, 0.0, 0.0),
    ("C", 0.99, 1.0, 0.0, 0.0, 0.0, 0.0),
    ("D", 0.0, 0.95, 0.0, 0.05, 0.0, 0.0),
    ("E", 0.99, 0.0, 0.5, 0.05, 0.45, 0.0),
    ("E_intended", 0.99, 0.0, 0.0, 0.05, 0.95, 0.0),
    ("F", 0.99, 0.5, 0.0, 0.0, 0.0, 0.0),
    ("W", 0.99, 0.01, 0.99, 0.0, 0.0, 0.0),
    ("RW", 0.99, 0.5, 0.5, 0.0, 0.0, 0.0),
    ("RSW", 0.99, 0.25, 0.25, 0.0, 0.5, 0.0),
    ("RS", 0.99, 0.47, 0.47, 0.0, 0.06, 0.0),
    ("R", 0.99, 0.95, 0.05, 0.0, 0.0, 0.0),
]
SCALES = [100_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 15_000_000]


def configs(spark: SparkSession, scales: list[int] | None = None) -> DataFrame:
    """A row per mix and scale: load of ops / 2, key space max(1M, 2 * ops), scans of up to 100 keys."""
    mixes = spark.createDataFrame(MIXES, "name string, theta double, read double, update double, insert double, scan double, delete double")
    sizes = F.explode(F.array(*[F.lit(s).cast("bigint") for s in scales or SCALES]))
    return mixes.withColumn("num_ops", sizes).select(
        "*", F.floor(F.col("num_ops") / 2).cast("bigint").alias("record_count"), F.greatest(F.lit(1_000_000), F.col("num_ops") * 2).cast("bigint").alias("key_space"),
        (1 - F.col("read") - F.col("update") - F.col("insert") - F.col("scan") - F.col("delete")).alias("rmw"), F.lit(100).alias("scan_length"),
    )


def op_type(draw: Column, read: float, update: float, insert: float, scan: float, delete: float) -> Column:
    """The operation of a uniform draw in [0, 1), by cumulative shares in this order."""
    edge, out = 0.0, None
    for name, share in (("READ", read), ("UPDATE", update), ("INSERT", insert), ("SCAN", scan), ("DELETE", delete)):
        edge += share
        out = F.when(draw < edge, name) if out is None else out.when(draw < edge, name)
    return out.otherwise("RMW")


def zeta(spark: SparkSession, items: int, theta: float) -> float:
    """The sum of 1 / i^theta for i from 1 to items."""
    return spark.range(1, items + 1).agg(F.sum(1 / F.pow(F.col("id"), F.lit(theta)))).first()[0]


def zipf_rank(u: Column, items: int, theta: float, zeta_n: float) -> Column:
    """The rank, from 0, of a uniform draw, by the usual bounded approximation."""
    zeta_2 = 1 + 0.5**theta
    alpha, eta = 1 / (1 - theta), (1 - (2 / items) ** (1 - theta)) / (1 - zeta_2 / zeta_n)
    uz = u * zeta_n
    rest = F.floor(items * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.least(F.when(uz < 1, 0).when(uz < zeta_2, 1).otherwise(rest), F.lit(items - 1)).cast("bigint")


def with_draw(d: DataFrame, name: str, seed: int) -> DataFrame:
    """Adds a uniform draw in [0, 1) that depends on id and seed alone, whatever the partitioning."""
    return d.withColumn(name, F.shiftrightunsigned(hash64(F.col("id") * F.lit(1 << 20) + F.lit(seed)), 11) / F.lit(float(1 << 53)))


def generate(spark: SparkSession, name: str, num_ops: int, seed: int = 42, theta: float | None = None) -> DataFrame:
    """(seq, op, key, scan_end): a seeded stream of the mix, made where it is used; theta replaces the mix's own."""
    _, own, *mix = next(m for m in MIXES if m[0] == name)
    theta = own if theta is None else theta
    key_space = max(1_000_000, 2 * num_ops)
    d = spark.range(num_ops)
    for k, draw in enumerate("ruw"):
        d = with_draw(d, draw, seed + k)
    d = d.withColumnRenamed("id", "seq")
    rank = F.floor(F.col("u") * key_space).cast("bigint") if theta == 0 else zipf_rank(F.col("u"), key_space, theta, zeta(spark, key_space, theta))
    d = d.withColumn("rank", rank).withColumn("h", hash64(F.col("rank"))).withColumn("key", unsigned_mod(F.col("h"), key_space) + 1).withColumn("op", op_type(F.col("r"), *mix))
    end = F.when(F.col("op") == "SCAN", F.col("key") + 1 + F.floor(F.col("w") * 100)).otherwise(F.lit(0)).cast("bigint")
    return d.select("seq", "op", "key", end.alias("scan_end"))


def load(spark: SparkSession, num_ops: int, seed: int = 99) -> DataFrame:
    """(seq, op, key) of ops / 2 inserts with uniform keys, repeats possible."""
    key_space = max(1_000_000, 2 * num_ops)
    d = with_draw(spark.range(num_ops // 2), "u", seed)
    return d.select(F.col("id").alias("seq"), F.lit("INSERT").alias("op"), (F.floor(F.col("u") * key_space) + 1).cast("bigint").alias("key"))


def as_log(ops: DataFrame, first_seq: int = 0) -> DataFrame:
    """The operation log (key, seq, op, value) of a stream: inserts and updates put "v<key>", RMW marks its key, reads leave no row."""
    kinds = F.when(F.col("op").isin("INSERT", "UPDATE"), "PUT").when(F.col("op") == "DELETE", "DELETE").when(F.col("op") == "RMW", "RMW")
    d = ops.select("key", (F.col("seq") + first_seq).alias("seq"), kinds.alias("op"))
    return d.where("op is not null").withColumn("value", F.when(F.col("op") == "PUT", F.concat(F.lit("v"), F.col("key").cast("string"))))


def run(spark: SparkSession, name: str, num_ops: int, seed: int = 42) -> DataFrame:
    """One row: what a run of a mix over its load does: operations by kind, reads that find a key, live keys after it.

    Reads see the load and all writes before them, so a read is answered by the newest
    version with a smaller seq: versions and reads of a key are counted in one order.
    """
    loaded = load(spark, num_ops)
    n = num_ops // 2
    ops = generate(spark, name, num_ops, seed)
    every = loaded.select("key", "seq", "op").unionByName(ops.select("key", (F.col("seq") + n).alias("seq"), "op"))
    writes = F.col("op").isin("INSERT", "UPDATE", "DELETE")
    before = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    seen = every.withColumn("last", F.last(F.when(writes, F.col("op")), True).over(before))
    live = F.coalesce(F.col("last") != "DELETE", F.lit(False))
    asked = F.col("op").isin("READ", "RMW")
    kinds = [F.count_if((F.col("op") == k) & (F.col("seq") >= n)).alias(k.lower()) for k in ("READ", "UPDATE", "INSERT", "SCAN", "DELETE", "RMW")]
    newest = every.where(writes).groupBy("key").agg(F.max_by("op", "seq").alias("op")).where("op <> 'DELETE'").agg(F.count("*").alias("live_keys"))
    return seen.agg(*kinds, F.count_if(asked & live).alias("hits")).crossJoin(newest).withColumn("name", F.lit(name)).withColumn("num_ops", F.lit(num_ops))  # one row each
