"""Adapters from tables to operation logs (key, seq, op, value), and the log's own accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.operators.order import ranked

#: Bytes of a log record beside its value: type, key and length.
RECORD_BYTES = 13


def from_events(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("value"))


def from_orders(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit("PUT").alias("op"), F.col("o_orderstatus").alias("value"))


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Line numbers are not unique within an order: the order of versions takes four columns."""
    seq = F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return lineitem.select(F.col("l_orderkey").alias("key"), seq.alias("seq"), F.lit("PUT").alias("op"), F.col("l_returnflag").alias("value"))


def put(key: Column, seq: Column, value: Column) -> list[Column]:
    return [key.alias("key"), seq.alias("seq"), F.lit("PUT").alias("op"), value.alias("value")]


def delete(key: Column, seq: Column) -> list[Column]:
    """A tombstone, whether or not the key exists; an empty PUT value stays a value."""
    return [key.alias("key"), seq.alias("seq"), F.lit("DELETE").alias("op"), F.lit(None).cast("string").alias("value")]


def group_commits(log: DataFrame, records: int = 64) -> DataFrame:
    """(batch, records, bytes): a commit after each so many records, in order of a BIGINT seq that may have gaps."""
    batch = F.floor(F.col("_place") / records).cast("bigint").alias("batch")
    return ranked(log, "seq", "_place").groupBy(batch).agg(F.count("*").alias("records"), F.sum(RECORD_BYTES + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"))


def tail(log: DataFrame, flushed: int) -> DataFrame:
    """What recovery replays: the records after the flushed one."""
    return log.where(F.col("seq") > flushed)


def totals(log: DataFrame, records: int = 64) -> DataFrame:
    return group_commits(log, records).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("commits"), F.sum("records").alias("records"))
