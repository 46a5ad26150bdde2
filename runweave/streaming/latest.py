"""Latest live state of a stream of operations.

Each micro-batch becomes one run, named by its batch id, so a batch that is delivered again
overwrites itself. State is the resolution of all runs; compaction() merges finished ones. Records
out of order do no harm: the greatest seq of a key wins, whatever arrived first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runweave.operators import policy, resolve
from runweave.operators.runs import merge
from runweave.session import ship_code

LOG = "key bigint, seq bigint, op string, value string"


def start(log: DataFrame, root: str, once: bool = True) -> StreamingQuery:
    """Flushes each micro-batch of a streaming log to root/runs/<batch id>; the checkpoint is root/checkpoint."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        won = merge(batch)
        won.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{root}/runs/batch={batch_id}")

    writer = log.writeStream.foreachBatch(flush).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def state(spark: SparkSession, root: str) -> DataFrame:
    """key, value of the live keys after all finished batches."""
    return resolve.live(_runs(spark, root))


def _runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{LOG}, batch bigint").parquet(f"{root}/runs")


def compaction(spark: SparkSession, root: str, upto: int) -> None:
    """Merges the runs of the batches up to upto, which must be finished, into the run of upto.

    Tombstones stay: an older record may still arrive. The merged run stands aside first and
    takes its place by a rename; the runs it replaces go afterwards, and until then they only
    repeat what it holds.
    """
    merged = merge(_runs(spark, root).where(F.col("batch") <= upto))
    aside = f"{root}/merged-{upto}"
    merged.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(aside)
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path(f"{root}/runs"))]
    old = [n for n in found if n.startswith("batch=") and int(n.split("=")[1]) <= upto]
    if not fs.rename(path(aside), path(f"{root}/runs/batch=-{upto + 1}")):
        raise RuntimeError("the merged run could not take its place")
    for n in old:
        fs.delete(path(f"{root}/runs/{n}"), True)


def latest_stateful(log: DataFrame) -> DataFrame:
    """(key, seq, op, value): an update whenever a key's newest version changes, with state per key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def newest(key, frames, held: GroupState):
        import pandas as pd

        best = held.get if held.exists else None
        changed = False
        for f in frames:
            if len(f):
                at = f["seq"].to_numpy().argmax()
                seq, op, value = f["seq"].iloc[at], f["op"].iloc[at], f["value"].iloc[at]
                if best is None or seq > best[0]:
                    best, changed = (int(seq), op, value), True
        if changed:
            held.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": [best[1]], "value": [best[2]]})

    ship_code(log.sparkSession)
    return log.groupBy("key").applyInPandasWithState(newest, LOG, "seq bigint, op string, value string", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 hour", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """(start, event_type, n) per window of ts, closed by the watermark: tumbling, sliding (slide) or by session (gap)."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.session_window("ts", gap) if gap else F.window("ts", width, slide) if slide else F.window("ts", width)
    return d.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def policy_decisions(signals: DataFrame) -> DataFrame:
    """Decisions of a finite slice of signals; a continuous one folds each stream's slice with its last state."""
    return policy.trace(signals, "stream")
