"""The compaction policy: three strategies with hysteresis, as a fold over ordered signals.

A signal row has stream, i (order), velocity, skew and any_full. With a cooldown the state
is held and the cooldown shrinks; otherwise velocity > tau and any_full choose TIERING, else
skew > skew_limit LEVELING, else HYBRID, and a change sets the cooldown to hysteresis.
Streams and parameter sets fold in parallel; one stream is sequential by nature.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DECISION = (
    "i bigint, prev_strategy string, new_strategy string, velocity_condition boolean, skew_condition boolean, "
    "any_full boolean, cooldown int, transition boolean, reason string"
)


def step(state: str, cooldown: int, fast: bool, skewed: bool, full: bool, hysteresis: int) -> tuple[str, int, bool, str]:
    """The next state and cooldown, whether the state changed, and why."""
    if cooldown > 0:
        return state, cooldown - 1, False, f"cooldown={cooldown}"
    wanted, why = ("TIERING", "velocity+saturation") if fast and full else ("LEVELING", "high_skew") if skewed else ("HYBRID", "default")
    change = wanted != state
    return wanted, hysteresis if change else 0, change, why


def trace(signals: DataFrame, *by: str) -> DataFrame:
    """A row per decision. signals: by..., i, velocity, skew, any_full, tau, skew_limit, hysteresis.

    Streams are hashed to tasks and sorted by i there; a task holds one state, and decisions
    stream through it in Arrow batches. A change of by begins anew from HYBRID: a reset is a
    new group.
    """
    rows = signals.select(
        *by, F.col("i").cast("bigint").alias("i"), (F.col("velocity") > F.col("tau")).alias("_fast"), (F.col("skew") > F.col("skew_limit")).alias("_skewed"),
        F.col("any_full").alias("_full"), F.col("hysteresis").cast("int").alias("_h"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # a column of their own, so that by may be in the output and hold nulls
    rows = rows.withColumn("_stream", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")).repartition("_stream").sortWithinPartitions("_stream", "i")
    n = len(by)

    def run(batches):
        at, state, cooldown = None, "HYBRID", 0
        for batch in batches:
            out = []
            for i, fast, skewed, full, h, stream in zip(*(batch.column(n + k).to_pylist() for k in range(6))):
                if stream != at:
                    at, state, cooldown = stream, "HYBRID", 0
                new, left, change, why = step(state, cooldown, bool(fast), bool(skewed), bool(full), h)
                out.append((i, state, new, fast, skewed, full, cooldown, change, why))
                state, cooldown = new, left
            columns = list(zip(*out)) if out else [[]] * 9
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*by, *[x.split()[0] for x in _DECISION.split(", ")]])

    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], _DECISION]))


def counts(decisions: DataFrame, reported: int, *by: str) -> DataFrame:
    """(by, total, delta, current): all switches, those after decision reported, and the strategy now."""
    return decisions.groupBy(*by).agg(
        F.count_if("transition").alias("total"), F.count_if(F.col("transition") & (F.col("i") > reported)).alias("delta"), F.max_by("new_strategy", "i").alias("current"),
    )


def with_resets(signals: DataFrame, resets: list[int]) -> DataFrame:
    """signals with the column era: each of the ascending resets begins a new one, which trace() folds anew."""
    era = F.lit(0)
    for i in resets:
        era = era + F.when(F.col("i") >= i, 1).otherwise(0)
    return signals.withColumn("era", era)


def switches(decisions: DataFrame) -> DataFrame:
    return decisions.where("transition")


def last_decision(decisions: DataFrame, *by: str) -> DataFrame:
    cols = [c for c in decisions.columns if c not in by]
    return decisions.groupBy(*by).agg(F.max_by(F.struct(*cols), "i").alias("d")).select(*by, "d.*")


def sweep(signals: DataFrame, taus: list[float], hysteresis: list[int], skew_limit: float) -> DataFrame:
    """(tau, hysteresis, switches) over all pairs of parameters: every signal row explodes to a fixed number of sets."""
    sets = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(h).alias("hysteresis")) for t in taus for h in hysteresis])
    rows = signals.withColumn("set", F.explode(sets)).select("*", "set.*").withColumn("skew_limit", F.lit(skew_limit))
    return trace(rows, "tau", "hysteresis").groupBy("tau", "hysteresis").agg(F.count_if("transition").alias("switches"))
