"""Tables of benchmark results: the main table, the parameter sweep, the ablation.

Results have scale, run_id, config, workload and one column a metric; runs of two
configurations are paired by run_id, and a pairing that is not complete fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions.scalar import scale_label
from runweave.operators import stats


def main_table(results: DataFrame, metrics: list[str], base: str, other: str, external: DataFrame | None = None) -> DataFrame:
    """A row per scale, workload and metric: mean and sd of both configurations, the difference in percent, n, t and p.

    external (scale, workload, metric, value): rows of another store, looked up by scale,
    workload and metric; its mean and the difference to it are null where it has none.
    """
    long = results.select("scale", "workload", "config", "run_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x"))
    long = long.select("scale", "workload", "config", "run_id", "x.metric", "x.value")
    by = ["scale", "workload", "metric"]
    pairs = stats.pair(long.where(F.col("config") == other), long.where(F.col("config") == base), *by, "run_id")
    tested = stats.paired_p(pairs, *by).select(*by, "n", "t", "p")
    sides = long.groupBy(*by).agg(*[
        f(F.when(F.col("config") == c, F.col("value"))).alias(f"{name}_{what}")
        for name, c in (("base", base), ("other", other)) for what, f in (("mean", F.avg), ("sd", lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0))))
    ])
    change = lambda a, b: F.when(b > 0, (a - b) / b * 100).otherwise(F.lit(0.0))
    out = sides.join(tested, by).withColumn("diff_pct", change(F.col("other_mean"), F.col("base_mean"))).withColumn("significant", F.col("p") < 0.05)
    if external is not None:
        means = external.groupBy(*by).agg(F.avg("value").alias("external_mean"))
        out = out.join(means, by, "left").withColumn("external_pct", F.when(F.col("external_mean") > 0, change(F.col("other_mean"), F.col("external_mean"))))
    return out.withColumn("scale_label", scale_label(F.col("scale")))


def sweep_table(sweep: DataFrame) -> DataFrame:
    """(scale, scale_label, workload, hysteresis, tau, switches, throughput, waf): a row per point, means where it ran more often."""
    return sweep.groupBy("scale", "workload", "hysteresis", "tau").agg(
        F.avg("switches").alias("switches"), F.avg("throughput").alias("throughput"), F.avg("waf").alias("waf"),
    ).withColumn("scale_label", scale_label(F.col("scale")))


def ablation_table(results: DataFrame, factors: list[str], value: str) -> DataFrame:
    """A row per cell of the factors: n, mean, sd, and the change in percent against the cell of the least levels."""
    cells = stats.mean_sd(results, value, *factors)
    least = cells.orderBy(*factors).limit(1).select(F.col("mean").alias("_least"))  # the cell to compare with
    return cells.crossJoin(F.broadcast(least)).withColumn("change_pct", (F.col("mean") / F.col("_least") - 1) * 100).drop("_least")


def markdown(rows: DataFrame, title: str, digits: int = 2, most: int = 1000) -> str:
    """A report table: numbers rounded, nulls as N/A, at most so many rows."""
    def shown(x) -> str:
        return "N/A" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else "**Yes**" if x is True else "No" if x is False else str(x)

    cols = rows.columns
    body = ["| " + " | ".join(shown(r[c]) for c in cols) + " |" for r in rows.limit(most).collect()]
    return "\n".join([f"### {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *body])
