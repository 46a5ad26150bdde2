"""Result tables and workload settings as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions.scalar import scale_label

RESULTS = (
    "scale int, run_id int, config string, workload string, throughput_ops_s double, waf double, raf double, saf double, "
    "bloom_fpr double, p50_us double, p99_us double, p999_us double, switches int, elapsed_s double, outlier string"
)
EXTERNAL = "scale int, run_id int, workload string, throughput_kops double, p50_us double, p99_us double, elapsed_s double, ok int"


def read_results(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    """Benchmark rows; malformed ones are skipped."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value) of 'name = value' lines; text after # is a comment."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("line"))
    return lines.where(F.col("line").contains("=")).select(
        "file", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("name"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("value")
    )


def write_settings(configs: DataFrame, root: str) -> None:
    """Writes a text file of 'name = value' lines for each row of workload.configs(): root/workload=<name>/scale=<label>."""
    named = [c for c in configs.columns if c != "name"]
    lines = [F.concat(F.lit(f"{c} = "), F.col(c).cast("string")) for c in named]
    body = F.concat_ws("\n", F.concat(F.lit("# workload "), F.col("name")), F.concat(F.lit("workload_name = "), F.col("name")), *lines)
    rows = configs.select(body.alias("value"), F.col("name").alias("workload"), scale_label(F.col("num_ops")).alias("scale"))
    rows.repartition("workload", "scale").write.partitionBy("workload", "scale").mode("overwrite").text(root)


def run_info(spark: SparkSession) -> DataFrame:
    """One row about where a result comes from: version, master, parallelism, time zone and time."""
    sc = spark.sparkContext
    return spark.range(1).select(
        F.lit(spark.version).alias("spark"), F.lit(sc.master).alias("master"), F.lit(sc.defaultParallelism).alias("parallelism"),
        F.lit(spark.conf.get("spark.sql.session.timeZone")).alias("time_zone"), F.current_timestamp().alias("at"),
    )


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table of at most so many report rows."""
    cols = rows.columns
    body = ["| " + " | ".join(str(r[c]) for c in cols) + " |" for r in rows.limit(most).collect()]
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *body])
