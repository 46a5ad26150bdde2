"""Sorted runs on storage: immutable Parquet folders under a manifest of versions.

A compaction writes its output first and then publishes a manifest that names it and drops
its inputs; readers keep the version they opened, and unreferenced folders are collected
afterwards. A version is one small file, created only if it does not exist yet, that names
the folder with its rows; paths are relative to the root, so a store may be moved or opened
under another spelling of its path. A version also says up to which seq the log is flushed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "level int, run_id bigint, path string, min_key bigint, max_key bigint, num_entries bigint"
ROW = "key bigint, op string, value string, seq bigint"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published manifest versions, oldest first."""
    return sorted(int(n) for n in _names(spark, f"{root}/manifest/versions") if n.isdigit())


def _head(spark: SparkSession, root: str, version: int) -> dict:
    p, fs = _fs(spark, f"{root}/manifest/versions/{version}")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """level, run_id, path (relative to root), min_key, max_key, num_entries of a version, by default the last."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/{_head(spark, root, known[-1] if version is None else version)['rows']}")


def flushed_seq(spark: SparkSession, root: str) -> int:
    """The seq up to which the log stands in runs; -1 before the first flush."""
    known = versions(spark, root)
    return _head(spark, root, known[-1])["flushed"] if known else -1


def publish(spark: SparkSession, root: str, rows: DataFrame, flushed: int | None = None, after: int | None = None) -> int:
    """Publishes the next version, or fails if another writer was first.

    after: the version that rows were made from; by default the last one.
    """
    known = versions(spark, root)
    last = (known or [-1])[-1] if after is None else after
    if flushed is None:
        flushed = _head(spark, root, last)["flushed"] if last >= 0 else -1
    folder = f"rows-{uuid.uuid4().hex}"
    rows.select(*[x.split()[0] for x in _MANIFEST.split(", ")]).coalesce(1).write.parquet(f"{root}/manifest/{folder}")  # a row a run
    p, fs = _fs(spark, f"{root}/manifest/versions/{last + 1}")
    try:
        stream = fs.create(p, False)  # only if it is not there
    except Exception as e:
        raise RuntimeError(f"manifest {last + 1} was published by another writer") from e
    try:
        stream.write(bytearray(json.dumps({"rows": folder, "flushed": flushed}).encode()))
    finally:
        stream.close()
    return last + 1


def write_run(rows: DataFrame, root: str, level: int, run_id: int, parts: int | None = None) -> dict:
    """Writes a run range-partitioned and sorted by key and returns its manifest row.

    Without parts, adaptive execution sizes the ranges by bytes. Bounds and count are
    observed while the rows are written.
    """
    path = f"runs/level={level}/run_id={run_id}"
    seen = Observation()
    ranged = rows.repartitionByRange("key") if parts is None else rows.repartitionByRange(parts, "key")
    counted = ranged.sortWithinPartitions("key").observe(seen, F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").parquet(f"{root}/{path}")
    m = seen.get
    return {"level": level, "run_id": run_id, "path": path, "min_key": m["a"], "max_key": m["b"], "num_entries": m["n"]}


def read_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """level, run_id, key, op, value, seq of some runs."""
    if not paths:
        return spark.createDataFrame([], f"{ROW}, level int, run_id bigint")
    return spark.read.schema(f"{ROW}, level int, run_id bigint").option("basePath", f"{root}/runs").parquet(*[f"{root}/{p}" for p in paths])


def read_runs(spark: SparkSession, root: str, version: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """level, run_id, key, op, value, seq of the runs of a version; runs outside [start, end] are not opened."""
    m = manifest(spark, root, version)
    if start is not None:
        m = m.where((F.col("max_key") >= start) & (F.col("min_key") <= end))
    d = read_paths(spark, root, [r.path for r in m.select("path").collect()])  # a row a run
    return d if start is None else d.where(F.col("key").between(start, end))


def collect_garbage(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes run folders that none of the last keep manifests names; returns how many.

    Run ids only grow: a folder with a greater id than any published one may be a run that a
    writer has not published yet, and stays.
    """
    kept = [r for v in versions(spark, root)[-keep:] for r in manifest(spark, root, v).select("path", "run_id").collect()]
    named, newest = {r.path for r in kept}, max((r.run_id for r in kept), default=-1)
    gone = 0
    for level in _names(spark, f"{root}/runs"):
        for run in _names(spark, f"{root}/runs/{level}"):
            if f"runs/{level}/{run}" not in named and run.startswith("run_id=") and int(run.split("=")[1]) <= newest:
                p, fs = _fs(spark, f"{root}/runs/{level}/{run}")
                fs.delete(p, True)
                gone += 1
    return gone
