"""Shared helpers of the training-data operators: shared storage, text buffers, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.session import ship_code

#: The separators between words: ASCII space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def prepare(spark: SparkSession) -> SparkSession:
    """Readies a session: workers find the code, and Arrow batches of texts stay small in JVM and Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ship_code(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("runweave.shared.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="runweave-")
        spark.conf.set("runweave.shared.dir", path)
    return path.rstrip("/")


#: Tables that this process has made and not yet forgotten.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive executors."""
    path = new_path(df.sparkSession, name)
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of numbers, of a bound that the caller knows, as a literal of the plan."""
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = "array<struct<" + ", ".join(x.replace(" ", ": ", 1) for x in schema.split(", ")) + ">>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("row")).select("row.*")


def tables_made() -> int:
    return len(_MADE)


def forget_tables(spark: SparkSession, since: int) -> None:
    """Deletes the tables made after tables_made() was since: for callers who have written what was computed from them."""
    while len(_MADE) > since:
        drop_path(spark, _MADE.pop())


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more, before the next large shuffle."""
    gc.collect()
    spark._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- text buffers


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_string(column.type):
        column = column.fill_null("").cast(pa.large_string())
    else:
        column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each; a longer row is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def gathered(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """The batches joined to about limit bytes of text each, so that repeats within a task meet."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text_at).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(len(b) for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    trim()


def trim() -> None:
    """Gives memory that a task no longer uses back to the system: Python workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, text_at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most limit bytes of text (a longer row alone)."""
    _, offs = buffer(batch.column(text_at))
    for i, j in chunks(offs, limit):
        yield batch.slice(i, j - i)


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words come before each row (length rows + 1)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_IS_SPACE[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offs] = False  # a row's first byte starts a word even if the row before ended in one
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[offs[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 .. n (or more) of an odd base modulo 2^64, and their inverses; kept once for all hashes."""
    if not _POWERS or len(_POWERS[0]) <= n:
        n = max(n, 1 << 16)
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            out = np.full(n + 1, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(out, out=out))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes and lengths wherever they stand.

    Equal hashes prove nothing: long texts can be built that collide under every seed. What
    removes or joins texts compares their bytes or their names (word_ids) as well.
    """
    up, down = powers(len(data))
    letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed | 1))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each word: its bytes and their number up to 15 bytes, else 120 bits of BLAKE2b.

    Names of short words are equal only for equal words; two long words would have to collide
    in a cryptographic hash, and no long word has the name of a short one.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    low = eight[starts].view("<u8")[:, 0] & keep[np.minimum(size, 8)]
    more = np.clip(size - 8, 0, 7)
    high = eight[np.minimum(starts + 8, len(data))].view("<u8")[:, 0] & keep[more]
    high |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    far = np.flatnonzero(size > 15)
    if len(far):
        text = memoryview(np.ascontiguousarray(data))
        digests = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(starts[far].tolist(), ends[far].tolist()))
        found = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[far], high[far] = found[:, 0], found[:, 1] | (np.uint64(255) << np.uint64(56))
    return low, high


def word_hash(ids: tuple[np.ndarray, np.ndarray], seed: int) -> np.ndarray:
    """64-bit hashes of named words; hashes of different seeds are worked out from all 128 bits anew."""
    return mix(ids[0] ^ mix(ids[1] + np.uint64(seed)))


def row_hash(data: np.ndarray, offs: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of whole rows, worked out in pieces of bounded size."""
    out = [np.zeros(0, np.uint64)]
    for i, j in chunks(offs):
        o = offs[i : j + 1] - offs[i]
        out.append(span_hash(data[offs[i] : offs[j]], o[:-1], o[1:], seed))
    return np.concatenate(out)


def window_hash(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of width consecutive entries; len(words) - width + 1 of them (none if shorter)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(seed)) * up[: len(words)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])


# --------------------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of each connected component of the links (a, b).

    Alternates the large-star and small-star contractions; each round is a table in the
    shared folder, and only three numbers a round come to the driver. A node's minimum is a
    partial aggregate, and the join back to it can be split by adaptive execution, so a hub
    node does not land in one task. Nodes without links have no row.
    """
    spark = edges.sparkSession
    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    e, at = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    signature = None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own: the join to it can then be split at a hub
        least, least_at = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large, large_at = stored(
            both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e, new_at = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        for old in (at, least_at, large_at):  # nothing reads them any more
            drop_path(spark, old)
        at = new_at
        now = e.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.countDistinct("a")
        ).first()
        if now == signature:
            break
        signature = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
