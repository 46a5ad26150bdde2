"""Conflict-constrained best-fit packing of documents into bins of a fixed size.

Documents (sizes in words) longer than the capacity give full bins and a rest. Pieces go,
largest first, to the open bin with the least residual that holds them and conflicts with
nothing in it. Open bins stand in order of residual; each carries a bitmap of the duplicate
clusters in it and bitmaps of the sources in it at least once, twice, ... per_source times.
A bin conflicts if it has the piece's cluster, or its source per_source times already; the
search goes on to the next larger residual until a bin fits, and opens a new one if none
does.

Documents are dealt to shards of about shard_docs by the hash of all that is known of them,
copies by their number too, and each shard is packed on its own, so tasks stay the same size
at every input size, whatever ids repeat; conflicts are within bins, so shards do not touch
each other's. Only ids, sources, sizes and text hashes move.

Defined cases: null and empty texts are pieces of size 0 and get a bin; a null source is a
source; rows under a null or repeated doc_id are documents of their own; a document that
stands several times is a cluster, its copies go to different bins; very long texts give
full bins and a rest; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import parts, table
from runweave.llm.mixing import word_count

_OUT = "doc_id bigint, piece int, size bigint, bin bigint, bin_offset bigint, source string, cluster bigint"


class Bins:
    """Open bins in order of residual, with their conflict bitmaps."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.source_bits: dict = {}
        self.cluster_bits: dict = {}

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        s = 1 << self.source_bits.setdefault(source, len(self.source_bits))
        c = 1 << self.cluster_bits.setdefault(cluster, len(self.cluster_bits))
        k = bisect_left(self.order, (size, -1))
        while k < len(self.order):
            b = self.order[k][1]
            if not self.clusters[b] & c and not self.sources[b][-1] & s:
                break
            k += 1
        if k < len(self.order):
            residual, b = self.order.pop(k)
        else:
            residual, b = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[b] |= c
        counts = self.sources[b]
        for level in range(self.per_source):
            if not counts[level] & s:
                counts[level] |= s
                break
        insort(self.order, (residual - size, b))
        return b, self.capacity - residual


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 4, shard_docs: int = 4096, cluster: Column | None = None) -> DataFrame:
    """(doc_id, piece, size, bin, bin_offset, source, cluster): a row per piece of each document.

    cluster: the duplicate cluster as BIGINT, by default the hash of the whole text.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("words"),
        (F.xxhash64(F.coalesce("text", F.lit(""))) if cluster is None else cluster).cast("bigint").alias("cluster"),
    )
    # equal rows are counted and told apart by their number, so reruns agree
    same = table(slim.groupBy("doc_id", "source", "words", "cluster").agg(F.count("*").alias("rows")), "packing-sizes")
    shards = max(1, -(-(same.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]) // shard_docs))
    step = 10_000
    slim = same.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.lit(step).cast("bigint"))))
    slim = slim.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + step, F.col("rows")) - 1))).drop("_from", "rows")
    slim = slim.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "doc_id", "source", "words", "cluster", "copy"), F.lit(shards)))
    rest = F.col("words") % capacity
    whole = (F.col("words") - rest) / capacity
    slim = slim.withColumn("full", whole.cast("int")).withColumn("rest", rest)
    order = ["shard", F.desc("rest"), "doc_id", "cluster", "source", "words", "copy"]

    def run(batches):
        shard, bins, closed = None, None, 0
        for batch in batches:
            out = []
            for doc, source, group, at, full, left in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if at != shard:
                    shard, bins, closed = at, Bins(capacity, per_source), 0
                base = at << 32
                for piece in range(full):  # full bins hold nothing else: they count down from the top
                    closed += 1
                    out.append((doc, piece, capacity, base + (1 << 32) - closed, 0, source, group))
                if left or not full:
                    b, offset = bins.place(left, source, group)
                    out.append((doc, full, left, base + b, offset, source, group))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            names = ["doc_id", "piece", "size", "bin", "bin_offset", "source", "cluster"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    dealt = slim.repartition(min(parts(spark) * 4, shards) if shards > 1 else 1, "shard").sortWithinPartitions(*order)
    return dealt.select("doc_id", "source", "cluster", "shard", "full", "rest").mapInArrow(run, _OUT)
