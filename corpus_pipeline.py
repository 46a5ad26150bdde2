"""From raw documents to packed training bins, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import mixing, packing, resemblance, suffix, toxicity
from runweave.llm.common import forget_tables, new_path, prepare, tables_made

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below one half; learnt from the labels outside the held-out fifth.

    Null and empty texts score the bias alone and stay unless most labels are toxic; every row
    is judged on its own text, whatever ids repeat; an empty table gives an empty one. This and
    the other stages read the columns of documents and drop others, so no name can clash.
    """
    prepare(spark)
    labels = toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*_COLUMNS), labels).where("toxicity < 0.5").drop("toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each component of links of Jaccard similarity 0.8 or more (five-word shingles).

    Candidates are the SimHash components of 4 bits and MinHash groups; every link is exact.
    Rows that repeat the kept doc_id and text are copies too: one of them stays. Other texts
    under a null or repeated doc_id are documents of their own; texts without words are copies
    of one another. Very long texts are compared as a whole.
    """
    prepare(spark)
    first = resemblance.first_of_each(docs.select(*_COLUMNS), width=5).alias("f")
    d = docs.select(*_COLUMNS, resemblance.own_id(), resemblance.text_hash()).alias("d")
    kept = d.join(first, (F.col("d.id") == F.col("f.id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left_semi")
    return kept.dropDuplicates(["id", "text_hash"]).select(*_COLUMNS)


def cut_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier; parts of characters at a cut go too.

    Every row stays, a null text as an empty one; earlier is by doc_id, null first, then text.
    """
    prepare(spark)
    left = suffix.dedup_bytes(docs.select(*_COLUMNS), carry=["lang", "source"])
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, each as often as it takes them, up to three times.

    Texts without words are never taken; a null source is a source of its own; repeated rows
    count each on their own.
    """
    return mixing.mixed_documents(docs.select(*_COLUMNS))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and offset of every piece of every document; copies of one text go to different bins."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_bytes),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_bins),
]

#: Near-duplicates, suffix order and packing are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path, before = new_path(spark, f"pipeline-{k}"), tables_made()
        stage(spark, docs, sf_dir).write.parquet(path)
        forget_tables(spark, before)  # what the stage wrote on its way
        docs = spark.read.parquet(path)
    return docs
