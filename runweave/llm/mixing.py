"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source has a weight and a target share of the total budget (the words of all
documents); a target stops at most_repeats times its source's size and the excess goes to
the others by weight. Every document may be sent once per epoch. Its virtual finish time is
the cumulative size of its source, in shuffled order, up to and including it (plus whole
epochs), divided by the source's target. All (document, epoch) rows are range-sorted by
finish time and the mix is the prefix whose cumulative size stays within the budget.

Cumulative sizes come from two levels, sums of key ranges and windows within a range, so a
source of any size spreads over many tasks; so do sources, of which there may be one a
host. Of sorted parts only one row each comes to the driver.

Defined cases: null text has size 0; a null source is a source, ordered last; documents of
size 0 are never taken (taken 0); repeated rows count each on their own; ties are broken by
key, document and epoch, so reruns agree; very long texts count as a whole; an empty table
gives an empty result. mix() reads doc_id, source and text only; mixed_documents() passes all
columns through, whatever their names. Documents keep their row in mix() even if nothing of
them is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runweave.llm.common import WORD, parts, small_table, table


def word_count(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ahead_of(rows: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """rows with, for each new column of sums, the sum of a number over all rows before it in order.

    Rows are range-sorted into a table; sums of its parts come to the driver, a row a part,
    and running sums stay within parts.
    """
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    sorted_rows = table(sorted_rows.withColumn("_part", F.spark_partition_id()), name)
    kinds = dict(sorted_rows.dtypes)
    wide = lambda x: "double" if kinds[x] == "double" else "bigint"
    before, offsets = {new: 0.0 if wide(x) == "double" else 0 for new, x in sums.items()}, []
    totals = sorted_rows.groupBy("_part").agg(*[F.sum(x).alias(new) for new, x in sums.items()]).orderBy("_part").collect()
    for r in totals:
        offsets.append((r["_part"], *[before[x] for x in sums]))
        before = {x: before[x] + r[x] for x in sums}
    start = small_table(spark, offsets, "_part int, " + ", ".join(f"`_from_{new}` {wide(x)}" for new, x in sums.items()))
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = sorted_rows.join(F.broadcast(start), "_part")  # a row a part
    for new, x in sums.items():
        out = out.withColumn(new, F.col(f"_from_{new}") + F.coalesce(F.sum(x).over(w), F.lit(0).cast(wide(x))))
    return out.drop("_part", *[f"_from_{new}" for new in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_repeats: int = 3) -> DataFrame:
    """(source, source_size, target) for sizes (source, source_size), one row per source.

    Sources in code point order, null last, weigh as weights says, repeating. The level at
    which targets = min(most_repeats * size, level * weight) use up the budget is found from
    running sums over the sources in the order in which they meet their limit.
    """
    by_name = [F.col("source").asc_nulls_last()]
    ranked = ahead_of(sizes.withColumn("one", F.lit(1).cast("bigint")), by_name, {"place": "one"}, "mix-names").withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ).withColumn("most", F.col("source_size") * F.lit(float(most_repeats))).withColumn("ratio", F.col("most") / F.col("weight"))
    filling = ahead_of(ranked, [F.col("ratio"), *by_name], {"most_before": "most", "weight_before": "weight", "turn": "one"}, "mix-levels")
    filling = table(filling.select("source", "source_size", "weight", "most", "ratio", "most_before", "weight_before", "turn"), "mix-filling")
    whole = filling.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"))
    levels = filling.crossJoin(F.broadcast(whole.toDF("all_size", "all_weight")))  # one row
    levels = levels.withColumn("level", (F.col("all_size") - F.col("most_before")) / (F.col("all_weight") - F.col("weight_before")))
    level = levels.where("ratio >= level").agg(F.min_by("level", "turn").alias("level"))
    return filling.crossJoin(F.broadcast(level)).select(  # one number
        "source", "source_size",
        F.least(F.col("most"), F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_repeats: int = 3, seed: int = 9) -> DataFrame:
    """(doc_id, text_hash, same, size, source_size, target, epochs, taken) per row of docs.

    same numbers the rows that share doc_id and text, so (doc_id, text_hash, same) names a row.
    """
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary"))
    slim = docs.select(
        "doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_hash"),
        F.conv(F.substring(shuffled, 1, 15), 16, 10).cast("bigint").alias("key"),  # 60 bits
    )
    again = W.partitionBy("doc_id", "text_hash").orderBy(F.col("source").asc_nulls_last())
    slim = table(slim.withColumn("same", F.row_number().over(again)), "mix-sizes")
    spark = slim.sparkSession
    n = slim.count()
    # about as many key ranges as documents in a range
    bits = max(1, (max(n, 1).bit_length() + 1) // 2)
    slim = slim.withColumn("bucket", F.shiftright("key", max(60 - bits, 0)))
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    goal = targets(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, most_repeats)
    goal = table(goal, "mix-targets")
    budget = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "same").rowsBetween(W.unboundedPreceding, 0)
    run = slim.withColumn("inside", F.sum("size").over(inside))
    s, g = sums.alias("s"), goal.alias("g")
    run = (
        run.join(s, F.col("s.source").eqNullSafe(run.source) & (F.col("s.bucket") == run.bucket))
        .select(run["*"], "s.ahead")
    )
    run = run.join(g, F.col("g.source").eqNullSafe(run.source)).select(run["*"], "g.source_size", "g.target")
    sent = run.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("epoch")
    ).withColumn(
        "finish",
        F.when(F.col("size") > 0, (F.col("epoch") * F.col("source_size") + F.col("ahead") + F.col("inside")) / F.col("target")),
    ).where("epoch = 0 or size > 0")
    order = [F.col("finish").asc_nulls_last(), "key", "doc_id", "text_hash", "same", "epoch"]
    ordered = sent.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    ordered = table(
        ordered.select("doc_id", "text_hash", "same", "source_size", "target", "key", "size", "epoch", "finish").withColumn("part", F.spark_partition_id()),
        "mix-order",
    )
    left, cut = budget, -1
    for r in ordered.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect():  # a row a part
        if r["size"] > left:
            cut = r["part"]
            break
        left -= r["size"]
    running = F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    edge = ordered.where(F.col("part") == cut).withColumn("in_mix", running <= left)
    rest = ordered.where(F.col("part") != cut).withColumn("in_mix", F.lit(True) if cut < 0 else F.col("part") < cut)
    chosen = rest.unionByName(edge)
    # one range of key and all epochs of a row: no hot group
    return chosen.groupBy("doc_id", "text_hash", "same", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("in_mix") & (F.col("size") > 0), 1).otherwise(0)).alias("epochs"),
        F.sum(F.when(F.col("in_mix"), F.col("size")).otherwise(0)).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (up to most_repeats times).

    Each text moves once: how often a document's repeated rows are taken is joined as one
    list, and the rows are numbered where the join has brought them.
    """
    own = lambda: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_id")
    times = mix(docs, **options).select(own(), "text_hash", "same", "epochs")
    # repeated rows are taken alike but for a few borders: a list of stretches, not of rows
    stretch = F.col("same") - F.row_number().over(W.partitionBy("_id", "text_hash", "epochs").orderBy("same"))
    times = times.withColumn("stretch", stretch).groupBy("_id", F.col("text_hash").alias("_hash"), "epochs", "stretch").agg(F.min("same").alias("a"), F.max("same").alias("b"))
    times = times.groupBy("_id", "_hash").agg(F.collect_list(F.struct("a", "b", "epochs")).alias("_taken"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), own(), F.xxhash64("text").alias("_hash"), F.col("source").alias("_source"))
    both = rows.join(times, ["_id", "_hash"])
    again = W.partitionBy("_id", "_hash").orderBy(F.col("_source").asc_nulls_last())
    both = both.withColumn("_same", F.row_number().over(again)).withColumn(
        "_epochs", F.get(F.filter("_taken", lambda x: (x["a"] <= F.col("_same")) & (F.col("_same") <= x["b"])), F.lit(0))["epochs"]
    ).where("_epochs > 0")
    return both.select("_row", F.explode(F.sequence(F.lit(1), F.col("_epochs").cast("int")))).select("_row.*")
