"""Threshold-scaled document sketches, in DataFrame operations only.

A sketch keeps every shingle hash (the first 64 bits of MD5) below a fixed fraction
(2^-bits) of the hash range, so its size follows the document's and sketches of very unequal
documents stay comparable: the sketch of a union is the union of the sketches, and the share
of one sketch's hashes that stand in another estimates containment. Beside them stands the
least hash of all, a field of its own that no union of kept hashes contains; only where
neither of two texts has a hash below the threshold do the least hashes tell whether they
are alike (1 if equal, else 0).

Shingles are width consecutive words, joined by one space; texts with fewer words have one
shingle, their whole sequence; texts without words have an empty sketch and no least hash.
Likeness is the resemblance (kept hashes shared over kept hashes of either).

Defined cases: null text is empty; ties and repeated rows of doc_id are ordered by text
hash; a null doc_id comes before all others (so does the id -2^63); very long texts are
read as a whole; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runweave.llm.common import parts, small_table, table
from runweave.llm.quality import words

_LOWEST = -(2**63)


def with_sketch(d: DataFrame, text: str, name: str, width: int = 5, bits: int = 3) -> DataFrame:
    """Adds the column name of the text's sketch: struct(kept, sorted distinct hashes as 16 hexadecimal digits; least).

    Each step is a column of its own: within another expression it would be evaluated again.
    """
    w, h = f"_{name}_words", f"_{name}_hashes"
    n = F.size(w)
    shingles = F.transform(
        F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.md5(F.concat_ws(" ", F.slice(w, i, width)).cast("binary"))
    )
    d = d.withColumn(w, words(text)).withColumn(h, F.when(n == 0, F.array().cast("array<string>")).otherwise(shingles))
    low = F.filter(h, lambda x: x < f"{1 << (64 - bits):016x}")
    kept = F.transform(F.array_sort(F.array_distinct(low)), lambda x: F.substring(x, 1, 16))
    return d.withColumn(name, F.struct(kept.alias("kept"), F.substring(F.array_min(h), 1, 16).alias("least"))).drop(w, h)


def likeness(a: str, b: str) -> Column:
    kept_a, kept_b = F.col(f"{a}.kept"), F.col(f"{b}.kept")
    union = F.size(F.array_union(kept_a, kept_b))
    few = F.when(F.col(f"{a}.least").eqNullSafe(F.col(f"{b}.least")), 1.0).otherwise(0.0)
    return F.when(union == 0, few).otherwise(F.size(F.array_intersect(kept_a, kept_b)) / union)


def containment(a: str, b: str) -> Column:
    """The estimated share of a's shingles that b has (1 if none of a's is kept)."""
    kept = F.col(f"{a}.kept")
    return F.when(F.size(kept) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(kept, F.col(f"{b}.kept"))) / F.size(kept))


def merge(a: str, b: str) -> Column:
    """The sketch of the two documents' shingles together."""
    kept = F.array_sort(F.array_union(F.col(f"{a}.kept"), F.col(f"{b}.kept")))
    return F.struct(kept.alias("kept"), F.least(F.col(f"{a}.least"), F.col(f"{b}.least")).alias("least"))


def as_text(a: str) -> Column:
    """A sketch as a string: its hashes, or ~ and the least hash where none is kept."""
    least = F.coalesce(F.concat(F.lit("~"), F.col(f"{a}.least")), F.lit(""))
    return F.when(F.size(F.col(f"{a}.kept")) == 0, least).otherwise(F.array_join(F.col(f"{a}.kept"), ""))


def _splits(slim: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """At most about 5 * ranges existing (_order, _tie) at which ranges of rows begin, the first of all among them.

    Cuts stand at quantiles of _order; an _order with the rows of several ranges (a null id)
    is cut again by _tie, a hash.
    """
    found = slim.agg(
        F.count("*").alias("n"), F.min("_order").alias("least"),
        F.percentile_approx("_order", [k / ranges for k in range(1, ranges)] or [0.5], max(10000, 4 * ranges)).alias("cuts"),
    ).first()
    if not found.n:
        return [(0, 0)]
    cuts = small_table(slim.sparkSession, [(x,) for x in {found.least, *found.cuts}], "_order bigint")  # at most ranges rows
    many = slim.groupBy("_order").agg(F.count("*").alias("rows")).where(F.col("rows") * ranges > 2 * found.n)  # at most ranges / 2
    bits = F.ceil(F.log2(F.col("rows") * ranges / found.n)).cast("int")
    cells = slim.join(F.broadcast(many.withColumn("bits", bits)), "_order").groupBy("_order", F.expr("shiftright(_tie, 64 - bits)").alias("cell"))
    begins = slim.join(F.broadcast(cuts), "_order").groupBy("_order").agg(F.min("_tie").alias("_tie"))
    return sorted({(r._order, r._tie) for d in (begins, cells.agg(F.min("_tie").alias("_tie"))) for r in d.select("_order", "_tie").collect()})


def _bucket(splits: list[tuple[int, int]], at: Column) -> tuple[Column, Column]:
    """How many of the ascending splits are at most at, less one, and the last of them; two levels keep it to about 2 sqrt(n) steps."""
    step = max(1, int(len(splits) ** 0.5))
    rows = [splits[i : i + step] for i in range(0, len(splits), step)]
    pair = "struct<o:bigint,t:bigint>"
    # literals of one string each, folded before the scan
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    named = [[{"o": o, "t": t} for o, t in r] for r in rows]
    heads, all_rows = literal([r[0] for r in named], f"array<{pair}>"), literal(named, f"array<array<{pair}>>")
    row = F.greatest(F.size(F.filter(heads, lambda x: x <= at)), F.lit(1))
    within = F.size(F.filter(F.element_at(all_rows, row), lambda x: x <= at))
    return (row - 1) * step + within - 1, F.element_at(F.element_at(all_rows, row), within)


def with_next(docs: DataFrame, width: int = 5, bits: int = 3, rows_in_range: int = 4096) -> DataFrame:
    """doc_id, text, sketch and next_text, next_sketch of the next document (after the last: the first).

    Documents are dealt to ranges of about rows_in_range rows; the first document of each
    range also stands at the end of the range before it, and the first of all at the end of
    the last. Each text is shuffled once and no task sees more than a range. Only rows with
    one id and one text are never parted.
    """
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), order.alias("_order"))
    d = d.withColumn("_tie", F.xxhash64("text"))
    slim = table(d.select("_order", "_tie"), "fingerprint-order")
    splits = _splits(slim, min(max(parts(docs.sparkSession), slim.count() // rows_in_range, 2), 1 << 16))
    last = len(splits) - 1
    d = with_sketch(d, "text", "sketch", width, bits)
    at = F.struct(F.col("_order").alias("o"), F.col("_tie").alias("t"))
    bucket, begin = _bucket(splits, at)
    d = d.withColumn("_bucket", bucket).withColumn("_begins", begin == at)
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("lap"), F.lit(False).alias("guest"))
    before = F.struct((F.col("_bucket") - 1).alias("bucket"), F.lit(0).alias("lap"), F.lit(True).alias("guest"))
    around = F.struct(F.lit(last).alias("bucket"), F.lit(1).alias("lap"), F.lit(True).alias("guest"))
    places = F.when(F.col("_begins") & (F.col("_bucket") > 0), F.array(own, before)).when(F.col("_begins"), F.array(own, around)).otherwise(F.array(own))
    d = d.select("doc_id", "text", "_order", "_tie", "sketch", F.explode(places).alias("_at"))
    w = W.partitionBy("_at.bucket").orderBy("_at.lap", "_order", "_tie")
    d = d.select("doc_id", "text", "sketch", "_at.guest", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch"))
    return d.where(~F.col("guest")).drop("guest")


def edited_and_next(docs: DataFrame, width: int = 5, bits: int = 3) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and the next document."""
    d = with_next(docs, width, bits)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("n_chars", n.cast("bigint")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    )
    d = with_sketch(d, "edited", "edited_sketch", width, bits)
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("kept_in_edited"),
    )
