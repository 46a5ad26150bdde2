"""Quality rules: per-document counts and cross-document line frequency, in SQL functions only.

Lines are normalised (lower case, digits to 0, white space collapsed) and hashed; the
distinct documents with a line are counted per host, where equal texts are one document.
Lines in more than max(most_docs, most_share * documents of the host) documents are
removed; a document that keeps fewer than least_words words, or less than least_left of
its words, is depleted and rejected.

Counting groups by (host, line, document) and then sums partial counts, so a line that a
third of all documents share reaches no single task; the join back is a plain equi-join
that adaptive execution splits.

Defined cases: null and empty texts have no words and fail the base rule; a null host is a
host of its own; repeated rows each have a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import SEPARATORS, table

_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def words(text: Column | str = "text") -> Column:
    """The words of a text in order; an empty array where there are none."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _SPLIT), lambda w: w != "")


def with_repeated_words(d: DataFrame, hashes: str, width: int, name: str) -> DataFrame:
    """Adds how many words lie in a window whose hash stands twice or more in the array hashes.

    Sorting (hash, place) pairs brings equal windows together; the places of those with an
    equal neighbour, in order, each add the words that the next such window does not cover.
    Each step is a column of its own: within a lambda it would be evaluated per element.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_pairs", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs))
    at = lambda k: F.get(F.col("_pairs"), k).getField("h")
    twice = F.filter("_pairs", lambda p, k: F.coalesce(at(k - 1) == p["h"], F.lit(False)) | F.coalesce(at(k + 1) == p["h"], F.lit(False)))
    d = d.withColumn("_places", F.array_sort(F.transform(twice, lambda p: p["i"])))
    after = lambda k: F.get(F.col("_places"), k + 1)
    each = F.transform("_places", lambda i, k: F.least(F.lit(width), F.coalesce(after(k) - i, F.lit(width))))
    total = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.withColumn(name, F.coalesce(total, F.lit(0)).cast("bigint")).drop("_pairs", "_places")


def base_counts(docs: DataFrame, width: int = 8) -> DataFrame:
    """doc_id, source, text_hash and the per-document counts of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "source", text.alias("text")).withColumn("w", F.transform(words(), lambda w: F.xxhash64(w)))
    n = F.size("w")
    windows = F.when(n < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, width)))
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    d = with_repeated_words(d.withColumn("h", windows), "h", width, "n_repeat_words").withColumn("lines", lines)
    return d.select(
        "doc_id", "source", F.xxhash64("text").alias("text_hash"),
        n.cast("bigint").alias("n_words"),
        F.length(F.translate("text", SEPARATORS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    )


def _plain(raw: str) -> Column:
    """A line as it is compared with others."""
    return F.trim(F.regexp_replace(F.translate(F.lower(raw), "123456789", "000000000"), _SPLIT, " "))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, host, line, n_words): a row per line with words; line is a hash."""
    d = docs.select(
        "doc_id", F.col("source").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw"),
    )
    d = d.withColumn("plain", _plain("raw")).where("plain <> ''")
    return d.select(
        "doc_id", "text_hash", "host", F.xxhash64("plain").alias("line"),
        (F.length("plain") - F.length(F.translate("plain", " ", "")) + 1).cast("bigint").alias("n_words"),
    )


def frequent_lines(lines: DataFrame, most_docs: int, most_share: float) -> DataFrame:
    """(host, line) of the lines in more documents of their host than allowed."""
    once = lines.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "line").agg(F.count("one").alias("docs"))
    hosts = lines.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("all_docs"))
    c, h = counts.where(F.col("docs") > most_docs).alias("c"), hosts.alias("h")
    return c.join(h, F.col("c.host").eqNullSafe(F.col("h.host"))).where(
        F.col("docs") > F.col("all_docs") * most_share
    ).select("c.host", "c.line")


def judge(
    docs: DataFrame, most_docs: int = 20, most_share: float = 0.005, least_words: int = 20, least_left: float = 0.5,
) -> DataFrame:
    """The counts of each document, the words its frequent lines take away, and the verdicts."""
    counts = table(base_counts(docs), "quality-counts")
    lines = table(line_table(docs), "quality-lines")
    often = table(frequent_lines(lines, most_docs, most_share), "quality-frequent")
    n, o = lines.alias("n"), often.alias("o")
    gone = n.join(o, F.col("n.host").eqNullSafe(F.col("o.host")) & (F.col("n.line") == F.col("o.line")), "left_semi")
    # rows of one document under one doc_id and text have the same lines: count them once a row
    gone = gone.groupBy("doc_id", "text_hash", "host").agg(F.sum("n_words").alias("words"), F.count("*").alias("lines"))
    same = counts.groupBy("doc_id", "text_hash", "source").agg(F.count("*").alias("rows"))
    c, g, s = counts.alias("c"), gone.alias("g"), same.alias("s")
    joined = c.join(
        s, F.col("c.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("c.text_hash") == F.col("s.text_hash"))
        & F.col("c.source").eqNullSafe(F.col("s.source")),
    ).join(
        g, F.col("c.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("c.text_hash") == F.col("g.text_hash"))
        & F.col("c.source").eqNullSafe(F.col("g.host")), "left",
    ).select(
        "c.*",
        F.coalesce((F.col("g.lines") / F.col("s.rows")).cast("bigint"), F.lit(0)).alias("n_removed_lines"),
        F.coalesce((F.col("g.words") / F.col("s.rows")).cast("bigint"), F.lit(0)).alias("n_removed_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < least_words) | (left < least_left * F.col("n_words")))
    return joined.withColumn("base_failed", failed).withColumn("depleted", depleted).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("depleted")
    )


def cleaned(docs: DataFrame, most_docs: int = 20, most_share: float = 0.005) -> DataFrame:
    """docs, all rows and columns, with the frequent lines of the row's host cut out of text."""
    lines = table(line_table(docs), "quality-lines")
    often = table(frequent_lines(lines, most_docs, most_share), "quality-frequent").alias("o")
    texts = docs.select(F.col("source").alias("host"), "text").where("text is not null").distinct()
    each = texts.select("host", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    each = each.select("host", "text_hash", "at", F.xxhash64(_plain("raw")).alias("line")).alias("n")
    gone = each.join(often, F.col("n.host").eqNullSafe(F.col("o.host")) & (F.col("n.line") == F.col("o.line")), "left_semi")
    gone = gone.groupBy("host", "text_hash").agg(F.collect_set("at").alias("places")).alias("g")
    d = docs.alias("d").join(gone, F.col("d.source").eqNullSafe(F.col("g.host")) & (F.xxhash64("d.text") == F.col("g.text_hash")), "left")
    left = F.array_join(F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains(F.col("g.places"), i)), "\n")
    text = F.when(F.col("g.places").isNull(), F.col("d.text")).otherwise(left).alias("text")
    return d.select(*[text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
