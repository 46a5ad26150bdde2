"""Blocked Bloom filters as (block, bit) rows, their error rates and the allocation of memory to levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runweave.functions.hashing import SALT_STEP, unsigned_mod, with_hash64, with_hash64b
from runweave.functions.scalar import bloom_k
from runweave.operators.order import ranked

BLOCK_BITS = 512


def blocks_for(bits: int) -> int:
    return max(1, -(-bits // BLOCK_BITS))


def clamp_hashes(k: int) -> int:
    """The number of hash functions of a filter that is rebuilt with k: 1 to 32."""
    return max(1, min(k, 32))


def best_hashes(bits_per_key: int) -> int:
    """The best number of hash functions, as scalar.bloom_k, for a plain number."""
    return min(max(int(0.693147 * bits_per_key + 0.5), 1), 20)


def _hashed(keys: DataFrame, blocks: Column | int) -> DataFrame:
    """keys with block, and the first position and step of its bits."""
    d = with_hash64(keys, "key", "h_block")
    d = with_hash64b(d, "key", "h1")
    d = with_hash64(d, "key", "h2", SALT_STEP)
    first, step = F.col("h1").bitwiseAND(BLOCK_BITS - 1), F.col("h2").bitwiseOR(1).bitwiseAND(BLOCK_BITS - 1)
    d = d.withColumn("first", first).withColumn("step", step).withColumn("block", unsigned_mod(F.col("h_block"), blocks))
    return d.drop("h_block", "h1", "h2")


def probes(keys: DataFrame, blocks: Column | int, k: int) -> DataFrame:
    """key, block and the array of k bit positions within its 512-bit block."""
    # written out: within a lambda the hashes would be worked out for each position
    bits = F.array(*[(F.col("first") + i * F.col("step")) % BLOCK_BITS for i in range(k)])
    return _hashed(keys, blocks).withColumn("bits", bits).drop("first", "step")


def probe_rows(keys: DataFrame, blocks: Column | int, k: int) -> DataFrame:
    """A row per key and bit: the columns of keys, block, bit.

    What is exploded is a constant, so no filter on hashes reaches the scan.
    """
    d = _hashed(keys, blocks).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return d.withColumn("bit", (F.col("first") + F.col("i") * F.col("step")) % BLOCK_BITS).drop("first", "step", "i")


def build(keys: DataFrame, blocks: Column | int, k: int, *by: str) -> DataFrame:
    """(by, block, have): the set bits of each block, at most 512; by tells filters apart."""
    return probe_rows(keys, blocks, k).groupBy(*by, "block").agg(F.collect_set("bit").alias("have"))


def test(filters: DataFrame, keys: DataFrame, blocks: Column | int, k: int, *by: str) -> DataFrame:
    """The columns of keys but blocks, and maybe: whether all bits of the key are set."""
    p = probes(keys, blocks, k).join(filters, [*by, "block"], "left")
    return p.select(*[c for c in keys.columns if c != "blocks"], F.coalesce(F.size(F.array_except("bits", "have")) == 0, F.lit(False)).alias("maybe"))


def serialize(filters: DataFrame) -> DataFrame:
    """(block, words): each block as eight 64-bit words in text, lowest bits first."""
    word = lambda w: F.aggregate(
        F.filter("have", lambda b: F.floor(b / 64) == w), F.lit(0).cast("bigint"),
        lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (b % 64).cast("int"))),
    )
    return filters.select("block", F.array(*[word(w) for w in range(8)]).alias("words"))


def deserialize(rows: DataFrame) -> DataFrame:
    bits = F.flatten(F.transform("words", lambda w, i: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.call_function("shiftrightunsigned", w, b).bitwiseAND(1) == 1, (i * 64 + b).cast("bigint"))),
        lambda x: x.isNotNull())))
    return rows.select("block", bits.alias("have"))


def _turned(h: Column, size: int) -> Column:
    """The hex digits of size bytes, last byte first. F.reverse takes bytes for UTF-8 text, which keeps the order within a character."""
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def pack(filters: DataFrame, k: int, n: int, blocks: int) -> DataFrame:
    """One row, filter BINARY: k, n and the number of blocks as 32-bit numbers, then the blocks, lowest bytes first."""
    number = lambda x: _turned(F.lpad(F.hex(F.lit(x)), 8, "0"), 4)
    words = F.array_join(F.transform("words", lambda w: _turned(F.lpad(F.hex(w), 16, "0"), 8)), "")
    every = filters.sparkSession.range(blocks).select(F.col("id").alias("block"))
    rows = every.join(serialize(filters).select("block", words.alias("hex")), "block", "left")
    rows = rows.select("block", F.coalesce("hex", F.lit("0" * (BLOCK_BITS // 4))).alias("hex"))
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "hex"))), lambda x: x["hex"]), "").alias("body"))
    return body.select(F.unhex(F.concat(number(k), number(n), number(blocks), "body")).alias("filter"))


def unpack(rows: DataFrame, bits_per_key: int = 14) -> DataFrame:
    """(k, n, blocks, words) of packed filters; one that is too short is an empty filter of one block.

    words: the 64-bit words of all blocks in order; a body that is cut short has none.
    """
    number = lambda at: F.conv(_turned(F.hex(F.substring("filter", at, 4)), 4), 16, 10).cast("bigint")
    short = F.octet_length("filter") < 12
    d = rows.withColumn("short", F.coalesce(short, F.lit(True)))
    for name, at, default in (("k", 1, bloom_k(F.lit(bits_per_key)).cast("bigint")), ("n", 5, F.lit(0)), ("blocks", 9, F.lit(1))):
        d = d.withColumn(name, F.when(F.col("short"), default.cast("bigint")).otherwise(number(at)))
    whole = ~F.col("short") & (F.octet_length("filter") >= 12 + F.col("blocks") * (BLOCK_BITS // 8))
    word = lambda i: F.hex(F.substring(F.col("filter"), (13 + 8 * i).cast("int"), F.lit(8)))
    words = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") * 8 - 1), word)
    words = F.transform(words, lambda h: F.conv(_turned(h, 8), 16, -10).cast("bigint"))
    return d.select("k", "n", "blocks", F.when(whole & (F.col("blocks") > 0), words).otherwise(F.array().cast("array<bigint>")).alias("words"))


def false_positive_rate(k, n, bits):
    """(1 - exp(-k n / m))^k for columns; 0 for an empty filter."""
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(1 - F.exp(-k * n / bits), k))


def allocate(levels: DataFrame, budget_bits: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds blocks and bits to (level, entries[, heat]): one block each, the rest by weight.

    The weight is the share of entries times 1 + 0.1 * level times heat (1 if absent or not
    positive); whole blocks first, then one each by the largest fraction, lower level first.
    Rejects a budget below one block a level. Any number of parameter sets may stand side by
    side under the columns by.
    """
    every = W.partitionBy(*by)
    d = levels.withColumn("_n", F.count("*").over(every)).withColumn("_all", F.sum("entries").over(every))
    if "heat" not in levels.columns:
        d = d.withColumn("heat", F.lit(1.0))
    heat = F.when(F.col("heat") > 0, F.col("heat")).otherwise(F.lit(1.0))
    weight = F.when(F.col("entries") > 0, F.col("entries") / F.col("_all") * (1 + 0.1 * F.col("level")) * heat).otherwise(F.lit(0.0))
    d = d.withColumn("_w", weight).withColumn("_sum", F.sum("_w").over(every))
    total = F.floor(F.lit(budget_bits) / BLOCK_BITS).cast("bigint")
    d = d.withColumn("_left", F.when(F.lit(budget_bits) < F.col("_n") * BLOCK_BITS, F.raise_error(F.lit("budget is below one block a level")).cast("bigint")).otherwise(total - F.col("_n")))
    d = d.withColumn("_ideal", F.when((F.col("_sum") > 0) & (F.col("_left") > 0), F.col("_left") * (F.col("_w") / F.col("_sum"))).otherwise(F.lit(0.0)))
    d = d.withColumn("_extra", F.floor("_ideal").cast("bigint"))
    rest = F.when((F.col("_sum") > 0) & (F.col("_left") > 0), F.col("_left") - F.sum("_extra").over(every)).otherwise(F.lit(0))
    d = d.withColumn("_rest", rest)
    turn = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.col("_ideal") - F.col("_extra")), "level"))
    d = d.withColumn("blocks", 1 + F.col("_extra") + F.when(turn <= F.col("_rest"), 1).otherwise(0))
    return d.withColumn("bits", F.col("blocks") * BLOCK_BITS).select(*levels.columns, "blocks", "bits")


def structural_budget(entries: int, levels: int, bits_per_key: int, cap_bits: int) -> int:
    """The budget for all levels: entries * bits_per_key, within one block a level and the cap."""
    if cap_bits < levels * BLOCK_BITS:
        raise ValueError("cap is below one block a level")
    return max(min(max(entries * bits_per_key, levels * BLOCK_BITS), cap_bits), levels * BLOCK_BITS)


def allocate_uniform(levels: DataFrame, bits_per_key: int, cap_bits: int) -> DataFrame:
    """Each level on its own: bits_per_key a key, at least a block, at most the cap."""
    bits = F.least(F.greatest(F.lit(BLOCK_BITS), F.col("entries") * bits_per_key), F.lit(cap_bits)).cast("bigint")
    return levels.withColumn("bits", bits).withColumn("blocks", F.ceil(F.col("bits") / BLOCK_BITS).cast("bigint"))


def reallocate_structural(levels: DataFrame, bits_per_key: int, cap_bits: int) -> DataFrame:
    """Adds blocks, bits and k to (level, entries): the budget follows all entries, within the cap."""
    size = levels.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.count("*")).first()  # one row
    budget = structural_budget(size[0], size[1], bits_per_key, cap_bits)
    return allocate(levels, budget).withColumn("k", bloom_k(F.lit(bits_per_key)))


def heat_factor(levels: DataFrame, accesses: DataFrame) -> DataFrame:
    """Adds heat = 1 + 0.1 * the level's share of accesses (level, n)."""
    total = accesses.agg(F.sum("n").alias("_total"))
    d = levels.join(accesses, "level", "left").crossJoin(F.broadcast(total))  # one row
    share = F.coalesce(F.col("n") / F.col("_total"), F.lit(0.0))
    return d.withColumn("heat", 1 + 0.1 * share).drop("n", "_total")


def reallocate_frequency(levels: DataFrame, accesses: DataFrame, bits_per_key: int) -> DataFrame:
    """(level, entries, blocks, bits, k) with the same total of bits dealt anew, hot levels weighing up to a tenth more.

    Without accesses, or without bits, nothing changes.
    """
    found = levels.agg(F.coalesce(F.sum("bits"), F.lit(0))).first()[0], accesses.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    k = bloom_k(F.lit(bits_per_key))
    if not all(found):
        return levels.select("level", "entries", "blocks", "bits", k.alias("k"))
    return allocate(heat_factor(levels.select("level", "entries"), accesses), found[0]).select("level", "entries", "blocks", "bits", k.alias("k"))


def reallocate(levels: DataFrame, accesses: DataFrame, bits_per_key: int, cap_bits: int, adaptive: bool = True) -> DataFrame:
    """(level, entries, blocks, bits, k) after a change of structure: uniform, or by structure and then by access."""
    if not adaptive:
        return allocate_uniform(levels, bits_per_key, cap_bits).select("level", "entries", "blocks", "bits", bloom_k(F.lit(bits_per_key)).alias("k"))
    return reallocate_frequency(reallocate_structural(levels, bits_per_key, cap_bits), accesses, bits_per_key)


def wrong_hash_counts(filters: DataFrame, bits_per_key: int) -> DataFrame:
    """The filters (level, k) whose k is not the best for bits_per_key: none, if the invariant holds."""
    return filters.where(F.col("k") != bloom_k(F.lit(bits_per_key))).select("level", "k", bloom_k(F.lit(bits_per_key)).alias("expected"))


def heat_windows(accesses: DataFrame, order: str, width: int = 1000, start: int = 0) -> DataFrame:
    """(window, key, n): counts in windows of width accesses; a reset begins a new window at place start.

    The place of an access is its rank by order, from 0; ranks come from counts of ranges, so
    order may have gaps and no task holds all accesses.
    """
    d = ranked(accesses, order, "_place").where(F.col("_place") >= start)
    window = F.floor((F.col("_place") - start) / width).cast("bigint")
    return d.withColumn("window", window).groupBy("window", "key").agg(F.count("*").alias("n"))


def hottest(windows: DataFrame) -> DataFrame:
    """(window, hottest): the largest count of each window."""
    return windows.groupBy("window").agg(F.max("n").alias("hottest"))
