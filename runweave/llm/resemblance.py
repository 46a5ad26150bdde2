"""Near copies by resemblance: texts whose sets of word shingles have Jaccard similarity of at least 4/5.

Candidates are groups of texts. SimHash gives one group a text: the component of its
fingerprint over links of at most 4 bits, by the operator of simhash.py. At similarity 0.8
fingerprints differ in about 10 of 64 bits, which no pigeonhole can search at scale, so
MinHash gives 24 more groups a text, by keys of 4 least values each: two texts of similarity
0.8 share one with probability 1 - (1 - 0.8^4)^24, all but 3 in a million. The texts of a
group meet, and each pair is compared by its exact sets. Groups of the same texts are worked
once.

A group of more than share texts is dealt into shares, each with the same few pivots, that
are linked within first. Then all links so far are brought to components; what is left to
compare in such a group are the texts outside its largest component, with all of the group,
in blocks of bounded size. So a large family of near copies costs about its size, and no
pair that matters is left out.

Texts with the same set of shingles are one node, nulls and texts without words too. A node
is named by the smallest doc_id (null first) and text hash that have it, so that unrelated
texts under a null or repeated doc_id stay apart. Very long texts are read as a whole;
columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm import simhash
from runweave.llm.common import buffer, chunks, components, mix, parts, table, trim, window_hash, word_bounds, word_hash, word_ids

_LOWEST = -(2**63)
_SEED = 0x51ED270B
_BANDS, _ROWS = 24, 4
_FLIP = mix(np.arange(1, _BANDS * _ROWS + 1, dtype=np.uint64))[:, None]
_TIMES = mix(np.arange(1001, _BANDS * _ROWS + 1001, dtype=np.uint64))[:, None] | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int):
    """For each row, the sorted distinct hashes of its width-word shingles (a shorter text is one)."""
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, offs)
    words = word_hash(word_ids(data, starts, ends), _SEED)
    by_width = {w: window_hash(words, w, _SEED + 2 * w) for w in range(1, width + 1)}
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        w = min(width, b - a)
        yield np.unique(by_width[w][a : b - w + 1]) if w else words[:0]


def group_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a set by which similar sets meet; none for the empty set."""
    if not len(shingles):
        return shingles
    least = np.full(_BANDS * _ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[None, i : i + 4096] ^ _FLIP) * _TIMES).min(1))
    keys = mix(np.arange(1, _BANDS + 1, dtype=np.uint64))
    for column in least.reshape(_BANDS, _ROWS).T:
        keys = mix(keys ^ mix(column))
    return keys


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))


def _rows(docs: DataFrame, width: int, keys: bool) -> DataFrame:
    """(id, text_hash, node, items[, fp]) of each row of docs: items are its keys, beside its fingerprint, or its shingles."""
    names = ["id", "text_hash", "node", "items", *(["fp"] if keys else [])]

    def run(batches):
        for batch in batches:
            data, offs = buffer(batch.column(2))
            for i, j in chunks(offs):
                text, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                sets = list(shingle_sets(text, at, width))
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                items = _lists([group_keys(s) for s in sets] if keys else sets)
                fp = [pa.array(simhash.fingerprints_of(text, at, width))] if keys else []
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(node), items, *fp], names=names)
        trim()

    schema = "id bigint, text_hash bigint, node bigint, items array<bigint>" + (", fp bigint" if keys else "")
    return docs.select(own_id(), text_hash(), "text").mapInArrow(run, schema)


def own_id() -> Column:
    return F.coalesce("doc_id", F.lit(_LOWEST)).alias("id")


def text_hash() -> Column:
    return F.xxhash64("text").alias("text_hash")


def connect(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of the first in its component of pairs with similarity of at least 4/5."""
    n, size = len(sets), np.array([len(s) for s in sets])
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    row, item = np.repeat(np.arange(n), size)[shared[item]], (np.cumsum(shared) - 1)[item[shared[item]]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(item, kind="stable")
    row, item, total = row[order], item[order], int(shared.sum())
    for v in range(0, total, 4096):
        i, j = np.searchsorted(item, [v, v + 4096])
        has = np.zeros((n, min(4096, total - v)), np.float32)
        has[row[i:j], item[i:j] - v] = 1
        both += has @ has.T
    close = 9 * both >= 4 * (size[:, None] + size[None, :])
    np.fill_diagonal(close, True)
    label = np.arange(n)
    while True:
        new = np.where(close, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _met(batches):
    """Links of the groups (k, lo, hi), which come sorted."""
    at, nodes, sets = None, [], []

    def close():
        if len(nodes) > 1:
            name, label = np.array(nodes, np.int64), connect(sets)
            far = np.flatnonzero(label != np.arange(len(name)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(name[far]), pa.array(name[label[far]])], names=["a", "b"])

    for batch in batches:
        k, lo, hi, node = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in range(4))
        items = batch.column(4)
        offs = items.offsets.to_numpy() - items.offsets[0].as_py()
        flat = items.flatten().to_numpy(zero_copy_only=False)
        for i, key in enumerate(zip(k, lo, hi)):
            if key != at:
                yield from close()
                at, nodes, sets = key, [], []
            nodes.append(node[i])
            sets.append(flat[offs[i] : offs[i + 1]].copy())
    yield from close()
    trim()


def candidates(nodes: DataFrame, tau: int = 4) -> DataFrame:
    """(k, node): the groups of each node (node, items, fp), by its MinHash keys and its SimHash component."""
    keyed = nodes.select("node", F.explode("items").alias("k"))
    prints = table(nodes.select("fp").distinct(), "near-prints")
    roots = components(simhash.links(prints, tau).distinct(), "near-prints-components")
    root = F.coalesce(F.col("r.root"), F.col("n.fp"))
    own = nodes.alias("n").join(roots.alias("r"), F.col("n.fp") == F.col("r.node"), "left").where(F.size("n.items") > 0)
    return keyed.unionByName(own.select("n.node", F.xxhash64(F.lit("simhash"), root).alias("k")))


def first_of_each(docs: DataFrame, width: int = 5, share: int = 512, pivots: int = 16) -> DataFrame:
    """(id, text_hash): the first row of each component of links of similarity 4/5 or more."""
    spark = docs.sparkSession
    signed = _rows(docs, width, True)
    nodes = signed.groupBy("node").agg(F.min(F.struct("id", "text_hash", "fp")).alias("name"), F.first("items").alias("items"))
    nodes = table(nodes.select("node", F.struct("name.id", "name.text_hash").alias("name"), "name.fp", "items"), "near-nodes")
    keyed = table(candidates(nodes), "near-keys")
    groups = keyed.groupBy("k").agg(
        F.count("*").alias("n"), F.min("node").alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("n > 1")
    once = groups.groupBy("n", "m", "x", "y").agg(F.min("k").alias("k"))
    members = table(keyed.join(once.select("k", "n"), "k"), "near-members")
    who = nodes.join(members.select("node").distinct(), "node", "left_semi").select("name.*").alias("w")
    own = docs.select("doc_id", "text", own_id(), text_hash()).alias("d")
    own = own.join(who, (F.col("d.id") == F.col("w.id")) & (F.col("d.text_hash") == F.col("w.text_hash")), "left_semi")
    sets = _rows(own, width, False).groupBy("node").agg(F.first("items").alias("items"))
    sets = table(sets, "near-sets")

    def linked(dealt: DataFrame, name: str) -> DataFrame:
        met = dealt.join(sets, "node").select("k", "lo", "hi", "node", "items")
        met = met.repartition(parts(spark), "k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "node")
        return table(met.mapInArrow(_met, "a bigint, b bigint").distinct(), name)

    deal = lambda size, salt: F.pmod(F.xxhash64("node", "k", F.lit(salt)), F.ceil(F.col(size) / share)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / share).cast("int") - 1))
    pivot = F.pmod(F.xxhash64("node", "k", F.lit(2)), F.col("n")) < pivots
    shares = members.select("k", deal("n", 1).alias("lo"), F.lit(0).alias("hi"), "node")
    common = members.where((F.col("n") > share) & pivot).select("k", every("n").alias("lo"), F.lit(0).alias("hi"), "node")
    found = linked(shares.unionByName(common).distinct(), "near-links")
    large = members.where(F.col("n") > share)
    if large.limit(1).count():
        part = components(found, "near-parts")
        of = F.coalesce(F.col("p.root"), F.col("m.node")).alias("root")
        placed = table(large.alias("m").join(part.alias("p"), F.col("m.node") == F.col("p.node"), "left").select("m.k", "m.n", "m.node", of), "near-placed")
        sizes = placed.groupBy("k", "root").agg(F.count("*").alias("size"))
        most = sizes.groupBy("k").agg(F.max_by("root", F.struct("size", "root")).alias("most"), (F.sum("size") - F.max("size")).alias("others"))
        left = table(placed.join(most.where("others > 0"), "k"), "near-left")
        asking = left.where("root <> most").select("k", (2 * deal("others", 3) + 1).alias("lo"), every("n").alias("hi"), "node")
        asked = left.select("k", every("others").alias("lo"), deal("n", 4).alias("hi"), "node").select("k", (2 * F.col("lo") + 1).alias("lo"), "hi", "node")
        found = found.unionByName(linked(asking.unionByName(asked).distinct(), "near-rest")).distinct()
    a, b = (nodes.select(F.col("node").alias(c), F.col("name").alias(f"name_{c}")) for c in "ab")
    named = found.join(a, "a").join(b, "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    rest = components(named, "near-components")
    return nodes.join(rest, nodes.name == rest.node, "left_anti").select("name.*")
