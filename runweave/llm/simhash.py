"""SimHash near-duplicates: fingerprints, then links by the generalised pigeonhole principle.

The 64 bits are grouped into partitions by correlation. Thresholds T_p with
sum(T_p + 1) = tau + 1 are allotted by dynamic programming over estimated candidate
counts, so two fingerprints within tau differ in at most T_p bits of some partition p.
Every distinct fingerprint probes partition p with all values within T_p of its own, and
candidates are verified by the full Hamming distance inside the join.

Dense partition values are left to exact ways that emit no pairs. A value's members and
probers are dealt into blocks of bounded size, by the numbers of both, and each block gives
a spanning forest. Values with more than crowded members, for thresholds 2 and 4 (here 4):
fingerprints within 4 bits share a fingerprint within 2 bits of both, so each one that
probes a crowded value is tied to all such midpoints, and those that meet at one are linked;
each task thins its links to a forest. Above 4 bits midpoints are too many, and odd
thresholds have none; there blocks do all the work.

Nulls and texts without words have fingerprint zero and are linked like any other. Equal
fingerprints are one node whatever the number of rows; repeated rows stay. The id -2^63 is
read as null. Very long texts are read as a whole. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import buffer, chunks, components, parts, table, trim, word_bounds

_LOWEST = -(2**63)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For each byte value, its 8 bits as the 8 byte lanes of a uint64 (lowest bit in lane 0).
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def fingerprints_of(data: np.ndarray, offs: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    """Signed 64-bit fingerprints of the rows."""
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, offs)
    words = np.diff(first)
    out = np.zeros(len(words), np.uint64)
    if not len(starts):
        return out.view(np.int64)
    # the words of all rows, one separator after each: shingles are slices
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(to[-1], 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[to[1:] - 1] = False
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] = 1
    stop = np.zeros(len(data) + 1, np.int8)
    stop[ends] = 1
    mask = np.cumsum(keep - stop, dtype=np.int8)[:-1].astype(bool)
    joined[inside] = data[mask]
    shingles = np.where(words == 0, 0, np.maximum(1, words - width + 1))
    row_at = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(len(words)), shingles)
    within = np.arange(row_at[-1]) - row_at[row]
    a = first[row] + within
    b = np.minimum(a + width, first[row + 1])
    text, hashed = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter(
        (hashed(text[i:j], seed) for i, j in zip(to[a].tolist(), (to[b] - 1).tolist())), np.uint64, len(a)
    )
    byte = h.view(np.uint8).reshape(-1, 8)
    blocks = np.flatnonzero(within % 255 == 0)
    has = np.flatnonzero(words)
    block_row = np.searchsorted(blocks, row_at[has])
    for k in range(8):
        lanes = np.add.reduceat(_LANES[byte[:, k]], blocks)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), block_row, axis=0)
        major = 2 * ones > shingles[has, None]
        bits = np.packbits(major, axis=1, bitorder="little")[:, 0].astype(np.uint64)
        out[has] |= bits << np.uint64(8 * k)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, width: int = 5, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """(id_col, fp BIGINT): SimHash of the width-word shingles of the lower-cased text."""

    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            data, offs = buffer(text)
            found = [
                fingerprints_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width, seed)
                for i, j in chunks(offs)
            ]
            fp = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp)], names=[id_col, "fp"])

    return docs.select(id_col, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{id_col} bigint, fp bigint")


# --------------------------------------------------------------------------- allotment


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches):
        n, both = 0, np.zeros((64, 64), np.float64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            both += bits.T @ bits
        counts = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["cell", "n"])

    out = np.zeros(64 * 64 + 1)
    rows = fps.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # 64 * 64 + 1 rows
        out[r.cell] = r.n
    return int(out[-1]), out[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, groups = set(range(64)), []
    for g in range(m):
        size = (64 * (g + 1)) // m - (64 * g) // m
        group = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def equal_shares(fps: DataFrame, plans: list[list[list[int]]]) -> list[list[float]]:
    """For each group of each plan the share of ordered pairs, of all fingerprints, that agree on its bits."""
    ids = [(i, j) for i, groups in enumerate(plans) for j in range(len(groups))]
    keys = [F.struct(F.lit(k).alias("k"), _value(plans[i][j]).alias("v")) for k, (i, j) in enumerate(ids)]
    counts = fps.select(F.explode(F.array(*keys)).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").cast("double").alias("n"))
    rows = counts.groupBy("k").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).collect()  # a row a group
    out = [[1.0] * len(groups) for groups in plans]
    for r in rows:
        i, j = ids[r.k]
        out[i][j] = r.pairs / (r.n * r.n)
    return out


def allot(n: int, both: np.ndarray, groups: list[list[int]], tau: int, equal: list[float] | None = None) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) of the least estimated probes and candidates, by dynamic programming.

    equal: for each group the share of pairs that agree on it, which correlation raises above
    what the single bits tell; the shares within a few bits are raised in proportion.
    """
    n = max(n, 1)  # without fingerprints all choices would cost the same, the widest too
    p = np.diag(both) / n
    differ = 2 * p * (1 - p)
    costs = []
    for g, group in enumerate(groups):
        dist = np.array([1.0])
        for b in group:
            dist = np.convolve(dist, [1 - differ[b], differ[b]])
        raised = max(1.0, equal[g] / max(dist[0], 1e-300)) if equal else 1.0
        ball, row = 0, [0.0]
        for t in range(tau + 1):
            ball += _choose(len(group), t)
            row.append(n * ball * 3.0 + n * float(n) * min(1.0, raised * dist[: t + 1].sum()))
        costs.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for give in range(tau + 2 - used):
                new = (cost + row[give], [*ts, give - 1])
                if used + give not in step or new[0] < step[used + give][0]:
                    step[used + give] = new
        best = step
    return best[tau + 1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _value(group: list[int]) -> Column:
    """The bits of fp that belong to a group."""
    return F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))


def _masks(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def links(fps: DataFrame, tau: int = 4, dense: int = 24, crowded: int = 2048, share: int = 256) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within tau bits of each other.

    fps: distinct fp BIGINT. Up to dense members, every pair within tau that a partition
    value brings together is a link. The members and probers of a dense value are dealt into
    blocks of at most about share of each, and every block gives a spanning forest, so its
    links stay fewer than its rows. Values with more than crowded members go through
    midpoints for tau 2 and 4.
    """
    n, both = bit_statistics(fps)
    plans = [group_bits(n, both, m) for m in range(2, tau + 2)]
    costs = [allot(n, both, groups, tau, equal) for groups, equal in zip(plans, equal_shares(fps, plans))]
    (_, ts), groups = min(zip(costs, plans), key=lambda x: x[0][0])
    used = [(p, g, t) for p, (g, t) in enumerate(zip(groups, ts)) if t >= 0]
    keys = F.array(*[F.struct(F.lit(p).alias("p"), _value(g).alias("v")) for p, g, t in used])
    data = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.p", "k.v")
    probes = None
    for p, g, t in used:
        each = F.explode(F.array(*[F.lit(x) for x in _masks(g, t)]))
        part = fps.select("fp", _value(g).alias("own"), each.alias("x")).select(
            F.col("fp").alias("q"), F.lit(p).alias("p"), F.col("own").bitwiseXOR(F.col("x")).alias("v")
        )
        probes = part if probes is None else probes.unionByName(part)
    hot = table(data.groupBy("p", "v").agg(F.count("*").alias("members")).where(F.col("members") > dense), "simhash-hot")
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= tau
    d = data.join(hot, ["p", "v"], "left_anti").alias("d")
    pairs = probes.alias("pr").join(d, (F.col("d.p") == F.col("pr.p")) & (F.col("d.v") == F.col("pr.v")) & (F.col("q") != F.col("fp")) & near)
    out = pairs.select(F.greatest("q", "fp").alias("a"), F.least("q", "fp").alias("b")).distinct()
    grouped = hot
    midpoints = tau <= 4 and tau % 2 == 0  # at odd distances no fingerprint lies within half of both
    if midpoints:
        packed = probes.join(hot.where(F.col("members") > crowded), ["p", "v"], "left_semi").select(F.col("q").alias("fp")).distinct()
        out = out.unionByName(midpoint_links(packed, tau))
        grouped = hot.where(F.col("members") <= crowded)
    asking = table(probes.join(grouped, ["p", "v"]).select("p", "v", "members", F.col("q").alias("fp")), "simhash-asking")
    blocks = lambda c: F.ceil(F.col(c) / share).cast("int")
    sizes = asking.groupBy("p", "v").agg(F.first("members").alias("members"), F.count("*").alias("probers"))
    sizes = table(sizes.select("p", "v", blocks("members").alias("mb"), blocks("probers").alias("qb")), "simhash-sizes")
    # each block of probers meets each block of members
    asks = asking.select("p", "v", "fp").join(sizes, ["p", "v"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("qb")).cast("int"))
    asks = asks.select("p", "v", F.explode(F.sequence(F.col("own") * F.col("mb"), F.col("own") * F.col("mb") + F.col("mb") - 1)).alias("block"), F.lit(True).alias("asks"), "fp")
    asked = data.join(sizes, ["p", "v"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("mb")).cast("int"))
    asked = asked.select("p", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda i: i * F.col("mb") + F.col("own"))).alias("block"), F.lit(False).alias("asks"), "fp")
    met = asks.unionByName(asked).repartition(parts(fps.sparkSession), "p", "v", "block").sortWithinPartitions("p", "v", "block")
    return out.unionByName(met.mapInArrow(lambda batches: _forests(batches, tau), "a bigint, b bigint"))


def _forests(batches, tau: int):
    """Spanning forests of the groups (p, v, block), which come sorted."""
    at, held = None, []

    def close():
        if held:
            asks, fp = (np.concatenate(x) for x in zip(*held))
            a, b = forest(fp[asks], fp[~asks], tau)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        p, v, block, asks, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        cuts = np.flatnonzero((p[1:] != p[:-1]) | (v[1:] != v[:-1]) | (block[1:] != block[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
            key = (p[i], v[i], block[i])
            if key != at:
                yield from close()
                at, held = key, []
            held.append((asks[i:j].astype(bool), fp[i:j]))
    yield from close()


def forest(asking: np.ndarray, asked: np.ndarray, tau: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links (each to its component's smallest) that connect what pairs of asking and asked within tau connect."""
    nodes, index = np.unique(np.concatenate([asking, asked]), return_inverse=True)
    qi, di = index[: len(asking)], index[len(asking) :]
    label = np.arange(len(nodes))
    if not len(asking) or not len(asked):
        return nodes[:0], nodes[:0]
    step = max(1, block // len(asked))
    while True:
        before = label.copy()
        for i in range(0, len(asking), step):
            q = qi[i : i + step]
            close = np.bitwise_count(asking[i : i + step, None] ^ asked[None, :]) <= tau
            np.minimum.at(label, q, np.where(close, label[di][None, :], len(nodes)).min(1))
            np.minimum.at(label, di, np.where(close, label[q][:, None], len(nodes)).min(0))
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def midpoint_links(fps: DataFrame, tau: int) -> DataFrame:
    """Links through shared fingerprints within half of tau bits; tau must be even.

    The least fingerprint of a midpoint is a partial aggregate, and the join back to it can
    be split, so a midpoint that many share does not land in one task.
    """
    flips = F.explode(F.array(*[F.lit(x) for x in _masks(list(range(64)), tau // 2)]))
    at = fps.select("fp", flips.alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("mid"))
    least = at.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
    found = at.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return found.mapInArrow(_thinned, "a bigint, b bigint").distinct()


def _thinned(batches, most: int = 1 << 18):
    """Links that connect the same, fewer than there are nodes in each part of a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def close():
        nodes, index = np.unique(np.concatenate([x for pair in held for x in pair]), return_inverse=True)
        split = np.cumsum([0, *(len(x) for pair in held for x in pair)])
        a = np.concatenate([index[split[k] : split[k + 1]] for k in range(0, 2 * len(held), 2)])
        b = np.concatenate([index[split[k] : split[k + 1]] for k in range(1, 2 * len(held), 2)])
        label = np.arange(len(nodes))
        while True:
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            while (label[label] != label).any():
                label = label[label]
            if (label == before).all():
                break
        far = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])

    for batch in batches:
        if len(batch):
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            size += len(batch)
        if size >= most:
            yield close()
            held, size = [], 0
    if held:
        yield close()
    trim()


def near_duplicates(docs: DataFrame, width: int = 5, tau: int = 4, dense: int = 24, crowded: int = 2048, share: int = 256) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most tau bits.

    Links are brought to the smallest doc_id of each fingerprint before components are
    formed, so that a component's root has its id and no large class is joined by root. The
    fingerprint stands beside the id: texts under one null or repeated doc_id are not tied.
    """
    fps = table(fingerprints(docs, width), "simhash-fp")
    own = F.coalesce("doc_id", F.lit(_LOWEST))
    distinct = fps.groupBy("fp").agg(F.min(own).alias("least"))
    distinct = table(distinct.select("fp", F.struct("least", "fp").alias("name")), "simhash-distinct")
    found = table(links(distinct.select("fp"), tau, dense, crowded, share).distinct(), "simhash-links")
    a, b = (distinct.select(F.col("fp").alias(c), F.col("name").alias(f"name_{c}")) for c in "ab")
    roots = components(found.join(a, "a").join(b, "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b")), "simhash-components")
    named = distinct.join(roots, distinct.name == roots.node, "left").select("fp", F.coalesce("root", "name")["least"].alias("root"))
    return fps.join(named, "fp").select("doc_id", "fp", F.nullif("root", F.lit(_LOWEST)).alias("component_id"))
