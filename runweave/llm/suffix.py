"""Suffix-array deduplication of byte strings by external induced sorting.

Every 100-byte window belongs to a run of neighbours with the same minimiser, the least hash
of 48 consecutive bytes within the window. Equal windows have equal minimisers, so the runs
of one minimiser form a shard of texts that holds every occurrence of its windows. A
count-min sketch of the minimisers first drops those that occur once: nothing in them
repeats. Minimisers that a very large number of runs share are dealt again by the hash of
each whole window, so that no shard grows with a third of the table.

In each task the runs with equal bytes are one text, held by the earliest place; so a
passage that many documents share reaches a shard once a task. A shard's texts are laid end
to end and their suffixes put in order, with common prefixes, by induced.InducedSorter,
which keeps its queues on disk beyond a memory budget. Suffixes that share 100 bytes stand
together: all but the earliest place (smallest document, then start) mark their windows,
and the marks return to their documents, whose covered bytes are removed.

The order is by the first 100 bytes only, as windows of 100 bytes ask no more.

Defined cases: null text is empty; texts shorter than the window stay whole; rows with equal
doc_id and text are one document and get equal results; equal doc_id with different texts
are documents in the order of their text hashes; a null doc_id comes before all others; an
empty table gives an empty result; other columns are ignored. Kept bytes may end within a
character; kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import buffer, chunks, gathered, mix, parts, pieces, powers, release, span_hash, table
from runweave.llm.countmin import log_width_for, repeated, sketch_of
from runweave.llm.induced import InducedSorter
from runweave.llm.substring import LOWEST, MARK, identified, later_rows, marks_of, repeated_rows
from runweave.llm.windows import by_key, covered, key_runs, not_first, ranges, runs, same_spans

_SEEDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_GRAM = 48
_ROW = "key bigint, ord bigint, sub bigint, pos int, n int, inner boolean, content binary"


def _grams(data: np.ndarray, width: int, seed: int) -> np.ndarray:
    n = len(data) - width + 1
    up, down = powers(len(data))
    letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed | 1))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])


def _runs(data: np.ndarray, offs: np.ndarray, cap: int):
    """(row, start, windows, minimiser, whether it occurs twice in the run) of all runs."""
    if len(data) < cap:
        return None
    n = np.maximum(np.diff(offs) - cap + 1, 0)
    if not n.sum():
        return None
    at = ranges(offs[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    s, m, key, inner = key_runs(_grams(data, _GRAM, _SEEDS[0]), row, at, cap - _GRAM + 1)
    return row[s], at[s], m, key, inner


def removed_runs(d: DataFrame, cap: int = 100, most_cells: int = 1 << 28, crowded: int = 20000, shard: int = 6 << 20) -> DataFrame:
    """(ord, sub, gone): runs of removed windows (first byte, number) of the documents identified()."""
    spark = d.sparkSession
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    log_width = log_width_for(size // 25, most_cells)

    def hashes(batch):
        data, offs = buffer(batch.column(0))
        for i, j in chunks(offs):
            found = _runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], cap)
            if found is not None:
                yield np.concatenate([found[3], found[3][found[4]]])

    # two bits a cell: at most most_cells / 2 bytes, whatever the input's size
    bits = spark.sparkContext.broadcast(sketch_of(d.select("text"), hashes, log_width, levels=(2, crowded)))
    release(spark)

    def candidates(batches):
        for batch in gathered(batches, 2):
            ids, subs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offs = buffer(batch.column(2))
            held = []
            for i, j in chunks(offs):
                text, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                found = _runs(text, o, cap)
                if found is None:
                    continue
                keep = np.flatnonzero(repeated(bits.value[0], found[3]))
                if not len(keep):
                    continue
                row, start, m, key, inner = (x[keep] for x in found)
                hot = repeated(bits.value[1], key)
                if hot.any():  # one row a window, dealt by the window's own hash
                    each = ranges(start[hot], m[hot])
                    whole = np.repeat(row[hot], m[hot])
                    row, start = np.concatenate([row[~hot], whole]), np.concatenate([start[~hot], each])
                    key = np.concatenate([key[~hot], span_hash(text, each, each + cap, _SEEDS[1])])
                    inner = np.concatenate([inner[~hot], np.zeros(len(each), bool)])
                    m = np.concatenate([m[~hot], np.ones(len(each), np.int64)])
                end = start + m + cap - 1
                one, two = (span_hash(text, start, end, x) for x in _SEEDS)
                held.append((ids[i:j][row], subs[i:j][row], start - o[row], m, key, inner, one, two, start + offs[i]))
            if not held:
                continue
            doc, sub, pos, m, key, inner, one, two, start = (np.concatenate(x) for x in zip(*held))
            stop = start + m + cap - 1
            text = memoryview(data)
            gone = np.zeros(len(doc), bool)
            gone[not_first(doc, sub, pos, one, two, same_spans(text, start, stop))] = True
            # known already: any task may pass them on, so each place has a key of its own
            key = np.where(gone, mix(doc.view(np.uint64) ^ mix(pos.astype(np.uint64))), key).view(np.int64)
            for i in range(0, len(doc), 20000):
                x = slice(i, i + 20000)
                content = [b"" if g else text[a:b].tobytes() for g, a, b in zip(gone[x].tolist(), start[x].tolist(), stop[x].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[x]), pa.array(doc[x]), pa.array(sub[x]), pa.array(pos[x].astype(np.int32)), pa.array(m[x].astype(np.int32)), pa.array(inner[x]), pa.array(content, pa.binary())],
                    names=["key", "ord", "sub", "pos", "n", "inner", "content"],
                )

    met = d.mapInArrow(candidates, _ROW).repartition(parts(spark), "key").sortWithinPartitions("key")

    marked = met.mapInArrow(lambda batches: by_key(batches, lambda t: _marks(t, cap), repeated_rows, shard), MARK)
    gone = table(marked.groupBy("ord", "sub").agg(F.collect_set(F.struct("pos", "n")).alias("gone")), "suffix-runs")
    bits.destroy()
    return gone


def _marks(t: pa.Table, cap: int) -> Iterator[pa.RecordBatch]:
    """The removed runs of a table of complete minimisers."""
    key, doc, sub, pos, n = (t.column(c).to_numpy() for c in ("key", "ord", "sub", "pos", "n"))
    pos, n = pos.astype(np.int64), n.astype(np.int64)
    inner = t.column("inner").to_numpy(zero_copy_only=False)
    data, offs = buffer(t.column("content"))
    later = later_rows(t)
    if later.any():
        yield marks_of(doc[later], sub[later], pos[later], n[later])
    held = np.flatnonzero(~later)
    if len(held):
        _, back, count = np.unique(key[held], return_inverse=True, return_counts=True)
        held = held[(count[back] > 1) | inner[held]]
    if len(held):
        found = _within(data, offs, held, doc, sub, pos, n, cap)
        if len(found[0]):
            yield marks_of(*found)


def _within(data, offs, held, doc, sub, pos, n, cap):
    """The removed runs among different texts, by the order of their suffixes."""
    held = held[np.lexsort((pos[held], sub[held], doc[held]))]  # places in order: a smaller index is an earlier place
    size = n[held] + cap - 1
    text = data[ranges(offs[:-1][held], size)]
    begin = np.cumsum(size) - size
    gone = []
    run_p: list[np.ndarray] = []

    def close(p: np.ndarray, lead: np.ndarray) -> None:
        """Marks the windows of complete classes; lead: whether an entry opens a class."""
        which = np.searchsorted(begin, p, "right") - 1
        whole = p - begin[which] < n[held][which]
        cls = np.cumsum(lead)[whole]
        p = p[whole]
        if len(p):
            order = np.lexsort((p, cls))
            c = cls[order]
            gone.append(p[order[1:][c[1:] == c[:-1]]])

    lead_rest: list[np.ndarray] = []
    for p, lcp in InducedSorter(text, cap).order():
        lead = lcp < cap
        at = np.flatnonzero(lead)
        if len(at):  # all before the last opening is complete
            cut = int(at[-1])
            close(np.concatenate([*run_p, p[:cut]]), np.concatenate([*lead_rest, lead[:cut]]))
            run_p, lead_rest = [p[cut:].copy()], [lead[cut:].copy()]
        else:
            run_p.append(p.copy())
            lead_rest.append(lead.copy())
    if run_p:
        close(np.concatenate(run_p), np.concatenate(lead_rest))
    gone = np.sort(np.concatenate(gone)) if gone else np.zeros(0, np.int64)
    which = np.searchsorted(begin, gone, "right") - 1
    s, m = runs(which, step=gone)
    w = held[which[s]]
    return doc[w], sub[w], pos[w] + gone[s] - begin[which[s]], m


def dedup_bytes(docs: DataFrame, cap: int = 100, carry: list[str] | None = None, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept BINARY, kept_text): what is left of each document.

    carry: further columns of docs to pass on. kept_text leaves out the parts of characters
    that stand alone after a cut.
    """
    carry = carry or []
    d = identified(docs, carry)
    gone = removed_runs(d.select("ord", "sub", "text"), cap, **options)
    release(d.sparkSession)
    both = d.join(gone, ["ord", "sub"], "left").select("ord", "text", "gone.pos", "gone.n", *carry)
    passed = [f for f in both.schema.fields if f.name in carry]
    schema = ", ".join(
        ["ord bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_text string"]
        + [f"`{f.name}` {f.dataType.simpleString()}" for f in passed]
    )

    def run(batches):
        for batch in (x for b in batches for x in pieces(b, 1)):
            ids, texts, pos, n, *rest = batch.columns
            total, removed, spans, kept = [], [], [], []
            for k, text in enumerate(texts):
                raw = text.as_py().encode()
                total.append(len(raw))
                if pos[k].is_valid:
                    a, m = np.asarray(pos[k].values), np.asarray(n[k].values)
                    hit = covered(a, a + m + cap - 1, len(raw))
                    removed.append(int(hit.sum()))
                    spans.append(int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()))
                    raw = np.frombuffer(raw, np.uint8)[~hit].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(raw)
            whole = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(x, pa.int64()) for x in (total, removed, spans)), pa.array(kept, pa.binary()), whole, *rest],
                names=["ord", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", *carry],
            )

    left = both.mapInArrow(run, schema)
    return left.select(F.nullif("ord", F.lit(LOWEST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_text", *carry)
