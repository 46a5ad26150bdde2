"""Sliding windows shared by the two substring operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from runweave.llm.common import trim


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive entries."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def key_runs(grams: np.ndarray, row: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same minimiser, the least of the span grams from the window's start.

    at: the first gram of each window, in order; row: its row. Gives start and number of the
    windows of each run (places in at), the minimiser, and whether it stands twice in the run,
    as it must where two windows of one run are equal.
    """
    least = sliding_min(grams, span)
    s, m = runs(row, least[at], step=at)
    start, key = at[s], least[at[s]]
    inside = np.zeros(len(s), np.int64)
    for k in range(span):
        inside += grams[start + k] == key
    entering = np.add.reduceat((grams[at + span - 1] == least[at]).astype(np.int64), s) - (grams[start + span - 1] == key)
    return s, m, key, inside + entering > 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start .. start + length - 1, one range after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    has = lengths > 0
    starts, lengths = starts[has], lengths[has]
    if not total:
        return out
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def runs(*columns: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs in which all columns are equal and step grows by one."""
    n = len(step)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = step[1:] != step[:-1] + 1
    for c in columns:
        new = new | (c[1:] != c[:-1])
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    return starts, np.diff(np.append(starts, n))


def covered(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Which of 0 .. size - 1 lie in a range first .. last (last not included)."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return np.cumsum(edge[:-1]) > 0


def not_first(doc: np.ndarray, sub: np.ndarray, pos: np.ndarray, one: np.ndarray, two: np.ndarray, same: Callable) -> np.ndarray:
    """Indices of the entries that have an equal entry at an earlier place; equal places are one.

    Entries with equal hashes one and two are compared with the earliest of them by
    same(later, first), a boolean for each pair of indices. Those that differ after all are a
    class of their own and are compared among themselves.
    """
    order = np.lexsort((pos, sub, doc, two, one))
    if not len(order):
        return order
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    far = (doc[order] != doc[first]) | (sub[order] != sub[first]) | (pos[order] != pos[first])
    later, first = order[far], first[far]
    if not len(later):
        return later
    equal = same(later, first)
    if equal.all():
        return later
    rest = later[~equal]
    again = not_first(doc[rest], sub[rest], pos[rest], one[rest], two[rest], lambda x, y: same(rest[x], rest[y]))
    return np.concatenate([later[equal], rest[again]])


def same_spans(text: bytes | memoryview, starts: np.ndarray, ends: np.ndarray) -> Callable:
    """Compares spans of bytes, for not_first."""

    def same(later: np.ndarray, first: np.ndarray) -> np.ndarray:
        ends_at = zip(starts[later].tolist(), ends[later].tolist(), starts[first].tolist(), ends[first].tolist())
        return np.fromiter((b - a == d - c and text[a:b] == text[c:d] for a, b, c, d in ends_at), bool, len(later))

    return same


def same_words(ids: tuple[np.ndarray, np.ndarray], at: np.ndarray, width: int) -> Callable:
    """Compares windows of width named words, for not_first; at: the first word of each window."""

    def same(later: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty(len(later), bool)
        order = np.argsort(at[later], kind="stable")
        a, b = at[later][order], at[first][order]
        for i in range(0, len(a), 1 << 18):  # neighbours are compared together, in parts of bounded size
            x, y = a[i : i + (1 << 18)], b[i : i + (1 << 18)]
            s, n = runs(y - x, step=x)
            flat_x, flat_y = ranges(x[s], n + width - 1), ranges(y[s], n + width - 1)
            differ = (ids[0][flat_x] != ids[0][flat_y]) | (ids[1][flat_x] != ids[1][flat_y])
            before = np.concatenate([[0], np.cumsum(differ)])
            size = n + width - 1
            place = ranges(np.cumsum(size) - size, n)
            out[order[i : i + (1 << 18)]] = before[place + width] == before[place]
        return out

    return same


def by_key(batches: Iterator[pa.RecordBatch], work: Callable, repeats: Callable, limit: int) -> Iterator[pa.RecordBatch]:
    """work() over tables of whole keys, about limit bytes each, of batches sorted by key.

    A key with more than that goes through repeats(), which gives a batch of marks of rows
    that repeat others, or None, and the table of the rest; so no more than the different
    rows of a key are held.
    """
    held: list[pa.Table] = []
    size, most = 0, limit
    for batch in batches:
        if not len(batch):
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size <= most:
            continue
        t = pa.concat_tables(held).combine_chunks()
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
        if cut:
            yield from work(t.slice(0, cut))
            t = pa.concat_tables([t.slice(cut)]).combine_chunks()
        else:
            marks, t = repeats(t)
            if marks is not None:
                yield marks
        held, size = [t], t.nbytes
        most = max(limit, 2 * size)
    if held:
        yield from work(pa.concat_tables(held).combine_chunks())
    trim()
