"""External induced sorting of the suffixes of one shard, with common-prefix values.

Suffixes are L (greater than the one that starts a byte later) or S; an S suffix after an L
one is S*. Sorted S* suffixes induce the order of the L suffixes in an ascending scan, and
those the order of the S suffixes in a descending scan: a scanned suffix puts the one that
starts a byte earlier into the queue of that one's first byte. The queues together are the
priority queue: one per first byte, first in first out, held on disk beyond a memory
budget. Each entry is a tuple of position and common-prefix value; the value of two
neighbours in a queue is one more than the least value between the suffixes that put them
there, which a sparse table answers for a whole batch at once.

Common prefixes count up to cap, all that deduplication by windows of cap bytes asks:
suffixes that share cap bytes stand together and in any order. The recursion is on prefix
depth instead of names: ties among S* suffixes are refined by their next eight bytes until
cap bytes are told apart, bucket by bucket, so no more than one bucket of S* is in memory.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

_ENTRY = np.dtype([("pos", "<i8"), ("lcp", "u1")])


class ByteQueues:
    """One first-in-first-out queue of (position, common prefix) for each byte, on disk beyond memory bytes."""

    def __init__(self, folder: Path, memory: int) -> None:
        self.folder, self.memory, self.held = folder, memory, 0
        self.blocks: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(256)]
        self.files: dict[int, object] = {}
        self.sizes = np.zeros(256, np.int64)

    def push(self, byte: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        block = np.empty(len(pos), _ENTRY)
        block["pos"], block["lcp"] = pos, lcp
        self.blocks[byte].append(block)
        self.sizes[byte] += len(block)
        self.held += block.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        for byte, blocks in enumerate(self.blocks):
            for k, b in enumerate(blocks):
                if isinstance(b, np.ndarray):
                    if byte not in self.files:
                        self.files[byte] = open(self.folder / f"{byte}", "w+b")  # noqa: SIM115
                    f = self.files[byte]
                    f.seek(0, 2)
                    at = f.tell()
                    b.tofile(f)
                    blocks[k] = (at, len(b))
        self.held = 0

    def block(self, byte: int, k: int) -> np.ndarray | None:
        """The k-th block of a queue; None beyond its end, which later pushes may move."""
        blocks = self.blocks[byte]
        if k >= len(blocks):
            return None
        b = blocks[k]
        if isinstance(b, np.ndarray):
            return b
        f = self.files[byte]
        f.seek(b[0])
        return np.fromfile(f, _ENTRY, b[1])

    def merged(self, byte: int, k: int, most: int) -> tuple[np.ndarray | None, int]:
        """Blocks from the k-th on, together up to about most entries, and the next k."""
        got = [self.block(byte, k)]
        if got[0] is None:
            return None, k
        k += 1
        size = len(got[0])
        while size < most and (b := self.block(byte, k)) is not None:
            got.append(b)
            size += len(b)
            k += 1
        return (np.concatenate(got) if len(got) > 1 else got[0]), k

    def close(self) -> None:
        for f in self.files.values():
            f.close()


class _RangeMin:
    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        size = 1
        while size * 2 <= len(values):
            x = self.levels[-1]
            self.levels.append(np.minimum(x[:-size], x[size:]))
            size *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first .. last], both included; 255 where the range is empty."""
        out = np.full(len(first), 255, np.uint8)
        n = last - first + 1
        level = np.frexp(np.maximum(n, 1))[1] - 1
        for k in range(len(self.levels)):
            at = np.flatnonzero((level == k) & (n > 0))
            if len(at):
                x = self.levels[k]
                out[at] = np.minimum(x[first[at]], x[last[at] - (1 << k) + 1])
        return out


class InducedSorter:
    def __init__(self, text: np.ndarray, cap: int = 100, memory: int = 64 << 20, batch: int = 1 << 19) -> None:
        self.text, self.cap, self.memory, self.batch = text, cap, memory, batch
        self.n = len(text)

    # ---- S* suffixes

    def _types(self) -> np.ndarray:
        """1 for S suffixes, right to left in pieces; the last suffix is L."""
        t, n = self.text, self.n
        s = np.zeros(n + 1, np.uint8)
        step = 1 << 22
        for b in range(n - 1, 0, -step):
            a = max(0, b - step)  # the suffixes a .. b - 1
            x = t[a : b + 1]
            less, equal = x[:-1] < x[1:], x[:-1] == x[1:]
            at = np.where(equal, len(less), np.arange(len(less)))
            at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
            known = np.append(less, bool(s[b]))
            s[a:b] = known[at]
        return s[:n]

    def _word(self, pos: np.ndarray) -> np.ndarray:
        """Eight bytes from each position as a big-endian number; zeros after the end."""
        if not hasattr(self, "_padded"):
            self._padded = np.concatenate([self.text, np.zeros(self.cap + 16, np.uint8)])
        out = np.zeros(len(pos), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | self._padded[pos + k]
        return out

    def _sorted_by_depth(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions ordered by their next cap bytes, and the common prefix of each with the one before."""
        n, cap = len(pos), self.cap
        lcp = np.full(n, cap, np.uint8)
        if n:
            lcp[0] = 0
        group = np.zeros(n, np.int64)
        active = np.arange(n)
        depth = 0
        while len(active) > 1 and depth < cap:
            p = pos[active]
            word = self._word(np.minimum(p + depth, self.n))
            order = np.lexsort((word, group[active]))
            pos[active], word = p[order], word[order]
            g = group[active]
            differ = (word[1:] != word[:-1]) & (g[1:] == g[:-1])
            at = np.flatnonzero(differ) + 1
            x = word[at] ^ word[at - 1]
            same = np.zeros(len(at), np.int64)
            for k in range(1, 8):
                same += (x >> np.uint64(8 * (8 - k))) == 0
            lcp[active[at]] = np.minimum(depth + same, cap)
            new = np.concatenate([[True], (g[1:] != g[:-1]) | differ])
            group[active] = active[np.flatnonzero(new)][np.cumsum(new) - 1]
            size = np.diff(np.append(np.flatnonzero(new), len(active)))
            active = active[np.repeat(size > 1, size)]
            depth += 8
        return pos, lcp

    def _common(self, a: int, b: int) -> int:
        x, y = self.text[a : a + self.cap], self.text[b : b + self.cap]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        return int(differ[0]) if len(differ) else m

    # ---- induction

    def _induce(self, pos: np.ndarray, lcp: np.ndarray, stype: int, queues: ByteQueues, since: np.ndarray) -> None:
        """Puts the suffixes of type stype that precede the scanned ones into their queues.

        since: for each byte the least common prefix scanned since its last entry, -1 if it
        has none yet.
        """
        before = pos - 1
        at = np.flatnonzero(before >= 0)
        at = at[self.stype[before[at]] == stype]
        least = int(lcp.min()) if len(lcp) else 255
        if not len(at):
            np.minimum(since, least, out=since, where=since >= 0)
            return
        byte = self.text[before[at]]
        order = np.argsort(byte, kind="stable")
        at, byte = at[order], byte[order]
        first = np.concatenate([[True], byte[1:] != byte[:-1]])
        low = np.concatenate([[0], at[:-1] + 1])
        low[first] = 0
        rmq = _RangeMin(lcp)
        value = np.minimum(rmq(low, at).astype(np.int64), self.cap)
        starts = np.flatnonzero(first)
        heads = byte[starts]
        value[starts] = np.minimum(value[starts], since[heads])
        value = np.minimum(value + 1, self.cap)  # no entry before: -1 + 1 = 0
        ends = np.append(starts[1:], len(at))
        tail = rmq(at[ends - 1] + 1, np.full(len(ends), len(lcp) - 1)).astype(np.int64)
        np.minimum(since, least, out=since, where=since >= 0)
        since[heads] = np.minimum(tail, self.cap)
        target = before[at]
        for b, i, j in zip(heads.tolist(), starts.tolist(), ends.tolist()):
            queues.push(b, target[i:j], value[i:j])

    def order(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefix of each with the one before it) of all suffixes, in descending order."""
        if not self.n:
            return
        folder = Path(tempfile.mkdtemp(prefix="induced-"))
        try:
            yield from self._order(folder)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def _order(self, folder: Path) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, t = self.n, self.text
        self.stype = self._types()
        star = np.zeros(n, bool)
        star[1:] = (self.stype[1:] == 1) & (self.stype[:-1] == 0)
        made = []
        for name in ("star", "l", "s"):
            (folder / name).mkdir()
            made.append(ByteQueues(folder / name, self.memory // 3))
        stars, ls, ss = made
        step = 1 << 22
        for a in range(0, n, step):
            pos = np.flatnonzero(star[a : a + step]) + a
            byte = t[pos]
            order = np.argsort(byte, kind="stable")
            pos, byte = pos[order], byte[order]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)]):
                if j > i:
                    stars.push(int(byte[i]), pos[i:j], np.zeros(j - i, np.uint8))
        del star
        since = np.full(256, -1, np.int64)
        ls.push(int(t[n - 1]), np.array([n - 1]), np.zeros(1, np.uint8))
        since[t[n - 1]] = 0
        for c in range(256):
            k, last = 0, -1
            while True:
                block, k = ls.merged(c, k, self.batch)
                if block is None:
                    break
                last = int(block["pos"][-1])
                for i in range(0, len(block), self.batch):
                    self._induce(block["pos"][i : i + self.batch], block["lcp"][i : i + self.batch], 0, ls, since)
            found, _ = stars.merged(c, 0, 1 << 62)
            if found is not None:
                pos, lcp = self._sorted_by_depth(found["pos"].copy())
                lcp[0] = self._common(last, int(pos[0])) if last >= 0 else 0
                for i in range(0, len(pos), self.batch):
                    self._induce(pos[i : i + self.batch], lcp[i : i + self.batch], 0, ls, since)
        stars.close()
        since = np.full(256, -1, np.int64)
        for c in range(255, -1, -1):
            k, last = 0, -1
            while True:
                block, k = ss.merged(c, k, self.batch)
                if block is None:
                    break
                last = int(block["pos"][-1])
                for i in range(0, len(block), self.batch):
                    pos, lcp = block["pos"][i : i + self.batch], block["lcp"][i : i + self.batch]
                    self._induce(pos, lcp, 1, ss, since)
                    yield pos, lcp
            follow = -1  # the common prefix of the entry scanned next with the one after it
            for k in range(len(ls.blocks[c]) - 1, -1, -1):
                block = ls.block(c, k)
                pos = block["pos"][::-1]
                lcp = np.empty(len(pos), np.uint8)
                lcp[1:] = block["lcp"][::-1][:-1]
                if follow >= 0:
                    lcp[0] = follow
                else:
                    lcp[0] = self._common(last, int(pos[0])) if last >= 0 else 0
                follow = int(block["lcp"][0])
                for i in range(0, len(pos), self.batch):
                    self._induce(pos[i : i + self.batch], lcp[i : i + self.batch], 1, ss, since)
                    yield pos[i : i + self.batch], lcp[i : i + self.batch]
        ls.close()
        ss.close()
