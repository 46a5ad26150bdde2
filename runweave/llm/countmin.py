"""Count-min sketches of 64-bit hashes: partial sketches per task, merged by block of cells.

A partial sketch lists its non-zero cells in order as byte-coded gaps, so it costs one to
two bytes a distinct hash whatever the sketch's width. Blocks of 2^20 cells are merged in
parallel. What comes back to the driver, and is broadcast, is one bit a cell (did two or
more hashes fall there): at most most_cells / 8 bytes a row, whatever the input's size.
Estimates are never below the true counts, so a hash whose bits are not all set is unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runweave.llm.common import parts

BLOCK = 20  # log2 of the cells in a block


def encode_gaps(cells: np.ndarray) -> bytes:
    """Ascending distinct numbers as gaps: each 255 adds 255, any smaller byte ends a gap."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    more, rest = np.divmod(gaps, 255)
    out = np.full(int((more + 1).sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def decode_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def cells_of(hashes: np.ndarray, row: int, log_width: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch (rows use different bits of the hash)."""
    return ((hashes >> np.uint64(32 * row)) & np.uint64((1 << log_width) - 1)).astype(np.uint32)


def partial_sketch(hashes: np.ndarray, log_width: int, rows: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, cells with at least one hash, (cell, further hashes) of those with more)."""
    for row in range(rows):
        cells = np.sort(cells_of(hashes, row, log_width))
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, int)
        counts = np.diff(np.append(first, len(cells)))
        cells = cells[first]
        cuts = np.flatnonzero(np.diff(cells >> BLOCK)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
            if a == b:
                continue
            local = cells[a:b] & ((1 << BLOCK) - 1)
            many = counts[a:b] > 1
            extra = np.stack([local[many], counts[a:b][many] - 1], 1).astype(np.uint32)
            yield (row << (log_width - BLOCK)) + int(cells[a] >> BLOCK), encode_gaps(local), extra.tobytes()


def merged_bits(partials: DataFrame, log_width: int, rows: int, levels: tuple[int, ...] = (2,)) -> list[np.ndarray]:
    """For each level the (rows, width / 8) bits of the cells with at least so many hashes.

    partials: (block, cells, extra) rows of partial_sketch().
    """

    def merge(batches):
        at, acc = None, None
        done: list[tuple[int, bytes]] = []

        def close():
            if at is not None:
                done.append((at, b"".join(np.packbits(acc >= x, bitorder="little").tobytes() for x in levels)))

        for batch in batches:
            for block, cells, extra in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    close()
                    at, acc = block, np.zeros(1 << BLOCK, np.int64)
                acc[decode_gaps(cells)] += 1
                more = np.frombuffer(extra, np.uint32).reshape(-1, 2)
                acc[more[:, 0]] += more[:, 1]
                if len(done) >= 8:
                    yield _rows(done)
                    done = []
        close()
        yield _rows(done)

    def _rows(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.binary())], names=["block", "bits"]
        )

    n = min(parts(partials.sparkSession), rows << (log_width - BLOCK))
    merged = partials.repartition(n, "block").sortWithinPartitions("block").mapInArrow(merge, "block bigint, bits binary")
    out = [np.zeros((rows << (log_width - BLOCK), 1 << (BLOCK - 3)), np.uint8) for _ in levels]
    for r in merged.toLocalIterator():
        for bits, got in zip(out, np.frombuffer(bytes(r.bits), np.uint8).reshape(len(levels), -1)):
            bits[r.block] = got
    return [bits.reshape(rows, -1) for bits in out]


def repeated(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the sketch estimates to occur twice or more."""
    log_width = int(bits.shape[1]).bit_length() - 1 + 3
    out = np.ones(len(hashes), bool)
    for row in range(len(bits)):
        cells = cells_of(hashes, row, log_width)
        out &= (bits[row][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0
    return out


def log_width_for(expected: int, most_cells: int) -> int:
    """Cells for about four times the expected hashes, within 2^BLOCK and most_cells."""
    return max(BLOCK, min((4 * max(expected, 1)).bit_length() - 1, most_cells.bit_length() - 1, 32))


def sketch_of(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], log_width: int, rows: int = 2, levels: tuple[int, ...] = (2,)) -> list[np.ndarray]:
    """The merged bits of the hashes of all batches of docs, for each level."""

    def run(batches):
        for batch in batches:
            held, n = [], 0
            for h in [*hashes(batch), None]:
                if h is not None:
                    held.append(h)
                    n += len(h)
                if held and (h is None or n > 1 << 22):
                    found = list(partial_sketch(np.concatenate(held), log_width, rows))
                    held, n = [], 0
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.binary())],
                            names=["block", "cells", "extra"],
                        )

    return merged_bits(docs.mapInArrow(run, "block bigint, cells binary, extra binary"), log_width, rows, levels)
