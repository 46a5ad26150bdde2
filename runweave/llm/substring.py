"""Substring deduplication by words: a count-min prefilter, then exact grouping.

A window is width consecutive words of one document. Pass one counts all windows in partial
count-min sketches that are merged; the estimates are never too low. Pass two keeps only
windows estimated to repeat, and in each task only the earliest of equal windows (later ones
are already known to go), so a passage that a third of all documents share reaches the
shuffle once a task. Windows travel in runs: neighbours with the same minimiser (the least
hash of five consecutive words within the window, which equal windows share) are one row
with the run's words, and rows meet by minimiser. The same sketch counts runs by minimiser;
those of a hot one (split or more) are dealt as single windows by the window's own hash, so
that no task gets a third of the table. There windows are grouped, and all but the earliest
(smallest document, then start) are marked. The marks return to their documents, whose
covered words are removed.

Grouping is exact: two 64-bit hashes bring windows together, and each window that is to go
is compared with the one it repeats, word by word (common.word_ids).

Defined cases: null text has no words; texts shorter than the window stay whole; rows with
equal doc_id and text are one document and get equal results; equal doc_id with different
texts are documents in the order of their text hashes; a null doc_id comes before all
others (so does the id -2^63, which is read back as null); very long texts and words are
worked like others; an empty table gives an empty result; other columns are ignored, and
names like ord or key among them do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import buffer, chunks, gathered, mix, parts, pieces, release, row_hash, table, window_hash, word_bounds, word_hash, word_ids
from runweave.llm.countmin import log_width_for, repeated, sketch_of
from runweave.llm.windows import by_key, covered, key_runs, not_first, ranges, runs, same_spans, same_words

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_GRAM = 5
LOWEST = -(2**63)


def _windows(data: np.ndarray, offs: np.ndarray, width: int):
    """(row, first word within its row, first word, hash) of all windows of the rows, and the words' names and bounds."""
    starts, ends, first = word_bounds(data, offs)
    n = np.diff(first)
    per = np.maximum(n - width + 1, 0)
    if not per.sum():
        return None
    at = ranges(first[:-1], per)
    row = np.repeat(np.arange(len(n)), per)
    ids = word_ids(data, starts, ends)
    words = word_hash(ids, _SEEDS[0])
    one = window_hash(words, width, _SEEDS[0])[at]
    return row, at - first[row], at, one, ids, words, starts, ends


def _key_runs(row: np.ndarray, at: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same minimiser, see windows.key_runs."""
    return key_runs(window_hash(words, _GRAM, _SEEDS[0]), row, at, width - _GRAM + 1)


def identified(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(ord, sub, text, ...): ord orders documents by doc_id (null first), sub is their text's hash."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("ord"), F.xxhash64("text").alias("sub"),
        F.coalesce("text", F.lit("")).alias("text"), *(carry or []),
    )


def removed_runs(d: DataFrame, width: int = 20, most_cells: int = 1 << 28, split: int = 20000, held_bytes: int = 8 << 20) -> DataFrame:
    """(ord, sub, gone): runs of removed windows (first word, number) of the documents identified()."""
    spark = d.sparkSession
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    log_width = log_width_for(size // 6, most_cells)

    def hashes(batch):
        data, offs = buffer(batch.column(0))
        for i, j in chunks(offs):
            found = _windows(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
            if found is not None:
                row, _, at, one, _, words, _, _ = found
                _, _, least, inner = _key_runs(row, at, words, width)
                least = mix(least)
                yield np.concatenate([one, least, least[inner]])

    # two bits a cell: at most most_cells / 2 bytes, whatever the input's size
    bits = spark.sparkContext.broadcast(sketch_of(d.select("text"), hashes, log_width, levels=(2, split)))
    release(spark)

    def candidates(batches):
        for batch in gathered(batches, 2):
            docs, subs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offs = buffer(batch.column(2))
            held, named, words_before = [], [], 0
            for i, j in chunks(offs):
                found = _windows(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                if found is None:
                    continue
                row, pos, at, one, ids, words, starts, ends = found
                s, n, least, _ = _key_runs(row, at, words, width)
                # equal windows have equal minimisers, so both must be estimated to repeat
                maybe, hot = repeated(bits.value[0], mix(least)), repeated(bits.value[1], mix(least))
                keep = np.flatnonzero(np.repeat(maybe, n) & repeated(bits.value[0], one))
                if not len(keep):
                    continue
                hot, least = np.repeat(hot, n)[keep], np.repeat(least, n)[keep]
                row, pos, at, one = row[keep], pos[keep].astype(np.int32), at[keep], one[keep]
                two = window_hash(word_hash(ids, _SEEDS[1]), width, _SEEDS[1])[at]
                begin, end = ((x + offs[i]).astype(np.int64) for x in (starts[at], ends[at + width - 1]))
                held.append((docs[i:j][row], subs[i:j][row], pos, one, two, np.where(hot, one, least), hot, at + words_before, begin, end))
                named.append(ids)
                words_before += len(ids[0])
            if not held:
                continue
            doc, sub, pos, one, two, key, hot, at, begin, end = (np.concatenate(x) for x in zip(*held))
            ids = tuple(np.concatenate(x) for x in zip(*named))
            del held, named
            later = np.zeros(len(doc), bool)
            later[not_first(doc, sub, pos, one, two, same_words(ids, at, width))] = True
            del one, two, at, ids
            order = np.lexsort((pos, sub, doc))
            doc, sub, pos, key, hot, later, begin, end = (x[order] for x in (doc, sub, pos, key, hot, later, begin, end))
            # runs of windows to compare elsewhere, one by one where they are hot, and runs that are known to go
            alone = np.where(hot & ~later, np.arange(len(doc)), -1)
            s, n = runs(doc, sub, np.where(later, np.uint64(0), key), later, alone, step=pos)
            del order, alone
            gone = later[s]
            # windows known to go may pass through any task, so each place has a key of its own
            keys = np.where(gone, mix(doc[s].view(np.uint64) ^ mix(pos[s].astype(np.uint64))), key[s]).view(np.int64)
            begin, end = begin[s], end[s + n - 1]
            text = memoryview(data)
            for i in range(0, len(s), 20000):
                x = slice(i, i + 20000)
                content = [b"" if g else text[a:b].tobytes() for g, a, b in zip(gone[x].tolist(), begin[x].tolist(), end[x].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[x]), pa.array(doc[s[x]]), pa.array(sub[s[x]]), pa.array(pos[s[x]].astype(np.int32)), pa.array(n[x].astype(np.int32)), pa.array(content, pa.binary())],
                    names=["key", "ord", "sub", "pos", "n", "content"],
                )

    found = d.mapInArrow(candidates, "key bigint, ord bigint, sub bigint, pos int, n int, content binary")
    met = found.repartition(parts(spark), "key").sortWithinPartitions("key")
    marked = met.mapInArrow(lambda batches: by_key(batches, lambda t: _later(t, width), repeated_rows, held_bytes), MARK)
    gone = table(marked.groupBy("ord", "sub").agg(F.collect_set(F.struct("pos", "n")).alias("gone")), "substring-runs")
    bits.destroy()
    return gone


MARK = "ord bigint, sub bigint, pos int, n int"


def marks_of(doc, sub, pos, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(sub), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], names=["ord", "sub", "pos", "n"]
    )


def later_rows(t: pa.Table) -> np.ndarray:
    """Which rows are known to go (no content), or have the whole content of a row at an earlier place."""
    doc, sub, pos = (t.column(c).to_numpy() for c in ("ord", "sub", "pos"))
    data, offs = buffer(t.column("content"))
    out = offs[1:] == offs[:-1]
    live = np.flatnonzero(~out)
    one, two = (row_hash(data, offs, x)[live] for x in _SEEDS)
    same = same_spans(data.tobytes(), offs[:-1][live], offs[1:][live])
    out[live[not_first(doc[live], sub[live], pos[live], one, two, same)]] = True
    return out


def repeated_rows(t: pa.Table) -> tuple[pa.RecordBatch | None, pa.Table]:
    """The marks of the rows that repeat others, and the table of the others."""
    later = later_rows(t)
    rest = t.filter(pa.array(~later))
    if not later.any():
        return None, rest
    return marks_of(*(t.column(c).to_numpy()[later] for c in ("ord", "sub", "pos", "n"))), rest


def _later(t: pa.Table, width: int):
    """The removed runs of a table of complete keys."""
    marks, t = repeated_rows(t)
    if marks is not None:
        yield marks
    if not len(t):
        return
    doc, sub, pos = (t.column(c).to_numpy() for c in ("ord", "sub", "pos"))
    data, offs = buffer(t.column("content"))
    row, place, at, one, ids, _, _, _ = _windows(data, offs, width)
    two = window_hash(word_hash(ids, _SEEDS[1]), width, _SEEDS[1])[at]
    d, b, p = doc[row], sub[row], pos[row] + place
    gone = not_first(d, b, p, one, two, same_words(ids, at, width))
    gone = gone[np.lexsort((p[gone], b[gone], d[gone]))]
    s, m = runs(d[gone], b[gone], step=p[gone])
    if len(s):
        yield marks_of(d[gone][s], b[gone][s], p[gone][s], m)


def dedup_words(docs: DataFrame, width: int = 20, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): what is left of each document, one space between words."""
    d = identified(docs)
    gone = removed_runs(d, width, **options)
    release(d.sparkSession)
    both = d.join(gone, ["ord", "sub"], "left").select("ord", "text", "gone.pos", "gone.n")

    def run(batches):
        for batch in (x for b in batches for x in pieces(b, 1)):
            ids, texts, pos, n = batch.columns
            total, removed, kept = [], [], []
            for k, text in enumerate(texts):
                words = text.as_py().encode().split()
                total.append(len(words))
                if pos[k].is_valid:
                    a, m = np.asarray(pos[k].values), np.asarray(n[k].values)
                    hit = covered(a, a + m + width - 1, len(words))
                    words = [w for w, h in zip(words, hit.tolist()) if not h]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["ord", "n_words", "n_removed", "kept"],
            )

    left = both.mapInArrow(run, "ord bigint, n_words bigint, n_removed bigint, kept string")
    return left.select(F.nullif("ord", F.lit(LOWEST)).alias("doc_id"), "n_words", "n_removed", "kept")
