"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

A character trigram model is counted over all documents, each between separators. Words that
mix letters with look-alike digits and signs, repeat a letter three times or more, or stand
as single letters in a row are decoded: a Viterbi search over the lattice of possible
readings of each character (itself, the letters it can stand for, nothing where it is a
separator or a repetition) finds the reading that is likeliest under the channel and the
trigram model. The search is exact for words and rows of any length: no state is dropped,
and back pointers, given up where all readings agree, keep it linear. All other words have
one reading and pass unchanged.

The restored text's words and their beginnings are binary features in a hash space of
2^space_bits places; their logistic regression is learnt from at most max_train labelled
rows (least hash of doc_id). Both are parameters, and the same at every size of input.
Labels, lang, source and doc_id are never features.

Defined cases: null and empty texts score the bias alone; rows without a label or with a
null one are scored but not learnt from; repeated labels of a doc_id count once (the larger
toxic); repeated rows each get a score; a table without usable labels scores 0 everywhere;
very long texts and words are read as a whole; an empty table gives an empty result; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import buffer, chunks, span_hash, trim, word_bounds
from runweave.llm.windows import runs

# Character classes of the language model: 0 separators, 1-26 letters, 27 other letters, 28 all else.
_CLASSES = 29
_CLASS = np.full(256, 28, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13, 44, 46, 45, 59, 58, 39, 34, 63]] = 0
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Letters that digits and signs stand for (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_JOINERS = " .-_*~'"
_LEET = np.zeros(256, np.int32)
_LEET[[ord(c) for c in "0123456789@$!|+("]] = 1
_JOIN = np.zeros(256, np.int32)
_JOIN[[ord(c) for c in ".-_*~'"]] = 1
_LETTER = np.zeros(256, np.int32)
_LETTER[97:123] = 1
_WORDY = np.zeros(256, bool)
_WORDY[97:123] = True
_WORDY[48:58] = True
_WORDY[128:] = True

_SEED = 0xE7037ED1A0B428DB
#: Lengths in bytes of the word beginnings that are features; 0 is the whole word.
_PREFIXES = (0, 4, 5, 6)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character class trigrams over all texts, as a 29 x 29 x 29 array."""

    def run(batches):
        total = np.zeros(_CLASSES**3, np.int64)
        for batch in batches:
            data, offs = buffer(batch.column(0))
            for i, j in chunks(offs):
                # two separators before each row and after the last: no trigram has letters of two rows
                c = np.insert(_CLASS[data[offs[i] : offs[j]]], np.repeat(offs[i : j + 1] - offs[i], 2), 0).astype(np.int32)
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(_CLASSES**3, np.int64)
    rows = docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most 29^3 rows
        out[r.gram] = r.n
    return out.reshape(_CLASSES, _CLASSES, _CLASSES)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b): trigrams interpolated with bigrams and single characters."""
    one = counts.sum((0, 1)) + 1.0
    two = counts.sum(0) + 0.0
    p1 = one / one.sum()
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (counts + 5 * p2[None]) / (counts.sum(2, keepdims=True) + 5)
    return np.log(p3)


@dataclass
class Decoder:
    """Viterbi search over the readings of a span; the state is the last two classes and the last letter read."""

    logp: list
    substitute: float = log(0.25)
    keep_odd: float = log(0.02)
    drop_joiner: float = log(0.4)
    keep_joiner: float = log(0.2)
    drop_repeat: float = log(0.5)
    known: dict = field(default_factory=dict)
    #: Characters after which back pointers that all readings share are followed and given up.
    settle: int = 4096

    def __post_init__(self) -> None:
        self.options: dict[str, list[tuple[str, int, float]]] = {}

    def readings(self, ch: str) -> list[tuple[str, float]]:
        """What a character may be, with log channel probabilities ('' is nothing)."""
        if "a" <= ch <= "z":
            return [(ch, 0.0)]
        out = [(x, self.substitute) for x in LOOKALIKES.get(ch, "")]
        if ch in _JOINERS:
            return [("", self.drop_joiner), (ch, self.keep_joiner)]
        return [*out, (ch, self.keep_odd if out else 0.0)]

    def _options(self, ch: str) -> list[tuple[str, int, float]]:
        if ch not in self.options:
            if len(self.options) > 10_000:  # a cache
                self.options.clear()
            self.options[ch] = [(x, (int(_CLASS[ord(x)]) if ord(x) < 128 else 27) if x else 0, cost) for x, cost in self.readings(ch)]
        return self.options[ch]

    def decode(self, span: str) -> str:
        """The likeliest reading."""
        if span in self.known:
            return self.known[span]
        best, _ = self.search(span)
        if len(self.known) > 50_000:  # a cache
            self.known.clear()
        if len(span) < 100:
            self.known[span] = best
        return best

    def search(self, span: str) -> tuple[str, float]:
        """The likeliest reading and its log probability."""
        keys, scores, back, settled = [(0, 0, "")], [0.0], [], []
        logp, drop_repeat, due = self.logp, self.drop_repeat, self.settle
        shared: dict[tuple, tuple] = {}
        for ch in span:
            options = self._options(ch)
            index: dict[tuple[int, int, str], int] = {}
            new_keys, new_scores, steps = [], [], []
            for i, key in enumerate(keys):
                a, b, last = key
                score, row = scores[i], logp[a][b]
                for x, c, cost in options:
                    moves = ((key, score + cost, ""),) if x == "" else (((b, c, x), score + cost + row[c], x),)
                    if x and x == last and 0 < c < 28:  # a repetition of what was read
                        moves = (*moves, (key, score + cost + drop_repeat, ""))
                    for to, value, out in moves:
                        at = index.get(to)
                        if at is None:
                            index[to] = len(new_keys)
                            new_keys.append(to)
                            new_scores.append(value)
                            steps.append((i, out))
                        elif new_scores[at] < value:
                            new_scores[at], steps[at] = value, (i, out)
            keys, scores = new_keys, new_scores
            made = tuple(steps)
            back.append(shared.setdefault(made, made))  # few differ: 8 bytes a character
            if len(back) >= due:
                back = self._settle(back, len(keys), settled)
                due = max(self.settle, 2 * len(back))
        last = max(range(len(keys)), key=lambda i: (scores[i] + logp[keys[i][0]][keys[i][1]][0], keys[i]))
        total = scores[last] + logp[keys[last][0]][keys[last][1]][0]
        tail = []
        for steps in reversed(back):
            last, out = steps[last]
            tail.append(out)
        return "".join(settled) + "".join(reversed(tail)), total

    @staticmethod
    def _settle(back: list, states: int, settled: list[str]) -> list:
        """Moves what all states' readings share to settled; the back pointers that are left."""
        alive = set(range(states))
        for k in range(len(back) - 1, -1, -1):
            alive = {back[k][i][0] for i in alive}
            if len(alive) == 1:  # all pass through one state before character k
                at, out = next(iter(alive)), []
                for steps in reversed(back[:k]):
                    at, x = steps[at]
                    out.append(x)
                settled.append("".join(reversed(out)))
                return back[k:] if k else back
        return back


def suspicious(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of lower-cased data to decode: odd words, and rows of three or more single letters."""
    starts, ends, first = word_bounds(data, offs)
    if not len(starts):
        return []
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    letters, leet, joins = (sums(t[data]) for t in (_LETTER, _LEET, _JOIN))
    triple = np.zeros(len(data) + 1, np.int64)
    same = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (_LETTER[data[2:]] > 0)
    triple[3:] = np.cumsum(same)  # how many triples end before a byte
    size = ends - starts
    n, m, j = (x[ends] - x[starts] for x in (letters, leet, joins))
    # edges do not count: a closing '!' or '.' is no disguise
    m = m - (_LEET[data[ends - 1]] * (_LETTER[data[np.maximum(ends - 2, 0)]] > 0) * (data[ends - 1] == 33))
    odd = (n > 0) & (m > 0)
    odd |= (triple[ends] - triple[np.minimum(starts + 2, ends)] > 0)
    odd |= (n >= 3) & (j >= n - 1)
    single = (size == 1) & (n + m == 1)
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    out = list(zip(starts[odd].tolist(), ends[odd].tolist()))
    letter = np.flatnonzero(single)
    at, size = runs(row[letter], step=letter)
    at, size = at[size >= 3], size[size >= 3]
    out += zip(starts[letter[at]].tolist(), ends[letter[at + size - 1]].tolist())
    return sorted(out)


def restore(data: np.ndarray, offs: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts with their suspicious spans decoded."""
    data = _LOWER[data]
    spans = suspicious(data, offs)
    if not spans:
        return data, offs
    raw = data.tobytes()
    pieces, at, grown, marks = [], 0, [], []
    for a, b in spans:
        if a < at:
            continue
        new = decoder.decode(raw[a:b].decode("utf-8", "replace")).encode()
        pieces += [raw[at:a], new]
        marks.append(b)
        grown.append(len(new) - (b - a))
        at = b
    pieces.append(raw[at:])
    shift = np.concatenate([[0], np.cumsum(grown)])
    return np.frombuffer(b"".join(pieces), np.uint8), offs + shift[np.searchsorted(marks, offs, "right")]


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of restored texts and their beginnings, without marks at their ends."""
    starts, ends, first = word_bounds(data, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    for _ in range(3):
        starts = starts + (~_WORDY[data[np.minimum(starts, len(data) - 1)]] & (starts < ends)) if len(data) else starts
        ends = ends - (~_WORDY[data[np.maximum(ends - 1, 0)]] & (starts < ends)) if len(data) else ends
    out_row, out_hash = [], []
    for k in _PREFIXES:
        has = np.flatnonzero(ends - starts > k)
        stop = ends[has] if k == 0 else starts[has] + k
        out_row.append(row[has])
        out_hash.append(span_hash(data, starts[has], stop, _SEED + 2 * k))
    return np.concatenate(out_row), np.concatenate(out_hash)


@dataclass
class Model:
    """A weight for each place of the hash space, and the bias."""

    weights: np.ndarray
    bias: float


def places(data: np.ndarray, offs: np.ndarray, decoder: Decoder, space_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the features of the texts, repeats included."""
    row, h = features(*restore(data, offs, decoder))
    return row, (h >> np.uint64(64 - space_bits)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, logp: np.ndarray, max_train: int = 16384, space_bits: int = 20, rounds: int = 80) -> Model:
    """Learns from at most max_train labelled documents; labels: doc_id, toxic, already without held-out rows."""
    usable = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # a broadcast of at most max_train rows of two numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    table = logp.tolist()

    def presence(batches):
        decoder = Decoder(table)
        for batch in batches:
            data, offs = buffer(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            for i, j in chunks(offs):
                row, idx = places(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], decoder, space_bits)
                pairs = np.unique((row.astype(np.int64) << space_bits) | idx)
                cuts = np.searchsorted(pairs, np.arange(j - i + 1) << space_bits)
                idx = (pairs & ((1 << space_bits) - 1)).astype(np.int32)
                found = [idx[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[i:j]), pa.array(found, pa.binary())], names=["toxic", "found"])
        trim()

    rows = sample.mapInArrow(presence, "toxic int, found binary").toArrow()  # at most max_train rows
    y = rows.column("toxic").to_numpy().astype(float)
    found, offs = buffer(rows.column("found"))
    del rows
    weights = np.zeros(1 << space_bits)
    if not len(y):
        return Model(weights, -50.0)
    idx, size = found.view(np.int32), np.diff(offs) // 4
    # A weight is never below 0, and rows without toxicity can only lower it: what stands in
    # no toxic row keeps weight 0 and need not be looked at.
    known = np.zeros(1 << space_bits, bool)
    known[idx[np.repeat(y > 0, size)]] = True
    keep = known[idx]
    doc = np.repeat(np.arange(len(y), dtype=np.int32), size)[keep]
    own = np.flatnonzero(known)
    slot = np.zeros(1 << space_bits, np.int32)
    slot[own] = np.arange(len(own))
    idx = slot[idx[keep]]
    often = np.bincount(idx[y[doc] > 0], minlength=len(own))
    # the value of a feature grows with the toxic rows that have it: one row proves little
    weights[own], bias = _regress(often / (often + 10), y, doc, idx, rounds)
    return Model(weights, bias)


def _regress(value: np.ndarray, y: np.ndarray, doc: np.ndarray, idx: np.ndarray, rounds: int, ridge: float = 0.02, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression of features with these values by full gradients with adaptive steps, weights held at 0 or more.

    A feature can speak for toxicity or be silent: a long clean passage takes nothing back.
    """
    n = len(value)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w, bias = np.zeros(n), log(share / (1 - share))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    parts = [slice(i, i + (1 << 20)) for i in range(0, len(doc), 1 << 20)]  # memory stays small
    for t in range(1, rounds + 1):
        z, told = np.full(len(y), bias), w * value
        for p in parts:
            z += np.bincount(doc[p], told[idx[p]], len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.zeros(n), error.sum())
        for p in parts:
            g[:-1] += np.bincount(idx[p], error[doc[p]], n)
        g[:-1] = g[:-1] * value + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-2) * min(1, 2 - 2 * t / rounds)
        w, bias = np.maximum(w - step[:-1], 0), bias - step[-1]
    return w * value, float(bias)


def score(docs: DataFrame, labels: DataFrame, space_bits: int = 20, **bounds) -> DataFrame:
    """All columns of docs and toxicity DOUBLE, 0 to 1, learnt from labels (doc_id, toxic)."""
    spark = docs.sparkSession
    logp = log_probabilities(trigram_counts(docs))
    model = fit(docs, labels, logp, space_bits=space_bits, **bounds)
    shared, table = spark.sparkContext.broadcast(model), logp.tolist()  # 8 bytes a place
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    plain = docs.toDF(*names)  # clashing and repeated names do not matter here
    text_at = cols.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + ", score double"

    def run(batches):
        decoder, w = Decoder(table), shared.value.weights
        for batch in batches:
            data, offs = buffer(batch.column(text_at))
            z = np.full(len(offs) - 1, shared.value.bias)
            for i, j in chunks(offs):
                row, idx = places(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], decoder, space_bits)
                told = w[idx] > 0
                pairs = np.unique((row[told].astype(np.int64) << space_bits) | idx[told])
                z[i:j] += np.bincount(pairs >> space_bits, w[pairs & ((1 << space_bits) - 1)], j - i)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, "score"])
        trim()

    return plain.mapInArrow(run, schema).toDF(*cols, "toxicity")


def learnable(labels: DataFrame) -> DataFrame:
    """The labels to learn from: crc32 of doc_id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
