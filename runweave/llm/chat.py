"""Chat formatting as prefix trees: shared first turns are emitted once, depth first.

Each turn has a node id, a digest chained from its parent's, so conversations that share
initial turns share nodes. Conversations are range-sorted by the path of their node ids; a
range is written in one pass as packs of a bounded number of tokens: a turn that the
conversation before it had is already out, so in a pack each node is emitted once, in
depth-first order. A first turn that a third of all conversations share is cut at the borders
of packs, and its shared nodes then stand once in each of those packs. No conversation or tree is held in memory: only the open path is.

Tokens are the bytes of the formatted text. A node has the offset of its first token in the
pack (start), the position id of that token (the tokens before it on its path), its length,
and the end of its subtree (close): the tokens that may attend to it are those in
[start, close). A conversation's end has the attention intervals of its path.

The template marks turns; in texts and roles every control string is broken by a backslash
after each backslash and bracket, which reading takes back. The loss mask covers exactly
the assistant texts.

Defined cases: null text and null role are empty; rows with equal conversation and turn are
turns in the order of role and text; a null conv_id is one conversation, before all others
(so is the id -2^63, read back as null); very long turns are written whole; an empty table
gives no packs; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import parts, table

_LOWEST = -(2**63)
_ESCAPED = re.compile(r"([\\<\[\]])")
_PLAIN = re.compile(r"([\\<\[\]])\\")
#: Roles with marks of their own, before and after the text.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
_BEGIN = "<s>"
_OTHER = re.compile(r"\[ROLE ((?:[^\\\[\]<]|[\\\[\]<]\\)*)\] (.*) \[/ROLE\]", re.S)

_NODE = (
    "pack bigint, seq bigint, kind string, depth int, start bigint, position bigint, n_tokens bigint, close bigint, "
    "piece string, loss_from int, loss_to int, conv bigint, intervals array<bigint>"
)
_READ = "conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    """Every backslash and bracket is followed by a backslash, so no control string stands in the text."""
    return _ESCAPED.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def format_turn(role: str, text: str, first: bool) -> tuple[str, int, int]:
    """The formatted turn, and where in it the loss mask begins and ends."""
    start = _BEGIN if first else ""
    if role in MARKS:
        before, after = MARKS[role]
        before = start + before
    else:
        before, after = f"{start}[ROLE {escape(role)}] ", " [/ROLE]"
    body = escape(text)
    at = len(before)
    return before + body + after, at if role == "assistant" else 0, at + len(body) if role == "assistant" else 0


def parse_turn(piece: str, first: bool) -> tuple[str, str]:
    """The role and text of a formatted turn."""
    if first:
        if not piece.startswith(_BEGIN):
            raise ValueError("a conversation does not begin with its mark")
        piece = piece[len(_BEGIN) :]
    for role, (before, after) in MARKS.items():
        if piece.startswith(before) and piece.endswith(after) and len(piece) >= len(before) + len(after):
            return role, unescape(piece[len(before) : len(piece) - len(after)])
    m = _OTHER.fullmatch(piece)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(_LOWEST)).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _chain(parent: bytes, role: str, text: str) -> bytes:
    h = hashlib.blake2b(parent, digest_size=16)
    r = role.encode()
    h.update(len(r).to_bytes(8, "big") + r + text.encode())
    return h.digest()


def ranks(d: DataFrame) -> DataFrame:
    """(conv, rank, pack, tokens): conversations in the order of their paths, cut into ranges of about equal number."""
    n = parts(d.sparkSession)

    def paths(batches):
        conv, node, path, tokens = None, b"", [], 0
        names, types = ["conv", "path", "tokens"], [pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if c != conv:
                    if conv is not None:
                        out.append((conv, b"".join(path), tokens))
                    conv, node, path, tokens = c, b"", [], 0
                node = _chain(node, role, text)
                tokens += len(format_turn(role, text, not path)[0].encode())
                path.append(node[:8])
            yield _batch(out, names, types)
        if conv is not None:
            yield _batch([(conv, b"".join(path), tokens)], names, types)

    whole = d.repartition(n, "conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(paths, "conv bigint, path binary, tokens bigint")
    whole = table(whole, "chat-paths")
    ordered = whole.repartitionByRange(n, "path", "conv").sortWithinPartitions("path", "conv")
    return table(ordered.select("conv", F.monotonically_increasing_id().alias("rank"), F.spark_partition_id().alias("pack"), "tokens"), "chat-ranks")


def _batch(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


_NODE_NAMES = [x.split()[0] for x in _NODE.split(", ")]
_NODE_TYPES = [
    pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
    pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
]


class _Writer:
    """The open path of a pack; nodes go out when their subtree closes, conversations at their end."""

    def __init__(self, pack: int) -> None:
        self.pack, self.offset, self.seq, self.path, self.out = pack, 0, 0, [], []

    def pop(self, depth: int) -> None:
        while len(self.path) > depth:
            _, seq, start, position, size, piece, a, b = self.path.pop()
            self.out.append((self.pack, seq, "turn", len(self.path), start, position, size, self.offset, piece, a, b, None, None))

    def turn(self, depth: int, node: bytes, role: str, text: str) -> None:
        if depth < len(self.path) and self.path[depth][0] == node:
            return
        self.pop(depth)
        piece, a, b = format_turn(role, text, depth == 0)
        size = len(piece.encode())
        position = self.path[-1][3] + self.path[-1][4] if self.path else 0
        self.path.append((node, self.seq, self.offset, position, size, piece, a, b))
        self.seq += 1
        self.offset += size

    def end(self, conv: int, depth: int) -> None:
        self.pop(depth)
        spans: list[int] = []
        for _, _, start, _, size, *_ in self.path:
            if spans and spans[-1] == start:
                spans[-1] = start + size
            else:
                spans += [start, start + size]
        self.out.append((self.pack, self.seq, "end", depth, self.offset, 0, 0, self.offset, None, 0, 0, conv, spans))
        self.seq += 1


def write_trees(conversations: DataFrame, path: str, max_tokens: int = 1 << 22) -> None:
    """Writes the packs as Parquet: kind 'turn' rows are nodes, 'end' rows conversations; seq is the order.

    A range is cut into packs of at most max_tokens, between conversations; only a single
    longer conversation is a longer pack.
    """
    d = turns(conversations)
    where = ranks(d)
    n = parts(d.sparkSession)

    def run(batches):
        writer, at, cut, conv, node, depth = None, None, 0, None, b"", 0
        for batch in batches:
            for c, _, role, text, part, tokens in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if conv is not None and (c != conv or part != at):
                    writer.end(conv, depth)
                    conv = None
                full = writer is not None and conv is None and writer.offset and writer.offset + tokens > max_tokens
                if part != at or full:
                    if writer is not None:
                        writer.pop(0)
                        yield _batch(writer.out, _NODE_NAMES, _NODE_TYPES)
                    at, cut = part, cut + 1 if part == at else 0
                    writer = _Writer((part << 32) + cut)
                if conv is None:
                    conv, node, depth = c, b"", 0
                node = _chain(node, role, text)
                writer.turn(depth, node, role, text)
                depth += 1
                if len(writer.out) >= 2000:
                    yield _batch(writer.out, _NODE_NAMES, _NODE_TYPES)
                    writer.out = []
        if writer is not None:
            writer.end(conv, depth)
            writer.pop(0)
            yield _batch(writer.out, _NODE_NAMES, _NODE_TYPES)

    rows = d.join(where, "conv").repartition(n, "pack").sortWithinPartitions("rank", "turn", "role", "text")
    rows.select("conv", "turn", "role", "text", "pack", "tokens").mapInArrow(run, _NODE).write.parquet(path)


def read_trees(packs: DataFrame) -> DataFrame:
    """What each conversation of the packs says, by walking the trees in order of seq."""
    n = parts(packs.sparkSession)

    def run(batches):
        path: list = []
        for batch in batches:
            out = []
            for kind, depth, piece, a, b, conv in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if kind == "end":
                    _, said, loss, chars, size = path[depth - 1]
                    out.append((conv, depth, said.hexdigest(), chars, loss.hexdigest(), size))
                    continue
                del path[depth:]
                said, loss, chars, size = (path[-1][1].copy(), path[-1][2].copy(), *path[-1][3:]) if path else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                role, text = parse_turn(piece, depth == 0)
                said.update(f"{role}\n{text}\n".encode())
                masked = unescape(piece[a:b])
                loss.update(masked.encode())
                path.append((depth, said, loss, chars + len(masked), size + len(piece)))
            yield _batch(out, ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    rows = packs.select("pack", "seq", "kind", "depth", "piece", "loss_from", "loss_to", "conv").repartition(n, "pack").sortWithinPartitions("pack", "seq")
    found = rows.select("kind", "depth", "piece", "loss_from", "loss_to", "conv").mapInArrow(run, _READ)
    return found.withColumn("conv_id", F.nullif("conv", F.lit(_LOWEST))).drop("conv")
