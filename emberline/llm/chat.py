"""Chat formatting by token-level assembly.

Every role and every text is encoded on its own; reserved ids that no text can
produce are spliced between the segments, and the loss mask is a prefix sum over
+1/-1 marks at segment borders. Control strings inside a text are escaped first, so
that the rendered form can be read back too.

A turn is ``<s>`` ``[INST]`` role ``[/INST]`` text ``</s>``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .tokens import encoder

CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
ESCAPE, BREAK = "\\", "\\-"
_MARKS = re.compile("|".join(map(re.escape, CONTROL)))
_TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string, ids binary"
_PIECE_SCHEMA = "conv_id bigint, piece bigint, start bigint, n_turns bigint, ids binary, loss_mask binary"
TURNS_PER_PIECE = 256
_ARROW_PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_turns", pa.int64()),
                          ("ids", pa.binary()), ("loss_mask", pa.binary())])
_ARROW_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                           ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                           ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])
DIGEST_SCHEMA = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                 "formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint")


def escape(text: str) -> str:
    """Double every backslash, then break each control string after its first character with ``\\-``."""
    return _MARKS.sub(lambda m: m[0][0] + BREAK + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\([\\-])", lambda m: "" if m[1] == "-" else ESCAPE, text)


def reserved_ids(path: str) -> np.ndarray:
    """Ids of the control strings: the first ones above the vocabulary."""
    size = encoder(path).whole.get_vocab_size()
    return np.arange(size, size + len(CONTROL), dtype=np.uint32)


def _encode_turns(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder, (turn, head, body, end) = encoder(path), reserved_ids(path)
    for batch in batches:
        roles, texts = ([escape(x or "") for x in batch.column(c).to_pylist()] for c in ("role", "text"))
        ids, ends = coder.encode(pa.array([x for pair in zip(roles, texts) for x in pair], pa.large_string()))
        out = []
        for i in range(len(roles)):
            a, b, c = ends[2 * i], ends[2 * i + 1], ends[2 * i + 2]
            out.append(np.concatenate([[turn, head], ids[a:b], [body], ids[b:c], [end]]).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "turn", "role", "text")] + [pa.array(out, pa.binary())],
                                         ["conv_id", "turn", "role", "text", "ids"])


def loss_mask(ids: np.ndarray, learns: np.ndarray, reserved: np.ndarray) -> np.ndarray:
    """1 on the text tokens of turns that are learnt from, by a prefix sum over segment borders."""
    opened, closed = np.flatnonzero(ids == reserved[2]), np.flatnonzero(ids == reserved[3])
    step = np.zeros(len(ids) + 1, np.int8)
    step[opened[learns] + 1] += 1
    step[closed[learns]] -= 1
    return np.cumsum(step[:-1], dtype=np.int8)


def _assemble(batches: Iterator[pa.RecordBatch], path: str, learnt: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Turns arrive sorted; at most ``TURNS_PER_PIECE`` of one conversation are held at a time."""
    reserved = reserved_ids(path)
    held: list[tuple[bytes, bool]] = []
    current, piece, start = object(), 0, 0

    def flush() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(x for x, _ in held), "<u4")
        mask = loss_mask(ids, np.array([y for _, y in held], bool), reserved)
        row = [[current], [piece], [start], [len(held)], [ids.tobytes()], [mask.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW_PIECE)], schema=_ARROW_PIECE)

    for batch in batches:
        for conv, role, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "ids"))):
            if held and (conv != current or len(held) == TURNS_PER_PIECE):
                yield flush()
                piece, start, held = piece + 1, start + sum(len(x) for x, _ in held) // 4, []
            if conv != current:
                current, piece, start = conv, 0, 0
            held.append((ids, role in learnt))
    if held:
        yield flush()


def format_conversations(conversations: DataFrame, path: str, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Token ids and loss mask of every conversation, in pieces of at most 256 turns.

    Input: conv_id, turn, role, text (other columns are ignored). Null role or text: empty. Turns are ordered
    by turn, then role, then text, nulls first; repeated rows are all kept; rows with null conv_id form one
    conversation. Output: conv_id, piece, start (its tokens before it), n_turns, ids and loss_mask (unsigned
    32-bit little-endian, one byte a token).

    Turns are encoded where they lie; then one shuffle brings a conversation's ids together, sorted, and they
    stream through a task that holds one piece at a time. No shuffle follows, so pieces stay in order.
    """
    ship(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    coded = turns.mapInArrow(lambda it: _encode_turns(it, path), _TURN_SCHEMA)
    ordered = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "ids").mapInArrow(lambda it: _assemble(it, path, learnt), _PIECE_SCHEMA)


def rendered(ids: np.ndarray, path: str) -> str:
    """The text form of ids: control strings in place of reserved ids."""
    coder, reserved = encoder(path), reserved_ids(path)
    at = np.flatnonzero(ids >= reserved[0])
    parts = np.split(ids, at)
    names = dict(zip(reserved.tolist(), CONTROL))
    bodies = coder.whole.decode_batch([(p if p[0] < reserved[0] else p[1:]).tolist() if len(p) else [] for p in parts],
                                      skip_special_tokens=False)
    heads = [names[int(p[0])] if len(p) and p[0] >= reserved[0] else "" for p in parts]
    return "".join(h + b for h, b in zip(heads, bodies))


def parse(ids: np.ndarray, mask: np.ndarray, path: str) -> list[tuple[str, str, str]]:
    """(role, text, text under the mask) of each turn, unescaped, from ids and mask alone."""
    coder, reserved = encoder(path), reserved_ids(path)
    opened, closed, heads = (np.flatnonzero(ids == reserved[k]) for k in (2, 3, 1))
    lists = []
    for h, b, e in zip(heads, opened, closed):
        inside = ids[b + 1:e]
        lists += [ids[h + 1:b].tolist(), inside.tolist(), inside[mask[b + 1:e] == 1].tolist()]
    texts = [unescape(t) for t in coder.whole.decode_batch(lists, skip_special_tokens=False)]
    return list(zip(texts[::3], texts[1::3], texts[2::3]))


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    current: object = object()
    state: list = []

    def row() -> list:
        turns, loss, n = state
        return [current, n["turns"], turns.hexdigest(), n["loss"], loss.hexdigest(), n["chars"], n["tokens"], n["learnt"]]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _ARROW_DIGEST)], schema=_ARROW_DIGEST)

    for batch in batches:
        rows = []
        for conv, raw, raw_mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_mask"))):
            if conv != current:
                if state:
                    rows.append(row())
                current, state = conv, [hashlib.sha256(), hashlib.sha256(), dict.fromkeys(("turns", "loss", "chars", "tokens", "learnt"), 0)]
            turns, loss, n = state
            ids, mask = np.frombuffer(raw, "<u4"), np.frombuffer(raw_mask, np.int8)
            for role, text, learnt in parse(ids, mask, path):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learnt.encode())
                n["turns"], n["loss"] = n["turns"] + 1, n["loss"] + len(learnt)
            n["chars"] += len(rendered(ids, path))
            n["tokens"], n["learnt"] = n["tokens"] + len(ids), n["learnt"] + int(mask.sum())
        if rows:
            yield batch_of(rows)
    if state:
        yield batch_of([row()])


def conversation_digests(formatted: DataFrame, path: str) -> DataFrame:
    """One row a conversation, read back from ids and mask.

    ``formatted`` must come straight from ``format_conversations``, whose partitions hold whole conversations in
    order. A SHA-256 has to see its bytes in order, so one conversation is one task's work, but it streams: only a
    piece of it is in memory.
    """
    return formatted.mapInArrow(lambda it: _digest(it, path), DIGEST_SCHEMA)
