"""Chat formatting on token ids.

Every segment of a turn (role, text) is encoded by itself, so no merge crosses a border, and three reserved
ids outside the vocabulary are spliced between them: OPEN role SAYS text CLOSE.  The loss mask is the prefix
sum of +1 where an assistant's text begins and -1 where it ends.  Rendered, the reserved ids read
as control strings; where content holds such a string, one more backslash goes before it, and reading takes
one away, so formatting is reversible, backslashes included.

Null roles and texts are empty ones; a null conv_id is a conversation of its own and a null
turn comes first.  Equal turns of a conversation are ordered by role, then text.  Long texts are encoded in
parts that end where tokens end, so the ids are those of the whole text; only a run of SEGMENT characters without a space between two words, on
which the encoder's pattern may exhaust its stack, is cut inside.  Other columns are dropped; empty tables give empty tables.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import slices

CONTROL = ("<turn>", "<says>", "</turn>")
#: Reserved ids of the control strings, above every id of the vocabulary.
OPEN, SAYS, CLOSE = RESERVED = (50_257, 50_258, 50_259)
ESCAPE = re.compile(r"\\*(?:" + "|".join(map(re.escape, CONTROL)) + ")")
UNESCAPE = re.compile(r"\\(\\*(?:" + "|".join(map(re.escape, CONTROL)) + "))")
SEGMENT = 32_768
_ENCODERS: dict = {}


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def encoder(path: str | None = None):
    """The byte-level vocabulary at path; no special tokens, so content can never become one."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) >= OPEN:
            raise ValueError("the vocabulary reaches into the reserved ids")
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def segments(text: str) -> Iterator[str]:
    """text in parts of at most SEGMENT characters, cut before a single space between two words, where the encoder ends a token in any case."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = at + SEGMENT
        while (cut := text.rfind(" ", at + 1, cut)) > 0 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            pass
        cut = cut if cut > 0 else at + SEGMENT
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str, model) -> list[int]:
    return [i for part in segments(text) for i in model.encode_ordinary(part)]


def assemble(role: str, text: str, model) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    head, body = encode(escape(role), model), encode(escape(text), model)
    ids = np.array([OPEN, *head, SAYS, *body, CLOSE], np.int32)
    change = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        change[len(head) + 2] += 1
        change[len(head) + 2 + len(body)] -= 1
    return ids, np.cumsum(change[:-1], dtype=np.int8)


def read_turn(ids: np.ndarray, mask: np.ndarray, model) -> tuple[str, str, str, int]:
    """Role, text, text under the mask, rendered characters."""
    marks = np.flatnonzero(ids >= OPEN)
    if tuple(ids[marks]) != RESERVED or marks[0] != 0 or marks[2] != len(ids) - 1:
        raise ValueError("not one turn")
    text_of = lambda some: model.decode_bytes(some.tolist()).decode()
    role, text, loss = text_of(ids[1 : marks[1]]), text_of(ids[marks[1] + 1 : -1]), text_of(ids[mask > 0])
    return unescape(role), unescape(text), unescape(loss), len(role) + len(text) + sum(map(len, CONTROL))


def format_conversations(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, ids, mask: one row a turn, encoded where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in slices(batches, 3):
            made = [assemble(r or "", t or "", model) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ends = np.cumsum([0] + [len(i) for i, _ in made]).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *(i for i, _ in made)]))
            mask = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int8), *(m for _, m in made)]))
            yield pa.record_batch([batch.column(0), batch.column(1), ids, mask], ["conv_id", "turn", "ids", "mask"])

    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "conv_id long, turn long, ids array<int>, mask array<tinyint>")


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, loss, chars: decoded from ids and masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
            masks, mask_ends = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
            ends, mask_ends = ends - ends[0], mask_ends - mask_ends[0]
            rows = [read_turn(flat[a:b], masks[c:d], model) for a, b, c, d in zip(ends[:-1], ends[1:], mask_ends[:-1], mask_ends[1:], strict=True)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["conv_id", "turn", "role", "text", "loss", "chars"])

    return formatted.mapInArrow(run, "conv_id long, turn long, role string, text string, loss string, chars long")


def digests(read: DataFrame) -> DataFrame:
    """One row a conversation.  A digest takes its turns one after another, so a conversation's decoded rows stream, batch by
    batch and sorted on disk where need be, through one task, which holds one batch; all encoding is done before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []

        def close() -> None:
            if state:
                out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for conv, _, role, text, loss, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if len(out) > 5000:
                yield flush()
                out.clear()
        close()
        yield flush()

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
