"""Chat formatting of worker dialogues, assembled token by token.

A turn's texts are encoded apart from the template: reserved ids beyond the vocabulary mark the
turns, so no text can ever yield one. What a reader of the decoded string could take for a mark
is escaped in the texts, and unescaped when read back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Marks in the order of their reserved ids, which follow the vocabulary.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</TEXT>>")
BOS, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, TEXT, TEXT_END = range(len(MARKS))
#: Opening and closing mark by role; any other role is written out between marks.
ROLES = {"user": (USER, USER_END), "system": (SYSTEM, SYSTEM_END), "assistant": (BOS, END)}
LOSS_ROLES = ("assistant",)
ESCAPE = "\x1b"
_CONTROL = re.compile(re.escape(ESCAPE) + "|" + "|".join(map(re.escape, MARKS)))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.S)


def escape(text: str) -> str:
    """Break every mark after its first character with ``ESCAPE``, and double ``ESCAPE``. No two
    marks overlap, so none is left."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:] if len(m[0]) > 1 else ESCAPE * 2, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(2)
def codec(path: str | None = None):
    """(encode, decode, first reserved id) of a byte-level vocabulary given as ranks. Texts that
    hold a special token's string are ordinary text here."""
    import base64
    import public_tokenizers
    import tiktoken
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return (lambda t: enc.encode_to_numpy(t, disallowed_special=()).astype(np.int32),
            lambda ids: enc.decode_bytes(ids.tolist()).decode("utf-8"), max(ranks.values()) + 2)


def assemble(role: str, text: str, encode, reserved: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn: segments encoded apart, reserved ids spliced between.

    The mask is the running sum of +1 where a segment with loss begins and -1 where it ends;
    only the text itself has loss, never a mark."""
    mark = lambda i: np.array([reserved + i], np.int32)
    body = encode(escape(text))
    if role in ROLES:
        parts = [mark(ROLES[role][0]), body, mark(ROLES[role][1])]
    else:
        parts = [mark(ROLE), encode(escape(role)), mark(TEXT), body, mark(TEXT_END)]
    ends = np.cumsum([len(p) for p in parts])
    delta = np.zeros(ends[-1] + 1, np.int8)
    if role in LOSS_ROLES:
        at = len(parts) - 2
        delta[ends[at - 1]] += 1
        delta[ends[at]] -= 1
    return np.concatenate(parts), np.cumsum(delta[:-1], dtype=np.int8)


def format_dialogues(turns: DataFrame, pull_id: str = "pull_id", row_index: str = "row_index", role: str = "role",
                     text: str = "text", ranks: str | None = None) -> DataFrame:
    """(pull_id, turn, start, ids, loss): the token rows of every dialogue with the worker.

    Turns stand in the order of ``row_index`` (NULL first; ties by role, then text); ``turn`` counts
    from 0 and ``start`` is the turn's offset in its dialogue, a running sum over the turns before.
    NULL role or text: empty. NULL dialogue: one of its own. Repeated rows are turns each.

    Turns are encoded where they are read; the shuffle by dialogue carries ids. A dialogue is in one
    sorted partition and is streamed, never held, whatever its number of turns."""
    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _, reserved = codec(ranks)
        for batch in batches:
            ids, loss = [], []
            for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                i, m = assemble(r or "", t or "", encode, reserved)
                ids.append(i)
                loss.append(m)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int8()))],
                names=["pull_id", "row_index", "role", "text", "ids", "loss"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turn, start = object(), 0, 0
        for batch in batches:
            turns_, starts = [], []
            lengths = np.diff(np.asarray(batch.column(1).offsets))
            for key, n in zip(batch.column(0).to_pylist(), lengths.tolist()):
                if key != now:
                    now, turn, start = key, 0, 0
                turns_.append(turn)
                starts.append(start)
                turn, start = turn + 1, start + n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(turns_, pa.int64()), pa.array(starts, pa.int64()), batch.column(1),
                 batch.column(2)], names=["pull_id", "turn", "start", "ids", "loss"])

    rows = turns.select(F.col(pull_id).alias("pull_id"), F.col(row_index).alias("row_index"),
                        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coded = rows.mapInArrow(encode_rows, f"pull_id {kinds['pull_id']}, row_index {kinds['row_index']}, role string, "
                                         "text string, ids array<int>, loss array<byte>")
    return (coded.repartition(parts, "pull_id").sortWithinPartitions("pull_id", "row_index", "role", "text")
            .select("pull_id", "ids", "loss")
            .mapInArrow(number, f"pull_id {kinds['pull_id']}, turn long, start long, ids array<int>, loss array<byte>"))


def read_turn(ids: np.ndarray, loss: np.ndarray, decode, reserved: int) -> tuple[str, str, str, str]:
    """(role, text, text under the mask, formatted string) of a turn, read from its ids."""
    at = np.nonzero(ids >= reserved)[0]
    first = int(ids[0]) - reserved
    role = next((r for r, (a, _) in ROLES.items() if a == first), None)
    if role is None:
        role = unescape(decode(ids[at[0] + 1:at[1]]))
        at = at[1:]
    text = unescape(decode(ids[at[0] + 1:at[1]]))
    under = unescape(decode(ids[loss.astype(bool)]))
    shown, last = [], 0
    for i in np.nonzero(ids >= reserved)[0]:
        shown += [decode(ids[last:i]), MARKS[int(ids[i]) - reserved]]
        last = i + 1
    return role, text, under, "".join(shown)


def read_back(formatted: DataFrame, ranks: str | None = None) -> DataFrame:
    """(pull_id, n_turns, n_tokens, turns_sha256, loss_chars, loss_sha256, formatted_chars) per
    dialogue, from the rows of ``format_dialogues`` as they stand: sorted in their partitions.
    Digests are updated turn by turn, so a dialogue needs no memory for its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        _, decode, reserved = codec(ranks)
        now, made = None, []

        def done(s) -> tuple:
            return (s[0], s[1], s[2], s[3].hexdigest(), s[4], s[5].hexdigest(), s[6])

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

        names = ["pull_id", "n_turns", "n_tokens", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            ids, loss = batch.column(3), batch.column(4)
            for i, (key, turn) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if turn == 0:
                    if now:
                        made.append(done(now))
                    now = [key, 0, 0, sha256(), 0, sha256(), 0]
                own = ids[i].values.to_numpy(zero_copy_only=False)
                role, text, under, shown = read_turn(own, loss[i].values.to_numpy(zero_copy_only=False), decode, reserved)
                now[1] += 1
                now[2] += len(own)
                now[3].update(f"{role}\n{text}\n".encode("utf-8"))
                now[4] += len(under)
                now[5].update(under.encode("utf-8"))
                now[6] += len(shown)
            if len(made) > 4096:
                yield sent()
                made.clear()
        if now:
            made.append(done(now))
            yield sent()

    kind = formatted.schema["pull_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"pull_id {kind}, n_turns long, n_tokens long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
