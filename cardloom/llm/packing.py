"""Hierarchical multi-length packing of strip transcripts into token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Context sizes, longest first. All are powers of two.
TIERS = (1024, 512, 256, 128, 64)
EOS = 0
#: Tokens that one step of training takes: whole sequences of one tier.
STEP_TOKENS = 8192
#: Tokens that a task holds before it packs them; what stays open is carried to the next lot.
LOT_TOKENS = 1 << 20
SCHEMA = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_id long")


@lru_cache(2)
def encoder(path: str | None = None):
    """Function text -> ids as the tokenizer file says. The same vocabulary as ranks, in the
    ``.tiktoken`` file beside it, gives the same ids several times faster; texts that hold the
    text of a special token, and files without ranks beside them, go to the tokenizer itself."""
    import os
    import public_tokenizers
    from tokenizers import Tokenizer
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import base64
    import tiktoken
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: slow(text) if any(s in text for s in special) else fast.encode_to_numpy(text, disallowed_special=())


class _Pool:
    """Open pieces by length: (length, order) sorted, with the piece behind each."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.pieces: dict[tuple[int, int], tuple] = {}
        self.made = 0
        self.tokens = 0

    def add(self, piece: tuple) -> None:
        self.made += 1
        key = (piece[2], self.made)
        insort(self.keys, key)
        self.pieces[key] = piece
        self.tokens += piece[2]

    def take(self, at: int) -> tuple:
        key = self.keys.pop(at)
        self.tokens -= key[0]
        return self.pieces.pop(key)

    def best(self, room: int) -> tuple | None:
        """The longest piece of at most ``room`` tokens."""
        at = bisect_right(self.keys, (room, self.made + 1)) - 1
        return self.take(at) if at >= 0 else None


class Packer:
    """Packs the documents of one task. A piece is (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.pool = tiers, _Pool()
        self.sequences: list[tuple[int, list[tuple]]] = []

    def add(self, document, length: int) -> None:
        """Cut whole windows of the longest tier from a document; its rest waits."""
        top, start = self.tiers[0], 0
        while length - start >= top:
            self.sequences.append((top, [(document, start, top)]))
            start += top
        if start < length:
            self.pool.add((document, start, length - start))

    def pack(self, keep: bool) -> None:
        """Fill sequences tier by tier. The longest waiting piece opens a window of the smallest
        tier that holds it; shorter pieces fill the gap, the longest that fits first; what then
        still is open takes the head of a longer piece, whose tail waits again. With ``keep``, what cannot
        fill a window waits for the next lot; else it goes to ever smaller tiers, and the last tokens,
        fewer than the smallest tier, into one padded sequence."""
        pool = self.pool
        least = self.tiers[0] * 8 if keep else self.tiers[-1]
        while pool.tokens >= least:
            longest = pool.keys[-1][0]
            tier = min(t for t in self.tiers if t >= longest)
            while tier > pool.tokens:
                tier = self.tiers[self.tiers.index(tier) + 1]
            room, held = tier, []
            if longest <= room:
                held.append(pool.take(len(pool.keys) - 1))
                room -= longest
            while room:
                piece = pool.best(room)
                if piece is None:
                    document, start, length = pool.take(len(pool.keys) - 1)
                    piece = (document, start, room)
                    pool.add((document, start + room, length - room))
                held.append(piece)
                room -= piece[2]
            self.sequences.append((tier, held))
        if not keep and pool.tokens:
            held = []
            while pool.keys:
                held.append(pool.take(len(pool.keys) - 1))
            self.sequences.append((sum(p[2] for p in held), held))

    def taken(self) -> list[tuple[int, list[tuple]]]:
        done, self.sequences = self.sequences, []
        return done


def pack(strips: DataFrame, strip_id: str = "strip_id", text: str = "text", tokenizer: str | None = None,
         with_ids: bool = True) -> DataFrame:
    """A row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_id[, ids]) for strip transcripts.

    A text (NULL: empty) becomes its ids and the end id 0, so an empty one is one token. Texts are
    routed by length to the context sizes ``TIERS``; each tier's windows are filled from shorter
    texts and all end full, so padding falls only on the last sequence of a task: fewer tokens than
    the smallest tier. ``tier`` is the window (of that last sequence: its tokens). ``step_id``
    groups whole sequences of one tier to ``STEP_TOKENS`` tokens each, so steps weigh the same.

    Each task packs the rows it reads, a bounded lot at a time, so nothing is shuffled and a
    lost task is repeated with the same result; one very long text is cut into windows as it
    comes. Repeated rows are packed each. ``doc_id`` is the ``strip_id`` of the row."""
    kind = strips.select(strip_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer()
        first = TaskContext.get().partitionId() << 32
        state = {"sequence": first, "step": first}
        open_steps: dict[int, list] = {}
        documents: dict[int, list] = {}   # order -> [id, ids, tokens not yet in a sequence]
        schema = None

        def step_of(tier: int, size: int) -> int:
            step = open_steps.get(tier)
            if step is None or step[1] + size > STEP_TOKENS:
                step = open_steps[tier] = [state["step"], 0]
                state["step"] += 1
            step[1] += size
            return step[0]

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for tier, pieces in packer.taken():
                step, offset = step_of(tier, sum(p[2] for p in pieces)), 0
                for order, start, length in pieces:
                    document = documents[order]
                    ids = document[1][start:start + length]
                    rows.append((document[0], start, length, zlib.crc32(ids.astype("<u4").tobytes()), len(document[1]),
                                 state["sequence"], offset, tier, step, *([ids.astype(np.int32)] if with_ids else [])))
                    offset += length
                    document[2] -= length
                    if not document[2]:
                        del documents[order]
                state["sequence"] += 1
                if len(rows) >= 4096:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        waiting, order = 0, 0
        for batch in batches:
            if schema is None:
                schema = pa.schema([("doc_id", batch.schema.field(0).type), *[(n, pa.int64()) for n in (
                    "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
                    ("tier", pa.int32()), ("step_id", pa.int64()),
                    *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
            for i in range(batch.num_rows):
                ids = np.append(encode(batch.column(1)[i].as_py() or ""), np.uint32(EOS))
                documents[order] = [batch.column(0)[i].as_py(), ids, len(ids)]
                packer.add(order, len(ids))
                order += 1
                waiting += len(ids)
                if waiting >= LOT_TOKENS:
                    packer.pack(keep=True)
                    yield from flush()
                    waiting = 0
        packer.pack(keep=False)
        if schema is not None:
            yield from flush()

    rows = strips.select(F.col(strip_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SCHEMA.format(id=kind) + (", ids array<int>" if with_ids else ""))
