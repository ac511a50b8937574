"""Language-model scores of strip transcripts from an Elias-Fano n-gram trie.

The model is a trigram model with absolute discounting, interpolated down to add-one words. Every
level keeps its own share of the smoothed probability, quantised: words their counts, word pairs
``(c - D) / c(context)`` and the weight ``D * types / c`` that they leave to what follows a shorter context,
triples their share. The trie lies in files in the shared folder, each with the subtries of a range of
(first word, second word) that holds about as many counted tokens as any other; the words of very frequent first words
are dealt over several. Tasks map the files into memory, one shard at a time, and read the pages that they meet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cardloom.llm.elias_fano import STEP, Children, Monotone, make_folder, read_file, write_file
from cardloom.plans.session import fresh_folder, stage

#: What a seen n-gram leaves to unseen ones, steps of a factor of two in a quantised probability, tokens of
#: a shard, words of a vocabulary file, and bytes of text that a task works on at a time.
DISCOUNT, STEPS, SHARD, WORDS, CHUNK = 0.75, 8, 1 << 21, 1 << 20, 4 << 20
#: Distinct words whose counts a task keeps before it sends them.
KEPT = 300_000
END = b""       # no word: the end of a text, and the context of its first word


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, A-Z in lower case, one after the other; where each text's begin, and the end)."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, starts = found.flatten(), np.r_[0, np.cumsum(pc.list_value_length(found).to_numpy(), dtype=np.int64)]
    real = pc.binary_length(words).to_numpy() > 0       # white space at either end leaves an empty one
    if not real.all():
        starts = np.r_[0, np.cumsum(real)][starts]
        words = words.filter(pa.array(real))
    return words, starts


def hashes_of(words: list[bytes], seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest
    return np.fromiter(map(xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def _bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def codes(p: np.ndarray) -> np.ndarray:
    """One byte for a probability: its logarithm in steps, down to the next one, so that no mass is added."""
    with np.errstate(divide="ignore"):
        c = np.ceil(-STEPS * np.log2(p) - 1e-9)
    return np.minimum(c, 255).astype(np.uint8)


#: What the bytes stand for; the last one for nothing.
VALUES = np.r_[2.0 ** (-np.arange(255) / STEPS), 0.0]
NOTHING = 255


def _begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """Where the files lie, and the few numbers that all tasks need."""
    folder: str
    seed: int
    n_tokens: int
    n_words: int
    bits: int                   # leading bits of a word's hash that name its vocabulary file
    starts: tuple[int, ...]     # first word number and tokens counted before, by vocabulary file
    before: tuple[int, ...]
    shard: int = SHARD

    def _file(self, i: int):
        return read_file(self.folder, f"words-{i}") if self.starts[i + 1] > self.starts[i] else None

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, count, tokens of all words before) of each word; unknown: -1, 0, 0."""
        hashes = hashes_of(words, self.seed)
        number, count, before = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        top = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = (hashes & np.uint64((1 << 64 - self.bits) - 1)).astype(np.int64)
        for i in np.unique(top).tolist():
            if (file := self._file(i)) is None:
                continue
            mine = np.flatnonzero(top == i)
            at, hit = Monotone(file[0].view(np.uint64)).find(rest[mine])
            mine, at = mine[hit], at[hit]
            sums = Monotone(file[1].view(np.uint64))
            low, high = sums.spans(at)
            number[mine], count[mine], before[mine] = self.starts[i] + at, high - low, self.before[i] + low
        return number, count, before

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """The counts of words by number, ascending."""
        out, cuts = np.zeros(len(numbers), np.int64), np.searchsorted(numbers, self.starts)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                low, high = Monotone(self._file(i)[1].view(np.uint64)).spans(numbers[a:b] - self.starts[i])
                out[a:b] = high - low
        return out

    def shards(self, count: np.ndarray, before: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The shard of a pair, from its first word's count and place and its second word; it never falls along (first, second)."""
        return ((before + count * (second / max(1, self.n_words))) // self.shard).astype(np.int64)


class Shard:
    """The subtries of a range of pairs."""

    def __init__(self, model: Model, name: int):
        parts = read_file(model.folder, f"grams-{name}")
        word = [p.view(np.uint64) for p in parts[:5]]
        self.roots, self.pairs, self.triples = Monotone(word[0]), Children(word[1], word[2]), Children(word[3], word[4])
        self.pair, self.back, self.triple = parts[5:8]


def _chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about ``CHUNK`` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _word_counts(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()

        def sent() -> pa.RecordBatch:
            words = list(kept)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(hashes_of(words, seed).view(np.int64)), pa.array(list(kept.values()), pa.int64())],
                                              names=["word", "hash", "n"])
        for batch in _chunks(batches, 0):
            found = words_of(batch.column(0))[0].value_counts()
            for word, n in zip(_bytes(found.field(0)), found.field(1).to_numpy().tolist()):
                kept[word] += n
            kept[END] += batch.num_rows
            if len(kept) > KEPT:
                yield sent()
                kept.clear()
        if kept:
            yield sent()
    return run


def _write_words(folder: str, bits: int):
    """Writes a vocabulary file for every leading part of the hashes; (file, words, tokens, hashes met twice)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes, counts, made = None, [], [], []

        def done() -> None:
            if now is not None:
                h, n = np.concatenate(hashes), np.concatenate(counts)
                rest = (h.view(np.uint64) & np.uint64((1 << 64 - bits) - 1)).astype(np.int64)
                write_file(folder, f"words-{now}", [Monotone.encode(rest), Monotone.encode(np.r_[0, np.cumsum(n)])])
                made.append((now, len(h), int(n.sum()), int((h[1:] == h[:-1]).sum())))
        for batch in batches:
            file = np.asarray(batch.column(0))
            cuts = np.r_[0, np.flatnonzero(file[1:] != file[:-1]) + 1, len(file)] if len(file) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if file[a] != now:
                    done()
                    now, hashes, counts = int(file[a]), [], []
                hashes.append(np.asarray(batch.column(1))[a:b])
                counts.append(np.asarray(batch.column(2))[a:b])
        done()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made) if made else [()] * 4)], names=["file", "words", "tokens", "clashes"])
    return run


class _Text:
    """The tokens of a few texts as one sequence: an end before the first text and after each one. Tokens and pairs are numbered in
    32 bits, and what is as long as the sequence goes as soon as it was used: a chunk takes about 20 times its bytes."""

    def __init__(self, model: Model, texts: pa.Array):
        words, starts = words_of(texts)
        local = words.dictionary_encode()
        del words
        # Local numbers: first the end, then the distinct words; then in the order of the model's, so that sorted pairs are sorted there too.
        number, count, before = model.look_up([END, *_bytes(local.dictionary)])
        order = np.argsort(number, kind="stable")
        n = len(order)
        new = np.empty(n, np.int32)
        new[order] = np.arange(n)
        self.number, self.count, self.before, self.end = number[order], count[order], before[order], int(new[0])
        self.ends = starts[1:] + np.arange(1, len(starts))
        self.seq = np.full(len(local) + len(starts), self.end, np.int32)
        is_word = np.ones(len(self.seq), bool)
        is_word[0] = is_word[self.ends] = False
        self.seq[is_word] = new[1:][local.indices.to_numpy()]
        del local, is_word
        key = self.seq[:-1].astype(np.int64)
        key *= n
        key += self.seq[1:]
        order = np.argsort(key)
        key = key[order]
        at = _begins(key)
        pairs, self.pair_n = key[at], np.diff(np.r_[at, len(key)])
        del key
        self.pair_at = np.empty(len(order), np.int32)
        self.pair_at[order] = np.repeat(np.arange(len(at), dtype=np.int32), self.pair_n)
        self.first, self.second = (x.astype(np.int32) for x in np.divmod(pairs, n))

    def inner(self) -> np.ndarray:
        """Where a triple begins: none reaches over the end of a text."""
        return np.flatnonzero(self.seq[1:-1] != self.end)

    def triples(self) -> np.ndarray:
        """The triples in their order in the text, each as one number: its pair times the number of words, and its third word."""
        inner = self.inner()
        key = self.pair_at[inner].astype(np.int64)
        key *= len(self.number)
        inner += 2
        key += self.seq[inner]
        return key


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.int64).ravel()


def _gram_counts(model: Model):
    """(shard, grams): the counted pairs and triples of a chunk of texts, packed by shard: sorted, and by planes of equal bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=1)
        for batch in _chunks(batches, 0):
            t = _Text(model, batch.column(0))
            u, v, n = t.number[t.first], t.number[t.second], len(t.number)
            shard = model.shards(t.count[t.first], t.before[t.first], v)
            key = t.triples()
            key.sort()
            at = _begins(key)
            key, times = key[at], np.diff(np.r_[at, len(key)])
            cuts = np.r_[_begins(shard), len(shard)]
            out = []
            for a, b, c, d in zip(cuts, cuts[1:], inner := np.searchsorted(key, cuts * n), inner[1:]):
                pair, third = np.divmod(key[c:d], n)
                cols = (np.diff(u[a:b], prepend=0), v[a:b], t.pair_n[a:b], np.diff(pair, prepend=a), t.number[third], times[c:d])
                out.append(np.array([b - a, d - c], np.int64).tobytes() + pack.compress(b"".join(map(_planes, cols))))
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), pa.array(out, pa.binary())], names=["shard", "grams"])
    return run


def _merged(key: np.ndarray, n: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys in order, their summed counts, and with ``where`` the place of each row among them. The keys are sorted in place."""
    order = np.argsort(key)
    key[:] = key[order]
    n = n[order]
    at, went = _begins(key), None
    if where:
        went = np.empty(len(order), np.int32)
        went[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.r_[at, len(key)]))
    del order
    return key[at], np.add.reduceat(n, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64), went


def _shares(n: np.ndarray, total: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The bytes for what ``n`` has of the totals at ``of``, a few at a time."""
    out = np.empty(len(n), np.uint8)
    for s in range(0, len(n), STEP):
        out[s:s + STEP] = codes((n[s:s + STEP] - DISCOUNT) / total[of[s:s + STEP]])
    return out


def _unpacked(blobs: list[bytes], n_words: int) -> list[np.ndarray]:
    """The columns of a shard's grams, with pairs by their place among all blobs'. Columns are made once, in 32 bits where that is enough."""
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    sizes = np.array([np.frombuffer(blob[:16], np.int64) for blob in blobs])
    kind = np.int32 if max(n_words, *sizes.sum(0).tolist()) < 1 << 31 else np.int64
    cols = [np.empty(n, kind) for n in np.repeat(sizes.sum(0), 3).tolist()]
    starts = np.cumsum(sizes, axis=0) - sizes
    for i, blob in enumerate(blobs):
        raw, at = unpack.decompress(memoryview(blob)[16:]), 0
        for k, (n, to) in enumerate(zip(np.repeat(sizes[i], 3).tolist(), np.repeat(starts[i], 3).tolist())):
            col = _unplaned(raw[at:at + 8 * n], n)
            cols[k][to:to + n] = np.cumsum(col) + (k and starts[i, 0]) if k in (0, 3) else col
            at += 8 * n
    return cols


def _write_shard(model: Model, shard: int, blobs: list[bytes]) -> tuple[int, int]:
    u, v, n, pair, w, m = _unpacked(blobs, model.n_words)
    least = int(u.min())
    key = (u - least).astype(np.int64)
    key *= model.n_words
    key += v
    del u, v
    key, n, went = _merged(key, n, True)
    u, v = np.divmod(key, model.n_words)
    u += least
    roots, of_root = np.unique(u, return_counts=True)
    parts = [Monotone.encode(roots), *Children.encode(of_root, v)]
    share, n_pairs = _shares(n, model.counts(roots), np.repeat(np.arange(len(roots)), of_root)), len(n)
    del u, v, n, roots, of_root
    key = went[pair].astype(np.int64)
    del pair, went
    key *= model.n_words
    key += w
    del w
    key, m, _ = _merged(key, m)
    pair = key // model.n_words
    key -= pair * model.n_words     # the third words
    of_pair, follow = np.bincount(pair, minlength=n_pairs), np.bincount(pair, m, n_pairs)
    triple = _shares(m, follow, pair)
    del pair, m
    back = np.divide(DISCOUNT * of_pair, follow, out=np.ones(n_pairs), where=follow > 0)
    write_file(model.folder, f"grams-{shard}", [*parts, *Children.encode(of_pair, key), share, codes(back), triple])
    return n_pairs, len(key)


def _write_grams(model: Model):
    """Merges the grams of a shard and writes its file; (shard, pairs, triples)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, made = None, [], []
        for batch in batches:
            for shard, grams in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != now:
                    if blobs:
                        made.append((now, *_write_shard(model, now, blobs)))
                    now, blobs = shard, []
                blobs.append(grams.as_py())
        if blobs:
            made.append((now, *_write_shard(model, now, blobs)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made) if made else [()] * 3)], names=["shard", "pairs", "triples"])
    return run


def train(texts: DataFrame, text: str = "text", shard: int = SHARD) -> Model:
    """Count all texts and write their trie to the shared folder.

    Words are counted exactly; should two of them have one 64-bit hash, all is counted again under another
    seed. What a shard merges is bounded by the tokens that it is cut for."""
    spark = texts.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    for seed in range(42, 50):
        folder = fresh_folder(spark, "trie")
        make_folder(folder)
        counted = stage(rows.mapInArrow(_word_counts(seed), "word binary, hash long, n long").groupBy("word", "hash")
                        .agg(F.sum("n").alias("n")).select("hash", "n"), "words")
        n_words = counted.count()
        bits = max(1, (n_words // WORDS).bit_length())
        file = F.shiftrightunsigned("hash", 64 - bits)
        dealt = counted.select(file.alias("file"), "hash", "n").repartition(min(parts, 1 << bits), "file")
        # Within a file all hashes have the same leading bits, so their order as signed numbers is that of the rest.
        written = dealt.sortWithinPartitions("file", "hash").mapInArrow(_write_words(folder, bits), "file long, words long, tokens long, clashes long").collect()
        if not sum(r["clashes"] for r in written):
            break
    by = {r["file"]: r for r in written}
    sizes = [(by[i]["words"], by[i]["tokens"]) if i in by else (0, 0) for i in range(1 << bits)]
    starts, before = (tuple(int(x) for x in np.r_[0, np.cumsum([s[k] for s in sizes])]) for k in (0, 1))
    model = Model(folder, seed, before[-1], starts[-1], bits, starts, before, shard)
    if n_words:
        grams = rows.mapInArrow(_gram_counts(model), "shard long, grams binary")
        shards = model.n_tokens // shard + 1
        grams.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_write_grams(model), "shard long, pairs long, triples long") \
            .agg(F.sum("pairs"), F.sum("triples")).collect()
    return model


def _shard(model: Model, s: int) -> Shard | None:
    try:
        return Shard(model, s)
    except FileNotFoundError:       # a range that no pair fell into
        return None


def _looked_up(model: Model, t: _Text) -> tuple[np.ndarray, ...]:
    """The bytes for the share of each distinct pair, for what it leaves as a context, and for the share of each triple; how many
    distinct words follow each word. One shard is open at a time."""
    n, known = len(t.number), np.flatnonzero((t.number[t.first] >= 0) & (t.number[t.second] >= 0))
    share, back, types = np.full(len(t.first), NOTHING, np.uint8), np.zeros(len(t.first), np.uint8), np.zeros(n, np.int64)
    u, v = t.number[t.first[known]], t.number[t.second[known]]
    shard = model.shards(t.count[t.first[known]], t.before[t.first[known]], v)
    key = t.triples()
    triple = np.full(len(key), NOTHING, np.uint8)
    order = np.argsort(key)
    key = key[order]
    real = np.flatnonzero(t.number >= 0)
    low, high = (model.shards(t.count[real], t.before[real], np.full(len(real), x)) for x in (0, model.n_words - 1))
    for s in range(int(low[0]), int(high[-1]) + 1) if len(real) else ():
        a, b = np.searchsorted(shard, (s, s + 1))
        words = real[np.searchsorted(high, s):np.searchsorted(low, s, "right")]     # those that have pairs there
        if not len(words) or (found := _shard(model, s)) is None:
            continue
        at, hit = found.roots.find(t.number[words])
        types[words[hit]] += found.pairs.size(at[hit])
        if a == b:
            continue
        new = _begins(u[a:b])       # each first word once
        times = np.diff(np.r_[new, b - a])
        root, in_roots = (np.repeat(x, times) for x in found.roots.find(u[a:b][new]))
        mine = np.flatnonzero(in_roots)
        place, hit = found.pairs.find(root[mine], v[a:b][mine])
        mine, place = known[a:b][mine[hit]], place[hit]
        share[mine], back[mine] = found.pair[place], found.back[place]
        from_, to = int(known[a]), int(known[b - 1]) + 1
        node = np.full(to - from_, -1, np.int64)
        node[mine - from_] = place
        c, d = np.searchsorted(key, (from_ * n, to * n))
        pair, third = np.divmod(key[c:d], n)
        node, third = node[pair - from_], t.number[third]
        asked = np.flatnonzero((node >= 0) & (third >= 0))
        place, hit = found.triples.find(node[asked], third[asked])
        triple[order[c:d][asked[hit]]] = found.triple[place[hit]]
    return share, back, triple, types


def score_chunk(model: Model, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of each text."""
    t = _Text(model, texts)
    word = (t.count + 1.0) / (model.n_tokens + model.n_words + 1)
    share, back, triple, types = _looked_up(model, t)
    left = np.where(types > 0, VALUES[codes(DISCOUNT * np.maximum(types, 1) / np.maximum(t.count, 1))], 1.0)
    p = VALUES[share[t.pair_at]]
    p += left[t.seq[:-1]] * word[t.seq[1:]]
    inner = t.inner()
    back = VALUES[back[t.pair_at[inner]]]
    inner += 1                      # a triple's last pair begins one later
    back *= p[inner]
    back += VALUES[triple]
    p[inner] = back
    del inner, back
    starts = np.r_[0, t.ends[:-1]]
    known = (t.count > 0)[t.seq[1:]].astype(np.int64)
    return (t.ends - starts, np.add.reduceat(known, starts), np.add.reduceat(np.log10(word)[t.seq[1:]], starts), np.add.reduceat(np.log10(p), starts))


def score_texts(strips: DataFrame, model: Model, strip_id: str = "strip_id", text: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """(strip_id, ``carry``, n_tokens, n_known, train_tokens, base_score, score) of every row, in log10.

    The tokens of a text are its words and one end. ``base_score`` sums the add-one probabilities of the tokens;
    ``score`` those of the model. NULL and blank texts have the end only; repeated rows come back repeated."""
    rows = strips.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(strip_id).alias("strip_id"), *carry)
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, 0):
            n, known, base, score = score_chunk(model, batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n), pa.array(known), pa.array(np.full(len(n), model.n_tokens)),
                                              pa.array(base), pa.array(score)],
                                             names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_strips(strips: DataFrame, held_out: Column, strip_id: str = "strip_id", text: str = "text") -> DataFrame:
    """``score_texts`` of all rows under a model of those that are not ``held_out`` (NULL: not), with ``held_out``."""
    held = F.coalesce(held_out, F.lit(False))
    return score_texts(strips, train(strips.filter(~held), text), strip_id, text, (held.alias("held_out"),))
