"""Classes of near-duplicate strips by the Jaccard similarity of their word shingles.

A 64-bit SimHash of two texts at similarity 0.8 differs in about 10 bits, and a ring for so many
bits would file by segments too short to part anything. Candidates therefore come from bands of
minima: ``BANDS`` keys of ``ROWS`` minima each. A pair at similarity s shares a key with probability
1 - (1 - s^6)^40: 0.999995 at 0.8. Two bits of each minimum are a sketch; a pair at 0.8 differs in 36 of the 240 on average, with a
standard deviation of 5.5, and pairs beyond ``BUDGET`` are dropped before any set is read (0.00003 of the pairs at 0.8).
Every link is checked on the whole shingle sets.

No pairs of a file are listed. First each set is checked with the smallest one that it shares a file with. Then the members of files
that are still in different classes and near by sketch meet in one task a file, with their sets: links found there join classes on the
spot, so only links that join come out, one a member at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cardloom.llm.common import components, majority, small
from cardloom.plans.session import stage

#: Words of a shingle, the least similarity (tenths) of a link, and the keys that find candidates.
WORDS, TENTHS, BANDS, ROWS = 5, 8, 40, 6
SEED = 42
#: Minima whose two bits may differ; members of a file, and shingles of them, that one task compares with each other.
BUDGET, FILE, SHINGLES = 58, 1024, 1 << 20

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the ``WORDS``-word shingles of a text, sorted; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(found[i:] for i in range(WORDS)))) if len(found) >= WORDS else [b" ".join(found)]
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in parts), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a non-empty set under each of ``BANDS * ROWS`` orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (_TIMES[:, None] * hashes[None, at:at + 2048] + _PLUS[:, None]).min(1))
    return least ^ least >> np.uint64(29)


def band_keys(least: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set's minima; equal sets have equal keys."""
    return (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, as two planes of four words."""
    two = (least * _BITS >> np.uint64(62)).astype(np.uint8)
    planes = np.zeros((2, 32), np.uint8)
    planes[:, :BANDS * ROWS // 8] = np.packbits(np.stack([two & 1, two >> 1]), axis=1)
    return planes.view(np.int64).ravel()


def marked_rows(strips: DataFrame, strip_id: str, text: str) -> DataFrame:
    """(strip_id, text_hash, mark, n, fp, keys, sketch) per row: the mark is a hash of the shingle set, 0 where it is
    empty, n its size and fp its SimHash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                batch = rows.slice(at, 500)
                sets = [shingles(t.as_py()) for t in batch.column(2)]
                marks = [xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets]
                least = [minima(s) if len(s) else None for s in sets]
                none = np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)),
                     pa.array([none if x is None else band_keys(x) for x in least], pa.list_(pa.int64())),
                     pa.array([none if x is None else sketch(x) for x in least], pa.list_(pa.int64()))],
                    names=["strip_id", "text_hash", "mark", "n", "fp", "keys", "sketch"])

    rows = strips.select(F.col(strip_id).alias("strip_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["strip_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"strip_id {kind}, text_hash long, mark long, n long, fp long, keys array<long>, sketch array<long>")


def whole_sets(strips: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(mark, shingles) of the texts whose hash is ``wanted`` (text_hash). Sets are larger than their texts, so they are made
    again where candidates need them, not stored for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                sets = [s for t in rows.column(1).slice(at, 500) if len(s := shingles(t.as_py()))]
                marks = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["mark", "shingles"])

    rows = strips.select(F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows.join(wanted, "text_hash", "left_semi").mapInArrow(run, "mark long, shingles array<long>").dropDuplicates(["mark"])


def _checked(pairs: DataFrame, marks: DataFrame, strips: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; sizes and sketches are looked at first."""
    end = lambda c: marks.select(F.col("mark").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n", "sketch", "text_hash")])
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    word = lambda c, i: F.element_at(f"{c}_sketch", i)
    apart = [F.bit_count(word("a", i).bitwiseXOR(word("b", i)).bitwiseOR(word("a", i + 4).bitwiseXOR(word("b", i + 4)))) for i in range(1, 5)]
    near = both.filter((10 * F.least("a_n", "b_n") >= TENTHS * F.greatest("a_n", "b_n")) & (apart[0] + apart[1] + apart[2] + apart[3] <= BUDGET))
    return _whole(near.select("a", "b", "a_text_hash", "b_text_hash"), strips, text)


def alike(pairs: DataFrame, marks: DataFrame, strips: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of marks whose sets reach the similarity, however they were found; sizes are looked at first."""
    end = lambda c: marks.select(F.col("mark").alias(c), F.col("n").alias(f"{c}_n"), F.col("text_hash").alias(f"{c}_text_hash"))
    near = pairs.join(end("a"), "a").join(end("b"), "b").filter(10 * F.least("a_n", "b_n") >= TENTHS * F.greatest("a_n", "b_n"))
    return _whole(near.select("a", "b", "a_text_hash", "b_text_hash"), strips, text)


def _whole(near: DataFrame, strips: DataFrame, text: str) -> DataFrame:
    near = stage(near, "near")
    sets = _sets(near.select(F.explode(F.array("a_text_hash", "b_text_hash")).alias("text_hash")), strips, text)
    one, two = (sets.select(F.col("mark").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
    common = F.size(F.array_intersect("_a", "_b"))
    return stage(near.select("a", "b").join(one, "a").join(two, "b")
                 .filter((10 + TENTHS) * common >= TENTHS * (F.size("_a") + F.size("_b"))).select("a", "b"), "checked")


def _near(root: np.ndarray, size: np.ndarray, planes: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which members of a file may be linked to one of another class, by sizes and sketches."""
    out, words = np.zeros(len(root), bool), planes.shape[1] // 2
    for at in range(0, len(root), 128):
        rows = slice(at, min(at + 128, len(root)))
        x = planes[rows, None, :] ^ planes[None, :, :]
        fits = np.bitwise_count(x[..., :words] | x[..., words:]).sum(2, dtype=np.int32) <= BUDGET
        fits &= root[rows, None] != root[None, :]
        fits &= 10 * np.minimum(size[rows, None], size[None, :]) >= TENTHS * np.maximum(size[rows, None], size[None, :])
        if side.any():
            fits &= side[rows, None] != side[None, :]
        out[rows] |= fits.any(1)
    return out


def _joining(root: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of a file that join their classes, checked on the whole sets."""
    sizes = np.array([len(x) for x in sets])
    _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, own = np.unique(root, return_inverse=True)
    both, found, seen = side.any(), [], np.zeros(numbers.max() + 1, bool)
    for i in range(len(sets) - 1):
        if (own[i + 1:] == own[i]).all():
            continue
        seen[numbers[starts[i]:ends[i]]] = True
        common = np.add.reduceat(seen[numbers[ends[i]:]], starts[i + 1:] - ends[i], dtype=np.int64)
        seen[numbers[starts[i]:ends[i]]] = False
        alike = ((10 + TENTHS) * common >= TENTHS * (sizes[i] + sizes[i + 1:])) & (own[i + 1:] != own[i])
        if both:
            alike &= side[i + 1:] != side[i]
        for j in (np.flatnonzero(alike) + i + 1).tolist():
            if own[j] != own[i]:
                found.append((i, j))
                own[own == own[j]] = own[i]
    return found


def _by_file(work, schema: pa.Schema):
    """Runs ``work`` on the rows of every file (key, low, high first) that streams by, sorted by file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            out = work(rows)
            if out is not None and out.num_rows:
                yield out.cast(schema) if out.schema != schema else out
        for batch in batches:
            if not batch.num_rows:
                continue
            file, low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.flatnonzero((file[1:] != file[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            for s, e in zip(np.r_[0, new], np.r_[new, len(file)]):
                if now != (key := (file[s], low[s], high[s])):
                    if held:
                        yield from done()
                    now = key
                held.append(batch.slice(s, e - s))
        if held:
            yield from done()
    return run


def _candidates(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    root, size, side = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("root", "n", "side"))
    if (root == root[0]).all():
        return None
    flat = rows.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(root), -1)
    return rows.filter(pa.array(_near(root, size, flat, side))).select(_FILED)


def _linked(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    mark, root, side = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("mark", "root", "side"))
    sets = [x.values.to_numpy(zero_copy_only=False) for x in rows.column("shingles")]
    found = np.array(_joining(root, sets, side), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(mark[found[:, 0]]), pa.array(mark[found[:, 1]])], names=["a", "b"])


_FILED = ["key", "low", "high", "side", "mark", "root"]
_FILED_ROWS = "key long, low long, high long, side int, mark long, root long"
_FILED_ARROW = pa.schema([(c, pa.int32() if c == "side" else pa.int64()) for c in _FILED])
_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _across(shared: DataFrame, marks: DataFrame, roots: DataFrame, strips: DataFrame, text: str) -> DataFrame:
    """(a, b): links between members of files that are still in different classes.

    A file of more than ``FILE`` members or ``SHINGLES`` shingles is filed again, under its key and each other key of a member: a
    pair at 0.8 shares 10 keys on average, and one alone with probability 0.00008. What is larger still is cut into slices, and each
    two of them are compared, so no task ever holds more than two slices."""
    named = marks.select("mark", "n", "keys", "sketch", "text_hash").join(roots.withColumnRenamed("node", "mark"), "mark", "left") \
        .withColumn("root", F.coalesce("root", "mark"))
    named = stage(named, "named")

    def split(files: DataFrame) -> DataFrame:
        mixed = files.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.greatest(
            F.count(F.lit(1)) / FILE, F.sum("n") / SHINGLES).alias("load")).filter("lo < hi")
        return stage(files.join(mixed.select("key", "load"), "key"), "split")
    first = split(shared.select("key", "mark").join(named.select("mark", "root", "n"), "mark"))
    large = first.filter("load > 1").select("key", "mark", "root", "n").join(named.select("mark", "keys"), "mark")
    again = large.select(F.explode(F.filter("keys", lambda k: k != F.col("key"))).alias("other"), "key", "mark", "root", "n") \
        .select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "mark", "root", "n").distinct()
    second = split(again).withColumn("slices", F.ceil("load"))
    dealt = second.withColumn("own", F.pmod(F.xxhash64("mark"), "slices")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    zero = F.lit(0).cast("long")
    files = first.filter("load <= 1").select("key", zero.alias("low"), zero.alias("high"), F.lit(0).alias("side"), "mark") \
        .unionByName(dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "mark"))
    parts = max(1, int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def by_file(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "mark")
    met = by_file(files.join(named.select("mark", "root", "n", "sketch"), "mark").select(*_FILED, "n", "sketch"))
    near = stage(met.mapInArrow(_by_file(_candidates, _FILED_ARROW), _FILED_ROWS), "near")
    sets = _sets(near.select("mark").distinct().join(named.select("mark", "text_hash"), "mark").select("text_hash"), strips, text)
    whole = by_file(near.join(sets, "mark").select(*_FILED, "shingles"))
    return stage(whole.mapInArrow(_by_file(_linked, _LINKS_ARROW), "a long, b long").distinct(), "across")


def _sets(wanted: DataFrame, strips: DataFrame, text: str) -> DataFrame:
    return stage(whole_sets(strips, text, small(stage(wanted.distinct(), "wanted"), 200_000)), "sets")


def links(marked: DataFrame, strips: DataFrame, text: str, first=None) -> DataFrame:
    """(a, b) marks of sets that reach the similarity; they connect what candidates connect. ``first``: links of another
    search, by marks (mark, n, fp, keys, sketch, text_hash); only what they leave apart is checked here."""
    marks = stage(marked.filter("n > 0").select("mark", "n", "fp", "keys", "sketch", "text_hash").dropDuplicates(["mark"]), "marks")
    before = first(marks, strips, text) if first else None
    filed = marks.select("mark", F.explode("keys").alias("key"))
    files = filed.groupBy("key").agg(F.min("mark").alias("a"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = stage(filed.join(files.select("key", "a"), "key"), "shared")
    # One check a text: with the smallest text that it shares a file with.
    stars = shared.groupBy(F.col("mark").alias("b")).agg(F.min("a").alias("a")).filter("a <> b").select("a", "b")
    if before is not None:
        roots = components(before)
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        stars = stars.join(root("a"), "a", "left").join(root("b"), "b", "left") \
            .filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    found = _checked(stars, marks, strips, text)
    found = found if before is None else before.unionByName(found)
    return found.unionByName(_across(shared, marks, components(found), strips, text))


def similar_classes(strips: DataFrame, strip_id: str = "strip_id", text: str = "text", first=None) -> DataFrame:
    """(strip_id, component_id) for every row: the smallest id that is reachable over links of
    similarity ``TENTHS`` tenths or more. NULL and blank texts are one class; repeated rows come back repeated, an
    empty table gives no rows, other columns are not looked at. ``first`` as in ``links``."""
    marked = stage(marked_rows(strips, strip_id, text), "keys")
    roots = components(links(marked, strips, text, first)).withColumnRenamed("node", "mark")
    placed = marked.groupBy("mark").agg(F.min("strip_id").alias("least")).join(roots, "mark", "left") \
        .withColumn("root", F.coalesce("root", "mark"))
    placed = stage(placed, "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(placed.join(least, "root").select("mark", "component_id"), "named")
    return marked.select("strip_id", "mark").join(named, "mark").select("strip_id", "component_id")
