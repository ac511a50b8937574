"""Near-duplicate strips by SimHash; candidates come from a pigeonring filter.

A fingerprint is cut into three segments set in a ring. If two fingerprints differ in at most
two bits, then from some segment on, the differences of the chains of one, two and three
consecutive segments stay within their proportional budgets 2/3, 4/3 and 2: the first segment
is equal, the first two differ in at most one bit, all three in at most two. Each fingerprint is
therefore filed, for each start, under the first segment and the second with one bit masked (each
in turn): two fingerprints in one file satisfy the chain of length two, and no linked pair is
missed. The full Hamming check follows inside each file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardloom.llm.common import components, key_of, majority
from cardloom.llm.similar import alike, similar_classes
from cardloom.plans.session import stage

SEED, WORDS, BITS = 42, 3, 2
#: (lowest bit, width) of the ring's segments.
RING = ((0, 21), (21, 21), (42, 22))
#: Parts of the second segment that ``keep_one`` masks in turn, instead of single bits: a third of the filings.
PARTS = 7
#: Files up to this size are compared pair by pair, larger ones by looking up neighbours.
PAIRWISE = 64


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the three-word shingles of a text, as an unsigned number."""
    from xxhash import xxh64_intdigest
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(WORDS)))) if len(found) >= WORDS else [b" ".join(found)]
    return majority(np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def fingerprints(strips: DataFrame, strip_id: str = "strip_id", text: str = "text") -> DataFrame:
    """(strip_id, fp): a signed 64-bit fingerprint per row, text by text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["strip_id", "fp"])

    rows = strips.select(F.col(strip_id).alias("strip_id"), F.col(text).alias("text"))
    kind = rows.schema["strip_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"strip_id {kind}, fp long")


def ring_files(fp: Column, parts: int | None = None) -> Column:
    """Array of the files of a fingerprint: (start, masked bit, kept bits of the chain). With ``parts``, as many runs of
    the second segment's bits are masked in turn: a differing bit lies in one of them, so no link is missed; the check inside
    a file does the rest."""
    files = []
    for start, (low, width) in enumerate(RING):
        first = ((1 << width) - 1) << low
        nlow, nwidth = RING[(start + 1) % 3]
        for bits in np.array_split(np.arange(nlow, nlow + nwidth), parts or nwidth):
            bit = int(bits[0])
            mask = first | (((1 << nwidth) - 1) << nlow) & ~(((1 << len(bits)) - 1) << bit)
            mask = mask - (1 << 64) if mask >= 1 << 63 else mask
            files.append(F.struct(F.lit(start * 64 + bit).cast("short").alias("file"),
                                  fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*files)


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links (smaller first element, member) that join the members of one file with a Hamming
    distance of at most two between neighbours; at most one link per member."""
    n = len(values)
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = top(i), top(j)
        if i != j:
            up[max(i, j)] = min(i, j)

    if n <= PAIRWISE:
        x = values.view(np.uint64)
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= BITS
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            join(int(i), int(j))
    else:
        # Members at distance two share a value one bit from both; values are filed in turn.
        # The work is 65 look-ups per member, whatever the size of the file.
        flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
        near = (values.view(np.uint64)[:, None] ^ flips[None, :]).ravel()
        owner = np.repeat(np.arange(n), 65)
        order = np.argsort(near, kind="stable")
        near, owner = near[order], owner[order]
        same = np.nonzero(near[1:] == near[:-1])[0]
        for i, j in zip(owner[same].tolist(), owner[same + 1].tolist()):
            join(i, j)
    return [(i, top(i)) for i in range(n) if top(i) != i]


def ring_links(distinct: DataFrame, masked: int | None = None) -> DataFrame:
    """(a, b) signed fingerprints: links within two bits that connect everything so linked.

    ``distinct`` (fp) holds each fingerprint once, so copies are one row here. A file holds the
    fingerprints that share 41 bits or more, so 2^23 at most whatever the input, and few in
    practice; the 64 filings of each are shuffled once (with ``masked`` parts 21 of them, under 38 bits or more). Files with equal members are compared once,
    and per file a spanning forest is returned, not all pairs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for members in batch["members"]:
                values = np.sort(np.asarray(members, np.int64))
                for i, root in _forest(values):
                    a.append(values[root])
                    b.append(values[i])
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    filed = distinct.repartition(parts, "fp").select("fp", F.explode(ring_files(F.col("fp"), masked)).alias("f")).select("f.file", "f.bits", "fp")
    shared = (filed.groupBy("file", "bits").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
              .select(F.array_sort("members").alias("members")).distinct())
    return stage(shared.mapInPandas(run, "a long, b long").distinct(), "links")


def near_duplicates(strips: DataFrame, strip_id: str = "strip_id", text: str = "text") -> DataFrame:
    """(strip_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest id
    that is reachable over links of at most two differing bits, itself included.

    NULL and blank texts have the fingerprint zero and link like any other; short texts are one
    shingle; repeated rows come back repeated. A NULL id takes part and may be reached, but is
    never the smallest unless its class has no other. Copies meet only in pre-aggregated minima."""
    marked = stage(fingerprints(strips, strip_id, text), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("strip_id").alias("least")), "classes")
    roots = components(ring_links(classes.select("fp")))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(placed.join(least, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(
        "strip_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def ring_alike(marks: DataFrame, strips: DataFrame, text: str) -> DataFrame:
    """(a, b): links between shingle sets (mark, n, fp, text_hash) whose fingerprints the ring connects, checked on the whole sets.

    Sets of one fingerprint are checked with the smallest of them, and the smallest ones along the links of the ring, so the
    checks grow with the sets."""
    least = stage(marks.groupBy("fp").agg(F.min("mark").alias("least")), "ringed")
    found = ring_links(least.select("fp"), PARTS)
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}"))
    pairs = found.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")) \
        .unionByName(marks.join(least, "fp").filter("mark <> least").select(F.col("least").alias("a"), F.col("mark").alias("b")))
    return alike(pairs, marks, strips, text)


def keep_one(strips: DataFrame, strip_id: str = "strip_id", text: str = "text") -> DataFrame:
    """One row of each class of similar texts (five words, Jaccard 0.8; the three words and two bits above bind
    ``near_duplicates`` only) stays, whole: that of the smallest id, and of the smallest text hash among rows of that id.

    The SimHash of a text's five-word shingles and the ring come first and link what differs in two bits at most; ``similar`` then finds the
    links at 0.8 that two bits leave, between texts still apart. The survivor is chosen per class, not per id: ids may be NULL (NULL comes
    after every id) or stand on several texts. A row repeated under one id and text stays once."""
    mark = F.struct(F.col(strip_id).isNull().alias("none"), F.col(strip_id).alias("id"), _text_hash(F.col(text)).alias("hash"))
    found = similar_classes(strips.select(mark.alias("strip_id"), F.col(text).alias("text")), first=ring_alike)
    kept = stage(found.filter(F.col("strip_id") == F.col("component_id"))
                 .select(key_of(F.col("strip_id.id")).alias("__key"), F.col("strip_id.hash").alias("__hash")).distinct(), "kept")
    # By merge at every size: the kept ids grow with the strips. Repeats are pre-aggregated.
    rows = strips.withColumn("__key", key_of(F.col(strip_id))).withColumn("__hash", _text_hash(F.col(text)))
    return rows.join(kept.hint("merge"), ["__key", "__hash"]).dropDuplicates(["__key", "__hash"]).drop("__key", "__hash")


def _text_hash(text: Column) -> Column:
    """128 bits of a text, never NULL."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))
