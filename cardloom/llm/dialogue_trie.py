"""Prefix trie of worker dialogues that are spliced from stored dialogues.

A rebuilt dialogue is a head of one stored dialogue followed by the rest of another one. A prefix of d turns has
the fingerprint ``G = sum(s_i * B**i, i = 1..d) mod P`` under two bases ``B``, where s_i stands for the i-th
turn. Fingerprints are a monoid: ``G(xy) = G(x) + B**len(x) * G(y)``, so those of all rebuilt prefixes follow from
running sums over the stored turns alone, ``G(head) + B**(k - h) * (G(own, j) - G(own, h))``, and no rebuilt text
is ever made. Every rebuilt turn is a reference (pull_id, position) to a stored one. Prefixes of one fingerprint are
one node only if the turns that they refer to are equal; as all of them share the parent's fingerprint,
that makes the whole paths equal, depth by depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardloom.llm.common import ranked
from cardloom.plans.session import stage

#: The prime of the fingerprints and two bases below it.
PRIME = (1 << 61) - 1
BASES = tuple(int.from_bytes(sha256(f"dialogue trie {i}".encode()).digest()[:8], "big") % PRIME for i in (1, 2))
#: Turns of one dialogue that one window scans, and member ids that are joined to one string.
TILE, BLOCK = 4096, 4096
NODE = ("depth", "g1", "g2")


@lru_cache(1 << 16)
def powers(exponent: int) -> tuple[int, int]:
    return pow(BASES[0], exponent, PRIME), pow(BASES[1], exponent, PRIME)


def residues(d1: int, d2: int) -> tuple[int, int]:
    """What stands for a turn in the sums, from two signed words of its digest."""
    return d1 % PRIME, d2 % PRIME


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds t1, t2: the turn's summands at its stored position."""
    for batch in batches:
        t1, t2 = [], []
        for at, d1, d2 in zip(*(batch.column(c).to_pylist() for c in ("at", "d1", "d2"))):
            (s1, s2), (b1, b2) = residues(d1, d2), powers(at)
            t1.append(s1 * b1 % PRIME)
            t2.append(s2 * b2 % PRIME)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t1, pa.int64()), pa.array(t2, pa.int64())],
                                         names=[*batch.schema.names, "t1", "t2"])


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of rebuilt prefixes (g) and of their parents (p), from those of the parts."""
    names = ["pull_id", "depth", "g1", "g2", "p1", "p2", "d1", "d2", "n_bytes", "ref_pull_id", "ref_at", "last"]
    for batch in batches:
        made: list[list[int]] = [[], [], [], []]
        cols = (batch.column(c).to_pylist() for c in ("depth", "shift", "d1", "d2", "o1", "o2", "h1", "h2", "b1", "b2"))
        for depth, shift, d1, d2, o1, o2, h1, h2, b1, b2 in zip(*cols):
            (m1, m2), (w1, w2), (s1, s2) = powers(shift), powers(depth), residues(d1, d2)
            g1, g2 = (b1 + m1 * (o1 - h1)) % PRIME, (b2 + m2 * (o2 - h2)) % PRIME
            for out, x in zip(made, (g1, g2, (g1 - s1 * w1) % PRIME, (g2 - s2 * w2) % PRIME)):
                out.append(x)
        keep = {c: batch.column(c) for c in names if c in batch.schema.names}
        keep |= {c: pa.array(x, pa.int64()) for c, x in zip(("g1", "g2", "p1", "p2"), made)}
        yield pa.RecordBatch.from_arrays([keep[c] for c in names], names=names)


def _scanned(rows: DataFrame, key: str, at: str, values: dict[str, str], back: bool = False) -> DataFrame:
    """Running sums of ``values`` (name: column) along ``at`` per key, or from each row to the end (``back``).
    Tiles are scanned apart and only their sums meet, so a very long dialogue is no hot group."""
    way = (lambda c: F.col(c).desc()) if back else (lambda c: F.col(c).asc())
    rows = rows.withColumn("_tile", F.floor(F.col(at) / TILE))
    total = {c: F.sum(F.col(c).cast("decimal(38,0)")) for c in values.values()}
    before = W.partitionBy(key).orderBy(way("_tile")).rowsBetween(W.unboundedPreceding, -1)
    tiles = rows.groupBy(key, "_tile").agg(*[x.alias(f"_{c}") for c, x in total.items()])
    tiles = tiles.select(key, "_tile", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in total])
    local = W.partitionBy(key, "_tile").orderBy(way(at)).rowsBetween(W.unboundedPreceding, 0)
    return (rows.join(tiles, [key, "_tile"]).withColumns({n: total[c].over(local) + F.col(f"_{c}") for n, c in values.items()})
            .drop("_tile", *[f"_{c}" for c in total]))


def stored_turns(turns: DataFrame, pull_id: str, row_index: str, role: str, text: str) -> DataFrame:
    """(pull_id, at, d1, d2, n_bytes, g1, g2): every stored turn by reference: its position from 1 on, two words of its
    content's digest, its text's bytes, and the fingerprint of the dialogue up to it."""
    empty = F.lit("")
    rows = turns.select(F.col(pull_id).alias("pull_id"), F.col(row_index).alias("row_index"), F.coalesce(F.col(role).cast("string"), empty).alias("role"),
                        F.coalesce(F.col(text).cast("string"), empty).alias("text")).filter("pull_id IS NOT NULL")
    told = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    word = lambda i: F.conv(F.substring("told", 1 + 15 * i, 15), 16, 10).cast("long")
    rows = rows.withColumn("told", told).select("pull_id", "row_index", "role", "text", word(0).alias("d1"), word(1).alias("d2"),
                                                F.octet_length("text").cast("long").alias("n_bytes"))
    placed = ranked(rows, "pull_id", "row_index", "role", "text", keep=("pull_id", "d1", "d2", "n_bytes"))
    firsts = placed.groupBy("pull_id").agg(F.min("rank").alias("first"))
    placed = placed.join(firsts, "pull_id").select("pull_id", (F.col("rank") - F.col("first") + 1).alias("at"), "d1", "d2", "n_bytes")
    kind = placed.schema["pull_id"].dataType.simpleString()
    terms = placed.mapInArrow(_terms, f"pull_id {kind}, at long, d1 long, d2 long, n_bytes long, t1 long, t2 long")
    summed = _scanned(terms, "pull_id", "at", {"g1": "t1", "g2": "t2"})
    prime = F.lit(PRIME).cast("decimal(38,0)")
    return stage(summed.select("pull_id", "at", "d1", "d2", "n_bytes", *[(F.col(g) % prime).cast("long").alias(g) for g in ("g1", "g2")]), "turns")


def rebuilt_prefixes(stored: DataFrame, splices: DataFrame, pull_id: str, base_id: str, n_head: str) -> DataFrame:
    """(pull_id, depth, g1, g2, p1, p2, d1, d2, n_bytes, ref_pull_id, ref_at, last): every prefix of every rebuilt dialogue,
    the textless one too; ``last`` marks the whole dialogue."""
    asked = splices.select(F.col(pull_id).alias("pull_id"), F.struct(F.col(base_id).alias("base_id"), F.greatest(F.coalesce(
        F.col(n_head).cast("long"), F.lit(0)), F.lit(0)).alias("n_head")).alias("s")).filter("pull_id IS NOT NULL")
    asked = asked.groupBy("pull_id").agg(F.min("s").alias("s")).select("pull_id", "s.*")
    lengths = stored.groupBy("pull_id").agg(F.max("at").alias("n"))
    zero = F.lit(0).cast("long")
    plan = (asked.join(lengths.withColumnRenamed("n", "n_own"), "pull_id", "left")
            .join(lengths.select(F.col("pull_id").alias("base_id"), F.col("n").alias("n_base")), "base_id", "left")
            .withColumn("k", F.least("n_head", F.coalesce("n_base", zero)))
            .withColumn("length", F.col("k") + F.greatest(F.coalesce("n_own", zero) - F.col("n_head"), zero))
            .join(stored.select(F.col("pull_id").alias("base_id"), F.col("at").alias("k"), F.col("g1").alias("b1"), F.col("g2").alias("b2")), ["base_id", "k"], "left")
            .join(stored.select("pull_id", F.col("at").alias("n_head"), F.col("g1").alias("h1"), F.col("g2").alias("h2")), ["pull_id", "n_head"], "left")
            .select("pull_id", "base_id", "n_head", "k", "length", *[F.coalesce(c, zero).alias(c) for c in ("b1", "b2", "h1", "h2")]))
    plan = stage(plan, "splices")
    told = ["d1", "d2", "n_bytes", F.col("g1").alias("o1"), F.col("g2").alias("o2")]
    parts = ["pull_id", "depth", "shift", "d1", "d2", "o1", "o2", "h1", "h2", "b1", "b2", "n_bytes", "ref_pull_id", "ref_at", "last"]
    heads = (plan.filter("k > 0").select("pull_id", "base_id", "length", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("ref_at"))
             .join(stored.select(F.col("pull_id").alias("base_id"), F.col("at").alias("ref_at"), *told), ["base_id", "ref_at"])
             .withColumns({"depth": F.col("ref_at"), "shift": zero, "ref_pull_id": F.col("base_id"), **{c: zero for c in ("h1", "h2", "b1", "b2")}}))
    own = (stored.select("pull_id", F.col("at").alias("ref_at"), *told).join(plan, "pull_id").filter("ref_at > n_head")
           .withColumns({"depth": F.col("k") + F.col("ref_at") - F.col("n_head"), "shift": F.col("k") - F.col("n_head"), "ref_pull_id": F.col("pull_id")}))
    rows = heads.withColumn("last", F.col("depth") == F.col("length")).select(*parts).unionByName(
        own.withColumn("last", F.col("depth") == F.col("length")).select(*parts))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("pull_id", "ref_pull_id")}
    made = rows.mapInArrow(_spliced, f"pull_id {kinds['pull_id']}, depth long, g1 long, g2 long, p1 long, p2 long, d1 long, d2 long, n_bytes long, "
                                     f"ref_pull_id {kinds['ref_pull_id']}, ref_at long, last boolean")
    none = {c: F.lit(None).cast(made.schema[c].dataType) for c in ("p1", "p2", "ref_pull_id", "ref_at")}
    roots = plan.select("pull_id", (F.col("length") == 0).alias("last")).withColumns({**{c: zero for c in ("depth", "g1", "g2", "d1", "d2", "n_bytes")}, **none})
    return stage(made.unionByName(roots.select(*made.columns)), "prefixes")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from a node's blocks of ids, in order; a node's digest is carried from batch to batch."""
    now, state, made = None, None, []

    def sent() -> pa.RecordBatch:
        cols = list(zip(*made)) if made else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=[*NODE, "ends_sha256"])
    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if node == now:
                state.update(f",{ids}".encode())
                continue
            if now:
                made.append((*now, state.hexdigest()))
            now, state = node, sha256(ids.encode())
        if len(made) > 4096:
            yield sent()
            made.clear()
    if now:
        made.append((*now, state.hexdigest()))
        yield sent()


def member_digests(ends: DataFrame) -> DataFrame:
    """(depth, g1, g2, ends_sha256) of the ids that end at each node, ascending and comma-joined. Ids are sorted by ranges over all
    nodes and joined in blocks; of a node that very many dialogues end at, only the blocks meet, as a digest is sequential."""
    placed = ranked(ends, *NODE, "pull_id").withColumn("block", F.floor(F.col("rank") / BLOCK))
    blocks = placed.groupBy(*NODE, "block").agg(F.sort_array(F.collect_list("pull_id")).alias("ids")) \
        .withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(parts, *NODE).sortWithinPartitions(*NODE, "block").mapInArrow(_ends, "depth long, g1 long, g2 long, ends_sha256 string")


def _agree(low: Column, high: Column, value: Column) -> Column:
    return F.when(low.eqNullSafe(high), value).otherwise(F.raise_error(F.lit("unequal turns under one fingerprint")))


def prefix_trie(turns: DataFrame, splices: DataFrame, pull_id: str = "pull_id", row_index: str = "row_index", role: str = "role",
                text: str = "text", base_id: str = "base_id", n_head: str = "n_head") -> DataFrame:
    """(pull_id, depth, parent_pull_id, n_members, n_children, n_leaves, saved_bytes, ends_sha256, ref_pull_id, ref_at): a row for
    every node of the trie of rebuilt dialogues.

    ``splices`` names the rebuilt dialogues: ``pull_id`` is the first ``n_head`` turns of ``base_id`` (all if fewer, none
    if absent or NULL), then its own turns after its first ``n_head``. A node is a distinct sequence of ``depth`` turns (role,
    text), from the textless root on; its members are the rebuilt dialogues that begin with it and ``pull_id`` is the smallest.
    ``n_leaves`` counts childless nodes of its subtree, itself included; ``saved_bytes`` sums (n_members - 1) times the bytes of
    the last text over its subtree; ``ends_sha256`` is the digest of the ids of members that end there;
    (``ref_pull_id``, ``ref_at``) refers to a stored turn that equals its last one.

    Turns stand in the order of ``row_index`` (NULL first; ties by role, then text); repeated rows are turns each. NULL
    role or text: empty. Rows without ``pull_id`` belong to no dialogue. An id repeated in ``splices`` counts once, by its
    smallest (base, head). No splices: no rows. Subtree sums need no walk: a node's smallest member owns it, and
    a subtree's sum is the sum, over the dialogues through its top, of what each owns from there on."""
    stored = stored_turns(turns, pull_id, row_index, role, text)
    rows = rebuilt_prefixes(stored, splices, pull_id, base_id, n_head)
    nodes = rows.groupBy(*NODE).agg(
        F.min("pull_id").alias("pull_id"), F.count(F.lit(1)).alias("n_members"), F.min("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min_by("ref_pull_id", "pull_id").alias("ref_pull_id"), F.min_by("ref_at", "pull_id").alias("ref_at"),
        *[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("d1", "d2", "p1", "p2")])
    same = F.struct("lo_d1", "lo_d2", "lo_p1", "lo_p2"), F.struct(*[F.col(f"hi_{c}").alias(f"lo_{c}") for c in ("d1", "d2", "p1", "p2")])
    nodes = stage(nodes.withColumn("n_members", _agree(*same, F.col("n_members"))).drop(*[f"{n}_{c}" for n in ("lo", "hi") for c in ("d1", "d2", "p1", "p2")]), "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2")]
    kids = nodes.filter("depth > 0").select(*above).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(kids, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    owned = nodes.select("pull_id", "depth", ((F.col("n_members") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    paths = rows.select("pull_id", *NODE).join(owned, ["pull_id", "depth"], "left").fillna(0, ["saved", "leaf"])
    sums = _scanned(paths, "pull_id", "depth", {"n_leaves": "leaf", "saved_bytes": "saved"}, back=True) \
        .groupBy(*NODE).agg(*[F.sum(c).cast("long").alias(c) for c in ("n_leaves", "saved_bytes")])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("pull_id").alias("parent_pull_id"))
    ends = member_digests(rows.filter("last").select(*NODE, "pull_id"))
    return (nodes.join(sums, list(NODE)).join(ends, list(NODE), "left").join(parents, ["depth", "p1", "p2"], "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
            .select("pull_id", "depth", "parent_pull_id", "n_members", "n_children", "n_leaves", "saved_bytes", "ends_sha256", "ref_pull_id", "ref_at"))
