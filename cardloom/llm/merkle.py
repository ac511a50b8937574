"""Merkle trees over manifest rows, with the inclusion proof of every row.

Rows are leaves; the leaves of a group (a manifest's ``source``) are a tree, the groups' roots are the
leaves of one more tree. Proofs are made by octopus multiproof: a leaf partition (an aligned run
of one large group's leaves, or several whole small groups) first works out the least set of node
coordinates that the proofs of all its leaves need and that it can't derive itself, fetches these nodes
by one join, derives the shared interiors, and expands each leaf's own proof on the spot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardloom.llm.common import key_of, ranked, small
from cardloom.plans.session import stage

#: Children of a node, and the levels that one task folds by default.
ARITY, DEPTH = 3, 7
#: The tree over the groups' roots.
UPPER = -1
_NODE = "tree long, level int, n long, pos long, digest binary"


def digest(*parts: bytes) -> bytes:
    """SHA-256 of the parts in order, as hex text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(fields: Iterable[Column]) -> Column:
    """Hex SHA-256 of a row: each field is ``-`` if NULL, else its UTF-8 byte count, ``:`` and its value."""
    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[told(c) for c in fields]), 256)


def fold(level: list[bytes]) -> list[bytes]:
    """The nodes above a run of consecutive nodes that begins at a multiple of ``ARITY``."""
    return [digest(*level[i:i + ARITY]) for i in range(0, len(level), ARITY)]


def above(n: int) -> int:
    return -(-n // ARITY)


def missing(held: set[int], n: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Coordinates (level, pos) of the nodes that prove all ``held`` nodes of a level with ``n`` nodes and
    can't be derived from them: the octopus walk, level by level up to the root."""
    while n > 1:
        up = {pos // ARITY for pos in held}
        for parent in sorted(up):
            for pos in range(parent * ARITY, min(n, (parent + 1) * ARITY)):
                if pos not in held:
                    yield level, pos
        held, n, level = up, above(n), level + 1


def _nodes(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["tree", "level", "n", "pos", "digest"])


def _trees(leaves: pa.Table) -> Iterator[tuple[int, int, list[dict]]]:
    """(tree, n, rows in order) of the trees of a leaf partition."""
    rows = leaves.sort_by([("tree", "ascending"), ("pos", "ascending")]).to_pylist()
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i]["tree"] != rows[start]["tree"]:
            yield rows[start]["tree"], rows[start]["n"], rows[start:i]
            start = i


def _top(leaves: pa.Table, depth: int) -> pa.Table:
    """The highest node that a leaf partition derives of each of its trees."""
    out, p1, p2 = [], leaves["p1"][0].as_py(), leaves["p2"][0].as_py()
    for tree, n, rows in _trees(leaves):
        nodes, at, level = [r["leaf"].hex().encode() for r in rows], rows[0]["pos"], 0
        while n > 1 and level < depth:
            nodes, at, n, level = fold(nodes), at // ARITY, above(n), level + 1
        out.append((tree, level, n, at, nodes[0]))
    made = _nodes(out)
    return made.append_column("p1", pa.array([p1] * len(out), pa.int64())).append_column("p2", pa.array([p2] * len(out), pa.int64()))


def _lift(nodes: pa.Table, depth: int) -> pa.Table:
    """All nodes of up to ``depth`` levels above an aligned run of nodes of one tree and level."""
    nodes = nodes.sort_by("pos")
    first = nodes.slice(0, 1).to_pylist()[0]
    run, at, n, level, out = nodes["digest"].to_pylist(), first["pos"], first["n"], first["level"], []
    for _ in range(depth):
        if n > 1:
            run, at, n, level = fold(run), at // ARITY, above(n), level + 1
            out += [(first["tree"], level, n, at + i, d) for i, d in enumerate(run)]
    return _nodes(out)


def grow(base: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(tree, level, n, pos, digest): the nodes of ``base``, all of one level, and all nodes above them; ``n`` is the
    number of nodes of their level. ``depth`` levels a round, each run of nodes in one task."""
    found, open_ = [base], base.filter("n > 1")
    while not open_.isEmpty():
        level = open_.agg(F.max("level")).first()[0] + depth
        up = stage(open_.groupBy("tree", F.floor(F.col("pos") / ARITY ** depth)).applyInArrow(lambda t: _lift(t, depth), _NODE), "nodes")
        found.append(up)
        open_ = up.filter((F.col("level") == level) & (F.col("n") > 1))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _wanted(tops: pa.Table, n_groups: int) -> pa.Table:
    """Coordinates that a leaf partition has to fetch, from the nodes that it derives itself."""
    rows, out = tops.to_pylist(), []
    for r in rows:
        out += [(r["tree"], level, pos) for level, pos in missing({r["pos"]}, r["n"], r["level"])]
    out += [(UPPER, level, pos) for level, pos in missing({r["tree"] for r in rows}, n_groups)]
    cols = list(zip(*out)) if out else [()] * 3
    head = [pa.array([rows[0][p]] * len(out), pa.int64()) for p in ("p1", "p2")]
    return pa.table(head + [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64()))],
                    names=["p1", "p2", "tree", "level", "pos"])


class _Climb:
    """The levels of one tree above what a partition holds: per node the siblings before and after it."""

    def __init__(self, tree: int, n: int, held: dict[int, bytes], fetched: Mapping[tuple, bytes]):
        self.levels, level = [], 0
        while n > 1:
            beside, up = {}, {}
            for parent in {pos // ARITY for pos in held}:
                places = range(parent * ARITY, min(n, (parent + 1) * ARITY))
                run = [held[p] if p in held else fetched[(tree, level, p)] for p in places]
                for i, p in enumerate(places):
                    if p in held:
                        beside[p] = (b"".join(run[:i]), b"".join(run[i + 1:]))
                up[parent] = digest(*run)
            self.levels.append(beside)
            held, n, level = up, above(n), level + 1
        self.top = held[0]

    def path(self, pos: int) -> Iterator[tuple[bytes, bytes]]:
        for beside in self.levels:
            yield beside[pos]
            pos //= ARITY


def _prove(leaves: pa.Table, fetched: pa.Table, n_groups: int) -> pa.Table:
    """The proofs of the leaves of a partition, from its leaves and the nodes fetched for it."""
    known = {(r["tree"], r["level"], r["pos"]): r["digest"] for r in fetched.to_pylist()}
    trees = list(_trees(leaves))
    lower = {tree: _Climb(tree, n, {r["pos"]: r["leaf"].hex().encode() for r in rows}, known) for tree, n, rows in trees}
    upper = _Climb(UPPER, n_groups, {tree: c.top for tree, c in lower.items()}, known)
    keys, out = [], []
    for tree, _, rows in trees:
        climb, shared = lower[tree], list(upper.path(tree))
        rest = b"".join(a + b for a, b in shared)
        tails: dict[int, tuple[list, bytes]] = {}      # what the leaves of one lowest node have in common
        for r in rows:
            parent = r["pos"] // ARITY
            if parent not in tails:
                steps = list(climb.path(r["pos"]))[1:]
                tails[parent] = steps + shared, b"".join(a + b for a, b in steps) + rest
            steps, tail = tails[parent]
            own = [climb.levels[0][r["pos"]]] if climb.levels else []
            told = r["leaf"].hex()
            at = (r["seen"] or r["leaf"]).hex().encode()
            for before, after in own + (steps if climb.levels else shared):
                at = digest(before, at, after)
            keys.append(r["key"])
            out.append((told, climb.top.decode(), upper.top.decode(),
                        sha256(b"".join(a + b for a, b in own) + (tail if climb.levels else rest)).hexdigest(), at.decode(), at == upper.top))
    cols = list(zip(*out)) if out else [()] * 6
    return pa.table([pa.array(keys, leaves.schema.field("key").type)] + [pa.array(c, pa.bool_() if i == 5 else pa.string()) for i, c in enumerate(cols)],
                    names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def prove_manifest(rows: DataFrame, key: str = "file", fields: tuple[str, ...] = ("file", "card_key", "set_id", "split", "tier", "source"),
                   group: str = "source", found: Mapping[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every manifest row.

    ``leaf`` is the digest of ``fields``; the leaves of a ``group`` stand in the order of ``key`` (NULL first; ties by
    digest) and every ``ARITY`` neighbours, the last fewer, become one node until one is left: ``subroot``.
    The subroots in the order of their groups (NULL first, by bytes) become ``root`` in the same way.
    ``proof_sha256`` is the digest of the siblings on a leaf's way to the root, from below, left to right. ``found`` gives
    fields as an audit finds them: ``folded_root`` is the root that the row as found and the recorded siblings
    give, ``verified`` whether it is ``root``.

    Rows equal in all fields are leaves each; a NULL key or group is a value like any other; an empty table gives
    no rows. Texts are read once, where they lie; digests are shuffled. A group of any size is
    cut into runs of ``ARITY ** depth`` leaves (small groups share a run of at most twice as many); the nodes
    fetched for a run are at most a few per level."""
    run = ARITY ** depth
    cols = {c: F.col(c) for c in fields}
    leaf = F.unhex(leaf_digest(cols.values()))
    changed = [c for c in fields if c in (found or {})]
    seen = F.lit(None).cast("binary")
    if changed:
        differs = F.lit(False)
        for c in changed:
            differs = differs | ~cols[c].eqNullSafe(found[c])
        seen = F.when(differs, F.unhex(leaf_digest({**cols, **found}[c] for c in fields)))
    told = stage(rows.select(F.col(key).alias("key"), F.col(group).cast("string").alias("group"), leaf.alias("leaf"), seen.alias("seen")), "leaves")
    # The number of a stored row parts rows that are equal in all else.
    placed = ranked(told.withColumn("row", F.monotonically_increasing_id()), "group", "key", "leaf", "row", name="at")
    groups = stage(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "groups")
    n_groups = groups.count()
    groups = stage(ranked(groups, "group", name="tree").withColumn("group", key_of(F.col("group"))), "ordered")
    leaves = placed.withColumn("group", key_of(F.col("group"))).join(small(groups), "group").withColumn("pos", F.col("at") - F.col("first"))
    large = F.col("n") > run
    leaves = leaves.select("key", "leaf", "seen", "tree", "n", "pos", F.when(large, F.col("tree")).otherwise(F.lit(-1)).cast("long").alias("p1"),
                           F.floor(F.when(large, F.col("pos")).otherwise(F.col("first")) / run).alias("p2"))

    tops = stage(leaves.drop("key", "seen").groupBy("p1", "p2").applyInArrow(lambda t: _top(t, depth), _NODE + ", p1 long, p2 long"), "tops")
    lower = stage(grow(tops.filter("n > 1").drop("p1", "p2"), depth), "lower")
    subroots = tops.drop("p1", "p2").unionByName(lower).filter("n = 1").select(
        F.lit(UPPER).cast("long").alias("tree"), F.lit(0).alias("level"), F.lit(n_groups).cast("long").alias("n"), F.col("tree").alias("pos"), "digest")
    nodes = small(stage(lower.unionByName(grow(stage(subroots, "subroots"), depth)).drop("n"), "nodes"))
    wanted = tops.groupBy("p1", "p2").applyInArrow(lambda t: _wanted(t, n_groups), "p1 long, p2 long, tree long, level int, pos long")
    fetched = wanted.join(nodes, ["tree", "level", "pos"])

    kind = rows.schema[key].dataType.simpleString()
    return leaves.groupBy("p1", "p2").cogroup(fetched.groupBy("p1", "p2")).applyInArrow(
        lambda a, b: _prove(a, b, n_groups), f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
