import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cardloom.llm import merkle

ROWS = "file string, card_key string, set_id string, split string, tier string, source string, source_ string"


def _h(text):
    return sha256(text.encode()).hexdigest()


def _leaf(values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(leaves):
    """(root, per leaf its siblings as (before, after) from below), written out level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 3 * 3:p // 3 * 3 + 3]
            paths[i].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        level = [_h("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], paths


def brute(rows, found):
    """rows: (group, key, values), found: values by position; returns the sorted result rows."""
    groups = {}
    for i, (group, key, values) in enumerate(rows):
        groups.setdefault(group, []).append((key is not None, key or "", _leaf(values), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, upper = _tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, upper):
        for (_, _, leaf, i), path in zip(sorted(groups[g]), trees[g][1]):
            at = _leaf(found[i])
            for before, after in path + up:
                at = _h(before + at + after)
            out.append((rows[i][1], leaf, trees[g][0], root, _h("".join(a + b for a, b in path + up)), at, at == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes,depth", [([1], 7), ([1, 1], 7), ([40, 3, 1, 9], 2), ([100, 28, 27, 2, 2, 1, 1, 1], 1), ([5] * 30 + [81], 2)])
def test_proofs_are_those_of_the_written_out_trees(spark, sizes, depth):
    rng, rows = random.Random(len(sizes)), []
    for g, n in enumerate(sizes):
        source = None if g == 1 else f"ß{g}" if g % 2 else f"s{g}"
        for i in range(n):
            file = None if rng.random() < .1 else f"strips/{rng.randrange(60)}.jpg"
            rows.append((file, rng.choice([None, "", "sv06-045", "a\nb", "ü\n" * 50]), "sv06", "train", None, source, "clash"))
    rows += rows[:2]
    rng.shuffle(rows)
    found = {"card_key": F.replace("card_key", F.lit("\n"), F.lit(""))}
    got = merkle.prove_manifest(spark.createDataFrame(rows, ROWS), found=found, depth=depth).collect()
    want = brute([(r[5], r[0], r[:6]) for r in rows], [(r[0], r[1] and r[1].replace("\n", ""), *r[2:6]) for r in rows])
    assert sorted(map(tuple, got), key=str) == want
    assert {r["verified"] for r in got} == {True, False} or sizes == [1] or len(rows) < 10


def test_octopus_asks_for_no_node_twice_and_for_none_it_can_derive():
    for n in range(1, 60):
        for held in ({0}, {n - 1}, set(range(n)), set(range(0, n, 4)), set(range(n // 3, 2 * n // 3 + 1))):
            held = {p for p in held if p < n}
            asked = list(merkle.missing(held, n))
            assert len(asked) == len(set(asked))
            have, size, level = set(held), n, 0
            while size > 1:     # with what is asked for, every parent of what is held can be made
                got = have | {p for l, p in asked if l == level}
                assert not have & {p for l, p in asked if l == level}
                up = {p // 3 for p in have}
                assert all(c in got for u in up for c in range(u * 3, min(size, u * 3 + 3)))
                assert got == {c for u in up for c in range(u * 3, min(size, u * 3 + 3))}
                have, size, level = up, -(-size // 3), level + 1


def test_empty_manifest(spark):
    assert merkle.prove_manifest(spark.createDataFrame([], ROWS)).collect() == []


def test_nothing_found_changed_is_all_verified(spark):
    rows = [(f"f{i}", None, "x", "train", None, "one source", "") for i in range(2500)]
    got = merkle.prove_manifest(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 2500 and all(r["verified"] for r in got) and len({r["root"] for r in got}) == 1
