import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.errors import PySparkException

from cardloom.llm import dialogue_trie

TURNS, SPLICES = "pull_id string, row_index long, role string, text string, base_id string", "pull_id string, base_id string, n_head long, role string"


def rebuilt(turns, splices):
    """pull_id -> [(role, text)], from texts as they stand."""
    stored = defaultdict(list)
    for pull, index, role, text, _ in turns:
        if pull is not None:
            stored[pull].append((index is not None, index or 0, role or "", text or ""))
    stored = {p: [(r, t) for _, _, r, t in sorted(rows)] for p, rows in stored.items()}
    asked = {}
    for pull, base, head, _ in sorted(splices, key=lambda s: (s[1] is not None, s[1] or "", s[2] or 0)):
        asked.setdefault(pull, (base, head or 0))
    return {p: stored.get(b, [])[:h] + stored.get(p, [])[h:] for p, (b, h) in asked.items() if p is not None}


def brute(turns, splices):
    paths = rebuilt(turns, splices)
    members = defaultdict(list)
    for p, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(p)
    out = []
    for node, of in members.items():
        under = [m for m in members if m[:len(node)] == node]
        kids = [m for m in members if m[:-1] == node and m]
        ends = ",".join(p for p in of if len(paths[p]) == len(node))
        out.append((of[0], len(node), members[node[:-1]][0] if node else None, len(of), len(kids),
                    sum(1 for m in under if not any(k[:-1] == m for k in members if k)),
                    sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m), sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def check(spark, turns, splices):
    got = dialogue_trie.prefix_trie(spark.createDataFrame(turns, TURNS), spark.createDataFrame(splices, SPLICES)).collect()
    assert sorted((tuple(r)[:8] for r in got), key=lambda r: (r[1], r[0])) == brute(turns, splices)
    stored = rebuilt(turns, [(t[0], None, 0, None) for t in turns])
    paths = rebuilt(turns, splices)
    for r in got:   # a node's reference is a stored turn that equals its last one
        if r["depth"]:
            assert stored[r["ref_pull_id"]][r["ref_at"] - 1] == paths[r["pull_id"]][r["depth"] - 1]
        else:
            assert r["ref_pull_id"] is None


@pytest.mark.parametrize("tile", [4096, 2])
def test_nodes_are_those_of_rebuilt_texts(spark, monkeypatch, tile):
    monkeypatch.setattr(dialogue_trie, "TILE", tile)
    monkeypatch.setattr(dialogue_trie, "BLOCK", tile)
    rng, turns, splices = random.Random(tile), [], []
    for i in range(40):
        for _ in range(rng.randrange(7)):
            turns.append((f"p{i}", rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", None, ""]), rng.choice(["ü", "a", "b", None]), "clash"))
        splices.append((f"p{i}", rng.choice([f"p{i - i % 5}", None, "gone"]), rng.choice([0, 1, 2, 9, None]), "clash"))
    turns += turns[:3] + [(None, 1, "user", "nobody's", "")] * 3
    splices += [splices[4], ("absent", "p3", 2, ""), (None, "p3", 2, "")]
    check(spark, turns, splices)


def test_copies_and_a_long_dialogue(spark, monkeypatch):
    monkeypatch.setattr(dialogue_trie, "TILE", 16)
    monkeypatch.setattr(dialogue_trie, "BLOCK", 8)
    turns = [(f"copy{i:02}", j, "user", f"line {j}", "") for i in range(30) for j in range(3)]
    turns += [("long", j, "user", f"line {j % 3}", "") for j in range(90)]
    check(spark, turns, [(f"copy{i:02}", "long", i % 3, "") for i in range(30)] + [("long", "copy00", 2, ""), ("ü", None, None, "")])


def test_empty_tables(spark):
    turns, splices = spark.createDataFrame([], TURNS), spark.createDataFrame([], SPLICES)
    assert dialogue_trie.prefix_trie(turns, splices).collect() == []
    assert [tuple(r)[:6] for r in dialogue_trie.prefix_trie(turns, spark.createDataFrame([("a", "b", 3, "")], SPLICES)).collect()] == [("a", 0, None, 1, 0, 1)]


def test_fingerprints_compose():
    turns = [random.Random(i).randrange(1 << 60) for i in range(20)]
    g = lambda xs: sum(x * dialogue_trie.powers(i)[0] for i, x in enumerate(xs, 1)) % dialogue_trie.PRIME
    head, own, h = turns[:4], turns[4:], 7
    for j in range(h, len(own)):
        assert g(head + own[h:j]) == (g(head) + dialogue_trie.powers(4 - h)[0] * (g(own[:j]) - g(own[:h]))) % dialogue_trie.PRIME


def test_unequal_turns_under_one_fingerprint_are_told(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1, 5, 5, 0, 0, 1, 1, 1, "a", 1, True), ("b", 1, 5, 5, 0, 0, 2, 1, 1, "b", 1, True)],
                                 "pull_id string, depth long, g1 long, g2 long, p1 long, p2 long, d1 long, d2 long, n_bytes long, ref_pull_id string, ref_at long, last boolean")
    monkeypatch.setattr(dialogue_trie, "rebuilt_prefixes", lambda *a: rows)
    with pytest.raises(PySparkException, match="unequal turns"):
        dialogue_trie.prefix_trie(spark.createDataFrame([], TURNS), spark.createDataFrame([], SPLICES)).collect()
