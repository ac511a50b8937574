"""Bucketed merges, log files and uploads as bytes."""

import os
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cardloom.operators import datasets
from cardloom.sources import logs, upserts
from cardloom.sources.keyed_table import KeyedTable

ROWS = "k long, s string, v long"


def _ignore(old, new):
    return upserts.upsert_ignore(old, new, ["k", "s"], ["v"])


def _newest(old, new):
    return new.unionByName(old.join(new.select("k"), "k", "left_anti"))


def _files(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{root}/files") for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_the_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=16).create(spark.range(4000).select(F.col("id").alias("k"), F.lit("old").alias("s"), F.lit(1).cast("long").alias("v")))
    first = _files(f"{tmp_path}/t")
    touched = table.merge(spark.createDataFrame([(7, "new", 2), (9999, "new", 3)], ROWS), _newest)
    fresh = {p: n for p, n in _files(f"{tmp_path}/t").items() if p not in first}
    assert len(fresh) == len(touched) <= 2
    assert sum(fresh.values()) < 0.3 * sum(first.values())
    got = {r["k"]: (r["s"], r["v"]) for r in table.read().collect()}
    assert len(got) == 4001 and got[7] == ("new", 2) and got[9999] == ("new", 3) and got[8] == ("old", 1)
    assert set(r["k"] for r in table.read(touched).collect()) < set(got)


def test_a_reader_never_sees_half_a_merge(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=4).create(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], ROWS))
    reader = table.read()

    def dies(old, new):
        return new.select("k", "s", F.raise_error(F.lit("worker lost")).cast("long").alias("v"))
    with pytest.raises(Exception, match="worker lost"):
        table.merge(spark.createDataFrame([(1, "x", 5), (2, "x", 5), (3, "x", 5)], ROWS), dies)
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "b", 1)]
    table.merge(spark.createDataFrame([(1, "y", 6), (3, "y", 6)], ROWS), _newest)
    assert sorted(map(tuple, table.read().collect())) == [(1, "y", 6), (2, "b", 1), (3, "y", 6)]
    assert sorted(map(tuple, reader.collect())) == [(1, "a", 1), (2, "b", 1)]       # the version it opened


def test_merges_of_nothing_and_into_nothing(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    table = KeyedTable(spark, f"{tmp_path}/t", ["k", "s"], buckets=4).create(none)
    assert table.read().collect() == [] and table.merge(none, _ignore) == []
    table.merge(spark.createDataFrame([(1, "a", 1), (None, "a", 2), (1, "a", 3)], ROWS), _ignore)
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1)]


def test_lines_of_log_files(spark, tmp_path):
    told = {"a.log": "INFO timing.pack.ocr scan=s1 ms=12.5 cold=1\nnot a timing\n\nINFO timing.pack.match scan=s1 ms=3\n", "b.log": "", "c.log": "INFO timing.pack.ocr scan=s2 ms=x"}
    for name, text in told.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "d.log").write_bytes(b"\xff\xfe broken\nINFO timing.live.code scan=\xc3\xbc ms=1.25")
    rows = logs.read_lines(spark, str(tmp_path))
    assert {(os.path.basename(r["file"]), r["line"], r["value"]) for r in rows.filter("file NOT LIKE '%d.log'").collect()} == {
        (n, i, x) for n, t in told.items() for i, x in enumerate(t.splitlines(), 1)}
    got = {(r["flow"], r["stage"], r["scan"], r["ms"], r["line"]) for r in logs.parse_timing(rows).collect()}
    assert got == {("pack", "ocr", "s1", 12.5, 1), ("pack", "match", "s1", 3.0, 4), ("live", "code", "ü", 1.25, 2)}


def test_lines_are_numbered_over_the_pieces_of_a_long_file(spark, tmp_path):
    (tmp_path / "long.log").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = logs.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        assert rows.filter(F.split("value", " ")[1].cast("long") != F.col("line")).count() == 0 and rows.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_identical_uploads_share_one_reading(spark, tmp_path):
    for name, data in {"a.jpg": b"\x00\xff" * 1000, "b.jpg": b"\x00\xff" * 1000, "c.jpg": b"", "d.jpg": b"", "e.jpg": b"x", "note.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r["path"]): (os.path.basename(r["reading_of"]), r["copies"], r["digest"])
           for r in datasets.content_dedup(datasets.read_uploads(spark, str(tmp_path), "*.jpg"), "content", "path").collect()}
    assert {n: v[:2] for n, v in got.items()} == {"a.jpg": ("a.jpg", 2), "b.jpg": ("a.jpg", 2), "e.jpg": ("e.jpg", 1)}     # empty files hold nothing
    assert got["e.jpg"][2] == sha256(b"x").hexdigest()
