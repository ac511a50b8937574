"""Append mode with late frames, update mode into a keyed sink: counts, replays, several micro-batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cardloom.streaming import live

START = datetime(2024, 5, 1, 12)
FRAMES = "session_id long, ts timestamp, confidence double"


def _files(spark, folder, batches):
    """One file a micro-batch, in order of their times."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(s, START + timedelta(minutes=m), c) for s, m, c in rows], FRAMES).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_frames_are_counted_and_closed_sessions_leave_the_state(spark, tmp_path):
    batches = [[(1, 0, .5), (1, 5, .9), (2, 3, .4)],
               [(3, 200, .1)],                                     # the watermark is now at 190 minutes
               [(3, 201, .2)],                                     # and from the next batch on, what comes behind it is late
               [(1, 10, .99), (2, 100, .8), (3, 205, .7)],         # two late frames
               [(4, 400, .3)]]
    sessions, progress = live.closed_sessions(_files(spark, tmp_path / "frames", batches))
    assert sorted(map(tuple, sessions.select("session_id", "frames", "best").collect())) == [(1, 2, .9), (2, 1, .4), (3, 3, .7)]
    assert (progress.rows, progress.dropped, progress.state_rows) == (9, 2, 1)      # session 4 is open


def test_frames_within_the_watermark_are_not_late(spark, tmp_path):
    sessions, progress = live.closed_sessions(_files(spark, tmp_path / "frames", [[(1, 0, .5)], [(1, 20, .6)], [(1, 12, .9)], [(2, 500, .1)]]))
    assert [tuple(r) for r in sessions.select("session_id", "frames", "best").collect()] == [(1, 3, .9)] and progress.dropped == 0


def test_update_mode_equals_the_batch_over_several_batches(spark, tmp_path):
    batches = [[(s, m + 7 * b, (s * m + b) % 10 / 10) for s in range(5) if (s + b) % 3 for m in range(3)] for b in range(7)]
    frames = _files(spark, tmp_path / "frames", batches)
    codes = lambda f: f.select("session_id", F.concat(F.lit("C"), F.minute("ts")).alias("code"), (F.col("confidence") > .5).alias("format_ok"), "ts",
                               F.unix_micros(F.col("ts")).alias("frame_id"))
    want = sorted(map(tuple, live.best_code(codes(spark.read.schema(FRAMES).parquet(str(tmp_path / "frames")))).collect()))
    for compact in (2, 16):
        assert sorted(map(tuple, live.keyed_state(live.best_code(codes(frames)), "codes", ["session_id"], compact).collect())) == want


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    sink = live.KeyedSink(f"file://{tmp_path}/sink", ["k"], compact=2)
    rows = [spark.createDataFrame(r, "k string, v long") for r in ([("a", 1), ("b", 1), (None, 1)], [("a", 2)], [("b", 3), (None, 3)])]
    for again in (False, True):
        for i, batch in enumerate(rows):
            sink.put(batch, i)
            if again:
                sink.put(batch, i)
        assert sorted(map(tuple, sink.read(spark, rows[0].schema).collect()), key=str) == sorted([("a", 2), ("b", 3), (None, 3)], key=str)
    # A batch writes its own changes only.
    assert spark.read.parquet(f"{tmp_path}/sink/changes/batch=1").count() == 1
