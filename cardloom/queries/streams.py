"""Streaming operators, drained over the events and orders tables, and batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import claims, stats
from cardloom.plans.session import fresh_folder
from cardloom.plans.skew import ordinal
from cardloom.queries.registry import query
from cardloom.sources.snapshots import read_snapshot, write_snapshot
from cardloom.sources.standins import _FRAME, _PULL_BASE
from cardloom.streaming import live


def frame_stream(t):
    return t.spark.sql(_FRAME, events=live.read_table_stream(t.spark, t.folder, "events"))


def marked(frames):
    """Frames with control events, codes and missing identities mixed in."""
    i = F.col("frame_id")
    return frames.withColumns({
        "kind": F.when(i % 17 == 0, "replace").when(i % 11 == 0, "code").otherwise("card"),
        "identity_key": F.when(i % 13 != 0, F.col("identity_key")),
        "code": F.concat(F.lit("CODE"), (i % 100).cast("string")), "format_ok": i % 3 == 0})


_SESS = """j AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL {gap} THEN 1 ELSE 0 END AS j FROM frame WINDOW w AS (PARTITION BY session_id ORDER BY ts, frame_id)),
s AS (SELECT *, sum(j) OVER (PARTITION BY session_id ORDER BY ts, frame_id) AS k FROM j)"""


@query("I1", "session_rollup", f"WITH {_SESS.format(gap='30 MINUTE')} SELECT session_id, min(ts) AS started, count(*) AS frames, max(confidence) AS best FROM s GROUP BY session_id, k")
def _rollup(t):
    return live.last_state(live.session_rollup(frame_stream(t), watermark=None), "rollup")


@query("I1", "session_rollup_closed", f"""WITH {_SESS.format(gap='30 MINUTE')}, e AS (SELECT session_id, min(ts) AS started, count(*) AS frames, max(confidence) AS best, max(ts) AS last FROM s GROUP BY session_id, k)
SELECT session_id, started, frames, best FROM e WHERE last + INTERVAL 30 MINUTE <= date_trunc('millisecond', (SELECT max(ts) FROM frame)) - INTERVAL 10 MINUTE""")
def _closed(t):
    """Append mode: sessions that ended by the watermark."""
    return live.closed_sessions(frame_stream(t))[0]


@query("I1", "session_rollup_12h", f"WITH {_SESS.format(gap='12 HOUR')} SELECT session_id, min(ts) AS started, count(*) AS frames, max(confidence) AS best FROM s GROUP BY session_id, k")
def _rollup12(t):
    return live.session_rollup(t.frames, "12 hours")


# The session rules spelled out: sessions in step, one frame after the other, rows in a list.
_ROW = "STRUCT(k VARCHAR, a DOUBLE, c DOUBLE, ok BOOLEAN, rep BOOLEAN)"
_LIVE = f"""f AS (SELECT session_id, frame_id, epoch_us(ts) / 1e6 AS a, confidence AS c, CASE WHEN frame_id % 17 = 0 THEN 'replace' WHEN frame_id % 11 = 0 THEN 'code' ELSE 'card' END AS kind,
   CASE WHEN frame_id % 13 <> 0 THEN identity_key END AS k, row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) AS n FROM frame),
st AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame_id, CAST(NULL AS DOUBLE) AS until, CAST([] AS {_ROW}[]) AS r, CAST(NULL AS VARCHAR) AS event,
   CAST(NULL AS BIGINT) AS at_row, CAST(NULL AS DOUBLE) AS shown, CAST(NULL AS VARCHAR) AS prior FROM f
 UNION ALL SELECT session_id, n, frame_id, a + 1800, CASE WHEN kind = 'code' THEN r WHEN kind = 'replace' THEN list_transform(r, lambda x, i: CAST({{'k': x.k, 'a': x.a, 'c': x.c, 'ok': x.ok, 'rep': x.rep OR i = len(r)}} AS {_ROW}))
     WHEN near THEN list_transform(r, lambda x, i: CAST({{'k': x.k, 'a': x.a, 'c': CASE WHEN i = old THEN greatest(x.c, c) ELSE x.c END, 'ok': x.ok, 'rep': x.rep}} AS {_ROW}))
     WHEN over IS NOT NULL THEN list_transform(r, lambda x, i: CASE WHEN i = over THEN fresh ELSE x END) ELSE list_append(r, fresh) END,
   CASE kind WHEN 'code' THEN 'code_card' WHEN 'replace' THEN 'marked' ELSE CASE WHEN old IS NOT NULL AND NOT near THEN 'duplicate_prompt' ELSE 'card' END END,
   CASE WHEN kind = 'code' THEN NULL WHEN kind = 'replace' THEN nullif(len(r), 0) WHEN near THEN old WHEN over IS NOT NULL THEN over ELSE len(r) + 1 END - 1,
   CASE WHEN kind <> 'card' THEN NULL WHEN near THEN greatest(r[old].c, c) ELSE c END, prior
  FROM (SELECT *, CAST({{'k': k, 'a': a, 'c': c, 'ok': old IS NULL, 'rep': FALSE}} AS {_ROW}) AS fresh, coalesce(a - r[old].a <= 2, FALSE) AS near,
     CASE WHEN old IS NULL AND kind = 'card' THEN list_filter(range(1, len(r) + 1), lambda i: r[i].rep AND r[i].k IS NOT DISTINCT FROM k)[1] END AS over,
     list_filter(sets, lambda x: len(list_filter(sets, lambda y: y = x)) = list_max(list_transform(sets, lambda z: len(list_filter(sets, lambda y: y = z)))))[1] AS prior FROM (
   SELECT *, list_filter(same, lambda i: r[i].a = list_max(list_transform(same, lambda j: r[j].a)))[1] AS old, list_transform(list_filter(r, lambda x: x.ok AND x.k IS NOT NULL), lambda x: split_part(x.k, ':', 1)) AS sets FROM (
   SELECT *, list_filter(range(1, len(r) + 1), lambda i: kind = 'card' AND k IS NOT NULL AND NOT r[i].rep AND r[i].k = k) AS same FROM (
   SELECT f.*, CASE WHEN st.until IS NULL OR f.a > st.until THEN [] ELSE st.r END AS r FROM st JOIN f ON f.session_id = st.session_id AND f.n = st.n + 1) z0) z1) z2) z3)"""


def _live(t, name):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    return live.run_to_table(live.live_sessions(marked(frame_stream(t))), name)


@query("I2", "dedup_frames", f"""WITH RECURSIVE {_LIVE} SELECT session_id, frame_id, event, CAST(at_row AS INT) AS row_index, shown AS confidence FROM st WHERE event IN ('card', 'duplicate_prompt')""")
def _dedup(t):
    return _live(t, "dedup").filter("event IN ('card', 'duplicate_prompt')").select(
        "session_id", "frame_id", "event", "row_index", "confidence")


@query("I3", "replace_row", f"""WITH RECURSIVE {_LIVE} SELECT session_id, CAST(at_row AS INT) AS row_index, count(*) FILTER (WHERE event = 'card') AS writes, count(*) FILTER (WHERE event = 'marked') AS marks
FROM st WHERE event IN ('card', 'marked') GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event = 'marked') > 0""")
def _replace(t):
    """Rows written more than once because the user marked them replaceable."""
    log = _live(t, "replace")
    return log.filter("event IN ('card', 'marked')").groupBy("session_id", "row_index").agg(
        F.count_if(F.col("event") == "card").alias("writes"), F.count_if(F.col("event") == "marked").alias("marks")).filter("marks > 0")


@query("I4", "running_session_prior", f"""WITH RECURSIVE {_LIVE} SELECT session_id, frame_id, prior AS prior_set FROM st WHERE event <> 'code_card'""")
def _prior(t):
    return _live(t, "prior").filter("event <> 'code_card'").select("session_id", "frame_id", "prior_set")


@query("I5", "best_code_so_far", """WITH c AS (SELECT session_id, frame_id, ts, 'CODE' || CAST(frame_id % 100 AS VARCHAR) AS code, frame_id % 3 = 0 AS ok FROM frame WHERE frame_id % 11 = 0 AND frame_id % 17 <> 0)
SELECT session_id, coalesce(arg_max(code, (ts, frame_id)) FILTER (WHERE ok), arg_min(code, (ts, frame_id))) AS code, bool_or(ok) AS format_ok FROM c GROUP BY 1""")
def _code(t):
    return live.keyed_state(live.best_code(marked(frame_stream(t)).filter("kind = 'code'")), "codes", ["session_id"])


@query("I7", "followup_progress", """WITH r AS (SELECT user_id AS scan_id, event_id % 9 AS row_index, CASE WHEN event_id % 4 = 0 THEN 'pending_vlm' ELSE 'ok' END AS state, event_id % 97 = 0 AS fin, ts, event_id FROM events),
l AS (SELECT scan_id, row_index, arg_max(state, (ts, event_id)) AS state, bool_or(fin) AS fin FROM r GROUP BY 1, 2)
SELECT scan_id, bool_or(state = 'pending_vlm') AS any_pending, bool_or(fin) AS done, count(*) AS rows FROM l GROUP BY 1""")
def _followup(t):
    e = live.read_table_stream(t.spark, t.folder, "events").select(
        F.col("user_id").alias("scan_id"), (F.col("event_id") % 9).alias("row_index"),
        F.when(F.col("event_id") % 4 == 0, "pending_vlm").otherwise("ok").alias("state"), (F.col("event_id") % 97 == 0).alias("finished"), "ts", "event_id")
    rows, scans = live.followup_rows(e), live.followup_scans
    return scans(live.keyed_state(rows, "followup", ["scan_id", "row_index"]))


@query("I8", "stage_progress", """SELECT user_id AS scan_id, arg_max(event_type, (ts, event_id)) AS stage, max(event_id % 9) AS done, CAST(9 AS INT) AS total FROM events GROUP BY 1""")
def _stages(t):
    """Run as a stream in update mode: each batch writes the scans that it changed."""
    e = live.read_table_stream(t.spark, t.folder, "events").select(
        F.col("user_id").alias("scan_id"), F.col("event_type").alias("stage"), (F.col("event_id") % 9).alias("done"),
        F.lit(9).alias("total"), "ts", "event_id")
    return live.keyed_state(live.stage_progress(e), "stages", ["scan_id"])


@query("I6", "debounced_batches", """SELECT frame_id, session_id, CASE WHEN confidence >= 0.7 THEN 'ok' ELSE 'vlm_failed' END AS state FROM frame WHERE needs_second_opinion""")
def _batches(t):
    pending = frame_stream(t).filter("needs_second_opinion")
    path, _ = live.debounced_batches(pending, lambda b: b.select(
        "frame_id", "session_id", F.when(F.col("confidence") >= 0.7, "ok").otherwise("vlm_failed").alias("state")), every=None)
    return t.spark.read.parquet(path).select("frame_id", "session_id", "state")


@query("I9", "incremental_stats", """WITH c AS (SELECT c.pull_id, set_id, row_index FROM pull_card c JOIN pull p ON c.pull_id = p.pull_id WHERE p.verified),
m AS (SELECT pull_id, set_id FROM (SELECT pull_id, set_id, row_number() OVER (PARTITION BY pull_id ORDER BY count(*) DESC, min(row_index), set_id) AS r FROM c GROUP BY 1, 2) x WHERE r = 1)
SELECT set_id, count(*) AS packs FROM m GROUP BY 1""")
def _incremental(t):
    """Stream new orders in; each batch verifies its own pulls against the codes claimed so far and
    adds its own set counts; publishing sums the batches' counts."""
    root = fresh_folder(t.spark, "incremental")
    cards = t.cards_unordered.withColumn("row_index", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))

    def derive(batch, batch_id):
        first = claims.first_valid_claim(batch.sparkSession.sql(_PULL_BASE, orders=batch)).select("pull_id", "code_normalized")
        if batch_id:
            before = t.spark.read.parquet(f"{root}/claimed").filter(F.col("batch") < batch_id)
            first = first.join(before.select("code_normalized"), "code_normalized", "left_anti")
        first.write.mode("overwrite").parquet(f"{root}/claimed/batch={batch_id}")
        fresh = t.spark.read.parquet(f"{root}/claimed/batch={batch_id}").select("pull_id")
        modal = stats.modal_set(cards.join(fresh, "pull_id", "left_semi"))
        stats.set_pack_counts(modal).write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")

    def publish():
        counts = t.spark.read.parquet(f"{root}/counts").groupBy("set_id").agg(F.sum("packs").alias("packs"))
        write_snapshot({"set_stat": counts}, root, 1, "2024-01-01 00:00:00", "stream")

    live.incremental_stats(live.read_table_stream(t.spark, t.folder, "orders"), derive, publish)
    return read_snapshot(t.spark, root, "set_stat").select("set_id", "packs")


@query("E14", "compact_index", """WITH s AS (SELECT session_id, frame_id, ts FROM frame WHERE NOT (frame_id % 5 = 0 AND frame_id % 3 <> 0))
SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) - 1 AS row_index FROM s""")
def _compact(t):
    """Drop unconfirmed duplicates and renumber in capture order."""
    kept = t.frames.filter("NOT (frame_id % 5 = 0 AND frame_id % 3 <> 0)")
    return ordinal(kept, ["session_id"], ["ts", "frame_id"], [F.date_trunc("hour", F.col("ts"))], "row_index", start=0).select(
        "session_id", "frame_id", "row_index")
