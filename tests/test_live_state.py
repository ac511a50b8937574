"""Keyed state of live sessions: several micro-batches, a restart from the checkpoint, state that follows what is touched."""

import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest

from cardloom.streaming import live

START = datetime(2024, 5, 1, 12)
FRAMES = "session_id long, frame_id long, ts timestamp, kind string, identity_key string, confidence double, code string, format_ok boolean"


def plain(rows):
    """The event log of frames in order, with a session's rows in one list."""
    out, sessions = {}, {}
    for s, i, ts, kind, key, conf, code, ok in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        at = (ts - START).total_seconds()
        if s not in sessions or at > sessions[s]["until"]:
            sessions[s] = {"rows": [], "code": None}
        x = sessions[s]
        x["until"] = at + live.SESSION_TTL
        votes = {}
        for r in x["rows"]:
            if r["ok"] and r["key"] and r["key"].split(":")[0]:
                votes[r["key"].split(":")[0]] = votes.get(r["key"].split(":")[0], 0) + 1
        prior = max(votes, key=votes.get) if votes else None
        event, at_row, shown = "card", None, conf
        if kind == "code":
            event, shown = "code_card", None
            x["code"] = code if ok or x["code"] is None else x["code"]
        elif kind == "replace":
            event, shown, at_row = "marked", None, len(x["rows"]) - 1 if x["rows"] else None
            if x["rows"]:
                x["rows"][-1]["rep"] = True
        else:
            same = [j for j, r in enumerate(x["rows"]) if key is not None and not r["rep"] and r["key"] == key]
            old = max(same, key=lambda j: x["rows"][j]["at"]) if same else None
            fresh = {"key": key, "at": at, "conf": conf, "ok": not same, "rep": False}
            free = [j for j, r in enumerate(x["rows"]) if r["rep"] and r["key"] == key]
            if same and at - x["rows"][old]["at"] <= live.DUP_WINDOW:
                x["rows"][old]["conf"] = shown = max(x["rows"][old]["conf"], conf)
                at_row = old
            elif not same and free:
                at_row = free[0]
                x["rows"][at_row] = fresh
            else:
                event, at_row = "duplicate_prompt" if same else "card", len(x["rows"])
                x["rows"].append(fresh)
        out[s, i] = (event, at_row, shown, prior, x["code"])
    return out


def _frames(rng, n, sessions=3):
    rows, at = [], START
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0.5, 1, 3, 60, 1900 if i % 50 == 49 else 2]))
        kind = rng.choice(["card"] * 6 + ["replace", "code"])
        rows.append((rng.randrange(sessions), i, at, kind, rng.choice([None, "a:1", "a:2", "b:1", ":x"]), rng.randrange(100) / 100, f"C{i}", rng.random() < .4))
    return rows


def _write(spark, folder, batches):
    for b in batches:
        spark.createDataFrame(b, FRAMES).coalesce(1).write.mode("append").parquet(str(folder))


def _read(spark, folder):
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _log(rows):
    return {(r["session_id"], r["frame_id"]): (r["event"], r["row_index"], r["confidence"], r["prior_set"], r["code"]) for r in rows}


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)


def test_steps_equal_the_plain_list(spark):
    rows = _frames(random.Random(1), 1500)
    got, sessions = {}, {}
    for s, i, ts, kind, key, conf, code, ok in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        at = (ts - START).total_seconds()
        if s not in sessions or at > sessions[s].expires:
            sessions[s] = live.Session()
        sessions[s].expires = at + live.SESSION_TTL
        prior = sessions[s].modal()
        got[s, i] = (*live.step(sessions[s], SimpleNamespace(at=at, kind=kind, identity_key=key, confidence=conf, code=code, format_ok=ok)), prior, sessions[s].code)
    assert got == {k: (e, r, c, p, code) for k, (e, r, c, p, code) in plain(rows).items()}


def test_micro_batches_and_a_restart_give_the_same_log(spark, tmp_path):
    rows = sorted(_frames(random.Random(2), 240), key=lambda r: r[2])
    folder, out, check = tmp_path / "frames", str(tmp_path / "out"), str(tmp_path / "check")

    def drain():
        live.live_sessions(_read(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check) \
            .trigger(availableNow=True).start().awaitTermination()
    _write(spark, folder, [rows[i:i + 40] for i in range(0, 120, 40)])
    drain()                                             # this query ends; the next one starts from its checkpoint
    _write(spark, folder, [rows[i:i + 40] for i in range(120, 240, 40)])
    drain()
    assert _log(spark.read.parquet(out).collect()) == plain(rows)


def test_state_written_follows_what_frames_touch():
    """A frame in a session of a thousand rows stores one identity, not the session."""
    stored = {}
    for n in (10, 1000):
        session = live.Session(lambda key: json.loads(stored.get(key, "[]")))
        for i in range(n):
            live.step(session, SimpleNamespace(at=10.0 * i, kind="card", identity_key=f"s:{i}", confidence=.5, code=None, format_ok=False))
        stored = {k: json.dumps(session.rows[k]) for k in session.changed}
        again = live.Session(lambda key: json.loads(stored.get(key, "[]")))
        again.n_rows, again.last, again.votes = session.n_rows, session.last, session.votes
        assert live.step(again, SimpleNamespace(at=10.0 * n, kind="card", identity_key="s:3", confidence=.9, code=None, format_ok=False))[0] == "duplicate_prompt"
        assert again.changed == {"=s:3"} and len(json.dumps(again.rows["=s:3"])) < 100 and set(again.rows) == {"=s:3"}


def test_timers_drop_ended_sessions(spark, tmp_path):
    rows = [(1, 0, START, "card", "a:1", .5, None, False), (2, 1, START + timedelta(hours=2), "card", "a:1", .6, None, False),
            (2, 2, START + timedelta(hours=4), "card", "a:1", .7, None, False), (2, 3, START + timedelta(hours=4, seconds=1), "card", "a:1", .8, None, False)]
    _write(spark, tmp_path / "frames", [[r] for r in rows])
    query = live.live_sessions(_read(spark, tmp_path / "frames"), expire_state=True).writeStream.format("memory").queryName("ended") \
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert _log(spark.table("ended").collect()) == plain(rows)
    left = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]
    assert left[-1] <= left[0] + 1          # session 1 has left; session 2 holds what one row needs
