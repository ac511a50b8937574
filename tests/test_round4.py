"""Steps whose memory, reads or time must not grow faster than the input."""

import pandas as pd

from cardloom.operators import fuzzy, vectors
from cardloom.plans import session
from cardloom.plans.session import stage
from cardloom.streaming.live import LiveSession


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_names_are_not_broadcast(spark):
    """A staged file of names is small, its grams and splits are not: no side of the blocking joins is sent whole."""
    q = stage(spark.createDataFrame([("hot bolt", "S01"), ("ring", "S02")], "q string, scope string"))
    k = stage(spark.createDataFrame([("hot bolts", "S01"), ("large ring", "S02")], "key string, scope string"))
    x, y = q.withColumnRenamed("q", "x"), k.withColumnRenamed("key", "y")
    for met in (fuzzy.window_pairs(x, y, 80 / 0.9, ["scope"]), fuzzy.covering_pairs(x, y, 80 / 0.95, ["scope"]), fuzzy.split_pairs(q, k, 80 / 0.95, ["scope"]),
                fuzzy.candidate_pairs(q, k, 80.0, ["scope"]), fuzzy.token_pairs(q, k, 80.0, ["scope"]), fuzzy.hazard_keys(k.select("key"))):
        assert "BroadcastHashJoin" not in _plan(met)
        met.collect()


class _State:
    """A state variable in memory that counts what is asked of it."""

    def __init__(self, calls):
        self.value, self.map, self.calls = None, {}, calls

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "clear":
                self.value, self.map = None, {}
            elif name == "update":
                self.value = args[0]
            elif name == "updateValue":
                self.map[args[0]] = args[1]
            return {"exists": self.value is not None, "get": self.value, "containsKey": args[:1] and args[0] in self.map,
                    "getValue": self.map.get(args[0]) if args else None, "iterator": iter(list(self.map.items()))}.get(name)
        return call


def test_sessions_that_end_inside_a_batch_cost_no_state_calls():
    calls, live = [], LiveSession()
    live.meta, live.rows, live.votes = _State(calls), _State(calls), _State(calls)

    def frames(first, n):
        return pd.DataFrame([(i, i * 3600.0, "card", f"S{i}:1", 0.5, None, False) for i in range(first, first + n)],
                            columns=["frame_id", "at", "kind", "identity_key", "confidence", "code", "format_ok"])
    out = pd.concat(live.handleInputRows((1,), iter([frames(0, 50)]), None))
    assert len(calls) < 10 and list(out["row_index"]) == [0] * 50 and out["prior_set"].isna().all()
    # The stored session has ended before the next batch: all of it goes, once.
    calls.clear()
    list(live.handleInputRows((1,), iter([frames(50, 50)]), None))
    assert calls.count("clear") == 3 and list(live.rows.map) == [("=S99:1",)] and list(live.votes.map) == [("S99",)]


def test_partitions_grow_with_the_input(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(session, "PARTITION", 1024)
    assert session.folder_bytes(spark, folder) > 0 and session.folder_bytes(spark, folder + "/none") == 0
    try:
        session.tune(spark, folder)
        assert int(spark.conf.get(session._INITIAL)) == session.folder_bytes(spark, folder) // 1024
        assert int(spark.conf.get(session._SPLIT).rstrip("b")) <= session.SPLIT
    finally:
        session.tune(spark)
    assert spark.conf.get(session._INITIAL, None) is None


def test_probes_are_dealt_out_and_not_broadcast(spark, monkeypatch):
    """A small file of queries makes many probes: it is dealt by their number first, and no side of the probing join is sent whole."""
    plans, real = [], vectors.stage
    monkeypatch.setattr(vectors, "stage", lambda df, name="stage": (plans.append(_plan(df)) if name == "probed" else None, real(df, name))[1])
    monkeypatch.setattr(vectors, "PROBES", 1000, raising=False)
    asked = real(spark.range(500).selectExpr("id AS query_id", "'s' AS set_id", "xxhash64(id) AS hash"))
    refs = real(spark.range(1000).selectExpr("'s' AS set_id", "id AS ref_id", "xxhash64(id + 7) AS hash"))
    found, open_ = vectors.probe_segments(asked, refs, cost=1)
    assert found.count() + open_.count() == 500 and len(plans) == 3
    # 4, 64 and 480 probes a query; what the first two rounds found asks no more.
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans) and "RepartitionByExpression" not in plans[0]
    assert "hashpartitioning(query_id" in plans[0] and ", 2)" in plans[0].replace("REPARTITION_BY_NUM", "")


def test_merged_partitions_stay_small(spark):
    """Adaptive execution merges shuffle partitions up to ``PARTITION`` bytes; a smaller setting stays."""
    first = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    try:
        session.tune(spark)
        spark.conf.set(first, "false")
        # 24 MB when written: one task of the default size, two or more now.
        rows = spark.range(3_000_000).selectExpr("xxhash64(id) AS k").groupBy("k").count()
        assert rows.rdd.getNumPartitions() > 1
        spark.conf.set(session._MERGED, "1m")
        session.tune(spark)
        assert spark.conf.get(session._MERGED) == "1m"
    finally:
        spark.conf.unset(first)
        spark.conf.unset(session._MERGED)
        session.tune(spark)
