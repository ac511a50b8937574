"""Live capture sessions as Structured Streaming queries.

Rollups, best code and progress are plain streaming aggregations. Duplicate handling,
row replacement and the running prior need the session's own history, so they run in
one keyed state processor."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from cardloom.plans.session import fresh_folder, path_exists

SESSION_TTL, DUP_WINDOW = 1800.0, 2.0
#: How far a frame may come behind the newest one before it is late.
WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """One Parquet table of a folder as a file stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def session_rollup(frames: DataFrame, gap: str = "30 minutes", watermark: str | None = WATERMARK) -> DataFrame:
    """Sessions end after ``gap`` without a frame. Works on streams and batches; a stream in append mode returns sessions once the
    watermark has passed their end and drops frames that come later than that (``closed_sessions`` counts them)."""
    kind = frames.schema["ts"].dataType       # a watermark needs a time with a zone; the result has the type that came
    f = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark and frames.isStreaming else frames
    return f.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("frames"), F.max("confidence").alias("best")).select(
        "session_id", F.col("w.start").cast(kind).alias("started"), "frames", "best")


def best_code(codes: DataFrame) -> DataFrame:
    """Latest well-formed code of a session, else its first. ``codes``: session_id,
    code, format_ok, ts, frame_id."""
    at = F.struct("ts", "frame_id")
    return codes.groupBy("session_id").agg(
        F.max(F.when(F.col("format_ok"), F.struct("ts", "frame_id", "code"))).alias("good"),
        F.min_by("code", at).alias("first")).select(
        "session_id", F.coalesce("good.code", "first").alias("code"), F.col("good").isNotNull().alias("format_ok"))


def followup_rows(rows: DataFrame) -> DataFrame:
    """Latest state of each row of a scan. ``rows``: scan_id, row_index, state, finished, ts,
    event_id. One aggregation, so it runs on streams."""
    return rows.groupBy("scan_id", "row_index").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.bool_or("finished").alias("finished"))


def followup_scans(last: DataFrame) -> DataFrame:
    """Per scan, from ``followup_rows``: is any row still pending, is the scan done."""
    return last.groupBy("scan_id").agg(F.bool_or(F.col("state") == "pending_vlm").alias("any_pending"),
                                       F.bool_or("finished").alias("done"), F.count(F.lit(1)).alias("rows"))


def followup_progress(rows: DataFrame) -> DataFrame:
    """Both steps on a batch."""
    return followup_scans(followup_rows(rows))


def stage_progress(events: DataFrame) -> DataFrame:
    """Current stage and counts per scan. ``events``: scan_id, stage, done, total, ts, event_id."""
    return events.groupBy("scan_id").agg(
        F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.max("done").alias("done"),
        F.max("total").alias("total"))


OUT = ("session_id bigint, frame_id bigint, event string, row_index int, confidence double, "
       "prior_set string, code string")


class Session:
    """What a live session knows: its rows by identity, the votes of its sets, its newest row and its code.

    ``load`` brings the stored rows of one identity; only what frames touch is loaded, and ``changed`` names what has to be
    stored again. A row is [index, captured at, confidence, accepted, replaceable]; of rows without an identity only
    replaceable ones are held, as no frame can match another."""

    def __init__(self, load: Callable[[str], list] | None = None):
        self.load, self.rows, self.changed = load or (lambda key: []), {}, set()
        self.votes: dict[str, list[int]] = {}           # set -> [accepted rows, first of them]
        self.n_rows, self.last, self.code, self.expires = 0, "", None, None

    def of(self, key: str) -> list:
        if key not in self.rows:
            self.rows[key] = self.load(key)
        return self.rows[key]

    def vote(self, key: str, index: int) -> None:
        if key and key[1:].split(":")[0]:
            n, first = self.votes.get(key[1:].split(":")[0], (0, index))
            self.votes[key[1:].split(":")[0]] = [n + 1, min(first, index)]

    def modal(self) -> str | None:
        """Most frequent set of the accepted rows; earliest row wins a tie."""
        return min(self.votes, key=lambda s: (-self.votes[s][0], self.votes[s][1])) if self.votes else None


def step(session: Session, f) -> tuple[str, int | None, float | None]:
    """Apply one frame or control event; (event, row, confidence shown)."""
    if f.kind == "code":
        if f.format_ok or session.code is None:
            session.code = f.code
        return "code_card", None, None
    if f.kind == "replace":                       # the user marks the newest row
        newest = session.n_rows - 1
        if newest < 0:
            return "marked", None, None
        rows = session.of(session.last)
        mine = [r for r in rows if r[0] == newest]
        if mine:
            mine[0][4] = True
        else:
            rows.append([newest, 0.0, None, True, True])
        session.changed.add(session.last)
        return "marked", newest, None
    key = "=" + f.identity_key if isinstance(f.identity_key, str) else ""
    rows = session.of(key)
    same = [r for r in rows if key and not r[4]]
    if same:
        row = max(same, key=lambda r: (r[1], -r[0]))
        if f.at - row[1] <= DUP_WINDOW:           # anchor is the first capture, not the last look
            row[2] = max(row[2], f.confidence)
            session.changed.add(key)
            return "card", row[0], row[2]
    session.changed.add(key)
    if not same:
        marked = min((r for r in rows if r[4]), default=None)       # NULL matches NULL here
        if marked is not None:
            rows.remove(marked)
            if key:
                rows.append([marked[0], f.at, f.confidence, True, False])
                if not marked[3]:
                    session.vote(key, marked[0])
            return "card", marked[0], f.confidence
    index, session.last = session.n_rows, key
    session.n_rows += 1
    if key:
        rows.append([index, f.at, f.confidence, not same, False])
    if not same:
        session.vote(key, index)
    return ("duplicate_prompt" if same else "card"), index, f.confidence


class LiveSession(StatefulProcessor):
    """One session: rows in capture order, a sliding idle expiry in event time, best code.

    Rows lie in map state by identity and votes by set, so a micro-batch reads and writes what its frames touch, however long the
    session is. Idle expiry is judged in event time; with ``timers`` an event-time timer also drops the state of a
    session that has ended."""

    def __init__(self, timers: bool = False):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "expires double, n_rows int, last string, code string")
        self.rows = handle.getMapState("rows", "identity string", "body string")
        self.votes = handle.getMapState("votes", "set string", "n int, first int")

    def _stored(self, key: str) -> list:
        return json.loads(self.rows.getValue((key,))[0]) if self.rows.containsKey((key,)) else []

    def _open(self) -> Session:
        session = Session(self._stored)
        session.expires, session.n_rows, session.last, session.code = self.meta.get()
        session.votes = {k[0]: [int(v[0]), int(v[1])] for k, v in self.votes.iterator()}
        return session

    def _wipe(self) -> None:
        self.meta.clear()
        self.rows.clear()
        self.votes.clear()

    def _store(self, session: Session) -> None:
        for key in session.changed:
            if session.rows[key]:
                self.rows.updateValue((key,), (json.dumps(session.rows[key]),))
            elif self.rows.containsKey((key,)):
                self.rows.removeKey((key,))
        for name, (n, first) in session.votes.items():
            self.votes.updateValue((name,), (n, first))
        self.meta.update((session.expires, session.n_rows, session.last, session.code))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(["at", "frame_id"])
        stored = self.meta.exists()
        session, out, ended = self._open() if stored else None, [], False
        for f in frames.itertuples(index=False):
            if session is None or f.at > session.expires:
                session, ended = Session(), stored
            session.expires = f.at + SESSION_TTL
            prior = session.modal()
            event, row, conf = step(session, f)
            out.append((key[0], f.frame_id, event, row, conf, prior, session.code))
        # Only the last session is stored, so what was stored is dropped once, not at the end of each session in between.
        if ended:
            self._wipe()
        self._store(session)
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(session.expires * 1000) + 1)
        yield pd.DataFrame(out, columns=["session_id", "frame_id", "event", "row_index", "confidence",
                                         "prior_set", "code"]).astype({"row_index": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._wipe()
        return iter([])

    def close(self) -> None:
        pass


def live_sessions(frames: DataFrame, expire_state: bool = False, watermark: str = WATERMARK) -> DataFrame:
    """Event log of live sessions. ``frames``: session_id, frame_id, ts, kind
    (card/code/replace), identity_key, confidence, code, format_ok.

    ``expire_state`` is for streams that never stop: a timer in event time drops the state of a session once the
    watermark has passed its idle end, and frames behind the watermark are dropped as late."""
    ts = F.col("ts").cast("timestamp")
    f = frames.select("session_id", "frame_id", ts.alias("ts"), (F.unix_micros(ts).cast("double") / 1e6).alias("at"),
                      "kind", "identity_key", "confidence", "code", "format_ok")
    if expire_state:
        f = f.withWatermark("ts", watermark)
    return f.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=LiveSession(expire_state), outputStructType=OUT, outputMode="Append",
        timeMode="EventTime" if expire_state else "None")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a table of the shared folder and read it back."""
    spark = stream.sparkSession
    root = fresh_folder(spark, name)
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/data") \
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def last_state(stream: DataFrame, name: str) -> DataFrame:
    """Drain a streaming aggregation in complete mode and read the state after its last batch."""
    spark = stream.sparkSession
    root = fresh_folder(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint") \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


@dataclass(frozen=True)
class Progress:
    """What a query's state operators report over the batches it made: input rows, rows dropped behind the watermark, rows of state left."""
    rows: int
    dropped: int
    state_rows: int


def progress_of(query: StreamingQuery) -> Progress:
    """Sums of the progress reports that the query still holds (a drained query holds all of its last hundred batches)."""
    reports = query.recentProgress
    operators = [o for p in reports for o in p.stateOperators]
    return Progress(sum(p.numInputRows for p in reports), sum(o.numRowsDroppedByWatermark for o in operators),
                    sum(o.numRowsTotal for o in reports[-1].stateOperators) if reports else 0)


def closed_sessions(frames: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK, name: str = "sessions") -> tuple[DataFrame, Progress]:
    """Drain a stream of frames in append mode: (sessions that have ended by the watermark, progress with the count of late frames).
    Open sessions stay in the state; closed ones leave it. The watermark of a batch makes frames late from the batch after
    the next one on; late frames of one session that come in one batch within the gap count once."""
    spark, root = frames.sparkSession, fresh_folder(frames.sparkSession, name)
    rollup = session_rollup(frames, gap, watermark)
    query = rollup.writeStream.outputMode("append").format("parquet").option("path", f"{root}/data") \
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rollup.schema).parquet(f"{root}/data"), progress_of(query)


class KeyedSink:
    """The newest row of every key of a stream in update mode, as a log of changes.

    Each batch writes its changed rows only, under its batch id, so a batch that runs again overwrites itself; every ``compact``
    batches, what is known so far is written as one base, and a log row, written last, makes the base visible. A
    reader takes the newest base and the changes after it."""

    def __init__(self, root: str, keys: list[str], compact: int = 16):
        self.root, self.keys, self.compact = root, keys, compact

    def put(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")
        if (batch_id + 1) % self.compact == 0:
            self._newest(spark, batch.schema, batch_id).write.mode("overwrite").parquet(f"{self.root}/base/upto={batch_id}")
            spark.range(1).select(F.lit(batch_id).cast("long").alias("upto")).write.mode("append").parquet(f"{self.root}/bases")

    def _newest(self, spark: SparkSession, schema: StructType, upto: int | None = None) -> DataFrame:
        stored = StructType([*schema.fields, StructField("batch_id", LongType())])
        changes = spark.read.schema(stored).parquet(f"{self.root}/changes/*")
        base = -1
        if path_exists(spark, f"{self.root}/bases"):
            logged = spark.read.schema("upto long").parquet(f"{self.root}/bases")
            base = (logged if upto is None else logged.filter(F.col("upto") < upto)).agg(F.max("upto")).first()[0]
            base = -1 if base is None else base
        if base >= 0:
            changes = changes.filter(F.col("batch_id") > base).unionByName(spark.read.schema(stored).parquet(f"{self.root}/base/upto={base}"))
        if upto is not None:
            changes = changes.filter(F.col("batch_id") <= upto)
        rest = [c for c in stored.names if c not in self.keys]
        newest = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"r.{c}") for c in stored.names])

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        return self._newest(spark, schema).drop("batch_id")


def keyed_state(stream: DataFrame, name: str, keys: list[str], compact: int = 16) -> DataFrame:
    """Drain a streaming aggregation in update mode into a ``KeyedSink`` and read the newest row of every key: a batch writes what
    it changed, not the whole result."""
    root = fresh_folder(stream.sparkSession, name)
    sink = KeyedSink(root, keys, compact)
    stream.writeStream.outputMode("update").foreachBatch(sink.put).option("checkpointLocation", f"{root}/checkpoint") \
        .trigger(availableNow=True).start().awaitTermination()
    return sink.read(stream.sparkSession, stream.schema)


def debounced_batches(pending: DataFrame, resolve, name: str = "batches",
                      every: str | None = "2 seconds") -> tuple[str, StreamingQuery]:
    """Collect pending items and process them together, each exactly once.

    ``resolve(batch_df)`` returns the terminal rows of a batch; they are written under
    the batch id, so a replayed batch overwrites itself. Returns the output folder and the query, which
    the caller stops or awaits; with ``every`` None it drains what is there and has ended."""
    root = fresh_folder(pending.sparkSession, name)

    def drain(batch: DataFrame, batch_id: int) -> None:
        resolve(batch).write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

    writer = pending.writeStream.foreachBatch(drain).option("checkpointLocation", f"{root}/checkpoint")
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    query = writer.start()
    if every is None:
        query.awaitTermination()
    return f"{root}/data", query


def incremental_stats(new_pulls: DataFrame, derive, publish, name: str = "stats") -> None:
    """Process only the pulls that arrived since the last run, then publish once.

    ``derive(batch, batch_id)`` appends the batch's derived rows idempotently;
    ``publish()`` combines what the batches wrote and writes a snapshot."""
    root = fresh_folder(new_pulls.sparkSession, name)
    new_pulls.writeStream.foreachBatch(derive).option("checkpointLocation", f"{root}/checkpoint") \
        .trigger(availableNow=True).start().awaitTermination()
    publish()
