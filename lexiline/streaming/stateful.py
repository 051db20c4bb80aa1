"""Streams with state of their own: speech intervals by hysteresis, and keys that fall silent.

Both keep a row of bounded size for each key in the state store, so they go on across micro-batches and restarts. They need the store
that `with_state` chooses. Rows of a key are worked through in order by one task, as the rules demand; keys are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexiline.operators import checks
from lexiline.operators.checks import FRAME, LEAST_SILENCE, LEAST_SPEECH, PAD, RATE, SPEECH_OFF, SPEECH_ON
from lexiline.sources.timeline import table

STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state(spark: SparkSession) -> SparkSession:
    """The session, with a store that holds more than one state for each key, unless one is set. Batches need the store's coordinator, which the streams start."""
    if not spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _ = spark.streams.active
    return spark


# ---- speech --------------------------------------------------------------------------------------------------

#: frames that a pad reaches into
REACH = -(-PAD // FRAME)


def _joined(a: list[float], b: list[float]) -> list[float]:
    """Two summaries [frames, sum, least, most] as one; [] has no frames."""
    return [a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])] if a and b else a or b


def _summary(values: list[float]) -> list[float]:
    return [float(len(values)), sum(values), min(values), max(values)] if values else []


class Hysteresis:
    """Where speech begins and ends in frames that come one after the other.

    What it keeps is as long for an hour of speech as for a second: a summary of the frames since speech began and one of those since it paused, the few frames before
    the beginning and after the pause that pads may reach, and the last interval, whose end isn't known until the next one begins far enough away."""

    FIELDS = "next long, start long, pause long, ring array<double>, lead array<double>, body array<double>, tail array<double>, rest array<double>, held array<double>, after array<double>"

    def __init__(self, kept: tuple | None = None):
        lists = [[] for _ in range(7)]
        self.next, self.start, self.pause, self.ring, self.lead, self.body, self.tail, self.rest, self.held, self.after = kept or (0, None, None, *lists)
        if kept:
            self.ring, self.lead, self.body, self.tail, self.rest, self.held, self.after = (list(x) for x in kept[3:])
        self.out: list[tuple] = []

    def kept(self) -> tuple:
        return self.next, self.start, self.pause, self.ring, self.lead, self.body, self.tail, self.rest, self.held, self.after

    def feed(self, p: float) -> None:
        ix, self.next = self.next, self.next + 1
        if self.held and len(self.after) < REACH:
            self.after.append(p)
        if p >= SPEECH_ON and self.start is None:
            self.start, self.lead, self.body = ix, self.ring, []
        if self.start is not None:
            if p >= SPEECH_ON:
                self.body = _joined(self.body, self.rest)
                self.pause, self.tail, self.rest = None, [], []
            elif p < SPEECH_OFF and self.pause is None:
                self.pause = ix
            if self.pause is None:
                self.body = _joined(self.body, [1.0, p, p, p])
            else:
                self.rest = _joined(self.rest, [1.0, p, p, p])
                self.tail = [*self.tail, p][:REACH]
                if p < SPEECH_OFF and (ix - self.pause) * FRAME >= LEAST_SILENCE:
                    if (self.pause - self.start) * FRAME >= LEAST_SPEECH:
                        self._found(self.pause * FRAME, self.body, self.tail)
                    self.start, self.pause, self.lead, self.body, self.tail, self.rest = None, None, [], [], [], []
        self.ring = [*self.ring, p][-REACH:]
        if self.held and ix * FRAME >= self.held[1] + PAD and (self.next if self.start is None else self.start) * FRAME - PAD >= self.held[1] + PAD:
            self._give(int(self.held[1]) + PAD)  # nothing that may come reaches into its pad

    def finish(self, samples: int) -> None:
        """The source ends after so many samples."""
        if self.start is not None and samples - self.start * FRAME >= LEAST_SPEECH:
            self._found(samples, _joined(self.body, self.rest), [])
        if self.held:
            self._give(min(samples, int(self.held[1]) + PAD))

    def _found(self, end: int, body: list[float], tail: list[float]) -> None:
        left = max(0, self.start * FRAME - PAD)
        if self.held:
            right = int(self.held[1]) + PAD
            if left < right:
                left = right = (right + left) // 2
            self._give(right)
        before = self.start - left // FRAME
        self.held, self.after = [float(left), float(end), *_joined(_summary(self.lead[len(self.lead) - before :]) if before else [], body)], list(tail)

    def _give(self, right: int) -> None:
        left, end, n, total, lo, hi = self.held
        n, total, lo, hi = _joined([n, total, lo, hi], _summary(self.after[: max(0, -(-right // FRAME) - -(-int(end) // FRAME))]))
        self.out.append((round(left * 1000 / RATE), round(right * 1000 / RATE), lo, total / n, hi))
        self.held, self.after = [], []


class SpeechProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("hysteresis", Hysteresis.FIELDS)
        self.waiting = handle.getMapState("waiting", "ix long", "p double")  # frames that came before others of smaller number

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at = Hysteresis(tuple(self.state.get()) if self.state.exists() else None)
        came, samples = {}, None
        for r in rows:
            if r["ix"] is not None and r["ix"] >= at.next:
                came[r["ix"]] = r["p"]
            samples = r["samples"] if r["samples"] is not None else samples
        if self.waiting.exists():
            came |= {k[0]: v[0] for k, v in self.waiting.iterator()}
            self.waiting.clear()
        for ix in sorted(came):
            if ix > at.next and samples is None:
                self.waiting.updateValue((ix,), (came[ix],))
                continue
            at.next = ix  # where the source has ended, what is missing doesn't come
            at.feed(came[ix])
        if samples is not None:
            at.finish(samples)
            self.state.clear()
        else:
            self.state.update(at.kept())
        for start, end, lo, mean, hi in at.out:
            yield Row(source_id=key[0], start_ms=start, end_ms=end, lo=lo, mean=mean, hi=hi)

    def close(self) -> None:
        pass


def speech_stream(frames: DataFrame) -> DataFrame:
    """B18 as a stream: (source_id, ix, p, samples) to speech intervals, each given as soon as nothing that may come changes it.

    A row that has samples ends its source (ix and p may be null there). Frames of a source may come in any order; one that comes before others of smaller number waits for them.
    A frame that came already is passed over. After its end a source may begin anew. The rows are those of checks.speech_intervals."""
    with_state(frames.sparkSession)
    rows = frames.select(F.col("source_id").cast("long").alias("source_id"), F.col("ix").cast("long").alias("ix"), F.col("p").cast("double").alias("p"), F.col("samples").cast("long").alias("samples"))
    schema = "source_id long, start_ms long, end_ms long, lo double, mean double, hi double"
    return rows.groupBy("source_id").transformWithState(statefulProcessor=SpeechProcessor(), outputStructType=schema, outputMode="Append", timeMode="None")


# ---- silence -------------------------------------------------------------------------------------------------

#: a key without a beat for longer than this has stalled (fixed value)
STALL_MS = 5 * 60 * 1000


class Stall:
    """What a key's beats say, in their order: it stalls when none came for longer than a limit, and resumes with the next one. A beat that is done ends it."""

    def __init__(self, limit: int, last: int | None = None, silent: bool = False):
        self.limit, self.last, self.silent, self.out = limit, last, silent, []

    def until(self, now: int) -> None:
        if self.last is not None and not self.silent and now - self.last > self.limit:
            self.silent = True
            self.out.append(("stalled", self.last + self.limit))

    def beat(self, at: int, done: bool) -> None:
        self.until(at)
        if self.silent:
            self.out.append(("resumed", at))
        self.last, self.silent = (None if done else at), False


class StallProcessor(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long, silent boolean")
        self.beats = handle.getMapState("beats", "at long", "done boolean")  # that the watermark hasn't passed yet

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            if r["at"] is not None:
                seen = self.beats.getValue((r["at"],)) if self.beats.containsKey((r["at"],)) else None
                self.beats.updateValue((r["at"],), (bool(r["done"]) or bool(seen and seen[0]),))
        self._wake(self._first())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        at = Stall(self.limit, *(self.state.get() if self.state.exists() else (None, False)))
        for beat in sorted(k[0] for k in self.beats.keys()):
            if beat <= now:  # none before it can come any more
                if at.last is None or beat > at.last:
                    at.beat(beat, self.beats.getValue((beat,))[0])
                self.beats.removeKey((beat,))
        at.until(now)
        if at.last is None:
            self.state.clear()
        else:
            self.state.update((at.last, at.silent))
        self._wake(self._first())
        if at.last is not None and not at.silent:
            self._wake(at.last + self.limit + 1)
        for kind, when in at.out:
            yield Row(key=key[0], kind=kind, at_ms=when)

    def _first(self) -> int | None:
        return min((k[0] for k in self.beats.keys()), default=None)

    def _wake(self, at: int | None) -> None:
        if at is not None and at not in self.handle.listTimers():
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def stall_stream(beats: DataFrame, key: str, ts: str, done: str | None = None, limit_ms: int = STALL_MS, late: str = "1 minute") -> DataFrame:
    """(key, kind, at_ms): 'stalled' where a key had no beat for longer than the limit, without waiting for one, and 'resumed' where the next beat takes that back.

    Beats may be late by as much as said; each is judged when the watermark has passed it, so their order of arrival doesn't matter. The rows are those of `stalls`
    with the watermark as now. Of beats at one time one counts, done if any is; a beat without a time is passed over."""
    with_state(beats.sparkSession)
    at = F.col(ts).cast("timestamp")
    rows = beats.select(F.col(key).cast("string").alias("key"), at.alias("ts"), F.unix_millis(at).alias("at"), (F.col(done) if done else F.lit(False)).alias("done")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithState(statefulProcessor=StallProcessor(limit_ms), outputStructType="key string, kind string, at_ms long", outputMode="Append", timeMode="EventTime")


def stalls(beats: DataFrame, key: str, ts: str, done: str | None = None, limit_ms: int = STALL_MS, now: DataFrame | None = None) -> DataFrame:
    """The same of a whole table at the time `now` (one row, now_ms; by default that of the last beat)."""
    own = beats.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), (F.coalesce(F.col(done), F.lit(False)) if done else F.lit(False)).alias("done")).filter("at is not null")
    once = own.groupBy("key", "at").agg(F.bool_or("done").alias("done"))
    now = own.agg(F.max("at").alias("now_ms")) if now is None else now
    seen = once.withColumn("after", F.lead("at").over(Window.partitionBy("key").orderBy("at"))).crossJoin(F.broadcast(now))  # one row
    silent = seen.filter(~F.col("done") & (F.coalesce("after", "now_ms") - F.col("at") > limit_ms))
    row = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at_ms"))
    rows = F.filter(F.array(row("stalled", F.col("at") + limit_ms), row("resumed", F.col("after"))), lambda x: x["at_ms"].isNotNull())
    return silent.select("key", F.explode(rows).alias("x")).select("key", "x.kind", "x.at_ms")


# ---- queries -------------------------------------------------------------------------------------------------

HOURS = 3_600_000


def st_speech_stateful(s: SparkSession, d: str) -> DataFrame:
    """The stream's own processor over the whole table of frames, against B18's statement."""
    frames = checks.speech_frames(s, d)
    ends = frames.groupBy("source_id").agg((F.count("*") * FRAME - 100).alias("samples"))
    rows = frames.select("source_id", "ix", "p", F.lit(None).cast("long").alias("samples")).unionByName(ends, allowMissingColumns=True)
    return speech_stream(rows).select("source_id", "start_ms", "end_ms", "lo", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "hi")


QUERIES = {
    "st_speech_stateful": st_speech_stateful,
    "st_stalls": lambda s, d: stalls(table(s, d, "events").withColumn("done", F.col("event_id") % 7 == 3), "user_id", "ts", "done", 6 * HOURS),
}
ORACLES = {
    "st_speech_stateful": checks.ORACLES["b18_speech_intervals"],
    "st_stalls": f"""WITH b AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS t, bool_or(event_id % 7 = 3) AS done FROM events GROUP BY ALL), e AS (SELECT max(t) AS now FROM b),
n AS (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t) AS nx FROM b), g AS (SELECT * FROM n, e WHERE NOT done AND coalesce(nx, now) - t > {6 * HOURS})
SELECT key, 'stalled' AS kind, t + {6 * HOURS} AS at_ms FROM g UNION ALL SELECT key, 'resumed', nx FROM g WHERE nx IS NOT NULL""",
}
