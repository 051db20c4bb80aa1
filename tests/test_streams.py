"""Streams in several micro-batches against the same rules over whole tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexiline.operators.checks import FRAME, speech_intervals
from lexiline.streaming.stateful import STALL_MS, speech_stream, stall_stream, stalls

FRAMES = "source_id long, ix long, p double, samples long"


def streamed(spark, tmp_path, batches, schema, plan):
    """The rows of a stream that gets these batches one after the other."""
    source, out = str(tmp_path / "in"), []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/batch={k:04d}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{source}/*")
    run = plan(files).writeStream.foreachBatch(lambda df, k: out.append((k, [tuple(r) for r in df.collect()]))).option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
    run.trigger(availableNow=True).start().awaitTermination(240)
    return out


def frames(seed: int, sources: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for s in range(sources):
        p = []
        for _ in range(rng.randrange(5, 30)):
            level = rng.choice([(0.5, 1.0), (0.0, 0.34), (0.35, 0.49), (0.0, 1.0)])
            p += [round(rng.uniform(*level), 2) for _ in range(rng.randrange(1, 14))]
        rows += [(s, i, x, None) for i, x in enumerate(p)] + [(s, None, None, len(p) * FRAME - rng.randrange(0, FRAME))]
    return rows


def plain(rows):
    return sorted((s, a, b, round(lo, 6), round(mean, 6), round(hi, 6)) for s, a, b, lo, mean, hi in rows)


def whole(spark, rows):
    f = spark.createDataFrame([r[:3] for r in rows if r[1] is not None], "source_id long, ix long, p double")
    ends = spark.createDataFrame([(r[0], r[3]) for r in rows if r[3] is not None], "source_id long, samples long")
    return plain(speech_intervals(f, ends).collect())


@pytest.mark.parametrize("seed", range(6))
def test_speech_of_one_batch(spark, seed):
    rows = frames(seed, 8)
    random.Random(seed).shuffle(rows)
    assert plain(speech_stream(spark.createDataFrame(rows, FRAMES)).collect()) == whole(spark, rows)


def test_speech_in_micro_batches_cut_anywhere(spark, tmp_path):
    """Cut inside pauses and pads, with frames that come before earlier ones."""
    rows = frames(21, 5)
    batches = [[] for _ in range(9)]
    for s, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        for i, r in enumerate(own):
            batches[min(8, i * 9 // len(own))].append(r)
    for a, b in ((1, 2), (4, 5)):  # some frames one batch too late, and one twice
        batches[b] += [r for r in batches[a] if r[1] is not None and r[1] % 5 == 2]
        batches[a] = [r for r in batches[a] if r[1] is None or r[1] % 5 != 2]
    batches[3] += [r for r in batches[0][:2] if r[1] is not None]
    got = streamed(spark, tmp_path, batches, FRAMES, speech_stream)
    assert plain([r for _, rows_ in got for r in rows_]) == whole(spark, rows)
    assert sum(bool(rows_) for _, rows_ in got) > 1, "intervals come while the stream runs"


BEATS = "run string, ts timestamp, done boolean"


def beats(spark, seed: int):
    rng, rows = random.Random(seed), []
    for run in "abcdef":
        t = rng.randrange(0, 600)
        for _ in range(rng.randrange(1, 12)):
            rows.append((run, t * 1000, False))
            t += rng.choice([30, 120, 299, 300, 301, 420, 900])
        if rng.random() < 0.4:
            rows.append((run, t * 1000, True))
    return rows


def stamped(rows):
    import datetime as dt

    return [(run, dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc), done) for run, ms, done in rows]


def by_hand(rows, now):
    out = []
    for run in sorted({r[0] for r in rows}):
        own = sorted((ms, done) for r, ms, done in rows if r == run)
        for (a, done), (b, _) in zip(own, [*own[1:], (now, None)]):
            if not done and b - a > STALL_MS:
                out.append((run, "stalled", a + STALL_MS))
                if b is not now or len([x for x in own if x[0] == b]):
                    out.append((run, "resumed", b))
    return sorted(out)


def test_stalls_of_a_table(spark):
    rows = beats(spark, 5)
    now = max(ms for _, ms, _ in rows) + 1_000_000
    got = stalls(spark.createDataFrame(stamped(rows) + [("a", None, None)], BEATS), "run", "ts", "done", now=spark.range(1).select(F.lit(now).cast("long").alias("now_ms")))
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, now)


def test_stalls_fire_without_a_beat_and_are_taken_back(spark, tmp_path):
    rows = beats(spark, 7)
    late = random.Random(8)
    order = sorted(rows, key=lambda r: r[1] + late.randrange(0, 55_000))  # within the watermark
    end = max(ms for _, ms, _ in rows) + 3_600_000
    batches = [stamped(order[i : i + 5]) for i in range(0, len(order), 5)] + [stamped([("clock", end, True)])]
    got = streamed(spark, tmp_path, batches, BEATS, lambda df: stall_stream(df, "run", "ts", "done"))
    assert sorted(r for _, rows_ in got for r in rows_) == by_hand(rows, end - 60_000)
    silent = [r for _, rows_ in got for r in rows_ if r[1] == "stalled"]
    assert silent and sum(bool(rows_) for _, rows_ in got) > 1
