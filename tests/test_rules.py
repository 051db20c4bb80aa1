"""Rules without SQL, and plan builders, against plain Python."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lexiline.operators import aggregate
from lexiline.operators import compile as plans
from lexiline.operators import metrics
from lexiline.plans.ordered import as_of, merged, range_join


def test_matching_is_the_largest():
    rng = random.Random(1)

    def best(r, h):
        if not r or not h:
            return 0
        return max(best(r[1:], h), *(1 + best(r[1:], h[:i] + h[i + 1 :]) for i in range(len(h)) if abs(r[0] - h[i]) <= 3), 0)

    for _ in range(200):
        r, h = ([rng.randrange(20) for _ in range(rng.randrange(6))] for _ in range(2))
        assert metrics.matched(r, h, 3) == best(r, h)


def test_edit_distance():
    def least(r, h):
        if not r or not h:
            return 2.0 * (len(r) + len(h))
        return min(2 + least(r[1:], h), 2 + least(r, h[1:]), abs(r[0] - h[0]) + least(r[1:], h[1:]))

    rng = random.Random(2)
    for _ in range(100):
        r, h = (sorted(rng.sample(range(15), rng.randrange(5))) for _ in range(2))
        assert metrics.edit_distance(r, h) == least(r, h)


def test_breaks_are_optimal():
    rng = np.random.default_rng(3)
    c = metrics.costs(metrics.gram(rng.normal(size=(17, 3))))
    total = lambda at: sum(c[a, b] for a, b in zip([0, *at], [*at, 17]))
    for k in (1, 2, 3):
        assert np.isclose(total(metrics.best_breaks(c, k)), min(total(x) for x in itertools.combinations(range(1, 17), k)))
    every = [x for k in range(4) for x in itertools.combinations(range(1, 17), k)]
    assert np.isclose(total(found := metrics.penalized_breaks(c, 0.4)) + 0.4 * len(found), min(total(x) + 0.4 * len(x) for x in every))


def test_shortest_paths(spark):
    rng = random.Random(4)
    rows = [(1, layer, rng.randrange(30), rng.randrange(9), f"{layer}-{i}") for layer in range(4) for i in range(4)]
    got = plans.shortest_paths(spark.createDataFrame(rows, "source_id long, layer long, ms long, cost long, bid string")).collect()
    options = [[r for r in rows if r[1] == layer] for layer in range(4)]
    paths = [p for p in itertools.product(*options) if all(a[2] < b[2] for a, b in zip(p, p[1:]))]
    if paths:
        assert got[0]["total"] == min(sum(r[3] for r in p) for p in paths)
    else:
        assert [r["layer"] for r in got] == [-1]


def least_of_component(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components_of_long_chains(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(300)] + [(1000 - i, 999 - i) for i in range(300) if i != 150] + [(2000 + rng.randrange(90), 2000 + rng.randrange(90)) for _ in range(60)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in plans.components_of(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least_of_component(edges)


def test_components_of_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    want = least_of_component([(r[0], r[1] + 100_000_000) for r in rows])
    assert {r["node"]: r["component"] for r in plans.QUERIES["h10_components_all"](spark, sf).collect()} == want
    assert sum(r["size"] for r in plans.QUERIES["h11_repair_plan_all"](spark, sf).collect()) == len(want)


def test_closure_of_deep_graphs(spark):
    edges = [(i, i - 1) for i in range(1, 31)] + [(0, 30)]
    got = plans.closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(7, 30), (8, 99)], "root long, node long")).collect()
    assert sorted(map(tuple, got)) == [(7, x) for x in range(31)] + [(8, 99)]


def test_bootstrap_of_2000_resamples(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    deltas = labels.join(docs, "doc_id").select(F.col("lang").alias("key"), F.col("doc_id").alias("pair"), (F.col("quality") - F.col("toxic")).cast("double").alias("delta"))
    got = aggregate.QUERIES["e18_bootstrap_interval"](spark, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, aggregate.bootstrap_interval(deltas, 2000).collect()))


def test_lookups_and_joins(spark):
    rng = random.Random(5)
    left = [(rng.randrange(3), i, rng.randrange(60)) for i in range(40)]
    right = [(rng.randrange(3), s, s + rng.randrange(1, 12), 100 + i) for i, s in enumerate(rng.sample(range(60), 25))]
    lf, rf = spark.createDataFrame(left, "k long, i long, t long"), spark.createDataFrame(right, "k long, s long, e long, v long")
    got = {(r["k"], r["i"]): r["right_v"] for r in as_of(lf, rf, ["k"], "t", "s", ["v"]).collect()}
    nxt = {(r["k"], r["i"]): r["right_v"] for r in as_of(lf, rf, ["k"], "t", "s", ["v"], forward=True).collect()}
    for k, i, t in left:
        before = [r for r in right if r[0] == k and r[1] <= t]
        after = [r for r in right if r[0] == k and r[1] >= t]
        assert got[k, i] == (max(before, key=lambda r: r[1])[3] if before else None)
        assert nxt[k, i] == (min(after, key=lambda r: r[1])[3] if after else None)
    a = lf.select("k", "i", F.col("t").alias("a_s"), (F.col("t") + 5).alias("a_e"))
    pairs = sorted((r["i"], r["v"]) for r in range_join(a, rf, ["k"], ("a_s", "a_e"), ("s", "e"), 7).collect())
    assert pairs == sorted((i, r[3]) for k, i, t in left for r in right if r[0] == k and t < r[2] and r[1] < t + 5)
    m = merged(rf.withColumnsRenamed({"s": "start_ms", "e": "end_ms"}), ["k"]).collect()
    for k in range(3):
        covered = {x for r in right if r[0] == k for x in range(r[1], r[2])}
        assert covered == {x for r in m if r["k"] == k for x in range(r["start_ms"], r["end_ms"])}


def test_entry_without_the_corpus_operators(spark, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "lexiline.llm", None)
    monkeypatch.setitem(sys.modules, "lexiline.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "sentence_grid" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert entry.entry(spark).limit(1).collect()
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_admission_counts_what_is_admitted(spark):
    rows = [(1, 1, 4), (1, 2, 9), (1, 3, 5), (1, 4, 1), (1, 5, 1), (2, 1, 11)]
    got = aggregate.admission(spark.createDataFrame(rows, "run long, attempt long, cost long"), 10, 3).collect()
    assert sorted((r["run"], r["attempt"], r["running"], r["admitted"]) for r in got) == [(1, 1, 4, True), (1, 2, 4, False), (1, 3, 9, True), (1, 4, 10, True), (1, 5, 10, False), (2, 1, 0, False)]


def test_capped_layers_keep_the_nearest_safe_of_each_kind(spark):
    b = [(1, f"s{i}", 1000 + i, "sentence", 0.5, 0, True) for i in range(6)] + [(1, "p", 1400, "pause", 0.5, 300, False), (1, "q", 1450, "pause", 0.5, 300, False), (1, "t", 1500, "turn", 0.5, 300, False)]
    wanted = spark.createDataFrame([(1, 0, 1000)], "source_id long, layer long, wanted long")
    got = plans.layer_choices(wanted, spark.createDataFrame(b, "source_id long, bid string, ms long, kind string, score double, clearance long, review boolean"), cap=4).collect()
    assert {r["bid"] for r in got} == {"p", "t", "s0", "s1"}


def test_stream_of_sessions_is_the_batch(spark, tmp_path):
    """What a stream has closed by its watermark equals the batch's rows, and a batch that runs twice is there once."""
    from lexiline.streaming import events

    rows = [(u, 1_700_000_000 + u * 7 + k * (600 if k % 4 else 9000), float(k)) for u in range(3) for k in range(12)]
    e = spark.createDataFrame(rows, "user_id long, t long, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value")
    e.repartition(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(9, 1_800_000_000, 0.0)], "user_id long, t long, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value").write.parquet(f"{tmp_path}/late")
    put = events.append_once(f"{tmp_path}/out")
    run = lambda src: events.sessions(spark.readStream.schema(e.schema).parquet(src), "user_id", "ts", "30 minutes").writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    run(f"{tmp_path}/in")
    spark.read.parquet(f"{tmp_path}/late").write.mode("append").parquet(f"{tmp_path}/in")
    run(f"{tmp_path}/in")
    want = sorted(map(tuple, events.sessions(e, "user_id", "ts", "30 minutes").collect()))
    out = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, out.collect())) == want
    put(out.limit(0), 0)
    assert spark.read.parquet(f"{tmp_path}/in").count() == 37


def test_files_refuse_what_does_not_fit(spark, tmp_path):
    import pytest

    from lexiline.sources import files

    (tmp_path / "bad.json").write_text('{"source_id": 1, "segments": {"unexpected": 123}}\n')
    with pytest.raises(Exception):
        files.asr_words(files.read_asr(spark, f"file://{tmp_path}/bad.json")).collect()
    with pytest.raises(Exception):
        files.artifacts(spark.createDataFrame([(float("nan"),)], "x double"), ["x"]).collect()
