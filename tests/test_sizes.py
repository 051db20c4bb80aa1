"""What a task holds, and what a query shuffles, as tables grow."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiline.operators import aggregate, bundle, clean, evaluation, intervals, metrics, portfolio, retrieval, source_index
from lexiline.operators import compile as plans
from lexiline.plans import rules
from lexiline.plans.shared import stored
from lexiline.sources import timeline

SMALL = "/root/testdata/sf0.001"


def _parts(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_words_of_a_task_are_bounded_by_text(spark, monkeypatch):
    monkeypatch.setattr(timeline, "TASK_TEXT", 1500)
    size = timeline.table(spark, SMALL, "conversations").agg(F.sum(F.octet_length("text"))).first()[0]
    assert timeline.words(spark, SMALL).rdd.getNumPartitions() == -(-size // 1500) > 4
    for name in ("c7_word_at", "c7_word_at_all"):
        assert len(_parts(intervals.QUERIES[name](spark, SMALL))) > 4


def test_interpolated_times_and_boundary_strings_in_tasks_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(timeline, "TASK_TEXT", 1500)
    for q in (clean.QUERIES["a6_interpolated_times"], metrics.QUERIES["g1_boundary_string"], metrics.QUERIES["g6_ghd"]):
        plan = q(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "specifiedwindowframe(RowFrame, 1, unboundedfollowing" not in plan and "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing" not in plan
        assert "RepartitionByExpression [conv_id" in plan


def test_bootstrap_in_blocks_equals_draws_joined(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(k, i * 3, None if k == "b" and i % 4 == 0 else float(rng.randrange(-5, 6))) for k, n in (("a", 41), ("b", 23), ("c", 1)) for i in range(n)]
    deltas = spark.createDataFrame(rows, "key string, pair long, delta double")
    monkeypatch.setattr(aggregate, "DRAW_BLOCK", 16)
    monkeypatch.setattr(aggregate, "DRAW_RESAMPLES", 7)
    df = aggregate.bootstrap_interval(deltas, 80)
    got = {r["key"]: r for r in df.collect()}
    draws = spark.range(80).selectExpr("cast(id as int) r").crossJoin(deltas.groupBy("key").agg(F.count("*").alias("n"))).selectExpr("key", "n", "r", "explode(sequence(0L, n - 1)) k")
    drawn = {}
    for r in draws.select("key", "r", F.pmod(F.xxhash64(F.lit(0), "key", "r", "k"), "n").alias("i")).collect():
        drawn.setdefault((r["key"], r["r"]), []).append(r["i"])
    for key in "ab":
        d = [x for k, _, x in rows if k == key]
        means = sorted(sum(y) / len(y) for r in range(80) for y in [[d[i] for i in drawn[key, r] if d[i] is not None]])
        assert (got[key]["low"], got[key]["high"]) == (round(means[1], 6), round(means[77], 6))
    assert got["c"]["low"] is None


def test_hybrid_search_scores_few_pairs_and_loses_none(spark, monkeypatch):
    import random

    rng = random.Random(9)
    some = [[float(rng.randrange(-3, 4)) / 8 for _ in range(6)] for _ in range(12)]
    vecs = [(i, rng.choice(some) if i % 3 else [rng.uniform(-0.3, 0.3) for _ in range(6)]) for i in range(400)] + [(400, None), (401, [0.1] * 5), (402, [float("nan")] * 6), (403, [None] * 6)]
    v = spark.createDataFrame(vecs, "id long, vec array<double>")
    q = v.filter("id % 40 = 0").selectExpr("id as query_id", "vec as query_vec")
    t = spark.createDataFrame([(qi, i, float(rng.randrange(1, 9))) for qi in (0, 80) for i in range(0, 400, 7)], "query_id long, id long, score double")
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    got = {}
    for cursor in (0, 16):
        for r in retrieval.hybrid(t, v, q, cursor).collect():
            got.setdefault(r["query_id"], {})[r["position"]] = (r["id"], r["score"])
    best = t.groupBy("query_id").agg(F.max("score").alias("top"))
    all_ = v.crossJoin(q).join(t, ["query_id", "id"], "left").join(best, "query_id", "left").select("query_id", "id", F.round(0.65 * (retrieval.dot(F.col("vec"), F.col("query_vec")) + 1) / 2 + 0.35 * F.coalesce(F.col("score") / F.col("top"), F.lit(0.0)), 4).alias("s"))
    want = {}
    for r in all_.orderBy("query_id", F.desc("s"), "id").collect():
        want.setdefault(r["query_id"], []).append((r["id"], r["s"]))
    for query, rows in want.items():
        assert [str(got[query][i + 1]) for i in range(32)] == [str(x) for x in rows[:32]]
    assert len(want) == 11
    assert retrieval._nearest(v.filter("id < 400"), q.filter("query_id < 400"), 16).count() < 10 * 40


def test_tables_of_a_review_do_not_go_back_to_words(spark):
    for name, df in portfolio._tables(spark, SMALL).items():
        assert "conversations" not in df._jdf.queryExecution().optimizedPlan().toString() and "conv_id" not in df._jdf.queryExecution().optimizedPlan().toString(), name


def _dealt_by(df):
    """What the shuffles of a plan are dealt by."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_index_shuffles_neither_words_nor_components(spark):
    rows = [(s, k, k * 10, k * 10 + 9, f"Word {s} and other words {k}.") for s in (1, 2) for k in range(70)]
    grid = spark.createDataFrame(rows, "source_id long, sentence_id long, start_ms long, end_ms long, text string")
    parts = spark.createDataFrame([(s, k, [1.0 + s, float(k)]) for s, k, *_ in rows if k % 9], "source_id long, sentence_id long, vec array<double>")
    nodes = stored(source_index.source_index(grid, parts), "nodes")
    for df in (source_index.source_index(grid, parts), source_index.source_index_violations(nodes, grid)):
        assert not [x for x in _dealt_by(df) if "word#" in x or "dim#" in x or "m#" in x]
    assert nodes.count() == 2 * (3 + 1 + 1) and source_index.source_index_violations(nodes, grid).count() == 0
    # a part of no known sentence counts nowhere
    more = parts.unionByName(spark.createDataFrame([(1, 500, [9.0, 9.0]), (1, -1, [9.0, 9.0]), (3, 0, [1.0, 1.0])], parts.schema))
    key = lambda df: sorted((r["source_id"], r["id"], [round(x, 9) for x in r["embedding"]]) for r in df.collect())
    assert key(source_index.source_index(grid, more)) == key(nodes)


def test_facts_of_dealt_tables_stay_where_they_are(spark, monkeypatch):
    tables = evaluation._tables(spark, SMALL)
    met = rules.facts(tables, evaluation.CATALOGUE, "bundle").withColumn("n", F.count("*").over(Window.partitionBy("bundle", "space", "key")))
    assert not [x for x in _dealt_by(met) if "key#" in x]
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(evaluation.bundle_violations(tables))

    def refused(_):
        raise AssertionError("facts are written")

    monkeypatch.setattr(rules, "shared_folder", refused)
    assert rows(evaluation.bundle_violations(tables, dealt=True)) == want and len(want) > 500


def test_evidence_goes_through_words_few_times(spark):
    plan = aggregate.QUERIES["e2_evidence_assembly"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 3 and plan.count("Exchange") <= 3


def test_clearance_in_one_pass(spark):
    import random

    rng = random.Random(4)
    spans = [(k, a := rng.randrange(400), a + rng.randrange(1, 30)) for k in (1, 2) for _ in range(9)]
    at = [(k, rng.choice([rng.randrange(460), *[x for s in spans for x in s[1:]]]), i) for i, k in enumerate([1, 2, 3, None] * 60)]
    got = intervals.clearance(spark.createDataFrame(at, "key long, t long, i long"), spark.createDataFrame(spans, "key long, start_ms long, end_ms long"), ["key"]).collect()

    def expected(k, t):
        own = []
        for _, a, b in sorted(s for s in spans if s[0] == k):
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]))
            else:
                own.append((a, b))
        if any(a <= t < b for a, b in own):
            return 0
        gaps = [t - b for a, b in own if a <= t][-1:] + [a - t for a, _ in own if a >= t][:1]
        return min(gaps) if gaps else t

    assert sorted((r["i"], r["clearance_ms"]) for r in got) == sorted((i, expected(k, t)) for k, t, i in at)


def test_closure_shuffles_neither_edges_nor_what_was_reached(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    monkeypatch.setattr(plans, "shared_folder", lambda s: f"file://{tmp_path}/r")
    monkeypatch.setattr(plans, "LEAST_ROWS", 8, raising=False)
    written, write = {}, DataFrameWriter.parquet

    def kept(self, path, *a, **k):
        written[path.split("/")[-1]] = self._df._jdf.queryExecution().executedPlan().toString()
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = [(i, j) for i in range(1, 60) for j in (i // 2, i // 3, (i * 7) % 60) if j]
        roots = range(0, 60, 5)
        got = plans.closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(i, i) for i in roots], "root long, node long")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = {(i, i) for i in roots}
    while more := {(r, b) for r, n in want for a, b in edges if a == n} - want:
        want |= more
    assert len(got) == len(want) and set(map(tuple, got)) == want
    rounds = [p for name, p in written.items() if name.startswith("reached-") and name != "reached-0"]
    assert len(rounds) > 3 and all(p.count("Exchange hashpartitioning") == 2 for p in rounds)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexiline_")]


def test_an_archive_grows_little_by_lines_that_many_bundles_share(spark, tmp_path):
    import glob
    import hashlib
    import os

    body = lambda i: "".join(hashlib.sha256(f"{i}.{k}".encode()).hexdigest() for k in range(20))
    artifacts = [(1, i, hashlib.sha256(body(i).encode()).hexdigest(), "f", "evidence", None, 9, i, body(i), 1) for i in range(40)]
    roots = [(r, 1, r % 2, 1) for r in range(300)]
    edges = [(i, j, 1) for i in (0, 1) for j in range(2, 40)]
    given = [spark.createDataFrame(x, s) for x, s in ((roots, "run long, source_id long, id long, version long"), (artifacts, "source_id long, id long, sha256 string, fingerprint string, kind string, format string, size_bytes long, created long, body string, version long"), (edges, "id long, input long, version long"))]
    rows, refused = bundle.bundle_rows(*given, 1)
    bundle.write_bundles(rows, f"file://{tmp_path}/a", archive=True)
    read, stated = bundle.read_bundles(spark, f"file://{tmp_path}/a")
    assert refused.count() == 0 and read.count() == 300 * 39 and bundle.bundle_violations(read, stated).count() == 0
    assert sum(map(os.path.getsize, glob.glob(f"{tmp_path}/a/bundles/part-*"))) < 300 * 39 * len(body(0)) / 10


def test_a_manifest_is_made_of_what_placed_the_lines(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    monkeypatch.setattr(bundle, "PIECE", 7)
    monkeypatch.setattr(bundle, "shared_folder", lambda s: f"file://{tmp_path}/m")
    written, write = {}, DataFrameWriter.json

    def kept(self, path, *a, **k):
        written[path.split("/")[-1]] = self._df._jdf.queryExecution().executedPlan().toString()
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "json", kept)
    got = bundle.k6_manifest(spark, SMALL).count()
    assert "to_json" not in written["manifest"] and written["manifest"].count("Exchange") == 1
    rows, stated = bundle.read_bundles(spark, f"file://{tmp_path}/m/bundles")
    again = bundle.manifest(rows)
    assert got == stated.count() > 20 and stated.select(sorted(stated.columns)).exceptAll(again.select(sorted(again.columns))).count() == 0 == bundle.bundle_violations(rows, stated).count()


def test_artifacts_that_a_source_has_twice_are_in_a_bundle_twice(spark):
    rows = [(1, i, "h", "f", "media", None, 3, 9 - i, None, 1) for i in (1, 2, 2, 3)] + [(1, 3, "g", "f", "media", None, 5, 1, None, 1), (2, 2, "h", "f", "media", None, 3, 0, None, 1)]
    artifacts = spark.createDataFrame(rows, "source_id long, id long, sha256 string, fingerprint string, kind string, format string, size_bytes long, created long, body string, version long")
    roots = spark.createDataFrame([(7, 1, 1, 1), (8, 2, 2, 1), (9, 2, 1, 1), (10, None, 2, 1), (11, 1, None, 1)], "run long, source_id long, id long, version long")
    got, refused = bundle.bundle_rows(roots, artifacts, spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1)], "id long, input long, version long"), 1)
    assert [(r["run"], r["position"], r["id"], r["sha256"]) for r in got.orderBy("run", "position").collect()] == [(7, 0, 3, "g"), (7, 1, 3, "h"), (7, 2, 2, "h"), (7, 3, 2, "h"), (7, 4, 1, "h")]
    assert sorted(map(str, refused.collect())) == sorted(map(str, [r for r in spark.createDataFrame([(8, 3, "absent"), (9, 1, "absent"), (9, 3, "absent"), (10, 2, "absent"), (10, 3, "absent"), (11, None, "absent")], refused.schema).collect()]))
