"""Bundles, written and read again, against a closure in plain Python; and changed files."""

import hashlib
import json

from lexiline.operators.bundle import FORMATS, bundle_rows, bundle_violations, manifest, read_bundles, write_bundles

ROOTS = "run long, source_id long, id long, version long"
ARTIFACTS = "source_id long, id long, sha256 string, fingerprint string, kind string, format string, size_bytes long, created long, body string, version long"
EDGES = "id long, input long, version long"


def artifact(source, ident, version=1, kind="evidence", form=None, body=None, good=True, created=None):
    body = json.dumps({"id": ident, "text": "é\n"}) if body is None else body
    return (source, ident, hashlib.sha256((body if good else "x").encode()).hexdigest(), "f", kind, form, len(body), 100 - ident if created is None else created, body, version)


def given():
    artifacts = [artifact(1, i, kind=("evidence", "edit", "model_response", "media")[i % 4], form=FORMATS[0] if i == 7 else None, created=i // 3) for i in range(12)]
    artifacts += [artifact(1, 50, version=3), artifact(2, 20), artifact(1, 60, good=False), artifact(1, 62, kind="media", good=False)]
    edges = [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1), (3, 4, 1), (4, 3, 1), (5, 6, 1), (0, 50, 3), (7, 20, 1), (8, 60, 1), (9, 99, 1), (10, 62, 1), (0, 1, 2)]
    roots = [(100, 1, 0, 1), (100, 1, 11, 1), (100, 1, 50, 3), (101, 1, 5, 1), (102, 1, 7, 1), (103, 1, 8, 1), (104, 1, 9, 1), (105, 1, 10, 1), (106, 1, 3, 4), (100, 1, 0, 2)]
    return roots, artifacts, edges


def closed(roots, artifacts, edges, version):
    edges = [(a, b) for a, b, v in edges if v <= version]
    known = {(s, i): x for x in artifacts for s, i in [x[:2]] if x[-1] <= version}
    out, refused = {}, set()
    for run in {r[0] for r in roots if r[3] <= version}:
        seen, todo = set(), {r[2] for r in roots if r[0] == run and r[3] <= version}
        while todo:
            seen |= todo
            todo = {b for a, b in edges if a in todo} - seen
        source = next(r[1] for r in roots if r[0] == run)
        out[run] = seen
        for i in seen:
            x = known.get((source, i))
            if x is None:
                refused.add((run, i, "absent"))
            elif (x[4] in ("evidence", "edit", "checks") or x[5] in FORMATS) and hashlib.sha256(x[8].encode()).hexdigest() != x[2]:
                refused.add((run, i, "body"))
    return {run: ids for run, ids in out.items() if run not in {r for r, _, _ in refused}}, refused


def frames(spark):
    roots, artifacts, edges = given()
    return spark.createDataFrame(roots, ROOTS), spark.createDataFrame(artifacts, ARTIFACTS), spark.createDataFrame(edges, EDGES)


def test_bundles_are_the_closure_at_a_moment(spark, tmp_path):
    for version in (1, 3):
        rows, refused = bundle_rows(*frames(spark), version)
        want, why = closed(*given(), version)
        assert {tuple(r) for r in refused.collect()} == why
        path = f"file://{tmp_path}/v{version}"
        write_bundles(rows, path)
        read, stated = read_bundles(spark, path)
        got: dict[int, list] = {}
        for r in read.orderBy("run", "position").collect():
            got.setdefault(r["run"], []).append(r)
        assert {run: {r["id"] for r in own} for run, own in got.items()} == want and (50 in want[100]) == (version == 3)
        artifacts = {x[1]: x for x in given()[1]}
        for own in got.values():
            assert [(r["position"], r["created"], r["id"]) for r in own] == [(k, c, i) for k, (c, i) in enumerate(sorted((artifacts[r["id"]][7], r["id"]) for r in own))]
            for r in own:
                assert r["dependencies"] == sorted({b for a, b, v in given()[2] if a == r["id"] and v <= version})
                included = artifacts[r["id"]][4] in ("evidence", "edit") or artifacts[r["id"]][5] == FORMATS[0]
                assert (r["body_status"] == "included") == included and r["body"] == (artifacts[r["id"]][8] if included else None)
        assert {r["run"]: (r["artifacts"], r["bytes"]) for r in stated.collect()} == {run: (len(ids), sum(artifacts[i][6] for i in ids)) for run, ids in want.items()}
        assert bundle_violations(read, stated).collect() == []


def test_changed_bundles_are_seen(spark):
    rows, _ = bundle_rows(*frames(spark), 1)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    stated = manifest(rows)
    stated = spark.createDataFrame(stated.collect(), stated.schema)
    said = lambda r, s=stated: {tuple(x) for x in bundle_violations(r, s).collect()}
    assert said(rows) == set()
    assert said(rows.filter("not (run = 100 and id = 3)")) == {(100, "changed"), (100, "open")}
    assert said(rows.replace("f", "g", "fingerprint").filter("run = 101"), stated.filter("run = 101")) == {(101, "changed")}
    assert said(rows.filter("run <> 101")) == {(101, "missing")} and said(rows, stated.filter("run <> 101")) == {(101, "unlisted")}
    from pyspark.sql import functions as F

    assert said(rows.withColumn("body", F.when(F.col("id") == 0, "{}").otherwise(F.col("body")))) == {(100, "changed"), (100, "body")}
    reordered = rows.withColumn("position", F.when((F.col("run") == 101) & (F.col("position") < 2), 1 - F.col("position")).otherwise(F.col("position")))
    assert said(reordered) == {(101, "changed")}


def test_pieces_and_empty_tables(spark, tmp_path, monkeypatch):
    from lexiline.operators import bundle

    monkeypatch.setattr(bundle, "PIECE", 2)
    rows, _ = bundle_rows(*frames(spark), 1)
    write_bundles(rows, f"file://{tmp_path}/a")
    assert bundle_violations(*read_bundles(spark, f"file://{tmp_path}/a")).collect() == []
    none, refused = bundle_rows(*(df.limit(0) for df in frames(spark)), 1)
    assert none.collect() == [] == refused.collect() and manifest(none).collect() == []
