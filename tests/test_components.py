"""Components of chains, stars and loops in few rounds, closures level by level, and bundles in archives."""

import glob

from lexiline.operators import bundle
from lexiline.operators import compile as plans


def test_components_in_few_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "shared_folder", lambda s: f"file://{tmp_path}/c")
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(3000)]
    star = [("hub", f"s{i}") for i in range(500)]
    edges = chain + star + [("alone", "alone"), ("x", "y"), ("y", "x"), (None, "half")]
    got = {r["node"]: r["component"] for r in plans.components_of(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {n: "c0000" for e in chain for n in e} | {n: "hub" for e in star for n in e} | {"alone": "alone", "x": "x", "y": "x", "half": "half"}
    assert got == want
    assert 1 < len(glob.glob(f"{tmp_path}/c/edges-*")) <= 13


def test_closure_writes_each_level_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "shared_folder", lambda s: f"file://{tmp_path}/r")
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (4, 6), (1, 4)]
    got = sorted(map(tuple, plans.closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(1, 1), (5, 5), (9, 9), (1, 1)], "root long, node long")).collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 6), (5, 5), (9, 9)]
    level = lambda k: sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/r/reached-{k}").collect()))
    assert [level(k) for k in range(4)] == [[(1, 1), (5, 5), (9, 9)], [(1, 2), (1, 4)], [(1, 3), (1, 6)], []]


def test_bundles_in_an_archive(spark, tmp_path):
    rows = spark.createDataFrame([(r, p, r * 10 + p, "h", "f", "edit", None, 3, 1, [], "included", "{}") for r in range(30) for p in range(3)], f"run long, position long, {bundle.LINE}")
    for at, archive in (("folders", False), ("archive", True)):
        bundle.write_bundles(rows, f"file://{tmp_path}/{at}", archive)
    read = [[sorted(map(str, df.select(sorted(df.columns)).collect())) for df in bundle.read_bundles(spark, f"file://{tmp_path}/{at}")] for at in ("folders", "archive")]
    assert read[0] == read[1] and len(read[0][0]) == 90
    assert len(glob.glob(f"{tmp_path}/folders/bundles/run=*")) == 30 and not glob.glob(f"{tmp_path}/archive/bundles/run=*")
    assert sorted(r["rule"] for r in bundle.bundle_violations(*bundle.read_bundles(spark, f"file://{tmp_path}/archive")).collect()) == ["body"] * 30
