"""Work items against a plain union of sets, bounds that refuse rather than cut, and the ledger of repeated runs."""

import random

from lexiline.operators import repairs

FINDINGS, NAMED, OPPS = "source_id long, finding_id string, place long, severity string", "source_id long, finding_id string, kind string, id string", "source_id long, id string, candidate_id string"


def by_sets(findings, named, opps):
    out = []
    for source in {f[0] for f in findings}:
        groups = []  # (places, findings, candidates, opportunities)
        for _, fid, place, severity in sorted((f for f in findings if f[0] == source), key=lambda f: f[2]):
            if severity != "required":
                continue
            mine = {("candidate", x[3]) for x in named if x[:2] == (source, fid) and x[2] == "candidate"}
            mine |= {("opportunity", x[3]) for x in named if x[:2] == (source, fid) and x[2] == "opportunity"} | {("opportunity", o[1]) for o in opps if o[0] == source and ("candidate", o[2]) in mine}
            met = [g for g in groups if g[2] & mine]
            groups = [g for g in groups if not g[2] & mine] + [(min([place, *(g[0] for g in met)]), {fid}.union(*(g[1] for g in met)), mine.union(*(g[2] for g in met)))]
        for n, (_, fs, things) in enumerate(sorted(groups, key=lambda g: g[0])):
            c, o = sum(k == "candidate" for k, _ in things), sum(k == "opportunity" for k, _ in things)
            why = "no_authority" if not things else "findings" if len(fs) > 12 else "candidates" if c > 8 else "opportunities" if o > 24 else None
            out.append((source, n, len(fs), c, o, why))
    return sorted(out, key=str)


def test_work_items_equal_a_union_of_sets(spark):
    rng = random.Random(5)
    findings, named, opps = [], [], []
    for source in range(12):
        wide = source % 4 == 0
        for place in range(30):
            fid = f"f{place}"
            findings.append((source, fid, place, rng.choice(["required", "required", "unknown"])))
            named += [(source, fid, rng.choice(["candidate", "opportunity"]), f"x{rng.randrange(25 if wide else 400)}") for _ in range(rng.randint(0, 2))]
        opps += [(source, f"o{rng.randrange(40)}", f"x{rng.randrange(25 if wide else 400)}") for _ in range(30)]
    frames = spark.createDataFrame(findings, FINDINGS), spark.createDataFrame(named, NAMED), spark.createDataFrame(opps, OPPS)
    items, members = repairs.repair_work_items(*frames)
    rows = [tuple(r) for r in items.collect()]
    assert sorted(rows, key=str) == by_sets(findings, named, opps)
    counts = {}
    for r in members.collect():
        counts.setdefault((r["source_id"], r["ordinal"]), []).append(r["kind"])
    assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in rows} == {k: tuple(v.count(x) for x in ("finding", "candidate", "opportunity")) for k, v in counts.items()}


def test_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], FINDINGS), spark.createDataFrame([], NAMED), spark.createDataFrame([], OPPS)
    assert repairs.repair_work_items(*none)[0].count() == 0
    items, _ = repairs.repair_work_items(spark.createDataFrame([(1, "a", 0, "required"), (1, None, 1, "required"), (None, "a", 0, "required"), (1, "b", 2, None)], FINDINGS), spark.createDataFrame([(1, "a", "candidate", None), (1, "b", "candidate", "c")], NAMED), none[2])
    assert [tuple(r) for r in items.collect()] == [(1, 0, 1, 0, 0, "no_authority")]


def test_a_repeated_run_adds_nothing_and_smaller_artifacts_give_a_negative_entry(spark):
    art, inc, led, run = "source_id long, kind string, size_bytes long", "source_id long, kind string, size_bytes long, ord long", "source_id long, kind string, category string, quantity long, key string", "source_id long, run long, duration_ms long"
    stored = spark.createDataFrame([(1, "a", 10), (1, "b", 5), (3, "a", 9)], art)
    incoming = spark.createDataFrame([(1, "a", 99, 0), (1, "a", 2, 1), (2, "a", None, 0)], inc)
    ledger = spark.createDataFrame([(1, "storage_bytes", "artifacts", 15, None), (1, "storage_bytes", "master", 1000, None)], led)
    runs = spark.createDataFrame([(1, 7, 2500), (1, 7, 2500), (2, 8, 3500)], run)
    after, entries = repairs.metered(stored, incoming, ledger, runs)
    assert sorted(tuple(r) for r in after.filter("source_id <> 2").collect()) == [(1, "a", 2), (1, "b", 5), (3, "a", 9)]
    rows = sorted((tuple(r) for r in entries.collect()), key=str)
    assert rows == [(1, "processing_seconds", None, 2, "processing:1:7"), (1, "storage_bytes", "artifacts", -8, None), (2, "processing_seconds", None, 4, "processing:2:8")]
    again = repairs.metered(after, incoming.filter("false"), ledger.unionByName(spark.createDataFrame(rows, led)), runs)[1]
    assert again.count() == 0
