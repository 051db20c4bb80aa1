"""Admission of shards: a plan that is whole, each fault by itself, nulls and empty tables, and random manifests against a loop over lists."""

import random

from lexiline.operators import shards

PLANS = "plan long, kind string, sha256 string, basis string"
ITEMS = "plan long, place long, item string, first long, last long, discovers boolean"
ASSIGNED = "plan long, item string, role string, place long, id string"
SCOPE = "plan long, item string, role string, id string"
SHARDS = "plan long, place long, item string, first long, last long, plan_sha256 string, basis string, family string, stored_kind string, stored_sha256 string, sha256 string"
ENTRIES = "plan long, shard long, role string, place long, id string, anchor long"
REFS = "plan long, shard long, role string, id string"
WHOLE = "plan long, role string, place long, id string"
SCHEMAS = (PLANS, ITEMS, ASSIGNED, SCOPE, SHARDS, ENTRIES, REFS, WHOLE)


def run(spark, *tables):
    return shards.shard_violations(*[spark.createDataFrame(rows, schema) for rows, schema in zip(tables, SCHEMAS, strict=True)])


def found(spark, *tables):
    return sorted((r["plan"], -1 if r["shard"] is None else r["shard"], r["rule"], r["id"] or "") for r in run(spark, *tables).collect())


def shard(plan, place, item, kind, first=None, last=None, **other):
    return tuple(({"plan": plan, "place": place, "item": item, "first": first, "last": last, "plan_sha256": "p", "basis": "b", "family": "f", "stored_kind": kind, "stored_sha256": "h", "sha256": "h"} | other).values())


def test_whole_plans_break_nothing(spark):
    plans = [(1, "inventory", "p", "b"), (2, "author", "p", "b"), (3, "review", "p", "b"), (4, "repair", "p", "b")]
    items = [(1, 0, "s1", 0, 9, None), (1, 1, "s2", 10, 19, None), (2, 0, "w1", None, None, None), (2, 1, "w2", None, None, None), (3, 0, "r1", 0, 9, True), (4, 0, "c1", None, None, None)]
    assigned = [(2, "w1", "opportunity", 0, "a"), (2, "w2", "opportunity", 0, "b"), (2, "w2", "opportunity", 1, "c"), (3, "r1", "candidate", 0, "k"), (4, "c1", "finding", 0, "f")]
    given = [shard(1, 0, "s1", "proposal", 0, 9, family=None), shard(1, 1, "s2", "proposal", 10, 19), shard(2, 0, "w1", "proposal"), shard(2, 1, "w2", "proposal"), shard(3, 0, "r1", "checks", 0, 9), shard(4, 0, "c1", None)]
    entries = [
        (1, 0, "opportunity", 0, "s1:x", 9), (1, 1, "opportunity", 0, "s2:x", 10), (2, 0, "opportunity", 0, "a", None), (2, 1, "opportunity", 0, "b", None), (2, 1, "opportunity", 1, "c", None), (2, 1, "candidate", 0, "w2:candidate:1", None), (2, 1, "mapped", 0, "w2:candidate:1", None),
        (3, 0, "candidate", 0, "k", None), (3, 0, "missing", 0, "r1:missing:1", 3), (4, 0, "finding", 0, "f", None), (4, 0, "finding", 1, "f", None), (4, 0, "candidate_write", 0, "k", None), (4, 0, "candidate_write", 1, "k", None),
    ]
    whole = [(2, "opportunity", 0, "a"), (2, "opportunity", 1, "b"), (2, "opportunity", 2, "c"), (3, "candidate", 0, "k")]
    refs = [(3, 0, "opportunity", "r1:missing:1"), (3, 0, "candidate", "k")]
    assert found(spark, plans, items, assigned, [(3, "r1", "candidate", "k")], given, entries, refs, whole) == []


def test_nulls_empty_tables_and_strange_plans(spark):
    assert found(spark, *[[]] * 8) == []
    plans, items = [(1, "inventory", "p", "b")], [(1, 0, "s1", 0, 9, None), (1, 1, "s2", 9, 19, None), (1, 2, "s3", 8, 2, None)]
    given = [shard(1, 0, "s1", "proposal", 0, 9), shard(1, 1, None, None, None, None), shard(7, 0, "s1", "proposal"), shard(None, 0, "s1", "proposal")]
    entries = [(1, 0, "opportunity", 0, None, None), (7, 0, "opportunity", 0, "s1:x", 1)]
    rules = [(1, 0, "anchor", ""), (1, 0, "namespace", ""), (1, 1, "artifact", "s2"), (1, 1, "moved", "s2"), (1, 1, "overlap", "s2"), (1, 2, "missing", "s3"), (1, 2, "overlap", "s3"), (1, 2, "reversed", "s3"), (7, 0, "no_plan", "s1")]
    rows = run(spark, plans, items, [], [], given, entries, [], []).collect()
    assert sorted((r["plan"], r["shard"], r["rule"], r["id"] or "") for r in rows if r["plan"] is not None) == rules
    assert [(r["rule"], r["id"]) for r in rows if r["plan"] is None] == [("no_plan", "s1")]


def test_random_author_and_repair_manifests_equal_a_loop(spark):
    rng = random.Random(11)
    plans, items, assigned, given, entries, whole, want = [], [], [], [], [], [], []
    for p in range(60):
        kind = rng.choice(["author", "repair"])
        plans.append((p, kind, "p", "b"))
        names, n, said_all, seen = [f"w{i}" for i in range(4)], 0, [], {}
        due_all = []
        for i, item in enumerate(names):
            items.append((p, i, item, None, None, None))
            given.append(shard(p, i, item, "proposal"))
            due = [f"n{n + j}" for j in range(rng.randint(0, 3))]
            n += len(due)
            due_all += due
            role = "opportunity" if kind == "author" else "finding"
            assigned += [(p, item, role, j, x) for j, x in enumerate(due)]
            said = list(due)
            if said and rng.random() < 0.4:
                said[rng.randrange(len(said))] = f"n{rng.randint(0, 9)}"
            if said and rng.random() < 0.3:
                said.pop()
            entries += [(p, i, role, j, x, None) for j, x in enumerate(said)]
            if kind == "author":
                said_all += [(i, x) for x in said]
                want += [(p, i, "assignment", said[j] if j < len(said) else due[j]) for j in range(len(due)) if j >= len(said) or said[j] != due[j]]
            else:
                want += [(p, i, "unanswered", x) for x in set(due) - set(said)] + [(p, i, "foreign", x) for x in set(said) - set(due)]
                writes = [f"c{rng.randint(0, 5)}" for _ in range(3)]
                entries += [(p, i, "candidate_write", j, x, None) for j, x in enumerate(writes)]
                for x in sorted(set(writes)):
                    if x in seen:
                        want.append((p, i, "conflict", x))
                    seen.setdefault(x, i)
        if kind == "author":
            whole += [(p, "opportunity", j, x) for j, x in enumerate(due_all)]
            want += [(p, i, "order", x) for j, (i, x) in enumerate(said_all) if j >= len(due_all) or due_all[j] != x]
            want += [(p, -1, "undecided", x) for x in due_all if x not in {y for _, y in said_all}]
    assert found(spark, plans, items, assigned, [], given, entries, [], whole) == sorted(want)
