"""Corrections by literal cases; review logs against replaying, for each revision, the commands that it rests on."""

import random
from fractions import Fraction

from lexiline.operators.compile import closure
from lexiline.operators.patch import CANDIDATE, patch_refusals, patched_plans, remapped_opportunities, reviewed, section_lineage

CANDIDATES = "plan long, id string, first long, last long, title string, purpose string"
OPS = f"plan long, op string, kind string, parents array<string>, children array<{CANDIDATE}>"
COMMANDS = "plan long, reason string, seconds double, method string, key string"
BASE = [("a", 0, 4, "A", "p"), ("b", 5, 9, "B", "p"), ("c", 10, 14, "C", "p"), ("d", 15, 19, "D", None)]
OK = ("why", None, None)
#: operations of a plan, its command, and the rules they break
CASES = [
    ([("1", "retitle", ["a"], [("a", 0, 4, "New", "p")]), ("2", "drop", ["b"], []), ("3", "split", ["c"], [("c1", 10, 11, "x", "p"), ("c2", 12, 14, "y", "p")])], OK, set()),
    ([("1", "merge", ["a", "b"], [("ab", 0, 9, "AB", "p")]), ("2", "add", [], [("z", 3, 6, "Z", "p")]), ("3", "adjust_extent", ["d"], [("d", 15, 18, "D", None)])], ("why", 3.5, "watch"), set()),
    ([("1", "retitle", ["a"], [("a", 0, 5, "New", "p")])], OK, {("1", "content")}),
    ([("1", "retitle", ["d"], [("d", 15, 19, "D", None)])], OK, {("1", "same")}),
    ([("1", "adjust_extent", ["a"], [("q", 0, 5, "A", "p")])], OK, {("1", "kept")}),
    ([("1", "drop", ["x"], []), ("2", "drop", ["a", "a"], [])], OK, {("1", "absent"), ("2", "repeated"), ("2", "count")}),
    ([("1", "drop", ["a"], []), ("2", "split", ["a"], [("s", 0, 1, "s", "p"), ("s", 2, 4, "t", "p")])], OK, {("1", "shared"), ("2", "shared"), ("2", "twice")}),
    ([("1", "merge", ["a"], [("m", 0, 4, "m", "p")]), ("1", "add", [], [("b", 0, 4, "m", "p")]), (" ", "what", [], None)], OK, {("1", "count"), ("1", "identity"), ("1", "known"), (" ", "identity"), (" ", "count")}),
    ([], (" \n", None, None), {(None, "reason")}),
    ([], ("why", float("nan"), "watch"), {(None, "time")}),
    ([], ("why", 1.0, " "), {(None, "time")}),
    ([], ("why", None, "watch"), {(None, "time")}),
    ([("1", "drop", None, None)], (None, -1.0, "watch"), {(None, "reason"), (None, "time"), ("1", "count")}),
]


def test_corrections(spark):
    plans = range(len(CASES))
    candidates = spark.createDataFrame([(p, *c) for p in plans for c in BASE], CANDIDATES)
    ops = spark.createDataFrame([(p, *o) for p in plans for o in CASES[p][0]], OPS)
    commands = spark.createDataFrame([(p, *CASES[p][1], "k" * (300 if p == 1 else 1)) for p in plans], COMMANDS)
    refused = patch_refusals(candidates, ops, commands)
    got = [(r["plan"], r["op"], r["rule"]) for r in refused.collect()]
    assert {p: {(o, r) for q, o, r in got if q == p} for p in plans} == {p: CASES[p][2] for p in plans}
    after, lineage = patched_plans(candidates, ops, refused)
    rows: dict[int, list] = {}
    for r in after.orderBy("plan", "ord").collect():
        rows.setdefault(r["plan"], []).append((r["ord"], r["id"], r["title"], r["replaced"]))
    assert rows[0] == [(0, "a", "New", True), (1, "c1", "x", True), (2, "c2", "y", True), (3, "d", "D", False)]
    assert rows[1] == [(0, "ab", "AB", True), (1, "z", "Z", True), (2, "c", "C", False), (3, "d", "D", True)]
    assert all([i for _, i, _, _ in rows[p]] == ["a", "b", "c", "d"] for p in plans if CASES[p][2])
    assert sorted((r["plan"], r["child"], r["parent"] or "") for r in lineage.collect()) == [(0, "a", "a"), (0, "c1", "c"), (0, "c2", "c"), (1, "ab", "a"), (1, "ab", "b"), (1, "d", "d"), (1, "z", "")]
    opportunities = spark.createDataFrame([(p, f"o{i}", c, "rejected", "r") for p in (0, 1, 2) for i, c in enumerate((["d", "b"], ["b"], [], None, ["c", "a"]))], "plan long, id string, candidates array<string>, disposition string, reason string")
    out = {(r["plan"], r["id"]): (r["candidates"], r["disposition"]) for r in remapped_opportunities(opportunities, after, lineage, ops, refused, commands.select("plan", "key")).collect()}
    assert {i: v for (p, i), v in out.items() if p == 0} == {"o0": (["d"], "proposed"), "o1": ([], "needs_evidence"), "o2": ([], "rejected"), "o3": (None, "rejected"), "o4": ([], "needs_evidence"), "human:k:a": (["a"], "proposed"), "human:k:c1": (["c1"], "proposed"), "human:k:c2": (["c2"], "proposed")}
    assert {v[1] for (p, i), v in out.items() if p == 2} == {"rejected"} and all(len(i) == 70 for (p, i) in out if p == 1 and i.startswith("human:"))


SECTIONS = "plan long, ord long, id string, kind string, title string, flags array<string>, state string, reason string, quotes array<long>, parents string"
BOUNDARIES = "plan long, ord long, id string, num long, den long, risky boolean, reasons array<string>"
LOG = "plan long, seq long, action string, section string, other string, boundary string, target_ms long, target long, reason string, key string"


def apply(sections, cuts, c, rate):
    """One command by the rules, on lists of tuples; None if it is refused."""
    why = (c["reason"] or "").strip()
    ids = [s[0] for s in sections]
    at = ids.index(c["section"]) if ids.count(c["section"]) == 1 else None
    if c["action"] in ("accept", "reject", "restore"):
        if at is None:
            return None
        i, kind, title, flags, state, reason, quotes, parents = sections[at]
        if c["action"] == "accept":
            if not why and (kind == "drop" or cuts[at][2] or cuts[at + 1][2]):
                return None
            flag, state = [f"accepted_reason:{why}"] if why else [], "accepted"
        elif c["action"] == "reject":
            if not why:
                return None
            flag, state = [f"rejected_reason:{why}"], "rejected"
        else:
            if kind != "drop":
                return None
            flag, state, kind = [f"restored_reason:{why}"], "proposed", "keep"
        new = (i, kind, title, tuple(flags) + tuple(f for f in flag if f not in flags), state, reason, quotes, parents)
        return sections[:at] + (new,) + sections[at + 1 :], cuts
    if c["action"] == "merge":
        if at is None or at + 1 >= len(sections) or sections[at + 1][0] != c["other"] or ids.count(c["other"]) != 1 or sections[at][1] != "keep" or sections[at + 1][1] != "keep":
            return None
        a, b = sections[at], sections[at + 1]
        flags = a[3] + tuple(f for f in (*b[3], "manual_merge") if f not in a[3])
        one = (f"merge-{c['key']}", "keep", f"{a[2]} / {b[2]}".strip(" /"), tuple(dict.fromkeys(flags)), "proposed", why or f"Merged {a[0]} and {b[0]}", a[6] + tuple(q for q in b[6] if q not in a[6]), (a[0], b[0]))
        return sections[:at] + (one,) + sections[at + 2 :], cuts[: at + 1] + cuts[at + 2 :]
    if c["action"] == "nudge":
        k = [x[0] for x in cuts].index(c["boundary"]) if [x[0] for x in cuts].count(c["boundary"]) == 1 else None
        if k in (None, 0, len(cuts) - 1) or c["target_ms"] is None:
            return None
        points = [n for n in range(-10, 12_000) if cuts[k - 1][1] < Fraction(n) / rate < cuts[k + 1][1]]
        if not points:
            return None
        best = min(points, key=lambda n: (abs(Fraction(n) / rate - Fraction(c["target_ms"], 1000)), n))
        cut = (cuts[k][0], Fraction(best) / rate, True, (f"manual_nudge:{why or 'manual boundary adjustment'}", f"manual_requested_ms:{c['target_ms']}"))
        mark = lambda s: (*s[:3], s[3] if "manual_boundary_changed" in s[3] else (*s[3], "manual_boundary_changed"), "proposed", *s[5:])
        return sections[: k - 1] + (mark(sections[k - 1]), mark(sections[k])) + sections[k + 1 :], cuts[:k] + (cut,) + cuts[k + 1 :]
    return None


def test_logs_of_200_plans(spark):
    rng = random.Random(17)
    rate = {}
    sections, boundaries, logs, want = [], [], [], {}
    for plan in range(200):
        n = rng.randrange(1, 7)
        rate[plan] = rng.choice([Fraction(25), Fraction(30000, 1001), Fraction(1000), Fraction(1)])
        now = tuple((f"s{i}", rng.choice(["keep", "keep", "drop"]), rng.choice(["T", "", "U /"]), tuple(rng.sample(["x", "manual_merge", "y"], 2)), "proposed", "", tuple(rng.sample(range(9), 3)), ()) for i in range(n))
        cuts = tuple((f"b{i}", Fraction(i * rng.choice([3, 3]), 2), rng.random() < 0.3, ("r",)) for i in range(n + 1))
        sections += [(plan, i, s[0], s[1], s[2], list(s[3]), s[4], s[5], list(s[6]), "clash") for i, s in enumerate(now)]
        boundaries += [(plan, i, c[0], c[1].numerator, c[1].denominator, c[2], list(c[3])) for i, c in enumerate(cuts)]
        # each revision is what its commands make of revision 0; an undo stands for those of its target
        made, chains, log = [(now, cuts)], [[]], []
        for seq in range(rng.randrange(0, 14)):
            ids = [s[0] for s in made[-1][0]] + ["lost"]
            k = rng.randrange(len(ids))
            action = rng.choice(["accept", "reject", "restore", "nudge", "merge", "merge", "undo", "undo", "publish"])
            c = {"action": action, "section": ids[k], "other": ids[min(k + 1, len(ids) - 1)], "boundary": f"b{rng.randrange(n + 2)}", "target_ms": rng.choice([None, rng.randrange(-500, 9000)]), "target": rng.randrange(-1, len(made) + 1) if action == "undo" else None, "reason": rng.choice([None, " ", "\n said "]), "key": f"k{seq}"}
            if action == "undo":
                good = 0 <= c["target"] < len(made) - 1
                chain = chains[c["target"]] if good else None
            else:
                good = action != "publish" and apply(*made[-1], c, rate[plan]) is not None
                chain = [*chains[-1], c] if good else None
            if good:
                state = made[0]
                for step in chain:
                    state = apply(*state, step, rate[plan])
                made.append(state), chains.append(chain)
            log.append((seq, len(made) - 1 if good else None))
            logs.append((plan, seq, *[c[x] for x in ("action", "section", "other", "boundary", "target_ms", "target", "reason", "key")]))
        want[plan] = (log, made)
    rates = spark.createDataFrame([(p, r.numerator, r.denominator) for p, r in rate.items() if r != 1000], "plan long, num long, den long")
    history = reviewed(spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(boundaries, BOUNDARIES), spark.createDataFrame(logs, LOG).repartition(3), rates)
    rows = history.collect()
    for plan, (log, made) in want.items():
        own = sorted((r for r in rows if r["plan"] == plan), key=lambda r: -1 if r["seq"] is None else r["seq"])
        assert [(r["seq"], r["revision"]) for r in own] == [(None, 0), *log] and all((r["refused"] is None) == (r["revision"] is not None) for r in own)
        for r in own:
            if r["revision"] is not None:
                now, cuts = made[r["revision"]]
                assert [tuple(tuple(v) if isinstance(v, list) else v for v in x) for x in r["sections"]] == list(now)
                assert [(b["id"], Fraction(b["num"], b["den"]), b["risky"], tuple(b["reasons"])) for b in r["boundaries"]] == list(cuts)
    undone = [(p, r) for p, (log, made) in want.items() for r in range(2, len(made)) if made[r] == made[r - 2] != made[r - 1]]
    assert len(undone) > 10
    # what a merged section goes back to, over all merges
    edges = section_lineage(history)
    parents = {}
    for r in edges.collect():
        parents.setdefault((r["plan"], r["child"]), set()).add(r["parent"])
    assert parents == {(p, s[0]): {x for _, m in [want[p]] for st in m for y in st[0] if y[0] == s[0] for x in y[7]} for p, (_, made) in want.items() for st in made for s in st[0] if s[7]}
    from pyspark.sql import functions as F

    named = edges.select(F.concat_ws("|", "plan", "child").alias("a"), F.concat_ws("|", "plan", "parent").alias("b"))
    reached = closure(named, named.select(F.col("a").alias("root"), F.col("a").alias("node")).distinct()).collect()
    assert any("merge" in r["node"] and r["node"] != r["root"] for r in reached), "merges of merges lead back"
