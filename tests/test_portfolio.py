"""Rules of portfolio reviews: a review that keeps all of them, one review for each way to break one, nulls and empty tables."""

import copy

from lexiline.operators import portfolio
from lexiline.plans import rules

SPANS = "array<struct<first:bigint,last:bigint>>"
SCHEMAS = {
    "candidates": "source_id long, candidate_id long, first long, last long", "opportunities": "source_id long, id long", "cores": "source_id long, opportunity_id long, first long, last long", "contexts": "source_id long, candidate_id long, first long, last long",
    "decisions": f"source_id long, candidate_id long, disposition string, spans {SPANS}", "judgments": f"source_id long, opportunity_id long, status string, candidates array<long>, spans {SPANS}", "missing": "source_id long, id long, disposition string, candidates array<long>",
    "findings": f"source_id long, id long, kind string, severity string, candidates array<long>, opportunities array<long>, spans {SPANS}", "overlaps": "source_id long, a_id long, b_id long, first long, last long, classification string",
    "handoffs": "source_id long, place long, candidate_id long, next_id long, before_first long, before_last long, after_first long, after_last long, classification string, left_last long, right_first long",
}


def clean():
    """Candidates 1 (0-40), 2 (30-50), 3 (60-99) and 4 (101-103): 1 and 2 overlap, 2 and 3 are neighbours, and 3 and 4."""
    return {
        "candidates": [(1, 0, 40), (2, 30, 50), (3, 60, 99), (4, 101, 103)], "opportunities": [(7,), (8,)], "cores": [(7, 2, 3), (7, 38, 40), (8, 70, 71)], "contexts": [(1, 30, 34), (1, 35, 40), (2, 20, 45)],
        "decisions": [(1, "select", [(0, 1)]), (2, "select", None), (3, "decline", []), (4, "select", [])], "judgments": [(7, "represented", [1], [(2, 3)]), (8, "missing_candidate", [], None)], "missing": [(20, "needs_evidence", None)],
        "findings": [(1, "unfocused_extent", "required", [2, 3], [8], [(50, 60)]), (2, "missed_opportunity", "required", [], [20], []), (3, "other", "unknown", None, None, None)], "overlaps": [(1, 2, 30, 40, "necessary_shared_context")],
        "handoffs": [(0, 2, 3, 35, 50, 60, 75, "misallocated_topic_extent", 48, 62), (1, 3, 4, 84, 99, 101, 103, "clean", None, None)],
    }


def put(name, at, **changes):
    def change(t):
        fields = [f.split()[0] for f in SCHEMAS[name].split(", ")][1:]
        t[name][at] = tuple(changes.get(f, v) for f, v in zip(fields, t[name][at], strict=True))

    return change


def add(name, *rows):
    return lambda t: t[name].extend(rows)


def drop(name, at):
    return lambda t: t[name].pop(at)


def twice(name):
    return lambda t: t[name].append(t[name][0])


CHANGES = [
    (drop("decisions", 0), {"undecided", "unrepresented"}), (twice("decisions"), {"repeated_decision"}), (add("decisions", (9, "select", None)), {"unknown_candidate"}), (put("decisions", 0, spans=[(1, 0)]), {"decision_span"}), (put("decisions", 0, spans=[(None, 0)]), {"decision_span"}),
    (put("decisions", 3, disposition="decline"), {"declined"}), (put("decisions", 0, disposition=None), {"unrepresented"}), (drop("judgments", 1), {"unjudged"}), (twice("judgments"), {"repeated_judgment"}), (add("judgments", (9, "unclear", [], None)), {"unknown_opportunity"}),
    (put("judgments", 1, candidates=[9]), {"judgment_candidate"}), (put("judgments", 0, candidates=[1, 1]), {"repeated_candidate"}), (put("judgments", 0, candidates=None), {"unrepresented"}), (put("judgments", 0, candidates=[3]), {"unrepresented", "core_outside"}), (put("judgments", 0, spans=[(4, None)]), {"judgment_span"}),
    (put("judgments", 0, status="missing_candidate"), {"missing_finding"}), (put("cores", 1, last=41), {"core_outside"}), (put("cores", 0, first=None), {"core_outside"}), (twice("missing"), {"repeated_missing"}), (add("opportunities", (20,)), {"not_new", "unjudged"}), (put("missing", 0, candidates=[1]), {"invented"}),
    (put("missing", 0, disposition=None), {"invented"}), (put("findings", 1, severity="unknown"), {"omission_finding"}), (twice("findings"), {"repeated_finding"}), (put("findings", 0, candidates=[2, 3, 9]), {"finding_candidate"}), (put("findings", 2, opportunities=[9]), {"finding_opportunity"}), (put("findings", 0, candidates=[2, 3, 3]), {"finding_repeats"}),
    (put("findings", 2, severity="required"), {"no_object"}), (put("findings", 2, kind="physical_boundary_constraint"), {"physical"}), (put("findings", 0, spans=[(50, 60), (2, 1)]), {"finding_span"}), (drop("overlaps", 0), {"unjudged_overlap"}), (twice("overlaps"), {"repeated_overlap"}), (add("overlaps", (1, 3, 40, 60, "distinct")), {"unknown_overlap"}),
    (put("overlaps", 0, last=39), {"changed_overlap"}), (put("overlaps", 0, classification="duplicate_core"), {"overlap_finding"}), (put("overlaps", 0, classification=None), set()), (put("contexts", 1, first=36), {"shared_context"}), (drop("contexts", 2), {"shared_context"}), (drop("handoffs", 1), {"unjudged_handoff"}), (twice("handoffs"), {"repeated_handoff"}),
    (add("handoffs", (2, 1, 2, 1, 2, 3, 4, "clean", None, None)), {"unknown_handoff"}), (put("handoffs", 1, place=2), {"handoff_order"}), (put("handoffs", 0, before_first=36), {"changed_handoff"}), (put("handoffs", 1, left_last=99), {"edges"}), (put("handoffs", 0, right_first=None), {"edges"}), (put("handoffs", 0, left_last=62), {"edges"}), (put("handoffs", 0, left_last=34), {"edges"}),
    (put("findings", 0, spans=[(0, 34), (76, 80)]), {"handoff_finding"}), (put("findings", 0, candidates=[3]), {"handoff_finding"}),
]
CHANGES.append((lambda t: (put("overlaps", 0, classification="duplicate_core")(t), add("findings", (9, "duplicate_core", "required", [2, 1], [], [(30, 40)]))(t)), set()))
CHANGES.append((lambda t: (put("overlaps", 0, classification="misallocated_topic_extent")(t), add("findings", (9, "unfocused_extent", "required", [1, 2], [], [(30, 39)]))(t)), {"overlap_finding"}))


def frames(spark, reviews):
    return {name: spark.createDataFrame([(s, *row) for s, t in reviews.items() for row in t[name]], schema) for name, schema in SCHEMAS.items()}


def test_each_rule_by_itself(spark):
    reviews, want = {0: clean()}, {0: set()}
    for n, (change, broken) in enumerate(CHANGES, 1):
        reviews[n], want[n] = copy.deepcopy(clean()), broken
        change(reviews[n])
    rows = [tuple(r) for r in portfolio.portfolio_violations(frames(spark, reviews)).collect()]
    assert len(rows) == len(set(rows))
    got = {n: set() for n in reviews}
    for source, _, _, rule in rows:
        got[source].add(rule)
    assert {n: (got[n], want[n]) for n in got if got[n] != want[n]} == {}
    known = {r.unique if isinstance(r, rules.Has) else r.rule for _, listed in portfolio.CATALOGUE.values() for r in listed} - {None}
    assert set().union(*want.values()) == known | {"shared_context", "overlap_finding", "handoff_finding", "core_outside"}


def test_empty_tables(spark):
    assert portfolio.portfolio_violations(frames(spark, {})).count() == 0
