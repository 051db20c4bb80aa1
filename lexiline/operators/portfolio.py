"""Reviews of a source's candidates as a whole: that everything is assessed once, that overlaps and handoffs are those that the candidates have, and that each complaint has its finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.intervals import CANDIDATES_SQL, HANDOFF_CONTEXT, candidates, handoffs, overlap_pairs, subtracted
from lexiline.operators.segment import GRID_SQL
from lexiline.plans.rules import Breaks, Has, Lacks, Needs, violations
from lexiline.plans.shared import stored

# fixed values: the finding that a kind of overlap asks for
REQUIRED_KIND = {"misallocated_topic_extent": "unfocused_extent", "duplicate_core": "duplicate_core"}
_REVERSED = "exists(coalesce(spans, array()), v -> not coalesce(v.first <= v.last, false))"
_REPEATS = lambda c: f"size(array_distinct(coalesce({c}, array()))) < size(coalesce({c}, array()))"
_NONE = lambda c: f"size(coalesce({c}, array())) = 0"

#: of each table: how a row is called, and its rules; spans are positions of sentences, null where there is no such sentence
CATALOGUE: dict[str, tuple[str, list]] = {
    # source_id, candidate_id, first, last
    "candidates": ("candidate_id", [Has("candidate", ("candidate_id",)), Needs("undecided", "decision", ("candidate_id",))]),
    "opportunities": ("id", [Has("opportunity", ("id",)), Has("named", ("id",)), Needs("unjudged", "judgment", ("id",))]),  # source_id, id
    # source_id, candidate_id, disposition, spans
    "decisions": ("candidate_id", [
        Has("decision", ("candidate_id",), unique="repeated_decision"), Has("selected", ("candidate_id",), "disposition = 'select'"), Needs("unknown_candidate", "candidate", ("candidate_id",)), Breaks("decision_span", _REVERSED),
        Needs("declined", "required_candidate", ("candidate_id",), "disposition = 'decline'"),
    ]),
    # source_id, opportunity_id, status, candidates, spans
    "judgments": ("opportunity_id", [
        Has("judgment", ("opportunity_id",), unique="repeated_judgment"), Needs("unknown_opportunity", "opportunity", ("opportunity_id",)), Needs("judgment_candidate", "candidate", ("x",), each="candidates"), Breaks("repeated_candidate", _REPEATS("candidates")), Breaks("judgment_span", _REVERSED),
        Breaks("unrepresented", f"status = 'represented' and {_NONE('candidates')}"), Needs("unrepresented", "selected", ("x",), "status = 'represented'", each="candidates"), Needs("missing_finding", "required_opportunity", ("opportunity_id",), "status = 'missing_candidate'"),
    ]),
    # source_id, id, disposition, candidates
    "missing": ("id", [
        Has("missing", ("id",), unique="repeated_missing"), Has("named", ("id",)), Lacks("not_new", "opportunity", ("id",)), Breaks("invented", f"not ({_NONE('candidates')} and disposition <=> 'needs_evidence')"), Needs("omission_finding", "omission", ("id",)),
    ]),
    # source_id, id, kind, severity, candidates, opportunities, spans
    "findings": ("id", [
        Has("finding", ("id",), unique="repeated_finding"), Has("required_candidate", ("x",), "severity = 'required'", each="candidates"), Has("required_opportunity", ("x",), "severity = 'required'", each="opportunities"),
        Has("omission", ("x",), "severity = 'required' and kind = 'missed_opportunity'", each="opportunities"), Needs("finding_candidate", "candidate", ("x",), each="candidates"), Needs("finding_opportunity", "named", ("x",), each="opportunities"),
        Breaks("finding_repeats", f"{_REPEATS('candidates')} or {_REPEATS('opportunities')}"), Breaks("no_object", f"{_NONE('candidates')} and {_NONE('opportunities')} and not severity <=> 'unknown'"), Breaks("physical", "kind = 'physical_boundary_constraint'"), Breaks("finding_span", _REVERSED),
    ]),
    # what the candidates have: source_id, a_id, b_id, first, last
    "overlap_rows": ("concat(a_id, ':', b_id)", [
        Has("overlap_row", ("a_id", "b_id"), value="concat_ws('-', first, last)"), Has("overlap_span", ("concat_ws('-', first, last)", "a_id", "b_id", "first", "last")), Needs("unjudged_overlap", "overlap", ("a_id", "b_id")),
    ]),
    # what the review says of them: the same, and classification
    "overlaps": ("concat(a_id, ':', b_id)", [
        Has("overlap", ("a_id", "b_id"), unique="repeated_overlap"), Needs("unknown_overlap", "overlap_row", ("a_id", "b_id")), Needs("changed_overlap", "overlap_row", ("a_id", "b_id"), after="overlap_span", rest=("a_id", "b_id", "first", "last"), lenient=True),
    ]),
    # source_id, place, candidate_id, next_id, before_first, before_last, after_first, after_last
    "handoff_rows": ("concat(candidate_id, ':', next_id)", [Has("handoff_row", ("candidate_id", "next_id"), value="place"), Has("handoff_span", ("place", "candidate_id", "next_id", "before_first", "before_last", "after_first", "after_last")), Has("handoff_at", ("place", "place", "candidate_id", "next_id")), Needs("unjudged_handoff", "handoff", ("candidate_id", "next_id"))]),
    # the same, and classification, left_last, right_first: the edges that are recommended
    "handoffs": ("concat(candidate_id, ':', next_id)", [
        Has("handoff", ("candidate_id", "next_id"), unique="repeated_handoff"), Needs("unknown_handoff", "handoff_row", ("candidate_id", "next_id")), Needs("handoff_order", "handoff_row", ("candidate_id", "next_id"), after="handoff_at", rest=("place", "candidate_id", "next_id"), lenient=True),
        Needs("changed_handoff", "handoff_row", ("candidate_id", "next_id"), after="handoff_span", rest=("candidate_id", "next_id", "before_first", "before_last", "after_first", "after_last"), lenient=True),
        Breaks("edges", "not classification <=> 'misallocated_topic_extent' and (left_last is not null or right_first is not null)"),
        Breaks("edges", "classification = 'misallocated_topic_extent' and not coalesce(before_first <= left_last and left_last < right_first and right_first <= after_last, false)"),
    ]),
}


def portfolio_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(source_id, subject, row, rule) of what a review of a source's candidates breaks; all tables of CATALOGUE but the computed ones, cores (source_id, opportunity_id, first, last) and contexts (source_id, candidate_id, first, last).

    Overlaps and handoffs are computed from the candidates and must each be judged once, with their spans, handoffs in order. Beside the catalogue: shared context must be required context of both candidates
    (shared_context), an overlap or handoff that is at fault needs a required finding on both candidates there (overlap_finding, handoff_finding), and a represented opportunity's cores lie within its candidates (core_outside)."""
    key, c = "source_id", tables["candidates"]
    placed = handoffs(c).join(c.select(key, F.col("candidate_id"), "first", F.col("last").alias("before_last")), [key, "candidate_id"]).join(c.select(key, F.col("candidate_id").alias("next_id"), F.col("first").alias("after_first")), [key, "next_id"])
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first", "before_last", "candidate_id")).cast("long") - 1).drop("first")
    given = {n: tables[n] for n in CATALOGUE if n in tables} | {"overlap_rows": overlap_pairs(c), "handoff_rows": placed}
    out = violations(given, CATALOGUE, key)
    found = lambda df, subject, row, rule: df.select(key, F.lit(subject).alias("subject"), F.expr(f"cast({row} as string)").alias("row"), F.lit(rule).alias("rule")).distinct()
    overlaps, hand, findings = tables["overlaps"], tables["handoffs"], tables["findings"]
    pair = CATALOGUE["overlaps"][0]
    # shared context: of each side, the overlap less what is required there
    sides = overlaps.filter("classification = 'necessary_shared_context'").select(key, "a_id", "b_id", F.explode(F.array("a_id", "b_id")).alias("candidate_id"), F.col("first").alias("start_ms"), (F.col("last") + 1).alias("end_ms"))
    keys = [key, "a_id", "b_id", "candidate_id"]
    required = sides.select(*keys).join(tables["contexts"].filter("first <= last").select(key, "candidate_id", F.col("first").alias("start_ms"), (F.col("last") + 1).alias("end_ms")), [key, "candidate_id"]).select(*keys, "start_ms", "end_ms")
    extra = [found(subtracted(sides, required, keys), "overlaps", pair, "shared_context")]
    # findings on both candidates: by the first of them, then the other
    named = findings.filter("severity = 'required'").select(key, F.col("kind").alias("needed"), F.explode("candidates").alias("one"), F.col("candidates").alias("all"), "spans")
    needed = F.element_at(F.create_map(*[F.lit(x) for p in REQUIRED_KIND.items() for x in p]), F.col("classification"))
    o = overlaps.withColumns({"needed": needed, "one": F.col("a_id")}).filter("needed is not null").alias("o")
    at = (F.col(f"o.{key}") == F.col(f"f.{key}")) & (F.col("o.needed") == F.col("f.needed")) & (F.col("o.one") == F.col("f.one"))
    extra.append(found(o.join(named.alias("f"), at & F.expr("array_contains(all, o.b_id) and exists(spans, v -> v.first = o.first and v.last = o.last)"), "left_anti"), "overlaps", pair, "overlap_finding"))
    h = hand.filter("classification = 'misallocated_topic_extent'").withColumns({"needed": F.lit("unfocused_extent"), "one": F.col("candidate_id")}).alias("o")
    extra.append(found(h.join(named.alias("f"), at & F.expr("array_contains(all, o.next_id) and exists(spans, v -> o.before_first <= v.last and v.first <= o.after_last)"), "left_anti"), "handoffs", CATALOGUE["handoffs"][0], "handoff_finding"))
    said = tables["judgments"].filter("status = 'represented'").select(key, "opportunity_id", F.explode("candidates").alias("candidate_id")).join(c.select(key, "candidate_id", F.col("first").alias("lo"), F.col("last").alias("hi")), [key, "candidate_id"])
    cores = said.join(tables["cores"], [key, "opportunity_id"]).filter("not coalesce(lo <= first and first <= last and last <= hi, false)")
    extra.append(found(cores, "judgments", "opportunity_id", "core_outside"))
    for more in extra:
        out = out.unionByName(more)
    return out


# ---- queries -------------------------------------------------------------------------------------------------

_SPAN = "array(named_struct('first', {0}, 'last', {1}))"


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Ranges of sentences as candidates, one opportunity and one finding for each; what is wrong is said by the sum of source and candidate."""
    # all tables come from the candidates, some thirty times: written once, no plan goes back to words
    c = stored(candidates(s, d).select("source_id", F.col("candidate_id"), "first", "last", (F.col("source_id") + F.col("candidate_id")).alias("x")), "candidates")
    k, own = "candidate_id", ["source_id", "candidate_id", "first", "last"]
    decisions = c.filter("x % 29 <> 5").selectExpr("source_id", f"if(x % 31 = 6, {k} + 1000000, {k}) as candidate_id", "if(x % 7 = 3, 'decline', 'select') as disposition", f"{_SPAN.format('first', 'if(x % 41 = 2, first - 1, last)')} as spans", "x")
    judgments = c.filter("x % 23 <> 4").selectExpr("source_id", f"{k} as opportunity_id", "case when x % 5 = 1 then 'missing_candidate' when x % 5 = 2 then 'unclear' else 'represented' end as status", f"if(x % 19 = 3, array({k}, {k}), if(x % 17 = 5, array({k} - {k}), array({k}))) as candidates", f"{_SPAN.format('first', 'last')} as spans")
    missing = c.filter("x % 11 = 2").selectExpr("source_id", f"if(x % 3 = 1, {k}, {k} + 500000) as id", "if(x % 2 = 1, 'supported', 'needs_evidence') as disposition", f"cast(array() as array<bigint>) as candidates")
    findings = c.selectExpr(
        "source_id", f"if(x % 37 = 8, 0, {k}) as id", "element_at(array('unfocused_extent', 'duplicate_core', 'missed_opportunity'), cast(x % 3 + 1 as int)) as kind", "if(x % 4 = 1, 'unknown', 'required') as severity", f"if(x % 13 = 9, array({k}), array({k}, {k} + 5)) as candidates",
        f"if(x % 3 = 2, array({k} + 500000), array({k})) as opportunities", f"{_SPAN.format(f'{k} + 5', 'last')} as spans",
    )
    overlaps = overlap_pairs(c.select(*own)).withColumn("y", F.expr("a_id + b_id + source_id"))
    overlaps = overlaps.filter("y % 19 <> 3").unionByName(overlaps.filter("y % 43 = 1")).selectExpr("source_id", "a_id", "b_id", "if(y % 17 = 2, first + 1, first) as first", "last", "element_at(array('misallocated_topic_extent', 'duplicate_core', 'necessary_shared_context', 'distinct'), cast(y % 4 + 1 as int)) as classification")
    w = Window.partitionBy("source_id").orderBy("candidate_id")
    h = handoffs(c.select(*own)).join(c.select("source_id", "candidate_id", F.col("last").alias("before_last")), ["source_id", "candidate_id"]).join(c.select("source_id", F.col("candidate_id").alias("next_id"), F.col("first").alias("after_first")), ["source_id", "next_id"])
    h = h.withColumn("place", F.row_number().over(w).cast("long") - 1).withColumn("y", F.expr("candidate_id + source_id")).filter("y % 13 <> 3")
    wrong = "y % 3 = 0"
    hand = h.selectExpr("source_id", "if(y % 11 = 2, place + 1, place) as place", "candidate_id", "next_id", "before_first", "before_last", "after_first", "if(y % 7 = 1, after_last + 1, after_last) as after_last", f"if({wrong}, 'misallocated_topic_extent', 'clean') as classification", f"if({wrong} or y % 5 = 1, before_last, null) as left_last", f"if({wrong} and y % 5 <> 2, after_first, null) as right_first")
    return {
        "candidates": c.select(*own), "opportunities": c.selectExpr("source_id", f"{k} as id"), "cores": c.selectExpr("source_id", f"{k} as opportunity_id", "first", "last + if(x % 9 = 4, 1, 0) as last"), "contexts": c.selectExpr("source_id", k, "first + if(x % 2 = 0, 0, 2) as first", "last").unionByName(c.filter("x % 6 = 1").selectExpr("source_id", k, "first", "first + 1 as last")),
        "decisions": decisions.drop("x"), "judgments": judgments, "missing": missing, "findings": findings, "overlaps": overlaps, "handoffs": hand,
    }


QUERIES = {"v10_portfolio_violations": lambda s, d: portfolio_violations(_tables(s, d))}


def _sql(parts: list[tuple[str, str, str, str, str]]) -> str:
    return " UNION ".join(f"SELECT source_id, '{subject}' AS subject, ({row})::VARCHAR AS row, '{rule}' AS rule FROM {frm} WHERE {cond}" for subject, rule, row, frm, cond in parts)


_DEC, _FID, _AB, _CN = "CASE WHEN x % 31 = 6 THEN k + 1000000 ELSE k END", "CASE WHEN x % 37 = 8 THEN 0 ELSE k END", "a || ':' || b", "k || ':' || n"
_JC = "CASE WHEN x % 17 = 5 AND x % 19 <> 3 THEN 0 ELSE k END"  # the candidate that a judgment names
_HAS = "EXISTS (SELECT 1 FROM c z WHERE z.source_id = c.source_id AND z.k = "
_REQ = "EXISTS (SELECT 1 FROM c f WHERE f.source_id = c.source_id AND f.x % 4 <> 1 AND (f.k = {0} OR f.k + 5 = {0} AND f.x % 13 <> 9))"
ORACLES = {
    "v10_portfolio_violations": f"""WITH {GRID_SQL}, {CANDIDATES_SQL}, c AS (SELECT source_id, candidate_id AS k, first AS f, last AS l, source_id + candidate_id AS x FROM cand), m AS (SELECT *, CASE WHEN x % 3 = 1 THEN k ELSE k + 500000 END AS id FROM c WHERE x % 11 = 2),
p AS (SELECT a.source_id, a.k AS a, b.k AS b, a.x AS ax, greatest(a.f, b.f) AS f, least(a.l, b.l) AS l, a.k + b.k + a.source_id AS y, a.f AS af, a.l AS al, b.f AS bf, b.l AS bl, b.x AS bx FROM c a JOIN c b ON a.source_id = b.source_id AND a.k < b.k AND a.f <= b.l AND b.f <= a.l),
g AS (SELECT *, CASE WHEN y % 17 = 2 THEN f + 1 ELSE f END AS gf FROM p WHERE y % 19 <> 3 OR y % 43 = 1), n AS (SELECT *, lead(k) OVER w AS n, lead(f) OVER w AS nf FROM c WINDOW w AS (PARTITION BY source_id ORDER BY f, l, k)), h AS (SELECT * FROM n WHERE nf > l)
""" + _sql([
        ("candidates", "undecided", "k", "c", "x % 29 = 5 OR x % 31 = 6"), ("decisions", "unknown_candidate", _DEC, "c", "x % 29 <> 5 AND x % 31 = 6"), ("decisions", "decision_span", _DEC, "c", "x % 29 <> 5 AND x % 41 = 2"), ("decisions", "declined", _DEC, "c", f"x % 29 <> 5 AND x % 7 = 3 AND NOT (x % 31 <> 6 AND {_REQ.format('c.k')})"),
        ("opportunities", "unjudged", "k", "c", "x % 23 = 4"), ("judgments", "repeated_candidate", "k", "c", "x % 23 <> 4 AND x % 19 = 3"), ("judgments", "unrepresented", "k", "c", f"x % 23 <> 4 AND x % 5 NOT IN (1, 2) AND NOT EXISTS (SELECT 1 FROM c z WHERE z.source_id = c.source_id AND z.k = {_JC.replace('x %', 'c.x %').replace('ELSE k', 'ELSE c.k')} AND z.x % 29 <> 5 AND z.x % 31 <> 6 AND z.x % 7 <> 3)"),
        ("judgments", "missing_finding", "k", "c", "x % 23 <> 4 AND x % 5 = 1 AND (x % 3 = 2 OR x % 4 = 1)"), ("judgments", "core_outside", "k", "c", "x % 23 <> 4 AND x % 5 NOT IN (1, 2) AND (x % 9 = 4 AND NOT (x % 17 = 5 AND x % 19 <> 3) OR x % 17 = 5 AND x % 19 <> 3 AND EXISTS (SELECT 1 FROM c z WHERE z.source_id = c.source_id AND z.k = 0 AND NOT (c.f >= z.f AND c.l + CASE WHEN c.x % 9 = 4 THEN 1 ELSE 0 END <= z.l)))"),
        ("missing", "not_new", "id", "m", "x % 3 = 1"), ("missing", "invented", "id", "m", "x % 2 = 1"), ("missing", "omission_finding", "id", "m", "NOT (x % 3 = 2 AND x % 4 <> 1)"), ("findings", "repeated_finding", "0", "(SELECT source_id, count(*) AS t FROM c WHERE x % 37 = 8 OR k = 0 GROUP BY 1)", "t > 1"),
        ("findings", "finding_candidate", _FID, "c", f"x % 13 <> 9 AND NOT {_HAS} c.k + 5)"), ("findings", "finding_opportunity", _FID, "c", "x % 3 = 2 AND NOT x % 11 = 2"), ("findings", "finding_span", _FID, "c", "l < k + 5"),
        ("overlap_rows", "unjudged_overlap", _AB, "p", "y % 19 = 3 AND y % 43 <> 1"), ("overlaps", "repeated_overlap", "a || ',' || b", "p", "y % 19 <> 3 AND y % 43 = 1"), ("overlaps", "changed_overlap", _AB, "g", "gf <> f"),
        ("overlaps", "overlap_finding", _AB, "g", "y % 4 < 2 AND NOT EXISTS (SELECT 1 FROM c f WHERE f.source_id = g.source_id AND f.x % 4 <> 1 AND f.x % 3 = g.y % 4 AND f.x % 13 <> 9 AND g.a = f.k AND g.b = f.k + 5 AND f.k + 5 = g.gf AND f.l = g.l)"),
        ("overlaps", "shared_context", _AB, "g", "y % 4 = 2 AND (gf <= l) AND (ax % 2 = 1 AND ax % 6 <> 1 AND gf < af + 2 OR bx % 2 = 1 AND bx % 6 <> 1 AND gf < bf + 2)"),
        ("handoff_rows", "unjudged_handoff", _CN, "h", "x % 13 = 3"), ("handoffs", "handoff_order", _CN, "h", "x % 13 <> 3 AND x % 11 = 2"), ("handoffs", "changed_handoff", _CN, "h", "x % 13 <> 3 AND x % 7 = 1"), ("handoffs", "edges", _CN, "h", "x % 13 <> 3 AND (x % 3 <> 0 AND x % 5 = 1 OR x % 3 = 0 AND x % 5 = 2)"),
        ("handoffs", "handoff_finding", _CN, "h", f"x % 13 <> 3 AND x % 3 = 0 AND NOT (x % 4 <> 1 AND x % 13 <> 9 AND n = k + 5 AND greatest(f, l - {HANDOFF_CONTEXT - 1}) <= l AND k + 5 <= (SELECT least(z.l, z.f + {HANDOFF_CONTEXT - 1}) FROM c z WHERE z.source_id = h.source_id AND z.k = h.n) + CASE WHEN x % 7 = 1 THEN 1 ELSE 0 END)"),
    ])
}
