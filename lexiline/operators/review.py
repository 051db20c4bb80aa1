"""Moments on the grid, selection drafts, accepted artifacts and track checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.checks import _rules
from lexiline.operators.segment import GRID_SQL, PAUSE_MS, pause_boundaries, sentence_grid
from lexiline.plans.ordered import range_join
from lexiline.sources.timeline import by_source, table, words

# fixed values: moments last 10 to 120 seconds, four in five of them; more overlap than half is a repeat; tracks may be off by two frames of either kind
LEAST_MS, MOST_MS, RATE, OVERLAP = 10_000, 120_000, 0.8, 0.5
AUDIO_FRAME, AUDIO_RATE = 1024, 48_000


def grid_points(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_id, ms) where a moment may start (sentences, turns, after pauses) and where it may end (sentences, before pauses)."""
    g = sentence_grid(w)
    before = F.lag("speaker").over(by_source())
    turns = w.withColumn("turn_start", F.lag("ord").over(by_source()).isNull() | ~F.col("speaker").eqNullSafe(before)).filter("turn_start")
    pauses = pause_boundaries(w)
    ends = pauses.select("source_id", (F.col("ord") - 1).alias("ord")).join(w.select("source_id", "ord", "end_ms"), ["source_id", "ord"])
    point = lambda df, c: df.select("source_id", F.col(c).alias("ms"))
    return point(g, "start_ms").unionByName(point(turns, "start_ms")).unionByName(point(pauses, "start_ms")).distinct(), point(g, "end_ms").unionByName(point(ends, "end_ms")).distinct()


def moment_score(rows: DataFrame, durations: DataFrame, w: DataFrame) -> DataFrame:
    """Moments (source_id, ord, start_ms, end_ms, grounded, suppressed, scores array<double>): share of grounded ones, less for survivors off the grid, out of range, repeated or of unfit length and for scores outside 0 to 1; with the number of issues of each kind."""
    starts, ends = grid_points(w)
    alive = rows.filter("grounded and not suppressed").join(durations, "source_id")
    on = alive.join(starts.select("source_id", F.col("ms").alias("start_ms"), F.lit(True).alias("s_ok")), ["source_id", "start_ms"], "left").join(ends.select("source_id", F.col("ms").alias("end_ms"), F.lit(True).alias("e_ok")), ["source_id", "end_ms"], "left")
    length = F.col("end_ms") - F.col("start_ms")
    g = on.groupBy("source_id").agg(
        F.count("*").alias("survivors"), F.count_if(F.col("s_ok").isNull() | F.col("e_ok").isNull()).alias("off_grid"), F.count_if((length <= 0) | (F.col("end_ms") > F.col("duration_ms"))).alias("invalid"), F.count_if(length.between(LEAST_MS, MOST_MS)).alias("fit"),
    )
    side = lambda k: alive.filter("end_ms > start_ms").select("source_id", F.col("ord").alias(f"o{k}"), F.col("start_ms").alias(f"s{k}"), F.col("end_ms").alias(f"e{k}"))
    met = range_join(side("a"), side("b"), ["source_id"], ("sa", "ea"), ("sb", "eb"), 60_000).filter("oa < ob")
    share = (F.least("ea", "eb") - F.greatest("sa", "sb")) / (F.greatest("ea", "eb") - F.least("sa", "sb"))
    pairs = met.filter(share > OVERLAP).groupBy("source_id").agg(F.count("*").alias("repeated"))
    base = rows.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("grounded").alias("grounded"), F.count_if(F.exists("scores", lambda x: (x < 0) | (x > 1))).alias("bad_scores"))
    none = lambda c: F.coalesce(c, F.lit(0))
    j = durations.select("source_id").join(base, "source_id", "left").join(g, "source_id", "left").join(pairs, "source_id", "left").select("source_id", *[none(c).alias(c) for c in ("n", "grounded", "survivors", "off_grid", "invalid", "repeated", "fit", "bad_scores")])
    unfit = (F.col("survivors") > 0) & (F.col("fit") / F.greatest(F.lit(1), "survivors") < RATE)
    factor = lambda cond, x: F.when(cond, x).otherwise(1.0)
    score = F.col("grounded") / F.greatest(F.lit(1), "n") * factor((F.col("off_grid") > 0) | (F.col("invalid") > 0), 0.5) * factor(F.col("repeated") > 0, 0.5) * factor(unfit, 0.85) * factor(F.col("bad_scores") > 0, 0.9)
    return j.select("source_id", F.round(score, 6).alias("score"), "n", "off_grid", "invalid", "repeated", unfit.alias("unfit"), "bad_scores")


def selection_violations(opportunities: DataFrame, links: DataFrame, candidates: DataFrame, cores: DataFrame) -> DataFrame:
    """V9: opportunities (source_id, opportunity, disposition), links (source_id, opportunity, candidate), candidates (source_id, candidate, first, last) and cores (source_id, opportunity, first, last):
    (source_id, kind, id, rule). Ids are unique, what is selected is mapped and nothing else is, links name what exists, cores lie inside a mapped candidate, each candidate is mapped."""
    same = F.count("*").over(Window.partitionBy("source_id", "opportunity"))
    mapped = links.select("source_id", "opportunity").distinct().withColumn("mapped", F.lit(True))
    o = opportunities.withColumn("same", same).join(mapped, ["source_id", "opportunity"], "left")
    rules = {"duplicate": F.col("same") > 1, "unmapped": (F.col("disposition") == "selected") & F.col("mapped").isNull(), "mapped": (F.col("disposition") != "selected") & F.col("mapped").isNotNull()}
    of_o = o.select("source_id", F.lit("opportunity").alias("kind"), F.col("opportunity").alias("id"), F.explode(_rules(rules)).alias("rule")).distinct()
    known = links.join(candidates, ["source_id", "candidate"], "left")
    lost = known.filter("first is null").select("source_id", F.lit("opportunity").alias("kind"), F.col("opportunity").alias("id"), F.lit("unknown_candidate").alias("rule")).distinct()
    free = candidates.join(links, ["source_id", "candidate"], "left_anti").select("source_id", F.lit("candidate").alias("kind"), F.col("candidate").alias("id"), F.lit("unused").alias("rule"))
    spans = known.select("source_id", "opportunity", F.col("first").alias("c_first"), F.col("last").alias("c_last"))
    inside = cores.join(spans, ["source_id", "opportunity"]).groupBy("source_id", "opportunity", "first", "last").agg(F.bool_or((F.col("first") >= F.col("c_first")) & (F.col("last") <= F.col("c_last"))).alias("ok"))
    out = inside.filter("not coalesce(ok, false)").select("source_id", F.lit("opportunity").alias("kind"), F.col("opportunity").alias("id"), F.lit("core_outside").alias("rule")).distinct()
    return of_o.unionByName(lost).unionByName(free).unionByName(out)


def accepted(incoming: DataFrame, dependencies: DataFrame, stored: DataFrame) -> DataFrame:
    """Artifacts (key, fingerprint) after their dependencies (key, needs) are looked up in what is stored (key): missing ones refuse it, a stored key is a repeat, else it is accepted."""
    have = stored.select("key").distinct()
    lacking = dependencies.join(have.withColumnRenamed("key", "needs"), "needs", "left_anti").groupBy("key").agg(F.count("*").alias("missing"))
    known = have.withColumn("known", F.lit(True))
    j = incoming.join(lacking, "key", "left").join(known, "key", "left")
    outcome = F.when(F.col("known"), "repeated").when(F.col("missing") > 0, "refused").otherwise("accepted")
    return j.select("key", outcome.alias("outcome"), F.coalesce("missing", F.lit(0)).alias("missing"))


def track_checks(tracks: DataFrame) -> DataFrame:
    """Tracks (track, expected_start, start, expected_end, end, fps_num, fps_den), times in ms: (track, check, off, ok) with a tolerance of two video or two audio frames, whichever is longer; an unknown time fails."""
    tolerance = F.greatest(2000 * F.col("fps_den") / F.col("fps_num"), F.lit(2000 * AUDIO_FRAME / AUDIO_RATE))
    one = lambda name, want, got: F.struct(F.lit(name).alias("check"), F.abs(F.col(got) - F.col(want)).alias("off"))
    x = tracks.withColumn("tolerance", tolerance).select("track", "tolerance", F.explode(F.array(one("start", "expected_start", "start"), one("end", "expected_end", "end"))).alias("x"))
    return x.select("track", "x.check", "x.off", F.coalesce(F.col("x.off") <= F.col("tolerance"), F.lit(False)).alias("ok"))


# ---- queries -----------------------------------------------------------------------------------------------

def g14_moments(s: SparkSession, d: str) -> DataFrame:
    w = words(s, d)
    g = sentence_grid(w)
    k = F.col("sentence_id")
    far = g.select("source_id", (k - 3).alias("sentence_id"), F.col("end_ms").alias("far_ms"))
    m = g.join(far, ["source_id", "sentence_id"]).filter("sentence_id % 2 = 0 and source_id % 9 <> 2").select(
        "source_id", k.alias("ord"), F.when(k % 34 == 8, F.col("start_ms") + 3).otherwise(F.col("start_ms")).alias("start_ms"), F.when(k % 46 == 10, F.col("start_ms") - 1).when(k % 6 == 4, F.col("end_ms")).otherwise(F.col("far_ms")).alias("end_ms"),
        (k % 14 != 6).alias("grounded"), (k % 8 == 2).alias("suppressed"), F.array((k % 5 / 4).cast("double"), (k % 29 / 27).cast("double")).alias("scores"),
    )
    return moment_score(m, w.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")), w)


def v9_selection(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").cast("long").alias("k"), F.col("l_partkey").alias("p")).distinct()
    o = li.select("source_id", F.when((F.col("k") == 4) & (F.col("source_id") % 9 == 1), 3).otherwise(F.col("k")).alias("opportunity"), F.when(F.col("p") % 3 == 0, "omitted").otherwise("selected").alias("disposition"))
    links = li.filter("p % 7 <> 2").select("source_id", F.col("k").alias("opportunity"), ((F.col("k") + F.col("p")) % 8).alias("candidate"))
    c = li.select("source_id", F.col("k").alias("candidate")).distinct().select("source_id", "candidate", (F.col("candidate") * 10).alias("first"), (F.col("candidate") * 10 + 9).alias("last"))
    cores = li.select("source_id", F.col("k").alias("opportunity"), ((F.col("k") + F.col("p")) % 8 * 10 + F.col("p") % 6).alias("first"), ((F.col("k") + F.col("p")) % 8 * 10 + F.col("p") % 6 + F.col("p") % 5).alias("last"))
    return selection_violations(o, links, c, cores)


def r19_accepted(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("fingerprint"))
    needs = table(s, d, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("key"), (F.col("l_orderkey") - F.col("l_linenumber")).alias("needs"))
    return accepted(o.filter("key % 4 <> 3"), needs.filter("needs > 0"), o.filter("key % 5 <> 1 and key % 7 <> 2").select("key"))


def x4_tracks(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(s, d, "part").select(k.alias("track"), F.lit(0).alias("expected_start"), F.when(k % 11 != 5, k % 90).alias("start"), (k * 10).alias("expected_end"), (k * 10 + k % 97 - 40).alias("end"), F.when(k % 2 == 0, 30_000).otherwise(25).alias("fps_num"), F.when(k % 2 == 0, 1001).otherwise(1).alias("fps_den"))
    return track_checks(p)


QUERIES = {"g14_moment_score": g14_moments, "v9_selection": v9_selection, "r19_accepted": r19_accepted, "x4_track_checks": x4_tracks}

ORACLES = {
    "g14_moment_score": f"""WITH {GRID_SQL}, ln AS (SELECT source_id, max(end_ms) AS d FROM words GROUP BY 1), lw AS (SELECT *, lag(end_ms) OVER w AS pe, speaker IS DISTINCT FROM lag(speaker) OVER w OR lag(ord) OVER w IS NULL AS t FROM words WINDOW w AS (PARTITION BY source_id ORDER BY ord)),
st AS (SELECT source_id, start_ms AS ms FROM grid UNION SELECT source_id, start_ms FROM lw WHERE t OR start_ms - pe >= {PAUSE_MS}), en AS (SELECT source_id, end_ms AS ms FROM grid UNION SELECT source_id, pe FROM lw WHERE start_ms - pe >= {PAUSE_MS}),
m AS (SELECT g.source_id, g.sentence_id AS k, CASE WHEN g.sentence_id % 34 = 8 THEN g.start_ms + 3 ELSE g.start_ms END AS s, CASE WHEN g.sentence_id % 46 = 10 THEN g.start_ms - 1 WHEN g.sentence_id % 6 = 4 THEN g.end_ms ELSE f.end_ms END AS e, g.sentence_id % 14 <> 6 AS gr, g.sentence_id % 8 = 2 AS su
  FROM grid g JOIN grid f ON f.source_id = g.source_id AND f.sentence_id = g.sentence_id + 3 WHERE g.sentence_id % 2 = 0 AND g.source_id % 9 <> 2), al AS (SELECT m.*, d FROM m JOIN ln USING (source_id) WHERE gr AND NOT su),
g AS (SELECT source_id, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM st WHERE st.source_id = al.source_id AND ms = s) OR NOT EXISTS (SELECT 1 FROM en WHERE en.source_id = al.source_id AND ms = e)) AS off_, count(*) FILTER (e <= s OR e > d) AS inv, count(*) FILTER (e - s BETWEEN 10000 AND 120000) AS fit FROM al GROUP BY 1),
pr AS (SELECT a.source_id, count(*) AS n FROM al a JOIN al b ON a.source_id = b.source_id AND a.k < b.k AND least(a.e, b.e) > greatest(a.s, b.s) AND (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) > 0.5 WHERE a.e > a.s AND b.e > b.s GROUP BY 1),
ba AS (SELECT source_id, count(*) AS n, count(*) FILTER (gr) AS gr, count(*) FILTER (k % 29 > 27) AS bad FROM m GROUP BY 1),
j AS (SELECT ln.source_id, coalesce(ba.n, 0) AS n, coalesce(gr, 0) AS gr, coalesce(bad, 0) AS bad, coalesce(g.n, 0) AS sv, coalesce(off_, 0) AS off_, coalesce(inv, 0) AS inv, coalesce(fit, 0) AS fit, coalesce(pr.n, 0) AS rp FROM ln LEFT JOIN ba USING (source_id) LEFT JOIN g USING (source_id) LEFT JOIN pr USING (source_id)), u AS (SELECT *, sv > 0 AND fit / greatest(1, sv) < 0.8 AS unfit FROM j)
SELECT source_id, round(gr / greatest(1, n) * CASE WHEN off_ > 0 OR inv > 0 THEN 0.5 ELSE 1 END * CASE WHEN rp > 0 THEN 0.5 ELSE 1 END * CASE WHEN unfit THEN 0.85 ELSE 1 END * CASE WHEN bad > 0 THEN 0.9 ELSE 1 END, 6)::DOUBLE AS score, n, off_ AS off_grid, inv AS invalid, rp AS repeated, unfit, bad AS bad_scores FROM u""",
    "v9_selection": """WITH li AS (SELECT DISTINCT l_orderkey AS s, l_linenumber::BIGINT AS k, l_partkey AS p FROM lineitem), o AS (SELECT s, CASE WHEN k = 4 AND s % 9 = 1 THEN 3 ELSE k END AS op, p % 3 = 0 AS om FROM li), ln AS (SELECT s, k AS op, (k + p) % 8 AS c FROM li WHERE p % 7 <> 2), cd AS (SELECT DISTINCT s, k AS c FROM li),
oc AS (SELECT *, count(*) OVER (PARTITION BY s, op) AS same, EXISTS (SELECT 1 FROM ln WHERE ln.s = o.s AND ln.op = o.op) AS m FROM o), co AS (SELECT s, k AS op, (k + p) % 8 * 10 + p % 6 AS f, (k + p) % 8 * 10 + p % 6 + p % 5 AS l FROM li),
ci AS (SELECT co.s, co.op, f, l, coalesce(bool_or(f >= cd.c * 10 AND l <= cd.c * 10 + 9), false) AS ok FROM co JOIN ln ON ln.s = co.s AND ln.op = co.op LEFT JOIN cd ON cd.s = ln.s AND cd.c = ln.c GROUP BY ALL)
SELECT s AS source_id, 'opportunity' AS kind, op AS id, 'duplicate' AS rule FROM oc WHERE same > 1 UNION SELECT s, 'opportunity', op, 'unmapped' FROM oc WHERE NOT om AND NOT m UNION SELECT s, 'opportunity', op, 'mapped' FROM oc WHERE om AND m
UNION SELECT s, 'opportunity', op, 'unknown_candidate' FROM ln WHERE NOT EXISTS (SELECT 1 FROM cd WHERE cd.s = ln.s AND cd.c = ln.c) UNION SELECT s, 'candidate', c, 'unused' FROM cd WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.s = cd.s AND ln.c = cd.c) UNION SELECT s, 'opportunity', op, 'core_outside' FROM ci WHERE NOT ok""",
    "r19_accepted": """WITH h AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 5 <> 1 AND o_orderkey % 7 <> 2), n AS (SELECT l_orderkey AS key, l_orderkey - l_linenumber AS needs FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey > l_linenumber),
m AS (SELECT key, count(*) AS missing FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.key = n.needs) GROUP BY 1)
SELECT o_orderkey AS key, CASE WHEN h.key IS NOT NULL THEN 'repeated' WHEN missing > 0 THEN 'refused' ELSE 'accepted' END AS outcome, coalesce(missing, 0) AS missing FROM orders LEFT JOIN h ON h.key = o_orderkey LEFT JOIN m ON m.key = o_orderkey WHERE o_orderkey % 4 <> 3""",
    "x4_track_checks": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 <> 5 THEN p_partkey % 90 END AS st, abs(p_partkey % 97 - 40) AS en, CASE WHEN p_partkey % 2 = 0 THEN greatest(2000 * 1001 / 30000, 2048000 / 48000) ELSE greatest(80, 2048000 / 48000) END AS tol FROM part)
SELECT k AS track, 'start' AS "check", st AS off, coalesce(st <= tol, false) AS ok FROM p UNION ALL SELECT k, 'end', en, en <= tol FROM p""",
}
