"""Small operators around stored rows: constraint checks as rows that break a rule, upserts as joins, prices and parsed text, scorers.

Every check returns the violating rows, so an empty result means valid; unions of such frames are a report. Upserts are batch plans: the new state is
a join of the stored rows with the incoming ones. Nulls: an unknown operand gives a null result or no violation, as each function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.segment import GRID_SQL, sentence_grid
from lexiline.sources.timeline import WORDS_SQL, table, words


def half_up_ms(num: Column, den: Column) -> Column:
    """num / den milliseconds rounded half up, in integers; null where den is not positive."""
    n, d = num.cast("decimal(38,0)"), den.cast("decimal(38,0)")
    return F.when(den > 0, F.call_function("div", 2 * n + d, 2 * d)).cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    """The least integer not below a / b for a >= 0 and b > 0."""
    return F.call_function("div", a + b - 1, b)


def rational(text: Column) -> Column:
    """(num, den) of texts such as 30000/1001, 24:1 or 25; null for anything else and for zero numerators or denominators."""
    whole = F.regexp_extract(text, r"^([0-9]{1,9})([/:]([0-9]{1,9}))?$", 1)
    under = F.regexp_extract(text, r"^([0-9]{1,9})([/:]([0-9]{1,9}))?$", 3)
    num, den = whole.try_cast("long"), F.when(under == "", F.lit(1)).otherwise(under.try_cast("long"))
    return F.when((num > 0) & (den > 0), F.struct(num.alias("num"), den.cast("long").alias("den")))


def duration_ms(text: Column) -> Column:
    """Milliseconds of texts such as 6m0s or 250ms; null if anything is left over."""
    part = lambda unit, size: F.coalesce(F.regexp_extract(text, unit, 1).try_cast("long"), F.lit(0)) * size
    total = part(r"([0-9]+)h", 3_600_000) + part(r"([0-9]+)m(?!s)", 60_000) + part(r"([0-9]+)s", 1000) + part(r"([0-9]+)ms", 1)
    return F.when(text.rlike(r"\A([0-9]{1,9}h)?([0-9]{1,9}m)?([0-9]{1,9}s)?([0-9]{1,9}ms)?\z") & (text != ""), total)


def micros(dollars: Column) -> Column:
    """Dollars as text with at most six decimals, in millionths; null if it isn't such a text."""
    ok = dollars.rlike(r"\A[0-9]{1,12}(\.[0-9]{1,6})?\z")
    return F.when(ok, (dollars.try_cast("decimal(20,6)") * 1_000_000).cast("long"))


def contract_violations(w: DataFrame, slack_ms: int = 2000) -> DataFrame:
    """Words (source_id, ord, start_ms, end_ms, duration_ms) that start before an earlier one, end before they start, or end beyond the duration and slack."""
    last = F.lag("start_ms").over(Window.partitionBy("source_id").orderBy("ord"))
    rules = {"start_order": F.col("start_ms") < last, "end_before_start": F.col("end_ms") < F.col("start_ms"), "past_duration": F.col("end_ms") > F.col("duration_ms") + slack_ms}
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return w.withColumn("broken", broken).select("source_id", "ord", F.explode("broken").alias("rule"))


def cover_violations(sections: DataFrame, last: DataFrame) -> DataFrame:
    """Where sections (source_id, first, last) don't tile 0 to the greatest ordinal (source_id, top): gaps, overlaps, both ends."""
    w = Window.partitionBy("source_id").orderBy("first", "last")
    s = sections.withColumns({"expected": F.coalesce(F.lag("last").over(w) + 1, F.lit(0).cast("long")), "final": F.lead("first").over(w).isNull()})
    s = s.join(last, "source_id", "left")
    rule = F.when(F.col("first") > F.col("expected"), "gap").when(F.col("first") < F.col("expected"), "overlap").when(F.col("final") & (F.col("last") < F.col("top")), "short").when(F.col("last") > F.col("top"), "beyond")
    return s.withColumn("rule", rule).filter("rule is not null").select("source_id", "first", "last", "rule")


def replay_differences(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that only one of two frames has, with repeats, and which one."""
    return stored.exceptAll(derived).withColumn("side", F.lit("stored")).unionByName(derived.exceptAll(stored).withColumn("side", F.lit("derived")))


def claims(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """State after claims (key, run): a free key is taken, a key of the same run stays as it is, a key of another run is refused."""
    both = stored.withColumnRenamed("run", "held").join(incoming, "key", "full_outer")
    outcome = F.when(F.col("run").isNull(), "kept").when(F.col("held").isNull(), "taken").when(F.col("held") == F.col("run"), "repeated").otherwise("refused")
    return both.select("key", F.coalesce("held", "run").alias("run"), outcome.alias("outcome"))


def appended_once(stored: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of incoming that are new by key: the first of each in order, and none whose key is stored."""
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
    return first.join(stored.select(key), key, "left_anti")


def revisions(stored: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts (key, attempt) with their revision: that of the same stored attempt, else the key's next ones in order of attempts."""
    known = attempts.join(stored, ["key", "attempt"], "left")
    top = stored.groupBy("key").agg(F.max("revision").alias("top"))
    fresh = F.sum(F.when(F.col("revision").isNull(), 1).otherwise(0)).over(Window.partitionBy("key").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0))
    return known.join(top, "key", "left").select("key", "attempt", F.coalesce("revision", F.coalesce("top", F.lit(0)) + fresh).cast("long").alias("revision"))


def kth_route(routes: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """The route k (from 0) of each key in order of rank, without excluded vendors; refused where there are too few."""
    left = routes.join(excluded, ["key", "vendor"], "left_anti")
    n = left.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("rank")) - 1).filter(F.col("n") == k).select("key", F.col("rank").alias("route"))
    return routes.select("key").distinct().join(n, "key", "left").select("key", "route", F.when(F.col("route").isNull(), "too_few").otherwise("ok").alias("outcome"))


def missing_parts(uploads: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts of (upload, n_parts, part_size, last_size) that aren't there in the exact expected size."""
    want = uploads.select("upload", "n_parts", "part_size", "last_size", F.explode(F.sequence(F.lit(1).cast("long"), "n_parts")).alias("part"))
    want = want.select("upload", "part", F.when(F.col("part") == F.col("n_parts"), F.col("last_size")).otherwise(F.col("part_size")).alias("size"))
    return want.join(parts.select("upload", "part", "size"), ["upload", "part", "size"], "left_anti")


def identity(want: Column, got: Column) -> Column:
    """matched, mismatch, or unknown where something is wanted and nothing is known; null where nothing is wanted."""
    return F.when(want.isNull(), F.lit(None)).when(got.isNull(), "unknown").when(want == got, "matched").otherwise("mismatch")


def decided(planned: DataFrame, judged: DataFrame, key: str, default: str) -> DataFrame:
    """Every planned id with its judgment or the default."""
    return planned.select(key).join(judged.select(key, "verdict"), key, "left").select(key, F.coalesce("verdict", F.lit(default)).alias("verdict"))


def last_edits(edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last edit of each id; ids whose last edit removes them go."""
    last = edits.groupBy(key).agg(F.max_by(F.struct("kind", "value"), F.struct(*order)).alias("e"))
    return last.filter("e.kind <> 'remove'").select(key, "e.kind", "e.value")


def boundary_decisions(atoms: DataFrame) -> DataFrame:
    """Whether each boundary between consecutive atoms (source_id, ord, grp) is kept: their groups differ."""
    w = Window.partitionBy("source_id").orderBy("ord")
    ahead = atoms.withColumns({"next": F.lead("grp").over(w), "after": F.lead("ord").over(w)})
    return ahead.filter("after is not null").select("source_id", "ord", (~F.col("grp").eqNullSafe(F.col("next"))).alias("keep"))


# ---- queries -----------------------------------------------------------------------------------------------

def v1_contract(s: SparkSession, d: str) -> DataFrame:
    w = words(s, d)
    moved = F.when(F.col("ord") % 97 == 5, F.col("start_ms") - 3000).otherwise(F.col("start_ms"))
    w = w.withColumns({"start_ms": moved, "end_ms": F.when(F.col("ord") % 89 == 7, moved - 1).otherwise(F.col("end_ms")), "duration_ms": F.lit(60000)})
    return contract_violations(w)


def v3_cover(s: SparkSession, d: str) -> DataFrame:
    g = sentence_grid(words(s, d))
    top = g.groupBy("source_id").agg(F.max("sentence_id").alias("top"))
    first = F.expr("sentence_id div 5 * 5")
    part = g.groupBy("source_id", first.alias("first")).agg(F.max("sentence_id").alias("last"))
    shifted = part.select("source_id", F.when(F.col("first") % 20 == 5, F.col("first") + 1).when(F.col("first") % 20 == 15, F.col("first") - 1).otherwise(F.col("first")).alias("first"), F.when(F.col("last") % 7 == 3, F.col("last") + 9).otherwise(F.col("last")).alias("last"))
    return cover_violations(shifted, top)


def v14_replay(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("kind"))
    return replay_differences(o.filter("key % 3 <> 0"), o.filter("key % 5 <> 0"))


def _attempts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("attempt")).agg(F.count("*").alias("n"))


def r10_claims(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 4).alias("run"))
    return claims(o.filter("key % 3 <> 0"), o.filter("key % 2 = 0").withColumn("run", F.when(F.col("key") % 5 == 0, F.lit(9)).otherwise(F.col("run"))))


def r11_appended(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", "ts")
    return appended_once(e.filter("event_id % 7 = 0"), e.filter("event_id % 7 <> 0"), "key", ["ts", "event_id"]).select("key", "event_id")


def r12_revisions(s: SparkSession, d: str) -> DataFrame:
    a = _attempts(s, d).select("key", "attempt")
    return revisions(a.filter("attempt <= 3 and (key + attempt) % 3 <> 0").withColumn("revision", F.col("attempt") * 2), a)


def r15_reaped(s: SparkSession, d: str) -> DataFrame:
    """Idle keys: their last event is more than a day before the end of the table; oldest first, the first ten."""
    last = table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    end = last.agg(F.max("last_ts").alias("end"))
    idle = last.join(F.broadcast(end), F.col("last_ts") < F.col("end") - F.expr("interval 1 day"))  # one row
    return idle.orderBy("last_ts", "user_id").limit(10).select("user_id", F.expr("unix_micros(cast(last_ts as timestamp))").alias("last_us"))


def x2_half_up(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", half_up_ms(F.col("l_partkey") * 1001, F.col("l_suppkey")).alias("ms"))


def x3_missing(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "lineitem").select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").cast("long").alias("part"), F.when(F.col("l_quantity") > 45, 3).otherwise(8).cast("long").alias("size")).distinct()
    up = table(s, d, "orders").select(F.col("o_orderkey").alias("upload"), (1 + F.col("o_custkey") % 7).alias("n_parts"), F.lit(8).cast("long").alias("part_size"), F.lit(3).cast("long").alias("last_size"))
    return missing_parts(up, parts)


def x8_routes(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("vendor"), F.col("p_partkey").alias("rank"))
    return kth_route(r, r.filter("rank % 11 = 0").select("key", "vendor").distinct(), 2)


def x9_cost_bound(s: SparkSession, d: str) -> DataFrame:
    tokens = ceil_div(F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.lit(3)) + 64
    return table(s, d, "documents").select("doc_id", tokens.alias("tokens"), F.when(tokens <= 8192, ceil_div(tokens * 1250, F.lit(1000)) + 17).alias("cost"))


def x11_durations(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    text = F.concat_ws("", F.concat(F.col("o_custkey") % 9, F.lit("m")), F.concat(F.col("o_orderkey") % 61, F.when(F.col("o_orderkey") % 4 == 0, "ms").when(F.col("o_orderkey") % 7 == 0, " s").otherwise("s")))
    return o.select("o_orderkey", text.alias("text"), duration_ms(text).alias("ms"))


def x12_micros(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit("."), F.repeat(F.lit("7"), (F.col("o_custkey") % 8).cast("int")))
    return table(s, d, "orders").select("o_orderkey", text.alias("dollars"), micros(text).alias("micros"))


def x14_identity(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    want, got = F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 3), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 3)
    return p.select("p_partkey", identity(want, got).alias("outcome"))


def x15_decided(s: SparkSession, d: str) -> DataFrame:
    judged = table(s, d, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, "good").otherwise("bad")).alias("verdict"))
    return decided(table(s, d, "documents"), judged, "doc_id", "unjudged")


def x16_rationals(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "N/A").when(k % 5 == 1, F.concat(k % 3, F.lit("/"), k % 7)).when(k % 5 == 2, F.concat(F.lit("0:"), k)).when(k % 5 == 3, k.cast("string")).otherwise(F.concat(k, F.lit("/1001")))
    return table(s, d, "part").select("p_partkey", text.alias("text"), rational(text).alias("r")).select("p_partkey", "text", "r.num", "r.den")


def x17_last_edits(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "remove").otherwise("set")
    e = table(s, d, "events").select("user_id", "ts", "event_id", kind.alias("kind"), F.col("event_id").alias("value"))
    return last_edits(e, "user_id", ["ts", "event_id"]).select("user_id", "value")


def g12_summary(s: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.coalesce("text", F.lit("")))
    n = F.regexp_count(t, F.lit(r"[.!?]([ \t\n\r]|\z)")).cast("long")
    issues = F.array_compact(F.array(F.when(F.length(t) < 40, "short"), F.when(~n.between(2, 10), "sentences"), F.when(t.rlike(r"(\A|\n)#"), "markdown")))
    return table(s, d, "conversations").select("conv_id", "turn", n.alias("n_sentences"), F.array_join(issues, ",").alias("issues"), F.round(1 - F.size(issues) / 3, 6).alias("score"))


def g16_decisions(s: SparkSession, d: str) -> DataFrame:
    return boundary_decisions(words(s, d).select("source_id", "ord", F.expr("(ord * 7 + source_id) div 25").alias("grp")))


QUERIES = {
    "v1_contract": v1_contract, "v3_exact_cover": v3_cover, "v14_replay": v14_replay, "r10_claims": r10_claims, "r11_appended_once": r11_appended, "r12_r20_revisions": r12_revisions,
    "r15_reaped": r15_reaped, "x2_half_up_ms": x2_half_up, "x3_missing_parts": x3_missing, "x8_kth_route": x8_routes, "x9_cost_bound": x9_cost_bound, "x11_duration_text": x11_durations,
    "x12_micros": x12_micros, "x14_identity": x14_identity, "x15_decided": x15_decided, "x16_rationals": x16_rationals, "x17_last_edits": x17_last_edits, "g12_summary_score": g12_summary, "g16_boundary_decisions": g16_decisions,
}

_ATTEMPTS = "a AS (SELECT DISTINCT l_orderkey AS key, l_linenumber::BIGINT AS attempt FROM lineitem)"
_EVENTS = "e AS (SELECT user_id || ':' || event_type AS key, event_id, ts FROM events)"

ORACLES = {
    "v1_contract": f"""WITH {WORDS_SQL}, m AS (SELECT source_id, ord, CASE WHEN ord % 97 = 5 THEN start_ms - 3000 ELSE start_ms END AS s, end_ms FROM words),
n AS (SELECT source_id, ord, s, CASE WHEN ord % 89 = 7 THEN s - 1 ELSE end_ms END AS e, lag(s) OVER (PARTITION BY source_id ORDER BY ord) AS p FROM m)
SELECT source_id, ord, 'start_order' AS rule FROM n WHERE s < p UNION ALL SELECT source_id, ord, 'end_before_start' FROM n WHERE e < s UNION ALL SELECT source_id, ord, 'past_duration' FROM n WHERE e > 62000""",
    "v3_exact_cover": f"""WITH {GRID_SQL}, p AS (SELECT source_id, sentence_id // 5 * 5 AS f, max(sentence_id) AS l FROM grid GROUP BY ALL),
q AS (SELECT source_id, CASE WHEN f % 20 = 5 THEN f + 1 WHEN f % 20 = 15 THEN f - 1 ELSE f END AS "first", CASE WHEN l % 7 = 3 THEN l + 9 ELSE l END AS "last" FROM p),
r AS (SELECT *, coalesce(lag("last") OVER w + 1, 0) AS x, lead("first") OVER w IS NULL AS fin FROM q WINDOW w AS (PARTITION BY source_id ORDER BY "first", "last")),
t AS (SELECT source_id, max(sentence_id) AS top FROM grid GROUP BY 1)
SELECT * FROM (SELECT source_id, "first", "last", CASE WHEN "first" > x THEN 'gap' WHEN "first" < x THEN 'overlap' WHEN fin AND "last" < top THEN 'short' WHEN "last" > top THEN 'beyond' END AS rule FROM r JOIN t USING (source_id)) WHERE rule IS NOT NULL""",
    "v14_replay": """WITH o AS (SELECT o_custkey AS key, o_orderpriority AS kind FROM orders), a AS (SELECT * FROM o WHERE key % 3 <> 0), b AS (SELECT * FROM o WHERE key % 5 <> 0)
SELECT *, 'stored' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'derived' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "r10_claims": """WITH o AS (SELECT o_orderkey AS key, o_custkey % 4 AS run FROM orders), a AS (SELECT key, run AS held FROM o WHERE key % 3 <> 0),
b AS (SELECT key, CASE WHEN key % 5 = 0 THEN 9 ELSE run END AS run FROM o WHERE key % 2 = 0)
SELECT key, coalesce(held, run) AS run, CASE WHEN run IS NULL THEN 'kept' WHEN held IS NULL THEN 'taken' WHEN held = run THEN 'repeated' ELSE 'refused' END AS outcome FROM a FULL JOIN b USING (key)""",
    "r11_appended_once": f"WITH {_EVENTS} SELECT key, arg_min(event_id, (ts, event_id)) AS event_id FROM e WHERE event_id % 7 <> 0 AND key NOT IN (SELECT key FROM e WHERE event_id % 7 = 0) GROUP BY key",
    "r12_r20_revisions": f"""WITH {_ATTEMPTS}, s AS (SELECT key, attempt, attempt * 2 AS revision FROM a WHERE attempt <= 3 AND (key + attempt) % 3 <> 0), t AS (SELECT key, max(revision) AS top FROM s GROUP BY key)
SELECT key, attempt, coalesce(revision, coalesce(top, 0) + count(*) FILTER (revision IS NULL) OVER (PARTITION BY key ORDER BY attempt))::BIGINT AS revision FROM a LEFT JOIN s USING (key, attempt) LEFT JOIN t USING (key)""",
    "r15_reaped": "SELECT user_id, epoch_us(t) AS last_us FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) WHERE t < (SELECT max(ts) FROM events) - INTERVAL 1 DAY ORDER BY t, user_id LIMIT 10",
    "x2_half_up_ms": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey > 0 THEN (2 * 1001 * l_partkey + l_suppkey) // (2 * l_suppkey) END AS ms FROM lineitem",
    "x3_missing_parts": """WITH p AS (SELECT l_orderkey AS upload, l_linenumber::BIGINT AS part, CASE WHEN l_quantity > 45 THEN 3 ELSE 8 END AS size FROM lineitem),
u AS (SELECT o_orderkey AS upload, 1 + o_custkey % 7 AS n FROM orders), w AS (SELECT upload, n, unnest(range(1, n + 1)) AS part FROM u)
SELECT upload, part, (CASE WHEN part = n THEN 3 ELSE 8 END)::BIGINT AS size FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.upload = w.upload AND p.part = w.part AND p.size = CASE WHEN w.part = w.n THEN 3 ELSE 8 END)""",
    "x8_kth_route": """WITH r AS (SELECT p_brand AS key, p_type AS vendor, p_partkey AS rank FROM part), l AS (SELECT key, nth_value(rank, 3) OVER (PARTITION BY key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS route FROM r
WHERE (key, vendor) NOT IN (SELECT (key, vendor) FROM r WHERE rank % 11 = 0))
SELECT key, route, CASE WHEN route IS NULL THEN 'too_few' ELSE 'ok' END AS outcome FROM (SELECT r.key, max(route) AS route FROM r LEFT JOIN l ON r.key = l.key GROUP BY r.key)""",
    "x9_cost_bound": "SELECT doc_id, t AS tokens, CASE WHEN t <= 8192 THEN (t * 1250 + 999) // 1000 + 17 END AS cost FROM (SELECT doc_id, (strlen(coalesce(text, '')) + 2) // 3 + 64 AS t FROM documents)",
    "x11_duration_text": """SELECT o_orderkey, (o_custkey % 9) || 'm' || (o_orderkey % 61) || CASE WHEN o_orderkey % 4 = 0 THEN 'ms' WHEN o_orderkey % 7 = 0 THEN ' s' ELSE 's' END AS text,
CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 9 * 60000 + o_orderkey % 61 WHEN o_orderkey % 7 <> 0 THEN o_custkey % 9 * 60000 + o_orderkey % 61 * 1000 END AS ms FROM orders""",
    "x12_micros": """SELECT o_orderkey, o_orderkey || '.' || repeat('7', (o_custkey % 8)::INT) AS dollars, CASE WHEN o_custkey % 8 BETWEEN 1 AND 6 THEN o_orderkey * 1000000 + rpad(repeat('7', (o_custkey % 8)::INT), 6, '0')::BIGINT END AS micros FROM orders""",
    "x14_identity": """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_size % 3 = p_partkey % 3 THEN 'matched' ELSE 'mismatch' END AS outcome FROM part""",
    "x15_decided": "SELECT doc_id, coalesce(v, 'unjudged') AS verdict FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) = 1 THEN 'good' ELSE 'bad' END AS v FROM labels GROUP BY 1) USING (doc_id)",
    "x16_rationals": """WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN (p_partkey % 3) || '/' || (p_partkey % 7) WHEN 2 THEN '0:' || p_partkey WHEN 3 THEN p_partkey::VARCHAR ELSE p_partkey || '/1001' END AS text,
CASE p_partkey % 5 WHEN 1 THEN p_partkey % 3 WHEN 3 THEN p_partkey WHEN 4 THEN p_partkey END AS n, CASE p_partkey % 5 WHEN 1 THEN p_partkey % 7 WHEN 3 THEN 1 WHEN 4 THEN 1001 END AS m FROM part)
SELECT k AS p_partkey, text, CASE WHEN n > 0 AND m > 0 THEN n END AS num, CASE WHEN n > 0 AND m > 0 THEN m END AS den FROM t""",
    "x17_last_edits": "SELECT user_id, x.event_id AS value FROM (SELECT user_id, arg_max({'event_id': event_id, 'k': event_type}, (ts, event_id)) AS x FROM events GROUP BY 1) WHERE x.k <> 'purchase'",
    "g12_summary_score": r"""WITH t AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ') AS t FROM conversations), n AS (SELECT *, len(regexp_extract_all(t, '[.!?]([ \t\n\r]|\z)'))::BIGINT AS n FROM t),
i AS (SELECT *, list_filter([CASE WHEN length(t) < 40 THEN 'short' END, CASE WHEN n NOT BETWEEN 2 AND 10 THEN 'sentences' END, CASE WHEN regexp_matches(t, '(\A|\n)#') THEN 'markdown' END], lambda x: x IS NOT NULL) AS x FROM n)
SELECT conv_id, turn, n AS n_sentences, array_to_string(x, ',') AS issues, round(1 - len(x) / 3, 6) AS score FROM i""",
    "g16_boundary_decisions": f"""WITH {WORDS_SQL}, a AS (SELECT source_id, ord, (ord * 7 + source_id) // 25 AS g, lead((ord * 7 + source_id) // 25) OVER (PARTITION BY source_id ORDER BY ord) AS x FROM words)
SELECT source_id, ord, g <> x AS keep FROM a WHERE x IS NOT NULL""",
}
