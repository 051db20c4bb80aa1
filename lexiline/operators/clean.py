"""Scalar cleaning, normalization of recognizer output, and speaker assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.functions.text import strip
from lexiline.plans.ordered import as_of, range_join
from lexiline.sources.timeline import WORDS_SQL, by_source, spans, table, words

# fixed values: labels, marker patterns and plan constants
SPEAKER_LABEL = r"^SPEAKER_0*([0-9]+)$"
OOM_MARKERS = r"(?i)out of memory|cuda error|alloc"
BATCH_LADDER = {16: 8, 8: 4}
RUNGS = ((1080, 5000), (720, 2800), (480, 1400), (360, 800))
STALL_MINUTES = 5


def normalize_speaker(c: Column) -> Column:
    """Blank to null, SPEAKER_07 to 7, else trimmed."""
    t = strip(c)
    digits = F.regexp_extract(t, SPEAKER_LABEL, 1)
    return F.when(t == "", None).when(digits != "", digits).otherwise(t)


def seconds_to_ms(c: Column) -> Column:
    """Finite seconds to whole milliseconds, half to even; else null."""
    bad = F.isnan(c) | c.isNull() | (F.abs(c) == float("inf"))
    return F.when(~bad, F.bround(c * 1000)).cast("long")


def clean_confidence(c: Column) -> Column:
    return F.when(~F.isnan(c) & c.between(0, 1), c)


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def clock(ms: Column | str) -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    c = F.col(ms) if isinstance(ms, str) else ms
    part = lambda div, mod: F.lpad((F.floor(c / div) % mod).cast("string"), 2, "0")
    return F.concat(part(3_600_000, 100), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit(","), F.lpad((c % 1000).cast("string"), 3, "0"))


def sanitize(c: Column, most: int = 60) -> Column:
    """URLs and what looks like a secret taken out, and cut."""
    c = F.regexp_replace(c, r"https?://[^ ]+", "[url]")
    return F.substring(F.regexp_replace(c, r"(?i)(key|token|secret)=[^ ]+", "$1=[hidden]"), 1, most)


def quantize(t: Column, num: int, den: int) -> Column:
    """t (ms) to the index of the nearest frame of num/den frames a second, ties earlier."""
    x, d = t * num, F.lit(1000 * den)
    q = F.floor(x / d)
    return (q + F.when(2 * (x - q * d) > d, 1).otherwise(0)).cast("long")


def parse_spec(c: Column) -> DataFrame:
    """name:key=value,... as name and a map."""
    return F.struct(F.split_part(c, F.lit(":"), F.lit(1)).alias("name"), F.str_to_map(F.regexp_extract(c, ":(.*)$", 1), F.lit(","), F.lit("=")).alias("params"))


def encoding_plan(c: DataFrame) -> DataFrame:
    """Rungs no taller than the source (the shortest at least), bit rate by height and frame rate, frames in two seconds."""
    all_ = F.array(*[F.struct(F.lit(h).alias("height"), F.lit(k).alias("kbps")) for h, k in RUNGS])
    fit = F.filter(all_, lambda r: r["height"] <= F.col("source_height"))
    r = c.withColumn("rung", F.explode(F.when(F.size(fit) > 0, fit).otherwise(F.slice(all_, -1, 1))))
    return r.select("id", "rung.height", F.when(F.col("fps") > 30, F.expr("rung.kbps * 3 div 2")).otherwise(F.col("rung.kbps")).cast("long").alias("kbps"), (F.round("fps") * 2).cast("long").alias("gop"))


def interpolated(w: DataFrame) -> DataFrame:
    """Missing times filled: the words of a run without times share the time between its known neighbours by their lengths."""
    o, back = by_source(), Window.partitionBy("source_id").orderBy(F.desc("ord"))
    # the next time is the last one in reverse: a frame up to the end would be gone through again for each word
    near = {"prev": F.last("end_ms", True).over(o.rowsBetween(Window.unboundedPreceding, -1)), "next": F.last("start_ms", True).over(back.rowsBetween(Window.unboundedPreceding, -1))}
    pts = w.withColumns(near | {"known": F.col("start_ms").isNotNull()})
    pts = pts.withColumn("run", F.sum(F.col("known").cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("source_id", "run", "known")
    size = F.greatest(F.length("text"), F.lit(1))
    pts = pts.withColumns({"total": F.sum(size).over(r), "upto": F.sum(size).over(r.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)), "size": size})
    low = F.coalesce("prev", "next", F.lit(0))
    span = F.greatest(F.coalesce(F.col("next"), low) - low, F.lit(0))
    at = lambda x: (low + F.floor((2 * span * x + F.col("total")) / (2 * F.col("total")))).cast("long")
    return pts.select("source_id", "ord", "text", F.coalesce("start_ms", at(F.col("upto") - F.col("size"))).alias("start_ms"), F.coalesce("end_ms", at(F.col("upto"))).alias("end_ms"), F.when(F.col("known"), "aligned").otherwise("interpolated").alias("timing"))


def monotonic(w: DataFrame) -> DataFrame:
    """Starts never go back and ends never precede them; what was touched is marked."""
    start = F.max("start_ms").over(by_source().rowsBetween(Window.unboundedPreceding, 0))
    m = w.withColumns({"s": start}).withColumn("e", F.greatest("end_ms", "s"))
    return m.select("source_id", "ord", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), ((F.col("s") != F.col("start_ms")) | (F.col("e") != F.col("end_ms"))).alias("touched"))


def speakers_in_order(w: DataFrame) -> DataFrame:
    f = w.filter("speaker is not null").groupBy("source_id", "speaker").agg(F.min("ord").alias("first_ord"))
    return f.withColumn("position", F.row_number().over(by_source("first_ord")).cast("long"))


def scoped(df: DataFrame, column: str, org: object | None) -> DataFrame:
    """Rows of one tenant; none where no tenant is set."""
    return df.filter(F.lit(False)) if org is None else df.filter(F.col(column) == org)


def speaker_by_overlap(w: DataFrame, turns: DataFrame) -> DataFrame:
    """Of each word the speaker with the most time in common, of equal ones the one met first; else the one whose turn's middle is nearest."""
    a = w.select("source_id", "ord", "start_ms", "end_ms")
    b = turns.select("source_id", "turn_ord", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"), F.col("speaker").alias("t_speaker"))
    met = range_join(a, b, ["source_id"], ("start_ms", "end_ms"), ("t_start", "t_end"), 10_000)
    shared = met.withColumn("ms", F.least("end_ms", "t_end") - F.greatest("start_ms", "t_start")).groupBy("source_id", "ord", "t_speaker").agg(F.sum("ms").alias("ms"), F.min("turn_ord").alias("first"))
    best = shared.groupBy("source_id", "ord").agg(F.min_by("t_speaker", F.struct(-F.col("ms"), F.col("first"))).alias("overlap"))
    return w.select("source_id", "ord").join(best, ["source_id", "ord"], "left")


def nearest_turn(points: DataFrame, turns: DataFrame) -> DataFrame:
    """The turn whose middle is nearest to t (twice the time, as the middles are), of two the earlier one: two as-of lookups."""
    mid = turns.groupBy("source_id", (F.col("start_ms") + F.col("end_ms")).alias("m")).agg(F.min("turn_ord").alias("turn_ord"))
    back = as_of(points, mid, ["source_id"], "t", "m", ["turn_ord"]).withColumnsRenamed({"right_m": "b_m", "right_turn_ord": "b_turn"})
    both = as_of(back, mid, ["source_id"], "t", "m", ["turn_ord"], forward=True)
    back_d, next_d = F.col("t") - F.col("b_m"), F.col("right_m") - F.col("t")
    nearer = F.when(F.col("right_m").isNull() | (back_d < next_d) | ((back_d == next_d) & (F.col("b_turn") <= F.col("right_turn_ord"))), F.col("b_turn")).otherwise(F.col("right_turn_ord"))
    return both.select("source_id", "ord", F.when(F.col("b_m").isNull(), F.col("right_turn_ord")).otherwise(nearer).alias("turn_ord"))


def assigned(w: DataFrame, turns: DataFrame) -> DataFrame:
    over = speaker_by_overlap(w, turns)
    near = nearest_turn(w.select("source_id", "ord", (F.col("start_ms") + F.col("end_ms")).alias("t")), turns).join(turns.select("source_id", "turn_ord", F.col("speaker").alias("nearest")), ["source_id", "turn_ord"], "left")
    return over.join(near, ["source_id", "ord"], "left").select("source_id", "ord", F.coalesce("overlap", "nearest").alias("speaker"), F.when(F.col("overlap").isNotNull(), "overlap").otherwise("nearest").alias("rule"))


def recognition_spans(s: DataFrame, most: int = 32) -> DataFrame:
    """Warnings about spans, by kind, the first `most` of each."""
    kind = F.when(F.col("end_ms") <= F.col("start_ms"), "empty").when(F.col("end_ms") - F.col("start_ms") > 900_000, "too_long").when(F.col("end_ms") - F.col("start_ms") < 20_000, "short")
    k = s.withColumn("warning", kind).filter("warning is not null")
    return k.withColumn("n", F.row_number().over(Window.partitionBy("warning").orderBy("id"))).filter(F.col("n") <= most).select("warning", "id", F.col("n").cast("long").alias("n"))


# ---- queries -----------------------------------------------------------------------------------------------

def drafts(s: SparkSession, d: str) -> DataFrame:
    """Words with some times taken away."""
    gone = F.expr("(ord % 13 in (4, 5, 6) or ord % 29 = 0)")
    return words(s, d).select("source_id", "ord", "text", F.when(~gone, F.col("start_ms")).alias("start_ms"), F.when(~gone, F.col("end_ms")).alias("end_ms"))


_DRAFTS = "dr AS (SELECT source_id, ord, text, CASE WHEN NOT (ord % 13 IN (4, 5, 6) OR ord % 29 = 0) THEN start_ms END AS start_ms, CASE WHEN NOT (ord % 13 IN (4, 5, 6) OR ord % 29 = 0) THEN end_ms END AS end_ms FROM words)"


def turns(s: SparkSession, d: str) -> DataFrame:
    w = words(s, d)
    return w.groupBy("source_id", "turn").agg((F.min("start_ms") + 1301).alias("start_ms"), (F.max("end_ms") + 977).alias("end_ms"), F.min_by("speaker", "ord").alias("speaker")).select("source_id", F.col("turn").alias("turn_ord"), "start_ms", "end_ms", "speaker")


_TURNS = "tn AS (SELECT source_id, turn AS turn_ord, min(start_ms) + 1301 AS start_ms, max(end_ms) + 977 AS end_ms, arg_min(speaker, ord) AS speaker FROM words GROUP BY source_id, turn)"
_OVER = "ov AS (SELECT w.source_id, w.ord, t.speaker, sum(least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms)) AS ms, min(turn_ord) AS f FROM words w JOIN tn t ON w.source_id = t.source_id AND w.start_ms < t.end_ms AND t.start_ms < w.end_ms GROUP BY ALL), bo AS (SELECT source_id, ord, speaker AS overlap FROM ov QUALIFY row_number() OVER (PARTITION BY source_id, ord ORDER BY ms DESC, f) = 1)"
_NEAR = "nt AS (SELECT w.source_id, w.ord, t.turn_ord, t.speaker AS nearest FROM words w JOIN tn t ON w.source_id = t.source_id QUALIFY row_number() OVER (PARTITION BY w.source_id, w.ord ORDER BY abs(w.start_ms + w.end_ms - t.start_ms - t.end_ms), t.turn_ord) = 1)"


def _docs(s, d):
    return table(s, d, "documents")


def _speaker(s, d):
    raw = F.when(F.expr("event_id % 5 = 0"), F.concat(F.lit("SPEAKER_0"), (F.col("user_id") % 12).cast("string"))).when(F.expr("event_id % 5 = 1"), F.lit("  ")).when(F.expr("event_id % 5 = 2"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))).when(F.expr("event_id % 5 = 3"), None).otherwise(F.lit("SPEAKER_x"))
    return table(s, d, "events").select("event_id", normalize_speaker(raw).alias("speaker"))


def _times(s, d):
    v = F.col("value")
    return table(s, d, "events").select("event_id", seconds_to_ms(F.when(F.expr("event_id % 7 = 0"), F.lit(float("nan"))).when(F.expr("event_id % 7 = 1"), F.lit(float("inf"))).otherwise(F.floor(v * 16) / 16 / 1000 + F.floor(v))).alias("ms"),
        clean_confidence(F.when(F.expr("event_id % 7 = 0"), F.lit(float("nan"))).otherwise(F.floor(v) / 256)).alias("confidence"))


def _blank(s, d):
    """Texts of segments without words are split instead; pure markers give none."""
    c = table(s, d, "conversations")
    ws = F.filter(F.split(F.trim("text"), r"[ \t\n\r]+"), lambda w: w != "")
    own = F.when(F.expr("turn % 3 = 0"), F.filter(ws, lambda w: F.length(w) > 4)).otherwise(F.array().cast("array<string>"))
    marker = F.expr("turn % 5 = 4")
    use = F.when(marker, F.array().cast("array<string>")).when(F.size(own) > 0, own).otherwise(ws)
    return c.select("conv_id", "turn", F.posexplode(use).alias("pos", "word")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "word")


def _state(s, d):
    """A label for each order: a pure function of its row, its lines and a fixed now."""
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    n = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    j = o.join(n, "o_orderkey", "left")
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    state = F.when(F.col("lines").isNull(), "waiting").when(F.col("o_orderstatus") == "F", "ready").when((F.col("o_orderstatus") == "P") & (age > 100 * STALL_MINUTES), "stalled").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def _labels(s, d):
    e = table(s, d, "events")
    sec = F.round(F.col("value")).cast("long")
    dur = F.when(sec >= 60, F.concat(F.expr("cast(round(value) as bigint) div 60").cast("string"), F.lit("m "), (sec % 60).cast("string"), F.lit("s"))).otherwise(F.concat(sec.cast("string"), F.lit("s")))
    cents = F.round(F.col("value") * 100).cast("long")
    money = F.concat(F.lit("$"), F.expr("cast(round(value * 100) as bigint) div 100").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return e.select("event_id", dur.alias("duration"), money.alias("money"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))


def _spec(s, d):
    c = F.concat(F.col("event_type"), F.lit(":per_hour="), (F.col("user_id") % 20).cast("string"), F.lit(",min="), (F.col("event_id") % 6).cast("string"))
    p = table(s, d, "events").select("event_id", parse_spec(c).alias("p"))
    return p.select("event_id", "p.name", F.col("p.params")["per_hour"].try_cast("int").cast("long").alias("per_hour"), F.col("p.params")["min"].try_cast("int").cast("long").alias("min_size"), F.col("p.params")["other"].alias("other"))


def _oom(s, d):
    size = F.element_at(F.array(F.lit(16), F.lit(8), F.lit(4)), (F.col("event_id") % 3 + 1).cast("int"))
    text = F.when(F.expr("event_id % 4 = 0"), "CUDA error: out of memory").when(F.expr("event_id % 4 = 1"), "connection lost").when(F.expr("event_id % 4 = 2"), "failed to allocate").otherwise("timeout")
    down = F.create_map(*[F.lit(x).cast("int") for k, v in BATCH_LADDER.items() for x in (k, v)])
    return table(s, d, "events").select("event_id", text.rlike(OOM_MARKERS).alias("is_oom"), F.when(text.rlike(OOM_MARKERS), F.try_element_at(down, size)).cast("long").alias("next_batch"))


def _toms(s, d):
    """Tenths and whole numbers by floor(x + 0.5)."""
    v = F.col("value")
    tenths = js_round(v * 10)
    return table(s, d, "events").select("event_id", tenths.cast("long").alias("tenths"), js_round(v).cast("long").alias("rounded"))


def _norm_scores(s, d):
    e = table(s, d, "events").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000 div 3600").alias("ms"), (F.floor(F.col("value")) / F.when(F.col("event_type") == "view", 255).otherwise(100)).alias("score"))
    return e.filter("score >= 0.3").groupBy("user_id", "ms").agg(F.round(F.max("score"), 6).alias("score"))


_SP = "CASE WHEN event_id % 5 = 0 THEN 'SPEAKER_0' || (user_id % 12) WHEN event_id % 5 = 1 THEN '  ' WHEN event_id % 5 = 2 THEN ' ' || event_type || ' ' WHEN event_id % 5 = 3 THEN NULL ELSE 'SPEAKER_x' END"
QUERIES = {
    "a1_normalize_speaker": _speaker,
    "a2_a3_times_and_confidence": _times,
    "a4_a5_blank_words_and_fallback": _blank,
    "a6_interpolated_times": lambda s, d: interpolated(drafts(s, d)),
    "a7_monotonic_repair": lambda s, d: monotonic(words(s, d).select("source_id", "ord", (F.col("start_ms") - F.expr("case when ord % 11 = 3 then 5000 else 0 end")).alias("start_ms"), (F.col("end_ms") - F.expr("case when ord % 7 = 3 then 4000 else 0 end")).alias("end_ms"))),
    "a8_speakers_in_order": lambda s, d: speakers_in_order(words(s, d)),
    "a9_scoped_read": lambda s, d: scoped(table(s, d, "orders"), "o_custkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus").unionByName(scoped(table(s, d, "orders"), "o_custkey", None).select("o_orderkey", "o_custkey", "o_orderstatus")),
    "a10_js_numbers": _toms,
    "a11_a12_tags_and_clocks": lambda s, d: words(s, d).select("source_id", "ord", clock("start_ms").alias("at"), F.coalesce(F.concat(F.lit("S"), (F.col("speaker").try_cast("int") + 1).cast("string")), F.concat(F.lit("S"), "speaker"), F.lit("S?")).alias("tag")),
    "a13_sanitize": lambda s, d: table(s, d, "pages").select("page_id", sanitize(F.concat(F.lit("failed at "), "url", F.lit(" with token=abc"), F.col("page_id").cast("string"), F.lit(" and more words to cut off here"))).alias("message")),
    "a14_display_labels": _labels,
    "a15_state": _state,
    "a16_spec_parse": _spec,
    "a17_oom_ladder": _oom,
    "a18_encoding_plan": lambda s, d: encoding_plan(table(s, d, "events").select(F.col("event_id").alias("id"), F.element_at(F.array(*[F.lit(h) for h in (2160, 1080, 576, 240)]), (F.col("event_id") % 4 + 1).cast("int")).alias("source_height"), F.element_at(F.array(F.lit(24.0), F.lit(50.0), F.lit(29.97)), (F.col("event_id") % 3 + 1).cast("int")).alias("fps"))),
    "a19_quantize": lambda s, d: words(s, d).select("source_id", "ord", quantize(F.col("start_ms"), 30000, 1001).alias("frame")),
    "a20_detector_scores": _norm_scores,
    "d1_speaker_by_overlap": lambda s, d: speaker_by_overlap(words(s, d), turns(s, d)),
    "d2_nearest_turn": lambda s, d: nearest_turn(words(s, d).select("source_id", "ord", (F.col("start_ms") + F.col("end_ms")).alias("t")), turns(s, d)),
    "d3_assigned_speakers": lambda s, d: assigned(words(s, d), turns(s, d)),
    "d4_recognition_spans": lambda s, d: recognition_spans(spans(s, d)),
}
ORACLES = {
    "a1_normalize_speaker": f"SELECT event_id, CASE WHEN trim(x) = '' THEN NULL WHEN regexp_matches(trim(x), '^SPEAKER_0*[0-9]+$') THEN regexp_extract(trim(x), '^SPEAKER_0*([0-9]+)$', 1) ELSE trim(x) END AS speaker FROM (SELECT event_id, {_SP} AS x FROM events)",
    "a2_a3_times_and_confidence": "SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE round_even((floor(value * 16) / 16 / 1000 + floor(value)) * 1000, 0)::BIGINT END AS ms, CASE WHEN event_id % 7 <> 0 AND floor(value) / 256 BETWEEN 0 AND 1 THEN floor(value) / 256 END AS confidence FROM events",
    "a4_a5_blank_words_and_fallback": r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM conversations), u AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN []::VARCHAR[] WHEN turn % 3 = 0 AND len(list_filter(ws, lambda x: length(x) > 4)) > 0 THEN list_filter(ws, lambda x: length(x) > 4) ELSE ws END AS ws FROM w) SELECT conv_id, turn, i - 1 AS pos, ws[i] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM u)",
    "a6_interpolated_times": f"""WITH {WORDS_SQL}, {_DRAFTS}, p AS (SELECT *, last_value(end_ms IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv, first_value(start_ms IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx, start_ms IS NOT NULL AS known, sum(CASE WHEN start_ms IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY ord) AS run, greatest(length(text), 1) AS size FROM dr),
        t AS (SELECT *, sum(size) OVER (PARTITION BY source_id, run, known) AS total, sum(size) OVER (PARTITION BY source_id, run, known ORDER BY ord) AS upto, coalesce(pv, nx, 0) AS low FROM p), u AS (SELECT *, greatest(coalesce(nx, low) - low, 0) AS span FROM t)
        SELECT source_id, ord, text, coalesce(start_ms, low + (2 * span * (upto - size) + total) // (2 * total))::BIGINT AS start_ms, coalesce(end_ms, low + (2 * span * upto + total) // (2 * total))::BIGINT AS end_ms, CASE WHEN known THEN 'aligned' ELSE 'interpolated' END AS timing FROM u""",
    "a7_monotonic_repair": f"WITH {WORDS_SQL}, b AS (SELECT source_id, ord, start_ms - CASE WHEN ord % 11 = 3 THEN 5000 ELSE 0 END AS start_ms, end_ms - CASE WHEN ord % 7 = 3 THEN 4000 ELSE 0 END AS end_ms FROM words), m AS (SELECT *, max(start_ms) OVER (PARTITION BY source_id ORDER BY ord) AS s FROM b) SELECT source_id, ord, s AS start_ms, greatest(end_ms, s) AS end_ms, (s <> start_ms OR greatest(end_ms, s) <> end_ms) AS touched FROM m",
    "a8_speakers_in_order": f"WITH {WORDS_SQL}, f AS (SELECT source_id, speaker, min(ord) AS first_ord FROM words WHERE speaker IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY first_ord) AS position FROM f",
    "a9_scoped_read": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7",
    "a10_js_numbers": "SELECT event_id, floor(value * 10 + 0.5)::BIGINT AS tenths, floor(value + 0.5)::BIGINT AS rounded FROM events",
    "a11_a12_tags_and_clocks": f"WITH {WORDS_SQL} SELECT source_id, ord, lpad((start_ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((start_ms % 1000)::VARCHAR, 3, '0') AS at, CASE WHEN speaker IS NULL THEN 'S?' WHEN try_cast(speaker AS INT) IS NOT NULL THEN 'S' || (try_cast(speaker AS INT) + 1) ELSE 'S' || speaker END AS tag FROM words",
    "a13_sanitize": "SELECT page_id, substr(regexp_replace(regexp_replace('failed at ' || url || ' with token=abc' || page_id || ' and more words to cut off here', 'https?://[^ ]+', '[url]', 'g'), '(?i)(key|token|secret)=[^ ]+', '\\1=[hidden]', 'g'), 1, 60) AS message FROM pages",
    "a14_display_labels": "SELECT event_id, CASE WHEN round(value) >= 60 THEN (round(value)::BIGINT // 60) || 'm ' || (round(value)::BIGINT % 60) || 's' ELSE round(value)::BIGINT || 's' END AS duration, '$' || (round(value * 100)::BIGINT // 100) || '.' || lpad((round(value * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS money, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events",
    "a15_state": "SELECT CASE WHEN lines IS NULL THEN 'waiting' WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'P' AND date_diff('day', o_orderdate::DATE, DATE '1998-08-02') > 500 THEN 'stalled' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END AS state, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1",
    "a16_spec_parse": "SELECT event_id, event_type AS name, user_id % 20 AS per_hour, event_id % 6 AS min_size, NULL::VARCHAR AS other FROM events",
    "a17_oom_ladder": "SELECT event_id, event_id % 4 IN (0, 2) AS is_oom, CASE WHEN event_id % 4 IN (0, 2) THEN CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 END END::BIGINT AS next_batch FROM events",
    "a18_encoding_plan": "WITH s AS (SELECT event_id AS id, [2160, 1080, 576, 240][event_id % 4 + 1] AS sh, [24.0, 50.0, 29.97][event_id % 3 + 1] AS fps FROM events), r(height, kbps) AS (VALUES (1080, 5000), (720, 2800), (480, 1400), (360, 800)) SELECT id, height, (CASE WHEN fps > 30 THEN kbps * 3 // 2 ELSE kbps END)::BIGINT AS kbps, (round(fps) * 2)::BIGINT AS gop FROM s JOIN r ON height <= sh OR (sh < 360 AND height = 360)",
    "a19_quantize": f"WITH {WORDS_SQL}, x AS (SELECT source_id, ord, start_ms * 30000 AS n, 1001000 AS d FROM words) SELECT source_id, ord, n // d + CASE WHEN 2 * (n % d) > d THEN 1 ELSE 0 END AS frame FROM x",
    "a20_detector_scores": "SELECT user_id, epoch_us(ts) // 1000000 // 3600 AS ms, round(max(s), 6) AS score FROM (SELECT *, floor(value) / CASE WHEN event_type = 'view' THEN 255 ELSE 100 END AS s FROM events) WHERE s >= 0.3 GROUP BY ALL",
    "d1_speaker_by_overlap": f"WITH {WORDS_SQL}, {_TURNS}, {_OVER} SELECT w.source_id, w.ord, overlap FROM words w LEFT JOIN bo ON bo.source_id = w.source_id AND bo.ord = w.ord",
    "d2_nearest_turn": f"WITH {WORDS_SQL}, {_TURNS}, {_NEAR} SELECT source_id, ord, turn_ord FROM nt",
    "d3_assigned_speakers": f"WITH {WORDS_SQL}, {_TURNS}, {_OVER}, {_NEAR} SELECT w.source_id, w.ord, coalesce(overlap, nearest) AS speaker, CASE WHEN overlap IS NOT NULL THEN 'overlap' ELSE 'nearest' END AS rule FROM words w LEFT JOIN bo ON bo.source_id = w.source_id AND bo.ord = w.ord LEFT JOIN nt ON nt.source_id = w.source_id AND nt.ord = w.ord",
    "d4_recognition_spans": "WITH s AS (SELECT event_id AS id, round(value * 100)::BIGINT * 2000 AS len FROM events), k AS (SELECT id, CASE WHEN len <= 0 THEN 'empty' WHEN len > 900000 THEN 'too_long' WHEN len < 20000 THEN 'short' END AS warning FROM s) SELECT * FROM (SELECT warning, id, row_number() OVER (PARTITION BY warning ORDER BY id) AS n FROM k WHERE warning IS NOT NULL) WHERE n <= 32",
}
