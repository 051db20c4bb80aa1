"""Aggregations and reports: evidence fusion, pooled vectors, quantiles, rates, confusion, money, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.segment import GRID_SQL, sentence_grid
from lexiline.plans.ordered import trail
from lexiline.sources.timeline import UNITS_SQL, WORDS_SQL, table, units, words

# fixed values: precedence of boundary kinds, in order
PRECEDENCE = ("edge", "pause", "turn", "shot", "sentence")
SAFE_CLEARANCE_MS = 250
# pairs of a block of a bootstrap, and resamples drawn from it in one row
DRAW_BLOCK, DRAW_RESAMPLES = 1 << 20, 20


def boundary_fusion(b: DataFrame) -> DataFrame:
    """Boundaries (source_id, ms, kind, score, sentence_id, ins) of one time become one: kinds united, best score, last sentence, first kind by precedence."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(PRECEDENCE) for x in (k, i)]), F.col("kind"))
    g = b.withColumn("rank", rank).groupBy("source_id", "ms").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max("score").alias("score"), F.min_by("kind", "rank").alias("primary_kind"),
        F.max_by("sentence_id", F.when(F.col("sentence_id").isNotNull(), F.col("ins"))).alias("sentence_id"))
    return g


def rate(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or either is unknown."""
    return F.round(F.when(den > 0, num / den), 6)


def confusion(d: DataFrame, truth: str, said: str) -> DataFrame:
    """Counts of all combinations of truth (valid, invalid, unknown) and verdict, zero where there are none."""
    label = lambda c, yes, no: F.when(F.col(c) == 1, yes).when(F.col(c) == 0, no).otherwise("unknown")
    counts = d.groupBy(label(truth, "valid", "invalid").alias("truth"), label(said, "approved", "rejected").alias("verdict")).agg(F.count("*").alias("n"))
    spark = d.sparkSession
    cells = spark.createDataFrame([(a, b) for a in ("valid", "invalid", "unknown") for b in ("approved", "rejected", "unknown")], "truth string, verdict string")
    return cells.join(counts, ["truth", "verdict"], "left").select("truth", "verdict", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def macro_average(d: DataFrame, truth: str, said: str) -> DataFrame:
    """Accuracy of each class that occurs, and their mean."""
    c = d.groupBy(F.col(truth).alias("class")).agg(F.count_if(F.col(truth) == F.col(said)).alias("correct"), F.count("*").alias("total"))
    return c.agg(F.round(F.avg(F.col("correct") / F.col("total")), 6).alias("macro_accuracy"), F.count("*").alias("classes"), F.sum("correct").alias("correct"), F.sum("total").alias("total"))


def pooled(u: DataFrame, keys: list[str]) -> DataFrame:
    """The normalized mean vector of each key, by dimension, so no vector list is gathered."""
    d = u.select(*keys, F.posexplode("vec").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("m"))
    w = Window.partitionBy(*keys)
    n = d.withColumn("norm", F.sqrt(F.sum(F.col("m") * F.col("m")).over(w)))
    return n.select(*keys, F.col("dim").cast("long").alias("dim"), F.round(F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0), 6).alias("x"))


def pooled_weighted(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means of (keys, dim, x, weight), normalized."""
    d = parts.groupBy(*keys, "dim").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("m"))
    n = d.withColumn("norm", F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(*keys))))
    return n.select(*keys, "dim", F.round(F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0), 5).alias("x"))


def quantiles_and_histogram(d: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Quantiles by linear interpolation and counts of equal bins of [0, 1], the last one closed."""
    q = d.agg(F.percentile(value, F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9, 0.99)])).alias("q")).select(F.posexplode("q").alias("i", "v"))
    q = q.select(F.concat(F.lit("p"), F.element_at(F.array(*map(F.lit, ("10", "50", "90", "99"))), F.col("i") + 1)).alias("name"), F.round("v", 6).alias("value"))
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    h = d.groupBy(b.alias("b")).agg(F.count("*").alias("n")).select(F.concat(F.lit("bin"), F.col("b").cast("string")).alias("name"), F.col("n").cast("double").alias("value"))
    return q.unionByName(h)


def peaks(samples: DataFrame, per_pixel: int) -> DataFrame:
    """Least and greatest of each pixel's samples, floor(/256), silence for pixels without samples."""
    g = samples.groupBy("source_id", F.expr(f"ix div {per_pixel}").alias("pixel")).agg(F.floor(F.min("value") / 256).alias("lo"), F.floor(F.max("value") / 256).alias("hi"))
    top = samples.groupBy("source_id").agg(F.max("length").alias("length"))
    all_ = top.select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {per_pixel}"))).alias("pixel"))
    return all_.join(g, ["source_id", "pixel"], "left").select("source_id", "pixel", F.coalesce("lo", F.lit(0)).cast("long").alias("lo"), F.coalesce("hi", F.lit(0)).cast("long").alias("hi"))


def admission(a: DataFrame, budget: int, calls: int) -> DataFrame:
    """Attempts (run, attempt, cost) in order, with what is reserved after each: one is admitted while its cost fits into the budget beside what was admitted before, and fewer than `calls` were.
    A refused attempt reserves nothing. A run's attempts stream through one task, with two numbers of state."""

    def step(state, row):
        spent, n = state or (0, 0)
        fits = spent + row[0] <= budget and n < calls
        spent, n = (spent + row[0], n + 1) if fits else (spent, n)
        return (spent, n), (spent, fits)

    rows = a.select("run", F.col("attempt").cast("long").alias("attempt"), F.col("cost").cast("long").alias("cost"))
    return trail(rows, ["run"], ["attempt", "cost"], ["cost"], step, {"running": "long", "admitted": "boolean"})


def staircase(v: DataFrame) -> DataFrame:
    """Change from one variant of a block to the next, null where either is contaminated."""
    w = Window.partitionBy("block").orderBy("variant")
    p, bad = F.lag("value").over(w), F.col("bad") | F.coalesce(F.lag("bad").over(w), F.lit(False))
    delta = F.when(~bad, F.col("value") - p)
    return v.select("block", "variant", "value", delta.alias("delta"), F.round(F.when(~bad & (p != 0), 100 * (F.col("value") - p) / p), 4).alias("percent"))


def bootstrap_interval(deltas: DataFrame, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Mean paired difference of each key and the 50th and 1950th of the sorted means of 2000 resamples; no interval for one pair.

    Draws are hashes of (key, resample, draw), so they are the same on every run and need no generator state. No draw becomes a row: some resamples of a key are one row with the key's differences as an
    array, and sum what they draw from it. A key of more than DRAW_BLOCK pairs has its differences and its draws in blocks of that size, each met with each, so a row stays bounded.
    """
    w = Window.partitionBy("key").orderBy("pair")
    numbered = deltas.withColumn("i", F.row_number().over(w) - 1)
    size = deltas.groupBy("key").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.count_if(F.col("delta").isNull()).alias("nulls"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "delta"))), lambda x: x["delta"])
    blocks = numbered.groupBy("key", F.expr(f"i div {DRAW_BLOCK}").alias("block")).agg(ordered.alias("part"))
    parts = blocks.join(size.filter("n > 1").select("key", "n", "nulls"), "key").withColumn("r0", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(DRAW_RESAMPLES))))
    parts = parts.withColumn("k0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAW_BLOCK).cast("long")))).repartition(4 * -(-resamples // DRAW_RESAMPLES), "key", "block", "r0", "k0")
    draws = F.sequence(F.col("k0"), F.least(F.col("k0") + DRAW_BLOCK, F.col("n")) - 1)
    place = lambda r, k: (F.pmod(F.xxhash64(F.lit(seed), "key", r, k), F.col("n")) - F.col("block") * DRAW_BLOCK).cast("int")
    got = lambda r, k: F.get("part", place(r, k))
    total = lambda r: F.aggregate(draws, F.lit(0.0), lambda s, k: s + F.coalesce(got(r, k), F.lit(0.0)))
    known = lambda r: F.aggregate(draws, F.lit(0).cast("long"), lambda s, k: s + F.when(got(r, k).isNotNull(), 1).otherwise(0).cast("long"))
    each = F.transform(F.sequence(F.col("r0"), F.least(F.col("r0") + DRAW_RESAMPLES, F.lit(resamples)) - 1), lambda r: F.struct(r.alias("r"), total(r).alias("s"), F.when(F.col("nulls") > 0, known(r)).alias("c")))
    drawn = parts.select("key", "n", "nulls", F.inline(each)).groupBy("key", "r").agg(F.sum("s").alias("s"), F.when(F.max("nulls") > 0, F.sum("c")).otherwise(F.max("n")).alias("c"))
    means = drawn.select("key", "r", F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("m")).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("m", "r")))
    ends = means.groupBy("key").agg(F.max(F.when(F.col("rank") == resamples // 40, F.col("m"))).alias("low"), F.max(F.when(F.col("rank") == resamples - resamples // 40, F.col("m"))).alias("high"))
    return size.join(ends, "key", "left").select("key", "n", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


# ---- queries -----------------------------------------------------------------------------------------------

def boundaries(s: SparkSession, d: str) -> DataFrame:
    return boundaries_of(words(s, d))


def boundaries_of(w: DataFrame) -> DataFrame:
    """Boundaries of words: each sentence and each word gives all of its own at once, so words are gone through twice, not once for each kind."""
    none = F.lit(None).cast("long")
    one = lambda ms, kind, score, sentence, ins: F.struct(F.col(ms).alias("ms"), F.lit(kind).alias("kind"), score.cast("double").alias("score"), sentence.alias("sentence_id"), F.lit(ins).alias("ins"))
    own = F.col("sentence_id")
    of_sentence = F.array(one("start_ms", "sentence", own % 7 / 8, own, 0), F.when(F.col("opens_turn"), one("start_ms", "turn", F.lit(0.5), own, 1)), F.when(F.col("pause_after_ms") >= 700, one("end_ms", "pause", F.lit(0.25), none, 2)))
    of_word = F.array(F.when(F.expr("ord % 17 = 5"), one("start_ms", "shot", F.lit(1.0), none, 3)), F.when(F.col("ord") == 0, one("start_ms", "edge", F.lit(0.0), none, 4)))
    told = lambda df, which: df.select("source_id", F.inline(F.array_compact(which)))
    return told(sentence_grid(w), of_sentence).unionByName(told(w.filter("ord % 17 = 5 or ord = 0"), of_word))


BOUNDARIES_SQL = """bnd AS (SELECT source_id, start_ms AS ms, 'sentence' AS kind, sentence_id % 7 / 8 AS score, sentence_id, 0 AS ins FROM grid UNION ALL SELECT source_id, start_ms, 'turn', 0.5, sentence_id, 1 FROM grid WHERE opens_turn UNION ALL SELECT source_id, end_ms, 'pause', 0.25, NULL, 2 FROM grid WHERE pause_after_ms >= 700
UNION ALL SELECT source_id, start_ms, 'shot', 1.0, NULL, 3 FROM words WHERE ord % 17 = 5 UNION ALL SELECT source_id, start_ms, 'edge', 0.0, NULL, 4 FROM words WHERE ord = 0)"""
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(PRECEDENCE)) + " END"


def judgments(s, d):
    l_, o = table(s, d, "labels"), table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return o.join(l_, "doc_id", "left").withColumn("said", F.when(F.expr("doc_id % 11 = 0"), None).otherwise((F.col("n_chars") > 900).cast("int")))


_JUDGE = "jd AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE (n_chars > 900)::INT END AS said FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def _assembly(s, d):
    """Fused boundaries with their clearance from words that run over them, and whether they need a look."""
    w = words(s, d)
    b = boundary_fusion(boundaries_of(w))
    from lexiline.operators.intervals import clearance

    c = clearance(b.select(F.col("source_id"), F.col("ms").alias("t"), "primary_kind", "score"), w.select("source_id", (F.col("start_ms") - 60).alias("start_ms"), (F.col("end_ms") - 60).alias("end_ms")), ["source_id"])
    return c.select("source_id", F.col("t").alias("ms"), "primary_kind", "clearance_ms", ((F.col("clearance_ms") < SAFE_CLEARANCE_MS) & (F.col("primary_kind") != "edge")).alias("requires_review"))


def _weighted(s, d):
    p = pooled(units(s, d), ["source_id"]).join(units(s, d).groupBy("source_id").agg(F.count("*").alias("weight")), "source_id")
    return pooled_weighted(p.withColumn("section", F.expr("source_id div 3")), ["section"])


def _rates(s, d):
    j = judgments(s, d)
    known = F.col("quality").isNotNull()
    g = j.groupBy("lang").agg(F.count_if(known & (F.col("quality") == 1)).alias("num"), F.count_if(known).alias("den"), F.count_if(~known).alias("unknown"))
    return g.select("lang", "num", "den", "unknown", rate(F.col("num"), F.col("den")).alias("value"), F.when(F.col("den") == 0, "no_cases").when(F.col("unknown") > 0, "some_unknown").alias("reason"))


def ledger(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("long").alias("attempt"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cost"), F.col("l_linestatus").alias("state"), F.col("l_returnflag").alias("flag"))


LEDGER_SQL = "led AS (SELECT l_orderkey AS run, l_linenumber::BIGINT AS attempt, round(l_extendedprice * 100)::BIGINT AS cost, l_linestatus AS state, l_returnflag AS flag FROM lineitem)"


def _money(s, d):
    g = ledger(s, d)
    return g.groupBy("run").agg(F.sum(F.when(F.col("state") == "F", F.col("cost"))).alias("known"), F.count_if(F.col("state") != "F").alias("unknown"), F.sum(F.when((F.col("state") == "O") & (F.col("flag") == "N"), F.col("cost")).otherwise(0)).alias("exposure"))


def _usage(s, d):
    e = table(s, d, "events").select("user_id", F.create_map(F.lit("input"), F.floor("value").cast("long"), F.lit("output"), F.col("event_id") % 50, F.col("event_type"), F.lit(1).cast("long")).alias("usage"))
    return e.select("user_id", F.explode("usage").alias("k", "v")).groupBy("user_id", "k").agg(F.sum("v").alias("total"))


def _delta(s, d):
    li = table(s, d, "lineitem")
    size = li.groupBy(F.col("l_suppkey").alias("supp")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    prior = li.filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("supp")).agg(F.sum(F.col("l_quantity").cast("long")).alias("prior"))
    return size.join(prior, "supp", "left").select("supp", (F.col("size") - F.coalesce("prior", F.lit(0))).alias("delta"))


def _review(s, d):
    e = table(s, d, "events").select("user_id", "event_type", F.floor("value").cast("long").alias("delta"))
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("accepted"), F.count_if(F.col("event_type") == "error").alias("rejected"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.percentile("delta", 0.5), 6).alias("median_delta"),
        rate(F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type").isin("view", "error"))).alias("acceptance"))


def _staircase(s, d):
    e = table(s, d, "events").filter("event_id < 100000000").groupBy(F.col("user_id").alias("block"), F.col("event_type").alias("variant")).agg(F.count("*").alias("value"), (F.min("event_id") % 5 == 0).alias("bad"))
    return staircase(e)


def _projection(s, d):
    g = sentence_grid(words(s, d)).groupBy("source_id").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"))
    return g.select("source_id", F.expr("(sentences + 11) div 12").alias("sections"), F.expr("(sentences + 79) div 80").alias("windows"), F.expr("2 + 3 * ((sentences + 11) div 12) + (sentences + 79) div 80").alias("calls"), F.expr("(chars + 3) div 4 * 3 + 1000").alias("cost_micros"))


def _delivery(s, d):
    """Orders whose required line numbers all exist once and are fulfilled."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("check"), (F.col("l_linestatus") == "F").alias("ok"))
    g = li.groupBy("run").agg(F.bool_and("ok").alias("all_ok"), F.count_if(F.col("check") <= 2).alias("required"), F.countDistinct(F.when(F.col("check") <= 2, F.col("check"))).alias("different"))
    return g.select("run", (F.col("all_ok") & (F.col("required") == 2) & (F.col("different") == 2)).alias("delivered"))


def _macro(s, d):
    return macro_average(judgments(s, d).filter("quality is not null and said is not null"), "quality", "said")


QUERIES = {
    "e1_boundary_fusion": lambda s, d: boundary_fusion(boundaries(s, d)),
    "e2_evidence_assembly": _assembly,
    "e5_pooled_vectors": lambda s, d: pooled(units(s, d), ["source_id"]),
    "e5_weighted_vectors": _weighted,
    "e7_quantiles_and_histogram": lambda s, d: quantiles_and_histogram(table(s, d, "events").select((F.floor(F.col("value")) / 512).alias("p")), "p"),
    "e8_review_metrics": _review,
    "e9_peaks": lambda s, d: peaks(table(s, d, "events").select(F.col("user_id").alias("source_id"), (F.col("event_id") % 5000).alias("ix"), (F.floor(F.col("value") * 100).cast("long") % 65536 - 32768).alias("value"), F.lit(5200).cast("long").alias("length")), 64),
    "e10_rates": _rates,
    "e11_confusion": lambda s, d: confusion(judgments(s, d), "quality", "said"),
    "e12_money_rollup": _money,
    "e12_usage_rollup": _usage,
    "e13_macro_average": _macro,
    "e14_storage_delta": _delta,
    "e15_admission": lambda s, d: admission(ledger(s, d), 12_000_000, 4),
    "e16_staircase": _staircase,
    "e17_run_projection": _projection,
    "e18_bootstrap_interval": lambda s, d: bootstrap_interval(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(F.col("lang").alias("key"), F.col("doc_id").alias("pair"), (F.col("quality") - F.col("toxic")).cast("double").alias("delta"))),
    "e19_technical_delivery": _delivery,
}
ORACLES = {
    "e1_boundary_fusion": f"WITH {GRID_SQL}, {BOUNDARIES_SQL} SELECT source_id, ms, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max(score)::DOUBLE AS score, arg_min(kind, {_RANK}) AS primary_kind, arg_max(sentence_id, ins) FILTER (sentence_id IS NOT NULL) AS sentence_id FROM bnd GROUP BY source_id, ms",
    "e2_evidence_assembly": f"""WITH {GRID_SQL}, {BOUNDARIES_SQL}, f AS (SELECT source_id, ms, arg_min(kind, {_RANK}) AS primary_kind FROM bnd GROUP BY source_id, ms), v AS (SELECT source_id AS key, start_ms - 60 AS start_ms, end_ms - 60 AS end_ms FROM words),
        x AS (SELECT *, CASE WHEN start_ms > max(end_ms) OVER (PARTITION BY key ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM v), y AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY start_ms, end_ms) AS i FROM x), m AS (SELECT key, i, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM y GROUP BY ALL),
        c AS (SELECT f.source_id, f.ms, f.primary_kind, p.end_ms AS pe, q.start_ms AS ns FROM f ASOF LEFT JOIN m p ON p.key = f.source_id AND f.ms >= p.start_ms ASOF LEFT JOIN m q ON q.key = f.source_id AND f.ms <= q.start_ms), k AS (SELECT *, CASE WHEN ms < pe THEN 0 ELSE coalesce(least(ms - pe, ns - ms), ms) END::BIGINT AS clearance_ms FROM c)
        SELECT source_id, ms, primary_kind, clearance_ms, clearance_ms < 250 AND primary_kind <> 'edge' AS requires_review FROM k""",
    "e5_pooled_vectors": f"WITH {UNITS_SQL}, d AS (SELECT source_id, i - 1 AS dim, avg(vec[i]) AS m FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS i FROM units) GROUP BY ALL), n AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY source_id)) AS norm FROM d) SELECT source_id, dim, round(CASE WHEN norm > 0 THEN m / norm ELSE 0 END, 6) AS x FROM n",
    "e5_weighted_vectors": f"WITH {UNITS_SQL}, d AS (SELECT source_id, i - 1 AS dim, avg(vec[i]) AS m FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS i FROM units) GROUP BY ALL), n AS (SELECT source_id, dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY source_id)), 6) AS x FROM d), c AS (SELECT source_id, count(*) AS w FROM units GROUP BY 1), g AS (SELECT source_id // 3 AS section, dim, sum(x * w) / sum(w) AS m FROM n JOIN c USING (source_id) GROUP BY ALL) SELECT section, dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY section)), 5) AS x FROM g",
    "e7_quantiles_and_histogram": "WITH p AS (SELECT floor(value) / 512 AS p FROM events) SELECT 'p' || n AS name, round(v, 6) AS value FROM (SELECT unnest(['10', '50', '90', '99']) AS n, unnest(quantile_cont(p, [0.1, 0.5, 0.9, 0.99])) AS v FROM p) UNION ALL SELECT 'bin' || least(floor(p * 10), 9)::BIGINT, count(*)::DOUBLE FROM p GROUP BY 1",
    "e8_review_metrics": "SELECT user_id, count(*) FILTER (event_type = 'view') AS accepted, count(*) FILTER (event_type = 'error') AS rejected, round(avg(floor(value)), 6) AS mean_delta, round(quantile_cont(floor(value), 0.5), 6) AS median_delta, round(CASE WHEN count(*) FILTER (event_type IN ('view', 'error')) > 0 THEN count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'error')) END, 6) AS acceptance FROM events GROUP BY user_id",
    "e9_peaks": "WITH x AS (SELECT user_id AS source_id, event_id % 5000 AS ix, floor(value * 100)::BIGINT % 65536 - 32768 AS v FROM events), g AS (SELECT source_id, ix // 64 AS pixel, floor(min(v) / 256)::BIGINT AS lo, floor(max(v) / 256)::BIGINT AS hi FROM x GROUP BY ALL), a AS (SELECT source_id, unnest(range(0, 5199 // 64 + 1)) AS pixel FROM (SELECT DISTINCT source_id FROM x)) SELECT source_id, pixel, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM a LEFT JOIN g USING (source_id, pixel)",
    "e10_rates": f"WITH {_JUDGE}, g AS (SELECT lang, count(*) FILTER (quality = 1) AS num, count(quality) AS den, count(*) - count(quality) AS unknown FROM jd GROUP BY lang) SELECT *, round(CASE WHEN den > 0 THEN num / den END, 6) AS value, CASE WHEN den = 0 THEN 'no_cases' WHEN unknown > 0 THEN 'some_unknown' END AS reason FROM g",
    "e11_confusion": f"WITH {_JUDGE}, c AS (SELECT CASE quality WHEN 1 THEN 'valid' WHEN 0 THEN 'invalid' ELSE 'unknown' END AS truth, CASE said WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'unknown' END AS verdict, count(*) AS n FROM jd GROUP BY ALL), a(truth) AS (VALUES ('valid'), ('invalid'), ('unknown')), b(verdict) AS (VALUES ('approved'), ('rejected'), ('unknown')) SELECT a.truth, b.verdict, coalesce(n, 0) AS n FROM a CROSS JOIN b LEFT JOIN c ON c.truth = a.truth AND c.verdict = b.verdict",
    "e12_money_rollup": f"WITH {LEDGER_SQL} SELECT run, sum(cost) FILTER (state = 'F')::BIGINT AS known, count(*) FILTER (state <> 'F') AS unknown, sum(CASE WHEN state = 'O' AND flag = 'N' THEN cost ELSE 0 END)::BIGINT AS exposure FROM led GROUP BY run",
    "e12_usage_rollup": "SELECT user_id, k, sum(v)::BIGINT AS total FROM (SELECT user_id, 'input' AS k, floor(value)::BIGINT AS v FROM events UNION ALL SELECT user_id, 'output', event_id % 50 FROM events UNION ALL SELECT user_id, event_type, 1 FROM events) GROUP BY ALL",
    "e13_macro_average": f"WITH {_JUDGE}, c AS (SELECT quality, count(*) FILTER (quality = said) AS correct, count(*) AS total FROM jd WHERE quality IS NOT NULL AND said IS NOT NULL GROUP BY 1) SELECT round(avg(correct / total), 6) AS macro_accuracy, count(*) AS classes, sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total FROM c",
    "e14_storage_delta": "SELECT l_suppkey AS supp, (sum(l_quantity::BIGINT) - coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R'), 0))::BIGINT AS delta FROM lineitem GROUP BY 1",
    "e15_admission": f"""WITH RECURSIVE {LEDGER_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY attempt, cost) AS i FROM led), r AS (SELECT DISTINCT run, 0::BIGINT AS i, 0::BIGINT AS attempt, 0::BIGINT AS cost, 0::BIGINT AS running, 0::BIGINT AS n, false AS admitted FROM o
        UNION ALL SELECT run, i, attempt, cost, running + CASE WHEN ok THEN cost ELSE 0 END, n + ok::BIGINT, ok FROM (SELECT o.run, o.i, o.attempt, o.cost, r.running, r.n, r.running + o.cost <= 12000000 AND r.n < 4 AS ok FROM r JOIN o ON o.run = r.run AND o.i = r.i + 1))
        SELECT run, attempt, cost, running, admitted FROM r WHERE i > 0""",
    "e16_staircase": "WITH v AS (SELECT user_id AS block, event_type AS variant, count(*) AS value, min(event_id) % 5 = 0 AS bad FROM events GROUP BY ALL), l AS (SELECT *, lag(value) OVER w AS p, bad OR coalesce(lag(bad) OVER w, false) AS b FROM v WINDOW w AS (PARTITION BY block ORDER BY variant)) SELECT block, variant, value, CASE WHEN NOT b THEN value - p END AS delta, round(CASE WHEN NOT b AND p <> 0 THEN 100 * (value - p) / p END, 4) AS percent FROM l",
    "e17_run_projection": f"WITH {GRID_SQL}, g AS (SELECT source_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM grid GROUP BY 1) SELECT source_id, (n + 11) // 12 AS sections, (n + 79) // 80 AS windows, 2 + 3 * ((n + 11) // 12) + (n + 79) // 80 AS calls, (chars + 3) // 4 * 3 + 1000 AS cost_micros FROM g",
    "e19_technical_delivery": "SELECT l_orderkey AS run, bool_and(l_linestatus = 'F') AND count(*) FILTER (l_linenumber <= 2) = 2 AND count(DISTINCT l_linenumber) FILTER (l_linenumber <= 2) = 2 AS delivered FROM lineitem GROUP BY 1",
}
