"""Interval algebra and range or as-of lookups over spans and word timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.segment import GRID_SQL, sentence_grid
from lexiline.operators.segment import ORACLES as _DISPLAY
from lexiline.plans.ordered import as_of, merged, range_join, sweep
from lexiline.sources.timeline import SPANS_SQL, WORDS_SQL, by_source, spans, words

# fixed values: thresholds of the coverage assessment, in milliseconds and thousandths
COVERAGE_GAP_MS, COVERAGE_MISSING_MS, COVERAGE_RATIO, COVERAGE_TAIL_MS, COVERAGE_LEAST_SPEECH_MS = 3000, 10_000, 50, 5000, 1000
REPAIR_NEIGHBOURS, HANDOFF_CONTEXT, NEIGHBOUR_CHARS = 8, 16, 4000


def subtracted(source: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """What the intervals of source cover and those of covered don't, as disjoint intervals."""
    s = sweep({"src": source, "cov": covered}, keys).filter("n_src > 0 and n_cov = 0")
    return merged(s, keys).select(*keys, "start_ms", "end_ms")


def interval_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count("*").alias("n"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"), F.max("end_ms").alias("tail_ms"))


def coverage_assessment(detected: DataFrame, recognized: DataFrame, keys: list[str]) -> DataFrame:
    """How well recognized intervals cover detected ones: clear, needs_review or unknown for each key."""
    gaps = subtracted(detected, recognized, keys)
    heard = merged(detected, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.max("end_ms").alias("speech_end"))
    said = recognized.groupBy(*keys).agg(F.max("end_ms").alias("words_end"))  # words without length count here, too
    missing = gaps.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("missing_ms"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"), F.count("*").alias("gaps"))
    j = heard.join(said, keys, "full").join(missing, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    j = j.select(*keys, zero("speech_ms"), zero("missing_ms"), zero("longest_ms"), zero("gaps"), F.greatest(F.lit(0), F.coalesce(F.col("speech_end") - F.col("words_end"), F.lit(0))).cast("long").alias("tail_ms"), F.col("words_end").isNull().alias("silent"))
    review = (F.col("longest_ms") >= COVERAGE_GAP_MS) | (F.col("missing_ms") >= COVERAGE_MISSING_MS) | (1000 * F.col("missing_ms") >= COVERAGE_RATIO * F.col("speech_ms")) | (F.col("tail_ms") >= COVERAGE_TAIL_MS) | F.col("silent")
    return j.withColumn("status", F.when(F.col("speech_ms") < COVERAGE_LEAST_SPEECH_MS, "unknown").when(review, "needs_review").otherwise("clear"))


def inside_test(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Whether t lies strictly inside a merged interval."""
    met = as_of(points, merged(intervals, keys), keys, "t", "start_ms", ["end_ms"])
    return met.select(*points.columns, F.coalesce((F.col("t") > F.col("right_start_ms")) & (F.col("t") < F.col("right_end_ms")), F.lit(False)).alias("inside"))


def clearance(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """0 inside an interval, else the distance to the nearest one; t itself where there is none.

    Points and merged intervals are united once: the last interval before is carried along in order, the next one in reverse."""
    m = merged(intervals, keys).select(*keys, F.col("start_ms").alias("__t"), F.struct("start_ms", "end_ms").alias("__v"))
    both = points.withColumns({"__t": F.col("t"), "__side": F.lit(1)}).unionByName(m.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    carried = lambda *order: F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("__b", carried("__t", "__side")).withColumn("__a", carried(F.desc("__t"), "__side")).filter("__side = 1")
    before, after = F.col("t") - F.col("__b.end_ms"), F.col("__a.start_ms") - F.col("t")
    return met.select(*points.columns, F.when(F.col("t") < F.col("__b.end_ms"), 0).otherwise(F.coalesce(F.least(before, after), "t")).cast("long").alias("clearance_ms"))


def sentence_at(points: DataFrame, grid: DataFrame) -> DataFrame:
    """The sentence that has begun by t; the first one before any has."""
    met = as_of(points, grid.select("source_id", "start_ms", "sentence_id"), ["source_id"], "t", "start_ms", ["sentence_id"])
    return met.select(*points.columns, F.coalesce("right_sentence_id", F.lit(0)).cast("long").alias("sentence_id"))


def word_at(points: DataFrame, w: DataFrame) -> DataFrame:
    met = as_of(points, w.select("source_id", "start_ms", "ord"), ["source_id"], "t", "start_ms", ["ord"])
    return met.select(*points.columns, F.coalesce("right_ord", F.lit(-1)).cast("long").alias("ord"))


def paragraph_of_word(points: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The paragraph (first_word, last_word) that a word (t) belongs to, -1 for none."""
    met = as_of(points, paragraphs.select("source_id", "first_word", "last_word", "paragraph_id"), ["source_id"], "t", "first_word", ["last_word", "paragraph_id"])
    return met.select(*points.columns, F.when(F.col("t") <= F.col("right_last_word"), F.col("right_paragraph_id")).otherwise(-1).cast("long").alias("paragraph_id"))


def resolve_span(ids: DataFrame, grid: DataFrame) -> DataFrame:
    """Sentence ids (first, last) to times, clamped to the source's sentences."""
    n = grid.groupBy("source_id").agg(F.max("sentence_id").alias("top"))
    c = ids.join(n, "source_id").withColumns({"a": F.greatest(F.lit(0), F.least("first", "top")), "z": F.greatest(F.lit(0), F.least("last", "top"))}).withColumn("z", F.greatest("a", "z"))
    c = c.withColumn("clamped", (F.col("a") != F.col("first")) | (F.col("z") != F.col("last")))
    start = grid.select("source_id", F.col("sentence_id").alias("a"), "start_ms")
    end = grid.select("source_id", F.col("sentence_id").alias("z"), "end_ms")
    return c.join(start, ["source_id", "a"]).join(end, ["source_id", "z"]).select("source_id", "first", "last", "start_ms", "end_ms", "clamped")


def temporal_iou(a0, a1, b0, b1):
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def candidates(s: SparkSession, d: str, modulus: int = 5) -> DataFrame:
    """Sentence ranges to stand for proposed sections."""
    g = sentence_grid(words(s, d))
    top = g.groupBy("source_id").agg(F.max("sentence_id").alias("top"))
    c = g.join(top, "source_id").filter(f"sentence_id % {modulus} = 0")
    return c.select("source_id", F.col("sentence_id").alias("candidate_id"), F.col("sentence_id").alias("first"), F.least("top", F.col("sentence_id") + 3 + F.col("sentence_id") % 9).alias("last"), "top")


CANDIDATES_SQL = "cand AS (SELECT g.source_id, sentence_id AS candidate_id, sentence_id AS first, least(top, sentence_id + 3 + sentence_id % 9) AS last, top FROM grid g JOIN (SELECT source_id, max(sentence_id) AS top FROM grid GROUP BY 1) t ON g.source_id = t.source_id WHERE sentence_id % 5 = 0)"


def overlap_pairs(c: DataFrame) -> DataFrame:
    """Pairs of candidates whose sentence ranges meet, and where."""
    span = lambda p: c.select("source_id", F.col("candidate_id").alias(f"{p}_id"), F.col("first").alias(f"{p}_first"), (F.col("last") + 1).alias(f"{p}_end"))
    met = range_join(span("a"), span("b"), ["source_id"], ("a_first", "a_end"), ("b_first", "b_end"), 16).filter("a_id < b_id")
    return met.select("source_id", "a_id", "b_id", F.greatest("a_first", "b_first").alias("first"), (F.least("a_end", "b_end") - 1).alias("last"))


def handoffs(c: DataFrame, context: int = HANDOFF_CONTEXT) -> DataFrame:
    """Neighbours in (first, last, id) order that don't overlap, with the sentences of the first before the place between them, and of the second after it, so many at most."""
    w = by_source("first", "last", "candidate_id")
    n = c.withColumns({"next_id": F.lead("candidate_id").over(w), "next_first": F.lead("first").over(w), "next_last": F.lead("last").over(w)})
    h = n.filter("next_id is not null and next_first > last")
    return h.select("source_id", "candidate_id", "next_id", F.greatest("first", F.col("last") - context + 1).alias("before_first"), F.least("next_last", F.col("next_first") + context - 1).alias("after_last"))


def region_relations(c: DataFrame, regions: DataFrame) -> DataFrame:
    """Candidates and the regions (r_id, r_first, r_end) that they meet, by how."""
    a = c.select("source_id", "candidate_id", F.col("first").alias("c_first"), (F.col("last") + 1).alias("c_end"))
    met = range_join(a, regions, ["source_id"], ("c_first", "c_end"), ("r_first", "r_end"), 16)
    kind = (
        F.when((F.col("c_first") == F.col("r_first")) & (F.col("c_end") == F.col("r_end")), "same_extent").when((F.col("c_first") >= F.col("r_first")) & (F.col("c_end") <= F.col("r_end")), "inside")
        .when((F.col("c_first") <= F.col("r_first")) & (F.col("c_end") >= F.col("r_end")), "covers").when(F.col("c_first") < F.col("r_first"), "opening_overlap").otherwise("closing_overlap")
    )
    return met.select("source_id", "candidate_id", "r_id", kind.alias("relation"))


def section_owner(grid: DataFrame, sections: DataFrame) -> DataFrame:
    """The one section that owns each sentence; null where none or several do."""
    g = grid.select("source_id", "sentence_id", F.col("sentence_id").alias("p"), (F.col("sentence_id") + 1).alias("p_end"))
    met = range_join(g, sections, ["source_id"], ("p", "p_end"), ("r_first", "r_end"), 16).groupBy("source_id", "sentence_id").agg(F.count("*").alias("n"), F.min("r_id").alias("r_id"))
    return grid.select("source_id", "sentence_id").join(met, ["source_id", "sentence_id"], "left").select("source_id", "sentence_id", F.when(F.col("n") == 1, F.col("r_id")).alias("section_id"))


def repair_sentences(c: DataFrame, around: int = REPAIR_NEIGHBOURS) -> DataFrame:
    """All sentences within `around` of required spans, as disjoint runs."""
    s = c.select("source_id", F.greatest(F.lit(0), F.col("first") - around).cast("long").alias("start_ms"), (F.least("top", F.col("last") + around) + 1).alias("end_ms"))
    return merged(s, ["source_id"]).select("source_id", F.col("start_ms").alias("first"), (F.col("end_ms") - 1).alias("last"))


def neighbour_windows(grid: DataFrame, regions: DataFrame, chars: int = NEIGHBOUR_CHARS) -> DataFrame:
    """Sentences before and after each region within a budget of characters, one at least."""
    g = grid.select("source_id", "sentence_id", F.length("text").alias("len"))
    met = g.join(regions, "source_id")
    w = Window.partitionBy("source_id", "r_id")
    before = met.filter("sentence_id < r_first").withColumns({"rn": F.row_number().over(w.orderBy(F.desc("sentence_id"))), "run": F.sum("len").over(w.orderBy(F.desc("sentence_id")).rowsBetween(Window.unboundedPreceding, 0))})
    after = met.filter("sentence_id >= r_end").withColumns({"rn": F.row_number().over(w.orderBy("sentence_id")), "run": F.sum("len").over(w.orderBy("sentence_id").rowsBetween(Window.unboundedPreceding, 0))})
    keep = (F.col("run") <= chars) | (F.col("rn") == 1)
    side = lambda df, name: df.filter(keep).groupBy("source_id", "r_id").agg(F.min("sentence_id").alias("first"), F.max("sentence_id").alias("last")).withColumn("side", F.lit(name))
    return side(before, "before").unionByName(side(after, "after"))


def source_usage(s: DataFrame, keys: list[str]) -> DataFrame:
    """Covered and repeated time of each key, and the gaps in between."""
    m = merged(s, keys)
    order = Window.partitionBy(*keys).orderBy("start_ms")
    g = m.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(order)).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"), F.coalesce(F.sum("gap"), F.lit(0)).alias("unused_ms"), F.count("*").alias("pieces"))
    total = s.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))
    return g.join(total, keys).select(*keys, "covered_ms", "unused_ms", "pieces", (F.col("total_ms") - F.col("covered_ms")).alias("repeated_ms"))


def feasible_points(grid: DataFrame, frame_ms: int = 40) -> DataFrame:
    """For each pair of neighbouring sentences the first, middle and last frame between all that ended and all that begins."""
    w = by_source("sentence_id")
    lower, upper = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min("start_ms").over(w.rowsBetween(1, Window.unboundedFollowing))
    g = grid.select("source_id", "sentence_id", lower.alias("lower"), upper.alias("upper")).filter("upper >= lower")
    g = g.withColumns({"a": F.expr(f"(lower + {frame_ms} - 1) div {frame_ms}"), "z": F.expr(f"upper div {frame_ms}")}).filter("a <= z")
    return g.select("source_id", "sentence_id", F.explode(F.array_distinct(F.array("a", F.expr("(a + z) div 2"), "z"))).alias("frame"))


def fragment_coverage(f: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the character ranges [a, z) of each key run from 0 to its length without a gap."""
    w = Window.partitionBy(*keys).orderBy("a", "z")
    top = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return f.withColumn("gap", F.col("a") > F.coalesce(top, F.lit(0))).groupBy(*keys).agg((~F.max("gap") & (F.max("z") == F.max("length"))).alias("complete"), F.count("*").alias("fragments"))


def event_timeline(s: SparkSession, d: str) -> DataFrame:
    """Tagged union of what several sensors saw, in one order."""
    w = words(s, d)
    g = sentence_grid(w)
    kinds = [
        ("sentence", g.select("source_id", F.col("start_ms").alias("ms"), F.col("sentence_id").alias("id"))), ("turn", g.filter("opens_turn").select("source_id", F.col("start_ms").alias("ms"), F.col("sentence_id").alias("id"))),
        ("pause", g.filter("pause_after_ms >= 700").select("source_id", F.col("end_ms").alias("ms"), F.col("sentence_id").alias("id"))), ("shot", w.filter("ord % 17 = 5").select("source_id", (F.col("start_ms") + 300).alias("ms"), F.col("ord").alias("id"))),
    ]
    out = None
    for rank, (kind, df) in enumerate(kinds):
        part = df.withColumns({"kind": F.lit(kind), "rank": F.lit(rank)})
        out = part if out is None else out.unionByName(part)
    return out.withColumn("position", F.row_number().over(by_source("ms", "rank", "id")).cast("long")).drop("rank")


def omission_context(c: DataFrame, regions: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates that meet a region, and those linked with them."""
    a = c.select("source_id", "candidate_id", F.col("first").alias("c_first"), (F.col("last") + 1).alias("c_end"))
    met = range_join(a, regions, ["source_id"], ("c_first", "c_end"), ("r_first", "r_end"), 16).select("source_id", "r_id", "candidate_id")
    more = met.join(links, ["source_id", "candidate_id"]).select("source_id", "r_id", F.col("other_id").alias("candidate_id"))
    return met.unionByName(more).distinct()


def reused_length(s: DataFrame, keys: list[str]) -> DataFrame:
    """Of each span the time that other spans of its key also cover, each moment once."""
    a = s.select(*keys, F.col("id").alias("a_id"), F.col("start_ms").alias("a_s"), F.col("end_ms").alias("a_e"))
    b = s.select(*keys, F.col("id").alias("b_id"), F.col("start_ms").alias("b_s"), F.col("end_ms").alias("b_e"))
    met = range_join(a, b, keys, ("a_s", "a_e"), ("b_s", "b_e"), 3_600_000).filter("a_id <> b_id")
    clip = met.select(*keys, "a_id", F.greatest("a_s", "b_s").alias("start_ms"), F.least("a_e", "b_e").alias("end_ms"))
    u = merged(clip, [*keys, "a_id"]).groupBy(*keys, "a_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("reused_ms"))
    return s.select(*keys, F.col("id").alias("a_id")).join(u, [*keys, "a_id"], "left").select(*keys, F.col("a_id").alias("id"), F.coalesce("reused_ms", F.lit(0)).cast("long").alias("reused_ms"))


def regions(g: DataFrame, size: int = 12) -> DataFrame:
    return g.withColumn("r_id", F.expr(f"sentence_id div {size}")).groupBy("source_id", "r_id").agg(F.min("sentence_id").alias("r_first"), (F.max("sentence_id") + 1).alias("r_end"))


REGIONS_SQL = "reg AS (SELECT source_id, sentence_id // 12 AS r_id, min(sentence_id) AS r_first, max(sentence_id) + 1 AS r_end FROM grid GROUP BY ALL)"


def points(s: SparkSession, d: str, which: str = "id % 3 = 0") -> DataFrame:
    return spans(s, d).filter(which).select("key", "id", (F.col("start_ms") + 45_000).alias("t"))


POINTS_SQL = "pts AS (SELECT key, id, start_ms + 45000 AS t FROM spans WHERE id % 3 = 0)"


def word_points(s: SparkSession, d: str, which: str = "ord % 5 = 2") -> DataFrame:
    return words(s, d).filter(which).select("source_id", "ord", (F.col("start_ms") - 777).alias("t"))


_WP = "wp AS (SELECT source_id, ord, start_ms - 777 AS t FROM words WHERE ord % 5 = 2)"
_MERGED = lambda src, out, keys="key", op=">": f"""{out}_f AS (SELECT {keys}, start_ms, end_ms, CASE WHEN start_ms {op} max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS x FROM {src} WHERE start_ms < end_ms),
{out}_i AS (SELECT *, sum(x) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms) AS island FROM {out}_f), {out} AS (SELECT {keys}, island::BIGINT AS island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members FROM {out}_i GROUP BY ALL)"""  # noqa: E731
_VIEW = "det AS (SELECT * FROM spans WHERE kind IN ('view', 'click')), rec AS (SELECT * FROM spans WHERE kind NOT IN ('view', 'click'))"
_SUB = f"""{_VIEW}, cut AS (SELECT DISTINCT key, t FROM (SELECT key, start_ms AS t FROM spans UNION ALL SELECT key, end_ms FROM spans)), seg AS (SELECT key, t AS start_ms, lead(t) OVER (PARTITION BY key ORDER BY t) AS end_ms FROM cut),
free AS (SELECT * FROM seg s WHERE end_ms IS NOT NULL AND EXISTS (SELECT 1 FROM det d WHERE d.key = s.key AND d.start_ms <= s.start_ms AND d.end_ms >= s.end_ms) AND NOT EXISTS (SELECT 1 FROM rec d WHERE d.key = s.key AND d.start_ms <= s.start_ms AND d.end_ms >= s.end_ms)), {_MERGED('free', 'gap')}"""


def _two(s, d):
    x = spans(s, d)
    view = F.col("kind").isin("view", "click")
    return x.filter(view), x.filter(~view)


def _cand(f):
    return lambda s, d: f(candidates(s, d))


def _paras(s, d, which="ord % 5 = 2"):
    from lexiline.operators.segment import display_paragraphs

    return paragraph_of_word(words(s, d).filter(which).select("source_id", (F.col("ord") + 40).alias("t")), display_paragraphs(words(s, d)))


def _fragments(s, d):
    g = sentence_grid(words(s, d)).withColumn("length", F.length("text").cast("long"))
    f = g.select("source_id", "sentence_id", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(30))).alias("a")).withColumn("z", F.least("length", F.col("a") + 30))
    return fragment_coverage(f.filter("(source_id + sentence_id + a) % 37 <> 4"), ["source_id", "sentence_id"])


_DISPLAY_SQL = _DISPLAY["b7_display_paragraphs"].rpartition("SELECT source_id, row_number()")[0] + ", dp AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY first_word) - 1 AS paragraph_id, first_word, last_word FROM g)"

QUERIES = {
    "c1_merge_intervals": lambda s, d: merged(spans(s, d), ["key"]),
    "c1b_spoken_islands": lambda s, d: merged(spans(s, d), ["key"], touching=False).select("key", "start_ms", "end_ms", "members"),
    "c2_subtract_intervals": lambda s, d: subtracted(*_two(s, d), ["key"]),
    "c3_interval_totals": lambda s, d: interval_totals(subtracted(*_two(s, d), ["key"]), ["key"]),
    "c4_coverage_assessment": lambda s, d: coverage_assessment(*_two(s, d), ["key"]),
    "c5_inside_test": lambda s, d: inside_test(points(s, d), spans(s, d).filter("kind = 'view'"), ["key"]),
    "c5_inside_test_all": lambda s, d: inside_test(points(s, d, "true"), spans(s, d).filter("kind = 'view'"), ["key"]),
    "c6_clearance": lambda s, d: clearance(points(s, d), spans(s, d).filter("kind = 'view'"), ["key"]),
    "c6_clearance_all": lambda s, d: clearance(points(s, d, "true"), spans(s, d).filter("kind = 'view'"), ["key"]),
    "c7_sentence_at": lambda s, d: sentence_at(word_points(s, d), sentence_grid(words(s, d))),
    "c7_sentence_at_all": lambda s, d: sentence_at(word_points(s, d, "true"), sentence_grid(words(s, d))),
    "c7_word_at": lambda s, d: word_at(word_points(s, d).drop("ord"), words(s, d)),
    "c7_word_at_all": lambda s, d: word_at(word_points(s, d, "true").drop("ord"), words(s, d)),
    "c8_paragraph_of_word": _paras,
    "c8_paragraph_of_word_all": lambda s, d: _paras(s, d, "true"),
    "c9_resolve_span": lambda s, d: resolve_span(candidates(s, d).select("source_id", (F.col("first") - 2).alias("first"), (F.col("last") + 4).alias("last")), sentence_grid(words(s, d))),
    "c10_temporal_iou": lambda s, d: spans(s, d).withColumn("n", F.lead("start_ms").over(Window.partitionBy("key").orderBy("start_ms", "id"))).withColumn("m", F.lead("end_ms").over(Window.partitionBy("key").orderBy("start_ms", "id"))).filter("n is not null").select("key", "id", F.round(temporal_iou(F.col("start_ms"), F.col("end_ms"), F.col("n"), F.col("m")), 6).alias("iou")),
    "c11_overlap_pairs": _cand(overlap_pairs),
    "c12_handoffs": _cand(handoffs),
    "c13_region_relations": lambda s, d: region_relations(candidates(s, d), regions(sentence_grid(words(s, d)))),
    "c14_event_timeline": event_timeline,
    "c15_section_owner": lambda s, d: section_owner(sentence_grid(words(s, d)), candidates(s, d).select("source_id", F.col("candidate_id").alias("r_id"), F.col("first").alias("r_first"), (F.col("last") + 1).alias("r_end"))),
    "c16_omission_context": lambda s, d: omission_context(candidates(s, d), regions(sentence_grid(words(s, d))), candidates(s, d).select("source_id", "candidate_id", (F.col("candidate_id") + 10).alias("other_id"))),
    "c17_repair_sentences": _cand(lambda c: repair_sentences(c.filter("candidate_id % 15 = 0"))),
    "c18_neighbour_windows": lambda s, d: (lambda g: neighbour_windows(g, regions(g), 400))(sentence_grid(words(s, d))),
    "c19_source_usage": lambda s, d: source_usage(spans(s, d), ["key"]),
    "c20_free_regions": lambda s, d: (lambda a, b: subtracted(a.groupBy("key").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")), b, ["key"]))(*_two(s, d)),
    "c21_feasible_points": lambda s, d: feasible_points(sentence_grid(words(s, d))),
    "c22_fragment_coverage": _fragments,
    "x1_reused_length": lambda s, d: reused_length(spans(s, d), ["key"]),
}
ORACLES = {
    "c1_merge_intervals": f"WITH {SPANS_SQL}, {_MERGED('spans', 'm')} SELECT * FROM m",
    "c1b_spoken_islands": f"WITH {SPANS_SQL}, {_MERGED('spans', 'm', op='>=')} SELECT key, start_ms, end_ms, members FROM m",
    "c2_subtract_intervals": f"WITH {SPANS_SQL}, {_SUB} SELECT key, start_ms, end_ms FROM gap",
    "c3_interval_totals": f"WITH {SPANS_SQL}, {_SUB} SELECT key, sum(end_ms - start_ms)::BIGINT AS total_ms, count(*) AS n, max(end_ms - start_ms) AS longest_ms, max(end_ms) AS tail_ms FROM gap GROUP BY key",
    "c4_coverage_assessment": f"""WITH {SPANS_SQL}, {_SUB}, {_MERGED('det', 'dm')}, h AS (SELECT key, sum(end_ms - start_ms)::BIGINT AS speech_ms, max(end_ms) AS se FROM dm GROUP BY key), r AS (SELECT key, max(end_ms) AS we FROM rec GROUP BY key), g AS (SELECT key, sum(end_ms - start_ms)::BIGINT AS missing_ms, max(end_ms - start_ms) AS longest_ms, count(*) AS gaps FROM gap GROUP BY key),
        j AS (SELECT key, coalesce(speech_ms, 0)::BIGINT AS speech_ms, coalesce(missing_ms, 0)::BIGINT AS missing_ms, coalesce(longest_ms, 0)::BIGINT AS longest_ms, coalesce(gaps, 0)::BIGINT AS gaps, greatest(0, coalesce(se - we, 0))::BIGINT AS tail_ms, we IS NULL AS silent FROM h FULL JOIN r USING (key) LEFT JOIN g USING (key))
        SELECT *, CASE WHEN speech_ms < {COVERAGE_LEAST_SPEECH_MS} THEN 'unknown' WHEN longest_ms >= {COVERAGE_GAP_MS} OR missing_ms >= {COVERAGE_MISSING_MS} OR 1000 * missing_ms >= {COVERAGE_RATIO} * speech_ms OR tail_ms >= {COVERAGE_TAIL_MS} OR silent THEN 'needs_review' ELSE 'clear' END AS status FROM j""",
    "c5_inside_test": f"WITH {SPANS_SQL}, {POINTS_SQL}, v AS (SELECT * FROM spans WHERE kind = 'view'), {_MERGED('v', 'm')} SELECT key, id, t, EXISTS (SELECT 1 FROM m WHERE m.key = pts.key AND m.start_ms < t AND t < m.end_ms) AS inside FROM pts",
    "c6_clearance": f"WITH {SPANS_SQL}, {POINTS_SQL}, v AS (SELECT * FROM spans WHERE kind = 'view'), {_MERGED('v', 'm')} SELECT pts.key, pts.id, pts.t, coalesce(min(CASE WHEN m.start_ms <= t AND t < m.end_ms THEN 0 WHEN m.end_ms <= t THEN t - m.end_ms ELSE m.start_ms - t END), any_value(t))::BIGINT AS clearance_ms FROM pts LEFT JOIN m ON m.key = pts.key GROUP BY ALL",
    "c7_sentence_at": f"WITH {GRID_SQL}, {_WP} SELECT wp.source_id, wp.ord, wp.t, coalesce(g.sentence_id, 0)::BIGINT AS sentence_id FROM wp ASOF LEFT JOIN grid g ON g.source_id = wp.source_id AND wp.t >= g.start_ms",
    "c7_word_at": f"WITH {WORDS_SQL}, {_WP} SELECT source_id, w0 AS ord, t FROM (SELECT wp.source_id, wp.t, coalesce(w.ord, -1)::BIGINT AS w0 FROM wp ASOF LEFT JOIN words w ON w.source_id = wp.source_id AND wp.t >= w.start_ms)",
    "c8_paragraph_of_word": _DISPLAY_SQL + ", q AS (SELECT source_id, ord + 40 AS t FROM words WHERE ord % 5 = 2) SELECT q.source_id, q.t, coalesce(p.paragraph_id, -1)::BIGINT AS paragraph_id FROM q LEFT JOIN dp p ON p.source_id = q.source_id AND q.t BETWEEN p.first_word AND p.last_word",
    "c9_resolve_span": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, i AS (SELECT source_id, first - 2 AS first, last + 4 AS last, greatest(0, least(first - 2, top)) AS a, greatest(0, least(last + 4, top)) AS z FROM cand) SELECT i.source_id, first, last, s.start_ms, e.end_ms, (a <> first OR greatest(a, z) <> last) AS clamped FROM i JOIN grid s ON s.source_id = i.source_id AND s.sentence_id = a JOIN grid e ON e.source_id = i.source_id AND e.sentence_id = greatest(a, z)",
    "c10_temporal_iou": f"WITH {SPANS_SQL}, n AS (SELECT *, lead(start_ms) OVER w AS n, lead(end_ms) OVER w AS m FROM spans WINDOW w AS (PARTITION BY key ORDER BY start_ms, id)), u AS (SELECT *, greatest(0, least(end_ms, m) - greatest(start_ms, n)) AS b FROM n WHERE n IS NOT NULL) SELECT key, id, CASE WHEN end_ms - start_ms + m - n - b > 0 THEN round(b / (end_ms - start_ms + m - n - b)::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS iou FROM u",
    "c11_overlap_pairs": f"WITH {GRID_SQL}, {CANDIDATES_SQL} SELECT a.source_id, a.candidate_id AS a_id, b.candidate_id AS b_id, greatest(a.first, b.first) AS first, least(a.last, b.last) AS last FROM cand a JOIN cand b ON a.source_id = b.source_id AND a.candidate_id < b.candidate_id AND a.first <= b.last AND b.first <= a.last",
    "c12_handoffs": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, n AS (SELECT *, lead(candidate_id) OVER w AS next_id, lead(first) OVER w AS nf, lead(last) OVER w AS nl FROM cand WINDOW w AS (PARTITION BY source_id ORDER BY first, last, candidate_id)) SELECT source_id, candidate_id, next_id, greatest(first, last - {HANDOFF_CONTEXT} + 1) AS before_first, least(nl, nf + {HANDOFF_CONTEXT} - 1) AS after_last FROM n WHERE nf > last",
    "c13_region_relations": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, {REGIONS_SQL} SELECT c.source_id, candidate_id, r_id, CASE WHEN first = r_first AND last + 1 = r_end THEN 'same_extent' WHEN first >= r_first AND last + 1 <= r_end THEN 'inside' WHEN first <= r_first AND last + 1 >= r_end THEN 'covers' WHEN first < r_first THEN 'opening_overlap' ELSE 'closing_overlap' END AS relation FROM cand c JOIN reg r ON c.source_id = r.source_id AND first < r_end AND r_first <= last",
    "c14_event_timeline": f"WITH {GRID_SQL}, u AS (SELECT source_id, start_ms AS ms, sentence_id AS id, 'sentence' AS kind, 0 AS k FROM grid UNION ALL SELECT source_id, start_ms, sentence_id, 'turn', 1 FROM grid WHERE opens_turn UNION ALL SELECT source_id, end_ms, sentence_id, 'pause', 2 FROM grid WHERE pause_after_ms >= 700 UNION ALL SELECT source_id, start_ms + 300, ord, 'shot', 3 FROM words WHERE ord % 17 = 5) SELECT source_id, ms, id, kind, row_number() OVER (PARTITION BY source_id ORDER BY ms, k, id) AS position FROM u",
    "c15_section_owner": f"WITH {GRID_SQL}, {CANDIDATES_SQL} SELECT g.source_id, g.sentence_id, CASE WHEN count(c.candidate_id) = 1 THEN min(c.candidate_id) END AS section_id FROM grid g LEFT JOIN cand c ON c.source_id = g.source_id AND g.sentence_id BETWEEN c.first AND c.last GROUP BY ALL",
    "c16_omission_context": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, {REGIONS_SQL}, m AS (SELECT c.source_id, r_id, candidate_id FROM cand c JOIN reg r ON c.source_id = r.source_id AND first < r_end AND r_first <= last) SELECT * FROM m UNION SELECT m.source_id, r_id, m.candidate_id + 10 FROM m",
    "c17_repair_sentences": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, s AS (SELECT source_id, greatest(0, first - 8) AS start_ms, least(top, last + 8) + 1 AS end_ms FROM cand WHERE candidate_id % 15 = 0), {_MERGED('s', 'm', 'source_id')} SELECT source_id, start_ms AS first, end_ms - 1 AS last FROM m",
    "c18_neighbour_windows": f"""WITH {GRID_SQL}, {REGIONS_SQL}, j AS (SELECT g.source_id, g.sentence_id, length(text) AS len, r_id, r_first, r_end FROM grid g JOIN reg r ON g.source_id = r.source_id),
        b AS (SELECT *, row_number() OVER w AS rn, sum(len) OVER w AS run FROM j WHERE sentence_id < r_first WINDOW w AS (PARTITION BY source_id, r_id ORDER BY sentence_id DESC)), a AS (SELECT *, row_number() OVER w AS rn, sum(len) OVER w AS run FROM j WHERE sentence_id >= r_end WINDOW w AS (PARTITION BY source_id, r_id ORDER BY sentence_id))
        SELECT source_id, r_id, min(sentence_id) AS first, max(sentence_id) AS last, 'before' AS side FROM b WHERE run <= 400 OR rn = 1 GROUP BY ALL UNION ALL SELECT source_id, r_id, min(sentence_id), max(sentence_id), 'after' FROM a WHERE run <= 400 OR rn = 1 GROUP BY ALL""",
    "c19_source_usage": f"WITH {SPANS_SQL}, {_MERGED('spans', 'm')}, g AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY key ORDER BY start_ms) AS gap FROM m), c AS (SELECT key, sum(end_ms - start_ms)::BIGINT AS covered_ms, coalesce(sum(gap), 0)::BIGINT AS unused_ms, count(*) AS pieces FROM g GROUP BY key) SELECT c.key, covered_ms, unused_ms, pieces, (t.total - covered_ms)::BIGINT AS repeated_ms FROM c JOIN (SELECT key, sum(end_ms - start_ms) AS total FROM spans GROUP BY key) t ON c.key = t.key",
    "c20_free_regions": f"WITH {SPANS_SQL}, {_VIEW}, hull AS (SELECT key, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM det GROUP BY key), cut AS (SELECT DISTINCT key, t FROM (SELECT key, start_ms AS t FROM rec UNION ALL SELECT key, end_ms FROM rec UNION ALL SELECT key, start_ms FROM hull UNION ALL SELECT key, end_ms FROM hull)), seg AS (SELECT key, t AS start_ms, lead(t) OVER (PARTITION BY key ORDER BY t) AS end_ms FROM cut), free AS (SELECT s.* FROM seg s JOIN hull h ON h.key = s.key AND h.start_ms <= s.start_ms AND h.end_ms >= s.end_ms WHERE s.end_ms IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rec d WHERE d.key = s.key AND d.start_ms <= s.start_ms AND d.end_ms >= s.end_ms)), {_MERGED('free', 'm')} SELECT key, start_ms, end_ms FROM m",
    "c21_feasible_points": f"WITH {GRID_SQL}, b AS (SELECT source_id, sentence_id, max(end_ms) OVER (PARTITION BY source_id ORDER BY sentence_id) AS lo, min(start_ms) OVER (PARTITION BY source_id ORDER BY sentence_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM grid), f AS (SELECT *, (lo + 39) // 40 AS a, hi // 40 AS z FROM b WHERE hi >= lo) SELECT source_id, sentence_id, unnest(list_distinct([a, (a + z) // 2, z])) AS frame FROM f WHERE a <= z",
    "c22_fragment_coverage": f"WITH {GRID_SQL}, f AS (SELECT source_id, sentence_id, length(text) AS n, unnest(range(0, length(text), 30)) AS a FROM grid), k AS (SELECT *, least(n, a + 30) AS z FROM f WHERE (source_id + sentence_id + a) % 37 <> 4), g AS (SELECT *, a > coalesce(max(z) OVER (PARTITION BY source_id, sentence_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM k) SELECT source_id, sentence_id, NOT bool_or(gap) AND max(z) = max(n) AS complete, count(*) AS fragments FROM g GROUP BY ALL",
    "x1_reused_length": f"WITH {SPANS_SQL}, clip AS (SELECT a.key, a.id, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms FROM spans a JOIN spans b ON a.key = b.key AND a.id <> b.id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms), {_MERGED('clip', 'm', 'key, id')}, u AS (SELECT key, id, sum(end_ms - start_ms)::BIGINT AS r FROM m GROUP BY ALL) SELECT s.key, s.id, coalesce(r, 0)::BIGINT AS reused_ms FROM spans s LEFT JOIN u ON u.key = s.key AND u.id = s.id",
}
# the lookups of every event and every word
ORACLES |= {f"{n}_all": ORACLES[n].replace(" WHERE id % 3 = 0", "").replace(" WHERE ord % 5 = 2", "") for n in ("c5_inside_test", "c6_clearance", "c7_sentence_at", "c7_word_at", "c8_paragraph_of_word") if n in ORACLES}
