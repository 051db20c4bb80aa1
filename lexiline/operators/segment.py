"""Segmentation of word timelines: sentences, turns, pauses, paragraphs, cues, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.plans.ordered import fold, islands, trail
from lexiline.sources.timeline import WORDS_SQL, by_source, words

# fixed values: thresholds in milliseconds, words and characters, and patterns
PAUSE_MS, PARAGRAPH_GAP_MS, PARAGRAPH_WORDS = 700, 2500, 120
CUE_SILENCE_MS, CUE_CHARS, CUE_SPAN_MS = 750, 70, 7000
RENDER_CUE_WORDS, RENDER_CUE_GAP_MS, RENDER_CUE_SPAN_MS = 12, 1000, 6000
REGION_SENTENCES, REGION_CHARS, UNIT_CHARS = 32, 8000, 800
TERMINAL = r"[.!?][\"')\]\u201D\u2019]*\z"
QUESTION = r"\?[\"')\]\u201D\u2019]*\z"
TERMINAL_SQL = "[.!?][\"'')\\]\u201d\u2019]*$"
QUESTION_SQL = "\\?[\"'')\\]\u201d\u2019]*$"


def with_sentences(w: DataFrame) -> DataFrame:
    """words with sentence_id: a sentence starts after a word that ends one."""
    order = by_source()
    return islands(w, F.lag("text").over(order).rlike(TERMINAL), ["source_id"], ["ord"], "sentence_id")


def sentence_starts(w: DataFrame) -> DataFrame:
    return with_sentences(w).groupBy("source_id", "sentence_id").agg(F.min("ord").alias("ord"), F.min_by("start_ms", "ord").alias("start_ms"))


def pause_boundaries(w: DataFrame, gap: int = PAUSE_MS) -> DataFrame:
    silence = F.col("start_ms") - F.lag("end_ms").over(by_source())
    return w.withColumn("pause_ms", silence).filter(F.col("pause_ms") >= gap).select("source_id", "ord", "start_ms", "pause_ms")


def sentence_times(w: DataFrame) -> DataFrame:
    s = with_sentences(w)
    return s.groupBy("source_id", "sentence_id").agg(F.min_by("start_ms", "ord").alias("start_ms"), F.max_by("end_ms", "ord").alias("end_ms"))


def turn_starts(w: DataFrame) -> DataFrame:
    order = by_source()
    same = F.col("speaker").eqNullSafe(F.lag("speaker").over(order))
    return w.withColumn("n", F.row_number().over(order)).withColumn("same", same).filter((F.col("n") == 1) | ~F.col("same")).select("source_id", "ord", "start_ms", "speaker")


def sentence_grid(w: DataFrame) -> DataFrame:
    """One row for each sentence with its turn and pause marks."""
    s = with_sentences(w).groupBy("source_id", "sentence_id").agg(
        F.min("ord").alias("word_start"), F.max("ord").alias("word_end"), F.count("*").alias("word_count"), F.min_by("speaker", "ord").alias("speaker"),
        F.min_by("start_ms", "ord").alias("start_ms"), F.max_by("end_ms", "ord").alias("end_ms"), F.max_by("text", "ord").rlike(QUESTION).alias("is_question"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    o = by_source("sentence_id")
    before, after, n = F.lag("speaker").over(o), F.lead("speaker").over(o), F.lead("start_ms").over(o)
    first, last = F.lag("sentence_id").over(o).isNull(), F.lead("sentence_id").over(o).isNull()
    return s.withColumns({
        "opens_turn": first | ~F.col("speaker").eqNullSafe(before), "ends_turn": last | ~F.col("speaker").eqNullSafe(after),
        "pause_after_ms": F.coalesce(F.greatest(F.lit(0), n - F.col("end_ms")), F.lit(0)).cast("long"),
    })


def _paragraph_step(state, row):
    speaker, start, end, count = row
    if state is None or state[0] != speaker or start - state[1] > PARAGRAPH_GAP_MS or state[2] + count > PARAGRAPH_WORDS:
        return (speaker, end, count), 1
    return (speaker, end, state[2] + count), 0


def packed_paragraphs(grid: DataFrame) -> DataFrame:
    """Sentences packed into paragraphs. Speaker and gap breaks are windows; only the word cap, which starts anew at each break, is folded inside."""
    o = by_source("sentence_id")
    cut = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(o)) | (F.col("start_ms") - F.lag("end_ms").over(o) > PARAGRAPH_GAP_MS)
    inside = islands(grid.select("source_id", "sentence_id", "speaker", "start_ms", "end_ms", "word_count"), cut, ["source_id"], ["sentence_id"])
    folded = fold(inside, ["source_id", "island"], ["sentence_id"], ["speaker", "start_ms", "end_ms", "word_count"], _paragraph_step, "part")
    new = islands(folded, (F.col("island") != F.lag("island").over(o)) | (F.col("part") != F.lag("part").over(o)), ["source_id"], ["sentence_id"], "paragraph_id")
    out = new.groupBy("source_id", "paragraph_id").agg(
        F.min("sentence_id").alias("sentence_start"), F.max("sentence_id").alias("sentence_end"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "sentence_id").alias("end_ms"),
        F.min_by("speaker", "sentence_id").alias("speaker"), F.sum("word_count").cast("long").alias("word_count"),
    )
    p = by_source("paragraph_id")
    turn, pause = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(p)), F.col("start_ms") - F.lag("end_ms").over(p) > PARAGRAPH_GAP_MS
    return out.withColumn("break_reason", F.when(F.col("paragraph_id") == 0, "start").when(turn, "turn").when(pause, "pause").otherwise("cap"))


def display_paragraphs(w: DataFrame) -> DataFrame:
    """Word-level paragraphs: the cap is a division inside each island, so no fold is needed."""
    o = by_source()
    cut = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(o)) | (F.col("start_ms") - F.lag("end_ms").over(o) > PARAGRAPH_GAP_MS)
    i = islands(w, cut, ["source_id"], ["ord"])
    part = F.floor((F.row_number().over(Window.partitionBy("source_id", "island").orderBy("ord")) - 1) / PARAGRAPH_WORDS)
    i = i.withColumn("part", part).groupBy("source_id", "island", "part").agg(F.min("ord").alias("first_word"), F.max("ord").alias("last_word"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker"))
    return i.select("source_id", (F.row_number().over(by_source("first_word")) - 1).cast("long").alias("paragraph_id"), "first_word", "last_word", "start_ms", "end_ms", "speaker")


def _viewer_step(state, row):
    start, end = row
    if state is None or state[1] >= PARAGRAPH_WORDS or start - state[0] > PARAGRAPH_GAP_MS:
        return (end, 1), 1
    return (max(state[0], end), state[1] + 1), 0


def viewer_paragraphs(w: DataFrame) -> DataFrame:
    """Inside each utterance; the gap is taken from the furthest end of the open paragraph."""
    u = islands(w.select("source_id", "ord", "speaker", "start_ms", "end_ms"), ~F.col("speaker").eqNullSafe(F.lag("speaker").over(by_source())), ["source_id"], ["ord"], "utterance")
    f = fold(u, ["source_id", "utterance"], ["ord"], ["start_ms", "end_ms"], _viewer_step, "part")
    return f.groupBy("source_id", "utterance", "part").agg(F.min("ord").alias("first_word"), F.max("ord").alias("last_word"), F.count("*").alias("words"))


def utterances(w: DataFrame) -> DataFrame:
    u = islands(w, ~F.col("speaker").eqNullSafe(F.lag("speaker").over(by_source())), ["source_id"], ["ord"], "utterance")
    return u.groupBy("source_id", "utterance").agg(F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("ord").alias("first_word"), F.count("*").alias("words"))


def words_by_utterance(w: DataFrame) -> DataFrame:
    return islands(w, ~F.col("speaker").eqNullSafe(F.lag("speaker").over(by_source())), ["source_id"], ["ord"], "utterance").select("source_id", "ord", "utterance")


def layer_candidates(paragraphs: DataFrame) -> DataFrame:
    """Paragraph starts that broke on a turn or a pause."""
    return paragraphs.filter(F.col("break_reason").isin("turn", "pause")).select("source_id", F.col("sentence_start").alias("sentence_id"), F.col("start_ms").alias("ms"), F.col("break_reason").alias("kind"), F.lit(1.0).alias("score"))


def _tag(c):
    n = c.try_cast("int")
    return F.when(c.isNull(), "S?").when(n.isNotNull(), F.concat(F.lit("S"), (n + 1).cast("string"))).otherwise(F.concat(F.lit("S"), c))


def coarse_rendering(grid: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A line for each paragraph: number, time, speaker, text."""
    p = paragraphs.select(F.col("source_id").alias("ps"), "paragraph_id", "sentence_start", "sentence_end", F.col("start_ms").alias("at"), F.col("speaker").alias("who"))
    met = grid.join(p, (F.col("source_id") == F.col("ps")) & F.col("sentence_id").between(F.col("sentence_start"), F.col("sentence_end")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"]), " ")
    g = met.groupBy("source_id", "paragraph_id").agg(F.first("at").alias("at"), F.first("who").alias("who"), text.alias("text"))
    clock = F.format_string("%02d:%02d", F.expr("at div 60000"), F.expr("at div 1000 % 60"))
    return g.select("source_id", "paragraph_id", F.concat(F.format_string("P%03d [", F.col("paragraph_id") + 1), clock, F.lit("] "), _tag(F.col("who")), F.lit(": "), "text").alias("line"))


def fine_rendering(grid: DataFrame, paragraphs: DataFrame, shots: DataFrame, near: int = 500) -> DataFrame:
    """A line for each sentence with glyphs for paragraph start, turn, pause and a shot nearby."""
    starts = paragraphs.select("source_id", F.col("sentence_start").alias("sentence_id"), F.lit("P").alias("p"))
    close = grid.select("source_id", "sentence_id", "start_ms").join(shots, "source_id").filter(F.abs(F.col("time_ms") - F.col("start_ms")) <= near).select("source_id", "sentence_id").distinct().withColumn("s", F.lit("S"))
    g = grid.join(starts, ["source_id", "sentence_id"], "left").join(close, ["source_id", "sentence_id"], "left")
    before = F.lag("pause_after_ms").over(by_source("sentence_id"))
    marks = F.concat(F.coalesce("p", F.lit(".")), F.when(F.col("opens_turn"), "T").otherwise("."), F.when(before >= PAUSE_MS, "|").otherwise("."), F.coalesce("s", F.lit(".")))
    clock = F.format_string("%02d:%02d", F.expr("start_ms div 60000"), F.expr("start_ms div 1000 % 60"))
    return g.select("source_id", "sentence_id", F.concat(marks, F.lit(" ["), clock, F.lit("] "), _tag(F.col("speaker")), F.lit(" "), "text").alias("line"))


def model_sentences(w: DataFrame, pieces: DataFrame) -> DataFrame:
    """Words given to model sentences (source_id, piece, length in characters of the joined text) by where they start; the speaker is that of most words, of
    equal ones the first, the end the furthest."""
    o = by_source()
    at = w.withColumn("char", F.sum(F.length("text") + 1).over(o.rowsBetween(Window.unboundedPreceding, -1)))
    at = at.withColumn("char", F.coalesce("char", F.lit(0)))
    p = pieces.withColumn("upto", F.sum("length").over(by_source("piece").rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("upto") - F.col("length"))
    met = at.join(p.select(F.col("source_id").alias("ps"), "piece", "from", "upto"), (F.col("source_id") == F.col("ps")) & (F.col("char") >= F.col("from")) & (F.col("char") < F.col("upto")))
    votes = met.groupBy("source_id", "piece", "speaker").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    top = votes.groupBy("source_id", "piece").agg(F.min_by("speaker", F.struct(-F.col("n"), F.col("first"))).alias("speaker"))
    times = met.groupBy("source_id", "piece").agg(F.min("ord").alias("word_start"), F.max("ord").alias("word_end"), F.min_by("start_ms", "ord").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return times.join(top, ["source_id", "piece"])


def _cue_step(state, row):
    text, speaker, start, end = row
    if state is None or state["ends"] or state["speaker"] != speaker or start - state["end"] > CUE_SILENCE_MS or state["chars"] + 1 + len(text) > CUE_CHARS or end - state["start"] > CUE_SPAN_MS:
        state, opens = {"speaker": speaker, "start": start, "chars": len(text)}, 1
    else:
        state, opens = state | {"chars": state["chars"] + 1 + len(text)}, 0
    return state | {"end": end, "ends": text.rstrip("\"')]\u201d\u2019")[-1:] in {".", "!", "?"} if text else False}, opens


def caption_cues(w: DataFrame) -> DataFrame:
    """Cues of captions: speaker, sentence end, silence, characters and span, all since the cue began."""
    o = by_source()
    sure = F.lag("text").over(o).rlike(TERMINAL) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(o)) | (F.col("start_ms") - F.lag("end_ms").over(o) > CUE_SILENCE_MS)
    inside = islands(w.select("source_id", "ord", "text", "speaker", "start_ms", "end_ms"), sure, ["source_id"], ["ord"])
    f = fold(inside, ["source_id", "island"], ["ord"], ["text", "speaker", "start_ms", "end_ms"], _cue_step, "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    cues = f.groupBy("source_id", "island", "part").agg(F.min("ord").alias("first_word"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker"), text.alias("text"))
    return cues.select("source_id", (F.row_number().over(by_source("first_word"))).cast("long").alias("cue"), "first_word", "start_ms", "end_ms", "speaker", "text")


def _render_step(state, row):
    speaker, start, end = row
    if state is None or state[0] != speaker or state[3] >= RENDER_CUE_WORDS or start - state[2] > RENDER_CUE_GAP_MS or end - state[1] > RENDER_CUE_SPAN_MS:
        return (speaker, start, end, 1), 1
    return (speaker, state[1], end, state[3] + 1), 0


def render_cues(w: DataFrame, first_ms: int, last_ms: int) -> DataFrame:
    """Cues of a section: words clipped to it and counted from its start."""
    inside = w.filter((F.col("end_ms") > first_ms) & (F.col("start_ms") < last_ms)).select(
        "source_id", "ord", "speaker", (F.greatest("start_ms", F.lit(first_ms)) - first_ms).cast("long").alias("start_ms"), (F.least("end_ms", F.lit(last_ms)) - first_ms).cast("long").alias("end_ms")
    )
    f = fold(inside, ["source_id"], ["ord"], ["speaker", "start_ms", "end_ms"], _render_step, "cue")
    return f.groupBy("source_id", "cue").agg(F.min("ord").alias("first_word"), F.count("*").alias("words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def _region_step(state, row):
    (length,) = row
    if state is None or state[0] >= REGION_SENTENCES or state[1] + 1 + length > REGION_CHARS:
        return (1, length), 1
    return (state[0] + 1, state[1] + 1 + length), 0


def region_partition(grid: DataFrame) -> DataFrame:
    """Sentences to regions of bounded count and characters, greedily."""
    g = grid.select("source_id", "sentence_id", F.length("text").cast("long").alias("length"))
    return fold(g, ["source_id"], ["sentence_id"], ["length"], _region_step, "region")


def _place_step(state, row):
    k, region, inside = state or (-1, -1, None)
    inside, opens = _region_step(inside, row)
    return (k + 1, region + opens, inside), (k + 1, region + opens)


def placed_regions(grid: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows of grid themselves with their place k in the source (from 0) and their region, in one shuffle."""
    g = grid.withColumn("length", F.length("text").cast("long"))
    return trail(g, ["source_id"], ["sentence_id"], ["length"], _place_step, {"k": "long", "region": "long"}, tasks).drop("length")


def unit_chunks(grid: DataFrame, chars: int = UNIT_CHARS) -> DataFrame:
    """Slices of sentences for an encoder; a blank one is a single space."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(chars))
    cut = grid.select("source_id", "sentence_id", "text", F.posexplode(starts).alias("chunk", "at")).withColumn("text", F.col("text").substr(F.col("at") + 1, F.lit(chars)))
    return cut.select("source_id", "sentence_id", F.col("chunk").cast("long").alias("chunk"), F.when(F.trim("text") == "", " ").otherwise(F.col("text")).alias("text"))


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(n / size).cast("long"))


def id_runs(df: DataFrame, key: str, ident: str) -> DataFrame:
    """Contiguous runs of ids of each key."""
    n = F.col(ident) - F.row_number().over(Window.partitionBy(key).orderBy(ident))
    return df.select(key, ident).distinct().withColumn("run", n).groupBy(key, "run").agg(F.min(ident).alias("first"), F.max(ident).alias("last"), F.count("*").alias("size")).drop("run")


def segments_from_boundaries(boundaries: DataFrame, durations: DataFrame) -> DataFrame:
    """Segments between different boundaries strictly inside [0, duration], and its ends."""
    inside = boundaries.join(durations, "source_id").filter("ms > 0 and ms < duration").select("source_id", "ms")
    ends = durations.select("source_id", F.explode(F.array(F.lit(0).cast("long"), "duration")).alias("ms"))
    w = by_source("ms")
    return inside.unionByName(ends).distinct().select("source_id", F.col("ms").alias("start_ms"), F.lead("ms").over(w).alias("end_ms")).filter("end_ms is not null")


def evidence_pauses(w: DataFrame) -> DataFrame:
    """Gaps between spoken islands (words that overlap are one) with the words at their ends."""
    i = islands(w, F.col("start_ms") > F.max("end_ms").over(by_source("start_ms", "ord").rowsBetween(Window.unboundedPreceding, -1)), ["source_id"], ["start_ms", "ord"])
    g = i.groupBy("source_id", "island").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.min("ord").alias("first"), F.max_by("ord", F.struct("end_ms", "ord")).alias("last"))
    o = by_source("island")
    return g.select("source_id", F.col("e").alias("start_ms"), F.lead("s").over(o).alias("end_ms"), F.col("last").alias("left_word"), F.lead("first").over(o).alias("right_word")).filter("end_ms is not null")


# ---- queries -----------------------------------------------------------------------------------------------

_SENT = rf"""
ws AS (SELECT *, CASE WHEN lag(text) OVER w IS NULL THEN 0 WHEN regexp_matches(lag(text) OVER w, '{TERMINAL_SQL}') THEN 1 ELSE 0 END AS f FROM words WINDOW w AS (PARTITION BY source_id ORDER BY ord)),
sw AS (SELECT *, sum(f) OVER (PARTITION BY source_id ORDER BY ord)::BIGINT AS sentence_id FROM ws),
g0 AS (SELECT source_id, sentence_id, min(ord) AS word_start, max(ord) AS word_end, count(*) AS word_count, arg_min(speaker, ord) AS speaker, arg_min(start_ms, ord) AS start_ms, arg_max(end_ms, ord) AS end_ms,
  regexp_matches(arg_max(text, ord), '{QUESTION_SQL}') AS is_question, string_agg(text, ' ' ORDER BY ord) AS text FROM sw GROUP BY ALL),
grid AS (SELECT *, lag(sentence_id) OVER w IS NULL OR speaker IS DISTINCT FROM lag(speaker) OVER w AS opens_turn, lead(sentence_id) OVER w IS NULL OR speaker IS DISTINCT FROM lead(speaker) OVER w AS ends_turn,
  coalesce(greatest(0, lead(start_ms) OVER w - end_ms), 0)::BIGINT AS pause_after_ms FROM g0 WINDOW w AS (PARTITION BY source_id ORDER BY sentence_id))
"""
GRID_SQL = WORDS_SQL + "," + _SENT
_PARA = f"""
pr AS (SELECT source_id, sentence_id, speaker, start_ms, end_ms, word_count AS n, 0 AS pid, word_count AS run FROM grid WHERE sentence_id = 0
  UNION ALL SELECT g.source_id, g.sentence_id, g.speaker, g.start_ms, g.end_ms, g.word_count,
    CASE WHEN g.speaker IS DISTINCT FROM p.speaker OR g.start_ms - p.end_ms > {PARAGRAPH_GAP_MS} OR p.run + g.word_count > {PARAGRAPH_WORDS} THEN p.pid + 1 ELSE p.pid END,
    CASE WHEN g.speaker IS DISTINCT FROM p.speaker OR g.start_ms - p.end_ms > {PARAGRAPH_GAP_MS} OR p.run + g.word_count > {PARAGRAPH_WORDS} THEN g.word_count ELSE p.run + g.word_count END
  FROM pr p JOIN grid g ON g.source_id = p.source_id AND g.sentence_id = p.sentence_id + 1),
pq AS (SELECT source_id, pid::BIGINT AS paragraph_id, min(sentence_id) AS sentence_start, max(sentence_id) AS sentence_end, min(start_ms) AS start_ms, arg_max(end_ms, sentence_id) AS end_ms, arg_min(speaker, sentence_id) AS speaker, sum(n)::BIGINT AS word_count FROM pr GROUP BY ALL),
paras AS (SELECT *, CASE WHEN paragraph_id = 0 THEN 'start' WHEN speaker IS DISTINCT FROM lag(speaker) OVER w THEN 'turn' WHEN start_ms - lag(end_ms) OVER w > {PARAGRAPH_GAP_MS} THEN 'pause' ELSE 'cap' END AS break_reason
  FROM pq WINDOW w AS (PARTITION BY source_id ORDER BY paragraph_id))
"""
PARA_SQL = GRID_SQL + "," + _PARA
_TAG = "CASE WHEN speaker IS NULL THEN 'S?' WHEN try_cast(speaker AS INT) IS NOT NULL THEN 'S' || (try_cast(speaker AS INT) + 1) ELSE 'S' || speaker END"
_CLOCK = "lpad((start_ms // 60000)::VARCHAR, greatest(2, length((start_ms // 60000)::VARCHAR))::INT, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0')"
SHOTS_SQL = "shots AS (SELECT source_id, start_ms + 300 AS time_ms FROM words WHERE ord % 17 = 5)"


def shots(w: DataFrame) -> DataFrame:
    return w.filter("ord % 17 = 5").select("source_id", (F.col("start_ms") + 300).alias("time_ms"))


def _w(f):
    return lambda s, d: f(words(s, d))


def _g(f):
    return lambda s, d: f(sentence_grid(words(s, d)))


def _pieces(w: DataFrame) -> DataFrame:
    """Model sentences for B14: every eight words of the joined text."""
    return w.withColumn("piece", F.expr("ord div 8")).groupBy("source_id", "piece").agg(F.sum(F.length("text") + 1).alias("length"))


def _model_paragraphs(s: SparkSession, d: str) -> DataFrame:
    w = words(s, d)
    m = model_sentences(w, _pieces(w)).withColumn("paragraph", F.expr("piece div 3"))
    p = m.groupBy("source_id", "paragraph").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("speaker", "piece").alias("speaker"))
    o = by_source("paragraph")
    turn, pause = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(o)), F.col("start_ms") - F.lag("end_ms").over(o) > PARAGRAPH_GAP_MS
    return p.withColumn("kind", F.when(F.lag("paragraph").over(o).isNull(), "start").when(turn, "turn").when(pause, "pause").otherwise("topic"))


_PIECES_SQL = """
ch AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY source_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM words),
pc AS (SELECT source_id, ord // 8 AS piece, sum(length(text) + 1) AS length FROM words GROUP BY ALL),
pu AS (SELECT *, sum(length) OVER (PARTITION BY source_id ORDER BY piece) AS upto FROM pc),
mt AS (SELECT ch.*, piece FROM ch JOIN pu ON ch.source_id = pu.source_id AND c >= upto - pu.length AND c < upto),
vt AS (SELECT source_id, piece, speaker, count(*) AS n, min(ord) AS f FROM mt GROUP BY ALL),
tp AS (SELECT source_id, piece, speaker FROM vt QUALIFY row_number() OVER (PARTITION BY source_id, piece ORDER BY n DESC, f) = 1),
ms AS (SELECT source_id, piece, min(ord) AS word_start, max(ord) AS word_end, arg_min(start_ms, ord) AS start_ms, max(end_ms) AS end_ms, any_value(tp.speaker) AS speaker FROM mt JOIN tp USING (source_id, piece) GROUP BY source_id, piece)
"""


def _boundaries(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    return turn_starts(w).select("source_id", F.col("start_ms").alias("ms")), w.groupBy("source_id").agg(F.max("end_ms").alias("duration"))


QUERIES = {
    "b1_sentence_starts": _w(sentence_starts),
    "b2_pause_boundaries": _w(pause_boundaries),
    "b3_sentence_times": _w(sentence_times),
    "b4_turn_starts": _w(turn_starts),
    "sentence_grid": _w(sentence_grid),
    "b6_packed_paragraphs": _g(packed_paragraphs),
    "b7_display_paragraphs": _w(display_paragraphs),
    "b8_viewer_paragraphs": _w(viewer_paragraphs),
    "b9_utterances": _w(utterances),
    "b10_words_by_utterance": _w(words_by_utterance),
    "b11_layer_candidates": _g(lambda g: layer_candidates(packed_paragraphs(g))),
    "b12_coarse_rendering": _g(lambda g: coarse_rendering(g, packed_paragraphs(g))),
    "b13_fine_rendering": lambda s, d: (lambda w: (lambda g: fine_rendering(g, packed_paragraphs(g), shots(w)))(sentence_grid(w)))(words(s, d)),
    "b14_model_sentences": _w(lambda w: model_sentences(w, _pieces(w))),
    "b15_model_paragraphs": _model_paragraphs,
    "b16_caption_cues": _w(caption_cues),
    "b17_render_cues": _w(lambda w: render_cues(w, 5000, 65000)),
    "b19_region_partition": _g(region_partition),
    "b20_unit_chunks": _g(lambda g: unit_chunks(g, 40)),
    "b21_batches": _g(lambda g: batches(g.select("source_id", "sentence_id"), ["source_id"], ["sentence_id"], 12)),
    "b22_id_runs": lambda s, d: id_runs(words(s, d).filter("ord % 7 <> 3 and ord % 11 <> 5"), "source_id", "ord"),
    "b23_segments_from_boundaries": _w(lambda w: segments_from_boundaries(*_boundaries(w))),
    "b24_evidence_pauses": _w(evidence_pauses),
}
_ISL = "u0 AS (SELECT *, CASE WHEN ord = 0 OR speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY source_id ORDER BY ord) THEN 0 ELSE 1 END AS nf FROM words), ut AS (SELECT *, sum(nf) OVER (PARTITION BY source_id ORDER BY ord)::BIGINT AS utterance FROM u0)"
ORACLES = {
    "b1_sentence_starts": f"WITH {GRID_SQL} SELECT source_id, sentence_id, word_start AS ord, start_ms FROM grid",
    "b2_pause_boundaries": f"WITH {WORDS_SQL} SELECT * FROM (SELECT source_id, ord, start_ms, start_ms - lag(end_ms) OVER (PARTITION BY source_id ORDER BY ord) AS pause_ms FROM words) WHERE pause_ms >= {PAUSE_MS}",
    "b3_sentence_times": f"WITH {GRID_SQL} SELECT source_id, sentence_id, start_ms, end_ms FROM grid",
    "b4_turn_starts": f"WITH {WORDS_SQL}, {_ISL} SELECT source_id, ord, start_ms, speaker FROM ut WHERE nf = 1 OR ord = 0",
    "sentence_grid": f"WITH {GRID_SQL} SELECT source_id, sentence_id, word_start, word_end, word_count, speaker, start_ms, end_ms, is_question, text, opens_turn, ends_turn, pause_after_ms FROM grid",
    "b6_packed_paragraphs": f"WITH RECURSIVE {PARA_SQL} SELECT * FROM paras",
    "b7_display_paragraphs": f"""WITH {WORDS_SQL}, f AS (SELECT *, CASE WHEN ord = 0 THEN 0 WHEN speaker IS DISTINCT FROM lag(speaker) OVER w OR start_ms - lag(end_ms) OVER w > {PARAGRAPH_GAP_MS} THEN 1 ELSE 0 END AS x FROM words WINDOW w AS (PARTITION BY source_id ORDER BY ord)),
        i AS (SELECT *, sum(x) OVER (PARTITION BY source_id ORDER BY ord) AS isl FROM f), k AS (SELECT *, (row_number() OVER (PARTITION BY source_id, isl ORDER BY ord) - 1) // {PARAGRAPH_WORDS} AS part FROM i),
        g AS (SELECT source_id, isl, part, min(ord) AS first_word, max(ord) AS last_word, min(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(speaker) AS speaker FROM k GROUP BY ALL)
        SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY first_word) - 1 AS paragraph_id, first_word, last_word, start_ms, end_ms, speaker FROM g""",
    "b8_viewer_paragraphs": f"""WITH RECURSIVE {WORDS_SQL}, {_ISL}, r AS (SELECT source_id, ord, utterance, end_ms AS mx, 1 AS n, 0 AS part FROM ut WHERE ord = 0
        UNION ALL SELECT u.source_id, u.ord, u.utterance, CASE WHEN u.utterance <> r.utterance OR r.n >= {PARAGRAPH_WORDS} OR u.start_ms - r.mx > {PARAGRAPH_GAP_MS} THEN u.end_ms ELSE greatest(r.mx, u.end_ms) END,
          CASE WHEN u.utterance <> r.utterance OR r.n >= {PARAGRAPH_WORDS} OR u.start_ms - r.mx > {PARAGRAPH_GAP_MS} THEN 1 ELSE r.n + 1 END,
          CASE WHEN u.utterance <> r.utterance THEN 0 WHEN r.n >= {PARAGRAPH_WORDS} OR u.start_ms - r.mx > {PARAGRAPH_GAP_MS} THEN r.part + 1 ELSE r.part END FROM r JOIN ut u ON u.source_id = r.source_id AND u.ord = r.ord + 1)
        SELECT source_id, utterance, part::BIGINT AS part, min(ord) AS first_word, max(ord) AS last_word, count(*) AS words FROM r GROUP BY ALL""",
    "b9_utterances": f"WITH {WORDS_SQL}, {_ISL} SELECT source_id, utterance, any_value(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(ord) AS first_word, count(*) AS words FROM ut GROUP BY source_id, utterance",
    "b10_words_by_utterance": f"WITH {WORDS_SQL}, {_ISL} SELECT source_id, ord, utterance FROM ut",
    "b11_layer_candidates": f"WITH RECURSIVE {PARA_SQL} SELECT source_id, sentence_start AS sentence_id, start_ms AS ms, break_reason AS kind, 1.0::DOUBLE AS score FROM paras WHERE break_reason IN ('turn', 'pause')",
    "b12_coarse_rendering": f"WITH RECURSIVE {PARA_SQL}, t AS (SELECT p.source_id, p.paragraph_id, p.start_ms, p.speaker, string_agg(g.text, ' ' ORDER BY g.sentence_id) AS text FROM paras p JOIN grid g ON g.source_id = p.source_id AND g.sentence_id BETWEEN p.sentence_start AND p.sentence_end GROUP BY ALL) SELECT source_id, paragraph_id, 'P' || lpad((paragraph_id + 1)::VARCHAR, greatest(3, length((paragraph_id + 1)::VARCHAR))::INT, '0') || ' [' || {_CLOCK} || '] ' || {_TAG} || ': ' || text AS line FROM t",
    "b13_fine_rendering": f"WITH RECURSIVE {PARA_SQL}, {SHOTS_SQL}, x AS (SELECT g.*, lag(pause_after_ms) OVER (PARTITION BY source_id ORDER BY sentence_id) AS before, EXISTS (SELECT 1 FROM paras p WHERE p.source_id = g.source_id AND p.sentence_start = g.sentence_id) AS p, EXISTS (SELECT 1 FROM shots s WHERE s.source_id = g.source_id AND abs(s.time_ms - g.start_ms) <= 500) AS s FROM grid g) SELECT source_id, sentence_id, CASE WHEN p THEN 'P' ELSE '.' END || CASE WHEN opens_turn THEN 'T' ELSE '.' END || CASE WHEN before >= {PAUSE_MS} THEN '|' ELSE '.' END || CASE WHEN s THEN 'S' ELSE '.' END || ' [' || {_CLOCK} || '] ' || {_TAG} || ' ' || text AS line FROM x",
    "b14_model_sentences": f"WITH {WORDS_SQL}, {_PIECES_SQL} SELECT * FROM ms",
    "b15_model_paragraphs": f"WITH {WORDS_SQL}, {_PIECES_SQL}, p AS (SELECT source_id, piece // 3 AS paragraph, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(speaker, piece) AS speaker FROM ms GROUP BY ALL) SELECT *, CASE WHEN lag(paragraph) OVER w IS NULL THEN 'start' WHEN speaker IS DISTINCT FROM lag(speaker) OVER w THEN 'turn' WHEN start_ms - lag(end_ms) OVER w > {PARAGRAPH_GAP_MS} THEN 'pause' ELSE 'topic' END AS kind FROM p WINDOW w AS (PARTITION BY source_id ORDER BY paragraph)",
    "b16_caption_cues": f"""WITH RECURSIVE {WORDS_SQL}, r AS (SELECT source_id, ord, text, speaker, start_ms, end_ms, start_ms AS cs, length(text) AS n, 1 AS cue FROM words WHERE ord = 0
        UNION ALL SELECT w.source_id, w.ord, w.text, w.speaker, w.start_ms, w.end_ms, CASE WHEN x THEN w.start_ms ELSE cs END, CASE WHEN x THEN length(w.text) ELSE n + 1 + length(w.text) END, CASE WHEN x THEN cue + 1 ELSE cue END
        FROM (SELECT r.cs, r.n, r.cue, w, (w.speaker IS DISTINCT FROM r.speaker OR regexp_matches(r.text, '{TERMINAL_SQL}') OR w.start_ms - r.end_ms > {CUE_SILENCE_MS} OR r.n + 1 + length(w.text) > {CUE_CHARS} OR w.end_ms - r.cs > {CUE_SPAN_MS}) AS x FROM r JOIN words w ON w.source_id = r.source_id AND w.ord = r.ord + 1))
        SELECT source_id, cue::BIGINT AS cue, min(ord) AS first_word, min(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY ord) AS text FROM r GROUP BY source_id, cue""",
    "b17_render_cues": f"""WITH RECURSIVE {WORDS_SQL}, v AS (SELECT source_id, ord, speaker, greatest(start_ms, 5000) - 5000 AS s, least(end_ms, 65000) - 5000 AS e, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS k FROM words WHERE end_ms > 5000 AND start_ms < 65000),
        r AS (SELECT source_id, ord, k, speaker, s, e, s AS cs, 1 AS n, 0 AS cue FROM v WHERE k = 1
        UNION ALL SELECT v.source_id, v.ord, v.k, v.speaker, v.s, v.e, CASE WHEN x THEN v.s ELSE cs END, CASE WHEN x THEN 1 ELSE n + 1 END, CASE WHEN x THEN cue + 1 ELSE cue END
        FROM (SELECT r.cs, r.n, r.cue, v, (v.speaker IS DISTINCT FROM r.speaker OR r.n >= {RENDER_CUE_WORDS} OR v.s - r.e > {RENDER_CUE_GAP_MS} OR v.e - r.cs > {RENDER_CUE_SPAN_MS}) AS x FROM r JOIN v ON v.source_id = r.source_id AND v.k = r.k + 1))
        SELECT source_id, cue::BIGINT AS cue, min(ord) AS first_word, count(*) AS words, min(s) AS start_ms, max(e) AS end_ms FROM r GROUP BY source_id, cue""",
    "b19_region_partition": f"""WITH RECURSIVE {GRID_SQL}, r AS (SELECT source_id, sentence_id, length(text) AS length, 1 AS n, length(text) AS c, 0 AS region FROM grid WHERE sentence_id = 0
        UNION ALL SELECT g.source_id, g.sentence_id, length(g.text), CASE WHEN x THEN 1 ELSE n + 1 END, CASE WHEN x THEN length(g.text) ELSE c + 1 + length(g.text) END, CASE WHEN x THEN region + 1 ELSE region END
        FROM (SELECT r.n, r.c, r.region, g, (r.n >= {REGION_SENTENCES} OR r.c + 1 + length(g.text) > {REGION_CHARS}) AS x FROM r JOIN grid g ON g.source_id = r.source_id AND g.sentence_id = r.sentence_id + 1))
        SELECT source_id, sentence_id, length, region::BIGINT AS region FROM r""",
    "b20_unit_chunks": f"WITH {GRID_SQL} SELECT source_id, sentence_id, k AS chunk, CASE WHEN trim(substr(text, k * 40 + 1, 40)) = '' THEN ' ' ELSE substr(text, k * 40 + 1, 40) END AS text FROM (SELECT *, unnest(range(0, greatest(length(text) - 1, 0) // 40 + 1)) AS k FROM grid)",
    "b21_batches": f"WITH {GRID_SQL} SELECT source_id, sentence_id, (row_number() OVER (PARTITION BY source_id ORDER BY sentence_id) - 1) // 12 AS batch FROM grid",
    "b22_id_runs": f"WITH {WORDS_SQL}, r AS (SELECT source_id, ord, ord - row_number() OVER (PARTITION BY source_id ORDER BY ord) AS k FROM words WHERE ord % 7 <> 3 AND ord % 11 <> 5) SELECT source_id, min(ord) AS first, max(ord) AS last, count(*) AS size FROM r GROUP BY source_id, k",
    "b23_segments_from_boundaries": f"WITH {WORDS_SQL}, {_ISL}, d AS (SELECT source_id, max(end_ms) AS duration FROM words GROUP BY 1), b AS (SELECT source_id, start_ms AS ms FROM ut JOIN d USING (source_id) WHERE (nf = 1 OR ord = 0) AND start_ms > 0 AND start_ms < duration UNION SELECT source_id, 0 FROM d UNION SELECT source_id, duration FROM d) SELECT * FROM (SELECT source_id, ms AS start_ms, lead(ms) OVER (PARTITION BY source_id ORDER BY ms) AS end_ms FROM b) WHERE end_ms IS NOT NULL",
    "b24_evidence_pauses": f"""WITH {WORDS_SQL}, f AS (SELECT *, CASE WHEN start_ms > max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS x FROM words),
        i AS (SELECT *, sum(x) OVER (PARTITION BY source_id ORDER BY start_ms, ord) AS isl FROM f), g AS (SELECT source_id, isl, min(start_ms) AS s, max(end_ms) AS e, min(ord) AS a, max(ord) AS z FROM i GROUP BY ALL)
        SELECT source_id, e AS start_ms, lead(s) OVER w AS end_ms, z AS left_word, lead(a) OVER w AS right_word FROM g WINDOW w AS (PARTITION BY source_id ORDER BY isl) QUALIFY lead(s) OVER w IS NOT NULL""",
}
