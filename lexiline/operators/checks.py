"""Evidence, edit, proposal and review checks as rows that break a rule; scorers with their issues; settlement, paging and speech intervals.

Checks return violations (an empty result means valid). Scorers return a row for each key with the score and the issues in their stated order.
What is gathered into one row are a recording's own sections, suggestions or issues.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.functions.text import blank
from lexiline.operators.segment import GRID_SQL, sentence_grid
from lexiline.operators.store import half_up_ms
from lexiline.sources.timeline import WORDS_SQL, by_source, table, words

# fixed values: sample rate and frame of speech windows, thresholds, durations in samples
RATE, FRAME, SPEECH_ON, SPEECH_OFF = 16_000, 512, 0.5, 0.35
LEAST_SPEECH, LEAST_SILENCE, PAD = 4000, 1600, 480
PAGE_CHARACTERS, PRICE_UNIT = 12_000, 1_000_000


def _rules(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, as an array."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def _listed(issues: list[Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*issues)), "; ")


# ---- checks ------------------------------------------------------------------------------------------------

def evidence_violations(w: DataFrame, sentences: DataFrame, durations: DataFrame) -> DataFrame:
    """V2: words (source_id, word_id, ord, text, start_ms, end_ms) and sentences (source_id, sentence_id, first, last, text, start_ms, end_ms) against each other and
    the duration: (source_id, kind, id, rule). Ordinals are positions; each word has one owner; a sentence says and spans what its words do."""
    place = F.row_number().over(by_source("ord", "word_id")) - 1
    same_id = F.count("*").over(Window.partitionBy("source_id", "word_id"))
    checked = w.join(durations, "source_id").withColumns({"place": place, "same": same_id})
    outside = (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms")) | (F.col("end_ms") > F.col("duration_ms"))
    of_words = _rules({"word_id": F.col("same") > 1, "order": F.col("ord") != F.col("place"), "blank": F.coalesce("text", F.lit("")) == "", "timing": outside})
    words_bad = checked.select("source_id", F.lit("word").alias("kind"), F.col("word_id").alias("id"), F.explode(of_words).alias("rule"))
    owned = sentences.filter("last >= first").select("source_id", "sentence_id", F.explode(F.sequence("first", "last")).alias("ord"))
    met = owned.join(w, ["source_id", "ord"], "left")
    said = met.groupBy("source_id", "sentence_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("words"), F.count("text").alias("known"), F.min_by("start_ms", F.when(F.col("word_id").isNotNull(), F.col("ord"))).alias("begins"), F.max("end_ms").alias("ends"),
        F.count_if(F.col("word_id").isNull()).alias("lost"),
    )
    said = said.withColumn("said", F.when(F.col("known") > 0, F.col("words"))).drop("words", "known")
    s = sentences.join(said, ["source_id", "sentence_id"], "left")
    empty = F.col("lost").isNull()
    of_sentences = _rules({"reference": empty | (F.col("lost") > 0), "text": ~empty & (F.col("text") != F.col("said")), "span": ~empty & ((F.col("start_ms") != F.col("begins")) | (F.col("end_ms") != F.col("ends")))})
    sentences_bad = s.select("source_id", F.lit("sentence").alias("kind"), F.col("sentence_id").alias("id"), F.explode(of_sentences).alias("rule"))
    owners = w.join(owned.groupBy("source_id", "ord").agg(F.count("*").alias("owners")), ["source_id", "ord"], "left").filter("owners is null or owners <> 1")
    return words_bad.unionByName(sentences_bad).unionByName(owners.select("source_id", F.lit("word").alias("kind"), F.col("word_id").alias("id"), F.lit("ownership").alias("rule")))


def edit_violations(boundaries: DataFrame, sections: DataFrame, durations: DataFrame) -> DataFrame:
    """V4: boundaries (plan, ord, num, den, ms) of sections (plan, ord, n_sections) over durations (plan, duration_ms): (plan, ord, rule). n + 1 boundaries from exactly 0 to exactly the
    duration, strictly increasing as rationals, each with its milliseconds rounded half up."""
    d = lambda c: F.col(c).cast("decimal(38,0)")
    w = Window.partitionBy("plan").orderBy("ord")
    count = F.count("*").over(Window.partitionBy("plan"))
    b = boundaries.withColumns({"p_num": F.lag("num").over(w), "p_den": F.lag("den").over(w), "next": F.lead("ord").over(w), "n": count}).join(sections, "plan").join(durations, "plan")
    first, last = F.col("p_num").isNull(), F.col("next").isNull()
    rules = {
        "count": first & (F.col("n") != F.col("n_sections") + 1), "start": first & (F.col("num") != 0), "end": last & (d("num") * 1000 != d("duration_ms") * d("den")),
        "rounding": ~F.col("ms").eqNullSafe(half_up_ms(F.col("num") * 1000, F.col("den"))), "increasing": d("num") * d("p_den") <= d("p_num") * d("den"),
    }
    return b.select("plan", "ord", F.explode(_rules(rules)).alias("rule"))


def layer_violations(transcript: DataFrame, layers: DataFrame, sentences: DataFrame) -> DataFrame:
    """V6: words that differ from the transcript's, and sentences (sentence_id, word_start, word_end, start_ms, end_ms) that don't tile it or don't span their words: (source_id, kind, id, rule)."""
    both = transcript.select("source_id", "ord", F.struct("text", "start_ms", "end_ms", "speaker").alias("t")).join(layers.select("source_id", "ord", F.struct("text", "start_ms", "end_ms", "speaker").alias("l")), ["source_id", "ord"], "full")
    rule = F.when(F.col("t").isNull(), "added").when(F.col("l").isNull(), "missing").when(~F.col("t").eqNullSafe(F.col("l")), "differs")
    words_bad = both.select("source_id", F.lit("word").alias("kind"), F.col("ord").alias("id"), rule.alias("rule")).filter("rule is not null")
    o = by_source("word_start", "sentence_id")
    top = transcript.groupBy("source_id").agg(F.max("ord").alias("top"))
    s = sentences.withColumns({"expected": F.coalesce(F.lag("word_end").over(o) + 1, F.lit(0).cast("long")), "place": F.row_number().over(o) - 1, "final": F.lead("word_end").over(o).isNull()}).join(top, "source_id")
    owned = s.filter("word_end >= word_start").select("source_id", "sentence_id", F.explode(F.sequence("word_start", "word_end")).alias("ord")).join(transcript.select("source_id", "ord", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we")), ["source_id", "ord"])
    span = owned.groupBy("source_id", "sentence_id").agg(F.min_by("ws", "ord").alias("begins"), F.max("we").alias("ends"))
    s = s.join(span, ["source_id", "sentence_id"], "left")
    rules = {
        "id": F.col("sentence_id") != F.col("place"), "cover": (F.col("word_start") != F.col("expected")) | (F.col("word_end") < F.col("word_start")), "outside": F.col("word_end") > F.col("top"),
        "span": (F.col("start_ms") != F.col("begins")) | (F.col("end_ms") != F.col("ends")), "short": F.col("final") & (F.col("word_end") < F.col("top")),
    }
    return words_bad.unionByName(s.select("source_id", F.lit("sentence").alias("kind"), F.col("sentence_id").alias("id"), F.explode(_rules(rules)).alias("rule")))


def proposal_violations(topics: DataFrame, spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """V7: topics (source_id, topic, first, last, title) and their spans (source_id, topic, field, first, last) over known sentences (source_id, sentence_id): (source_id, topic, rule)."""
    known = lambda c: sentences.select("source_id", F.col("sentence_id").alias(c), F.lit(True).alias(f"{c}_known"))
    seen = F.count("*").over(Window.partitionBy("source_id", "topic"))
    t = topics.withColumn("same", seen).join(known("first"), ["source_id", "first"], "left").join(known("last"), ["source_id", "last"], "left")
    unknown = F.col("first_known").isNull() | F.col("last_known").isNull()
    of_topics = t.select("source_id", "topic", F.explode(_rules({"blank": blank("title"), "duplicate": F.col("same") > 1, "unknown": unknown, "reversed": F.col("last") < F.col("first")})).alias("rule"))
    core = topics.select("source_id", "topic").distinct().join(spans.filter("field = 'core'").select("source_id", "topic"), ["source_id", "topic"], "left_anti").select("source_id", "topic", F.lit("no_core").alias("rule"))
    inside = spans.join(known("first"), ["source_id", "first"], "left").join(known("last"), ["source_id", "last"], "left").join(topics.select("source_id", "topic", F.col("first").alias("t_first"), F.col("last").alias("t_last")).distinct(), ["source_id", "topic"])
    outside = (F.col("first") < F.col("t_first")) | (F.col("last") > F.col("t_last"))
    of_spans = inside.select("source_id", "topic", F.explode(_rules({"span_unknown": unknown, "span_reversed": F.col("last") < F.col("first"), "span_outside": outside})).alias("rule"))
    return of_topics.unionByName(core).unionByName(of_spans).distinct()


def undelivered(claims: DataFrame, delivered: DataFrame) -> DataFrame:
    """Sentences that claims (source_id, claim, first, last) cite and that were not delivered (source_id, sentence_id)."""
    cited = claims.filter("last >= first").select("source_id", "claim", F.explode(F.sequence("first", "last")).alias("sentence_id")).distinct()
    return cited.join(delivered.select("source_id", "sentence_id").distinct(), ["source_id", "sentence_id"], "left_anti")


def review_violations(criteria: DataFrame, spans: DataFrame) -> DataFrame:
    """Criteria (review, criterion, status, reason, allowed_first, allowed_last, topic_first, topic_last) and their spans (review, criterion, first, last): (review, criterion, rule)."""
    met = criteria.join(spans, ["review", "criterion"], "left")
    bad = ~((F.col("allowed_first") <= F.col("first")) & (F.col("first") <= F.col("last")) & (F.col("last") <= F.col("allowed_last")))
    g = met.groupBy("review", "criterion", "status", "reason").agg(F.count("first").alias("n"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"), F.coalesce(F.bool_or((F.col("first") <= F.col("topic_last")) & (F.col("last") >= F.col("topic_first"))), F.lit(False)).alias("owns"))
    rules = {"blank": blank("reason"), "no_evidence": F.col("status").isin("pass", "fail") & (F.col("n") == 0), "unavailable": F.col("bad"), "not_cited": (F.col("status") == "pass") & ~F.col("owns")}
    return g.select("review", "criterion", F.explode(_rules(rules)).alias("rule"))


# ---- scorers -----------------------------------------------------------------------------------------------

def chapter_score(chapters: DataFrame, durations: DataFrame) -> DataFrame:
    """Chapters (source_id, ord, start_ms, end_ms, title) of durations (source_id, duration_ms): score and issues."""
    c = chapters.withColumn("before", F.lag("end_ms").over(by_source("ord")))
    untitled = blank("title")
    g = c.groupBy("source_id").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered"), F.coalesce(F.bool_or(F.col("start_ms") < F.col("before")), F.lit(False)).alias("mixed"), F.max_by("end_ms", "ord").alias("last_end"),
        F.array_sort(F.collect_list(F.when(untitled, F.col("ord")))).alias("blanks"),
    )
    j = durations.join(g, "source_id", "left").withColumn("share", F.least(F.col("covered") / F.col("duration_ms"), F.lit(1.0)))
    named = F.array_join(F.transform("blanks", lambda k: F.concat(F.lit("chapter "), k.cast("string"), F.lit(" has an empty title"))), "; ")
    issues = _listed([F.when(F.size("blanks") > 0, named), F.when(F.col("share") < 0.8, F.concat(F.lit("chapters cover only "), F.floor(F.col("share") * 100 + 0.5).cast("string"), F.lit("%"))), F.when(F.col("mixed"), "chapters overlap or are out of order"),
        F.when(F.col("last_end") < F.col("duration_ms") * 0.9, "last chapter ends well before the recording does")])
    score = F.col("share") * F.when(F.col("mixed"), 0.5).otherwise(1.0) * F.when(F.size("blanks") > 0, 0.8).otherwise(1.0)
    none = F.col("covered").isNull()
    return j.select("source_id", F.round(F.when(none, 0.0).otherwise(score), 6).alias("score"), F.when(none, "no chapters").otherwise(issues).alias("issues"))


def suggestion_score(suggestions: DataFrame, speakers: DataFrame) -> DataFrame:
    """Suggestions (source_id, ord, speaker, merge_with, name, evidence) for speakers (source_id, speaker, ord): score and issues."""
    ids = speakers.select("source_id", "speaker").distinct()
    known = lambda c: ids.select("source_id", F.col("speaker").alias(c), F.lit(True).alias(f"{c}_known"))
    s = suggestions.join(known("speaker"), ["source_id", "speaker"], "left").join(known("merge_with"), ["source_id", "merge_with"], "left")
    texts = F.array(
        F.when(F.col("speaker_known").isNull(), F.concat(F.lit("suggestion for unknown speaker id "), "speaker")), F.when(F.col("merge_with").isNotNull() & F.col("merge_with_known").isNull(), F.concat(F.lit("merge target "), "merge_with", F.lit(" is not a speaker id"))),
        F.when((F.coalesce("name", F.lit("")) != "") & blank("evidence"), F.concat(F.lit("name for speaker "), "speaker", F.lit(" carries no evidence"))),
    )
    said = s.select("source_id", F.lit(0).alias("part"), "ord", F.posexplode(texts).alias("k", "text")).filter("text is not null")
    silent = speakers.groupBy("source_id", "speaker").agg(F.min("ord").alias("ord")).join(suggestions.select("source_id", "speaker").distinct(), ["source_id", "speaker"], "left_anti")
    missing = silent.select("source_id", F.lit(1).alias("part"), "ord", F.lit(0).alias("k"), F.concat(F.lit("speaker id "), "speaker", F.lit(" has no suggestion entry")).alias("text"))
    listed = said.unionByName(missing).groupBy("source_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "k", "text"))), lambda x: x["text"]), "; ").alias("issues"))
    size = ids.groupBy("source_id").agg(F.count("*").alias("known"))
    j = size.join(listed, "source_id", "left")
    return j.select("source_id", F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("n", F.lit(0)) / F.col("known")), 6).alias("score"), F.coalesce("issues", F.lit("")).alias("issues"))


def extraction_score(rows: DataFrame, durations: DataFrame) -> DataFrame:
    """Rows (source_id, ord, kind, start_ms, end_ms, grounded): score and issues."""
    bad = F.col("grounded") & ((F.col("end_ms") <= F.col("start_ms")) | (F.col("end_ms") > F.col("duration_ms")))
    text = F.concat("kind", F.lit(" range "), F.col("start_ms").cast("string"), F.lit("-"), F.col("end_ms").cast("string"), F.lit(" is invalid"))
    g = durations.join(rows, "source_id", "left").groupBy("source_id").agg(
        F.count("ord").alias("n"), F.count_if("grounded").alias("good"), F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("ord", text.alias("text"))))), lambda x: x["text"]).alias("bad"), F.countDistinct("kind").alias("kinds"), F.min("kind").alias("kind"),
    )
    ratio = F.col("good") / F.col("n")
    issues = _listed([F.when(F.col("good") < F.col("n"), F.concat((F.col("n") - F.col("good")).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" items failed verbatim grounding"))), F.when(F.size("bad") > 0, F.array_join("bad", "; ")), F.when(F.col("kinds") < 2, F.concat(F.lit("only "), "kind", F.lit(" extracted")))])
    score = ratio * F.when(F.size("bad") > 0, 0.5).otherwise(1.0) * F.when(F.col("kinds") < 2, 0.8).otherwise(1.0)
    return g.select("source_id", F.round(F.when(F.col("n") == 0, 0.0).otherwise(score), 6).alias("score"), F.when(F.col("n") == 0, "no extractions produced").otherwise(issues).alias("issues"))


def segment_score(rows: DataFrame, tiled: DataFrame) -> DataFrame:
    """Rows (source_id, ord, kind, drop_reason, start_ms, end_ms, grounded) and whether they tile (source_id, partition_ok): score and issues."""
    r = rows.withColumn("before", F.lag("end_ms").over(by_source("ord")))
    keep = F.col("kind") == "keep"
    g = r.groupBy("source_id").agg(F.count_if(keep).alias("keeps"), F.count_if(keep & F.col("grounded")).alias("good"), F.count_if((F.col("kind") == "drop") & F.col("drop_reason").isNull()).alias("bare"), F.coalesce(F.bool_or(F.col("start_ms") < F.col("before")), F.lit(False)).alias("mixed"))
    j = tiled.join(g, "source_id", "left")
    text = lambda c: c.cast("string")
    issues = _listed([F.when(F.col("good") < F.col("keeps"), F.concat(text(F.col("keeps") - F.col("good")), F.lit("/"), text(F.col("keeps")), F.lit(" keeps failed anchor grounding"))), F.when(~F.col("partition_ok"), "rows do not tile the episode"),
        F.when(F.col("bare") > 0, F.concat(text(F.col("bare")), F.lit(" drop(s) carry no reason"))), F.when(F.col("mixed"), "rows overlap or are out of order")])
    score = F.col("good") / F.col("keeps") * F.when(~F.col("partition_ok"), 0.5).otherwise(1.0) * F.when(F.col("mixed"), 0.5).otherwise(1.0) * F.when(F.col("bare") > 0, 0.9).otherwise(1.0)
    none, nothing = F.col("keeps").isNull(), F.col("keeps") == 0
    return j.select("source_id", F.round(F.when(none | nothing, 0.0).otherwise(score), 6).alias("score"), F.when(none, "no segments produced").when(nothing, "plan kept nothing").otherwise(issues).alias("issues"))


def decision_score(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """First decisions (source_id, atom, ord, keep) against the first of gold: macro average of the classes that occur, and the number of issues of each kind."""
    first = lambda df: df.groupBy("source_id", "atom").agg(F.min_by("keep", "ord").alias("keep"), (F.count("*") - 1).alias("more"))
    p, g = first(predicted), first(gold)
    met = g.join(p.select("source_id", "atom", F.col("keep").alias("said")), ["source_id", "atom"], "left")
    c = met.groupBy("source_id", "keep").agg(F.count_if(F.col("said") == F.col("keep")).alias("right"), F.count("*").alias("n"), F.count_if(F.col("said").isNull()).alias("none"), F.count_if((F.col("said") != F.col("keep")) & F.col("said")).alias("kept"), F.count_if((F.col("said") != F.col("keep")) & ~F.col("said")).alias("removed"))
    score = c.groupBy("source_id").agg(F.round(F.avg(F.col("right") / F.col("n")), 6).alias("score"), F.sum("none").alias("no_prediction"), F.sum("kept").alias("kept_wrongly"), F.sum("removed").alias("removed_wrongly"))
    repeats = p.groupBy("source_id").agg(F.sum("more").alias("repeated"))
    return score.join(repeats, "source_id", "left").select("source_id", "score", "no_prediction", "kept_wrongly", "removed_wrongly", F.coalesce("repeated", F.lit(0)).alias("repeated"))


def answer_score(outcomes: DataFrame, citations: DataFrame) -> DataFrame:
    """Outcomes (suite, question, expected, got, gold_start, gold_end) and citations (question, start_ms, end_ms): 1 for a right answer whose citation overlaps gold, 0.5 without, 0 for wrong answerability."""
    hit = outcomes.select("question", "gold_start", "gold_end").join(citations, "question").filter((F.col("start_ms") < F.coalesce("gold_end", F.lit(0))) & (F.col("end_ms") > F.coalesce("gold_start", F.lit(0)))).select("question", F.lit(True).alias("hit")).distinct()
    right = F.col("expected") == F.col("got")
    each = outcomes.join(hit, "question", "left").withColumns({"points": F.when(~right, 0.0).when(~F.col("expected") | F.col("hit"), 1.0).otherwise(0.5), "uncited": right & F.col("expected") & F.col("hit").isNull(), "wrong": ~right})
    return each.groupBy("suite").agg(F.round(F.avg("points"), 6).alias("score"), F.count_if("wrong").alias("wrong"), F.count_if("uncited").alias("uncited"))


# ---- settlement, paging, speech ----------------------------------------------------------------------------

def settled(usage: DataFrame, surcharge: int = 0) -> DataFrame:
    """Usage (input, output, cache_read, cache_write) with prices (price_in, price_out, price_read, price_write) to micros, rounded up; null without any usage. Cache tokens are part of the input; without a price of their own they cost as input."""
    zero = F.lit(0).cast("long")
    u = usage.withColumns({"in_": F.greatest(zero, "input"), "out_": F.greatest(zero, "output")})
    u = u.withColumn("read_", F.least(F.greatest(zero, "cache_read"), "in_"))
    u = u.withColumn("write_", F.least(F.greatest(zero, "cache_write"), F.col("in_") - F.col("read_")))
    total = (F.col("in_") - F.col("read_") - F.col("write_")) * F.col("price_in") + F.col("read_") * F.coalesce("price_read", "price_in") + F.col("write_") * F.coalesce("price_write", "price_in") + F.col("out_") * F.col("price_out")
    amount = F.when((F.col("in_") > 0) | (F.col("out_") > 0), F.call_function("div", total + (PRICE_UNIT - 1), F.lit(PRICE_UNIT)) + surcharge)
    return u.select(*usage.columns, (F.col("in_") - F.col("read_") - F.col("write_")).alias("uncached"), amount.alias("amount"))


def character_page(records: DataFrame, keys: list[str], ordinal: int = 0, offset: int = 0, limit: int = 4, budget: int = PAGE_CHARACTERS) -> DataFrame:
    """The fragments of a page of records (keys, ordinal, text) from a cursor on: at most limit records and budget characters; a record too long goes on by offset on the next page."""
    if not 1 <= limit <= 8 or ordinal < 0 or offset < 0:
        raise ValueError("limit must be 1 to 8 and the cursor inside the collection")
    w = Window.partitionBy(*keys).orderBy("ordinal")
    own = F.when(F.col("ordinal") == ordinal, F.lit(offset)).otherwise(0)
    r = records.filter((F.col("ordinal") >= ordinal) & (F.col("ordinal") < ordinal + limit)).withColumns({"start_character": own.cast("long"), "characters": F.char_length("text").cast("long")})
    r = r.withColumn("before", F.coalesce(F.sum(F.col("characters") - F.col("start_character")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.filter((F.col("before") < budget) & (F.col("start_character") < F.col("characters")))
    end = F.least(F.col("characters"), F.col("start_character") + budget - F.col("before"))
    return r.select(*keys, "ordinal", "characters", "start_character", end.alias("end_character"), F.substring(F.col("text"), F.col("start_character").cast("int") + 1, (end - F.col("start_character")).cast("int")).alias("fragment"))


def speech_intervals(frames: DataFrame, durations: DataFrame) -> DataFrame:
    """Frames (source_id, ix, p) to speech intervals with hysteresis. Speech begins with a frame of SPEECH_ON; a pause begins with the first frame below SPEECH_OFF
    after the last one at SPEECH_ON, and ends the speech there once a low frame LEAST_SILENCE after it is reached. Short speech goes, the rest is padded,
    and pads that overlap meet in the middle. Frames between two at SPEECH_ON are looked at together, so no state runs from row to row."""
    o = by_source("ix")
    run = F.sum((F.col("p") >= SPEECH_ON).cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0))
    low = F.when(F.col("p") < SPEECH_OFF, F.col("ix"))
    g = frames.withColumn("run", run).filter("run > 0").groupBy("source_id", "run").agg(F.min("ix").alias("on"), F.min(low).alias("pause"), F.max(low).alias("late"))
    g = g.withColumn("closes", F.coalesce((F.col("late") - F.col("pause")) * FRAME >= LEAST_SILENCE, F.lit(False)))
    r = by_source("run")
    g = g.withColumn("part", F.coalesce(F.sum(F.col("closes").cast("int")).over(r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    raw = g.groupBy("source_id", "part").agg(F.min("on").alias("on"), F.max(F.when(F.col("closes"), F.col("pause"))).alias("off")).join(durations, "source_id")
    raw = raw.select("source_id", "samples", (F.col("on") * FRAME).alias("s"), F.coalesce(F.col("off") * FRAME, "samples").alias("e")).filter(F.col("e") - F.col("s") >= LEAST_SPEECH)
    q = by_source("s")
    padded = raw.withColumns({"left": F.greatest(F.lit(0).cast("long"), F.col("s") - PAD), "right": F.least("samples", F.col("e") + PAD)})
    middle = lambda a, b: F.floor((a + b) / 2)
    before, after = F.lag("right").over(q), F.lead("left").over(q)
    cut = padded.select("source_id", "samples", F.when(F.col("left") < before, middle(before, F.col("left"))).otherwise(F.col("left")).alias("b"), F.when(after < F.col("right"), middle(F.col("right"), after)).otherwise(F.col("right")).alias("e"))
    ms = lambda c: F.bround(F.col(c) * 1000 / RATE).cast("long")
    own = cut.withColumn("ix", F.explode(F.sequence(F.expr(f"b div {FRAME}"), F.expr(f"(e + {FRAME - 1}) div {FRAME} - 1"))))
    met = own.join(frames, ["source_id", "ix"], "left").groupBy("source_id", "samples", "b", "e").agg(F.min("p").alias("lo"), F.avg("p").alias("mean"), F.max("p").alias("hi"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return met.select("source_id", ms("b").alias("start_ms"), F.least(ms("e"), ms("samples")).alias("end_ms"), zero("lo"), zero("mean"), zero("hi"))


# ---- queries -----------------------------------------------------------------------------------------------

def _lengths(s: SparkSession, d: str, extra: Column | int = 0) -> DataFrame:
    return words(s, d).groupBy("source_id").agg(F.max("end_ms").alias("top")).select("source_id", (F.col("top") + extra).cast("long").alias("duration_ms"))


_LEN = "SELECT source_id, max(end_ms) AS duration_ms FROM words GROUP BY 1"


def v2_evidence(s: SparkSession, d: str) -> DataFrame:
    w = words(s, d).select("source_id", F.when(F.col("ord") % 101 == 50, F.col("ord") - 1).otherwise(F.col("ord")).alias("word_id"), F.when(F.col("ord") % 83 == 9, F.col("ord") + 100_000).otherwise(F.col("ord")).alias("ord"), F.when(F.col("ord") % 71 == 3, "").otherwise(F.col("text")).alias("text"), "start_ms", F.when(F.col("ord") % 67 == 5, F.col("start_ms") - 1).otherwise(F.col("end_ms")).alias("end_ms"))
    g = sentence_grid(words(s, d)).select("source_id", "sentence_id", F.col("word_start").alias("first"), F.when(F.col("sentence_id") % 13 == 6, F.col("word_end") + 1).otherwise(F.col("word_end")).alias("last"), "text", "start_ms", "end_ms")
    return evidence_violations(w, g, _lengths(s, d))


def v4_edit(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("long").alias("k")).distinct()
    ord_, odd = F.col("k") - 1, (F.col("plan") + F.col("k")) % 17
    num = F.when(odd == 3, (ord_ - 1) * 1001).otherwise(ord_ * 1001)
    b = li.select("plan", ord_.alias("ord"), num.alias("num"), F.lit(30).cast("long").alias("den")).withColumn("ms", half_up_ms(F.col("num") * 1000, F.col("den")) + F.when((F.col("plan") + F.col("ord")) % 19 == 4, 1).otherwise(0))
    g = li.groupBy("plan").agg(F.max("k").alias("top"))
    return edit_violations(b, g.select("plan", (F.col("top") - 1 + F.when(F.col("plan") % 11 == 2, 1).otherwise(0)).alias("n_sections")), g.select("plan", F.expr("(top - 1) * 1001 * 1000 div 30").alias("duration_ms")))


def v6_layers(s: SparkSession, d: str) -> DataFrame:
    w = words(s, d).select("source_id", "ord", "text", "start_ms", "end_ms", "speaker")
    moved = w.filter("ord % 97 <> 13").withColumn("end_ms", F.when(F.col("ord") % 59 == 8, F.col("end_ms") + 5).otherwise(F.col("end_ms")))
    g = sentence_grid(words(s, d)).select("source_id", "sentence_id", F.when(F.col("sentence_id") % 17 == 5, F.col("word_start") + 1).otherwise(F.col("word_start")).alias("word_start"), "word_end", "start_ms", "end_ms")
    return layer_violations(w, moved, g.filter("sentence_id % 23 <> 11"))


def v7_proposal(s: SparkSession, d: str) -> DataFrame:
    g = sentence_grid(words(s, d)).select("source_id", "sentence_id")
    k = F.col("sentence_id")
    t = g.filter("sentence_id % 6 = 0").select("source_id", F.expr("sentence_id div 6 div case when sentence_id % 30 = 24 then 2 else 1 end").alias("topic"), F.when(k % 42 == 36, k + 9).otherwise(k).alias("first"), (k + 4).alias("last"), F.when(k % 24 == 18, " ").otherwise("t").alias("title"))
    p = g.filter("sentence_id % 6 = 0 and sentence_id % 54 <> 48").select("source_id", F.expr("sentence_id div 6").alias("topic"), F.when(k % 12 == 0, "core").otherwise("context").alias("field"), (k + 1).alias("first"), (k + F.when(k % 18 == 12, 7).when(k % 18 == 6, 0).otherwise(3)).alias("last"))
    return proposal_violations(t, p.unionByName(p.filter("field <> 'core'").withColumn("field", F.lit("core"))), g)


def v12_claims(s: SparkSession, d: str) -> DataFrame:
    g = sentence_grid(words(s, d)).select("source_id", "sentence_id")
    return undelivered(g.select("source_id", F.col("sentence_id").alias("claim"), F.expr("sentence_id div 2").alias("first"), F.expr("sentence_id div 2 + sentence_id % 4").alias("last")), g.filter("sentence_id % 7 <> 3"))


def x6_review(s: SparkSession, d: str) -> DataFrame:
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    k = F.col("o_custkey")
    c = o.select(F.col("o_orderkey").alias("review"), (k % 3).alias("criterion"), F.when(k % 4 == 0, "pass").when(k % 4 == 1, "fail").otherwise("unknown").alias("status"), F.when(k % 10 == 7, "  ").otherwise("r").alias("reason"), F.lit(5).alias("allowed_first"), F.lit(900).alias("allowed_last"), F.lit(300).alias("topic_first"), F.lit(500).alias("topic_last"))
    sp = li.select(F.col("l_orderkey").alias("review"), (F.col("l_linenumber") % 3).cast("long").alias("criterion"), (F.col("l_partkey") % 890).alias("first"), (F.col("l_partkey") % 890 + F.col("l_suppkey") % 12 - 1).alias("last"))
    return review_violations(c, sp)


def _chapters(s: SparkSession, d: str) -> DataFrame:
    g = sentence_grid(words(s, d)).groupBy("source_id", F.expr("sentence_id div 5").alias("ord")).agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    k = F.col("ord") + F.col("source_id")
    return g.select("source_id", "ord", F.when(k % 9 == 1, F.col("a") - 4000).otherwise(F.col("a")).alias("start_ms"), F.when(k % 7 == 2, F.expr("(a + b) div 2")).otherwise(F.col("b")).alias("end_ms"), F.when(k % 11 == 3, " ").otherwise("t").alias("title"))


_CHAPTERS = """cg AS (SELECT source_id, sentence_id // 5 AS ord, min(start_ms) AS a, max(end_ms) AS b FROM grid GROUP BY ALL),
ch AS (SELECT source_id, ord, CASE WHEN (ord + source_id) % 9 = 1 THEN a - 4000 ELSE a END AS s, CASE WHEN (ord + source_id) % 7 = 2 THEN (a + b) // 2 ELSE b END AS e, CASE WHEN (ord + source_id) % 11 = 3 THEN ' ' ELSE 't' END AS title FROM cg)"""


def g10_chapters(s: SparkSession, d: str) -> DataFrame:
    return chapter_score(_chapters(s, d).filter("source_id % 8 <> 5"), _lengths(s, d, F.col("source_id") % 3 * 2000))


def g11_suggestions(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").filter("conv_id % 6 <> 0 or turn <> 1")
    t = F.col("turn")
    sg = c.select(F.col("conv_id").alias("source_id"), t.cast("long").alias("ord"), F.when(t % 4 == 3, "ghost").otherwise(F.col("role")).alias("speaker"), F.when(t % 5 == 2, "nobody").when(t % 5 == 1, "user").alias("merge_with"), F.when(t % 2 == 0, F.concat(F.lit("N"), t.cast("string"))).alias("name"), F.when(t % 3 == 0, " ").otherwise("said").alias("evidence"))
    return suggestion_score(sg, table(s, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("role").alias("speaker"), F.col("turn").cast("long").alias("ord")))


def g13_extractions(s: SparkSession, d: str) -> DataFrame:
    k = F.col("sentence_id")
    r = sentence_grid(words(s, d)).filter("sentence_id % 2 = 0 and source_id % 9 <> 4").select("source_id", k.alias("ord"), F.when(F.col("source_id") % 4 == 1, "fact").when(k % 6 == 2, "quote").otherwise("fact").alias("kind"), "start_ms", F.when(k % 22 == 8, F.col("start_ms") - 7).otherwise(F.col("end_ms")).alias("end_ms"), (k % 10 != 6).alias("grounded"))
    return extraction_score(r, _lengths(s, d))


def g15_segments(s: SparkSession, d: str) -> DataFrame:
    k = F.col("ord") + F.col("source_id")
    r = _chapters(s, d).filter("source_id % 8 <> 5").select("source_id", "ord", F.when((k % 3 == 0) | (F.col("source_id") % 10 == 7), "drop").otherwise("keep").alias("kind"), F.when(k % 2 == 0, "why").alias("drop_reason"), "start_ms", "end_ms", (k % 8 != 4).alias("grounded"))
    return segment_score(r, _lengths(s, d).select("source_id", (F.col("source_id") % 4 != 2).alias("partition_ok")))


def g17_decisions(s: SparkSession, d: str) -> DataFrame:
    w = words(s, d).select("source_id", F.expr("ord div 2").alias("atom"), "ord")
    p = w.filter("atom % 12 <> 7").withColumn("keep", F.expr("(atom + source_id) % 4 = 1"))
    return decision_score(p, w.withColumn("keep", F.expr("(atom + source_id) % 5 in (1, 2)")))


def g18_answers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select((F.col("o_custkey") % 10).alias("suite"), k.alias("question"), (F.col("o_custkey") % 3 != 0).alias("expected"), (k % 5 != 0).alias("got"), F.when(k % 8 != 1, k % 700).alias("gold_start"), F.when(k % 8 != 1, k % 700 + 90).alias("gold_end"))
    return answer_score(o, table(s, d, "lineitem").select(F.col("l_orderkey").alias("question"), (F.col("l_partkey") % 900).alias("start_ms"), (F.col("l_partkey") % 900 + 60).alias("end_ms")))


def x10_settled(s: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    u = table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_partkey") % 5000 - 100).cast("long").alias("input"), F.when(F.col("l_linenumber") == 7, -3).otherwise(F.col("l_suppkey") % 300).cast("long").alias("output"),
        (q * 40).alias("cache_read"), (F.col("l_linenumber") * 100).cast("long").alias("cache_write"), F.lit(1_250_000).cast("long").alias("price_in"), F.lit(10_000_000).cast("long").alias("price_out"),
        F.when(F.col("l_returnflag") == "N", F.lit(125_000).cast("long")).alias("price_read"), F.when(F.col("l_linestatus") == "O", F.lit(1_562_500).cast("long")).alias("price_write"),
    )
    return settled(u, 25).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "uncached", "amount")


def x13_page(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "documents").select("source", F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    r = r.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1).alias("ordinal"), "text")
    return character_page(r, ["source"], 2, 40, 8).select("source", "ordinal", "characters", "start_character", "end_character", F.sha2("fragment", 256).alias("fragment_sha256"))


def speech_frames(s: SparkSession, d: str) -> DataFrame:
    """(source_id, ix, p) of the events of each user, in their order."""
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("source_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("ix"), (F.expr("(event_id div 2 * 37 + event_id % 7 * 5) % 100") / 100).alias("p"))


def b18_intervals(s: SparkSession, d: str) -> DataFrame:
    f = speech_frames(s, d)
    found = speech_intervals(f, f.groupBy("source_id").agg((F.count("*") * FRAME - 100).alias("samples")))
    return found.select("source_id", "start_ms", "end_ms", "lo", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "hi")


QUERIES = {
    "v2_evidence": v2_evidence, "v4_edit_cover": v4_edit, "v6_layers": v6_layers, "v7_topic_proposal": v7_proposal, "v12_claims": v12_claims, "x6_review_grounding": x6_review, "g10_chapter_score": g10_chapters, "g11_suggestion_score": g11_suggestions,
    "g13_extraction_score": g13_extractions, "g15_segment_score": g15_segments, "g17_decision_score": g17_decisions, "g18_answer_score": g18_answers, "x10_settled_usage": x10_settled, "x13_character_page": x13_page, "b18_speech_intervals": b18_intervals,
}

ORACLES = {
    "v2_evidence": f"""WITH {GRID_SQL}, ln AS ({_LEN}), w AS (SELECT source_id, CASE WHEN ord % 101 = 50 THEN ord - 1 ELSE ord END AS word_id, CASE WHEN ord % 83 = 9 THEN ord + 100000 ELSE ord END AS ord, CASE WHEN ord % 71 = 3 THEN '' ELSE text END AS text, start_ms, CASE WHEN ord % 67 = 5 THEN start_ms - 1 ELSE end_ms END AS end_ms FROM words),
sn AS (SELECT source_id, sentence_id, word_start AS f, CASE WHEN sentence_id % 13 = 6 THEN word_end + 1 ELSE word_end END AS l, text, start_ms, end_ms FROM grid),
p AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord, word_id) - 1 AS place, count(*) OVER (PARTITION BY source_id, word_id) AS same FROM w JOIN ln USING (source_id)),
ow AS (SELECT source_id, sentence_id, unnest(range(f, l + 1)) AS ord FROM sn),
sd AS (SELECT ow.source_id, ow.sentence_id, string_agg(w.text, ' ' ORDER BY ow.ord) AS said, first(w.start_ms ORDER BY ow.ord) FILTER (w.start_ms IS NOT NULL) AS b, max(w.end_ms) AS e, count(*) FILTER (w.word_id IS NULL) AS lost FROM ow LEFT JOIN w ON w.source_id = ow.source_id AND w.ord = ow.ord GROUP BY ALL),
sj AS (SELECT sn.*, said, b, e, lost FROM sn JOIN sd USING (source_id, sentence_id)), oc AS (SELECT w.source_id, w.word_id, count(ow.ord) AS n FROM w LEFT JOIN ow ON ow.source_id = w.source_id AND ow.ord = w.ord GROUP BY w.source_id, w.word_id, w.ord)
SELECT source_id, 'word' AS kind, word_id AS id, 'word_id' AS rule FROM p WHERE same > 1 UNION ALL SELECT source_id, 'word', word_id, 'order' FROM p WHERE ord <> place UNION ALL SELECT source_id, 'word', word_id, 'blank' FROM p WHERE text = ''
UNION ALL SELECT source_id, 'word', word_id, 'timing' FROM p WHERE start_ms < 0 OR end_ms < start_ms OR end_ms > duration_ms UNION ALL SELECT source_id, 'sentence', sentence_id, 'reference' FROM sj WHERE lost > 0 UNION ALL SELECT source_id, 'sentence', sentence_id, 'text' FROM sj WHERE text <> said
UNION ALL SELECT source_id, 'sentence', sentence_id, 'span' FROM sj WHERE start_ms <> b OR end_ms <> e UNION ALL SELECT source_id, 'word', word_id, 'ownership' FROM oc WHERE n <> 1""",
    "v4_edit_cover": """WITH li AS (SELECT DISTINCT l_orderkey AS plan, l_linenumber::BIGINT AS k FROM lineitem), b AS (SELECT plan, k - 1 AS ord, CASE WHEN (plan + k) % 17 = 3 THEN (k - 2) * 1001 ELSE (k - 1) * 1001 END AS num FROM li),
c AS (SELECT *, CASE WHEN (plan + ord) % 19 = 4 THEN 1 ELSE 0 END AS off, lag(num) OVER w AS p, lead(ord) OVER w AS nx, count(*) OVER (PARTITION BY plan) AS n FROM b WINDOW w AS (PARTITION BY plan ORDER BY ord)), g AS (SELECT plan, max(k) AS top FROM li GROUP BY 1), j AS (SELECT * FROM c JOIN g USING (plan))
SELECT plan, ord, 'count' AS rule FROM j WHERE p IS NULL AND n <> top + CASE WHEN plan % 11 = 2 THEN 1 ELSE 0 END UNION ALL SELECT plan, ord, 'start' FROM j WHERE p IS NULL AND num <> 0 UNION ALL SELECT plan, ord, 'end' FROM j WHERE nx IS NULL AND num * 1000 <> ((top - 1) * 1001 * 1000 // 30) * 30
UNION ALL SELECT plan, ord, 'rounding' FROM j WHERE off <> 0 UNION ALL SELECT plan, ord, 'increasing' FROM j WHERE num <= p""",
    "v6_layers": f"""WITH {GRID_SQL}, l AS (SELECT source_id, ord, CASE WHEN ord % 59 = 8 THEN end_ms + 5 ELSE end_ms END AS end_ms FROM words WHERE ord % 97 <> 13),
sn AS (SELECT source_id, sentence_id, CASE WHEN sentence_id % 17 = 5 THEN word_start + 1 ELSE word_start END AS f, word_end AS l, start_ms, end_ms FROM grid WHERE sentence_id % 23 <> 11),
q AS (SELECT *, coalesce(lag(l) OVER w + 1, 0) AS x, row_number() OVER w - 1 AS place, lead(l) OVER w IS NULL AS fin FROM sn WINDOW w AS (PARTITION BY source_id ORDER BY f, sentence_id)), t AS (SELECT source_id, max(ord) AS top FROM words GROUP BY 1),
sp AS (SELECT q.source_id, sentence_id, arg_min(w.start_ms, w.ord) AS b, max(w.end_ms) AS e FROM q JOIN words w ON w.source_id = q.source_id AND w.ord BETWEEN f AND l GROUP BY ALL), z AS (SELECT q.*, top, b, e FROM q JOIN t USING (source_id) LEFT JOIN sp USING (source_id, sentence_id))
SELECT w.source_id, 'word' AS kind, w.ord AS id, CASE WHEN l.ord IS NULL THEN 'missing' ELSE 'differs' END AS rule FROM words w LEFT JOIN l ON l.source_id = w.source_id AND l.ord = w.ord WHERE l.ord IS NULL OR l.end_ms <> w.end_ms
UNION ALL SELECT source_id, 'sentence', sentence_id, 'id' FROM z WHERE sentence_id <> place UNION ALL SELECT source_id, 'sentence', sentence_id, 'cover' FROM z WHERE f <> x OR l < f UNION ALL SELECT source_id, 'sentence', sentence_id, 'outside' FROM z WHERE l > top
UNION ALL SELECT source_id, 'sentence', sentence_id, 'span' FROM z WHERE start_ms <> b OR end_ms <> e UNION ALL SELECT source_id, 'sentence', sentence_id, 'short' FROM z WHERE fin AND l < top""",
    "v7_topic_proposal": f"""WITH {GRID_SQL}, k AS (SELECT source_id, sentence_id AS k FROM grid), t AS (SELECT source_id, k // 6 // CASE WHEN k % 30 = 24 THEN 2 ELSE 1 END AS topic, CASE WHEN k % 42 = 36 THEN k + 9 ELSE k END AS f, k + 4 AS l, CASE WHEN k % 24 = 18 THEN ' ' ELSE 't' END AS title FROM k WHERE k % 6 = 0),
p0 AS (SELECT source_id, k // 6 AS topic, CASE WHEN k % 12 = 0 THEN 'core' ELSE 'context' END AS field, k + 1 AS f, k + CASE WHEN k % 18 = 12 THEN 7 WHEN k % 18 = 6 THEN 0 ELSE 3 END AS l FROM k WHERE k % 6 = 0 AND k % 54 <> 48), p AS (SELECT * FROM p0 UNION ALL SELECT source_id, topic, 'core', f, l FROM p0 WHERE field <> 'core'),
mx AS (SELECT source_id, max(k) AS top FROM k GROUP BY 1), tc AS (SELECT *, count(*) OVER (PARTITION BY source_id, topic) AS same FROM t JOIN mx USING (source_id)), pj AS (SELECT p.*, top, t.f AS tf, t.l AS tl FROM p JOIN (SELECT DISTINCT source_id, topic, f, l FROM t) t USING (source_id, topic) JOIN mx USING (source_id))
SELECT source_id, topic, 'blank' AS rule FROM tc WHERE trim(title) = '' UNION SELECT source_id, topic, 'duplicate' FROM tc WHERE same > 1 UNION SELECT source_id, topic, 'unknown' FROM tc WHERE f > top OR l > top UNION SELECT source_id, topic, 'reversed' FROM tc WHERE l < f
UNION SELECT source_id, topic, 'no_core' FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source_id = t.source_id AND p.topic = t.topic AND field = 'core') UNION SELECT source_id, topic, 'span_unknown' FROM pj WHERE f > top OR l > top UNION SELECT source_id, topic, 'span_reversed' FROM pj WHERE l < f UNION SELECT source_id, topic, 'span_outside' FROM pj WHERE f < tf OR l > tl""",
    "v12_claims": f"WITH {GRID_SQL}, c AS (SELECT DISTINCT source_id, sentence_id AS claim, unnest(range(sentence_id // 2, sentence_id // 2 + sentence_id % 4 + 1)) AS x FROM grid) SELECT source_id, x AS sentence_id, claim FROM c WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.source_id = c.source_id AND g.sentence_id = x AND x % 7 <> 3)",
    "x6_review_grounding": """WITH c AS (SELECT o_orderkey AS review, o_custkey % 3 AS criterion, CASE o_custkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unknown' END AS status, o_custkey % 10 = 7 AS blank FROM orders), s AS (SELECT l_orderkey AS review, (l_linenumber % 3)::BIGINT AS criterion, l_partkey % 890 AS f, l_partkey % 890 + l_suppkey % 12 - 1 AS l FROM lineitem),
g AS (SELECT c.review, c.criterion, status, blank, count(f) AS n, coalesce(bool_or(NOT (5 <= f AND f <= l AND l <= 900)), false) AS bad, coalesce(bool_or(f <= 500 AND l >= 300), false) AS owns FROM c LEFT JOIN s ON s.review = c.review AND s.criterion = c.criterion GROUP BY ALL)
SELECT review, criterion, 'blank' AS rule FROM g WHERE blank UNION ALL SELECT review, criterion, 'no_evidence' FROM g WHERE status <> 'unknown' AND n = 0 UNION ALL SELECT review, criterion, 'unavailable' FROM g WHERE bad UNION ALL SELECT review, criterion, 'not_cited' FROM g WHERE status = 'pass' AND NOT owns""",
    "g10_chapter_score": f"""WITH {GRID_SQL}, {_CHAPTERS}, x AS (SELECT *, s < lag(e) OVER (PARTITION BY source_id ORDER BY ord) AS m FROM ch WHERE source_id % 8 <> 5), ln AS (SELECT source_id, max(end_ms) + source_id % 3 * 2000 AS d FROM words GROUP BY 1),
g AS (SELECT source_id, sum(e - s) AS c, coalesce(bool_or(m), false) AS m, arg_max(e, ord) AS le, string_agg('chapter ' || ord || ' has an empty title', '; ' ORDER BY ord) FILTER (trim(title) = '') AS t FROM x GROUP BY 1), j AS (SELECT *, least(c / d, 1.0) AS sh FROM ln LEFT JOIN g USING (source_id))
SELECT source_id, round(CASE WHEN c IS NULL THEN 0 ELSE sh * CASE WHEN m THEN 0.5 ELSE 1 END * CASE WHEN t IS NOT NULL THEN 0.8 ELSE 1 END END, 6)::DOUBLE AS score,
CASE WHEN c IS NULL THEN 'no chapters' ELSE concat_ws('; ', t, CASE WHEN sh < 0.8 THEN 'chapters cover only ' || floor(sh * 100 + 0.5)::BIGINT || '%' END, CASE WHEN m THEN 'chapters overlap or are out of order' END, CASE WHEN le < d * 0.9 THEN 'last chapter ends well before the recording does' END) END AS issues FROM j""",
    "g11_suggestion_score": """WITH k AS (SELECT conv_id AS s, role AS sp, min(turn) AS o FROM conversations GROUP BY ALL), g AS (SELECT conv_id AS s, turn AS o, CASE WHEN turn % 4 = 3 THEN 'ghost' ELSE role END AS sp, CASE turn % 5 WHEN 2 THEN 'nobody' WHEN 1 THEN 'user' END AS mw FROM conversations WHERE conv_id % 6 <> 0 OR turn <> 1),
i AS (SELECT s, 0 AS part, o, 0 AS q, 'suggestion for unknown speaker id ' || sp AS t FROM g WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.s = g.s AND k.sp = g.sp) UNION ALL SELECT s, 0, o, 1, 'merge target ' || mw || ' is not a speaker id' FROM g WHERE mw IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.s = g.s AND k.sp = g.mw)
UNION ALL SELECT s, 0, o, 2, 'name for speaker ' || sp || ' carries no evidence' FROM g WHERE o % 6 = 0 UNION ALL SELECT s, 1, o, 0, 'speaker id ' || sp || ' has no suggestion entry' FROM k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.s = k.s AND g.sp = k.sp)),
l AS (SELECT s, count(*) AS n, string_agg(t, '; ' ORDER BY part, o, q) AS t FROM i GROUP BY 1), z AS (SELECT s, count(*) AS known FROM k GROUP BY 1) SELECT s AS source_id, round(greatest(0, 1 - coalesce(n, 0) / known), 6)::DOUBLE AS score, coalesce(t, '') AS issues FROM z LEFT JOIN l USING (s)""",
    "g13_extraction_score": f"""WITH {GRID_SQL}, ln AS ({_LEN}), r AS (SELECT source_id, sentence_id AS k, CASE WHEN source_id % 4 = 1 THEN 'fact' WHEN sentence_id % 6 = 2 THEN 'quote' ELSE 'fact' END AS kind, start_ms AS s, CASE WHEN sentence_id % 22 = 8 THEN start_ms - 7 ELSE end_ms END AS e, sentence_id % 10 <> 6 AS g FROM grid WHERE sentence_id % 2 = 0 AND source_id % 9 <> 4),
a AS (SELECT ln.source_id, count(k) AS n, count(*) FILTER (g) AS good, string_agg(kind || ' range ' || s || '-' || e || ' is invalid', '; ' ORDER BY k) FILTER (g AND (e <= s OR e > duration_ms)) AS bad, count(DISTINCT kind) AS kinds, min(kind) AS kind FROM ln LEFT JOIN r ON r.source_id = ln.source_id GROUP BY 1)
SELECT source_id, round(CASE WHEN n = 0 THEN 0 ELSE good / n * CASE WHEN bad IS NOT NULL THEN 0.5 ELSE 1 END * CASE WHEN kinds < 2 THEN 0.8 ELSE 1 END END, 6)::DOUBLE AS score, CASE WHEN n = 0 THEN 'no extractions produced' ELSE concat_ws('; ', CASE WHEN good < n THEN (n - good) || '/' || n || ' items failed verbatim grounding' END, bad, CASE WHEN kinds < 2 THEN 'only ' || kind || ' extracted' END) END AS issues FROM a""",
    "g15_segment_score": f"""WITH {GRID_SQL}, {_CHAPTERS}, r AS (SELECT *, CASE WHEN (ord + source_id) % 3 = 0 OR source_id % 10 = 7 THEN 'drop' ELSE 'keep' END AS kind, (ord + source_id) % 2 = 0 AS why, (ord + source_id) % 8 <> 4 AS g, s < lag(e) OVER (PARTITION BY source_id ORDER BY ord) AS m FROM ch WHERE source_id % 8 <> 5),
a AS (SELECT source_id, count(*) FILTER (kind = 'keep') AS keeps, count(*) FILTER (kind = 'keep' AND g) AS good, count(*) FILTER (kind = 'drop' AND NOT why) AS bare, coalesce(bool_or(m), false) AS m FROM r GROUP BY 1), j AS (SELECT l.source_id, l.source_id % 4 <> 2 AS ok, a.* EXCLUDE (source_id) FROM ({_LEN}) l LEFT JOIN a ON a.source_id = l.source_id)
SELECT source_id, round(CASE WHEN coalesce(keeps, 0) = 0 THEN 0 ELSE good / keeps * CASE WHEN ok THEN 1 ELSE 0.5 END * CASE WHEN m THEN 0.5 ELSE 1 END * CASE WHEN bare > 0 THEN 0.9 ELSE 1 END END, 6)::DOUBLE AS score, CASE WHEN keeps IS NULL THEN 'no segments produced' WHEN keeps = 0 THEN 'plan kept nothing'
ELSE concat_ws('; ', CASE WHEN good < keeps THEN (keeps - good) || '/' || keeps || ' keeps failed anchor grounding' END, CASE WHEN NOT ok THEN 'rows do not tile the episode' END, CASE WHEN bare > 0 THEN bare || ' drop(s) carry no reason' END, CASE WHEN m THEN 'rows overlap or are out of order' END) END AS issues FROM j""",
    "g17_decision_score": f"""WITH {WORDS_SQL}, a AS (SELECT source_id, ord // 2 AS atom, count(*) AS n FROM words GROUP BY ALL), m AS (SELECT source_id, atom, n, (atom + source_id) % 5 IN (1, 2) AS keep, CASE WHEN atom % 12 <> 7 THEN (atom + source_id) % 4 = 1 END AS said FROM a),
c AS (SELECT source_id, keep, count(*) FILTER (said = keep) / count(*) AS x, count(*) FILTER (said IS NULL) AS q, count(*) FILTER (said AND NOT keep) AS k, count(*) FILTER (NOT said AND keep) AS r, sum(n - 1) FILTER (said IS NOT NULL) AS p FROM m GROUP BY ALL)
SELECT source_id, round(avg(x), 6) AS score, sum(q)::BIGINT AS no_prediction, sum(k)::BIGINT AS kept_wrongly, sum(r)::BIGINT AS removed_wrongly, coalesce(sum(p), 0)::BIGINT AS repeated FROM c GROUP BY 1""",
    "g18_answer_score": """WITH o AS (SELECT o_custkey % 10 AS suite, o_orderkey AS q, o_custkey % 3 <> 0 AS x, o_orderkey % 5 <> 0 AS g, CASE WHEN o_orderkey % 8 <> 1 THEN o_orderkey % 700 END AS a FROM orders),
h AS (SELECT o.*, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = q AND l_partkey % 900 < coalesce(a + 90, 0) AND l_partkey % 900 + 60 > coalesce(a, 0)) AS hit FROM o)
SELECT suite, round(avg(CASE WHEN x <> g THEN 0 WHEN NOT x OR hit THEN 1 ELSE 0.5 END), 6)::DOUBLE AS score, count(*) FILTER (x <> g) AS wrong, count(*) FILTER (x = g AND x AND NOT hit) AS uncited FROM h GROUP BY 1""",
    "x10_settled_usage": """WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_partkey % 5000 - 100 END) AS i, greatest(0, CASE WHEN l_linenumber = 7 THEN -3 ELSE l_suppkey % 300 END) AS o, l_quantity::BIGINT * 40 AS r, l_linenumber * 100 AS w, CASE WHEN l_returnflag = 'N' THEN 125000 ELSE 1250000 END AS pr, CASE WHEN l_linestatus = 'O' THEN 1562500 ELSE 1250000 END AS pw FROM lineitem),
v AS (SELECT *, least(r, i) AS r2, least(w, i - least(r, i)) AS w2 FROM u) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (i - r2 - w2)::BIGINT AS uncached, CASE WHEN i > 0 OR o > 0 THEN (((i - r2 - w2) * 1250000 + r2 * pr + w2 * pw + o * 10000000 + 999999) // 1000000 + 25)::BIGINT END AS amount FROM v""",
    "x13_character_page": """WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS o, coalesce(text, '') AS t FROM documents), p AS (SELECT *, length(t) AS c, CASE WHEN o = 2 THEN 40 ELSE 0 END AS st FROM r WHERE o BETWEEN 2 AND 9), q AS (SELECT *, coalesce(sum(c - st) OVER (PARTITION BY source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT source, o AS ordinal, c AS characters, st AS start_character, least(c, st + 12000 - b)::BIGINT AS end_character, sha256(substr(t, st + 1, (least(c, st + 12000 - b) - st)::BIGINT)) AS fragment_sha256 FROM q WHERE b < 12000 AND st < c""",
    "b18_speech_intervals": """WITH RECURSIVE f AS (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix, (event_id // 2 * 37 + event_id % 7 * 5) % 100 / 100 AS p FROM events), n AS (SELECT s, count(*) * 512 - 100 AS d FROM f GROUP BY 1),
st AS (SELECT s, -1::BIGINT AS ix, false AS on_, 0::BIGINT AS b, NULL::BIGINT AS q, NULL::BIGINT AS ob, NULL::BIGINT AS oe FROM n UNION ALL
  SELECT s, ix, on_ AND NOT cl, b, CASE WHEN cl THEN NULL ELSE q END, CASE WHEN cl THEN b END, CASE WHEN cl THEN q END FROM (SELECT *, on_ AND q IS NOT NULL AND p < 0.35 AND (ix - q) * 512 >= 1600 AS cl FROM (SELECT f.s, f.ix, f.p, st.on_ OR f.p >= 0.5 AS on_, CASE WHEN f.p >= 0.5 AND NOT st.on_ THEN f.ix ELSE st.b END AS b,
    CASE WHEN f.p >= 0.5 THEN NULL WHEN st.on_ AND f.p < 0.35 THEN coalesce(st.q, f.ix) ELSE st.q END AS q FROM st JOIN f ON f.s = st.s AND f.ix = st.ix + 1))),
rw AS (SELECT s, ob * 512 AS b, oe * 512 AS e FROM st WHERE ob IS NOT NULL UNION ALL SELECT st.s, b * 512, d FROM st JOIN n ON n.s = st.s WHERE on_ AND ix = (d + 100) // 512 - 1),
pd AS (SELECT rw.s, d, greatest(0, b - 480) AS l, least(d, e + 480) AS r FROM rw JOIN n ON n.s = rw.s WHERE e - b >= 4000), ct AS (SELECT s, d, CASE WHEN l < lag(r) OVER w THEN (lag(r) OVER w + l) // 2 ELSE l END AS b, CASE WHEN lead(l) OVER w < r THEN (r + lead(l) OVER w) // 2 ELSE r END AS e FROM pd WINDOW w AS (PARTITION BY s ORDER BY l))
SELECT ct.s AS source_id, round_even(b / 16, 0)::BIGINT AS start_ms, least(round_even(e / 16, 0), round_even(d / 16, 0))::BIGINT AS end_ms, coalesce(min(p), 0)::DOUBLE AS lo, round(coalesce(avg(p), 0) + 1e-9, 6)::DOUBLE AS mean, coalesce(max(p), 0)::DOUBLE AS hi FROM ct LEFT JOIN f ON f.s = ct.s AND f.ix >= b // 512 AND f.ix < (e + 511) // 512 GROUP BY ct.s, d, b, e""",
}
