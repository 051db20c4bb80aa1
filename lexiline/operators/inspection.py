"""Replaying what an agent read of a source: each call of a trace against what the index gives for its arguments, at that point of the trace.

A call's place in its trace comes from the calls before it by windows over the trace; pages are computed anew by joins with the index, a page at most. No call is replayed
in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.functions.text import strip
from lexiline.operators.source_index import _REGIONS, _index, _placed
from lexiline.plans.shared import stored

# fixed values: bounds of pages and queries, and what calls ask for where they don't say
BROWSE_MOST, SEARCH_MOST, READ_MOST, READ_CHARS, QUERY_CHARS = 16, 12, 80, 16_000, 512
BROWSE_LIMIT, SEARCH_LIMIT, READ_LIMIT = 8, 6, 40
COLD = "cold_reviewer"
CALLS = (
    "trace long, seq long, tool string, parent_id string, query string, cursor long, limit long, node_ids array<string>, next_cursor long, first long, last long, cursor_sentence long, cursor_character long, "
    "sentence_ids array<long>, next_sentence long, fragment_ids array<string>, next_character long, complete boolean"
)


def _rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.select("trace", "seq", F.explode(F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]), lambda x: x.isNotNull())).alias("rule"))


def _browse(calls: DataFrame, traces: DataFrame, nodes: DataFrame) -> DataFrame:
    of_trace = Window.partitionBy("trace").orderBy("seq")
    before = of_trace.rowsBetween(Window.unboundedPreceding, -1)
    parents = nodes.filter("kind <> 'region'").select("source_id", "id", "child_ids", (F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("kind") != "episode", "ordinal")) - 1).cast("long").alias("offset"))
    n = parents.groupBy("source_id").agg(F.count("*").alias("n_parents"))
    c = calls.filter("tool = 'browse_source'").join(traces.filter(F.col("role") != COLD).select("trace", "source_id"), "trace").join(n, "source_id", "left")
    # where the trace stands at each call, by what the calls before it said
    c = c.withColumns({"offset": F.coalesce(F.count_if("complete").over(before), F.lit(0)).cast("long"), "due": F.coalesce(F.lag(F.when(~F.col("complete"), F.col("next_cursor"))).over(of_trace), F.lit(0).cast("long"))})
    j = c.join(parents.withColumnRenamed("id", "due_parent"), ["source_id", "offset"], "left")
    cursor, limit, size = F.coalesce("cursor", F.lit(0)), F.coalesce("limit", F.lit(BROWSE_LIMIT)), F.size("child_ids")
    end = F.least(size, F.col("due") + limit)
    page, next_ = F.slice("child_ids", (F.col("due") + 1).cast("int"), F.greatest(F.lit(0), limit).cast("int")), F.when(end < size, end)
    known, asked = F.col("due_parent").isNotNull(), F.coalesce("parent_id", F.lit("episode")).eqNullSafe(F.col("due_parent")) & (cursor == F.col("due")) & limit.between(1, BROWSE_MOST)
    out = _rules(j, {"browse_repeated": ~known, "browse_cursor": known & ~asked, "browse_page": known & asked & ~F.coalesce("node_ids", F.array().cast("array<string>")).eqNullSafe(page), "browse_next": known & asked & ~(F.col("next_cursor").eqNullSafe(next_) & F.col("complete").eqNullSafe(next_.isNull()))})
    done = c.groupBy("trace").agg(F.count_if("complete").alias("done"), F.max_by("complete", "seq").alias("ended"))
    whole = traces.filter(F.col("role") != COLD).join(n, "source_id", "left").join(done, "trace", "left").filter("not (done <=> n_parents) or not coalesce(ended, false)")
    return out.unionByName(whole.select("trace", F.lit(None).cast("long").alias("seq"), F.lit("browse_incomplete").alias("rule")))


def _search(calls: DataFrame, traces: DataFrame, nodes: DataFrame) -> DataFrame:
    regions = nodes.filter("kind = 'region'").groupBy("source_id").agg(F.count("*").alias("n_regions"))
    c = calls.filter("tool = 'search_source'").join(traces.filter(F.col("role") != COLD).select("trace", "source_id"), "trace").join(regions, "source_id", "left")
    cursor, limit, query = F.coalesce("cursor", F.lit(0)), F.coalesce("limit", F.lit(SEARCH_LIMIT)), F.coalesce(strip("query"), F.lit(""))
    hits = c.select("trace", "seq", "source_id", F.explode("node_ids").alias("id")).join(nodes.filter("kind = 'region'").select("source_id", "id", F.lit(True).alias("known")), ["source_id", "id"], "left")
    strange = hits.groupBy("trace", "seq").agg(F.count_if(F.col("known").isNull()).alias("strange"))
    j = c.join(strange, ["trace", "seq"], "left").withColumns({"end": F.least(F.col("n_regions"), cursor + limit), "n_hits": F.size(F.coalesce("node_ids", F.array().cast("array<string>")))})
    bad = (query == "") | (F.char_length(query) > QUERY_CHARS) | ~cursor.between(0, F.col("n_regions")) | ~limit.between(1, SEARCH_MOST) | (F.coalesce("strange", F.lit(0)) > 0) | (F.size(F.array_distinct("node_ids")) < F.col("n_hits"))
    next_ = F.when(F.col("end") < F.col("n_regions"), F.col("end"))
    paged = (F.col("n_hits") == F.col("end") - cursor) & F.col("next_cursor").eqNullSafe(next_) & F.col("complete").eqNullSafe(next_.isNull())
    none = traces.filter(F.col("role") != COLD).join(c.select("trace").distinct(), "trace", "left_anti")
    return _rules(j, {"search": F.coalesce(bad, F.lit(True)), "search_next": ~F.coalesce(bad, F.lit(True)) & ~paged}).unionByName(none.select("trace", F.lit(None).cast("long").alias("seq"), F.lit("no_search").alias("rule")))


def read_pages(calls: DataFrame, placed: DataFrame) -> DataFrame:
    """(trace, seq, fine, ids, fragment, from, upto, size, after, after_character, done) of read calls with source_id: what each gives. fine: its arguments name a range; ids: whole sentences, up to the limit
    and the characters of a page, one at least; a sentence beyond a page's characters comes alone, from..upto of its size, in as many calls as it takes."""
    at = lambda c, k: placed.select("source_id", F.col("sentence_id").alias(c), F.col("k").alias(k))
    c = calls.filter("tool = 'read_source'").withColumns({"start": F.coalesce("cursor_sentence", "first"), "most": F.coalesce("limit", F.lit(READ_LIMIT)), "character": F.coalesce("cursor_character", F.lit(0))})
    c = c.select("trace", "seq", "source_id", "first", "last", "start", "most", "character").join(at("first", "lo"), ["source_id", "first"], "left").join(at("last", "hi"), ["source_id", "last"], "left").join(placed.select("source_id", F.col("sentence_id").alias("start"), F.col("k").alias("at"), F.char_length("text").alias("size")), ["source_id", "start"], "left")
    long_ = F.col("size") > READ_CHARS
    ranged = F.col("most").between(1, READ_MOST) & F.col("at").between(F.col("lo"), F.col("hi")) & (F.col("character") >= 0) & (F.col("character") < F.greatest(F.lit(1), F.col("size"))) & (long_ | (F.col("character") == 0))
    c = c.withColumns({"fine": F.coalesce(ranged, F.lit(False)), "long": long_})
    each = c.filter("fine and not long").select("trace", "seq", "source_id", "at", "hi", F.explode(F.sequence(F.col("at"), F.least("hi", F.col("at") + F.col("most") - 1).cast("int"))).alias("k")).join(placed.select("source_id", "k", "sentence_id", F.char_length("text").alias("n")), ["source_id", "k"])
    chars = F.sum("n").over(Window.partitionBy("trace", "seq").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    kept = each.withColumn("chars", chars).filter((F.col("chars") <= READ_CHARS) | (F.col("k") == F.col("at")))
    pages = kept.groupBy("trace", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sentence_id"))), lambda x: x["sentence_id"]).alias("ids"), (F.max("k") + 1).alias("end"))
    j = c.join(pages, ["trace", "seq"], "left")
    upto = F.least(F.col("size"), F.col("character") + READ_CHARS)
    partial = F.col("long") & (upto < F.col("size"))
    j = j.withColumn("k", F.when(partial, F.col("at")).when(F.col("long"), F.col("at") + 1).otherwise(F.col("end")))
    j = j.join(placed.select("source_id", "k", F.col("sentence_id").alias("after")), ["source_id", "k"], "left").withColumn("after", F.when(F.col("k") <= F.col("hi"), F.col("after")))
    return j.select(
        "trace", "seq", "source_id", "fine", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), F.when(F.col("fine") & F.col("long"), F.col("start")).alias("fragment"), F.col("character").cast("long").alias("from"), upto.cast("long").alias("upto"), F.col("size").cast("long").alias("size"), "after",
        F.when(partial, upto).cast("long").alias("after_character"), F.col("after").isNull().alias("done"),
    )


def _read(calls: DataFrame, traces: DataFrame, placed: DataFrame) -> DataFrame:
    c = calls.join(traces.select("trace", "source_id"), "trace")
    pages = read_pages(c, placed)
    j = c.filter("tool = 'read_source'").drop("source_id").join(pages, ["trace", "seq"])
    fragment = F.sha2(F.concat(F.col("fragment").cast("string"), F.lit(":"), F.col("from").cast("string"), F.lit(":"), F.col("upto").cast("string")), 256)
    fragments = F.when(F.col("fragment").isNull(), F.array().cast("array<string>")).otherwise(F.array(fragment))
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    same = none("sentence_ids", "long").eqNullSafe(F.col("ids")) & F.col("next_sentence").eqNullSafe(F.col("after")) & F.col("complete").eqNullSafe(F.col("done")) & none("fragment_ids", "string").eqNullSafe(fragments) & F.col("next_character").eqNullSafe(F.col("after_character"))
    out = _rules(j, {"read_range": ~F.col("fine"), "read_page": F.col("fine") & ~same})
    # what was read: sentences as stated, and those whose parts together are the whole text
    stated = c.filter("tool = 'read_source'").select("trace", "source_id", F.explode("sentence_ids").alias("sentence_id")).distinct()
    parts = pages.filter("fragment is not null").select("trace", "source_id", F.col("fragment").alias("sentence_id"), "from", "upto", "size")
    w = Window.partitionBy("trace", "sentence_id").orderBy("from", "upto")
    gap = F.col("from") > F.coalesce(F.max("upto").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_full = parts.withColumn("gap", gap).groupBy("trace", "source_id", "sentence_id").agg(F.bool_or("gap").alias("gap"), F.max("upto").alias("upto"), F.max("size").alias("size")).filter("not gap and upto = size").select("trace", "source_id", "sentence_id")
    read = stated.unionByName(in_full).distinct()
    unknown = read.join(placed.select("source_id", "sentence_id"), ["source_id", "sentence_id"], "left_anti").select("trace").distinct()
    silent = traces.join(read.select("trace").distinct(), "trace", "left_anti").select("trace")
    kept = traces.filter("retained is not null")
    lost = kept.select("trace", F.explode("retained").alias("sentence_id")).join(read.select("trace", "sentence_id"), ["trace", "sentence_id"], "left_anti").select("trace").distinct()
    nothing = kept.filter("size(retained) = 0").join(in_full.select("trace").distinct(), "trace", "left_anti").select("trace")
    twice = kept.filter(F.size(F.array_distinct("retained")) < F.size("retained")).select("trace")
    whole = lambda df, rule: df.select("trace", F.lit(None).cast("long").alias("seq"), F.lit(rule).alias("rule"))
    return out.unionByName(whole(silent, "no_speech")).unionByName(whole(unknown, "unknown_speech")).unionByName(whole(lost.unionByName(nothing).unionByName(twice).distinct(), "retained"))


def inspection_violations(calls: DataFrame, traces: DataFrame, nodes: DataFrame, sentences: DataFrame) -> DataFrame:
    """(trace, seq, rule) of calls (CALLS) of traces (trace, source_id, role, retained: what the reader still holds, null where that isn't known) over the nodes of an index and its sentences.

    Browsing goes through the episode and then each section, page by page: browse_cursor (another parent, place or size of page than is due), browse_page (other children than the index's),
    browse_next, browse_repeated (all was browsed before), browse_incomplete (seq null: something wasn't). Searches: search (query, place, size, or hits that are no regions of the source or come
    twice), search_next (not the number of hits, or the continuation, of its place), no_search. Reads: read_range (arguments that name no range), read_page (not what the range gives there). Of
    the whole trace: no_speech, unknown_speech, retained (nothing, twice, or what wasn't read in full). A cold reviewer only reads: tool."""
    placed = _placed(sentences)
    cold = calls.filter("tool <> 'read_source'").join(traces.filter(F.col("role") == COLD).select("trace"), "trace", "left_semi").select("trace", "seq", F.lit("tool").alias("rule"))
    return cold.unionByName(_browse(calls, traces, nodes)).unionByName(_search(calls, traces, nodes)).unionByName(_read(calls, traces, placed))


# ---- queries -------------------------------------------------------------------------------------------------

PAGE = 40


def _trace(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A trace for each source, that browses everything, searches once and reads all in pages; a fault in some, by the remainder of the source."""
    grid, nodes = _index(s, d)
    nodes = stored(nodes.select("source_id", "id", "kind", "ordinal", "child_ids"), "nodes")
    odd = lambda k, fault, c: F.when(F.col("source_id") % 17 == k, fault).otherwise(c)
    null = lambda t: F.lit(None).cast(t)
    names = [x.rsplit(" ", 1) for x in CALLS.split(", ")]
    full = lambda df: df.select(F.col("source_id").alias("trace"), *[(F.col(n) if n in df.columns else null(t)).cast(t).alias(n) for n, t in names if n != "trace"])
    parents = nodes.filter("kind <> 'region'").withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("kind") != "episode", "ordinal")) - 1)
    browse = full(parents.select("source_id", F.col("k").alias("seq"), F.lit("browse_source").alias("tool"), F.col("id").alias("parent_id"), odd(1, F.when(F.col("k") == 1, 1).otherwise(0), F.lit(0)).alias("cursor"), F.lit(16).alias("limit"), odd(2, F.reverse(F.array_append("child_ids", F.lit("x"))), F.col("child_ids")).alias("node_ids"), odd(3, F.lit(2), null("long")).alias("next_cursor"), F.lit(True).alias("complete")))
    regions = nodes.filter("kind = 'region'").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("ids"))
    n, hits = F.size("ids"), F.slice("ids", 1, 6)
    search = full(regions.select("source_id", F.lit(1000).alias("seq"), F.lit("search_source").alias("tool"), odd(4, F.lit(" \n"), F.lit("what")).alias("query"), odd(5, F.slice(F.array_append(hits, F.lit("region-9999")), 1, 7), hits).alias("node_ids"), F.when(n > 6, 6).alias("next_cursor"), odd(6, n > 6, n <= 6).alias("complete")))
    top = grid.groupBy("source_id").agg(F.max("sentence_id").alias("top"), F.count("*").alias("n"))
    page = grid.withColumn("p", F.expr(f"sentence_id div {PAGE}")).groupBy("source_id", "p").agg(F.array_sort(F.collect_list("sentence_id")).alias("ids")).join(top, "source_id")
    start, ended = F.col("p") * PAGE, (F.col("p") + 1) * PAGE > F.col("top")
    first_page = F.col("p") == 0
    reads = full(page.select("source_id", (2000 + F.col("p")).alias("seq"), F.lit("read_source").alias("tool"), F.lit(0).alias("first"), odd(7, F.when(first_page, F.lit(-5)).otherwise(F.col("top")), F.col("top")).alias("last"), F.when(~first_page, start).alias("cursor_sentence"), odd(8, F.when(first_page, 81).otherwise(PAGE), F.lit(PAGE)).alias("limit"),
        odd(9, F.when(first_page, F.slice("ids", 1, F.size("ids") - 1)).otherwise(F.col("ids")), F.col("ids")).alias("sentence_ids"), F.when(~ended, start + PAGE).alias("next_sentence"), odd(10, F.when(first_page, ~ended).otherwise(ended), ended).alias("complete")))
    calls = browse.unionByName(search).unionByName(reads).filter(~((F.col("trace") % 17 == 11) & (F.col("seq") == 1000)) & ~((F.col("trace") % 17 == 12) & (F.col("seq") == 0)))
    traces = top.select(F.col("source_id").alias("trace"), "source_id", odd(13, F.lit(COLD), F.lit("author")).alias("role"), odd(14, F.array(F.col("n") + 7), odd(15, F.array().cast("array<long>"), odd(16, null("array<long>"), F.array(F.lit(0).cast("long"))))).alias("retained"))
    return calls, traces, nodes, grid


QUERIES = {"v16_inspection": lambda s, d: inspection_violations(*_trace(s, d))}
ORACLES = {
    # what each fault breaks; sources have one section, whose call is that of seq 1
    "v16_inspection": f"""{_REGIONS}, s AS (SELECT source_id AS t, source_id % 17 AS o, count(*) AS n, max(region) AS r FROM k GROUP BY 1), sec AS (SELECT t, o, unnest(range(0, r // 8 + 2)) AS i, r // 8 + 1 AS top FROM s)
SELECT t AS trace, 1 AS seq, 'browse_cursor' AS rule FROM s WHERE o = 1 UNION ALL SELECT t, i, 'browse_page' FROM sec WHERE o = 2 UNION ALL SELECT t, i, 'browse_next' FROM sec WHERE o = 3
UNION ALL SELECT t, 1000, 'search' FROM s WHERE o IN (4, 5) UNION ALL SELECT t, 1000, 'search_next' FROM s WHERE o = 6 UNION ALL SELECT t, 2000, 'read_range' FROM s WHERE o IN (7, 8) UNION ALL SELECT t, 2000, 'read_page' FROM s WHERE o IN (9, 10)
UNION ALL SELECT t, NULL, 'no_search' FROM s WHERE o = 11 UNION ALL SELECT t, i, 'browse_cursor' FROM sec WHERE o = 12 AND i > 0 UNION ALL SELECT t, NULL, 'browse_incomplete' FROM s WHERE o = 12
UNION ALL SELECT t, i, 'tool' FROM sec WHERE o = 13 UNION ALL SELECT t, 1000, 'tool' FROM s WHERE o = 13 UNION ALL SELECT t, NULL, 'retained' FROM s WHERE o IN (14, 15)""",
}
