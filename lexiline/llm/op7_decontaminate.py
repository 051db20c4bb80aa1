"""Benchmark decontamination by winnowing, with built-in functions only.

Words are lower-cased runs of letters and digits. Of each window of ten words the least hash of its five-word
grams is kept, on both sides, so every span of ten words that a document shares with an item leaves an equal fingerprint in
both. Fingerprints are joined (the benchmark's are broadcast only while their counted number is at most BROADCAST_ROWS, as are the ids of
documents with hits while there are at most BROADCAST_IDS; beyond, joins shuffle). In documents that have hits, the places of the fingerprints found are extended to the ten-word windows
around them whose least gram they are, and these windows alone are compared, word for word, with the items' windows of that fingerprint. Items of
fewer words are one window, and documents get fingerprints of those lengths too.

Null text has no words; a null doc_id is kept as a document of its own; rows with equal doc_id are one row each and share
their hits; items with equal text all count, rows with an equal item_id count once, a null item_id is not counted; empty
tables give no rows or no hits. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline.llm.common import drop, let, materialise, table, workspace

WINDOW, GRAM = 10, 5
BROADCAST_ROWS, BROADCAST_IDS = 200_000, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(w: Column) -> Column:
    return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))


def words(text: Column) -> Column:
    cut = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.transform(F.filter(cut, lambda w: w != ""), ascii_lower)


def gram_hashes(h: Column, k: int) -> Column:
    """A hash of each k neighbours of an array of hashes."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)]))
    return F.when(F.size(h) >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def winnowed(g: Column) -> Column:
    """The different least hashes of all windows of WINDOW words, from the hashes of their grams."""
    span = WINDOW - GRAM + 1
    least = F.transform(F.sequence(F.lit(1), F.size(g) - (span - 1)), lambda j: F.array_min(F.slice(g, j, span)))
    return F.when(F.size(g) >= span, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(w: Column, lengths: list[int]) -> Column:
    """Winnowed fingerprints of an array of words, and hashes of all its runs of the given lengths below WINDOW."""

    def of(h: Column) -> Column:
        out = let(gram_hashes(h, GRAM), winnowed)
        for m in lengths:
            out = F.array_union(out, gram_hashes(h, m))
        return out

    return let(word_hashes(w), of)


def places(w: Column, length: int) -> Column:
    """Structs (i, fp) of each run of `length` words: its place and its fingerprint, which is the least hash of its grams, or below WINDOW words its own hash."""

    def of(g: Column) -> Column:
        span = WINDOW - GRAM + 1 if length == WINDOW else 1
        each = F.transform(F.sequence(F.lit(0), F.size(g) - span), lambda i: F.struct(i.alias("i"), F.array_min(F.slice(g, i + 1, span)).alias("fp")))
        return F.when(F.size(g) >= span, each)

    return let(let(word_hashes(w), lambda h: gram_hashes(h, GRAM if length == WINDOW else length)), of)


def extended(w: Column, found: Column, length: int | Column) -> Column:
    """Structs (i, fp, window) of the runs of `length` words at the places found."""
    inside = F.filter(found, lambda x: x["i"] + length <= F.size(w))
    return F.transform(inside, lambda x: F.struct(x["i"].alias("i"), x["fp"].alias("fp"), F.array_join(F.slice(w, x["i"] + 1, length), " ").alias("window")))


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    place = workspace(docs.sparkSession)
    items = materialise(benchmark.select("item_id", words(F.col("text")).alias("w")), place, "items").withColumn("n", F.size("w")).filter("n > 0")
    short = sorted(r["n"] for r in items.filter(F.col("n") < WINDOW).select("n").distinct().collect())  # nine at most
    lengths = [*short, WINDOW]
    of = lambda m: items.filter((F.col("n") == m) if m < WINDOW else (F.col("n") >= m))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    whole = lambda m: let(places(F.col("w"), m), lambda p: extended(F.col("w"), p, m))
    each = [of(m).select("item_id", F.explode(whole(m)).alias("x")).select("item_id", F.lit(m).alias("m"), "x.fp", "x.window") for m in lengths]
    test_windows = materialise(union(each).distinct(), place, "test-windows")
    test_fps = materialise(test_windows.select("fp").distinct().withColumn("found", F.lit(1)), place, "test-fps")

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nameless = own.filter("doc_id is null")
    own = own.withColumn("nth", F.lit(None).cast("long"))
    if not nameless.isEmpty():  # numbered once, as numbers are made anew with each reading
        own = own.filter("doc_id is not null").unionByName(materialise(nameless.withColumn("nth", F.monotonically_increasing_id()), place, "nameless"))
    own = own.withColumn("row", F.monotonically_increasing_id())
    same = lambda a: F.col("doc_id").eqNullSafe(F.col(f"{a}id")) & F.col("nth").eqNullSafe(F.col(f"{a}nth"))
    counted = own.select("doc_id", "nth", "row", let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), fingerprints(w, short).alias("fps"))).alias("r"))
    test_fps = small(test_fps, test_fps.count())
    prints = counted.select("doc_id", "nth", "row", F.col("r.n").alias("n_words"), F.explode_outer("r.fps").alias("fp")).join(test_fps, "fp", "left")
    # the prints of a row are in one task, which sums them before the shuffle
    base = materialise(prints.groupBy("row", "doc_id", "nth", "n_words").agg(F.max("found").alias("found")), place, "base")

    hit_ids = base.filter("found = 1").select(F.col("doc_id").alias("__id"), F.col("nth").alias("__nth")).distinct()
    hit_ids = small(hit_ids, hit_ids.count(), BROADCAST_IDS)
    hit_docs = own.select("doc_id", "nth", "text").join(hit_ids, same("__"), "left_semi")
    # numbered by what is written, so that places and texts stay together
    hit_docs = materialise(hit_docs.select("doc_id", "nth", words(F.col("text")).alias("w")).withColumn("at", F.monotonically_increasing_id()), place, "hit-docs")
    near = union([hit_docs.select("at", F.explode(places(F.col("w"), m)).alias("x")).select("at", F.lit(m).alias("m"), "x.i", "x.fp") for m in lengths])
    near = near.join(test_fps, "fp", "left_semi").groupBy("at", "m").agg(F.collect_list(F.struct("i", "fp")).alias("found"))
    near = materialise(near, place, "places")
    found = hit_docs.join(near, "at").select("doc_id", "nth", "m", F.explode(extended(F.col("w"), F.col("found"), F.col("m"))).alias("x")).select("doc_id", "nth", "m", "x.i", "x.fp", "x.window")
    n_test, same_run = test_windows.count(), ["fp", "m", "window"]
    hits = materialise(found.join(small(test_windows.select(same_run).distinct(), n_test), same_run, "left_semi"), place, "hits")
    # covered words: spans in order, each from where the last one ended
    spans = F.array_sort(F.collect_set(F.struct("i", (F.col("i") + F.col("m")).alias("e"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    join = lambda a, s: F.struct(F.greatest(a["end"], s["e"]).alias("end"), (a["total"] + F.greatest(F.lit(0), s["e"] - F.greatest(a["end"], s["i"]))).alias("total"))
    covered = hits.groupBy("doc_id", "nth").agg(spans.alias("spans")).select("doc_id", "nth", F.aggregate("spans", start, join, lambda a: a["total"]).cast("long").alias("n_hit"))
    pairs = hits.select("doc_id", "nth", *same_run).distinct().join(small(test_windows, n_test), same_run).filter("item_id is not null").select("doc_id", "nth", F.col("item_id").cast("string").alias("item")).distinct()
    listed = pairs.groupBy("doc_id", "nth").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = covered.join(listed.withColumnsRenamed({"doc_id": "__id", "nth": "__nth"}), same("__"), "left").select(F.col("doc_id").alias("hit_id"), F.col("nth").alias("hit_nth"), "n_hit", "items")
    names = F.coalesce("items", F.array().cast("array<string>"))
    out = base.join(hit, same("hit_"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    out = materialise(out, workspace(docs.sparkSession), "contamination")
    drop(place, docs.sparkSession, "")
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def contamination_sql(docs: str, benchmark: str = "benchmark") -> str:
    """CTEs from docs (doc_id, text) to contamination (the columns of decontaminate)."""
    cut = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
iw AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {cut} AS w FROM {benchmark}) WHERE len(w) > 0),
tw AS (SELECT DISTINCT item_id, least(n, 10) AS m, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(n - 10, 0) + 2)) AS i FROM iw)),
dw AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {cut} AS w FROM {docs})),
ms AS (SELECT DISTINCT m FROM tw),
wx AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT dw.*, ms.m, unnest(range(1, n - m + 2)) AS i FROM dw, ms WHERE n >= m)),
ht AS (SELECT doc_id, i, wx.m, item_id FROM wx JOIN tw ON wx.win = tw.win AND wx.m = tw.m),
cv AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM ht) GROUP BY doc_id),
ls AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM ht) GROUP BY doc_id),
contamination AS (SELECT dw.doc_id, n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM dw LEFT JOIN cv USING (doc_id) LEFT JOIN ls USING (doc_id))
"""


ORACLE_SQL = f"WITH {contamination_sql('documents')} SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM contamination"
