"""Quality rules with thresholds that adapt to each language and source.

Every document is measured (all of it) with built-in functions. Per (lang, source) and measure a quantile
sketch is kept: counts of integer buckets, exact below 512 and within 1/256 above, so a sketch has a bounded number of buckets, sketches merge by adding
counts, and two engines agree exactly. A group's quartiles are blended with those of all documents by counts (PRIOR documents' worth of the whole), so small groups
lean on the whole without a switch. A document fails when a measure lies beyond its group's upper quartile by more than SPREAD times the distance from the median to
that quartile, a tenth of the median and a slack; length of words and share of marks are bounded below in the same way. The joined thresholds are a row for each group.

A null text has no words; a null lang or source is a group value of its own; rows with equal doc_id are judged each; an empty table gives
an empty result; other columns are kept by measure() and judge(), except that those named like a measure are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.llm.common import let, materialise, table, workspace

#: measures in thousandths: characters of words, marks and symbols of characters, repeats of words, repeated lines of lines
MEASURES = {
    "word_length": ("word_chars", "n_words"), "marks": ("n_marks", "word_chars"), "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
}
#: measures that may also be too low
BOTH_TAILS = ("word_length", "marks")
#: thousandths that any group may go beyond its fence by
SLACK = {"word_length": 0, "marks": 10, "symbols": 20, "repeats": 100, "dup_lines": 300}
SPREAD, PRIOR = 6, 50
SPACES = (" ", "\n", "\t", "\r", "\x0b", "\x0c")


def repeat_words(w: Column) -> Column:
    """Words covered by the five-word windows that an array of words holds twice or more."""
    hashed = F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)])))

    def covered(places: Column) -> Column:
        """Of sorted starts of windows: each covers what lies before the next one, five words at most."""
        steps = F.transform(places, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(places, i + 1) - x, F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def again(pairs: Column) -> Column:
        """Of sorted (hash, start) those whose hash a neighbour has too."""
        same = lambda i, j: F.coalesce(F.get(pairs, i)["g"] == F.get(pairs, j)["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(pairs, lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"]))

    def of(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(g) > F.size(F.array_distinct(g)), let(let(pairs, again), covered))

    return F.coalesce(let(hashed, of), F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_marks, n_dup_lines, n_lines (with a word), n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, text)
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count = lambda signs: F.regexp_count(text, F.lit(signs)).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    found = docs.select(*kept, by_word.alias("__w"), by_line.alias("__l"), F.length(bare).cast("long").alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"), count("[.,;:!?]").alias("n_marks"))
    out = found.select(*kept, "__w.n_words", "word_chars", "n_symbols", "n_marks", "__l.n_dup_lines", "__l.n_lines", "__w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed")


def value(name: str) -> Column:
    a, b = MEASURES[name]
    return F.expr(f"1000 * {a} div greatest(1, {b})")


#: the bucket of v, in both engines: the nine leading bits
BUCKET_SQL = "(({v} >> greatest(0, length(bin({v})) - 9)) << greatest(0, length(bin({v})) - 9))"


def sketches(measured: DataFrame) -> DataFrame:
    """Counts of (lang, source, measure, bucket): partial counts add up, so sketches of parts merge into that of the whole."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), value(m).alias("v")) for m in MEASURES])).alias("x")
    bits = F.greatest(F.lit(0), F.length(F.bin("v")) - 9)
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), bits), bits).alias("bucket")
    return measured.select("lang", "source", each).select("lang", "source", "x.measure", "x.v").groupBy("lang", "source", "measure", bucket).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of each (keys, measure), and the number of documents. A window holds the buckets of a sketch, not documents."""
    by = Window.partitionBy(*keys, "measure")
    placed = sketch.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "docs": F.sum("n").over(by)})
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bucket")))
    return placed.groupBy(*keys, "measure").agg(at(1).alias("p25"), at(2).alias("p50"), at(3).alias("p75"), F.first("docs").alias("docs"))


def thresholds(measured: DataFrame, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """A row for each (lang, source): the most that each measure may be, and the least of those with two tails."""
    sketch = sketches(measured)
    every = quantiles(sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n")), []).select("measure", *[F.col(f"p{k}").alias(f"a{k}") for k in (25, 50, 75)])
    own = quantiles(sketch, ["lang", "source"]).join(F.broadcast(every), "measure")  # a row for each measure
    p25, p50, p75 = (F.expr(f"(p{k} * docs + a{k} * {prior}) div (docs + {prior})") for k in (25, 50, 75))
    slack = F.element_at(F.create_map(*[F.lit(x) for item in SLACK.items() for x in item]), F.col("measure"))
    blended = own.select("lang", "source", "measure", p25.alias("p25"), p50.alias("p50"), p75.alias("p75"), slack.alias("slack"))
    most = F.expr(f"p75 + {spread} * (p75 - p50) + p50 div 10 + slack")
    least = F.expr(f"p25 - {spread} * (p50 - p25) - p50 div 10 - slack")
    of = lambda m, limit: F.max(F.when(F.col("measure") == m, limit))
    return blended.groupBy("lang", "source").agg(*[of(m, most).alias(f"most_{m}") for m in MEASURES], *[of(m, least).alias(f"least_{m}") for m in BOTH_TAILS])


def judge(measured: DataFrame) -> DataFrame:
    """measured with kept. It reads measured twice: write it first where measuring is dear."""
    limits = thresholds(measured)
    mine = limits.select(F.struct("*").alias("__limits"))
    same = F.col("lang").eqNullSafe(F.col("__limits.lang")) & F.col("source").eqNullSafe(F.col("__limits.source"))
    joined = measured.join(mine, same, "left")  # every group has a row
    bad = [value(m) > F.col(f"__limits.most_{m}") for m in MEASURES] + [value(m) < F.col(f"__limits.least_{m}") for m in BOTH_TAILS]
    return joined.select(*[F.col(f"`{c}`") for c in measured.columns if c != "kept"], (~(F.col("base_failed") | reduce(lambda a, b: a | b, bad))).alias("kept"))


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = materialise(measure(docs).drop("text"), workspace(spark), "measured")
    return judge(measured).select(*DIGEST)


_V = {k: f"(1000 * {a} // greatest(1, {b}))" for k, (a, b) in MEASURES.items()}
_BLEND = ", ".join(f"((p{k} * docs + a{k} * {PRIOR}) // (docs + {PRIOR}))::BIGINT AS p{k}" for k in (25, 50, 75))
_AT = ", ".join("min(bucket) FILTER (4 * upto >= {i} * docs) AS {p}{k}".replace("{i}", str(i)).replace("{k}", str(k)) for i, k in ((1, 25), (2, 50), (3, 75)))
#: sketches and thresholds over a table m of measured documents; gives judged
JUDGE_SQL = f"""
x AS (SELECT lang, source, u.measure, {BUCKET_SQL.format(v="u.v")} AS bucket FROM m, LATERAL (VALUES {", ".join(f"('{k}', {v})" for k, v in _V.items())}) AS u(measure, v)),
s AS (SELECT lang, source, measure, bucket, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS docs FROM s),
q AS (SELECT lang, source, measure, {_AT.replace("{p}", "p")}, min(docs) AS docs FROM g GROUP BY ALL),
ag AS (SELECT measure, bucket, sum(sum(n)) OVER (PARTITION BY measure ORDER BY bucket) AS upto, sum(sum(n)) OVER (PARTITION BY measure) AS docs FROM s GROUP BY measure, bucket),
aq AS (SELECT measure, {_AT.replace("{p}", "a")} FROM ag GROUP BY measure),
bl AS (SELECT lang, source, q.measure, {_BLEND}, CASE q.measure {" ".join(f"WHEN '{k}' THEN {v}" for k, v in SLACK.items())} END AS slack FROM q JOIN aq ON q.measure = aq.measure),
lim AS (SELECT lang, source, measure, p75 + {SPREAD} * (p75 - p50) + p50 // 10 + slack AS most, p25 - {SPREAD} * (p50 - p25) - p50 // 10 - slack AS least FROM bl),
w AS (SELECT lang, source, {", ".join(f"max(most) FILTER (measure = '{k}') AS most_{k}, max(least) FILTER (measure = '{k}') AS least_{k}" for k in MEASURES)} FROM lim GROUP BY lang, source),
judged AS (SELECT m.*, NOT (base_failed {" ".join(f"OR {v} > most_{k}" for k, v in _V.items())} {" ".join(f"OR {_V[k]} < least_{k}" for k in BOTH_TAILS)}) AS kept
  FROM m JOIN w ON m.lang IS NOT DISTINCT FROM w.lang AND m.source IS NOT DISTINCT FROM w.source)
"""
#: documents d (doc_id, text, lang, source) to measured documents m
MEASURE_SQL = r"""
b AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM d),
ws AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM b),
gr AS (SELECT rid, i, hash(words[i:i+4]) AS h FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM ws WHERE len(words) >= 5)),
rp AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY rid, h) AS c FROM gr) WHERE c > 1),
rw AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM rp GROUP BY rid),
mm AS (SELECT b.doc_id, b.lang, b.source, b.rid, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^.,;:!?]', '', 'g'))::BIGINT AS n_marks, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM b JOIN ws USING (rid) LEFT JOIN rw USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM mm),
"""
ORACLE_SQL = f"WITH d AS (SELECT doc_id, text, lang, source FROM documents), {MEASURE_SQL} {JUDGE_SQL} SELECT {', '.join(DIGEST)} FROM judged"
