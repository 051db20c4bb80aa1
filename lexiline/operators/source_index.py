"""The index of a source: an episode of sections of regions of sentences, each node with keywords, a preview and a unit vector; and its check.

Both work level by level from below. Counts of words add up from regions to sections to the episode, vectors are means of those of the children weighted by
sentences, and previews look up three sentences of a node by place, so no level reads all sentences again. What is gathered into one row are a node's children and keywords.

Texts and vectors of sentences travel once, to the tasks of their source (so many that each has some bytes of text): all counts and means are made there, and neither words nor components are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.functions.text import strip
from lexiline.operators import inventory
from lexiline.operators.inventory import SECTION_REGIONS, hierarchy_of
from lexiline.operators.retrieval import _TOK, tokens
from lexiline.operators.segment import GRID_SQL, placed_regions, sentence_grid
from lexiline.plans.ordered import as_of
from lexiline.plans.shared import stored
from lexiline.sources.timeline import by_source, table, text_tasks, words

# fixed values: words of a node, characters of each part of a preview and what stands between parts, how far norms and means of vectors may be off
KEYWORDS, PREVIEW_CHARS, BETWEEN = 10, 240, " … "
UNIT_OFF, MEAN_OFF = 1e-4, 1e-6
NODES = ["source_id", "id", "kind", "parent", "ordinal", "place", "child_ids", "first_sentence", "last_sentence", "start_ms", "end_ms", "sentences", "keywords", "preview", "embedding"]
#: the level above the place of a region, for each kind of node
UP = {"region": "at", "section": f"at div {SECTION_REGIONS}", "episode": "0"}


def _levels(regions: DataFrame) -> DataFrame:
    """(kind, at) in place of the place `at` of each region: a row for each level, with the region's own as `leaf`."""
    up = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(e).cast("long").alias("at")) for k, e in UP.items()])
    return regions.withColumn("x", F.explode(up)).withColumn("leaf", F.col("at")).drop("at").select("*", "x.kind", "x.at").drop("x")


def _placed(sentences: DataFrame) -> DataFrame:
    return sentences.select("source_id", "sentence_id", "start_ms", "end_ms", "text", (F.row_number().over(by_source("sentence_id")) - 1).alias("k"))


def _keywords(leaves: DataFrame) -> DataFrame:
    """(source_id, kind, at, keywords) of sentences (source_id, at, text) of regions. Where these are dealt by source, nothing is shuffled."""
    n = leaves.select("source_id", "at", F.explode(tokens(F.col("text"))).alias("word")).groupBy("source_id", "at", "word").agg(F.count("*").alias("n"))
    all_ = _levels(n).groupBy("source_id", "kind", "at", "word").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("source_id", "kind", "at").orderBy(F.desc("n"), "word"))
    top = all_.withColumn("rank", best).filter(F.col("rank") <= KEYWORDS)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    return top.groupBy("source_id", "kind", "at").agg(listed.alias("keywords"))


def _previews(ranges: DataFrame, placed: DataFrame) -> DataFrame:
    """(source_id, kind, at, preview) of ranges (source_id, kind, at, lo, hi) of places."""
    n = F.col("hi") - F.col("lo") + 1
    three = F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 2).cast("long"), (n - 1).cast("long")))
    wanted = ranges.select("source_id", "kind", "at", "lo", F.posexplode(three).alias("j", "off")).withColumn("k", F.col("lo") + F.col("off"))
    met = wanted.join(placed.select("source_id", "k", F.substring(strip("text"), 1, PREVIEW_CHARS).alias("part")), ["source_id", "k"])
    return met.groupBy("source_id", "kind", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "part"))), lambda x: x["part"]), BETWEEN).alias("preview"))


def _means(children: DataFrame) -> DataFrame:
    """(source_id, at, embedding): unit vectors of weighted means of children (source_id, at, vec, weight); none where the mean is of no length. Where children are dealt by source, nothing is shuffled."""
    x = F.col("x").cast("double")
    d = children.select("source_id", "at", "weight", F.posexplode("vec").alias("dim", "x")).groupBy("source_id", "at", "dim").agg((F.sum(x * F.col("weight")) / F.sum("weight")).alias("m"))
    ms = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda v: v["m"])
    v = d.groupBy("source_id", "at").agg(ms.alias("ms")).withColumn("length", F.sqrt(F.aggregate("ms", F.lit(0.0), lambda a, m: a + F.coalesce(m * m, F.lit(0.0)))))
    return v.filter("length > 0 and not isnan(length)").select("source_id", "at", F.transform("ms", lambda m: m / F.col("length")).alias("embedding"))


def source_index(grid: DataFrame, unit_vectors: DataFrame) -> DataFrame:
    """The nodes of each source (NODES) from sentences (source_id, sentence_id, start_ms, end_ms, text) and vectors of their parts (source_id, sentence_id, vec): regions of bounded
    size, sections of eight regions, the episode. A source whose vectors have a mean of no length has nodes without one."""
    tasks = text_tasks(grid, "text")
    placed = stored(placed_regions(grid, tasks), "placed").withColumn("at", F.col("region"))
    spans = placed.groupBy("source_id", "at").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    ranges = _levels(spans).groupBy("source_id", "kind", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # regions come to the vectors of sentences within the tasks of a source
    at = placed.select("source_id", "sentence_id", "at").repartition(tasks, "source_id")
    parts = as_of(unit_vectors.select("source_id", "sentence_id", "vec").repartition(tasks, "source_id"), at, ["source_id"], "sentence_id", "sentence_id", ["at"])
    parts = parts.filter("right_sentence_id = sentence_id").select("source_id", F.col("right_at").alias("at"), "vec", F.lit(1).alias("weight"))
    region_vectors = stored(_means(parts), "regions")
    sized = spans.select("source_id", "at", (F.col("hi") - F.col("lo") + 1).alias("weight"))
    section_children = region_vectors.join(sized, ["source_id", "at"]).select("source_id", F.expr(UP["section"]).alias("at"), F.col("embedding").alias("vec"), "weight")
    section_vectors = _means(section_children.repartition(tasks, "source_id"))
    weights = sized.groupBy("source_id", F.expr(UP["section"]).alias("at")).agg(F.sum("weight").alias("weight"))
    episode_vectors = _means(section_vectors.join(weights, ["source_id", "at"]).select("source_id", F.lit(0).cast("long").alias("at"), F.col("embedding").alias("vec"), "weight").repartition(tasks, "source_id"))
    vectors = None
    for kind, v in (("region", region_vectors), ("section", section_vectors), ("episode", episode_vectors)):
        v = v.select("source_id", F.lit(kind).alias("kind"), F.col("at").cast("long").alias("at"), "embedding")
        vectors = v if vectors is None else vectors.unionByName(v)
    h = hierarchy_of(placed).withColumn("at", F.col("ordinal"))
    sections = h.filter("kind = 'section'").groupBy("source_id").agg(F.count("*").alias("n_sections"))
    children = h.filter("parent is not null").groupBy("source_id", F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("child_ids"))
    place = F.when(F.col("kind") == "episode", 0).when(F.col("kind") == "section", 1 + F.col("at")).otherwise(1 + F.col("n_sections") + F.col("at"))
    key = ["source_id", "kind", "at"]
    words_of = _keywords(placed.select("source_id", "at", "text").repartition(tasks, "source_id"))
    out = h.drop("children").join(sections, "source_id").join(children, ["source_id", "id"], "left").join(words_of, key, "left").join(_previews(ranges, placed), key, "left").join(vectors, key, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"place": place.cast("long"), "child_ids": F.coalesce("child_ids", none), "keywords": F.coalesce("keywords", none)}).select(*NODES)


def source_index_violations(nodes: DataFrame, sentences: DataFrame) -> DataFrame:
    """V5: (source_id, id, rule) of nodes (NODES; place: where a node stands in its index) over the sentences they claim.

    duplicate, order, name, ordinal, parent, children; unknown, partition (a region doesn't go on where the one before it ends), coverage (the last one doesn't reach the end), count,
    span (first and last sentence of a node above regions), times, keywords, preview; vector (no unit vector of finite numbers), mean (not the mean of the children's). A source without an
    episode, a section or a region is incomplete (id null). Each level is held against the one below as it is stated there, so words of a node above regions are those that its regions own."""
    rank = F.when(F.col("kind") == "episode", 0).when(F.col("kind") == "section", 1).otherwise(2)
    of_kind, of_source = Window.partitionBy("source_id", "kind").orderBy("place"), Window.partitionBy("source_id").orderBy("place")
    tasks = text_tasks(sentences, "text")
    at = (F.row_number().over(of_kind) - 1).cast("long")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    whole = F.coalesce((F.abs(length - 1) <= F.greatest(F.lit(UNIT_OFF), UNIT_OFF * length)) & (F.size("embedding") > 0) & ~F.isnan(length), F.lit(False))
    n = nodes.withColumn("whole", whole).drop("embedding").repartition(tasks, "source_id").withColumns({"at": at, "rank": rank, "same": F.count("*").over(Window.partitionBy("source_id", "id"))})
    n = n.withColumn("before", F.lag("rank").over(of_source))
    placed = stored(_placed(sentences.repartition(tasks, "source_id")), "placed")
    total = placed.groupBy("source_id").agg(F.max("k").alias("top"))
    find = lambda c, k: placed.select("source_id", F.col("sentence_id").alias(c), F.col("k").alias(k))
    regions = n.filter("kind = 'region'").join(find("first_sentence", "lo"), ["source_id", "first_sentence"], "left").join(find("last_sentence", "hi"), ["source_id", "last_sentence"], "left")
    chain = Window.partitionBy("source_id").orderBy("at")
    regions = regions.join(total, "source_id", "left").withColumns({"ended": F.lag("hi", 1, -1).over(chain), "next": F.lead("id").over(chain)})
    # what each level should be, from the regions as stated
    spans = regions.filter("lo <= hi").select("source_id", "at", "lo", "hi", F.col("sentences").alias("weight"))
    ranges = _levels(spans).groupBy("source_id", "kind", "at").agg(F.min_by("lo", "leaf").alias("lo"), F.max_by("hi", "leaf").alias("hi"))
    claims = spans.select("source_id", "at", "lo", "hi").repartition(tasks, "source_id").select("source_id", "at", F.explode(F.sequence("lo", "hi")).alias("k"))
    leaves = as_of(claims, placed.select("source_id", "k", "text").repartition(tasks, "source_id"), ["source_id"], "k", "k", ["text"]).filter("right_k = k").select("source_id", "at", F.col("right_text").alias("text"))
    ends = lambda c, *values: placed.select("source_id", F.col("k").alias(c), *[F.col(v).alias(f"own_{v}" if v != "sentence_id" else f"own_{c}") for v in values])
    key = ["source_id", "kind", "at"]
    none = F.array().cast("array<string>")
    should = ranges.join(ends("lo", "sentence_id", "start_ms"), ["source_id", "lo"]).join(ends("hi", "sentence_id", "end_ms"), ["source_id", "hi"])
    should = should.join(_keywords(leaves).withColumnRenamed("keywords", "own_keywords"), key, "left").join(_previews(ranges, placed).withColumnRenamed("preview", "own_preview"), key, "left")
    ids = n.filter("kind <> 'episode'").select("source_id", F.when(F.col("kind") == "region", "section").otherwise("episode").alias("kind"), F.when(F.col("kind") == "region", F.expr(UP["section"])).otherwise(0).cast("long").alias("at"), F.struct(F.col("at").alias("p"), "id").alias("child"))
    children = ids.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("child")), lambda x: x["id"]).alias("own_children"))
    j = n.join(should, key, "left").join(children, key, "left")
    name = F.when(F.col("kind") == "episode", "episode").otherwise(F.format_string("%s-%04d", "kind", F.col("at") + 1))
    parent = F.when(F.col("kind") == "section", "episode").when(F.col("kind") == "region", F.format_string("section-%04d", F.expr(UP["section"]) + 1))
    known = F.col("lo").isNotNull()
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    rules = {
        "duplicate": F.col("same") > 1, "order": (F.col("rank") < F.col("before")) | (F.col("rank") == 0) & (F.col("before") == 0), "name": ~F.col("id").eqNullSafe(name), "ordinal": ~F.col("ordinal").eqNullSafe(F.col("at")),
        "parent": ~F.col("parent").eqNullSafe(parent), "children": ~F.coalesce("child_ids", none).eqNullSafe(F.coalesce("own_children", none)), "count": known & ~F.col("sentences").eqNullSafe(F.col("hi") - F.col("lo") + 1),
        "span": known & (F.col("kind") != "region") & (differs("first_sentence", "own_lo") | differs("last_sentence", "own_hi")), "times": known & (differs("start_ms", "own_start_ms") | differs("end_ms", "own_end_ms")),
        "keywords": known & ~F.coalesce("keywords", none).eqNullSafe(F.coalesce("own_keywords", none)), "preview": known & differs("preview", "own_preview"),
        "vector": ~F.col("whole"),
    }
    of_regions = {"unknown": F.col("lo").isNull() | F.col("hi").isNull(), "partition": F.coalesce((F.col("lo") != F.col("ended") + 1) | (F.col("hi") < F.col("lo")), F.lit(False)), "coverage": F.col("next").isNull() & ~F.col("hi").eqNullSafe(F.col("top"))}
    found = lambda which: F.explode(F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in which.items()]), lambda x: x.isNotNull())).alias("rule")
    out = j.select("source_id", "id", found(rules)).unionByName(regions.select("source_id", "id", found(of_regions)))
    # means: children as stated
    v = nodes.select("source_id", "kind", "id", "place", "sentences", "embedding").repartition(tasks, "source_id").withColumn("at", at)
    own = lambda kind, up: v.filter(F.col("kind") == kind).select("source_id", up.alias("at"), F.col("embedding").alias("vec"), F.col("sentences").alias("weight"))
    means = _means(own("region", F.expr(UP["section"]))).withColumn("kind", F.lit("section")).unionByName(_means(own("section", F.lit(0).cast("long"))).withColumn("kind", F.lit("episode")))
    stated = v.filter("kind <> 'region'").select(*key, "id", "embedding").join(means.withColumnRenamed("embedding", "mean"), key, "left")
    off = F.exists(F.arrays_zip("embedding", "mean"), lambda x: F.coalesce(F.abs(x["embedding"] - x["mean"]) > MEAN_OFF + MEAN_OFF * F.abs(x["mean"]), F.lit(True)))
    bad = stated.filter(F.coalesce((F.size("embedding") != F.size("mean")) | off, F.lit(True)))
    out = out.unionByName(bad.select("source_id", "id", F.lit("mean").alias("rule")))
    per = total.select("source_id").unionByName(n.select("source_id")).distinct().join(n.groupBy("source_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in UP]), "source_id", "left")
    incomplete = per.filter(" or ".join(f"coalesce({k}, 0) = 0" for k in UP)).select("source_id", F.lit(None).cast("string").alias("id"), F.lit("incomplete").alias("rule"))
    return out.unionByName(incomplete)


# ---- queries -------------------------------------------------------------------------------------------------

def _index(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    grid = stored(sentence_grid(words(s, d)).select("source_id", "sentence_id", "start_ms", "end_ms", "text"), "grid")
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vec"))
    parts = grid.select("source_id", "sentence_id", ((F.col("source_id") * 7 + F.col("sentence_id")) % 500).alias("v")).join(vectors, "v").drop("v")
    return grid, source_index(grid, parts)


def e6_source_index(s: SparkSession, d: str) -> DataFrame:
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return _index(s, d)[1].select("source_id", "id", "kind", "parent", "ordinal", "place", F.array_join("child_ids", ",").alias("child_ids"), "first_sentence", "last_sentence", "start_ms", "end_ms", "sentences", F.array_join("keywords", " ").alias("keywords"), "preview", F.round(weighed, 4).alias("weighed"))


def _marred(nodes: DataFrame) -> DataFrame:
    """An index with faults in some sources: a kind of fault for each remainder; those of 3 are within what a vector may be off."""
    odd = lambda k, kind: (F.col("source_id") % 17 == k) & (F.col("kind") == kind) & (F.col("ordinal") == 0)
    put = lambda k, kind, c, value: {c: F.when(odd(k, kind), value).otherwise(F.col(c))}
    faults = [
        put(0, "section", "child_ids", F.array_append("child_ids", F.lit("region-9999"))), put(1, "region", "preview", F.concat("preview", F.lit("."))), put(2, "section", "embedding", F.transform("embedding", lambda x, i: x + F.when(i == 3, 3e-5).otherwise(0.0))),
        put(3, "episode", "embedding", F.transform("embedding", lambda x: x * (1 + 1e-8))), put(4, "region", "keywords", F.reverse("keywords")), put(5, "episode", "end_ms", F.col("end_ms") + 1), put(6, "section", "sentences", F.col("sentences") + 1),
        put(7, "region", "parent", F.lit("section-0002")), put(8, "region", "id", F.lit("region-1")), put(9, "episode", "embedding", F.transform("embedding", lambda x: x * 1.001)), put(10, "episode", "last_sentence", F.lit(-1).cast("long")), put(11, "section", "ordinal", F.lit(5).cast("long")),
    ]
    for fault in faults:
        nodes = nodes.withColumns(fault)
    return nodes.filter(~((F.col("source_id") % 17 == 13) & (F.col("kind") == "episode")))


def v5_source_index(s: SparkSession, d: str) -> DataFrame:
    grid, nodes = _index(s, d)
    return source_index_violations(stored(_marred(nodes), "nodes"), grid)


QUERIES = {"e6_source_index": e6_source_index, "v5_source_index": v5_source_index}


def _mean_sql(name: str, of: str, at: str) -> str:
    """Unit vectors of means of rows (source_id, c, i, x, w) of a table, by at."""
    return f"""{name}_m AS (SELECT source_id, {at} AS c, i, sum(x * w) / sum(w) AS m FROM {of} GROUP BY ALL), {name} AS (SELECT source_id, c, i, m / sqrt(sum(m * m) OVER (PARTITION BY source_id, c)) AS x FROM {name}_m)"""


_REGIONS = inventory.ORACLES["e6_hierarchy"].partition(", l0 AS")[0]
_ID = "CASE kind WHEN 'episode' THEN 'episode' ELSE printf('%s-%04d', kind, c + 1) END"
ORACLES = {
    "e6_source_index": f"""{_REGIONS}, lv AS (SELECT k.*, g.text, u.kind, u.c FROM k JOIN grid g USING (source_id, sentence_id), LATERAL (VALUES ('region', region), ('section', region // 8), ('episode', 0)) AS u(kind, c)),
nd AS (SELECT source_id, kind, c, min(sentence_id) AS f, max(sentence_id) AS l, count(*) AS n, arg_min(start_ms, sentence_id) AS b, arg_max(end_ms, sentence_id) AS e FROM (SELECT DISTINCT * FROM lv) GROUP BY ALL), ns AS (SELECT source_id, count(*) AS sections FROM nd WHERE kind = 'section' GROUP BY 1),
kn AS (SELECT source_id, kind, c, word, count(*) AS n FROM (SELECT source_id, kind, c, unnest({_TOK('text')}) AS word FROM lv) GROUP BY ALL), kr AS (SELECT *, row_number() OVER (PARTITION BY source_id, kind, c ORDER BY n DESC, word) AS r FROM kn),
kw AS (SELECT source_id, kind, c, string_agg(word, ' ' ORDER BY r) AS keywords FROM kr WHERE r <= {KEYWORDS} GROUP BY ALL), pp AS (SELECT lv.source_id, kind, c, text, row_number() OVER (PARTITION BY lv.source_id, kind, c ORDER BY sentence_id) - 1 AS p, count(*) OVER (PARTITION BY lv.source_id, kind, c) AS n FROM lv),
pv AS (SELECT source_id, kind, c, string_agg(substr(trim(text), 1, {PREVIEW_CHARS}), '{BETWEEN}' ORDER BY p) AS preview FROM pp WHERE p IN (0, n // 2, n - 1) GROUP BY ALL),
ch AS (SELECT source_id, 'section' AS kind, c // 8 AS c, string_agg(printf('region-%04d', c + 1), ',' ORDER BY c) AS ids FROM nd WHERE kind = 'region' GROUP BY ALL UNION ALL SELECT source_id, 'episode', 0, string_agg(printf('section-%04d', c + 1), ',' ORDER BY c) FROM nd WHERE kind = 'section' GROUP BY ALL),
un AS (SELECT k.source_id, region, i, v.embedding[i]::DOUBLE AS x, 1 AS w FROM k JOIN embeddings v ON v.vec_id = (k.source_id * 7 + k.sentence_id) % 500, LATERAL (SELECT unnest(range(1, 65)) AS i)), {_mean_sql("rv", "un", "region")}, rwx AS (SELECT rv.*, n AS w FROM rv JOIN nd ON nd.kind = 'region' AND nd.source_id = rv.source_id AND nd.c = rv.c),
{_mean_sql("sv", "rwx", "c // 8")}, swx AS (SELECT sv.*, n AS w FROM sv JOIN nd ON nd.kind = 'section' AND nd.source_id = sv.source_id AND nd.c = sv.c), {_mean_sql("ev", "swx", "0")},
ve AS (SELECT source_id, kind, c, round(sum(x * i), 4) AS weighed FROM (SELECT 'region' AS kind, * FROM rv UNION ALL SELECT 'section', * FROM sv UNION ALL SELECT 'episode', * FROM ev) GROUP BY ALL)
SELECT source_id, {_ID} AS id, kind, CASE kind WHEN 'region' THEN printf('section-%04d', c // 8 + 1) WHEN 'section' THEN 'episode' END AS parent, c AS ordinal, CASE kind WHEN 'episode' THEN 0 WHEN 'section' THEN 1 + c ELSE 1 + sections + c END AS place, coalesce(ids, '') AS child_ids, f AS first_sentence, l AS last_sentence,
b AS start_ms, e AS end_ms, n AS sentences, coalesce(keywords, '') AS keywords, preview, weighed FROM nd JOIN ns USING (source_id) LEFT JOIN kw USING (source_id, kind, c) LEFT JOIN pv USING (source_id, kind, c) LEFT JOIN ch USING (source_id, kind, c) LEFT JOIN ve USING (source_id, kind, c)""",
    # what each fault breaks; a node that is its parent's only child takes its mean along
    "v5_source_index": f"""{_REGIONS}, s AS (SELECT source_id, source_id % 17 AS o, max(region) < 8 AS single FROM k GROUP BY 1) SELECT source_id, x.id, x.rule FROM s, LATERAL (VALUES (0, 'section-0001', 'children', true), (1, 'region-0001', 'preview', true), (2, 'section-0001', 'mean', true), (2, 'episode', 'mean', single),
(4, 'region-0001', 'keywords', true), (5, 'episode', 'times', true), (6, 'section-0001', 'count', true), (7, 'region-0001', 'parent', true), (8, 'region-1', 'name', true), (8, 'section-0001', 'children', true), (9, 'episode', 'vector', true), (9, 'episode', 'mean', true),
(10, 'episode', 'span', true), (11, 'section-0001', 'ordinal', true), (13, NULL, 'incomplete', true)) AS x(o, id, rule, holds) WHERE x.o = s.o AND x.holds""",
}
