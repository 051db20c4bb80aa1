"""Shot grids, strict logs and playlists as files; the hierarchy of a source; editorial status, attempts in doubt and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.segment import GRID_SQL, region_partition, sentence_grid
from lexiline.plans.shared import shared_folder
from lexiline.sources import files
from lexiline.sources.timeline import WORDS_SQL, table, words

# fixed values: regions of a section, attempts that a report lists, labels of an editorial status
SECTION_REGIONS, LISTED = 8, 50
UNVERIFIED, REJECTED, PASSED, OPEN = "Unverified", "Rejected by text review", "Passed text review", "Needs review"


def hierarchy(grid: DataFrame) -> DataFrame:
    """(source_id, id, kind, parent, ordinal, children, first_sentence, last_sentence, start_ms, end_ms, sentences): regions of bounded size, sections of eight
    regions, and the episode. Keywords, previews and vectors of nodes are keywords(), preview() and pooled_weighted() over the same ranges."""
    return hierarchy_of(region_partition(grid).join(grid.select("source_id", "sentence_id", "start_ms", "end_ms"), ["source_id", "sentence_id"]))


def hierarchy_of(sentences: DataFrame) -> DataFrame:
    """hierarchy() of sentences (source_id, sentence_id, start_ms, end_ms, region)."""
    r = sentences.withColumn("ordinal", F.col("region"))
    regions = r.groupBy("source_id", "ordinal").agg(
        F.min("sentence_id").alias("first_sentence"), F.max("sentence_id").alias("last_sentence"), F.min_by("start_ms", "sentence_id").alias("start_ms"), F.max_by("end_ms", "sentence_id").alias("end_ms"), F.count("*").alias("sentences"), F.lit(0).cast("long").alias("children"),
    )
    up = lambda df, ordinal: df.withColumn("at", F.col("ordinal")).withColumn("ordinal", ordinal).groupBy("source_id", "ordinal").agg(
        F.min("first_sentence").alias("first_sentence"), F.max("last_sentence").alias("last_sentence"), F.min_by("start_ms", "at").alias("start_ms"), F.max_by("end_ms", "at").alias("end_ms"), F.sum("sentences").alias("sentences"), F.count("*").alias("children"),
    )
    sections = up(regions, F.expr(f"ordinal div {SECTION_REGIONS}"))
    episode = up(sections, F.lit(0).cast("long"))
    name = lambda kind, at: F.format_string(f"{kind}-%04d", at + 1)
    named = lambda df, kind, ident, parent: df.select("source_id", ident.alias("id"), F.lit(kind).alias("kind"), parent.alias("parent"), "ordinal", "children", "first_sentence", "last_sentence", "start_ms", "end_ms", "sentences")
    return (
        named(regions, "region", name("region", F.col("ordinal")), name("section", F.expr(f"ordinal div {SECTION_REGIONS}")))
        .unionByName(named(sections, "section", name("section", F.col("ordinal")), F.lit("episode")))
        .unionByName(named(episode, "episode", F.lit("episode"), F.lit(None).cast("string")))
    )


def editorial_status(verifier: Column, proposer: Column, status: Column, cold: Column, source: Column) -> Column:
    """The label of a candidate. Reviews (arrays of criteria, null: not made) count where both were made and the verifier is known and isn't the proposer."""
    independent = F.coalesce(verifier != "", F.lit(False)) & ~verifier.eqNullSafe(proposer) & cold.isNotNull() & source.isNotNull()
    all_pass = F.forall(F.concat(cold, source), lambda c: F.coalesce(c == "pass", F.lit(False)))
    return F.when(~independent, UNVERIFIED).when(status == "rejected", REJECTED).when((status == "passed") & all_pass, PASSED).otherwise(OPEN)


def unknown_attempts(attempts: DataFrame, now_s: int, listed: int = LISTED) -> DataFrame:
    """Of each run the oldest attempts (run, id, state, cost_status, created_s, heartbeat_s, finished_s) whose outcome and charge are unknown, with their age; at most so many, as the report has it."""
    doubt = attempts.filter("state = 'outcome_unknown' and cost_status = 'unknown'")
    place = F.row_number().over(Window.partitionBy("run").orderBy("created_s", "id"))
    age = F.lit(now_s) - F.coalesce("finished_s", "heartbeat_s", "created_s")
    return doubt.withColumns({"place": place.cast("long"), "age_s": age}).filter(F.col("place") <= listed).select("run", "id", "place", "age_s")


FACTORS = ("author_identity", "reviewer_identity", "program_identity", "prompt_identity", "schema_identity", "media_identity", "execution_identity")


def comparison_reasons(reports: DataFrame, baseline: int, allowed: tuple[str, ...]) -> DataFrame:
    """(configuration, recording, reason): why reports (configuration, recording, evidence, the factors) of a configuration can't be compared with the baseline's of the same recording."""
    base = reports.filter(F.col("configuration") == baseline)
    left = base.select("recording", F.col("evidence").alias("b_evidence"), *[F.col(f).alias(f"b_{f}") for f in FACTORS])
    other = reports.filter(F.col("configuration") != baseline)
    # each configuration with each recording that any configuration has: as many rows as the report has cells
    cells = other.select("configuration").distinct().join(reports.select("recording").distinct(), F.lit(True))
    j = cells.join(other.withColumn("has", F.lit(True)), ["configuration", "recording"], "left").join(left.withColumn("b_has", F.lit(True)), "recording", "left")
    paired = F.col("has").isNotNull() & F.col("b_has").isNotNull()
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rules = [F.when(~paired, F.lit("unpaired_source")), F.when(paired & ~F.col("evidence").eqNullSafe(F.col("b_evidence")), F.lit("different_source_evidence"))]
    for f in FACTORS:
        unseen = blank(f) | blank(f"b_{f}")
        rules.append(F.when(paired & unseen, F.lit(f"unobserved_factor:{f}")).when(paired & (F.col(f) != F.col(f"b_{f}")) & F.lit(f not in allowed), F.lit(f"changed_fixed_factor:{f}")))
    return j.select("configuration", "recording", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("reason"))


def paired_deltas(reports: DataFrame, baseline: int, metrics: list[str]) -> DataFrame:
    """(configuration, metric, pairs, mean): differences from the baseline over the recordings where both are measured. Their interval is bootstrap_interval()."""
    long = reports.select("configuration", "recording", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select("configuration", "recording", "x.metric", "x.v").filter("v is not null")
    base = long.filter(F.col("configuration") == baseline).select("recording", "metric", F.col("v").alias("b"))
    return long.filter(F.col("configuration") != baseline).join(base, ["recording", "metric"]).groupBy("configuration", "metric").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("v") - F.col("b")), 6).alias("mean"))


# ---- queries -----------------------------------------------------------------------------------------------

def s3_grid(s: SparkSession, d: str) -> DataFrame:
    w = words(s, d).filter("ord % 17 = 5")
    shot = F.struct((F.col("start_ms") / 1000).alias("t"), (F.col("ord") % 11 + 0.25).cast("double").alias("score"))
    g = w.groupBy("source_id").agg(F.array_sort(F.collect_list(shot)).alias("shots")).select("source_id", (F.lit(3.0) + F.col("source_id") % 4).alias("decision_threshold"), "shots")
    path = f"{shared_folder(s)}/grids"
    g.write.json(path)
    return files.read_shot_grid(s, path)


def s5_log(s: SparkSession, d: str) -> DataFrame:
    w = words(s, d).filter("ord % 17 = 5").withColumn("at", F.greatest(F.lit(0), F.col("start_ms") - F.when(F.col("ord") % 13 == 4, 50_000).otherwise(0)))
    line = lambda k, value: F.struct((F.col("ord") * 3 + k).alias("ord"), value.alias("line"))
    lines = F.array(line(0, F.concat(F.lit("[info] n:1 pts_time:"), F.format_string("%d.%03d", F.expr("at div 1000"), F.expr("at % 1000")))), line(1, F.lit("frame ok")), line(2, F.concat(F.lit("lavfi.scd.score="), (F.col("ord") % 11 * 11).cast("string"), F.lit(".25"))))
    x = w.select("source_id", F.explode(lines).alias("x")).select("source_id", "x.ord", "x.line").filter("not (ord % 3 = 2 and ord % 7 = 3) and not (ord % 3 = 0 and ord % 5 = 4)")
    path = f"{shared_folder(s)}/logs"
    files.write_lines(x, path, archive=True)
    return files.shot_log_violations(s, path, archive=True)


#: lines near the end of some playlists: a key, a range that nothing follows, another playlist
ODD_LINES = (("#EXT-X-KEY:METHOD=NONE", "#EXT-X-NOTE", "#EXTINF:1.000,"), ("#EXT-X-NOTE", "#EXT-X-BYTERANGE:5@0", "nested.m3u8"))


def _playlists(s: SparkSession, d: str) -> DataFrame:
    """A playlist for each conversation: objects of five sentences; every fifth range has a start, some lack one, a duration or a map; some have a key, a range left over or another playlist."""
    g = sentence_grid(words(s, d)).select("source_id", "sentence_id", "word_count", "start_ms", "end_ms")
    k, length = F.col("sentence_id"), F.col("word_count") * 100
    inf = F.when(k % 31 != 17, F.concat(F.lit("#EXTINF:"), F.format_string("%d.%03d", F.expr("(end_ms - start_ms) div 1000"), F.expr("(end_ms - start_ms) % 1000")), F.lit(","))).otherwise(F.lit("#EXT-X-NOTE"))
    spans = F.concat(F.lit("#EXT-X-BYTERANGE:"), length.cast("string"), F.when((k % 5 == 0) & (k % 35 != 20), "@0").otherwise(""))
    line = lambda at, value: F.struct((k * 3 + at + 3).alias("ord"), value.alias("line"))
    rows = g.select("source_id", F.explode(F.array(line(0, inf), line(1, spans), line(2, F.concat(F.lit("part"), F.expr("sentence_id div 5").cast("string"), F.lit(".m4s"))))).alias("x")).select("source_id", "x.ord", "x.line")
    top = g.groupBy("source_id").agg(F.max("sentence_id").alias("m"))
    ends = F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.lit("#EXTM3U").alias("line")), F.struct(F.lit(1).cast("long").alias("ord"), F.when(F.col("source_id") % 7 != 3, '#EXT-X-MAP:URI="init.mp4",BYTERANGE="800@0"').otherwise("#EXT-X-NOTE").alias("line")),
                   *[F.struct((F.col("m") * 3 + 6 + i).alias("ord"), F.when(F.col("source_id") % 13 == 5, odd[0]).when(F.col("source_id") % 13 == 6, odd[1]).when(F.col("source_id") % 13 == 7, odd[2]).otherwise("#EXT-X-NOTE").alias("line")) for i, odd in enumerate(ODD_LINES)],
                   F.struct((F.col("m") * 3 + 8).alias("ord"), F.when(F.col("source_id") % 11 != 4, "#EXT-X-ENDLIST").otherwise("#EXT-X-NOTE").alias("line")))
    path = f"{shared_folder(s)}/playlists"
    files.write_lines(rows.unionByName(top.select("source_id", F.explode(ends).alias("x")).select("source_id", "x.ord", "x.line")), path, archive=True)
    return files.read_playlists(s, path, archive=True)


def v13_inventory(s: SparkSession, d: str) -> DataFrame:
    g = sentence_grid(words(s, d))
    sizes = g.groupBy("source_id", F.expr("sentence_id div 5").alias("p")).agg((F.sum("word_count") * 100 - F.when(F.col("p") % 6 == 4, 1).otherwise(0)).alias("size")).filter("p % 9 <> 7").select("source_id", F.concat(F.lit("part"), F.col("p").cast("string"), F.lit(".m4s")).alias("uri"), "size")
    init = g.select("source_id").distinct().select("source_id", F.lit("init.mp4").alias("uri"), (F.lit(799) + F.col("source_id") % 3).alias("size"))
    return files.playlist_violations(_playlists(s, d), sizes.unionByName(init))


def x7_status(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    says = lambda k, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when((F.col("o_custkey") + i * k) % 13 == 0, "fail").otherwise("pass"))
    cold, source = F.when(F.col("o_custkey") % 17 != 5, says(2, 4)), F.when(F.col("o_custkey") % 19 != 6, says(3, 3))
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "rejected").otherwise("open")
    verifier = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("family"), (F.col("o_orderkey") % 3).cast("string")))
    return o.select("o_orderkey", editorial_status(verifier, F.lit("family1"), status, cold, source).alias("status"))


def r14_attempts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    every = lambda m, c: F.when(F.col("o_orderkey") % m == 1, c)
    created = F.col("o_custkey") * 10
    a = o.select((F.col("o_custkey") % 20).alias("run"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "outcome_unknown").otherwise("done").alias("state"), F.when(F.col("o_orderkey") % 3 != 2, "unknown").otherwise("settled").alias("cost_status"), created.alias("created_s"), every(2, created + 5).alias("heartbeat_s"), every(5, created + 9).alias("finished_s"))
    return unknown_attempts(a, 10_000_000)


def _reports(s: SparkSession, d: str) -> DataFrame:
    """Reports of forty recordings; configuration 0 is the baseline."""
    k = F.col("p_partkey")
    factors = [F.when((k + i) % 29 == 3, "").otherwise(F.concat(F.lit(f), F.when(k % 40 == i, (k % 3).cast("string")).otherwise("x"))).alias(f) for i, f in enumerate(FACTORS)]
    p = table(s, d, "part").filter("p_partkey % 97 <> 45")
    return p.select(F.expr("p_partkey div 40").alias("configuration"), (k % 40).alias("recording"), F.when(k % 23 == 7, F.concat(F.lit("e"), k.cast("string"))).otherwise("e").alias("evidence"), *factors, F.when(k % 11 != 3, k % 7 / 8).alias("clean_rate"), (k % 5 / 4).alias("kept_rate"))


QUERIES = {
    "s3_shot_grid": s3_grid, "s5_strict_log": s5_log, "s6_playlist_items": lambda s, d: files.playlist_items(_playlists(s, d)).withColumn("seconds", F.col("seconds").cast("double")), "v13_playlist_inventory": v13_inventory,
    "e6_hierarchy": lambda s, d: hierarchy(sentence_grid(words(s, d))), "x7_editorial_status": x7_status, "r14_unknown_attempts": r14_attempts,
    "g20_comparison_reasons": lambda s, d: comparison_reasons(_reports(s, d), 0, ("author_identity",)), "g20_paired_deltas": lambda s, d: paired_deltas(_reports(s, d), 0, ["clean_rate", "kept_rate"]),
}

_ITEMS = f"""{GRID_SQL}, ln AS (SELECT source_id, sentence_id AS k, sentence_id // 5 AS p, word_count * 100 AS len, (end_ms - start_ms) / 1000 AS sec FROM grid), has AS (SELECT DISTINCT source_id, source_id % 7 <> 3 AS m FROM grid),
it AS (SELECT l.source_id, k + m::INT AS item, 'segment' AS kind, 'part' || p || '.m4s' AS uri, CASE WHEN k % 31 <> 17 THEN sec END AS seconds, CASE WHEN p % 7 <> 4 THEN sum(len) OVER (PARTITION BY l.source_id, p ORDER BY k) - len END AS begin, len AS length, p FROM ln l JOIN has USING (source_id)
UNION ALL SELECT source_id, 0, 'map', 'init.mp4', NULL, 0, 800, -1 FROM has WHERE m
UNION ALL SELECT source_id, max(k) + 1 + any_value(m)::INT, 'segment', 'nested.m3u8', 1, NULL, NULL, -2 FROM ln JOIN has USING (source_id) WHERE source_id % 13 = 7 GROUP BY source_id)"""
_P = "rp AS (SELECT p_partkey // 40 AS configuration, p_partkey % 40 AS recording, CASE WHEN p_partkey % 23 = 7 THEN 'e' || p_partkey ELSE 'e' END AS evidence, " + ", ".join(f"CASE WHEN (p_partkey + {i}) % 29 = 3 THEN '' ELSE '{f}' || CASE WHEN p_partkey % 40 = {i} THEN (p_partkey % 3)::VARCHAR ELSE 'x' END END AS {f}" for i, f in enumerate(FACTORS)) + ", CASE WHEN p_partkey % 11 <> 3 THEN p_partkey % 7 / 8 END AS clean_rate, p_partkey % 5 / 4 AS kept_rate FROM part WHERE p_partkey % 97 <> 45)"
_CHANGED = " ".join(f"UNION ALL SELECT configuration, recording, CASE WHEN {f} = '' OR b_{f} = '' THEN 'unobserved_factor:{f}' ELSE 'changed_fixed_factor:{f}' END FROM pr WHERE {f} = '' OR b_{f} = '' OR {f} <> b_{f} AND {str(f != 'author_identity').lower()}" for f in FACTORS)
ORACLES = {
    "s3_shot_grid": f"WITH {WORDS_SQL} SELECT source_id, start_ms AS time_ms, (ord % 11)::DOUBLE + 0.25 AS score FROM words WHERE ord % 17 = 5 AND ord % 11 + 0.25 >= 3 + source_id % 4",
    "s5_strict_log": f"""WITH {WORDS_SQL}, w AS (SELECT source_id, ord, greatest(0, start_ms - CASE WHEN ord % 13 = 4 THEN 50000 ELSE 0 END) AS t FROM words WHERE ord % 17 = 5),
l AS (SELECT source_id, ord * 3 AS k, t, NULL AS sc FROM w WHERE ord * 3 % 5 <> 4 UNION ALL SELECT source_id, ord * 3 + 1, NULL, NULL FROM w UNION ALL SELECT source_id, ord * 3 + 2, NULL, ord % 11 * 11 + 0.25 FROM w WHERE (ord * 3 + 2) % 7 <> 3),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k) - 1 AS n FROM l), r AS (SELECT *, lag(t) OVER o AS bt, lead(sc) OVER o AS sa FROM n WHERE t IS NOT NULL OR sc IS NOT NULL WINDOW o AS (PARTITION BY source_id ORDER BY n)),
e AS (SELECT *, max(CASE WHEN sa IS NOT NULL THEN t END) OVER (PARTITION BY source_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS te FROM r)
SELECT source_id, n, 'no_score' AS rule FROM e WHERE t IS NOT NULL AND sa IS NULL UNION ALL SELECT source_id, n, 'no_time' FROM e WHERE sc IS NOT NULL AND bt IS NULL UNION ALL SELECT source_id, n, 'range' FROM e WHERE bt IS NOT NULL AND NOT sc BETWEEN 3 AND 100 UNION ALL SELECT source_id, n, 'order' FROM e WHERE sc IS NOT NULL AND bt <= te""",
    "s6_playlist_items": f"WITH {_ITEMS} SELECT source_id, item, kind, uri, seconds::DOUBLE AS seconds, begin, length FROM it",
    "v13_playlist_inventory": f"""WITH {_ITEMS}, sz AS (SELECT source_id, p, sum(len) - CASE WHEN p % 6 = 4 THEN 1 ELSE 0 END AS size FROM ln WHERE p % 9 <> 7 GROUP BY source_id, p UNION ALL SELECT source_id, -1, 799 + source_id % 3 FROM has), j AS (SELECT it.*, size FROM it LEFT JOIN sz ON sz.source_id = it.source_id AND sz.p = it.p)
SELECT source_id, item, 'missing' AS rule FROM j WHERE size IS NULL UNION ALL SELECT source_id, item, 'range' FROM j WHERE p <> -2 AND (begin IS NULL OR begin + length > size) UNION ALL SELECT source_id, item, 'nested' FROM j WHERE p = -2 UNION ALL SELECT source_id, item, 'duration' FROM j WHERE kind = 'segment' AND coalesce(seconds, 0) <= 0
UNION ALL SELECT source_id, -1, 'map' FROM has WHERE NOT m UNION ALL SELECT source_id, -1, 'end' FROM has WHERE source_id % 11 = 4 UNION ALL SELECT source_id, -1, 'encrypted' FROM has WHERE source_id % 13 = 5 UNION ALL SELECT source_id, -1, 'pending_range' FROM has WHERE source_id % 13 = 6
UNION ALL SELECT DISTINCT source_id, -1, 'durations' FROM ln WHERE k % 31 = 17""",
    "x7_editorial_status": """WITH o AS (SELECT o_orderkey, o_orderstatus AS st, o_custkey AS c FROM orders), t AS (SELECT *, (o_orderkey % 7 = 0 OR o_orderkey % 3 = 1 OR c % 17 = 5 OR c % 19 = 6) AS un,
list_bool_and(list_transform(range(1, 5), lambda i: (c + i * 2) % 13 <> 0)) AND list_bool_and(list_transform(range(1, 4), lambda i: (c + i * 3) % 13 <> 0)) AS ok FROM o)
SELECT o_orderkey, CASE WHEN un THEN 'Unverified' WHEN st = 'O' THEN 'Rejected by text review' WHEN st = 'F' AND ok THEN 'Passed text review' ELSE 'Needs review' END AS status FROM t""",
    "r14_unknown_attempts": """WITH a AS (SELECT o_custkey % 20 AS run, o_orderkey AS id, o_custkey * 10 AS c FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 2), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY c, id) AS place FROM a)
SELECT run, id, place, 10000000 - (c + CASE WHEN id % 5 = 1 THEN 9 WHEN id % 2 = 1 THEN 5 ELSE 0 END) AS age_s FROM r WHERE place <= 50""",
    "e6_hierarchy": f"""WITH RECURSIVE {GRID_SQL}, r AS (SELECT source_id, sentence_id, 1 AS n, length(text) AS c, 0 AS region FROM grid WHERE sentence_id = 0
UNION ALL SELECT g.source_id, g.sentence_id, CASE WHEN x THEN 1 ELSE n + 1 END, CASE WHEN x THEN length(g.text) ELSE c + 1 + length(g.text) END, CASE WHEN x THEN region + 1 ELSE region END
FROM (SELECT r.n, r.c, r.region, g, (r.n >= 32 OR r.c + 1 + length(g.text) > 8000) AS x FROM r JOIN grid g ON g.source_id = r.source_id AND g.sentence_id = r.sentence_id + 1)),
k AS (SELECT r.source_id, region::BIGINT AS region, g.sentence_id, g.start_ms, g.end_ms FROM r JOIN grid g ON g.source_id = r.source_id AND g.sentence_id = r.sentence_id), {{levels}}
SELECT source_id, printf('region-%04d', a + 1) AS id, 'region' AS kind, printf('section-%04d', a // 8 + 1) AS parent, a AS ordinal, 0::BIGINT AS children, f AS first_sentence, l AS last_sentence, b AS start_ms, e AS end_ms, n AS sentences FROM l0
UNION ALL SELECT source_id, printf('section-%04d', a + 1), 'section', 'episode', a, c, f, l, b, e, n FROM l1 UNION ALL SELECT source_id, 'episode', 'episode', NULL, 0, (SELECT count(*) FROM l1 WHERE l1.source_id = l2.source_id), f, l, b, e, n FROM l2""".replace("{levels}", ", ".join(f"l{i} AS (SELECT source_id, {a} AS a, count(DISTINCT region) AS c, min(sentence_id) AS f, max(sentence_id) AS l, arg_min(start_ms, sentence_id) AS b, arg_max(end_ms, sentence_id) AS e, count(*) AS n FROM k GROUP BY ALL)" for i, a in enumerate(("region", "region // 8", "0")))),
    "g20_comparison_reasons": f"""WITH {_P}, ce AS (SELECT * FROM (SELECT DISTINCT configuration FROM rp WHERE configuration <> 0), (SELECT DISTINCT recording FROM rp)), b AS (SELECT recording, evidence AS b_evidence, {", ".join(f"{f} AS b_{f}" for f in FACTORS)} FROM rp WHERE configuration = 0),
pr AS (SELECT * FROM rp JOIN b USING (recording) WHERE configuration <> 0) SELECT configuration, recording, 'unpaired_source' AS reason FROM ce ANTI JOIN pr USING (configuration, recording) UNION ALL SELECT configuration, recording, 'different_source_evidence' FROM pr WHERE evidence <> b_evidence {_CHANGED}""",
    "g20_paired_deltas": " UNION ALL ".join(f"SELECT a.configuration, '{m}' AS metric, count(*) AS pairs, round(avg(a.{m} - b.{m}), 6) AS mean FROM rp a JOIN rp b ON b.configuration = 0 AND b.recording = a.recording WHERE a.configuration <> 0 AND a.{m} IS NOT NULL AND b.{m} IS NOT NULL GROUP BY 1" for m in ("clean_rate", "kept_rate")),
}
ORACLES["g20_paired_deltas"] = f"WITH {_P} {ORACLES['g20_paired_deltas']}"
