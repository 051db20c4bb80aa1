"""Files in and out: recognizer JSON, detector logs, captions, sample frames, peaks and content-addressed artifacts.

Readers take an explicit schema and refuse what doesn't fit. Writers put a recording's file together in one task, which holds it whole, as it does when it is read and
numbered by line. A file goes into a folder of its own, or with archive=True into a row (source_id, value) of Parquet, so that many recordings need few files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.functions.text import SPACES, blank, strip
from lexiline.functions.text import pieces as text_pieces
from lexiline.operators.clean import clean_confidence, normalize_speaker, seconds_to_ms

# fixed values: the recognizer's fields, non-speech texts, the least score of a shot, line forms of logs and captions
ASR_SCHEMA = "source_id long, duration_ms long, language string, segments array<struct<start:double,end:double,speaker:string,text:string,words:array<struct<word:string,start:double,end:double,score:double,speaker:string>>>>"
NO_SPEECH = r"(?i)\A(?:[♪♫♬♩" + SPACES[1:-1] + r"]+|\[(?:music|silence|no speech)\]|\((?:music|silence|no speech)\))\z"
SHOT_FLOOR, SHOT_MOST = 3.0, 100.0
TIME_LINE, SCORE_LINE = r"pts_time:([0-9]+(?:\.[0-9]+)?)", r"lavfi\.scd\.score=([0-9]+(?:\.[0-9]+)?)"
STRICT_TIME, STRICT_SCORE = r"\bpts_time:(-?\d+(?:\.\d+)?(?:e[+-]?\d+)?)\b", r"^lavfi\.scd\.score=(-?\d+(?:\.\d+)?)$"
CUE = r"\A(?:[^\n]*\n)?([0-9]{2,}):([0-9]{2}):([0-9]{2})[.,]([0-9]{3}) --> ([0-9]{2,}):([0-9]{2}):([0-9]{2})[.,]([0-9]{3})\n"


# ---- sources -----------------------------------------------------------------------------------------------

def read_asr(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Recordings, one to a line (multi_line: one to a file); anything that the schema doesn't hold ends the reading with an error."""
    return spark.read.schema(ASR_SCHEMA).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def asr_words(raw: DataFrame) -> DataFrame:
    """(source_id, ord, segment, text, start_ms, end_ms, speaker, confidence): the words of all segments in spoken order. Blank words go; a segment without any other
    gives the pieces of its text without times, and none where the text says that there is no speech. A segment with neither words nor text is refused. A word without a speaker has its segment's."""
    empty_word = lambda w: blank(w["word"])
    empty_type = "array<struct<word:string,start:double,end:double,score:double,speaker:string>>"
    empty = F.lit(None).cast(empty_type)
    silent = F.coalesce(strip("s.text"), F.lit("")).rlike(NO_SPEECH) | (F.coalesce(strip("s.text"), F.lit("")) == "")
    nothing = F.lit(None).cast("double")
    pieces = F.transform(text_pieces("s.text"), lambda t: F.struct(t.alias("word"), nothing.alias("start"), nothing.alias("end"), nothing.alias("score"), F.lit(None).cast("string").alias("speaker")))
    unreadable = F.col("s").isNull() | (F.col("s.words").isNull() & F.col("s.text").isNull())
    refused = F.raise_error(F.concat(F.lit("a segment has neither words nor text: "), F.col("source_id").cast("string"))).cast(empty_type)
    said = F.when(unreadable, refused).when(F.coalesce(F.exists("s.words", lambda w: ~empty_word(w)), F.lit(False)), F.col("s.words")).when(~silent, pieces).otherwise(empty)
    words = raw.select("source_id", F.posexplode("segments").alias("segment", "s")).select("source_id", "segment", F.col("s.speaker").alias("whose"), F.posexplode(said).alias("k", "w")).filter(~blank("w.word"))
    order = Window.partitionBy("source_id").orderBy("segment", "k")
    return words.select(
        "source_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), F.col("segment").cast("long").alias("segment"), strip("w.word").alias("text"), seconds_to_ms(F.col("w.start")).alias("start_ms"), seconds_to_ms(F.col("w.end")).alias("end_ms"),
        F.coalesce(normalize_speaker(F.col("w.speaker")), normalize_speaker(F.col("whose"))).alias("speaker"), clean_confidence(F.col("w.score")).alias("confidence"),
    )


def _whole(spark: SparkSession, path: str, archive: bool) -> DataFrame:
    """(source_id, value) of files in folders source_id=..., or of an archive of them."""
    whole = spark.read.parquet(path) if archive else spark.read.text(path, wholetext=True)
    return whole.select(F.col("source_id").cast("long").alias("source_id"), "value")


def _lines(spark: SparkSession, path: str, archive: bool = False) -> DataFrame:
    """(source_id, n, line) of files in folders source_id=..., or of an archive of them, numbered from 0."""
    return _whole(spark, path, archive).select("source_id", F.posexplode(F.split("value", "\n")).alias("n", "line"))


def shot_log(spark: SparkSession, path: str, floor: float = SHOT_FLOOR, archive: bool = False) -> DataFrame:
    """(source_id, time_ms, score) of detector logs: a score belongs to the last time line before it, each time to one score; scores below the floor go."""
    o = Window.partitionBy("source_id").orderBy("n")
    t, score = F.regexp_extract("line", TIME_LINE, 1), F.regexp_extract("line", SCORE_LINE, 1)
    known = _lines(spark, path, archive).select("source_id", "n", F.when(t != "", t).cast("double").alias("t"), F.when(score != "", score).cast("double").alias("score")).filter("t is not null or score is not null")
    paired = known.withColumns({"before": F.lag("t").over(o)}).filter("score is not null and t is null and before is not null")
    return paired.filter(F.col("score") >= floor).select("source_id", F.floor(F.col("before") * 1000 + 0.5).cast("long").alias("time_ms"), "score")


SHOT_GRID = "source_id long, decision_threshold double, shots array<struct<t:double,score:double>>"


def read_shot_grid(spark: SparkSession, path: str) -> DataFrame:
    """S3: (source_id, time_ms, score) of shot grids in JSON, one to a line: the shots that reach the threshold of their own file."""
    g = spark.read.schema(SHOT_GRID).option("mode", "FAILFAST").json(path)
    x = g.select("source_id", "decision_threshold", F.explode("shots").alias("x")).filter("x.score >= decision_threshold")
    return x.select("source_id", F.floor(F.col("x.t") * 1000 + 0.5).cast("long").alias("time_ms"), "x.score")


def shot_log_violations(spark: SparkSession, path: str, least: float = SHOT_FLOOR, most: float = SHOT_MOST, archive: bool = False) -> DataFrame:
    """(source_id, n, rule) of detector logs read strictly: a time without a score or a score without a time (rows of either kind in turn), a score out of range,
    a time that isn't beyond the one before it (compared exactly, as decimals). A log with text but without rows of either kind breaks rule unrecognised (n -1)."""
    o = Window.partitionBy("source_id").orderBy("n")
    t, score = F.regexp_extract("line", STRICT_TIME, 1), F.regexp_extract(strip("line"), STRICT_SCORE, 1)
    lines = _lines(spark, path, archive)
    rows = lines.select("source_id", "n", F.when(t != "", t).cast("decimal(28,9)").alias("t"), F.when((t == "") & (score != ""), score).cast("double").alias("score")).filter("t is not null or score is not null")
    near = rows.withColumns({"before": F.lag("t").over(o), "after": F.lead("score").over(o)})
    pairs = F.max(F.when(F.col("after").isNotNull(), F.col("t"))).over(o.rowsBetween(Window.unboundedPreceding, -2))
    near = near.withColumn("earlier", pairs)
    rules = {
        "no_score": F.col("t").isNotNull() & F.col("after").isNull(), "no_time": F.col("score").isNotNull() & F.col("before").isNull(),
        "range": F.col("before").isNotNull() & ~F.col("score").between(least, most), "order": F.col("before").isNotNull() & F.col("score").isNotNull() & (F.col("before") <= F.col("earlier")),
    }
    found = F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]), lambda x: x.isNotNull())
    said = lines.filter(~blank("line")).select("source_id").distinct().join(rows.select("source_id").distinct(), "source_id", "left_anti")
    return near.select("source_id", F.col("n").cast("long").alias("n"), F.explode(found).alias("rule")).unionByName(said.select("source_id", F.lit(-1).cast("long").alias("n"), F.lit("unrecognised").alias("rule")))


def _references(lines: DataFrame) -> DataFrame:
    """What each playlist refers to, in order: lines that are no tag, and tags with a URI. A range line belongs to the next line that is no tag, and so does a duration."""
    o = Window.partitionBy("source_id").orderBy("n")
    is_tag = F.col("line").startswith("#")
    attributes = F.when(is_tag & ~F.col("line").rlike("^#EXT-X-(KEY|BYTERANGE):"), F.regexp_extract("line", "^[^:]*:(.*)$", 1)).otherwise("")
    of = lambda name: F.nullif(F.regexp_extract(attributes, f'(?:^|,){name}="([^"]+)"(?:,|$)', 1), F.lit(""))
    said = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    plain = ~is_tag & (F.col("line") != "")
    block = F.coalesce(F.sum(plain.cast("long")).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.withColumns({"plain": plain, "block": block, "tag_uri": of("URI"), "tag_range": of("BYTERANGE"), "next_range": F.when(F.col("line").startswith("#EXT-X-BYTERANGE:"), F.substring_index("line", "#EXT-X-BYTERANGE:", -1)), "inf": said("^#EXTINF:([^,]+),")})
    b = Window.partitionBy("source_id", "block").orderBy("n")
    last = lambda c: F.when(F.col("plain"), F.last(c, ignorenulls=True).over(b))
    found = marked.withColumns({"range": F.coalesce(last("next_range"), "tag_range"), "seconds": last("inf").try_cast("decimal(18,6)"), "uri": F.when(F.col("plain"), F.col("line")).otherwise(F.col("tag_uri"))}).filter("uri is not null")
    kind = F.when(F.col("plain"), "segment").when(F.col("line").startswith("#EXT-X-MAP:"), "map").otherwise("tag")
    part = lambda k: F.get(F.split("range", "@"), k).try_cast("long")
    numbered = found.withColumns({"item": (F.row_number().over(o) - 1).cast("long"), "kind": kind, "length": F.when(F.size(F.split("range", "@")) <= 2, part(0)), "start": part(1)})
    i = Window.partitionBy("source_id").orderBy("item")
    goes_on = F.col("range").isNotNull() & ~F.contains("range", F.lit("@")) & F.col("uri").eqNullSafe(F.lag("uri").over(i)) & F.lag("range").over(i).isNotNull()
    runs = numbered.withColumn("run", F.sum((~goes_on).cast("long")).over(i))
    r = Window.partitionBy("source_id", "run").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.select("source_id", "item", "kind", "uri", "seconds", (F.first("start").over(r) + F.sum("length").over(r) - F.col("length")).alias("begin"), "length", "range")


def playlist_items(lines: DataFrame) -> DataFrame:
    """(source_id, item, kind, uri, seconds, begin, length) of the lines (source_id, n, line) of media playlists: what each refers to, in order; kind is segment, map, or tag for
    other tags with a URI. A range without a start goes on where the one before it ended, if that is of the same object (else begin is null); a reference without a range has neither begin nor length."""
    return _references(lines).drop("range")


def playlist_seconds(lines: DataFrame) -> DataFrame:
    """(source_id, seconds): the sum of all durations of a playlist; null where there is none, or one that isn't a positive number."""
    said = lines.select("source_id", F.nullif(F.regexp_extract("line", "^#EXTINF:([^,]+),", 1), F.lit("")).alias("inf"))
    number = F.col("inf").try_cast("decimal(18,6)")
    g = said.groupBy("source_id").agg(F.sum(number).alias("seconds"), F.coalesce(F.min(F.when(F.col("inf").isNotNull(), F.coalesce(number > 0, F.lit(False)))), F.lit(False)).alias("fine"))
    return g.select("source_id", F.when(F.col("fine"), F.col("seconds")).alias("seconds"))


def playlist_violations(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source_id, item, rule): objects (source_id, uri, size) that are missing or empty, ranges past their object's end, without a start or unreadable, unsafe names, playlists
    within playlists, segments without a duration, and of whole playlists (item -1): no first line, no end, no map or one without a URI, no segment, a key line, a range that no line follows, and not as many durations as segments."""
    j = _references(lines).join(sizes, ["source_id", "uri"], "left")
    unsafe = F.col("uri").rlike(r"[:?#\\\\%]|^/|(^|/)\.{1,2}(/|$)")
    item = {
        "unsafe": unsafe, "missing": F.coalesce("size", F.lit(0)) <= 0, "nested": F.col("uri").endswith(".m3u8"),
        "range": F.col("range").isNotNull() & (F.col("begin").isNull() | (F.col("begin") < 0) | (F.col("length") <= 0) | F.coalesce(F.col("begin") + F.col("length") > F.col("size"), F.lit(False))),
        "duration": (F.col("kind") == "segment") & (F.coalesce("seconds", F.lit(0)) <= 0),
    }
    starts = lambda tag: F.col("line").startswith(tag)
    whole = lines.groupBy("source_id").agg(
        F.min_by("line", "n").alias("first"), F.max((F.col("line") == "#EXT-X-ENDLIST").cast("int")).alias("end"), F.count_if(starts("#EXT-X-KEY:")).alias("keys"), F.count_if(F.col("line").rlike("^#EXTINF:[^,]+,")).alias("durations"),
        F.count_if(starts("#EXT-X-MAP:") & ~F.col("line").rlike('[:,]URI="[^"]+"(,|$)')).alias("bad_maps"), F.max(F.when(starts("#EXT-X-BYTERANGE:"), F.col("n"))).alias("last_range"), F.max(F.when(~starts("#") & (F.col("line") != ""), F.col("n"))).alias("last_plain"),
    )
    whole = whole.join(j.groupBy("source_id").agg(F.count_if(F.col("kind") == "map").alias("maps"), F.count_if(F.col("kind") == "segment").alias("segments")), "source_id", "left")
    of_all = {
        "first_line": F.col("first") != "#EXTM3U", "end": F.col("end") == 0, "map": (F.coalesce("maps", F.lit(0)) == 0) | (F.col("bad_maps") > 0), "segments": F.coalesce("segments", F.lit(0)) == 0, "encrypted": F.col("keys") > 0,
        "pending_range": F.col("last_range") > F.coalesce("last_plain", F.lit(-1)), "durations": F.col("durations") != F.coalesce("segments", F.lit(0)),
    }
    found = lambda rules: F.explode(F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]), lambda x: x.isNotNull())).alias("rule")
    return j.select("source_id", "item", found(item)).unionByName(whole.select("source_id", F.lit(-1).cast("long").alias("item"), found(of_all)))


def read_playlists(spark: SparkSession, path: str, archive: bool = False) -> DataFrame:
    """(source_id, n, line) of playlists in folders source_id=..., or of an archive of them."""
    return _lines(spark, path, archive)


def read_captions(spark: SparkSession, path: str, archive: bool = False) -> DataFrame:
    """(source_id, ord, start_ms, end_ms, text, ok) of WebVTT or SRT files in folders source_id=..., or of an archive of them; ok: positive, and not before the end of the cue before it."""
    blocks = _whole(spark, path, archive).select("source_id", F.posexplode(F.split("value", "\n\n")).alias("n", "block")).filter(F.col("block").rlike(CUE))
    part = lambda k: F.regexp_extract("block", CUE, k).cast("long")
    ms = lambda k: ((part(k) * 60 + part(k + 1)) * 60 + part(k + 2)) * 1000 + part(k + 3)
    c = blocks.select("source_id", "n", ms(1).alias("start_ms"), ms(5).alias("end_ms"), F.rtrim(F.regexp_replace("block", CUE, "")).alias("text"))
    o = Window.partitionBy("source_id").orderBy("n")
    ok = (F.col("end_ms") > F.col("start_ms")) & (F.col("start_ms") >= F.coalesce(F.lag("end_ms").over(o), F.lit(0)))
    return c.select("source_id", (F.row_number().over(o) - 1).cast("long").alias("ord"), "start_ms", "end_ms", F.regexp_replace("text", "\n$", "").alias("text"), ok.alias("ok"))


def sample_frames(samples: DataFrame, size: int = 512) -> DataFrame:
    """(source_id, frame, start_sample, valid, samples): frames of `size` samples (source_id, ix, value), the last one filled with zeros."""
    g = samples.groupBy("source_id", F.expr(f"ix div {size}").alias("frame")).agg(F.count("*").alias("valid"), F.transform(F.array_sort(F.collect_list(F.struct("ix", "value"))), lambda x: x["value"]).alias("values"))
    zeros = F.array_repeat(F.lit(0).cast(samples.schema["value"].dataType), (F.lit(size) - F.col("valid")).cast("int"))
    return g.select("source_id", "frame", (F.col("frame") * size).alias("start_sample"), "valid", F.concat("values", zeros).alias("samples"))


# ---- sinks -------------------------------------------------------------------------------------------------

def cue_clock(ms: str, point: str) -> Column:
    c = F.col(ms)
    part = lambda div, mod, n: F.lpad((F.floor(c / div) % mod).cast("string"), n, "0")
    return F.concat(F.lpad(F.floor(c / 3_600_000).cast("string"), 2, "0"), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit(point), F.lpad((c % 1000).cast("string"), 3, "0"))


def _write(rows: DataFrame, path: str, sep: str, archive: bool) -> None:
    """Rows (source_id, ord, value) as one text for each recording, each value ended by sep. The grouping keeps a recording's rows together; after repartition() Spark may split those of a union over tasks, and so over files."""
    g = rows.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), sep).alias("value"))
    if archive:
        g.select("source_id", F.concat("value", F.lit(sep)).alias("value")).write.parquet(path)
    else:
        g.write.partitionBy("source_id").option("lineSep", sep).text(path)


def write_captions(cues: DataFrame, path: str, form: str = "vtt", archive: bool = False) -> None:
    """K2: cues (source_id, ord, start_ms, end_ms, text) as a WebVTT or SRT file for each recording, in a folder source_id=... or a row of an archive."""
    if form not in ("vtt", "srt"):
        raise ValueError("form must be vtt or srt")
    point = "." if form == "vtt" else ","
    times = F.concat(cue_clock("start_ms", point), F.lit(" --> "), cue_clock("end_ms", point), F.lit("\n"), F.regexp_replace("text", r"\n\s*\n", "\n"))
    block = times if form == "vtt" else F.concat((F.col("ord") + 1).cast("string"), F.lit("\n"), times)
    rows = cues.select("source_id", "ord", block.alias("value"))
    if form == "vtt":
        rows = rows.unionByName(cues.select("source_id").distinct().select("source_id", F.lit(-1).cast("long").alias("ord"), F.lit("WEBVTT").alias("value")))
    _write(rows, path, "\n\n", archive)


def write_lines(lines: DataFrame, path: str, archive: bool = False) -> None:
    """K3: lines (source_id, ord, line) as a text file for each recording, in a folder source_id=... or a row of an archive."""
    _write(lines.select("source_id", "ord", F.coalesce("line", F.lit("")).alias("value")), path, "\n", archive)


def read_lines(spark: SparkSession, path: str, archive: bool = False) -> DataFrame:
    return _lines(spark, path, archive).filter("line <> ''").select("source_id", F.col("n").cast("long").alias("ord"), "line")


PEAKS = "version int, samples_per_pixel int, bits int, length long, data array<long>"


def write_peaks(peaks: DataFrame, path: str, per_pixel: int, archive: bool = False) -> None:
    """K5: peaks (source_id, pixel, lo, hi) as a JSON document for each recording, least and greatest in turn, in a folder source_id=... or a row of an archive."""
    data = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pixel", "lo", "hi"))), lambda p: F.array(p["lo"], p["hi"])))
    g = peaks.groupBy("source_id").agg(F.count("*").alias("length"), data.alias("data"))
    body = F.to_json(F.struct(F.lit(2).alias("version"), F.lit(per_pixel).alias("samples_per_pixel"), F.lit(8).alias("bits"), "length", "data"))
    out = g.select("source_id", body.alias("value")).write
    out.parquet(path) if archive else out.partitionBy("source_id").text(path)


def read_peaks(spark: SparkSession, path: str, archive: bool = False) -> DataFrame:
    j = _whole(spark, path, archive).select("source_id", F.from_json("value", PEAKS, {"mode": "FAILFAST"}).alias("j"))
    x = j.select("source_id", "j.length", F.posexplode("j.data").alias("i", "v"))
    return x.groupBy("source_id", "length", F.expr("cast(i div 2 as long)").alias("pixel")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("lo"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).alias("hi"))


def artifacts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """K1: (address, body): each row as JSON with its fields in order of their names, under the SHA-256 of that text. NaN has no such text and is refused."""
    body = F.to_json(F.struct(*sorted(columns)))
    refused = F.when(body.contains('"NaN"') | body.contains('"Infinity"'), F.raise_error(F.lit("not a finite number"))).otherwise(body)
    return rows.select(refused.alias("body")).select(F.sha2("body", 256).alias("address"), "body")


def publish(new: DataFrame, path: str, stored: DataFrame | None = None) -> None:
    """Appends artifacts that aren't stored yet, once each, in folders by the first digits of their addresses; what is stored isn't written again."""
    once = new.dropDuplicates(["address"])
    once = once.join(stored.select("address"), "address", "left_anti") if stored is not None else once
    once.withColumn("prefix", F.substring("address", 1, 1)).write.mode("append").partitionBy("prefix").parquet(path)
