"""Files of recordings in folders and archives, and coverage by words without length."""

import glob

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiline.operators.intervals import coverage_assessment
from lexiline.sources import files
from lexiline.sources.transcripts import read_transcripts, write_transcripts


def grouped(spark):
    """Lines of 40 recordings as a union of frames that are both dealt by recording already."""
    rows = spark.range(40_000).select((F.col("id") % 40).alias("source_id"), (F.expr("id div 40") + 1).alias("ord"))
    body = rows.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("ord"))).select("source_id", "ord", F.format_string("line %d", "n").alias("line"))
    ends = rows.groupBy("source_id").agg(F.max("ord").alias("m")).select("source_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.lit("first").alias("line")), F.struct((F.col("m") + 1).alias("ord"), F.lit("last").alias("line")))).alias("x"))
    return body.unionByName(ends.select("source_id", "x.ord", "x.line"))


def test_lines_of_a_union_are_one_file_each(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")  # as with larger tables, the frames' tasks are merged in different ways
    try:
        files.write_lines(grouped(spark), f"file://{tmp_path}/lines")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    found = sorted(glob.glob(f"{tmp_path}/lines/source_id=*/part*"))
    assert len(found) == 40
    want = ["first", *(f"line {i}" for i in range(1, 1001)), "last"]
    assert all(open(f).read().splitlines() == want for f in found)


def test_archives_hold_what_folders_hold(spark, tmp_path):
    cues = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 900, f"word {i}\n\nmore") for i in range(20)] + [(2, 0, 5, 5, "none")], "source_id long, ord long, start_ms long, end_ms long, text string")
    for form in ("vtt", "srt"):
        at = f"file://{tmp_path}/{form}"
        files.write_captions(cues, f"{at}-folders", form)
        files.write_captions(cues, f"{at}-archive", form, archive=True)
        whole = spark.read.text(f"{at}-folders", wholetext=True).select("source_id", "value").collect()
        assert sorted(map(tuple, spark.read.parquet(f"{at}-archive").collect())) == sorted(map(tuple, whole))
        read = lambda p, a: sorted(map(tuple, files.read_captions(spark, p, a).collect()))
        assert read(f"{at}-archive", True) == read(f"{at}-folders", False) != []
    words = spark.createDataFrame([(s, 0, "a", None, 1, 2, 0.5, "aligned", "en", 9, "m", "n", "1") for s in range(5)], "source_id long, ord long, text string, speaker string, start_ms long, end_ms long, confidence double, timing string, language string, duration_ms long, model string, name string, version string")
    write_transcripts(words, f"file://{tmp_path}/t-folders")
    write_transcripts(words, f"file://{tmp_path}/t-archive", archive=True)
    read = lambda p, a: sorted(read_transcripts(spark, f"file://{tmp_path}/{p}", a).collect())
    assert len(read("t-archive", True)) == 5 and read("t-archive", True) == read("t-folders", False)
    assert len(glob.glob(f"{tmp_path}/t-archive/part*")) < 5


def test_words_without_length_end_the_tail(spark):
    said = lambda *rows: spark.createDataFrame(list(rows), "key long, start_ms long, end_ms long")
    got = coverage_assessment(said((1, 0, 9000), (2, 0, 9000)), said((1, 0, 3000), (1, 9000, 9000), (2, 500, 500)), ["key"]).collect()
    assert {r["key"]: (r["tail_ms"], r["silent"], r["missing_ms"]) for r in got} == {1: (0, False, 6000), 2: (8500, False, 9000)}
