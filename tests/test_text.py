"""White space of every kind, and files that are refused, by literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from lexiline.functions.text import SPACE, blank, pieces, strip
from lexiline.operators import checks
from lexiline.operators.clean import normalize_speaker
from lexiline.sources import files

ODD = ["", " ", "\n", "\t", " ", "  　", "\x1f", "\x85", "​", "a", "\n a b \t", " a ", "﻿", "  x  y\nz "]


def test_white_space_is_that_of_the_language():
    assert all(c.isspace() for c in SPACE) and {chr(c) for c in range(0x110000) if chr(c).isspace()} == set(SPACE)


def test_strip_blank_and_pieces(spark):
    df = spark.createDataFrame(list(enumerate([*ODD, None])), "i int, t string")
    got = df.select("t", strip("t").alias("s"), blank("t").alias("b"), pieces("t").alias("p")).collect()
    assert all((r["s"], r["b"], r["p"]) == (r["t"].strip(), not r["t"].strip(), r["t"].split()) for r in got if r["t"] is not None)
    assert [tuple(r) for r in got if r["t"] is None] == [(None, None, None, None)]


def test_speakers(spark):
    given = ["SPEAKER_007", " SPEAKER_0\n", "\n", "\t Ann ", None, "SPEAKER_x", "SPEAKER_1 b"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "s string").select(normalize_speaker(F.col("s"))).collect()]
    assert got == ["7", "0", None, "Ann", None, "SPEAKER_x", "SPEAKER_1 b"]


def recording(spark, tmp_path, segments):
    path = tmp_path / f"r{abs(hash(json.dumps(segments)))}.json"
    path.write_text(json.dumps({"source_id": 1, "duration_ms": 9, "language": "en", "segments": segments}) + "\n")
    return [r["text"] for r in files.asr_words(files.read_asr(spark, f"file://{path}")).orderBy("ord").collect()]


def test_recognizer_words(spark, tmp_path):
    word = lambda w: {"word": w, "start": 0.0, "end": 1.0, "score": 0.5, "speaker": "A"}
    segment = lambda text, *words: {"start": 0.0, "end": 1.0, "speaker": None, "text": text, "words": [word(w) for w in words]}
    assert recording(spark, tmp_path, [segment("x", "\n", " ", "a\t", " b")]) == ["a", "b"]
    assert recording(spark, tmp_path, [segment("one two\nthree", "\n", "\t")]) == ["one", "two", "three"]
    assert recording(spark, tmp_path, [segment(" [Music]\n"), segment("♪ ♪"), segment(" \n")]) == []
    assert recording(spark, tmp_path, [{"start": 0.0, "text": "said"}, {"words": []}]) == ["said"]
    with pytest.raises(Exception, match="neither words nor text"):
        recording(spark, tmp_path, [{"start": 0.0, "end": 1.0}])


def test_blank_titles(spark):
    chapters = spark.createDataFrame([(1, 0, 0, 50, "a"), (1, 1, 50, 100, "\n "), (2, 0, 0, 100, "b")], "source_id long, ord long, start_ms long, end_ms long, title string")
    got = {r["source_id"]: (r["score"], r["issues"]) for r in checks.chapter_score(chapters, spark.createDataFrame([(1, 100), (2, 100)], "source_id long, duration_ms long")).collect()}
    assert got == {1: (0.8, "chapter 1 has an empty title"), 2: (1.0, "")}


def test_strict_logs(spark, tmp_path):
    logs = {1: "nothing here\n", 2: " \n\n", 3: "pts_time:1.5\nframe\n\tlavfi.scd.score=11.0 \n", 4: "lavfi.scd.score=11.0\n"}
    for source, text in logs.items():
        (tmp_path / f"source_id={source}").mkdir()
        (tmp_path / f"source_id={source}" / "log.txt").write_text(text)
    got = sorted(tuple(r) for r in files.shot_log_violations(spark, f"file://{tmp_path}").collect())
    assert got == [(1, -1, "unrecognised"), (4, 0, "no_time")]


HEAD, MAP, END = "#EXTM3U", '#EXT-X-MAP:URI="init.mp4",BYTERANGE="10@0"', "#EXT-X-ENDLIST"


@pytest.mark.parametrize(
    ("body", "rules"),
    [
        ([MAP, "#EXTINF:2.5,", "#EXT-X-BYTERANGE:5@0", "a.m4s", "#EXTINF:1,", "#EXT-X-BYTERANGE:5", "a.m4s"], []),
        ([MAP, "#EXT-X-KEY:METHOD=NONE", "#EXTINF:1,", "a.m4s"], ["encrypted"]),
        ([MAP, "#EXTINF:1,", "other.m3u8"], ["missing", "nested"]),
        ([MAP, "#EXTINF:1,", "#EXTINF:1,", "a.m4s"], ["durations"]),
        ([MAP, "#EXTINF:1,", "a.m4s", "#EXT-X-BYTERANGE:5@0"], ["pending_range"]),
        (["#EXT-X-MAP:BYTERANGE=\"10@0\"", "#EXTINF:1,", "a.m4s"], ["map"]),
        ([MAP, "#EXTINF:nan,", "a.m4s"], ["duration"]),
        ([MAP, "#EXTINF:1,", "#EXT-X-BYTERANGE:5@0@1", "a.m4s"], ["range"]),
        ([MAP, "#EXTINF:1,", "#EXT-X-BYTERANGE:x", "a.m4s"], ["range"]),
        ([MAP, '#EXT-X-MEDIA:TYPE=AUDIO,URI="lost.m4s"', "#EXTINF:1,", "a.m4s"], ["missing"]),
        ([MAP, "#EXTINF:1,", "#EXT-X-BYTERANGE:5@0", '#EXT-X-MEDIA:TYPE=AUDIO,URI="a.m4s"', "a.m4s", "#EXTINF:1,", "#EXT-X-BYTERANGE:6", "a.m4s"], ["range"]),
        ([MAP, "#EXTINF:1,", "../a.m4s"], ["missing", "unsafe"]),
    ],
)
def test_playlists(spark, body, rules):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate([HEAD, *body, END])], "source_id long, n int, line string")
    sizes = spark.createDataFrame([(1, "init.mp4", 10), (1, "a.m4s", 10)], "source_id long, uri string, size long")
    assert sorted(r["rule"] for r in files.playlist_violations(lines, sizes).collect()) == rules


def test_playlist_seconds(spark):
    rows = [(1, 0, "#EXTINF:1.5,"), (1, 1, "#EXTINF:2,x"), (2, 0, "#EXTINF:0,"), (2, 1, "#EXTINF:1,"), (3, 0, "a"), (4, 0, "#EXTINF:inf,")]
    got = {r["source_id"]: r["seconds"] and float(r["seconds"]) for r in files.playlist_seconds(spark.createDataFrame(rows, "source_id long, n int, line string")).collect()}
    assert got == {1: 3.5, 2: None, 3: None, 4: None}
