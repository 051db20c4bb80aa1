"""Adapters: the shared tables as the frames that the operators take. All arithmetic is on integers.

words      source_id, ord, text, speaker, start_ms, end_ms      from conversations
spans      key, id, start_ms, end_ms, kind                      from events
units      source_id, ord, vec                                  from embeddings
Each has a DuckDB twin in SQL, so that queries and oracles start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: bytes of text of a task of words, and the fewest where there are idle cores
TASK_TEXT, LEAST_TEXT = 2_000_000, 64_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_source(*order: str):
    return Window.partitionBy("source_id").orderBy(*(order or ("ord",)))


def text_tasks(df: DataFrame, text: str) -> int:
    """So many tasks that each has some TASK_TEXT bytes of the text of df."""
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, -(-size // TASK_TEXT), min(df.sparkSession.sparkContext.defaultParallelism, size // LEAST_TEXT))


def by_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """df dealt by key to so many tasks that each has some TASK_TEXT bytes of text. Windows by the key stay in these tasks, where rows are sorted more than once; left to itself, Spark makes
    tasks of as many rows as fit some MB when compressed, of short words ten times what they are there."""
    return df.repartition(text_tasks(df, text), key)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each conversation with made-up times: a pause before each turn, short gaps inside."""
    c = by_text(table(spark, sf_dir, "conversations"), "conv_id", "text")
    cut = F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"[ \t\n\r]+"), lambda w: w != "")
    w = c.select(F.col("conv_id").alias("source_id"), "turn", F.col("role").alias("speaker"), F.posexplode(cut).alias("pos", "text"))
    w = w.withColumns({
        "dur": 80 + 30 * F.length("text"),
        "gap": F.when(F.col("pos") == 0, 400 + (F.col("turn") * 911) % 2900).otherwise((F.col("pos") * 37 + F.col("turn") * 13) % 900),
    })
    order = by_source("turn", "pos")
    w = w.withColumn("end_ms", F.sum(F.col("dur") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return w.select("source_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), "text", "speaker", (F.col("end_ms") - F.col("dur")).cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "turn", F.col("pos").cast("long").alias("pos"))


WORDS_SQL = r"""
wx AS (SELECT conv_id AS source_id, turn, role AS speaker, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '[ \t\n\r]+'), lambda w: w <> '') AS ws FROM conversations),
we AS (SELECT source_id, turn, speaker, i - 1 AS pos, ws[i] AS text FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM wx)),
wg AS (SELECT *, 80 + 30 * length(text) AS dur, CASE WHEN pos = 0 THEN 400 + (turn * 911) % 2900 ELSE (pos * 37 + turn * 13) % 900 END AS gap FROM we),
wt AS (SELECT *, sum(dur + gap) OVER (PARTITION BY source_id ORDER BY turn, pos)::BIGINT AS end_ms, row_number() OVER (PARTITION BY source_id ORDER BY turn, pos) - 1 AS ord FROM wg),
words AS (SELECT source_id, ord, text, speaker, (end_ms - dur)::BIGINT AS start_ms, end_ms, turn, pos FROM wt)
"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval for each event: from its time, as long as its value says."""
    e = table(spark, sf_dir, "events")
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), start.alias("start_ms"), (start + F.round(F.col("value") * 100).cast("long") * 2000).alias("end_ms"), F.col("event_type").alias("kind"))


SPANS_SQL = """
spans AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + round(value * 100)::BIGINT * 2000 AS end_ms, event_type AS kind FROM events)
"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in blocks of fifty."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 50").alias("source_id"), F.expr("vec_id % 50").alias("ord"), F.col("embedding").cast("array<double>").alias("vec"), "label")


UNITS_SQL = "units AS (SELECT vec_id // 50 AS source_id, vec_id % 50 AS ord, embedding::DOUBLE[] AS vec, label FROM embeddings)"
