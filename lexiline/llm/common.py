"""What the corpus operators share: the shared folder, bounded batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a task holds at once; a longer single text is a step of its own.
BATCH_BYTES = 4 << 20


def workspace(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: under spark.checkpoint.dir.

    Where that setting is absent, a temporary folder on a single machine, as in tests, and an error on a cluster.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.lexiline.dir", None)
    if base is None:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lexiline-")
        spark.conf.set("spark.lexiline.dir", base)
    return f"{base.rstrip('/')}/lexiline-{uuid.uuid4().hex}"


def materialise(df: DataFrame, place: str, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it: lineage ends there, lost executors cost nothing."""
    df.write.option("compression", "zstd").parquet(f"{place}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{place}/{name}")


def drop(place: str, spark: SparkSession, *names: str) -> None:
    """Deletes materialised steps that nothing reads any more."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Heavy:
    """Rows joined with a few rows of each key, where a key may hold a third of all rows: those of heavy keys are dealt by salts.

    At most HEAVY keys can hold more than a HEAVY-th of all entries, so the broadcast list of them is bounded."""

    HEAVY, SALTS, LEAST = 20_000, 64, 1000

    def __init__(self, sizes: DataFrame, key: str, entries: int, place: str):
        """sizes: (key, n)."""
        self.key = key
        self.keys = materialise(sizes.filter(F.col("n") > max(self.LEAST, entries // self.HEAVY)).select(key, F.lit(True).alias("heavy")), place, "heavy")

    def join(self, rows: DataFrame, few: DataFrame, deal: str, how: str = "inner") -> DataFrame:
        """rows joined with few by the key (or left joined); column `deal` of rows is what salts are made of."""
        marked = lambda df: df.join(F.broadcast(self.keys), self.key, "left")
        left = marked(rows).withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64(deal), F.lit(self.SALTS))).otherwise(0)).drop("heavy")
        salts = F.when(F.col("heavy"), F.sequence(F.lit(0).cast("long"), F.lit(self.SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        return left.join(marked(few).withColumn("salt", F.explode(salts)).drop("heavy"), [self.key, "salt"], how).drop("salt")


def let(value: Column, body) -> Column:
    """body(x) with x bound to value. Plain columns that a lambda uses get inlined, and then computed anew for each element,
    wherever the optimizer pushes a filter below their projection; a bound one is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `column`, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text (null: none): one flat array and the offsets of the texts in it."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    listed = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = listed.flatten(), listed.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[offsets]


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; each different word is hashed once."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    digest = xxhash.xxh3_64_intdigest
    own = np.fromiter((digest(w, seed) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits of x."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of each k neighbours of h, in order; empty if there are fewer than k."""
    n = max(0, len(h) - k + 1)
    g = np.full(n, np.uint64(0x9E3779B97F4A7C15 + salt), np.uint64)
    for i in range(k):
        g = (g ^ h[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        g ^= g >> np.uint64(32)
    return mixed(g)
