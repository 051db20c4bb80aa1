"""Documents in groups of a few MB: a table bucketed by group, and fingerprints that groups send dealt by hash and get back.

A group is the unit that tasks hold in memory. Fingerprints travel as packed lists, so a shuffled row has those of one group and
bucket, each different one once, however often the group's documents repeat it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lexiline.llm.common import Heavy, drop, materialise, mixed, partitions, workspace

GROUP_BYTES = 8 << 20


def bucket_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a hash, in one number."""
    h = mixed(h)
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def packed(g: int, key: np.ndarray, often: np.ndarray) -> pa.Table:
    """Rows (bucket, g, once, often) of a group's sorted different keys."""
    bucket, value = (key >> np.uint64(32)).astype(np.int32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(key)])
    split = lambda mask: pa.ListArray.from_arrays(
        pa.array(np.concatenate([np.concatenate([[0], np.cumsum(mask)])[starts], [mask.sum()]]).astype(np.int32)), pa.array(value[mask])
    )
    return pa.table({"bucket": pa.array(bucket[starts]), "g": pa.array(np.full(len(starts), g, np.int64)), "once": split(~often), "often": split(often)})


def by_value(tables: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All values of packed rows in order, with their group, whether it has them often, and the number of their table."""
    values, own, often, side = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int8)]
    for k, rows in enumerate(tables):
        for batch in rows.to_batches():
            g = batch.column("g").to_numpy()
            for name, flag in (("once", False), ("often", True)):
                column = batch.column(name)
                values.append(column.flatten().to_numpy())
                own.append(np.repeat(g, column.value_lengths().to_numpy()))
                often.append(np.full(len(values[-1]), flag))
                side.append(np.full(len(values[-1]), k, np.int8))
    value, own, often, side = (np.concatenate(x) for x in (values, own, often, side))
    order = np.argsort(value)
    return value[order], own[order], often[order], side[order]


def list_column(own: np.ndarray, key: np.ndarray) -> pa.Table:
    """(g, keys): the keys of each group as a list."""
    order = np.argsort(own, kind="stable")
    own, key = own[order], key[order]
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    return pa.table({"g": pa.array(own[cut]), "keys": pa.ListArray.from_arrays(pa.array(np.append(cut, len(own)).astype(np.int32)), pa.array(key))})


def own_texts(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """doc_id, row and text of a group's documents that have an id and aren't copies."""
    copies = right.column("copy").drop_null()
    rows = left.filter(pa.compute.is_valid(left.column("doc_id")))
    rows = rows.filter(pa.compute.invert(pa.compute.is_in(rows.column("row"), value_set=copies))) if len(copies) else rows
    return rows.column("doc_id").to_numpy(), rows.column("row").to_numpy(), rows.column("text")


def bucketed(df: DataFrame, key: str, n: int, path: str | None = None) -> str:
    """The name of a new table of df in n buckets by key, sorted by it: in the warehouse, or in the folder `path`, where it outlives the session."""
    name = f"lexiline_{key}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(n, key).sortBy(key).option("compression", "zstd").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return name


def reopened(spark: SparkSession, path: str, schema: str, key: str, n: int) -> str:
    """The name of a table over a folder that bucketed() wrote."""
    name = f"lexiline_{key}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    return name


class Groups:
    """The documents as a table bucketed by group, and joins of its groups with other rows of theirs. Each row has a number of its own: rows of one doc_id stay apart.

    Texts of about one length make a group, so that it never holds more than GROUP_BYTES, or one text."""

    #: columns of the table of an index that lasts
    STORED = "doc_id long, text string, batch int, row long, g long, key binary"

    def __init__(self, docs: DataFrame, place: str | None = None):
        """With a place, the table and the copies are kept there."""
        self.spark, self.place = docs.sparkSession, place or workspace(docs.sparkSession)
        extra = [c for c in ("batch",) if c in docs.columns]
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
        size = source.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
        self.bytes = size["b"] or 0
        mean = max(1, self.bytes // max(1, size["n"]))
        numbered = source.withColumn("row", F.monotonically_increasing_id())
        # class k: texts of up to 4^(k+1) times the mean length, fewer to a group
        k = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.octet_length("text") / F.lit(float(mean)))) / 2) - 1).cast("int")
        rows = F.greatest(F.lit(1.0), F.least(F.lit(4096.0), F.floor(F.lit(GROUP_BYTES / mean) / F.pow(F.lit(4.0), k + 1)))).cast("long")
        group = F.floor(F.col("row") / rows)
        marks = {"g": F.pmod(F.xxhash64(group, k, *extra), F.lit(1 << 48)), "key": F.unhex(F.md5("text"))}
        self.name = bucketed(numbered.withColumns(marks), "g", partitions(self.spark), place and f"{place}/groups")
        self.table = self.spark.table(self.name)
        known = self.table.filter("doc_id is not null").select("g", "row", "doc_id", "key")
        first = materialise(known.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first < last").drop("last"), self.place, "first")
        heavy = Heavy(first.select("key", "n"), "key", size["n"], self.place)
        self.copies = materialise(heavy.join(known, first.select("key", "first"), "row").filter("doc_id > first").select("g", F.col("row").alias("copy")), self.place, "copies")

    @classmethod
    def stored(cls, spark: SparkSession, place: str, n: int) -> Groups:
        """Groups that an earlier call kept at a place, in n buckets."""
        self = cls.__new__(cls)
        self.spark, self.place, self.name = spark, place, reopened(spark, f"{place}/groups", cls.STORED, "g", n)
        self.table, self.copies = spark.table(self.name), spark.read.schema("g long, copy long").parquet(f"{place}/copies")
        return self

    def join(self, right: DataFrame, step, schema: str, where: Column | None = None) -> DataFrame:
        """step(g, documents, rows) on each group with the rows of its g in right."""
        rows = self.table if where is None else self.table.filter(where)
        none = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
        run = lambda key, a, b: step(key[0].as_py(), a, b) if len(a) else none
        return rows.select("g", "doc_id", "row", "text").groupBy("g").cogroup(right.groupBy("g")).applyInArrow(run, schema)

    def finished(self, result: DataFrame) -> DataFrame:
        """The result, written, after which the table and all steps go."""
        out = materialise(result, workspace(self.spark), "stripped")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop(self.place, self.spark, "")
        return out
