"""Substring dedup of word windows by a log-structured fingerprint index.

Of each window of WINDOW words the least hash of its GRAM-word grams is its fingerprint; neighbouring windows with one and
the same gram share an entry. Equal windows have equal fingerprints, so fingerprints are enough to find all repeats. Documents are
written once, in groups of a few MB, as a table bucketed by group that later steps join without a shuffle.

The index is a log of sorted immutable runs: a run has the different fingerprints of each group of a batch, sorted, in tables bucketed by
hash. A batch becomes a run of its own, which is merge-joined with the earlier ones, bucket by bucket and without moving them; groups on both
sides get back the fingerprints that occur again. When there are more than `fanout` runs they are compacted into one, which the next batch is joined with. Entries with such
fingerprints are then verified: the hashes of their single windows are dealt and sorted by fingerprint and (doc_id, start), and a window
that was there before (64 bits of its own besides the 64 of its fingerprint) is a repeat. A group sends only the first of its own equal
windows. Batches are ranges of doc_id, oldest first. strip() makes the batches of one call; SubstringIndex keeps the index for later ones.

Null text has no words and documents of fewer words than a window keep them all; a null doc_id is kept whole and never compared; rows with
equal doc_id are taken for versions of one document, where a window at the same place is no repeat; an empty table gives no rows; other columns are ignored (strip() keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline.llm.common import drop, grams, hashes, materialise, mixed, partitions, slices, table, words_of, workspace
from lexiline.llm.groups import Groups, bucket_keys, bucketed, by_value, list_column, own_texts, packed, reopened
from lexiline.llm.ranges import Ranges, least_places

WINDOW, GRAM, BUCKET_PRINTS = 20, 5, 400_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = "bucket int, g long, once array<int>, often array<int>"


def entries(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In steps: first row, word hashes, offsets, and of each entry its fingerprint, first window and number of windows."""
    batches = (pa.RecordBatch.from_arrays([c], ["text"]) for c in (texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]))
    row = 0
    for batch in slices(batches):
        words, offsets = words_of(batch.column("text"))
        first, row = row, row + batch.num_rows
        if len(words) < WINDOW:
            continue
        h = hashes(words)
        g = grams(h, GRAM)
        anchor = least_places(g, WINDOW - GRAM + 1)  # by window start
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[: len(anchor)]
        start = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= offsets[doc + 1])
        if len(start):
            a = anchor[start]
            cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            yield first, h, offsets, g[a[cut]], start[cut], np.diff(np.append(cut, len(start)))


class FingerprintIndex:
    """Runs of (bucket, g, once, often): the fingerprints that a group has once, and more than once, sorted. A run isn't changed once it is written."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 1, place: str | None = None):
        """With a place, runs are kept there."""
        self.spark, self.buckets, self.fanout, self.place = spark, buckets, fanout, place
        self.tables, self.runs, self.stale, self.batches = partitions(spark), [], [], 0

    def _write(self, df: DataFrame) -> dict:
        path = self.place and f"{self.place}/run-{uuid.uuid4().hex}"
        return {"table": bucketed(df.repartition(self.tables, "bucket"), "bucket", self.tables, path), "path": path, "n": self.tables}

    def reopen(self, path: str, n: int) -> None:
        """Adds a run that an earlier call kept."""
        self.runs.append({"table": reopened(self.spark, path, RUN, "bucket", n), "path": path, "n": n})

    def add(self, groups: Groups, where: Column | None = None) -> list[DataFrame]:
        """Makes a run of a batch's groups and joins it with the earlier ones, compacted if there are many: (g, keys) of groups of both sides."""
        n_buckets = self.buckets

        def send(g: int, left: pa.Table, right: pa.Table) -> pa.Table:
            _, _, texts = own_texts(left, right)
            keys = [bucket_keys(fp, n_buckets) for _, _, _, fp, _, _ in entries(texts)]
            key, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return packed(g, key, count > 1)

        def merge(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
            value, own, often, side = by_value([new, old])
            cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
            if len(cut):
                size = np.diff(np.append(cut, len(value)))
                met = ((size > 1) | np.logical_or.reduceat(often, cut)) & (np.minimum.reduceat(side, cut) == 0)
                keep = np.repeat(met, size)
                value, own = value[keep], own[keep]
            return list_column(own, value.view(np.uint32).astype(np.int64) | (key[0].as_py() << 32))

        if len(self.runs) > self.fanout:
            self.compact()
        new, empty = self._write(groups.join(groups.copies, send, RUN, where=where)), self.spark.createDataFrame([], RUN)
        found = []
        for run in self.runs or [None]:
            old = self.spark.table(run["table"]) if run else empty
            met = self.spark.table(new["table"]).groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(merge, "g long, keys array<long>")
            found.append(materialise(met, groups.place, f"found{self.batches}-{len(found)}"))
        self.batches += 1
        self.runs.append(new)
        return found

    def compact(self) -> None:
        """Merges all runs into one, which later batches are joined with in their place."""
        merged = self.spark.table(self.runs[0]["table"])
        for run in self.runs[1:]:
            merged = merged.unionByName(self.spark.table(run["table"]))
        self.stale, self.runs = self.stale + self.runs, [self._write(merged)]

    def forget(self, runs: list[dict]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run['table']}")
            if run["path"]:
                drop(run["path"], self.spark, "")

    def close(self) -> None:
        self.forget(self.stale + self.runs)
        self.runs, self.stale = [], []


WINDOWS = "fp long, g long, doc_id long, row long, s int, at array<int>, h array<long>, late int"


def windows(groups: Groups, shared: DataFrame, n_buckets: int) -> DataFrame:
    """Entries with shared fingerprints: hashes h of their windows s + at. Windows that a group has earlier are rows with late = how many from s on."""

    def step(g: int, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows, texts = own_texts(left, right)
        lists = right.column("keys").drop_null()
        known = np.unique(np.concatenate([c.flatten().to_numpy() for c in lists.chunks])) if len(lists) else np.zeros(0, np.int64)
        parts = []
        for first, h, offsets, fp, s, n in entries(texts) if len(known) else ():
            key = bucket_keys(fp, n_buckets).astype(np.int64)
            hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            fp, s, n = fp[hit], s[hit], n[hit]
            doc = np.searchsorted(offsets, s, side="right") - 1
            own = np.repeat(np.arange(len(s)), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            w = s[own] + at
            parts.append((fp[own], ids[first + doc][own], rows[first + doc][own], w - offsets[doc][own], (s - offsets[doc])[own], at, Ranges(h).of(w, np.full(len(w), WINDOW))))
        kinds = ("fp", "g", "doc_id", "row", "s", "at", "h", "late")
        fp, doc, number, place, s, at, h = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 5, np.zeros(0, np.uint64))
        order = np.lexsort((place, number, doc))
        fp, doc, number, place, s, at, h = (x[order] for x in (fp, doc, number, place, s, at, h))
        _, at_first, same = np.unique(mixed(fp) ^ h, return_index=True, return_inverse=True)
        new = (doc == doc[at_first][same]) & (place == place[at_first][same]) if len(h) else np.zeros(0, bool)
        # a row for each entry's windows that are new here, and one for each run of late ones
        entry = np.concatenate([[True], (number[1:] != number[:-1]) | (s[1:] != s[:-1])])[: len(h)]
        begins = np.flatnonzero(new & (entry | np.concatenate([[True], ~new[:-1]])[: len(h)]))
        ends = np.flatnonzero(new & np.concatenate([entry[1:] | ~new[1:], [True]])[: len(h)]) + 1
        size = ends - begins
        l_begins = np.flatnonzero(~new & np.concatenate([[True], new[:-1] | (number[1:] != number[:-1]) | (place[1:] != place[:-1] + 1)])[: len(h)])
        l_ends = np.flatnonzero(~new & np.concatenate([new[1:] | (number[1:] != number[:-1]) | (place[1:] != place[:-1] + 1), [True]])[: len(h)]) + 1
        take = lambda x, y: np.concatenate([x[begins], y])
        bounds = np.concatenate([np.cumsum(size) - size, np.full(len(l_begins) + 1, size.sum())]).astype(np.int32)
        flat = np.flatnonzero(new)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x))
        inside = place[flat] - np.repeat(place[begins], size)
        return pa.Table.from_arrays(
            [
                pa.array(take(fp, mixed(l_begins.astype(np.uint64) + np.uint64(g & 0xFFFF))).view(np.int64)), pa.array(np.full(len(begins) + len(l_begins), g, np.int64)), pa.array(take(doc, doc[l_begins])), pa.array(take(number, number[l_begins])),
                pa.array(take(place, place[l_begins]).astype(np.int32)), lists(inside.astype(np.int32)), lists(h[flat].view(np.int64)), pa.array(np.concatenate([np.zeros(len(begins)), l_ends - l_begins]).astype(np.int32)),
            ],
            kinds,
        )

    right = shared.select("g", "keys", F.lit(None).cast("long").alias("copy")).unionByName(groups.copies.select("g", F.lit(None).cast("array<bigint>").alias("keys"), "copy"))
    return groups.join(right, step, WINDOWS)


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


SPANS = "g long, row long, s int, n int"


def repeats(found: DataFrame) -> DataFrame:
    """(g, row, s, n): runs of windows that are there before, by doc_id and start. A task holds a batch and the windows of one fingerprint."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(0, np.uint64)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            h = batch.column("h")
            n = h.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(fp)), n)
            key = mixed(fp[row]) ^ h.flatten().to_numpy().view(np.uint64)
            place = batch.column("s").to_numpy()[row] + batch.column("at").flatten().to_numpy()
            doc = batch.column("doc_id").to_numpy()[row]
            _, first, same = np.unique(key, return_index=True, return_inverse=True)
            # the same place again is a repeated row, not a repeat
            late = (doc != doc[first][same]) | (place != place[first][same]) if len(key) else np.zeros(0, bool)
            if len(fp) and last is not None and fp[0] == last:
                late |= np.isin(key, seen)
            if len(fp):
                tail = key[fp[row] == fp[-1]]
                seen = np.union1d(seen, tail) if fp[-1] == last else np.unique(tail)
                last = fp[-1]
            joined = np.concatenate([[False], (row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1) & late[1:] & late[:-1]])[: len(row)]
            begins = np.flatnonzero(late & ~joined)
            size = np.diff(np.append(np.flatnonzero(late & ~joined), len(late))) if len(begins) else np.zeros(0, np.int64)
            run = np.cumsum(late & ~joined)[late] - 1
            size = np.bincount(run, minlength=len(begins)) if len(begins) else size
            r = row[begins]
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(r)), batch.column("row").take(pa.array(r)), pa.array(place[begins].astype(np.int32)), pa.array(size.astype(np.int32))], ["g", "row", "s", "n"])

    dealt = found.filter("late = 0").repartition(partitions(found.sparkSession), "fp").sortWithinPartitions("fp", "doc_id", "s", "row")
    return found.filter("late > 0").select("g", "row", "s", F.col("late").alias("n")).unionByName(dealt.select("fp", "g", "doc_id", "row", "s", "at", "h").mapInArrow(task, SPANS))


def strip(docs: DataFrame, batches: int = 3, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (texts: and text, with the repeated words and the space after them cut out)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = sorted({int(x) for x in source.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)})
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.when(F.col("doc_id") > cut, 1).otherwise(0)
    groups = Groups(source.withColumn("batch", F.coalesce(batch, F.lit(0))))
    index = FingerprintIndex(docs.sparkSession, buckets_for(groups.bytes))
    shared = [found for k in range(len(cuts) + 1) for found in index.add(groups, F.col("batch") == k)]
    index.close()
    found = materialise(windows(groups, united(shared), index.buckets), groups.place, "windows")
    spans = materialise(repeats(found), groups.place, "spans")
    return groups.finished(without(groups, spans, texts))


def buckets_for(size: int) -> int:
    """Buckets of fingerprints for so many bytes of texts."""
    return max(1, math.ceil(size / 50 / BUCKET_PRINTS))


class SubstringIndex:
    """An index that lasts: documents added in later calls and sessions are stripped of what earlier batches have.

    Its folder, which all machines share, keeps each batch's documents in groups, the runs, and a manifest for each batch that names those in
    force. A call that ends early leaves the manifest before it in force, and the batch can be added again. Batches come in order of doc_id: one
    that begins below what the index holds is refused (ValueError), so all outputs together are those of strip() over all documents. Rows
    without doc_id are kept whole. An addition joins the new run with the earlier runs; of earlier documents it reads the texts,
    and handles those of groups that share a fingerprint with the batch. Nothing else is computed anew. One call at a time may add."""

    def __init__(self, spark: SparkSession, path: str, expected_bytes: int = 1 << 40, fanout: int = 4):
        """Opens the index in a folder, or makes one for about so many bytes of texts in all."""
        self.spark, self.path = spark, path.rstrip("/")
        last = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/*") if self._has("manifests") else spark.createDataFrame([], MANIFEST)
        state = last.orderBy(F.desc("batches")).first()
        self.index = FingerprintIndex(spark, state["buckets"] if state else buckets_for(expected_bytes), fanout, self.path)
        self.top, self.batches = (state["top"], [b.asDict() for b in state["groups"]]) if state else (None, [])
        for run in state["runs"] if state else ():
            self.index.reopen(run["path"], run["n"])
        self.index.batches = len(self.batches)

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def add(self, docs: DataFrame, texts: bool = False) -> DataFrame:
        """The columns of strip() for a batch, which is in the index afterwards."""
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        ends = source.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
        if ends["least"] is not None and self.top is not None and ends["least"] <= self.top:
            raise ValueError(f"the index holds documents up to {self.top}, and the batch begins at {ends['least']}")
        n = len(self.batches)
        place = f"{self.path}/batch-{n}-{uuid.uuid4().hex}"
        groups = Groups(source.withColumn("batch", F.lit(n)), place)
        shared = united(self.index.add(groups))
        keys = shared.select("g").distinct()
        found = [windows(groups, shared, self.index.buckets)]
        for old in [Groups.stored(self.spark, b["place"], b["n"]) for b in self.batches]:
            old.table = old.table.join(keys, "g", "left_semi")
            found.append(windows(old, shared, self.index.buckets))
        spans = materialise(repeats(materialise(united(found), place, "windows")), place, "spans")
        out = materialise(without(groups, spans, texts), workspace(self.spark), "stripped")
        drop(place, self.spark, "windows", "spans", "first", "heavy", *[f"found{self.index.batches - 1}-{k}" for k in range(len(self.index.runs))])
        self.batches.append({"place": place, "n": self.index.tables})
        self.top = max((x for x in (self.top, ends["most"]) if x is not None), default=None)
        runs = [(r["path"], r["n"]) for r in self.index.runs]
        state = self.spark.createDataFrame([(len(self.batches), self.index.buckets, self.top, runs, [(b["place"], b["n"]) for b in self.batches])], MANIFEST)
        materialise(state.coalesce(1), f"{self.path}/manifests", f"{n}-{uuid.uuid4().hex}")
        self.index.forget(self.index.stale)
        self.index.stale = []
        return out


MANIFEST = "batches int, buckets int, top long, runs array<struct<path:string,n:int>>, groups array<struct<place:string,n:int>>"


def without(groups: Groups, spans: DataFrame, texts: bool) -> DataFrame:
    """The rows of all documents of groups without the words of spans (those of other groups are passed over) and of copies."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("s", "int"), ("n", "int"))]
    right = spans.withColumn("copy", F.lit(None).cast("long")).unionByName(groups.copies.select("g", *none, "copy"))

    def step(g: int, left: pa.Table, right: pa.Table) -> pa.Table:
        copies = right.column("copy").drop_null()
        right = right.filter(pa.compute.is_valid(right.column("row")))
        numbers = left.column("row")
        known = numbers.to_numpy()
        sort = np.argsort(known, kind="stable")
        parts, row = [], 0
        number, s, n = (right.column(c).to_numpy().astype(np.int64) for c in ("row", "s", "n"))
        at = sort[np.searchsorted(known[sort], number)] if len(number) else number
        copy = pa.compute.is_in(numbers, value_set=copies).to_numpy(zero_copy_only=False) if len(copies) else np.zeros(len(numbers), bool)
        for part in slices(left.select(["doc_id", "text"]).combine_chunks().to_batches()):
            words, offsets = words_of(part.column("text"))
            rows = slice(row, row + part.num_rows)
            mine = (at >= rows.start) & (at < rows.stop)
            first, size = offsets[at[mine] - row] + s[mine], n[mine] + WINDOW - 1
            all_gone = copy[rows] & (np.diff(offsets) >= WINDOW)
            first, size = np.concatenate([first, offsets[:-1][all_gone]]), np.concatenate([size, np.diff(offsets)[all_gone]])
            edge = np.bincount(first, minlength=len(words) + 1) - np.bincount(first + size, minlength=len(words) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            removed = before[offsets[1:]] - before[offsets[:-1]]
            kept = words.filter(pa.array(~gone))
            bounds = offsets - before[offsets]
            joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), kept), " ")
            out = {"doc_id": part.column("doc_id"), "n_words": np.diff(offsets), "n_removed": removed, "kept_sha256": [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]}
            if texts:
                cut = pa.compute.fill_null(part.column("text"), "").to_pylist()
                for i in np.flatnonzero(removed):
                    found = list(WORD.finditer(cut[i]))
                    ends = [*(m.start() for m in found[1:]), len(cut[i])]
                    cut[i] = "".join(cut[i][m.start() : e] for m, e, x in zip(found, ends, gone[offsets[i] : offsets[i + 1]]) if not x)
                out["text"] = pa.array(cut, pa.string())
            parts.append(pa.table(out))
            row = rows.stop
        return pa.concat_tables(parts)

    return groups.join(right, step, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents"))


def substring_sql(docs: str) -> str:
    """CTEs from docs (doc_id, text) to stripped (the columns of strip, and words_kept)."""
    return rf"""
sw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM {docs}),
wi AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM sw WHERE len(w) >= 20)),
lt AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM wi) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM lt),
wp AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM sw)),
kp AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS words_kept, count(*) AS n FROM wp ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
stripped AS (SELECT sw.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words_kept, '')) AS kept_sha256, words_kept FROM sw LEFT JOIN kp USING (doc_id))
"""


ORACLE_SQL = f"WITH {substring_sql('documents')} SELECT doc_id, n_words, n_removed, kept_sha256 FROM stripped"
