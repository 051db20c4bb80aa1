"""Suffix-array dedup of byte strings: common prefixes from a Burrows-Wheeler transform, in increasing order up to the minimum length.

What goes to the transform is found first. Of each window of LENGTH bytes the least hash of its GRAM-byte grams is its anchor, so equal
windows have equal anchors; neighbouring windows with one anchor make an entry. Documents are written once, in groups of a few MB, as a table
bucketed by group, which every later step joins without a shuffle. (1) Groups send the different hashes of their anchors, dealt by hash, and get
back those that any other document has. (2) Only entries of such anchors are kept; ctx hashes all bytes of an entry's windows. Entries with
equal (anchor, ctx) in an earlier document are repeats as a whole; where an anchor has several contexts, those of the earliest document go to (3).
(3) Contexts are dealt by anchor into blocks of about BLOCK_BYTES. A block is sorted by its suffixes' first bytes, LENGTH or a few more, and transformed.
Prefixes common to neighbouring suffixes follow by breadth-first backward extension, one length after the other: a neighbour pair that starts
with c has one byte more in common than the least of those between the two occurrences of c that it is an extension of. Expansion stops below LENGTH;
pairs that are still open share a string, and each such interval's smallest doc_id keeps it. An anchor of more than HOT contexts is
dealt further, by its single windows. Exact copies of a document are taken out at the start: all their bytes are repeats.

Null text is empty, a null doc_id is kept whole and never compared, rows with equal doc_id are each compared with documents of smaller ones and not with each other, an
empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.llm.common import materialise, mixed, partitions, table
from lexiline.llm.groups import Groups, bucket_keys, by_value, list_column, own_texts, packed
from lexiline.llm.ranges import Ranges

LENGTH, GRAM = 50, 20
BUCKET_ANCHORS, BLOCK_BYTES, HOT = 400_000, 1 << 20, 20_000
STEP_BYTES = 4 << 20
LOW = np.uint64((1 << 24) - 1)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one word."""
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 7, 8), (1, 1))).view("<u8").reshape(-1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one array: hash of the anchor, first window and number of windows of each entry."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none
    e = eights(data)
    n = len(data) - GRAM + 1
    h = mixed(e[:n] * np.uint64(0x9FB21C651E98DF25) + mixed(e[8 : 8 + n] ^ (e[GRAM - 8 : GRAM - 8 + n] * np.uint64(0xD6E8FEB86659FD93))))
    least = (h & ~LOW) | (np.arange(n, dtype=np.uint64) & LOW)
    span, have = LENGTH - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    # windows that end in their own text
    valid = np.zeros(len(least) + 1, np.int64)
    long = np.diff(offsets) >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(start):
        return none
    low = (least[start] & LOW).astype(np.int64)
    at = start + ((low - start) & int(LOW))
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    return h[at[cut]], start[cut], np.diff(np.append(cut, len(start)))


def buffers(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Steps of at most STEP_BYTES (or one text): first row, bytes, offsets."""
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    group = (offsets[1:] - offsets[0]) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def shared_anchors(groups: Groups) -> DataFrame:
    """(g, keys): bucket keys of the anchors of a group that another document has too."""
    n_buckets = max(1, math.ceil(groups.bytes / 16 / BUCKET_ANCHORS))

    def send(g: int, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, _, texts = own_texts(left, right)
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, data, offsets in buffers(texts):
            h, s, _ = anchors(data, offsets)
            keys.append(bucket_keys(h, n_buckets)), docs.append(ids[first + np.searchsorted(offsets, s, side="right") - 1])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        often = np.minimum.reduceat(doc, cut) < np.maximum.reduceat(doc, cut) if len(cut) else np.zeros(0, bool)
        return packed(g, key[cut], often)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket: int, rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            value, own, often, _ = by_value([pa.Table.from_batches(rows)])
            cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])[: len(value)])
            size = np.diff(np.append(cut, len(value)))
            shared = np.repeat((size > 1) | np.logical_or.reduceat(often, cut), size)
            return list_column(own[shared], value[shared].view(np.uint32).astype(np.int64) | (bucket << 32)).to_batches()

        current, rows = None, []
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if buckets[a] != current and rows:
                        yield from done(current, rows)
                        rows = []
                    current = int(buckets[a])
                    rows.append(batch.slice(a, b - a))
        if rows:
            yield from done(current, rows)

    sent = groups.join(groups.copies, send, "bucket int, g long, once array<int>, often array<int>")
    return sent.repartition(partitions(groups.spark), "bucket").sortWithinPartitions("bucket").mapInArrow(back, "g long, keys array<long>"), n_buckets


def entries(groups: Groups, shared: DataFrame, n_buckets: int) -> DataFrame:
    """(fp, ctx, doc_id, row, s, n, g, late) of the entries with shared anchors; what has an earlier document in its own group is late already."""

    def step(g: int, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows, texts = own_texts(left, right)
        lists = right.column("keys").drop_null()
        known = np.unique(np.concatenate([c.flatten().to_numpy() for c in lists.chunks])) if lists.num_chunks else np.zeros(0, np.int64)
        parts = []
        for first, data, offsets in buffers(texts) if len(known) else ():
            h, s, n = anchors(data, offsets)
            key = bucket_keys(h, n_buckets).astype(np.int64)
            at = np.searchsorted(known, key)
            hit = known[np.minimum(at, len(known) - 1)] == key
            h, s, n = h[hit], s[hit], n[hit]
            doc = np.searchsorted(offsets, s, side="right") - 1
            ctx = Ranges(data.astype(np.uint64) + np.uint64(1)).of(s, n + LENGTH - 1)
            parts.append((h, ctx, ids[first + doc], rows[first + doc], s - offsets[doc], n))
        fp, ctx, doc, row, s, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
        order = np.lexsort((doc, ctx, fp))
        fp, ctx, doc, row, s, n = (x[order] for x in (fp, ctx, doc, row, s, n))
        late = np.zeros(len(fp), bool)
        if len(fp):
            new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])])
            late = doc > doc[new][np.cumsum(new) - 1]
        fp = np.where(late, mixed(mixed(row.view(np.uint64)) + s.astype(np.uint64)), fp)  # dealt anywhere
        return pa.table({"fp": fp.view(np.int64), "ctx": ctx.view(np.int64), "doc_id": doc, "row": row, "s": s.astype(np.int32), "n": n.astype(np.int32), "g": np.full(len(fp), g, np.int64), "late": late})

    right = shared.select("g", "keys", F.lit(None).cast("long").alias("copy")).unionByName(groups.copies.select("g", F.lit(None).cast("array<bigint>").alias("keys"), "copy"))
    return groups.join(right, step, "fp long, ctx long, doc_id long, row long, s int, n int, g long, late boolean")


def bounded_suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t by their first `depth` symbols (or some more)."""
    bits = int(t.max()).bit_length()
    have = 63 // bits
    key = np.zeros(len(t), np.int64)
    for i in range(have):
        key <<= bits
        key[: len(t) - i] |= t[i:]
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(len(t), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        if have >= depth:
            return order
        step = min(have, depth - have)
        key = rank << np.int64(32)
        key[: len(t) - step] |= rank[step:] + 1
        have += step


def open_pairs(t: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix has the first `length` symbols in common with the one before it: breadth-first backward extension
    on the transform. Values are found in increasing order and the search stops at `length`."""
    bwt = t[sa - 1]  # the symbol before each suffix
    back = np.argsort(bwt, kind="stable")  # where the suffix after the first symbol of each suffix is
    first = bwt[back]
    start = np.concatenate([[True], first[1:] != first[:-1]])
    closed = start.astype(np.int32)  # nothing in common: their first symbols differ
    waiting = np.flatnonzero(~start)
    low, high = back[waiting - 1] + 1, back[waiting] + 1
    for _ in range(1, length):
        upto = np.concatenate([[0], np.cumsum(closed)])
        ends = upto[high] > upto[low]  # a shorter prefix parts the two: theirs is one symbol longer
        if not ends.any():
            break
        closed[waiting[ends]] = 1
        keep = ~ends
        waiting, low, high = waiting[keep], low[keep], high[keep]
    return closed == 0


def late_windows(contexts: list[np.ndarray], docs: np.ndarray) -> np.ndarray:
    """For all windows of the contexts, one after the other: whether one with a smaller doc_id has the same bytes."""
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    t = np.zeros(int((lengths + 1).sum()) + 1, np.int64)
    ends = np.cumsum(lengths + 1)
    own = np.repeat(np.arange(len(contexts)), lengths)
    place = np.arange(lengths.sum()) + own  # one separator after each context
    symbols = np.concatenate(contexts)
    used = np.zeros(256, bool)
    used[symbols] = True
    t[place] = (np.cumsum(used) + 1)[symbols]
    t[ends - 1] = 1
    sa = bounded_suffix_array(t, LENGTH)
    shared = open_pairs(t, sa, LENGTH)
    size, doc = np.zeros(len(t), np.int64), np.full(len(t), np.iinfo(np.int64).max)
    size[place] = ends[own] - 1 - place
    doc[place] = docs[own]
    full = size >= LENGTH
    # intervals of suffixes with a common window; those that run over a context's end share nothing with windows
    interval = np.cumsum(~shared) - 1
    d = np.where(full[sa], doc[sa], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(d, np.flatnonzero(~shared))
    late = np.zeros(len(t), bool)
    late[sa] = full[sa] & (d > least[interval])
    return late[place[full[place]]]


def spans_from_blocks(groups: Groups, wanted: DataFrame, total: int) -> DataFrame:
    """(g, row, s, n): late windows among the contexts wanted (g, fp, doc_id, row, s, n, hot)."""
    n_blocks = max(1, math.ceil(total / BLOCK_BYTES))

    def cut(g: int, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"block": [], "doc_id": [], "row": [], "s": [], "context": []}
        if right.num_rows:
            texts = dict(zip(left.column("row").to_pylist(), left.column("text").cast(pa.large_binary()).to_pylist()))
            for fp, doc, row, s, n, hot in zip(*(right.column(c).to_pylist() for c in ("fp", "doc_id", "row", "s", "n", "hot"))):
                whole = texts[row][s : s + n + LENGTH - 1]
                for a, b in ((i, i + LENGTH) for i in range(n)) if hot else ((0, len(whole)),):
                    own = whole[a:b]
                    out["block"].append((int.from_bytes(hashlib.blake2b(own, digest_size=7).digest(), "little") if hot else fp) % n_blocks)
                    out["doc_id"].append(doc), out["row"].append(row), out["s"].append(s + a), out["context"].append(own)
        kinds = {"block": pa.int64(), "g": pa.int64(), "doc_id": pa.int64(), "row": pa.int64(), "s": pa.int32(), "context": pa.binary()}
        out["g"] = [g] * len(out["block"])
        return pa.table({k: pa.array(out[k], v) for k, v in kinds.items()})

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = pa.Table.from_batches(rows)
            doc, place, s, g = (block.column(c).to_numpy() for c in ("doc_id", "row", "s", "g"))
            contexts = [np.frombuffer(x, np.uint8) for x in block.column("context").to_pylist()]
            late = late_windows(contexts, doc)
            windows = np.fromiter((len(x) - LENGTH + 1 for x in contexts), np.int64, len(contexts))
            own = np.repeat(np.arange(len(contexts)), windows)
            inside = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
            begins = np.flatnonzero(late & np.concatenate([[True], ~late[:-1] | (own[1:] != own[:-1])]))
            stops = np.flatnonzero(late & np.concatenate([~late[1:] | (own[1:] != own[:-1]), [True]]))
            row = own[begins]
            return pa.RecordBatch.from_arrays([pa.array(g[row]), pa.array(place[row]), pa.array((s[row] + inside[begins]).astype(np.int32)), pa.array((stops - begins + 1).astype(np.int32))], ["g", "row", "s", "n"])

        current, rows = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if blocks[a] != current and rows:
                        yield done(rows)
                        rows = []
                    current = blocks[a]
                    rows.append(batch.slice(a, b - a))
        if rows:
            yield done(rows)

    blocks = groups.join(wanted, cut, "block long, g long, doc_id long, row long, s int, context binary")
    return blocks.repartition(partitions(groups.spark), "block").sortWithinPartitions("block").mapInArrow(transform, "g long, row long, s int, n int")


def strip(docs: DataFrame, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (kept: and the bytes that stay)."""
    groups = Groups(docs.select("doc_id", "text"))
    shared, n_buckets = shared_anchors(groups)
    found = entries(groups, shared, n_buckets)
    by, by_ctx = Window.partitionBy("fp"), Window.partitionBy("fp", "ctx")
    judged = found.withColumns({"first": F.min("doc_id").over(by_ctx), "lo": F.min("ctx").over(by), "hi": F.max("ctx").over(by), "size": F.count("*").over(by)})
    is_late = F.col("late") | (F.col("doc_id") > F.col("first"))
    judged = judged.select("g", "doc_id", "row", "s", "n", "fp", is_late.alias("late"), (F.col("size") > HOT).alias("hot"), ((F.col("lo") < F.col("hi")) & ~is_late).alias("open")).filter("late or open")
    judged = materialise(judged, groups.place, "judged")
    wanted = judged.filter("open").select("g", "fp", "doc_id", "row", "s", "n", "hot")
    total = wanted.agg(F.sum(F.when(F.col("hot"), F.col("n") * LENGTH).otherwise(F.col("n") + LENGTH))).first()[0] or 0
    spans = materialise(spans_from_blocks(groups, wanted, total), groups.place, "spans")
    everything = judged.filter("late").select("g", "row", "s", "n").unionByName(spans)
    right = everything.withColumn("copy", F.lit(None).cast("long")).unionByName(groups.copies.select("g", F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("n"), "copy"))

    def step(g: int, left: pa.Table, right: pa.Table) -> pa.Table:
        copies = set(right.column("copy").drop_null().to_pylist())
        spans = right.filter(pa.compute.is_valid(right.column("row")))
        ids, numbers = left.column("doc_id").to_pylist(), left.column("row").to_pylist()
        place = {d: i for i, d in enumerate(numbers)}
        row = np.fromiter((place[d] for d in spans.column("row").to_pylist()), np.int64, spans.num_rows)
        order = np.argsort(row, kind="stable")
        s, n, row = spans.column("s").to_numpy().astype(np.int64)[order], spans.column("n").to_numpy().astype(np.int64)[order], row[order]
        cuts = np.searchsorted(row, np.arange(len(ids) + 1))
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i, (own, text) in enumerate(zip(numbers, left.column("text").cast(pa.large_binary()).to_pylist())):
            a, b, removed, runs, rest = cuts[i], cuts[i + 1], 0, 0, text
            if own in copies:
                if len(text) >= LENGTH:
                    removed, runs, rest = len(text), 1, b""
            elif b > a:
                edge = np.bincount(s[a:b], minlength=len(text) + 1) - np.bincount(s[a:b] + n[a:b] + LENGTH - 1, minlength=len(text) + 1)
                gone = np.cumsum(edge[: len(text)]) > 0
                removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for k, v in zip(out, (len(text), removed, runs, hashlib.sha256(rest).hexdigest(), rest if kept else None)):
                out[k].append(v)
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), **({"kept": pa.binary()} if kept else {})}
        return pa.table({"doc_id": pa.array(ids, pa.int64()), **{k: pa.array(out[k], v) for k, v in kinds.items()}})

    return groups.finished(groups.join(right, step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents"))
