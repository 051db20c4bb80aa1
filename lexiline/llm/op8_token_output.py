"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of one range of documents, in ascending doc_id order: magic, blocks, then an
index (start of each block), the documents (id, number of ids) and a footer. A block subtracts its
minimum, packs all values at the width that the given percentile of them needs, and keeps the values
that don't fit in an exception list of (place, whole value).

Tasks write their files straight to the shared folder under names of their own and return one row
for each; only files named in the manifest, which Spark commits, count, so a lost or repeated task
leaves at most a file that nobody reads.

Null text is empty, an empty document has the end id alone, a null doc_id sorts first, rows with equal
doc_id follow each other in the order of their text, an empty table gives no files and no rows, other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.llm.common import materialise, partitions, slices, table, workspace
from lexiline.llm.tokens import TOKEN_BYTES, Encoder, with_end, word_path

MAGIC = b"PFOR\x01\0\0\0"
BLOCK = 4096
#: blocks that are packed or unpacked in one step
STEP = 128
HEAD = "<IIHH"  # values, minimum, width, exceptions
FOOT = "<QQQQ"  # where the index starts, blocks, documents, ids
HEAD_SIZE, FOOT_SIZE = struct.calcsize(HEAD), struct.calcsize(FOOT)


def _lanes(width: int) -> list[tuple[int, int]]:
    return [divmod(i * width, 64) for i in range(64)]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values (a multiple of 64 each) below 2**width, each as 64-bit words: a row is 64 lanes, and word j of
    every column of the lanes has the bits from 64 * j on."""
    v = values.reshape(len(values), 64, -1).astype(np.uint64)
    out = np.zeros((len(v), width, v.shape[2]), np.uint64)
    for i, (word, shift) in enumerate(_lanes(width)):
        out[:, word] |= v[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, i] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(len(words), width, -1)
    out, mask = np.empty((len(w), 64, w.shape[2]), np.uint32), np.uint64((1 << width) - 1)
    for i, (word, shift) in enumerate(_lanes(width)):
        x = w[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (w[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = x & mask
    return out.reshape(len(words), -1)


def encode_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """Blocks of BLOCK ids (the last may be shorter)."""
    n = -(-len(ids) // BLOCK)
    full = np.zeros(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1:] if len(ids) else 0
    rows = full.reshape(n, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    kth = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    bound = np.partition(rest, kth, axis=1)[:, kth]
    widths = np.maximum(1, np.ceil(np.log2(bound.astype(np.float64) + 1)).astype(np.int64))
    out: list[bytes] = [b""] * n
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        over = (rest[at].astype(np.uint64) >> np.uint64(width)) > 0
        packed = pack(np.where(over, 0, rest[at]), int(width))
        for j, i in enumerate(at):
            places = np.flatnonzero(over[j]).astype("<u2")
            count = min(BLOCK, len(ids) - i * BLOCK)
            out[i] = struct.pack(HEAD, count, least[i], width, len(places)) + packed[j].astype("<u8").tobytes() + places.tobytes() + rest[i][places].astype("<u4").tobytes()
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    heads = [struct.unpack_from(HEAD, b) for b in blocks]
    out = np.empty((len(blocks), BLOCK), np.uint32)
    widths = np.array([h[2] for h in heads])
    for width in np.unique(widths):
        at, size = np.flatnonzero(widths == width), BLOCK // 64 * int(width)
        words = np.stack([np.frombuffer(blocks[i], "<u8", size, HEAD_SIZE) for i in at])
        out[at] = unpack(words, int(width))
    for i, (_, least, width, exceptions) in enumerate(heads):
        if exceptions:
            o = HEAD_SIZE + BLOCK // 8 * width
            out[i, np.frombuffer(blocks[i], "<u2", exceptions, o)] = np.frombuffer(blocks[i], "<u4", exceptions, o + 2 * exceptions)
        out[i] += np.uint32(least)
    return np.concatenate([row[: h[0]] for row, h in zip(out, heads)]) if blocks else np.zeros(0, np.uint32)


def _open(uri: str, write: bool):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    if write:
        files.create_dir(path.rpartition("/")[0], recursive=True)
        return files.open_output_stream(path)
    return files.open_input_file(path)


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, place: str, tokenizer: str, end: int = 1, percentile: float = 0.95, files: int | None = None) -> DataFrame:
    """Writes documents (doc_id, text) in ascending order; returns the manifest, a row for each file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uri, out = Encoder(tokenizer), f"{place}/ids-{uuid.uuid4().hex}.pfor", None
        starts, at, doc_ids, counts, kept, waiting = [], 0, [], [], [], 0

        def put(ids: np.ndarray) -> None:
            nonlocal at
            for block in encode_blocks(ids, percentile):
                starts.append(at)
                out.write(block)
                at += len(block)

        for batch in slices(batches, most=TOKEN_BYTES):
            if out is None:
                out = _open(uri, True)
                out.write(MAGIC)
                at = len(MAGIC)
            ids, offsets = with_end(*encoder.ids(batch.column("text")), end)
            doc_ids.append(batch.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy())
            counts.append(np.diff(offsets))
            kept.append(ids)
            waiting += len(ids)
            if waiting >= STEP * BLOCK:
                ids = np.concatenate(kept)
                cut = len(ids) // BLOCK * BLOCK
                for a in range(0, cut, STEP * BLOCK):
                    put(ids[a : min(cut, a + STEP * BLOCK)])
                kept, waiting = [ids[cut:]], len(ids) - cut
        if out is None:
            return
        if waiting:
            put(np.concatenate(kept))
        ids, counts = np.concatenate(doc_ids), np.concatenate(counts)
        out.write(np.array(starts, "<u8").tobytes() + ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes() + struct.pack(FOOT, at, len(starts), len(ids), int(counts.sum())))
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [uri], "n_docs": [len(ids)], "n_ids": [int(counts.sum())]})

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(files or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(task, MANIFEST), place, "manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents from the files of a manifest: where they start among all ids, how many they have, their crc32
    (and the ids themselves, in pieces of at most STEP blocks, as rows of `ids` and `piece`)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                yield from one(uri, before)

    def one(uri: str, before: int) -> Iterator[pa.RecordBatch]:
        with _open(uri, False) as f:
            assert f.read_at(len(MAGIC), 0) == MAGIC, f"{uri} is no file of this format"
            index, n_blocks, n_docs, n_ids = struct.unpack(FOOT, f.read_at(FOOT_SIZE, f.size() - FOOT_SIZE))
            tail = f.read_at(8 * (n_blocks + 2 * n_docs), index)
            starts = np.append(np.frombuffer(tail, "<u8", n_blocks), np.uint64(index)).astype(np.int64)
            doc_ids, counts = np.frombuffer(tail, "<i8", n_docs, 8 * n_blocks), np.frombuffer(tail, "<u8", n_docs, 8 * (n_blocks + n_docs)).astype(np.int64)
            ends = np.cumsum(counts)
            crc, doc, seen, rows = 0, 0, 0, ([], [], [])
            for a in range(0, n_blocks, STEP):
                b = min(n_blocks, a + STEP)
                raw = f.read_at(int(starts[b] - starts[a]), int(starts[a]))
                cuts = starts[a : b + 1] - starts[a]
                ids = decode_blocks([raw[x:y] for x, y in zip(cuts, cuts[1:])]).astype("<u4")
                place = 0
                while doc < n_docs and place < len(ids):
                    upto = min(len(ids), int(ends[doc]) - seen)
                    piece = ids[place:upto]
                    crc = zlib.crc32(piece.tobytes(), crc)
                    if with_ids:
                        rows[0].append(doc), rows[1].append(place + seen - int(ends[doc] - counts[doc])), rows[2].append(piece.tolist())
                    place = upto
                    if seen + place == ends[doc]:
                        if not with_ids:
                            rows[0].append(doc), rows[1].append(crc)
                        doc, crc = doc + 1, 0
                seen += len(ids)
                if rows[0]:
                    at = np.array(rows[0])
                    own = pa.array(doc_ids[at], mask=doc_ids[at] == np.iinfo(np.int64).min)
                    if with_ids:
                        yield pa.RecordBatch.from_pydict({"doc_id": own, "first": pa.array(rows[1], pa.int64()), "ids": pa.array(rows[2], pa.list_(pa.int64()))})
                    else:
                        yield pa.RecordBatch.from_pydict({"doc_id": own, "start": before + (ends - counts)[at], "n_tokens": counts[at], "ids_crc32": pa.array(rows[1], pa.int64())})
                    rows = ([], [], [])
            assert seen == n_ids

    spark = manifest.sparkSession
    # a row for each file, so this one window is over as many rows as there are files
    placed = manifest.withColumn("before", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("path", F.coalesce("before", F.lit(0)).alias("before")).repartition(partitions(spark), "path")
    return placed.mapInArrow(task, "doc_id long, first long, ids array<long>" if with_ids else READ)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), workspace(spark), word_path()))
