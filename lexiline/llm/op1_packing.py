"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces (only those longer than a sequence are cut). Pieces are dealt into blocks of
about `block_pieces` at random; a block is one packing problem. Every block is evolved on several
islands at once, each a task with a population and a seed of its own. A genome is a partition of
the block's pieces into bins. Crossover injects whole well-filled bins of one parent into the other, removes
the bins that hold duplicates of injected pieces, and puts the displaced pieces back by best fit, longest
first. Between epochs each island passes its elite to the next one; the best island of a block
wins. Poorly filled bins of all blocks are released and packed once more, so blocks cost next to nothing.

Only lengths travel: no task sees more than a block's lengths, the driver only counts pieces.

Null text is empty; a document without ids is the separator alone. Rows with equal doc_id are packed each.
A null doc_id stays null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline.llm.common import materialise, partitions, slices, table, workspace
from lexiline.llm.tokens import TOKEN_BYTES, Encoder, with_end, word_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids (with_ids: and the ids) of each document and its separator."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in slices(batches, most=TOKEN_BYTES):
            ids, offsets = with_end(*encoder.ids(batch.column("text")), separator)
            counts = np.diff(offsets)
            cuts = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(capacity, counts[doc] - start)
            first, raw = offsets[doc] + start, ids.astype("<u4").tobytes()
            out = {
                "doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length,
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first, first + length)], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([ids[a:b].tolist() for a, b in zip(first, first + length)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, PIECES + ", ids array<long>" * with_ids)


class Bins:
    """Bins of piece numbers with best-fit insertion: the fullest bin that still has room is one bit search away."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] = ()):
        self.sizes, self.capacity = sizes, capacity
        self.bins, self.by_room, self.mask = [], {}, 0
        for b in bins:
            self._place(b, capacity - sum(map(sizes.__getitem__, b)))

    def _place(self, b: list[int], room: int) -> None:
        if room in self.by_room and self.by_room[room]:
            self.by_room[room].append(b)
        else:
            self.by_room[room] = [b]
            self.mask |= 1 << room

    def insert(self, items: list[int]) -> None:
        sizes, by_room = self.sizes, self.by_room
        for i in items:
            size = sizes[i]
            if fits := self.mask >> size:
                room = size + (fits & -fits).bit_length() - 1
                own = by_room[room]
                b = own.pop()
                if not own:
                    self.mask ^= 1 << room
                b.append(i)
                self._place(b, room - size)
            else:
                self._place([i], self.capacity - size)

    def all(self) -> list[list[int]]:
        return [b for own in self.by_room.values() for b in own]


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more uneven filling."""
    return len(bins), -sum((sum(map(sizes.__getitem__, b)) / capacity) ** 2 for b in bins)


def crossover(into: list[list[int]], donor: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    filled = sorted(donor, key=lambda b: (-sum(map(sizes.__getitem__, b)), rng.random()))
    injected = [list(b) for b in filled[: max(1, int(len(filled) * rng.uniform(0.2, 0.6)))]]
    taken = {i for b in injected for i in b}
    stay, displaced = [], []
    for b in into:
        if taken.isdisjoint(b):
            stay.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return refit(injected + stay, displaced, sizes, capacity)


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Takes the emptiest bins and some others apart and puts their pieces back."""
    order = sorted(range(len(bins)), key=lambda k: sum(map(sizes.__getitem__, bins[k])))
    gone = {*order[:3], *rng.sample(order, min(len(order), 2 + len(order) // 20))}
    return refit([list(b) for k, b in enumerate(bins) if k not in gone], [i for k in gone for i in bins[k]], sizes, capacity)


def refit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    packed = Bins(sizes, capacity, bins)
    packed.insert(sorted(items, key=lambda i: -sizes[i]))
    return packed.all()


def evolve(sizes: list[int], capacity: int, seed: int, population: int, generations: int, immigrants: list[list[list[int]]] = ()) -> list[list[list[int]]]:
    """The population after some generations, best first; it stops at the lower bound."""
    rng, least = random.Random(seed), -(-sum(sizes) // capacity)
    score = lambda g: fitness(g, sizes, capacity)
    people = [[list(b) for b in g] for g in immigrants]
    if not people:
        people.append(refit([], list(range(len(sizes))), sizes, capacity))
    while len(people) < population and len(people[0]) > least:
        start = list(range(len(sizes)))  # longest first, but for some noise
        noisy = {i: sizes[i] * rng.uniform(0.8, 1) for i in start}
        packed = Bins(sizes, capacity)
        packed.insert(sorted(start, key=lambda i: -noisy[i]))
        people.append(packed.all())
    people.sort(key=score)
    for _ in range(generations):
        if len(people[0]) <= least:
            break
        children = []
        for _ in range(max(1, population // 2)):
            a, b = sorted(rng.sample(range(len(people)), 2)) if len(people) > 1 else (0, 0)
            children.append(mutate(crossover(people[b], people[a], sizes, capacity, rng), sizes, capacity, rng))
        people = sorted(people + children, key=score)[:population]
    return people


def _genome(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(genome: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(genome) + 1)]
    for i, k in enumerate(genome):
        out[k].append(i)
    return out


ISLAND = "block long, island int, bins int, fitness double, genomes array<array<int>>"


def _epoch(frame: DataFrame, capacity: int, epoch: int, population: int, generations: int, elite: int) -> DataFrame:
    """frame: block, island, lengths and, after the first epoch, genomes (own elite) and migrant."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                came = [_bins(g) for g in (row.get("genomes") or []) + ([row["migrant"]] if row.get("migrant") else [])]
                seed = row["block"] * 1_000_003 + row["island"] * 101 + epoch
                best = evolve(row["lengths"], capacity, seed, population, generations, came)[:elite]
                bins, score = fitness(best[0], row["lengths"], capacity)
                yield pa.RecordBatch.from_pydict({
                    "block": [row["block"]], "island": pa.array([row["island"]], pa.int32()), "bins": pa.array([bins], pa.int32()), "fitness": [score],
                    "genomes": pa.array([[_genome(g, len(row["lengths"])) for g in best]], pa.list_(pa.list_(pa.int32()))),
                })

    return frame.repartition(partitions(frame.sparkSession), "block", "island").mapInArrow(task, ISLAND)


PLACED = PIECES + ", bin int, offset long, filled long"


def _pack(cut: DataFrame, place: str, name: str, capacity: int, block_pieces: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """Pieces with block, bin, offset in the bin and filling of the bin."""
    blocks = math.ceil(max(1, cut.count()) / block_pieces)
    row = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = cut.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    problems = materialise(dealt.groupBy("block").agg(F.collect_list(row).alias("items")), place, f"{name}-blocks")
    lengths = problems.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"))
    state = materialise(_epoch(lengths, capacity, 0, population, generations, 3), place, f"{name}-epoch0")
    for epoch in range(1, epochs):
        migrants = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("genomes")[0].alias("migrant"))
        met = lengths.join(state.select("block", "island", "genomes"), ["block", "island"]).join(migrants, ["block", "island"])
        state = materialise(_epoch(met, capacity, epoch, population, generations, 3), place, f"{name}-epoch{epoch}")
    best = state.groupBy("block").agg(F.min_by(F.col("genomes")[0], F.struct("bins", "fitness", "island")).alias("genome"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column("items")[i].values
                genome, length = batch.column("genome")[i].values.to_numpy(), items.field("length").to_numpy()
                order = np.argsort(genome, kind="stable")
                ends = np.cumsum(length[order])
                new = np.concatenate([[True], np.diff(genome[order]) > 0])
                offset = ends - length[order] - (ends - length[order])[new][np.cumsum(new) - 1]
                filled = np.bincount(genome, length)[genome[order]].astype(np.int64)
                rows = items.take(pa.array(order))
                yield pa.RecordBatch.from_pydict(
                    {"block": np.full(len(order), batch.column("block")[i].as_py()), **{n: rows.field(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}, "bin": genome[order], "offset": offset, "filled": filled}
                )

    return problems.join(best, "block").select("block", "items", "genome").mapInArrow(task, "block long, " + PLACED)


def best_fit_packing(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, block_pieces: int = 4096, islands: int = 3, epochs: int = 2, population: int = 6, generations: int = 5
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document goes."""
    place = workspace(docs.sparkSession)
    cut = materialise(pieces(docs, tokenizer, capacity, separator), place, "pieces")
    whole = cut.filter(F.col("length") >= capacity)
    evolving = dict(capacity=capacity, block_pieces=block_pieces, islands=islands, epochs=epochs, population=population, generations=generations)
    first = materialise(_pack(cut.filter(F.col("length") < capacity), place, "first", **evolving), place, "placed")
    poor = F.col("filled") * 32 < 31 * capacity
    again = _pack(first.filter(poor), place, "again", **evolving)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    number = F.col("block") * (1 << 20) + F.col("bin")
    return (
        first.filter(~poor).select(*columns, (number * 3).alias("sequence_id"), "offset")
        .unionByName(again.select(*columns, (number * 3 + 1).alias("sequence_id"), "offset"))
        .unionByName(whole.select(*columns, (F.monotonically_increasing_id() * 3 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), word_path())
