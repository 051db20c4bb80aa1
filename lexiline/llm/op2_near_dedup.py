"""Near-duplicate groups by b-bit MinHash.

A document's set are the hashes of its five-word shingles. PERMUTATIONS minima of it are taken: hashes of ROWS of the first ones
each are the bands (a pair at similarity 0.75 misses all BANDS of them with a probability of 5e-6), and two bits of each minimum, mixed, are packed
into 64-bit planes. Two documents of one band bucket are compared by the number of equal two-bit minima, corrected for chance collisions;
those that may reach the threshold (all but 1e-6 of the pairs that do) are confirmed on their full sets.

Documents with equal sets are one node from the start. A bucket isn't expanded into pairs. First every node meets one other: of the hubs
of its buckets (a bucket's hub is the member that shares most buckets with others) the greatest; what is confirmed is merged. Then a bucket
whose members aren't yet in one component takes PIVOTS pivots outside its largest component, and compares them with its members of other
components. Where components are still left in one bucket after that, all outside the largest one meet the others. Both go in blocks of bounded size, by bit counts, and only
pairs that pass become rows. So no link between components is lost, and pairs within a component aren't looked at. In a comparison
the pivot's signature or text goes ahead of those of the others, once for at most HEADED of them; buckets and pivots with many members are dealt by salts.

Empty texts and null ones have no set and stand alone. A null doc_id is not linked (component null, kept). Rows of one doc_id with different
sets are nodes of their own under one name; each row is returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.llm.common import Heavy, drop, grams, hashes, materialise, mixed, partitions, slices, table, words_of, workspace
from lexiline.llm.components import components, merged

SHINGLE, PERMUTATIONS, ROWS, BANDS = 5, 1024, 4, 32
PLANES = 2 * PERMUTATIONS // 64
#: equal two-bit minima from which a pair is confirmed: at 0.75, 832 of 1024 are expected, and this is 4.8 deviations of 12.5 less
LEAST_EQUAL = 772
#: the similarity in percent that the bands and LEAST_EQUAL are made for
LEAST_THRESHOLD = 75
#: members that one copy of a pivot is sent ahead of; pivots of a bucket
HEADED, PIVOTS = 512, 4
#: sketches that a task holds, and members that it compares them with, in what the rounds leave
BLOCK, PART = 1024, 4096
#: rows (id, digest, pair) that may be broadcast, by count
BROADCAST_ROLES = 200_000
_RNG = np.random.Generator(np.random.PCG64(2))
FACTORS = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
BAND_SALTS = np.array([xxhash.xxh3_64_intdigest(b"band", i) for i in range(BANDS)], np.uint64)


def sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted different shingle hashes of each text."""
    words, offsets = words_of(texts, lower=True)
    h, out = hashes(words), []
    for a, b in zip(offsets, offsets[1:]):
        own = h[a:b]
        g = grams(own, SHINGLE) if b - a >= SHINGLE else grams(own, int(b - a), int(b - a) + 1) if b > a else own
        out.append(np.unique(g))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of the set under each permutation of 32-bit hashes."""
    x, least = (mixed(s) >> np.uint64(32)).astype(np.uint32), np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF))
    for a in range(0, len(x), 512):
        for b in range(0, PERMUTATIONS, 256):
            own = slice(b, b + 256)
            np.minimum(least[own], (FACTORS[own, None] * x[None, a : a + 512] + SHIFTS[own, None]).min(axis=1), out=least[own])
    return least


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


SKETCH = "doc_id long, n_shingles long, set_key binary, planes binary, bands array<long>"


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set), planes (b-bit minima), bands (bucket keys)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = sets(batch.column("text"))
            least = np.stack([signature(s) for s in own])
            band = np.zeros((len(own), BANDS), np.uint64)
            for r in range(ROWS):
                band = mixed(band + least[:, r : ROWS * BANDS : ROWS] + np.uint64(1))
            band = mixed(band ^ BAND_SALTS)
            # all bits of a minimum are mixed first: the low ones of FACTORS * x + SHIFTS depend on the low ones of x alone
            kept = np.stack([mixed(m.astype(np.uint64)).astype(np.uint8) for m in least])
            bits = np.stack([kept & 1, (kept >> 1) & 1], axis=1)
            planes = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS), pa.int32()), pa.array(band.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array([*map(set_key, own)], pa.binary()), pa.array([p.tobytes() for p in planes], pa.binary()), bands],
                ["doc_id", "n_shingles", "set_key", "planes", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SKETCH)


def headed(pairs: DataFrame, place: str, name: str) -> DataFrame:
    """What a comparison needs, by node: (node, a, salt, b), where b is null for the copies of a that go ahead."""
    pairs = materialise(pairs, place, name)
    # fewer than HEAVY of them can have more than a HEAVY-th of all pairs
    most = max(HEADED, pairs.count() // Heavy.HEAVY)
    heavy = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("a", F.ceil(F.col("n") / HEADED).alias("salts"))
    dealt = materialise(pairs.join(F.broadcast(heavy), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt")), place, f"{name}-dealt")
    return dealt.select(F.col("b").alias("node"), "a", "salt", "b").unionByName(dealt.select(F.col("a").alias("node"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct())


def compared(rows: DataFrame, columns: list[str], of, near) -> DataFrame:
    """The pairs (a, b) for which near(head, others) holds: rows of headed() with their node's columns, whose batches of() turns into values."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in slices(batches, columns[0]):
            values, ahead = of(batch), pc.is_null(batch.column("b")).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(ahead).tolist(), batch.num_rows]
            found = np.zeros(batch.num_rows, bool)
            for a, b in zip(cuts, cuts[1:]):
                if a < b and ahead[a]:
                    head, a = values[a] if values[a] is not None else head, a + 1
                if a < b:
                    found[a:b] = near(head, values[a:b])
            yield batch.select(["a", "b"]).filter(pa.array(found))

    dealt = rows.repartition(partitions(rows.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", *columns).mapInArrow(task, "a long, b long")


def estimated(pairs: DataFrame, planes: DataFrame, place: str, name: str) -> DataFrame:
    """The pairs whose bit count of equal two-bit minima reaches LEAST_EQUAL."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("planes").to_pylist()), np.uint64).reshape(-1, 2, PLANES // 2)

    def near(head: np.ndarray, others: np.ndarray) -> np.ndarray:
        differ = head ^ others
        return PERMUTATIONS - np.bitwise_count(differ[:, 0] | differ[:, 1]).sum(axis=1, dtype=np.int64) >= LEAST_EQUAL

    return compared(headed(pairs, place, name).join(planes, "node"), ["planes"], of, near)


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: int, place: str, name: str) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= threshold * union; nodes: node, id, set_key; docs: id, text."""

    def of(batch: pa.RecordBatch) -> list[np.ndarray | None]:
        # of several texts under one doc_id the one that the node was made of
        return [s if set_key(s) == k else None for s, k in zip(sets(batch.column("text")), batch.column("set_key").to_pylist())]

    def near(head: np.ndarray, others: list[np.ndarray | None]) -> list[bool]:
        both = [-1 if x is None else len(np.intersect1d(head, x, assume_unique=True)) for x in others]
        return [k >= 0 and 100 * k >= threshold * (len(head) + len(x) - k) for k, x in zip(both, others)]

    roles = materialise(headed(pairs, place, name).join(nodes, "node").select("id", "set_key", "a", "salt", "b"), place, f"{name}-roles")
    met = docs.join(F.broadcast(roles) if roles.count() <= BROADCAST_ROLES else roles, "id")
    return compared(met.select("text", "set_key", "a", "salt", "b"), ["text", "set_key"], of, near).distinct()


def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    turned = tried.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(tried.unionByName(turned), ["a", "b"], "left_anti")


def in_blocks(rows: DataFrame, sketches: DataFrame, pivots: int | None = None) -> DataFrame:
    """The pairs (a, b) of different components in a bucket that reach LEAST_EQUAL, each once: rows (bucket, node, c, main, m, n).

    Those outside a bucket's largest component (or as many of them as pivots says) are dealt into blocks of about BLOCK, and all members into parts of about
    PART; a task holds the sketches of one block and streams the members of a part past them. Only pairs that pass are rows."""
    outside = F.least(F.col("n") - F.col("m"), F.lit(pivots)) if pivots else F.col("n") - F.col("m")
    ahead = rows.filter("c <> main")
    if pivots:
        order = Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
        ahead = ahead.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= pivots)
    upto = lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    blocks, parts = F.ceil(outside / BLOCK), F.ceil(F.col("n") / PART)
    where = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "node"), k)
    columns = ["bucket", "node", "c", (F.col("c") == F.col("main")).alias("inside")]
    heads = ahead.select(*columns, where(1, blocks).alias("block"), F.explode(upto(parts)).alias("part"), F.lit(True).alias("head"))
    members = rows.select(*columns, F.explode(upto(blocks)).alias("block"), where(2, parts).alias("part"), F.lit(False).alias("head"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None

        def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            planes = np.frombuffer(b"".join(batch.column("planes").to_pylist()), np.uint64).reshape(-1, 2, PLANES // 2)
            bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
            return batch.column("node").to_numpy(), batch.column("c").to_numpy(), planes, bands

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "block", "part")])
            head = batch.column("head").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (head[1:] != head[:-1])) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                own, part = tuple(keys[:, x].tolist()), arrays(batch.slice(x, y - x))
                if own != key:
                    key, held, block = own, [], None
                if head[x]:
                    held.append(part)
                    continue
                block = block or tuple(np.concatenate(z) for z in zip(*held))
                inside = batch.column("inside").slice(x, y - x).to_numpy(zero_copy_only=False)
                for i in range(0, y - x, 32):  # what is compared at once is bounded
                    node, c, planes, bands = (z[i : i + 32] for z in part)
                    differ = planes[:, None] ^ block[2][None]
                    near = PERMUTATIONS - np.bitwise_count(differ[:, :, 0] | differ[:, :, 1]).sum(axis=2, dtype=np.int64) >= LEAST_EQUAL
                    near &= c[:, None] != block[1][None]
                    if not pivots:
                        near &= inside[i : i + 32, None] | (node[:, None] < block[0][None])
                    m, h = np.nonzero(near)
                    same = bands[m] == block[3][h]
                    # where all meet, a pair is taken in the first bucket that both have
                    once = (bands[m, same.argmax(axis=1)] == own[0]) | bool(pivots) if len(m) else np.zeros(0, bool)
                    if once.any():
                        yield pa.RecordBatch.from_arrays([pa.array(block[0][h[once]]), pa.array(node[m[once]])], ["a", "b"])

    dealt = heads.unionByName(members).join(sketches, "node").repartition(partitions(rows.sparkSession), "bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", F.desc("head"))
    found = dealt.select("bucket", "block", "part", "head", "node", "c", "inside", "planes", "bands").mapInArrow(task, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct() if pivots else found


def near_duplicates(docs: DataFrame, threshold: int = LEAST_THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. Bands and the cut-off of estimates are made for LEAST_THRESHOLD and find all links above it too; a lower threshold is refused."""
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"links below {LEAST_THRESHOLD} % would be lost")
    place = workspace(docs.sparkSession)
    sketched = materialise(sketch(docs), place, "sketch")
    source = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    # equal sets are linked: they are one node, named by its smallest doc_id
    full = sketched.filter("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy("set_key").agg(F.min("doc_id").alias("id")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes, place, "nodes")
    first = full.join(nodes.withColumnsRenamed({"id": "doc_id"}), ["set_key", "doc_id"]).select("node", "planes", "bands")
    first = materialise(first.dropDuplicates(["node"]), place, "first")
    planes, banded = first.select("node", "planes"), first.select("node", F.explode("bands").alias("bucket"))
    # buckets of one node are nothing to look at again
    sizes = materialise(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), place, "sizes")
    buckets = Heavy(sizes, "bucket", BANDS * nodes.count(), place)
    shared = materialise(buckets.join(banded, sizes, "node"), place, "shared")

    weight = materialise(shared.groupBy("node").agg(F.sum("n").alias("weight")), place, "weight")
    rank = F.struct("weight", "node").alias("hub")
    hubs = shared.join(weight, "node").groupBy("bucket").agg(F.max(rank).alias("hub"))
    stars = buckets.join(shared.select("bucket", "node"), hubs, "node").filter("hub.node <> node").groupBy("node").agg(F.max("hub").alias("hub"))
    tried = materialise(estimated(stars.select(F.col("hub.node").alias("a"), F.col("node").alias("b")), planes, place, "stars"), place, "tried0")
    links = materialise(confirmed(tried, source, nodes, threshold, place, "met0"), place, "links0")
    # links lead from greater hubs to lesser ones, so what they lead to has no cycles
    found = components(links, place, "round0", led=True)

    def open_buckets(name: str) -> DataFrame:
        """(bucket, node, c, main, m, n) of buckets with several components: their largest one, its members and all."""
        labelled = shared.select("bucket", "node").join(found.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
        state = labelled.groupBy("bucket", "c").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("n"))
        return materialise(buckets.join(labelled, materialise(state.filter("m < n"), place, f"{name}-left"), "node"), place, name)

    def met(fresh: DataFrame, name: str) -> DataFrame:
        """The components after those of the candidate pairs that are links."""
        return found if fresh.isEmpty() else merged(found, materialise(confirmed(fresh, source, nodes, threshold, place, f"{name}-met"), place, f"{name}-links"), place, f"{name}-round")

    some = open_buckets("open1")
    if not some.isEmpty():
        fresh = materialise(untried(in_blocks(some, first, PIVOTS), tried), place, "tried1")
        tried, found = tried.unionByName(fresh), met(fresh, "some")
        rest = open_buckets("open2")
        if not rest.isEmpty():
            found = met(materialise(untried(in_blocks(rest, first), tried), place, "tried2"), "rest")
    least = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select("set_key", "id", F.coalesce("component", "node").alias("root"))
    names = materialise(least.groupBy("root").agg(F.min("id").alias("component_id")), place, "names")
    named = materialise(least.join(names, "root").select("set_key", "component_id"), place, "named")
    # rows without a set have a key of their own, by which they are dealt
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")).otherwise(F.unhex(F.sha1(F.coalesce(F.col("doc_id"), F.rand() * (1 << 52)).cast("string"))))
    out = sketched.select("doc_id", "n_shingles", own.alias("set_key")).join(named, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    out = materialise(out, workspace(docs.sparkSession), "groups")
    drop(place, docs.sparkSession, "")
    return out


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: CTEs from docs (doc_id, text) to neardup (the columns of near_duplicates)
def neardup_sql(docs: str) -> str:
    return rf"""
nw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM {docs}),
sh AS (SELECT DISTINCT doc_id, hash(w[i:i + 4], len(w[i:i + 4])) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM nw WHERE len(w) > 0)),
ns AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
ov AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
ed AS (SELECT a, b FROM ov JOIN ns x ON x.doc_id = a JOIN ns y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e2 AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
rc AS (SELECT DISTINCT a AS id, a AS r FROM e2 UNION SELECT rc.id, e2.b FROM rc JOIN e2 ON rc.r = e2.a),
cc AS (SELECT id, min(r) AS c FROM rc GROUP BY 1),
neardup AS (SELECT nw.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, nw.doc_id) AS component_id, coalesce(c, nw.doc_id) = nw.doc_id AS kept
  FROM nw LEFT JOIN ns USING (doc_id) LEFT JOIN cc ON cc.id = nw.doc_id)
"""


ORACLE_SQL = f"WITH RECURSIVE {neardup_sql('documents')} SELECT doc_id, n_shingles, component_id, kept FROM neardup"
