"""Spelling variants by full neighbourhood generation.

Words are maximal runs of letters, A-Z in lower case, one in `every` of them with a letter knocked out by a hash; of those, the ones of
`shortest` code points and `rarest` occurrences at least. Each word gives all its different deletions, replacements and insertions over the
letters that the vocabulary has: a deletion counts at the first place of a run of equal letters, an insertion never after the same letter, so
that no candidate comes twice. Candidates are hash-joined to the vocabulary; what is in it is near, and no distance is computed.

Candidates (some 800 for each word) don't travel. A word is cut into segments of at most SEGMENT letters, and an edit within one leaves all the
others as they are. So the candidates of a segment are made where all words lie that agree with it outside that segment, in its own
length, one less or one more: a word is shuffled some 3 L / SEGMENT times, as itself. Such a group has A + ... + A^(SEGMENT+1) words at most
(A letters: 70,000 for 41), whatever the corpus, and a task holds a few groups at a time. Matches of 64-bit hashes are compared as strings.

Words are counted in each task, in a bounded table, before they are shuffled. Forms lead to words at least twice as frequent, so that chains
have no cycles and pointer doubling ends after a few rounds; targets that very many words share are dealt by salts.

A null text has no words, a null doc_id is hashed as nothing before the colon, rows of one doc_id are counted each, an empty table
gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline.llm.common import Heavy, drop, materialise, mixed, slices, table, workspace

LETTERS = "A-Za-zÀ-ÿ"
#: letters of a segment
SEGMENT = 2
#: different words that a task counts at once
MOST_COUNTED = 200_000
#: rows of groups that a task holds at once, and words that it makes candidates of at once
GROUP_ROWS, STEP_WORDS = 100_000, 8192
BASE = 0x9E3779B97F4A7C15


def vocabulary(docs: DataFrame, every: int = 97, shortest: int = 5, rarest: int = 3) -> DataFrame:
    """(word, n) of all texts."""
    find = re.compile(f"[{LETTERS}]+").findall

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        give = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        for batch in slices(batches):
            ids = ["" if d is None else str(d) for d in batch.column("doc_id").to_pylist()]
            for doc, text in zip(ids, pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.string()), "")).to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(find(text)).items():
                    if not (h := zlib.crc32(word.encode(), start)) % every:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= MOST_COUNTED:
                    yield give()
                    counts.clear()
        yield give()

    found = docs.select("doc_id", "text").mapInArrow(task, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def bounds(length: int) -> list[int]:
    """Where the segments of a word of this length begin, and its end."""
    k = -(-length // SEGMENT)
    return [j * length // k for j in range(k + 1)]


def _blocks(words: DataFrame) -> DataFrame:
    """(block, word, n, own segment or null): a row for each segment of words of the length, one less and one more. Words agree with
    a block in its length, its segment, and all letters outside it."""
    size = F.char_length("word")

    def of(more: int) -> Column:
        length = size + more
        k = F.ceil(length / SEGMENT).cast("int")
        cut = lambda j: F.floor(j * length / k).cast("int")
        segment = lambda j: F.struct(
            F.xxhash64(length, j, F.substring("word", F.lit(1), cut(j)), F.substring("word", size - (length - cut(j + 1)) + 1, length - cut(j + 1))).alias("block"), (j if not more else F.lit(None).cast("int")).alias("own")
        )
        return F.transform(F.sequence(F.lit(0), k - 1), segment)

    return words.select("word", "n", F.explode(F.concat(*[F.when(size + more > 0, of(more)).otherwise(F.array()) for more in (-1, 0, 1)])).alias("x")).select("x.block", "word", "n", "x.own")


class Neighbourhood:
    """All different single edits of words over an alphabet, as hashes."""

    def __init__(self, letters: str):
        self.letters = letters
        codes = np.array([ord(c) for c in letters], np.int64)
        self.code = mixed(codes.astype(np.uint64) + np.uint64(1))
        self.codes = codes
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(1 << 12, BASE, np.uint64)]), dtype=np.uint64)

    def powers(self, n: int) -> np.ndarray:
        if n > len(self.power):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, BASE, np.uint64)]), dtype=np.uint64)
        return self.power

    def matrix(self, words: list[str]) -> np.ndarray:
        """Code points of words of one length, a row each."""
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.int64)

    def hashed(self, w: np.ndarray) -> np.ndarray:
        return (mixed(w.astype(np.uint64) + np.uint64(1)) * self.powers(w.shape[1])[: w.shape[1]]).sum(axis=1, dtype=np.uint64)

    def edits(self, w: np.ndarray, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, str, int]]:
        """(hashes, which of them count, kind, place) of the edits at the places from first to before last, and of insertions at the end."""
        length, power = w.shape[1], self.powers(w.shape[1] + 1)
        term = mixed(w.astype(np.uint64) + np.uint64(1))
        before = np.concatenate([np.zeros((len(w), 1), np.uint64), np.cumsum(term * power[:length], axis=1, dtype=np.uint64)], axis=1)
        total = before[:, -1]
        # what follows a place, moved one to the left or to the right
        after = np.concatenate([np.cumsum((term * power[1 : length + 1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((len(w), 1), np.uint64)], axis=1)
        nearer = np.zeros((len(w), length + 1), np.uint64)
        if length > 1:
            nearer[:, 1:length] = np.cumsum((term[:, 1:] * power[: length - 1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        for i in range(first, last + (last == length)):
            if i < length:
                fresh = np.ones(len(w), bool) if not i else w[:, i] != w[:, i - 1]
                yield (before[:, i] + nearer[:, i + 1])[:, None], fresh[:, None], "delete", i
                yield (total - term[:, i] * power[i])[:, None] + self.code * power[i], w[:, i, None] != self.codes, "replace", i
            apart = np.ones((len(w), len(self.codes)), bool) if not i else w[:, i - 1, None] != self.codes
            yield (before[:, i] + after[:, i])[:, None] + self.code * power[i], apart, "insert", i

    def spelt(self, word: str, kind: str, i: int, letter: int) -> str:
        return word[:i] + ("" if kind == "delete" else self.letters[letter]) + word[i + (kind != "insert") :]


PAIRS = "word string, near string, near_n long"


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each ordered pair of words that differ by one edit, once. words: (word, n), each word once."""
    letters = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]))  # an alphabet

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Neighbourhood(letters)
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= GROUP_ROWS:
                held = pa.Table.from_batches(waiting).combine_chunks()
                block = held.column("block").to_numpy()
                if block[0] != block[-1]:
                    cut = int(np.flatnonzero(block != block[-1])[-1]) + 1  # groups stay whole
                    yield from matched(made, held.slice(0, cut))
                    held = held.slice(cut).combine_chunks()
                waiting, rows = held.to_batches(), held.num_rows
        if rows:
            yield from matched(made, pa.Table.from_batches(waiting).combine_chunks())

    def matched(made: Neighbourhood, held: pa.Table) -> Iterator[pa.RecordBatch]:
        text, n, own = held.column("word").to_pylist(), held.column("n").to_numpy(), pc.fill_null(held.column("own"), -1).to_numpy()
        size = np.fromiter(map(len, text), np.int64, len(text))
        # the vocabulary of these groups: hashes in order, and a table of bits that most candidates don't pass
        known = np.array(list({w: i for i, w in enumerate(text)}.values()), np.int64)
        value = np.empty(len(known), np.uint64)
        for length in np.unique(size[known]):
            at = np.flatnonzero(size[known] == length)
            value[at] = made.hashed(made.matrix([text[i] for i in known[at]]))
        order = np.argsort(value)
        value, known = value[order], known[order]
        width = np.uint64(64 - max(16, int(len(known)).bit_length() + 6))
        bits = np.zeros(1 << int(64 - width), bool)
        bits[mixed(value) >> width] = True
        out: tuple[list, list, list] = ([], [], [])
        for length in np.unique(size[own >= 0]):
            edge = bounds(int(length))
            for j in range(len(edge) - 1):
                mine = np.flatnonzero((own == j) & (size == length))
                for a in range(0, len(mine), STEP_WORDS):
                    some = mine[a : a + STEP_WORDS]
                    w = made.matrix([text[i] for i in some])
                    for hashed, counts, kind, place in made.edits(w, edge[j], edge[j + 1]):
                        row, letter = np.nonzero(bits[mixed(hashed) >> width] & counts)
                        found = hashed[row, letter]
                        at = np.minimum(np.searchsorted(value, found), len(value) - 1)
                        for r, c, k in zip(*(x[value[at] == found].tolist() for x in (row, letter, at))):
                            word, near = text[some[r]], text[known[k]]
                            if made.spelt(word, kind, place, c) == near:
                                out[0].append(word), out[1].append(near), out[2].append(n[known[k]])
        yield pa.RecordBatch.from_pydict({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})

    return _blocks(words).repartition("block").sortWithinPartitions("block").mapInArrow(task, PAIRS)


def roots(forms: DataFrame, place: str) -> DataFrame:
    """(word, root) of the words that have a form (word, form): where following forms ends, by pointer doubling."""
    spark = forms.sparkSession
    hops = materialise(forms.select("word", F.col("form").alias("to")), place, "hops0")
    entries, k = hops.count(), 0
    while True:
        sizes = hops.groupBy("to").agg(F.count("*").alias("n"))
        heavy = Heavy(sizes, "to", entries, f"{place}/round{k}")
        moved = heavy.join(hops, hops.select(F.col("word").alias("to"), F.col("to").alias("next")), "word", "left")
        after = materialise(moved.select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), place, f"hops{k + 1}")
        drop(place, spark, f"hops{k}", f"round{k}")
        hops, k = after.select("word", "to"), k + 1
        if after.filter("moved").isEmpty():
            return hops.withColumnRenamed("to", "root")


def spelling_variants(words: DataFrame, place: str) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = materialise(near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best), place, "near")
    strong = -F.col("best.less") >= 2 * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    formed = materialise(formed, place, "formed")
    found = roots(formed.filter("form is not null").select("word", "form"), place)
    return formed.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = workspace(spark)
    words = materialise(vocabulary(table(spark, sf_dir, "documents")), place, "words")
    return spelling_variants(words, place).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 by its table; near words by what is left after one letter is taken out, another way than that of the plan
ORACLE_SQL = """WITH RECURSIVE
tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
low AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY ALL),
hx AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM low),
bt AS (SELECT w, n, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM hx),
cr AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1]))) AS h FROM bt, tbl),
sp AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM cr),
v AS (SELECT word, sum(n)::BIGINT AS n FROM sp WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT del.word, v.word AS near FROM del JOIN v ON v.word = del.d),
pairs AS (SELECT word, near FROM shorter UNION ALL SELECT near, word FROM shorter
  UNION ALL SELECT a.word, b.word FROM del a JOIN del b ON a.i = b.i AND a.d = b.d AND a.word <> b.word),
best AS (SELECT p.word, p.near, v.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, encode(p.near)) AS k, count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN v ON v.word = p.near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND k = 1),
walk AS (SELECT word, coalesce(form, word) AS top, form IS NULL AS done FROM f UNION ALL SELECT walk.word, coalesce(f.form, f.word), f.form IS NULL FROM walk JOIN f ON f.word = walk.top WHERE NOT done)
SELECT f.word, form, walk.top AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND done"""
