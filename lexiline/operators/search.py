"""Finding words and phrases in transcripts: many queries in one pass over the words.

Texts are compared in compatibility form and lower case, so that full-width letters, ligatures and composed letters agree. A query matches each word that contains
it whole, signs included, and, if it has two terms or more, each place where its terms stand in a row, whatever signs or white space lie between them: within a word, across words,
overlapping. Both are found by automata over all queries at once: one reads letters of words, one reads terms, and neither goes back.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiline.sources.timeline import WORDS_SQL, words

#: what a query's ends are stripped of (fixed value: white space and line ends of the query's language)
EDGE = "\t\n\v\f\r                  　﻿"
TERM = r"[\p{L}\p{M}\p{N}]+"
#: different words whose hits a task keeps
MOST_WORDS = 200_000


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves letters apart that should be composed
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normal(c: Column | str) -> Column:
    """A text in compatibility form and lower case."""
    return F.lower(_nfkc(c))


def terms(c: Column) -> Column:
    """Runs of letters, marks and numbers of a normal text."""
    return F.regexp_extract_all(c, F.lit(TERM), F.lit(0))


def _normal(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def _terms(text: str) -> list[str]:
    import regex

    return regex.findall(TERM, text)


class Automaton:
    """All places where sequences end in a stream of symbols. State 0 is the start; a state stands for the longest suffix that begins a sequence."""

    def __init__(self, sequences: Iterable[tuple[Hashable, Iterable[Hashable]]]):
        self.to: list[dict] = [{}]
        self.back, self.ends = [0], [[]]
        for name, symbols in sequences:
            at = 0
            for x in symbols:
                if x not in self.to[at]:
                    self.to[at][x] = len(self.to)
                    self.to.append({}), self.back.append(0), self.ends.append([])
                at = self.to[at][x]
            if at:
                self.ends[at].append(name)
        row = deque(self.to[0].values())
        while row:
            at = row.popleft()
            for x, child in self.to[at].items():
                self.back[child] = self.step(self.back[at], x)
                self.ends[child] += self.ends[self.back[child]]
                row.append(child)

    def step(self, state: int, x: Hashable) -> int:
        while state and x not in self.to[state]:
            state = self.back[state]
        return self.to[state].get(x, 0)


def find_matches(w: DataFrame, queries: dict[int, str]) -> DataFrame:
    """(source_id, query_id, first_word, last_word) of words (source_id, ord, text), each once.

    A query that is blank finds nothing; a word without text is empty; words without source_id are one source. Queries go to each task, so they are as many as a
    user's list holds; words of a source are read in order by one task with a state of a few terms."""
    wanted = {q: (_normal(t.strip(EDGE)), _terms(_normal(t))) for q, t in queries.items()}
    wanted = {q: (needle, t) for q, (needle, t) in wanted.items() if needle}
    letters = Automaton((q, needle) for q, (needle, _) in wanted.items())
    phrases = Automaton((q, t) for q, (_, t) in wanted.items() if len(t) > 1)
    size = {q: len(t) for q, (_, t) in wanted.items()}
    longest = max(size.values(), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        source, state, places, begun = None, 0, deque(maxlen=longest), False
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, ord_, text, own in zip(*(batch.column(c).to_pylist() for c in ("source_id", "ord", "norm", "terms"))):
                if not begun or key != source:
                    source, state, begun = key, 0, True
                    places.clear()
                hits = known.get(text)
                if hits is None:
                    at, found = 0, {}
                    for x in text:
                        at = letters.step(at, x)
                        for q in letters.ends[at]:
                            found[q] = True
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    hits = known[text] = list(found)
                here = dict.fromkeys((q, ord_) for q in hits)  # all that end at this word, each once
                for term in own:
                    places.append(ord_)
                    state = phrases.step(state, term)
                    for q in phrases.ends[state]:
                        here[q, places[-size[q]]] = None
                for q, first in here:
                    out[0].append(key), out[1].append(q), out[2].append(first), out[3].append(ord_)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip(("source_id", "query_id", "first_word", "last_word"), out)})

    rows = w.select(F.col("source_id").cast("long").alias("source_id"), F.col("ord").cast("long").alias("ord"), normal(F.coalesce("text", F.lit(""))).alias("norm")).withColumn("terms", terms(F.col("norm")))
    return rows.repartition("source_id").sortWithinPartitions("source_id", "ord").mapInArrow(run, "source_id long, query_id long, first_word long, last_word long")


# ---- queries -------------------------------------------------------------------------------------------------

PLAIN, WIDE = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26))
#: the stated queries: parts of words, signs, phrases of two to five terms, repeated terms, full-width letters and a ligature, a blank one
FOUND = {0: "TION", 1: "the and", 2: "of  the", 3: "-", 4: " 　", 5: "to be—to", 6: "ｔｈｅ", 7: "ﬁ", 8: "de la de", 9: "a a", 10: "in the", 11: ", the", 12: "and in the of a"}


def _typeset(c: Column | str) -> Column:
    """Every fifth word in full-width letters, and ligatures in every third."""
    ligature = F.when(F.col("ord") % 3 == 1, F.replace(c, F.lit("fi"), F.lit("ﬁ"))).otherwise(c)
    return F.when(F.col("ord") % 5 == 2, F.translate(c, PLAIN, WIDE)).otherwise(ligature)


QUERIES = {"f4_matches": lambda s, d: find_matches(words(s, d).withColumn("text", _typeset(F.col("text"))), FOUND)}
_NEEDLES = ", ".join(f"({q}, '{n}')" for q, t in FOUND.items() if (n := _normal(t.strip(EDGE))))
ORACLES = {
    # typesetting is undone by hand: what is left is lower case
    "f4_matches": f"""WITH {WORDS_SQL}, w AS (SELECT source_id, ord, lower(translate(replace(CASE WHEN ord % 5 = 2 THEN translate(text, '{PLAIN}', '{WIDE}') WHEN ord % 3 = 1 THEN replace(text, 'fi', 'ﬁ') ELSE text END, 'ﬁ', 'fi'), '{WIDE}', '{PLAIN}')) AS t FROM words),
q(query_id, needle) AS (VALUES {_NEEDLES}), qt AS (SELECT query_id, regexp_extract_all(needle, '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS ts FROM q),
tk AS (SELECT source_id, ord, x, row_number() OVER (PARTITION BY source_id ORDER BY ord, i) AS k FROM (SELECT source_id, ord, unnest(ts) AS x, generate_subscripts(ts, 1) AS i FROM (SELECT source_id, ord, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS ts FROM w))),
p AS (SELECT query_id, len(ts) AS n, unnest(ts) AS x, generate_subscripts(ts, 1) AS i FROM qt WHERE len(ts) > 1),
m AS (SELECT tk.source_id, query_id, n, k - i AS at, min(ord) AS first_word, max(ord) AS last_word, count(*) AS c FROM tk JOIN p ON p.x = tk.x GROUP BY ALL)
SELECT source_id, query_id, ord AS first_word, ord AS last_word FROM w JOIN q ON contains(t, needle) UNION SELECT source_id, query_id, first_word, last_word FROM m WHERE c = n"""
}
