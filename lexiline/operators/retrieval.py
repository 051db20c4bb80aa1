"""Text retrieval: tokens, keywords, previews, BM25, hybrid search, phrase matching, paging and retained windows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.segment import GRID_SQL, sentence_grid
from lexiline.plans.ordered import page
from lexiline.plans.shared import stored
from lexiline.sources.timeline import UNITS_SQL, WORDS_SQL, by_source, table, units, words

# fixed values: ranking constants, and function words that are no keywords
K1, B, VECTOR_WEIGHT, TEXT_WEIGHT = 1.2, 0.75, 0.65, 0.35
STOP = tuple(
    """
    a an and are as at be but by for from had has have he her his i if in is it
    its me my not of on or our she so that the their them then there they this to us was we
    were what when where which who will with you your
    """.split()
)
TOKEN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"
PAGE_CHARS, FRAGMENT_CHARS = 16_000, 2000
KEEP_ROWS, KEEP_CHARS = 320, 4000
VECTOR_BLOCK, QUERY_BLOCK = 8192, 4096


def tokens(c: Column) -> Column:
    """Lower-case tokens of more than one character that aren't function words."""
    all_ = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(all_, lambda t: (F.length(t) > 1) & ~t.isin(*STOP))


def keywords(d: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """The most frequent tokens of each key, of equal ones the first in order."""
    n = d.select(key, F.explode(tokens(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word")).cast("long")).filter(F.col("rank") <= top)


def preview(g: DataFrame, chars: int = 240) -> DataFrame:
    """First, middle and last sentence of each source, cut, each once."""
    w = Window.partitionBy("source_id")
    p = g.withColumns({"n": F.count("*").over(w)}).filter("sentence_id in (0, n div 2, n - 1)")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", "text"))), lambda x: F.substring(x["text"], 1, chars))
    return p.groupBy("source_id").agg(F.array_join(texts, " ... ").alias("preview"))


def bm25(d: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """Scores of documents for queries (query_id, query), a query being a set of terms. Term tables are joined, no document is broadcast."""
    t = d.select(F.col(key), F.explode(tokens(F.col(text))).alias("term"))
    size = d.select(F.col(key), F.size(tokens(F.col(text))).alias("len"))
    total = size.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))  # one row
    tf = t.groupBy(key, "term").agg(F.count("*").alias("tf"))
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    wanted = tf.join(q.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    j = q.join(wanted, "term").join(df, "term").join(size, key).crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return j.groupBy("query_id", key).agg(F.round(F.sum(s), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _nearest(vectors: DataFrame, query_vectors: DataFrame, keep: int) -> DataFrame:
    """Pairs (query_id, id) among which are those that come first, up to `keep` for each query, by their score without text and by id; vectors are of one length and finite.

    Blocks of vectors meet blocks of queries, which bounds what a task holds, and each pair of blocks is a product of matrices. A sum in another order may round to the next step, so a pair has a least and a
    greatest step; it goes only if `keep` others of its query are ahead whatever their steps are. The pairs that stay are scored again by the caller."""
    n_v, n_q = max(1, -(-vectors.count() // VECTOR_BLOCK)), max(1, -(-query_vectors.count() // QUERY_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("id", "vec", block("id", n_v).alias("vb"), every(n_q).alias("qb"))
    q = query_vectors.select("query_id", "query_vec", block("query_id", n_q).alias("qb"), every(n_v).alias("vb"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]]
        if left.num_rows and right.num_rows:
            flat = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
            ids, queries = left.column("id").to_numpy(), right.column("query_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, vs, qs = ids[order], flat(left.column("vec"))[order], flat(right.column("query_vec"))
            longest = np.sqrt((vs * vs).sum(1)).max()
            for at in range(0, len(qs), 256):
                some = qs[at : at + 256]
                off = 1e-6 + 1e-11 * len(vs[0]) * (1 + np.sqrt((some * some).sum(1)) * longest)[:, None]
                x = 10_000 * VECTOR_WEIGHT * (some @ vs.T + 1) / 2 + 0.5
                low, high = np.floor(x - off), np.floor(x + off)
                least = np.partition(low, -keep, axis=1)[:, -keep, None] if len(ids) > keep else np.full((len(some), 1), -np.inf)
                even = (high == least) & (low == least)
                r, c = np.nonzero((high >= least) & (~even | (np.cumsum(even, axis=1) <= keep)))
                for column, values in zip(out, (queries[at + r], ids[c], low[r, c], high[r, c])):
                    column.append(values)
        return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "id", "low", "high"), out)})

    met = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInArrow(best, "query_id long, id long, low double, high double")
    w = Window.partitionBy("query_id")
    met = met.withColumn("n", F.row_number().over(w.orderBy(F.desc("low")))).withColumn("least", F.coalesce(F.max(F.when(F.col("n") == keep, F.col("low"))).over(w), F.lit(float("-inf")))).filter("high >= least")
    even = F.expr("high = least and low = least")
    ahead = F.row_number().over(Window.partitionBy("query_id", even).orderBy("id"))
    return met.withColumn("ahead", ahead).filter(~even | (F.col("ahead") <= keep)).select("query_id", "id").distinct()


def hybrid(text_scores: DataFrame, vectors: DataFrame, query_vectors: DataFrame, cursor: int = 0, limit: int = 16) -> DataFrame:
    """0.65 of the cosine moved to [0, 1] and 0.35 of the text score over the query's best, ranked, one page. Text scores aren't negative; ids are whole numbers.

    Pairs with a text score are all scored. Of the others, those that can't come onto the page are left out before: what a text score adds to a pair ahead of them only puts it further ahead."""
    text_pairs = text_scores.select("query_id", "id")
    first = query_vectors.filter("query_vec is not null").select(F.size("query_vec").alias("n")).first()
    plain = lambda i, c: F.coalesce(F.col(i).isNotNull() & (F.size(c) == (first["n"] if first else 0)) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))
    whole, asked = plain("id", "vec"), plain("query_id", "query_vec")
    v, q = vectors.filter(whole), query_vectors.filter(asked)
    pairs = _nearest(v, q, cursor + limit).unionByName(text_pairs.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"))).distinct()
    scored = [pairs.join(q, "query_id").join(v, "id")]
    # vectors with nulls, of another length or not finite, with every query; and such queries with the others
    scored += [vectors.filter(~whole).crossJoin(query_vectors), v.crossJoin(query_vectors.filter(~asked))]
    cos = reduce(DataFrame.unionByName, [x.select("query_id", "id", dot(F.col("vec"), F.col("query_vec")).alias("cos")) for x in scored])
    best = text_scores.groupBy("query_id").agg(F.max("score").alias("top"))
    j = cos.join(text_scores, ["query_id", "id"], "left").join(best, "query_id", "left")
    text = F.coalesce("score", F.lit(0.0)) / F.when(F.coalesce("top", F.lit(0.0)) > 0, F.col("top")).otherwise(1.0)
    ranked = j.select("query_id", "id", F.round(VECTOR_WEIGHT * (F.col("cos") + 1) / 2 + TEXT_WEIGHT * text, 4).alias("score"))
    return page(ranked, ["query_id"], [F.desc("score"), "id"], cursor, limit)


def phrase_matches(w: DataFrame, terms: list[str]) -> DataFrame:
    """Places where the terms stand in a row; overlapping ones count."""
    o = by_source()
    clean = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    t = w.withColumn("t", clean)
    hit = t.withColumns({f"t{i}": F.lead("t", i).over(o) for i in range(1, len(terms))})
    cond = F.col("t") == terms[0]
    for i in range(1, len(terms)):
        cond = cond & (F.col(f"t{i}") == terms[i])
    return hit.filter(cond).select("source_id", "ord", "start_ms")


def word_matches(w: DataFrame, part: str) -> DataFrame:
    return w.filter(F.contains(F.lower("text"), F.lit(part))).select("source_id", "ord", "text")


def sentence_ends(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"[.!?](?:\s|\z)"), F.lit(0))).cast("long")


def budget_page(g: DataFrame, first: int, budget: int = PAGE_CHARS) -> DataFrame:
    """Sentences from `first` on while their characters fit the budget, one at least."""
    n = F.sum(F.length("text")).over(by_source("sentence_id").rowsBetween(Window.unboundedPreceding, 0))
    r = F.row_number().over(by_source("sentence_id"))
    return g.filter(F.col("sentence_id") >= first).withColumns({"run": n, "rn": r}).filter((F.col("run") <= budget) | (F.col("rn") == 1)).select("source_id", "sentence_id", F.col("run").cast("long").alias("run"))


def fragments(d: DataFrame, key: str, text: str, chars: int = FRAGMENT_CHARS) -> DataFrame:
    """Long texts in fragments with the hash of each."""
    f = d.select(key, text, F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(chars))).alias("at")).withColumn("part", F.col(text).substr(F.col("at") + 1, F.lit(chars)))
    return f.select(key, F.col("at").cast("long").alias("at"), F.length("part").cast("long").alias("length"), F.sha2("part", 256).alias("sha256"))


def retained(reads: DataFrame, rows: int = KEEP_ROWS, chars: int = KEEP_CHARS) -> DataFrame:
    """What a reader still holds: last reads, newest first, while counts and characters stay within bounds. Evicting the oldest
    until all bounds hold leaves the longest suffix that fits, so reverse running sums decide it."""
    last = reads.groupBy("source_id", "id").agg(F.max("seq").alias("seq"), F.max_by("len", "seq").alias("len"))
    w = Window.partitionBy("source_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumns({"n": F.count("*").over(w), "c": F.sum("len").over(w)}).filter((F.col("n") <= rows) & (F.col("c") <= chars)).select("source_id", "id", "seq")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def capped(c: DataFrame, key: str, kind: str, cost: str, ident: str, cap: int) -> DataFrame:
    """At most `cap` rows of each key, cheapest first, but the cheapest safe row of each kind stays in any case."""
    safe = F.row_number().over(Window.partitionBy(key, kind).orderBy(F.desc("safe"), cost, ident))
    first = c.withColumn("must", (safe == 1) & F.col("safe"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("must"), cost, ident))
    return first.withColumn("rank", rank).filter(F.col("rank") <= cap).select(key, ident, F.col("rank").cast("long").alias("rank"))


# ---- queries -----------------------------------------------------------------------------------------------

def _corpus(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _hybrid(s, d, which="{} < 20"):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    # the stated query set: the first twenty items, or those that which takes, each with the vector of its own id
    q = v.filter(which.format("id")).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    t = bm25(_corpus(s, d), "doc_id", "text", _queries(s, d).filter(which.format("query_id"))).select("query_id", F.col("doc_id").alias("id"), "score")
    # read three times, and the texts are cut into tokens for each
    return hybrid(stored(t, "text_scores"), v, q)


def _reads(s, d):
    return words(s, d).select("source_id", (F.col("ord") * 7 % 400).alias("id"), F.col("ord").alias("seq"), F.length("text").cast("long").alias("len"))


_STOP = ", ".join(f"'{w}'" for w in STOP)
_TOK = lambda c: rf"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}\p{{N}}]+)?'), lambda t: lower(t)), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
_BM25 = f"""dt AS (SELECT doc_id, {_TOK('text')} AS ts FROM documents), sz AS (SELECT doc_id, len(ts) AS len FROM dt), tot AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM sz), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM dt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT item_id AS query_id, unnest(list_distinct({_TOK('text')})) AS term FROM benchmark), bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN sz USING (doc_id), tot GROUP BY ALL)"""
QUERIES = {
    "f1_tokens": lambda s, d: _corpus(s, d).select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(tokens(F.col("text")), " ")).alias("hash")),
    "e3_keywords": lambda s, d: keywords(_corpus(s, d), "doc_id", "text"),
    "e4_preview": lambda s, d: preview(sentence_grid(words(s, d))),
    "f2_bm25": lambda s, d: bm25(_corpus(s, d), "doc_id", "text", _queries(s, d)),
    "f3_hybrid_search": _hybrid,
    "f3_hybrid_search_all": lambda s, d: _hybrid(s, d, "{} % 50 = 0"),
    "f4_phrase_matches": lambda s, d: phrase_matches(words(s, d), ["the", "and"]),
    "f4_word_matches": lambda s, d: word_matches(words(s, d), "tion"),
    "f5_cosine": lambda s, d: (lambda u: u.join(u.select(F.col("source_id").alias("sb"), F.col("ord").alias("ob"), F.col("vec").alias("vb")), (F.col("source_id") == F.col("sb")) & (F.col("ord") + 1 == F.col("ob"))).select("source_id", "ord", F.round(dot(F.col("vec"), F.col("vb")), 6).alias("cos")))(units(s, d)),
    "f6_sentence_ends": lambda s, d: _corpus(s, d).select("doc_id", sentence_ends(F.col("text")).alias("n")),
    "l1_cursor_page": lambda s, d: page(sentence_grid(words(s, d)).select("source_id", "sentence_id", "word_count"), ["source_id"], [F.desc("word_count"), "sentence_id"], 5, 12).select("source_id", "sentence_id", F.col("position").cast("long").alias("position")),
    "l2_budget_page": lambda s, d: budget_page(sentence_grid(words(s, d)), 3, 500),
    "l2_fragments": lambda s, d: fragments(_corpus(s, d), "doc_id", "text"),
    "l4_capped_candidates": lambda s, d: capped(table(s, d, "events").select("user_id", "event_id", "event_type", F.floor("value").alias("cost"), (F.col("event_id") % 3 == 0).alias("safe")), "user_id", "event_type", "cost", "event_id", 8),
    "l5_latest_row": lambda s, d: latest(table(s, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("event_id")]),
    "l6_retained_window": lambda s, d: retained(_reads(s, d), 100, 500),
}
ORACLES = {
    "f1_tokens": f"SELECT doc_id, len(ts) AS n, md5(array_to_string(ts, ' ')) AS hash FROM (SELECT doc_id, {_TOK('text')} AS ts FROM documents)",
    "e3_keywords": f"WITH n AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_TOK('text')}) AS word FROM documents) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 10",
    "e4_preview": f"WITH {GRID_SQL}, p AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM grid) SELECT source_id, string_agg(substr(text, 1, 240), ' ... ' ORDER BY sentence_id) AS preview FROM p WHERE sentence_id IN (0, n // 2, n - 1) GROUP BY 1",
    "f2_bm25": f"WITH {_BM25} SELECT query_id, doc_id, score FROM bm",
    "f3_hybrid_search": f"WITH {_BM25}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings), c AS (SELECT q.id AS query_id, v.id, list_dot_product(v.vec, q.vec) AS cos FROM v, v q WHERE q.id < 20), b AS (SELECT query_id, max(score) AS top FROM bm GROUP BY 1), x AS (SELECT c.query_id, c.id, round(0.65 * (cos + 1) / 2 + 0.35 * coalesce(score, 0) / CASE WHEN coalesce(top, 0) > 0 THEN top ELSE 1 END, 4) AS score FROM c LEFT JOIN bm ON bm.query_id = c.query_id AND bm.doc_id = c.id LEFT JOIN b ON b.query_id = c.query_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM x) WHERE position <= 16",
    "f4_phrase_matches": rf"WITH {WORDS_SQL}, c AS (SELECT *, lower(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS t FROM words), n AS (SELECT *, lead(t) OVER (PARTITION BY source_id ORDER BY ord) AS t1 FROM c) SELECT source_id, ord, start_ms FROM n WHERE t = 'the' AND t1 = 'and'",
    "f4_word_matches": f"WITH {WORDS_SQL} SELECT source_id, ord, text FROM words WHERE contains(lower(text), 'tion')",
    "f5_cosine": f"WITH {UNITS_SQL} SELECT a.source_id, a.ord, round(list_dot_product(a.vec, b.vec), 6) AS cos FROM units a JOIN units b ON a.source_id = b.source_id AND a.ord + 1 = b.ord",
    "f6_sentence_ends": r"SELECT doc_id, len(regexp_extract_all(text, '[.!?](?:\s|$)')) AS n FROM documents",
    "l1_cursor_page": f"WITH {GRID_SQL} SELECT * FROM (SELECT source_id, sentence_id, row_number() OVER (PARTITION BY source_id ORDER BY word_count DESC, sentence_id) AS position FROM grid) WHERE position > 5 AND position <= 17",
    "l2_budget_page": f"WITH {GRID_SQL}, r AS (SELECT source_id, sentence_id, sum(length(text)) OVER w::BIGINT AS run, row_number() OVER w AS rn FROM grid WHERE sentence_id >= 3 WINDOW w AS (PARTITION BY source_id ORDER BY sentence_id)) SELECT source_id, sentence_id, run FROM r WHERE run <= 500 OR rn = 1",
    "l2_fragments": 'SELECT doc_id, "at", length(substr(text, "at" + 1, 2000)) AS length, sha256(substr(text, "at" + 1, 2000)) AS sha256 FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 2000)) AS "at" FROM documents)',
    "l4_capped_candidates": "WITH c AS (SELECT user_id, event_id, event_type, floor(value) AS cost, event_id % 3 = 0 AS safe FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY safe DESC, cost, event_id) = 1 AND safe AS must FROM c), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY must DESC, cost, event_id) AS rank FROM m) SELECT * FROM r WHERE rank <= 8",
    "l5_latest_row": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "l6_retained_window": f"WITH {WORDS_SQL}, r AS (SELECT source_id, ord * 7 % 400 AS id, ord AS seq, length(text) AS len FROM words), l AS (SELECT source_id, id, max(seq) AS seq, arg_max(len, seq) AS len FROM r GROUP BY ALL), n AS (SELECT *, count(*) OVER w AS n, sum(len) OVER w AS c FROM l WINDOW w AS (PARTITION BY source_id ORDER BY seq DESC)) SELECT source_id, id, seq FROM n WHERE n <= 100 AND c <= 500",
}
ORACLES["f3_hybrid_search_all"] = ORACLES["f3_hybrid_search"].replace("q.id < 20", "q.id % 50 = 0")
