"""Segmentation metrics: boundary strings, Pk, WindowDiff, edit distance, tolerant and overlap matching; change points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.segment import GRID_SQL, sentence_grid
from lexiline.sources.timeline import by_source, units, words

# fixed values: tolerance in milliseconds, edit costs, overlap thresholds, kernel bounds
TOLERANCE_MS, INSERT_COST, DELETE_COST, SHIFT_COST = 3000, 2.0, 2.0, 1.0
IOU_STEPS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
LEAST_SEGMENT, MOST_UNITS = 4, 10_000


def boundary_string(grid: DataFrame, boundaries: DataFrame, name: str) -> DataFrame:
    """A bit for each sentence: whether a boundary falls at the start of the next one (boundaries go to the first start at or after them; edges are dropped)."""
    starts = grid.select("source_id", "start_ms", "sentence_id")
    w = Window.partitionBy("source_id").orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    both = boundaries.select("source_id", F.col("ms").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("v")).unionByName(starts.select("source_id", F.col("start_ms").alias("t"), F.lit(1).alias("side"), F.col("sentence_id").alias("v")))
    hit = both.withColumn("f", F.last("v", True).over(w)).filter("side = 0 and f > 0").select("source_id", (F.col("f") - 1).alias("sentence_id")).distinct().withColumn(name, F.lit(1))
    return grid.select("source_id", "sentence_id").join(hit, ["source_id", "sentence_id"], "left").select("source_id", "sentence_id", F.coalesce(name, F.lit(0)).alias(name))


def window_sizes(bits: DataFrame, ref: str) -> DataFrame:
    """Half the mean segment length of the reference, rounded half to even, 1 to n."""
    g = bits.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(ref).alias("marks"))
    return g.select("source_id", "n", F.greatest(F.lit(1), F.least("n", F.bround(F.col("n") / (2 * (F.col("marks") + 1))))).cast("long").alias("k"))


def windowed(bits: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Pk and WindowDiff of each source: windows of k bits by prefix sums and a join k rows on."""
    w = by_source("sentence_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = bits.join(window_sizes(bits, ref), "source_id").withColumns({"r": F.sum(ref).over(w), "h": F.sum(hyp).over(w)})
    ends = sums.select("source_id", F.col("sentence_id").alias("e"), F.col("r").alias("re"), F.col("h").alias("he"))
    met = sums.join(ends, ["source_id"]).filter("e = sentence_id + k - 1")
    rd, hd = F.col("re") - F.col("r") + F.col(ref), F.col("he") - F.col("h") + F.col(hyp)
    g = met.groupBy("source_id").agg(F.count("*").alias("windows"), F.count_if((rd > 0) != (hd > 0)).alias("pk"), F.count_if(rd != hd).alias("wd"))
    return g.select("source_id", "windows", F.round(F.col("pk") / F.col("windows"), 6).alias("pk"), F.round(F.col("wd") / F.col("windows"), 6).alias("window_diff"))


def edit_distance(ref: list[int], hyp: list[int]) -> float:
    """Least cost to turn the boundaries of hyp into those of ref: add, remove or shift by a distance."""
    row = [i * INSERT_COST for i in range(len(ref) + 1)]
    for j, h in enumerate(hyp, 1):
        new = [j * DELETE_COST]
        for i, r in enumerate(ref, 1):
            new.append(min(new[i - 1] + INSERT_COST, row[i] + DELETE_COST, row[i - 1] + SHIFT_COST * abs(r - h)))
        row = new
    return row[-1]


def _per_source(df: DataFrame, columns: dict[str, str], step) -> DataFrame:
    """One row for each source from its rows: step(table) -> values."""

    def run(rows: pa.Table) -> pa.Table:
        out = step(rows)
        return pa.table({"source_id": rows.column("source_id").slice(0, 1), **{c: pa.array([v], {"double": pa.float64(), "long": pa.int64()}[t]) for (c, t), v in zip(columns.items(), out)}})

    return df.groupBy("source_id").applyInArrow(run, "source_id long, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def ghd(bits: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Edit distance of the boundary strings of each source; only the marked bits travel."""
    marked = bits.filter(f"{ref} = 1 or {hyp} = 1").select("source_id", "sentence_id", ref, hyp)

    def step(rows: pa.Table):
        rows = rows.sort_by("sentence_id")
        at = rows.column("sentence_id").to_numpy()
        return (edit_distance(at[rows.column(ref).to_numpy() == 1].tolist(), at[rows.column(hyp).to_numpy() == 1].tolist()),)

    return _per_source(marked, {"ghd": "double"}, step)


def matched(ref: list[int], hyp: list[int], tolerance: int) -> int:
    """The most pairs of points within the tolerance. In order, the earliest points of both sides are a pair, or the earlier of them is too early for all that is left."""
    ref, hyp = sorted(ref), sorted(hyp)
    i = j = n = 0
    while i < len(ref) and j < len(hyp):
        apart = hyp[j] - ref[i]
        n += abs(apart) <= tolerance
        i += apart >= -tolerance
        j += apart <= tolerance
    return n


def tolerant_match(points: DataFrame, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """Matches, precision, recall and F1 of (source_id, ms, side) points within a tolerance."""

    def step(rows: pa.Table):
        ms, side = rows.column("ms").to_numpy(), rows.column("side").to_numpy()
        r, h = ms[side == 0].tolist(), ms[side == 1].tolist()
        n = matched(r, h, tolerance)
        p, c = (n / len(h) if h else 0.0), (n / len(r) if r else 0.0)
        return n, round(p, 6), round(c, 6), round(2 * p * c / (p + c), 6) if p + c else 0.0

    return _per_source(points, {"matches": "long", "purity": "double", "coverage": "double", "f1": "double"}, step)


def overlap_match(segments: DataFrame) -> DataFrame:
    """Mean F1 over overlap thresholds of segments (source_id, start_ms, end_ms, side) matched greedily one to one."""

    def step(rows: pa.Table):
        s, e, side = (rows.column(c).to_numpy() for c in ("start_ms", "end_ms", "side"))
        order = np.argsort(s, kind="stable")
        s, e, side = s[order], e[order], side[order]
        rs, re, hs, he = s[side == 0], e[side == 0], s[side == 1], e[side == 1]
        pairs = []
        for i in range(len(rs)):  # only hypotheses that begin before the reference ends can overlap it
            for j in range(np.searchsorted(he, rs[i], side="right"), np.searchsorted(hs, re[i])):
                both = min(re[i], he[j]) - max(rs[i], hs[j])
                if both > 0:
                    pairs.append((-both / (re[i] - rs[i] + he[j] - hs[j] - both), i, j))
        pairs.sort()
        total = 0.0
        for t in IOU_STEPS:
            ri, hj = set(), set()
            for v, i, j in pairs:
                if -v >= t and i not in ri and j not in hj:
                    ri.add(i), hj.add(j)
            total += 2 * len(ri) / (len(rs) + len(hs)) if len(rs) + len(hs) else 0.0
        return (round(total / len(IOU_STEPS), 6),)

    return _per_source(segments, {"f1": "double"}, step)


# ---- change points -----------------------------------------------------------------------------------------

def gram(vectors: np.ndarray) -> np.ndarray:
    """RBF kernel; the bandwidth is the median of squared distances of neighbours in order."""
    norm = (vectors * vectors).sum(1)
    sq = np.maximum(norm[:, None] + norm[None, :] - 2 * vectors @ vectors.T, 0)
    near = np.sort(sq[np.triu_indices(len(vectors), 1)])
    width = near[len(near) // 2] if len(near) and near[len(near) // 2] > 0 else 1.0
    return np.exp(-sq / width)


def costs(k: np.ndarray) -> np.ndarray:
    """Scatter of each segment [a, b): its trace less its mean similarity."""
    n = len(k)
    s = np.zeros((n + 1, n + 1))
    s[1:, 1:] = k.cumsum(0).cumsum(1)
    d = np.concatenate([[0], np.cumsum(np.diag(k))])
    a, b = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
    block = s[b, b] - s[a, b] - s[b, a] + s[a, a]
    with np.errstate(divide="ignore", invalid="ignore"):
        c = (d[b] - d[a]) - block / (b - a)
    return np.where(b - a >= LEAST_SEGMENT, c, np.inf)


def best_breaks(c: np.ndarray, breaks: int) -> list[int]:
    """The exact optimum of breaks + 1 segments."""
    n = len(c) - 1
    breaks = max(0, min(breaks, n // LEAST_SEGMENT - 1))
    best, back = c[0].copy(), []
    for _ in range(breaks):
        total = best[:, None] + c
        back.append(total.argmin(0))
        best = total.min(0)
    out, at = [], n
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def penalized_breaks(c: np.ndarray, penalty: float) -> list[int]:
    """The optimum when each break costs `penalty`."""
    n = len(c) - 1
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for b in range(1, n + 1):
        total = best[:b] + c[:b, b] + penalty
        back[b] = int(total.argmin())
        best[b] = total[back[b]]
    out, at = [], n
    while at > 0 and np.isfinite(best[n]):
        at = int(back[at])
        if at:
            out.append(at)
    return out[::-1]


def change_points(u: DataFrame, breaks: int | None = None, penalty: float | None = None) -> DataFrame:
    """Change points (source_id, ord, score) of vectors in order; the score is the share of scatter that a break removes. A source is
    one kernel matrix, so more than MOST_UNITS units are refused."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ord")
        if rows.num_rows > MOST_UNITS:
            raise ValueError(f"{rows.num_rows} units; {MOST_UNITS} at most")
        v = np.array(rows.column("vec").to_pylist(), float)
        found: list[tuple[int, float]] = []
        if len(v) >= 2 * LEAST_SEGMENT:
            c = costs(gram(v))
            at = best_breaks(c, breaks) if penalty is None else penalized_breaks(c, penalty)
            edges = [0, *at, len(v)]
            for lo, b, hi in zip(edges, at, edges[2:]):
                whole = c[lo, hi]
                found.append((b, float(min(1, max(0, 1 - (c[lo, b] + c[b, hi]) / whole))) if whole > 0 else 0.0))
        return pa.table({"source_id": pa.array([rows.column("source_id")[0].as_py()] * len(found), pa.int64()), "ord": pa.array([b for b, _ in found], pa.int64()), "score": pa.array([round(s, 6) for _, s in found], pa.float64())})

    return u.select("source_id", "ord", "vec").groupBy("source_id").applyInArrow(run, "source_id long, ord long, score double")


def segment_costs(u: DataFrame, length: int = 10) -> DataFrame:
    """Linear-kernel scatter of consecutive segments, natively: sum of squares less the squared norm of the sum over n."""
    seg = u.withColumn("seg", F.expr(f"ord div {length}")).select("source_id", "seg", "ord", F.posexplode("vec").alias("dim", "x"))
    d = seg.groupBy("source_id", "seg", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    return d.groupBy("source_id", "seg").agg(F.round(F.sum("q") - F.sum(F.col("s") * F.col("s")) / F.max("n"), 5).alias("cost"))


# ---- queries -----------------------------------------------------------------------------------------------

def gold_and_guess(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn starts as gold boundaries, long pauses as guesses."""
    w = words(s, d)
    g = sentence_grid(w)
    return g, g.filter("opens_turn").select("source_id", F.col("start_ms").alias("ms")), g.filter("pause_after_ms >= 1500").select("source_id", (F.col("end_ms") + 100).alias("ms"))


def bits(s: SparkSession, d: str) -> DataFrame:
    g, gold, guess = gold_and_guess(s, d)
    return boundary_string(g, gold, "ref").join(boundary_string(g, guess, "hyp"), ["source_id", "sentence_id"])


_BITS = """gold AS (SELECT source_id, start_ms AS ms FROM grid WHERE opens_turn), guess AS (SELECT source_id, end_ms + 100 AS ms FROM grid WHERE pause_after_ms >= 1500),
br AS (SELECT DISTINCT b.source_id, g.sentence_id - 1 AS sentence_id FROM gold b ASOF JOIN grid g ON g.source_id = b.source_id AND b.ms <= g.start_ms WHERE g.sentence_id > 0), bh AS (SELECT DISTINCT b.source_id, g.sentence_id - 1 AS sentence_id FROM guess b ASOF JOIN grid g ON g.source_id = b.source_id AND b.ms <= g.start_ms WHERE g.sentence_id > 0),
bits AS (SELECT g.source_id, g.sentence_id, (br.sentence_id IS NOT NULL)::INT AS ref, (bh.sentence_id IS NOT NULL)::INT AS hyp FROM grid g LEFT JOIN br ON br.source_id = g.source_id AND br.sentence_id = g.sentence_id LEFT JOIN bh ON bh.source_id = g.source_id AND bh.sentence_id = g.sentence_id),
wsz AS (SELECT source_id, count(*) AS n, greatest(1, least(count(*), round_even(count(*) / (2 * (sum(ref) + 1)), 0)))::BIGINT AS k FROM bits GROUP BY 1)"""


def _points(s, d):
    _, gold, guess = gold_and_guess(s, d)
    return gold.withColumn("side", F.lit(0)).unionByName(guess.withColumn("side", F.lit(1)))


def _segments(s, d):
    out = None
    for side in (0, 1):
        p = _points(s, d).filter(F.col("side") == side).select("source_id", "ms").distinct()
        seg = p.select("source_id", F.col("ms").alias("start_ms"), F.lead("ms").over(by_source("ms")).alias("end_ms")).filter("end_ms is not null").withColumn("side", F.lit(side))
        out = seg if out is None else out.unionByName(seg)
    return out


def _agreement(s, d):
    """F1 of the boundaries of two segmenters, pause lengths as segmenters."""
    g = sentence_grid(words(s, d))
    p = {k: g.filter(f"pause_after_ms >= {k}").select("source_id", F.col("end_ms").alias("ms")) for k in (700, 1500, 2500)}
    out = None
    for a in p:
        for b in p:
            if a < b:
                t = tolerant_match(p[a].withColumn("side", F.lit(0)).unionByName(p[b].withColumn("side", F.lit(1)))).select("source_id", F.lit(a).alias("a"), F.lit(b).alias("b"), "f1")
                out = t if out is None else out.unionByName(t)
    return out


QUERIES = {
    "g1_boundary_string": bits,
    "g2_window_size": lambda s, d: window_sizes(bits(s, d), "ref"),
    "g3_tolerant_match": lambda s, d: tolerant_match(_points(s, d)),
    "g4_g5_pk_and_window_diff": lambda s, d: windowed(bits(s, d), "ref", "hyp"),
    "g6_ghd": lambda s, d: ghd(bits(s, d), "ref", "hyp"),
    "g7_density": lambda s, d: sentence_grid(words(s, d)).groupBy("source_id").agg(F.count_if("opens_turn").alias("marks"), (F.max("end_ms") - F.min("start_ms")).alias("span")).select("source_id", "marks", F.round(F.col("marks") * 3_600_000 / F.col("span"), 4).alias("per_hour")),
    "g8_overlap_match": lambda s, d: overlap_match(_segments(s, d)),
    "g9_agreement": _agreement,
    "p1_target_count": lambda s, d: words(s, d).groupBy("source_id").agg((F.max("end_ms") - F.min("start_ms")).alias("span")).select("source_id", F.greatest(F.lit(0), F.bround(F.col("span") * 12 / 3_600_000)).cast("long").alias("target")),
    "p2_change_points": lambda s, d: change_points(units(s, d), breaks=4),
    "p3_change_points_by_penalty": lambda s, d: change_points(units(s, d), penalty=0.2),
    "p4_segment_costs": lambda s, d: segment_costs(units(s, d)),
}
ORACLES = {
    "g1_boundary_string": f"WITH {GRID_SQL}, {_BITS} SELECT source_id, sentence_id, ref, hyp FROM bits",
    "g2_window_size": f"WITH {GRID_SQL}, {_BITS} SELECT source_id, n, k FROM wsz",
    "g4_g5_pk_and_window_diff": f"WITH {GRID_SQL}, {_BITS}, p AS (SELECT bits.*, k, sum(ref) OVER w AS r, sum(hyp) OVER w AS h FROM bits JOIN wsz USING (source_id) WINDOW w AS (PARTITION BY source_id ORDER BY sentence_id)), m AS (SELECT a.source_id, b.r - a.r + a.ref AS rd, b.h - a.h + a.hyp AS hd FROM p a JOIN p b ON a.source_id = b.source_id AND b.sentence_id = a.sentence_id + a.k - 1) SELECT source_id, count(*) AS windows, round(count(*) FILTER ((rd > 0) <> (hd > 0)) / count(*), 6) AS pk, round(count(*) FILTER (rd <> hd) / count(*), 6) AS window_diff FROM m GROUP BY 1",
    "g7_density": f"WITH {GRID_SQL} SELECT source_id, count(*) FILTER (opens_turn) AS marks, round(count(*) FILTER (opens_turn) * 3600000 / (max(end_ms) - min(start_ms)), 4) AS per_hour FROM grid GROUP BY 1",
    "p1_target_count": f"WITH {GRID_SQL} SELECT source_id, greatest(0, round_even((max(end_ms) - min(start_ms)) * 12 / 3600000, 0))::BIGINT AS target FROM words GROUP BY 1",
    "p4_segment_costs": "WITH u AS (SELECT vec_id // 50 AS source_id, vec_id % 50 // 10 AS seg, embedding::DOUBLE[] AS vec FROM embeddings), d AS (SELECT source_id, seg, i, sum(vec[i]) AS s, sum(vec[i] * vec[i]) AS q, count(*) AS n FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS i FROM u) GROUP BY ALL) SELECT source_id, seg, round(sum(q) - sum(s * s) / max(n), 5) AS cost FROM d GROUP BY ALL",
}
