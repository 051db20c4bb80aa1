"""Plan compilation: candidate costs, layer choices, shortest paths, cut ownership, plans, components, patches, corrections, backstops."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.aggregate import BOUNDARIES_SQL, boundaries
from lexiline.operators.intervals import CANDIDATES_SQL, candidates
from lexiline.operators.segment import GRID_SQL, sentence_grid
from lexiline.plans.ordered import as_of
from lexiline.plans.shared import shared_folder
from lexiline.sources.timeline import WORDS_SQL, by_source, table, words

# fixed values: cost weights, search radius and caps, limits of the backstops in milliseconds
COST_MS, COST_CLEARANCE, COST_REVIEW, COST_WIDENED, CLEARANCE_MS = 100, 20, 1_000_000, 10_000, 250
KIND_BONUS = {"edge": 0, "pause": -100, "turn": -50, "shot": -25, "sentence": 0}
RADIUS_MS, LAYER_CAP = 1500, 64
LEAD_GAP_MS, LEAD_TURN_MS, SECOND_TURN_MS, AIR_MS, SNAP_MS, CUTTER_MS = 3000, 20_000, 6000, 700, 500, 90_000
BATCH = 12
# fixed values: edges and starts of a closure for a bucket, and the fewest where there are idle cores
BUCKET_ROWS, LEAST_ROWS = 400_000, 50_000


def candidate_cost(c: DataFrame) -> DataFrame:
    """Whole-number cost of a boundary for a wanted time: distance, lack of clearance, review, widening, kind and score."""
    bonus = F.element_at(F.create_map(*[F.lit(x) for i in KIND_BONUS.items() for x in i]), F.col("kind"))
    score = (100 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score"))).cast("long")
    cost = COST_MS * F.abs(F.col("ms") - F.col("wanted")) + COST_CLEARANCE * F.greatest(F.lit(0), CLEARANCE_MS - F.col("clearance")) + F.when(F.col("review"), COST_REVIEW).otherwise(0) + F.when(F.col("widened"), COST_WIDENED).otherwise(0) + bonus - score
    return c.withColumn("cost", cost.cast("long"))


def layer_choices(wanted: DataFrame, b: DataFrame, radius: int = RADIUS_MS, cap: int = LAYER_CAP) -> DataFrame:
    """For each wanted time the boundaries within the radius; where none of them is safe, also those outward up to the first safe one. Where there are more than cap, the nearest safe
    one of each kind but edges stays, then the nearest ones do."""
    met = wanted.join(b, "source_id").withColumn("far", F.abs(F.col("ms") - F.col("wanted")))
    w = Window.partitionBy("source_id", "layer")
    near = F.col("far") <= radius
    first_safe = F.min(F.when(~F.col("review"), F.col("far"))).over(w)
    reach = F.greatest(F.lit(radius), F.coalesce(first_safe, F.lit(radius)))
    c = candidate_cost(met.withColumn("reach", reach).filter("far <= reach").withColumn("widened", ~near))
    safest = F.row_number().over(Window.partitionBy("source_id", "layer", "kind", "review").orderBy("far", "ms", "bid")) == 1
    c = c.withColumn("stays", safest & ~F.col("review") & (F.col("kind") != "edge"))
    return c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("stays"), "far", "ms", "bid")).cast("long")).filter(F.col("rank") <= cap).select("source_id", "layer", "bid", "ms", "cost", "rank")


def shortest_paths(layers: DataFrame) -> DataFrame:
    """One choice of each layer with strictly increasing times and the least total cost, of equal ones the earliest times. A source is one plan."""

    def run(rows: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for layer, ms, cost, bid in zip(*(rows.column(c).to_pylist() for c in ("layer", "ms", "cost", "bid"))):
            by.setdefault(layer, []).append((ms, cost, bid))
        best: list[tuple] = [(0, (), ())]  # (cost, times, ids) for paths by their last time
        for layer in sorted(by):
            new = {}
            for ms, cost, bid in by[layer]:
                before = [p for p in best if not p[1] or p[1][-1] < ms]
                if before:
                    p = min(before)
                    path = (p[0] + cost, (*p[1], ms), (*p[2], bid))
                    if ms not in new or path < new[ms]:
                        new[ms] = path
            best = [*new.values()]
            if not best:
                break
        source = rows.column("source_id")[0].as_py()
        if not best:
            return pa.table({"source_id": pa.array([source], pa.int64()), "layer": pa.array([-1], pa.int64()), "ms": pa.array([None], pa.int64()), "total": pa.array([None], pa.int64())})
        cost, times, _ = min(best)
        return pa.table({"source_id": pa.array([source] * len(times), pa.int64()), "layer": pa.array(sorted(by), pa.int64()), "ms": pa.array(times, pa.int64()), "total": pa.array([cost] * len(times), pa.int64())})

    return layers.groupBy("source_id").applyInArrow(run, "source_id long, layer long, ms long, total long")


def owned_paths(layers: DataFrame, quotes: DataFrame, durations: DataFrame) -> DataFrame:
    """H3: one choice of each layer (source_id, layer, ms, cost, bid), the cuts between sections 0, 1, ...: times strictly between 0 and the duration (source_id, duration_ms) and strictly
    increasing, and every quote (source_id, section, start_ms, end_ms) has its centre in its own section. The least total cost, of equal ones the earliest times, then the least ids.

    (source_id, layer, ms, bid, total) of each source's path; layer -1 and nulls where there is none. Only the first and last centre of a section matter, and a state is a choice with its best
    predecessor, so a plan takes as many steps as neighbouring layers have pairs of choices and as much memory as it has choices. A source is one plan; layers are numbered from 0 without gaps."""
    centre = F.col("start_ms") + F.col("end_ms")  # twice the centre, whole
    q = quotes.groupBy("source_id", F.col("section").alias("layer")).agg(F.min(centre).alias("lo"), F.max(centre).alias("hi"))
    top = layers.groupBy("source_id").agg((F.max("layer") + 1).alias("layer"))
    ends = top.join(q, ["source_id", "layer"], "left").join(durations, "source_id").select("source_id", F.col("lo").alias("last_lo"), F.col("hi").alias("last_hi"), "duration_ms")
    rows = layers.select("source_id", F.col("layer").cast("long").alias("layer"), F.col("ms").cast("long").alias("ms"), F.col("cost").cast("long").alias("cost"), F.col("bid").cast("string").alias("bid")).join(q, ["source_id", "layer"], "left").join(ends, "source_id")

    def owns(start: int, end: int, lo: int | None, hi: int | None) -> bool:
        return lo is None or 2 * start <= lo and hi < 2 * end

    def run(rows: pa.Table) -> pa.Table:
        by: dict[int, list[dict]] = {}
        for row in rows.to_pylist():
            by.setdefault(row["layer"], []).append(row)
        source, end = rows.column("source_id")[0].as_py(), rows.column("duration_ms")[0].as_py()
        states, kept = [(0, 0, 0, 0, None)], []  # cost, rank of the times, rank of the ids, last time, place in the layer before
        for layer in sorted(by):
            made = []
            for c in by[layer]:
                fits = [(s[:3], k) for k, s in enumerate(states) if s[3] < c["ms"] and owns(s[3], c["ms"], c["lo"], c["hi"])]
                if fits:
                    (cost, times, ids), k = min(fits)
                    made.append((cost + c["cost"], (times, c["ms"]), (ids, c["bid"]), c, k))
            place = [{v: i for i, v in enumerate(sorted({m[j] for m in made}))} for j in (1, 2)]
            states = [(m[0], place[0][m[1]], place[1][m[2]], m[3]["ms"], m[4]) for m in made]
            kept.append([(m[3], m[4]) for m in made])
        last = rows.column("last_lo")[0].as_py(), rows.column("last_hi")[0].as_py()
        whole = [(s[:3], k) for k, s in enumerate(states) if s[3] < end and owns(s[3], end, *last)] if kept else []
        out = []
        if whole:
            (total, *_), k = min(whole)
            for layer in range(len(kept) - 1, -1, -1):
                c, before = kept[layer][k]
                out.append({"source_id": source, "layer": c["layer"], "ms": c["ms"], "bid": c["bid"], "total": total})
                k = before
        return pa.Table.from_pylist(out or [{"source_id": source, "layer": -1, "ms": None, "bid": None, "total": None}], schema=pa.schema([("source_id", pa.int64()), ("layer", pa.int64()), ("ms", pa.int64()), ("bid", pa.string()), ("total", pa.int64())]))

    return rows.groupBy("source_id").applyInArrow(run, "source_id long, layer long, ms long, bid string, total long")


def compiled_cover(paths: DataFrame, durations: DataFrame) -> DataFrame:
    """H4: (source_id, section, start_ms, end_ms, start_bid, end_bid): the sections that the cuts of a path make of a source's whole time; a source without a path has none, one without cuts is a section."""
    failed = paths.filter("layer < 0").select("source_id")
    edges = paths.filter("layer >= 0").select("source_id", (F.col("layer") + 1).alias("section"), F.col("ms").alias("start_ms"), F.col("bid").alias("start_bid"))
    first = durations.join(failed, "source_id", "left_anti").select("source_id", F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("start_ms"), F.lit(None).cast("string").alias("start_bid"))
    o = by_source("section")
    nexts = first.unionByName(edges).withColumns({"end_ms": F.lead("start_ms").over(o), "end_bid": F.lead("start_bid").over(o)})
    return nexts.join(durations, "source_id").select("source_id", "section", "start_ms", F.coalesce("end_ms", "duration_ms").alias("end_ms"), "start_bid", "end_bid")


def pause_ownership(c: DataFrame) -> DataFrame:
    """Of each (source, sentence) the latest admissible cut, trusted ones first."""
    w = Window.partitionBy("source_id", "sentence_id").orderBy("review", F.desc("ms"), F.desc("clearance"), "bid")
    return c.withColumn("n", F.row_number().over(w)).filter("n = 1").select("source_id", "sentence_id", "bid", "ms")


def inventory_plan(sections: DataFrame) -> DataFrame:
    w = by_source("section")
    return sections.withColumns({"prev": F.lag("section").over(w), "next": F.lead("section").over(w), "ordinal": F.row_number().over(w).cast("long")})


def review_plan(c: DataFrame) -> DataFrame:
    """Items of four kinds with one ordinal for each source."""
    local = c.select("source_id", F.lit("local").alias("kind"), F.col("candidate_id").alias("a"), F.lit(None).cast("long").alias("b"))
    w = by_source("first", "last", "candidate_id")
    n = c.withColumns({"n_id": F.lead("candidate_id").over(w), "n_first": F.lead("first").over(w)}).filter("n_id is not null")
    over = n.filter("n_first <= last").select("source_id", F.lit("overlap").alias("kind"), F.col("candidate_id").alias("a"), F.col("n_id").alias("b"))
    hand = n.filter("n_first > last").select("source_id", F.lit("handoff").alias("kind"), F.col("candidate_id").alias("a"), F.col("n_id").alias("b"))
    omitted = c.groupBy("source_id").agg(F.max("top").alias("a")).select("source_id", F.lit("omission").alias("kind"), "a", F.lit(None).cast("long").alias("b"))
    all_ = local.unionByName(over).unionByName(hand).unionByName(omitted)
    return all_.withColumn("ordinal", F.row_number().over(by_source("kind", "a")).cast("long"))


def assembled(planned: DataFrame, shards: DataFrame, gaps: DataFrame) -> DataFrame:
    """Each planned item has a shard or a gap, not both; anything else is named."""
    j = planned.join(shards.withColumn("shard", F.lit(True)), "item", "full").join(gaps.withColumn("gap", F.lit(True)), "item", "full")
    status = F.when(F.col("planned").isNull(), "unplanned").when(F.col("shard").isNotNull() & F.col("gap").isNotNull(), "both").when(F.col("shard").isNotNull(), "shard").when(F.col("gap").isNotNull(), "gap").otherwise("missing")
    return j.select("item", status.alias("status"))


def _shared_folder(spark: SparkSession) -> None:
    """checkpoint() needs the shared folder; spark.checkpoint.dir is one from the start."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def components_of(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) by contraction: every vertex points to the one of itself and its neighbours with the least hash, other
    hashes each round, and then to what that one points to; edges move to what their ends point to, loops go. A constant share of the vertices is expected to go each round, chains too,
    and rounds end when no edge is left. Pointers are written and followed from the last round to the first, so all of them together are a small multiple of the vertices."""
    kept = _kept(edges.sparkSession)
    links = kept(edges.select("a", "b"), "links")
    turned = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"))
    current = kept(links.unionByName(turned(links)).filter("a <> b").distinct(), "edges-0")
    pointers: list[DataFrame] = []
    while not current.isEmpty():
        k = len(pointers)
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c), c)  # noqa: B023, E731
        best = current.groupBy("a").agg(F.min_by("b", rank(F.col("b"))).alias("b"))
        hop = kept(best.select("a", F.when(rank(F.col("a")) < rank(F.col("b")), F.col("a")).otherwise(F.col("b")).alias("to")), f"hop-{k}")
        to = kept(hop.join(hop.select(F.col("a").alias("to"), F.col("to").alias("further")), "to").select("a", F.col("further").alias("to")), f"to-{k}")
        moved = current.join(to, "a").select(F.col("to").alias("x"), "b").join(to.select(F.col("a").alias("b"), "to"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
        current = kept(moved.filter("a <> b").distinct(), f"edges-{k + 1}")
        pointers.append(to)
    labels = links.select("a").unionByName(links.select(F.col("b").alias("a"))).filter("a is not null").distinct()
    if not pointers:
        return labels.select(F.col("a").alias("node"), F.col("a").alias("component"))
    roots = pointers[-1]
    for to in reversed(pointers[:-1]):
        roots = to.join(roots.select(F.col("a").alias("to"), F.col("to").alias("root")), "to", "left").select("a", F.coalesce("root", "to").alias("to"))
    labels = kept(labels.join(roots, "a", "left").select("a", F.coalesce("to", "a").alias("root")), "labels")
    least = labels.groupBy("root").agg(F.min("a").alias("component"))
    return labels.join(least, "root").select(F.col("a").alias("node"), "component")


def _kept(spark: SparkSession):
    """kept(df, name): df written once below a new shared folder and read again, which cuts its lineage and tells Spark its size."""
    folder = shared_folder(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return kept


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All that starts (node) reach over (a, b), a directed graph; frontiers only hold new nodes, so they end, after cycles too. Edges are written once, in buckets of a. A frontier is written by itself, and in buckets of
    its pairs to what was reached; so a round shuffles its frontier and what that leads to, and neither the edges nor what was reached before. The tables' names end with the call, their files stay."""
    spark = edges.sparkSession
    folder, name = shared_folder(spark), f"lexiline_{uuid.uuid4().hex}"
    edges, frontier = edges.select("a", F.col("b").alias("to")), starts.select("root", "node")
    rows = edges.count() + frontier.count()
    n = max(1, rows // BUCKET_ROWS, min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS))

    def bucketed(df: DataFrame, table: str, *by: str) -> DataFrame:
        df.write.mode("append").option("path", f"{folder}/{table}").bucketBy(n, *by).saveAsTable(f"{name}_{table}")
        return spark.table(f"{name}_{table}")

    try:
        edges = bucketed(edges.repartition(n, "a").distinct(), "edges", "a")
        frontier, k, reached = frontier.repartition(n, "root", "node").distinct(), 0, []
        while True:
            frontier.write.parquet(f"{folder}/reached-{k}")
            reached.append(f"{folder}/reached-{k}")
            last = spark.read.schema(frontier.schema).parquet(reached[-1])
            if last.isEmpty():
                return spark.read.schema(frontier.schema).parquet(*reached)
            seen = bucketed(last, "seen", "root", "node")
            found = last.join(edges, last["node"] == edges["a"]).select("root", F.col("to").alias("node"))
            frontier = found.repartition(n, "root", "node").distinct().join(seen, ["root", "node"], "left_anti")
            k += 1
    finally:
        for table in ("edges", "seen"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")


def patched(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows after edits (op: drop, retitle, add): untouched ones keep their order, added ones come last."""
    gone = ops.filter("op in ('drop', 'retitle')").select("id")
    stay = rows.join(gone, "id", "left_anti").withColumn("place", F.lit(0))
    new = rows.join(ops.filter("op = 'retitle'").select("id", F.col("title").alias("new")), "id").select("key", "id", F.col("new").alias("title"), F.lit(0).alias("place"))
    added = ops.filter("op = 'add'").select("key", "id", "title", F.lit(1).alias("place"))
    all_ = stay.unionByName(new).unionByName(added)
    return all_.withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy("place", "id")).cast("long")).drop("place")


def corrected(w: DataFrame, edits: DataFrame) -> DataFrame:
    """Words after edits (source_id, ord, op, at, new), one to a word: delete; split at a character, the time shared; replace by new text. Ordinals are made anew and parents kept."""
    k = w.join(edits, ["source_id", "ord"], "left").withColumn("op", F.coalesce("op", F.lit("keep"))).filter("op <> 'delete'")
    mid = F.expr("start_ms + (end_ms - start_ms) div 2")
    one = lambda t, s, e: F.struct(t.alias("t"), s.alias("s"), e.alias("e"))
    halves = F.array(one(F.expr("substring(text, 1, at)"), F.col("start_ms"), mid), one(F.expr("substring(text, at + 1)"), mid, F.col("end_ms")))
    parts = F.when(F.col("op") == "split", halves).otherwise(F.array(one(F.when(F.col("op") == "replace", F.col("new")).otherwise(F.col("text")), F.col("start_ms"), F.col("end_ms"))))
    x = k.select("source_id", F.col("ord").alias("parent"), F.posexplode(parts).alias("part", "p"))
    return x.select("source_id", "parent", (F.row_number().over(by_source("parent", "part")) - 1).cast("long").alias("ord"), F.col("p.t").alias("text"), F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms"))


# ---- backstops over the grid -------------------------------------------------------------------------------

def turn_table(grid: DataFrame) -> DataFrame:
    t = grid.withColumn("turn", F.sum(F.col("opens_turn").cast("int")).over(by_source("sentence_id").rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy("source_id", "turn").agg(F.min("sentence_id").alias("first"), F.max("sentence_id").alias("last"), F.min("start_ms").alias("t_start"), F.max("end_ms").alias("t_end"), F.min_by("speaker", "sentence_id").alias("speaker"), F.max_by("is_question", "sentence_id").alias("asks"))
    w = by_source("turn")
    return g.withColumns({"p_start": F.lag("t_start").over(w), "p_end": F.lag("t_end").over(w), "p_speaker": F.lag("speaker").over(w), "p_asks": F.lag("asks").over(w), "pp_start": F.lag("t_start", 2).over(w), "pp_end": F.lag("t_end", 2).over(w)})


def ranges_in_turns(r: DataFrame, grid: DataFrame) -> DataFrame:
    """Ranges (source_id, rid, s, e) with the turn that their start falls in."""
    t = turn_table(grid)
    cols = [c for c in t.columns if c not in ("source_id", "t_start")]
    return as_of(r, t.select("source_id", "t_start", *cols), ["source_id"], "s", "t_start", cols)


def lead_in(r: DataFrame, grid: DataFrame) -> DataFrame:
    """The turn before by another speaker is prepended if it is close and short, a second one if the first asked and the second is short."""
    j = ranges_in_turns(r, grid)
    one = (F.col("right_p_speaker") != F.col("right_speaker")) & (F.col("s") - F.col("right_p_end") <= LEAD_GAP_MS) & (F.col("right_p_end") - F.col("right_p_start") <= LEAD_TURN_MS)
    two = one & F.col("right_p_asks") & (F.col("right_p_start") - F.col("right_pp_end") <= LEAD_GAP_MS) & (F.col("right_pp_end") - F.col("right_pp_start") <= SECOND_TURN_MS)
    return j.select("source_id", "rid", F.when(one, F.col("right_p_start")).otherwise(F.col("s")).alias("one"), F.when(two, F.col("right_pp_start")).when(one, F.col("right_p_start")).otherwise(F.col("s")).alias("two"))


def stale_open(r: DataFrame, grid: DataFrame) -> DataFrame:
    """Marks and times of the sentences at the ends of ranges."""
    cols = ["sentence_id", "opens_turn", "ends_turn", "pause_after_ms", "is_question"]
    g = grid.select("source_id", "start_ms", *cols)
    a = as_of(r, g, ["source_id"], "s", "start_ms", cols).select("source_id", "rid", "s", "e", (F.col("right_ends_turn") & ~F.col("right_opens_turn") & (F.abs(F.col("s") - F.col("right_start_ms")) <= 1)).alias("stale"))
    b = as_of(a, g, ["source_id"], "e", "start_ms", cols)
    trim = F.col("right_opens_turn") & F.col("right_is_question") & (F.col("right_start_ms") > F.col("s"))
    return b.select("source_id", "rid", F.coalesce("stale", F.lit(False)).alias("stale"), (F.col("e") + F.least(F.coalesce("right_pause_after_ms", F.lit(0)), F.lit(AIR_MS))).cast("long").alias("extended"), F.when(trim, F.col("right_start_ms")).otherwise(F.col("e")).cast("long").alias("trimmed"))


def shot_snap(r: DataFrame, shots: DataFrame) -> DataFrame:
    """The first listed shot within half a second of a range's start."""
    met = r.join(shots, "source_id").filter(F.abs(F.col("time_ms") - F.col("s")) <= SNAP_MS)
    best = met.groupBy("source_id", "rid").agg(F.min_by("time_ms", "listed").alias("snapped"))
    return r.join(best, ["source_id", "rid"], "left").select("source_id", "rid", F.coalesce("snapped", "s").alias("snapped"))


def cutter_window(r: DataFrame, grid: DataFrame, around: int = CUTTER_MS) -> DataFrame:
    """The turns within 90 s of a range, two before and one after at least."""
    t = turn_table(grid).select("source_id", "turn", "t_start", "t_end")
    met = r.join(t, "source_id")
    own = met.groupBy("source_id", "rid").agg(F.max(F.when(F.col("t_start") <= F.col("s"), F.col("turn"))).alias("at"), F.max(F.when(F.col("t_start") <= F.col("e"), F.col("turn"))).alias("upto"), F.max("turn").alias("top"), F.min("turn").alias("bottom"),
        F.min(F.when(F.col("t_end") >= F.col("s") - around, F.col("turn"))).alias("lo"), F.max(F.when(F.col("t_start") <= F.col("e") + around, F.col("turn"))).alias("hi"))
    return own.select("source_id", "rid", F.greatest("bottom", F.least("lo", F.coalesce("at", "bottom") - 2)).alias("first_turn"), F.least("top", F.greatest("hi", F.coalesce("upto", "bottom") + 1)).alias("last_turn"))


# ---- queries -----------------------------------------------------------------------------------------------

def _b(s, d):
    b = boundaries(s, d).withColumn("bid", F.concat_ws("-", "kind", F.col("ms").cast("string")))
    return b.select("source_id", "ms", "kind", "score", "bid", (F.col("ms") % 400).alias("clearance"), (F.col("ms") % 3 == 0).alias("review"), "sentence_id")


_B = "cb AS (SELECT source_id, ms, kind, score, kind || '-' || ms AS bid, ms % 400 AS clearance, ms % 3 = 0 AS review, sentence_id FROM bnd)"


def _wanted(s, d):
    g = sentence_grid(words(s, d)).filter("sentence_id % 9 = 4")
    return g.select("source_id", F.expr("sentence_id div 9").alias("layer"), (F.col("start_ms") + 130).alias("wanted"))


_W = "wd AS (SELECT source_id, sentence_id // 9 AS layer, start_ms + 130 AS wanted FROM grid WHERE sentence_id % 9 = 4)"
_COST = f"100 * abs(ms - wanted) + 20 * greatest(0, 250 - clearance) + CASE WHEN review THEN 1000000 ELSE 0 END + CASE WHEN far > 1500 THEN 10000 ELSE 0 END + CASE kind {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in KIND_BONUS.items())} END - trunc(100 * greatest(-1, least(1, score)))::BIGINT"
_LAYERS = f"{BOUNDARIES_SQL}, {_B}, {_W}, jn AS (SELECT wd.source_id, layer, wanted, bid, ms, kind, score, clearance, review, abs(ms - wanted) AS far FROM wd JOIN cb ON cb.source_id = wd.source_id), rc AS (SELECT *, greatest(1500, coalesce(min(far) FILTER (NOT review) OVER (PARTITION BY source_id, layer), 1500)) AS reach FROM jn), co AS (SELECT *, ({_COST})::BIGINT AS cost FROM rc WHERE far <= reach), sf AS (SELECT *, NOT review AND kind <> 'edge' AND row_number() OVER (PARTITION BY source_id, layer, kind, review ORDER BY far, ms, bid) = 1 AS stays FROM co), ly AS (SELECT source_id, layer, bid, ms, cost, row_number() OVER (PARTITION BY source_id, layer ORDER BY stays DESC, far, ms, bid) AS rank FROM sf QUALIFY rank <= 64)"


def _ranges(s, d):
    return candidates(s, d).join(sentence_grid(words(s, d)).select("source_id", F.col("sentence_id").alias("first"), F.col("start_ms").alias("s")), ["source_id", "first"]).join(sentence_grid(words(s, d)).select("source_id", F.col("sentence_id").alias("last"), F.col("end_ms").alias("e")), ["source_id", "last"]).select("source_id", F.col("candidate_id").alias("rid"), "s", "e")


_R = "rg AS (SELECT c.source_id, candidate_id AS rid, a.start_ms AS s, z.end_ms AS e FROM cand c JOIN grid a ON a.source_id = c.source_id AND a.sentence_id = first JOIN grid z ON z.source_id = c.source_id AND z.sentence_id = last)"
_T = "tq AS (SELECT *, sum(opens_turn::INT) OVER (PARTITION BY source_id ORDER BY sentence_id) AS turn FROM grid), tt AS (SELECT source_id, turn, min(start_ms) AS ts, max(end_ms) AS te, arg_min(speaker, sentence_id) AS sp, arg_max(is_question, sentence_id) AS asks FROM tq GROUP BY ALL), tl AS (SELECT *, lag(ts) OVER w AS p_s, lag(te) OVER w AS p_e, lag(sp) OVER w AS p_sp, lag(asks) OVER w AS p_a, lag(ts, 2) OVER w AS pp_s, lag(te, 2) OVER w AS pp_e FROM tt WINDOW w AS (PARTITION BY source_id ORDER BY turn))"


def _edges(s, d, which="true"):
    return table(s, d, "lineitem").filter(which).select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 100_000_000).alias("b"))


def _repairs(s, d, which="true"):
    return components_of(_edges(s, d, which)).groupBy("component").agg(F.count("*").alias("size")).select("component", "size", F.expr("(size + 11) div 12").alias("calls"))


#: the edges of h10 and h11, as in their SQL, whose recursion is too slow for all; h10_components_all and h11_repair_plan_all take every row
_SAMPLE = "l_orderkey % 40 = 3"


def _dag(s, d, which="true"):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k")).filter(which)
    return o.select(F.col("k").alias("a"), F.explode(F.array(F.expr("k div 2"), F.expr("k div 3"))).alias("b")).filter("b > 0")


def _ancestors(s, d, which="true"):
    """What every order divisible by 50, of those that which takes, reaches among these."""
    roots = table(s, d, "orders").select(F.col("o_orderkey").alias("k")).filter(which).filter("k % 50 = 0")
    return closure(_dag(s, d, which), roots.select(F.col("k").alias("root"), F.col("k").alias("node")))


def _patched(s, d):
    r = table(s, d, "events").filter("event_id % 4 = 0").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("title"))
    op = F.expr("case when event_id % 20 = 0 then 'drop' when event_id % 28 = 4 then 'retitle' when event_id % 33 = 1 and event_id % 4 <> 0 then 'add' end")
    ops = table(s, d, "events").withColumn("op", op).filter("op is not null").select("op", F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"))
    return patched(r, ops)


def _corrected(s, d):
    w = words(s, d)
    op = F.expr("case when ord % 23 = 7 then 'delete' when ord % 31 = 4 then 'split' when ord % 19 = 2 then 'replace' end")
    return corrected(w, w.select("source_id", "ord", op.alias("op"), F.lit(2).alias("at"), F.concat("text", F.lit("+")).alias("new")).filter("op is not null"))


def _assembled(s, d):
    o = table(s, d, "orders")
    item = F.col("o_orderkey").alias("item")
    return assembled(o.filter("o_orderkey % 9 <> 1").select(item, F.lit(True).alias("planned")), o.filter("o_orderkey % 3 = 0").select(item), o.filter("o_orderkey % 5 = 0").select(item)).groupBy("status").agg(F.count("*").alias("n"))


def _renderable(s, d):
    """Selected candidates without a required finding."""
    c = candidates(s, d).filter("candidate_id % 3 <> 1")
    blocked = candidates(s, d).filter("candidate_id % 7 = 0").select("source_id", "candidate_id")
    return c.join(blocked, ["source_id", "candidate_id"], "left_anti").select("source_id", "candidate_id", "first", "last")


def _semantic(s, d):
    """States that are equal but for their prose: the first of each key."""
    c = candidates(s, d).withColumn("state", F.sha2(F.to_json(F.struct((F.col("last") - F.col("first")).alias("length"), (F.col("first") % 2).alias("parity"))), 256))
    return c.groupBy("source_id", "state").agg(F.min("candidate_id").alias("first_id"), F.count("*").alias("n")).select("source_id", "first_id", "n")


def _owned(s, d):
    """Layers numbered from 0, a quote before each wanted time and after every second one, and durations."""
    _shared_folder(s)
    chosen = layer_choices(_wanted(s, d), _b(s, d)).checkpoint()
    layers = chosen.withColumn("layer", (F.dense_rank().over(by_source("layer")) - 1).cast("long"))
    wanted = _wanted(s, d).join(chosen.select("source_id", "layer").distinct(), ["source_id", "layer"], "left_semi").withColumn("k", (F.dense_rank().over(by_source("layer")) - 1).cast("long"))
    said = lambda df, section, ms: df.select("source_id", section.alias("section"), ms.cast("long").alias("start_ms"), ms.cast("long").alias("end_ms"))
    quotes = said(wanted, F.col("k"), F.col("wanted") - 400).unionByName(said(wanted.filter("k % 2 = 0"), F.col("k") + 1, F.col("wanted") + 300))
    return layers, quotes, words(s, d).groupBy("source_id").agg(F.max("end_ms").cast("long").alias("duration_ms"))


def _execution(s, d):
    """Kept sections and the drops between them, as one exact cover."""
    g = sentence_grid(words(s, d)).groupBy("source_id").agg(F.max("sentence_id").alias("top"))
    k = candidates(s, d).filter("candidate_id % 20 = 0").select("source_id", "first", "last")
    w = by_source("first")
    drops = k.withColumn("after", F.lead("first").over(w)).join(g, "source_id").select("source_id", (F.col("last") + 1).alias("first"), (F.coalesce("after", F.col("top") + 1) - 1).alias("last")).filter("first <= last")
    return k.withColumn("kind", F.lit("keep")).unionByName(drops.withColumn("kind", F.lit("drop")))


QUERIES = {
    "h1_candidate_cost": lambda s, d: candidate_cost(_b(s, d).withColumns({"wanted": F.col("ms") + (F.col("ms") % 91), "widened": F.col("ms") % 5 == 0})).select("source_id", "bid", "cost"),
    "h2_layer_choices": lambda s, d: layer_choices(_wanted(s, d), _b(s, d)),
    "h3_shortest_paths": lambda s, d: shortest_paths(layer_choices(_wanted(s, d), _b(s, d))),
    "h4_compiled_sections": lambda s, d: (lambda p: p.filter("layer >= 0").select("source_id", (F.row_number().over(by_source("layer"))).cast("long").alias("section"), F.col("ms").alias("start_ms"), F.lead("ms").over(by_source("layer")).alias("end_ms")))(shortest_paths(layer_choices(_wanted(s, d), _b(s, d)))),
    "h3_owned_paths": lambda s, d: owned_paths(*_owned(s, d)),
    "h4_compiled_cover": lambda s, d: (lambda o: compiled_cover(owned_paths(*o), o[2]))(_owned(s, d)),
    "h5_topic_execution": _execution,
    "h6_pause_ownership": lambda s, d: pause_ownership(_b(s, d).filter("sentence_id is not null")),
    "h7_inventory_plan": lambda s, d: inventory_plan(sentence_grid(words(s, d)).select("source_id", F.expr("sentence_id div 12").alias("section")).distinct()),
    "h8_author_plan": lambda s, d: candidates(s, d).select("source_id", "candidate_id", F.expr(f"(row_number() over (partition by source_id order by candidate_id) - 1) div {BATCH}").alias("batch")),
    "h9_review_plan": lambda s, d: review_plan(candidates(s, d)),
    "h10_components": lambda s, d: components_of(_edges(s, d, _SAMPLE)),
    "h10_components_all": lambda s, d: components_of(_edges(s, d)),
    "h11_repair_plan": lambda s, d: _repairs(s, d, _SAMPLE),
    "h11_repair_plan_all": _repairs,
    "h12_assembly": _assembled,
    "h13_assessment": lambda s, d: (lambda e: e.select("event_id", F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), c.alias("passed")) for n, c in (("value", F.col("value") > 5), ("type", F.col("event_type") != "error"), ("user", F.col("user_id") % 4 != 0))])).alias("x")).filter("not x.passed").groupBy("x.criterion").agg(F.count("*").alias("findings")))(table(s, d, "events")),
    "h14_renderable_selection": _renderable,
    "h15_h16_patched": _patched,
    "h17_review_commands": lambda s, d: candidates(s, d).withColumn("cmd", F.expr("element_at(array('accept', 'reject', 'nudge', 'restore'), cast(candidate_id % 4 + 1 as int))")).select("source_id", "candidate_id", F.when(F.col("cmd") == "reject", "rejected").when(F.col("cmd") == "accept", "accepted").otherwise("open").alias("status"), F.when(F.col("cmd") == "nudge", F.least("top", F.col("last") + 1)).otherwise(F.col("last")).alias("last")),
    "h18_corrections": _corrected,
    "j4_closure": lambda s, d: _ancestors(s, d, "k < 4000"),
    "j4_closure_all": _ancestors,
    "j5_semantic_keys": _semantic,
    "r1_r2_lead_in": lambda s, d: lead_in(_ranges(s, d), sentence_grid(words(s, d))),
    "r3_r4_r5_range_ends": lambda s, d: stale_open(_ranges(s, d), sentence_grid(words(s, d))),
    "r6_shot_snap": lambda s, d: shot_snap(_ranges(s, d), words(s, d).filter("ord % 17 = 5").select("source_id", (F.col("start_ms") + 300).alias("time_ms"), F.col("ord").alias("listed"))),
    "r7_cutter_window": lambda s, d: cutter_window(_ranges(s, d), sentence_grid(words(s, d)), 9000),
}
ORACLES = {
    "h1_candidate_cost": f"WITH {GRID_SQL}, {BOUNDARIES_SQL}, {_B}, x AS (SELECT *, ms + ms % 91 AS wanted, CASE WHEN ms % 5 = 0 THEN 1501 ELSE 0 END AS far FROM cb) SELECT source_id, bid, ({_COST})::BIGINT AS cost FROM x",
    "h2_layer_choices": f"WITH {GRID_SQL}, {_LAYERS} SELECT * FROM ly",
    "h5_topic_execution": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, k AS (SELECT source_id, first, last, top, lead(first) OVER (PARTITION BY source_id ORDER BY first) AS nx FROM cand WHERE candidate_id % 20 = 0) SELECT source_id, first, last, 'keep' AS kind FROM k UNION ALL SELECT source_id, last + 1, coalesce(nx, top + 1) - 1, 'drop' FROM k WHERE last + 1 <= coalesce(nx, top + 1) - 1",
    "h6_pause_ownership": f"WITH {GRID_SQL}, {BOUNDARIES_SQL}, {_B} SELECT source_id, sentence_id, bid, ms FROM cb WHERE sentence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, sentence_id ORDER BY review, ms DESC, clearance DESC, bid) = 1",
    "h7_inventory_plan": f"WITH {GRID_SQL}, s AS (SELECT DISTINCT source_id, sentence_id // 12 AS section FROM grid) SELECT *, lag(section) OVER w AS prev, lead(section) OVER w AS next, row_number() OVER w AS ordinal FROM s WINDOW w AS (PARTITION BY source_id ORDER BY section)",
    "h8_author_plan": f"WITH {GRID_SQL}, {CANDIDATES_SQL} SELECT source_id, candidate_id, (row_number() OVER (PARTITION BY source_id ORDER BY candidate_id) - 1) // 12 AS batch FROM cand",
    "h9_review_plan": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, n AS (SELECT *, lead(candidate_id) OVER w AS ni, lead(first) OVER w AS nf FROM cand WINDOW w AS (PARTITION BY source_id ORDER BY first, last, candidate_id)), u AS (SELECT source_id, 'local' AS kind, candidate_id AS a, NULL::BIGINT AS b FROM cand UNION ALL SELECT source_id, CASE WHEN nf <= last THEN 'overlap' ELSE 'handoff' END, candidate_id, ni FROM n WHERE ni IS NOT NULL UNION ALL SELECT source_id, 'omission', max(top), NULL FROM cand GROUP BY 1) SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY kind, a) AS ordinal FROM u",
    "h10_components": "WITH RECURSIVE e AS (SELECT l_orderkey AS a, l_partkey + 100000000 AS b FROM lineitem WHERE l_orderkey % 40 = 3), e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT DISTINCT a AS n, a AS m FROM e2 UNION SELECT r.n, e2.b FROM r JOIN e2 ON r.m = e2.a) SELECT n AS node, min(m) AS component FROM r GROUP BY 1",
    "h11_repair_plan": "WITH RECURSIVE e AS (SELECT l_orderkey AS a, l_partkey + 100000000 AS b FROM lineitem WHERE l_orderkey % 40 = 3), e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT DISTINCT a AS n, a AS m FROM e2 UNION SELECT r.n, e2.b FROM r JOIN e2 ON r.m = e2.a), c AS (SELECT n, min(m) AS component FROM r GROUP BY 1) SELECT component, count(*) AS size, (count(*) + 11) // 12 AS calls FROM c GROUP BY 1",
    "h12_assembly": "SELECT CASE WHEN o_orderkey % 9 = 1 THEN 'unplanned' WHEN o_orderkey % 15 = 0 THEN 'both' WHEN o_orderkey % 3 = 0 THEN 'shard' WHEN o_orderkey % 5 = 0 THEN 'gap' ELSE 'missing' END AS status, count(*) AS n FROM orders WHERE o_orderkey % 9 <> 1 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 GROUP BY 1",
    "h13_assessment": "SELECT criterion, count(*) AS findings FROM (SELECT 'value' AS criterion FROM events WHERE NOT value > 5 UNION ALL SELECT 'type' FROM events WHERE event_type = 'error' UNION ALL SELECT 'user' FROM events WHERE user_id % 4 = 0) GROUP BY 1",
    "h14_renderable_selection": f"WITH {GRID_SQL}, {CANDIDATES_SQL} SELECT source_id, candidate_id, first, last FROM cand WHERE candidate_id % 3 <> 1 AND candidate_id % 7 <> 0",
    "h15_h16_patched": "WITH o AS (SELECT user_id AS key, event_id AS id, 't' || event_id AS title, CASE WHEN event_id % 20 = 0 THEN 'drop' WHEN event_id % 28 = 4 THEN 'retitle' WHEN event_id % 33 = 1 AND event_id % 4 <> 0 THEN 'add' END AS op FROM events), r AS (SELECT user_id AS key, event_id AS id, event_type AS title FROM events WHERE event_id % 4 = 0), u AS (SELECT r.key, r.id, CASE WHEN op = 'retitle' THEN o.title ELSE r.title END AS title, 0 AS p FROM r JOIN o ON o.id = r.id WHERE op IS DISTINCT FROM 'drop' UNION ALL SELECT key, id, title, 1 FROM o WHERE op = 'add') SELECT key, id, title, row_number() OVER (PARTITION BY key ORDER BY p, id) AS position FROM u",
    "h17_review_commands": f"WITH {GRID_SQL}, {CANDIDATES_SQL} SELECT source_id, candidate_id, CASE candidate_id % 4 WHEN 1 THEN 'rejected' WHEN 0 THEN 'accepted' ELSE 'open' END AS status, CASE WHEN candidate_id % 4 = 2 THEN least(top, last + 1) ELSE last END AS last FROM cand",
    "h18_corrections": f"WITH {WORDS_SQL}, k AS (SELECT *, CASE WHEN ord % 23 = 7 THEN 'delete' WHEN ord % 31 = 4 THEN 'split' WHEN ord % 19 = 2 THEN 'replace' ELSE 'keep' END AS op, start_ms + (end_ms - start_ms) // 2 AS mid FROM words), u AS (SELECT source_id, ord AS parent, 0 AS part, CASE op WHEN 'split' THEN substr(text, 1, 2) WHEN 'replace' THEN text || '+' ELSE text END AS text, start_ms, CASE WHEN op = 'split' THEN mid ELSE end_ms END AS end_ms FROM k WHERE op <> 'delete' UNION ALL SELECT source_id, ord, 1, substr(text, 3), mid, end_ms FROM k WHERE op = 'split') SELECT source_id, parent, row_number() OVER (PARTITION BY source_id ORDER BY parent, part) - 1 AS ord, text, start_ms, end_ms FROM u",
    "j4_closure": "WITH RECURSIVE e AS (SELECT a, b FROM (SELECT o_orderkey AS a, unnest([o_orderkey // 2, o_orderkey // 3]) AS b FROM orders WHERE o_orderkey < 4000) WHERE b > 0), r AS (SELECT o_orderkey AS root, o_orderkey AS node FROM orders WHERE o_orderkey < 4000 AND o_orderkey % 50 = 0 UNION SELECT root, b FROM r JOIN e ON e.a = r.node) SELECT * FROM r",
    "j4_closure_all": "WITH RECURSIVE e AS (SELECT a, b FROM (SELECT o_orderkey AS a, unnest([o_orderkey // 2, o_orderkey // 3]) AS b FROM orders) WHERE b > 0), r AS (SELECT o_orderkey AS root, o_orderkey AS node FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT root, b FROM r JOIN e ON e.a = r.node) SELECT * FROM r",
    "j5_semantic_keys": f"WITH {GRID_SQL}, {CANDIDATES_SQL} SELECT source_id, min(candidate_id) AS first_id, count(*) AS n FROM cand GROUP BY source_id, last - first, first % 2",
    "r1_r2_lead_in": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, {_R}, {_T}, j AS (SELECT rg.*, tl.* EXCLUDE (source_id) FROM rg ASOF LEFT JOIN tl ON tl.source_id = rg.source_id AND rg.s >= tl.ts), f AS (SELECT *, coalesce(p_sp <> sp AND s - p_e <= {LEAD_GAP_MS} AND p_e - p_s <= {LEAD_TURN_MS}, false) AS one FROM j), h AS (SELECT *, coalesce(one AND p_a AND p_s - pp_e <= {LEAD_GAP_MS} AND pp_e - pp_s <= {SECOND_TURN_MS}, false) AS two FROM f) SELECT source_id, rid, CASE WHEN one THEN p_s ELSE s END AS one, CASE WHEN two THEN pp_s WHEN one THEN p_s ELSE s END AS two FROM h",
    "r3_r4_r5_range_ends": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, {_R}, j AS (SELECT rg.source_id, rid, s, e, coalesce(a.ends_turn AND NOT a.opens_turn AND abs(s - a.start_ms) <= 1, false) AS stale, z.pause_after_ms AS pa, z.opens_turn AS ot, z.is_question AS q, z.start_ms AS zs FROM rg ASOF LEFT JOIN grid a ON a.source_id = rg.source_id AND rg.s >= a.start_ms ASOF LEFT JOIN grid z ON z.source_id = rg.source_id AND rg.e >= z.start_ms) SELECT source_id, rid, stale, e + least(coalesce(pa, 0), {AIR_MS}) AS extended, CASE WHEN ot AND q AND zs > s THEN zs ELSE e END AS trimmed FROM j",
    "r6_shot_snap": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, {_R}, sh AS (SELECT source_id, start_ms + 300 AS t, ord FROM words WHERE ord % 17 = 5) SELECT rg.source_id, rid, coalesce(arg_min(t, ord), any_value(s)) AS snapped FROM rg LEFT JOIN sh ON sh.source_id = rg.source_id AND abs(t - s) <= {SNAP_MS} GROUP BY rg.source_id, rid",
    "r7_cutter_window": f"WITH {GRID_SQL}, {CANDIDATES_SQL}, {_R}, {_T}, o AS (SELECT rg.source_id, rid, max(turn) FILTER (ts <= s) AS at_, max(turn) FILTER (ts <= e) AS up, max(turn) AS top, min(turn) AS bot, min(turn) FILTER (te >= s - 9000) AS lo, max(turn) FILTER (ts <= e + 9000) AS hi FROM rg JOIN tt ON tt.source_id = rg.source_id GROUP BY ALL) SELECT source_id, rid, greatest(bot, least(lo, coalesce(at_, bot) - 2))::BIGINT AS first_turn, least(top, greatest(hi, coalesce(up, bot) + 1))::BIGINT AS last_turn FROM o",
}
