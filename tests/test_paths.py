"""Constrained paths against all paths; resampling, overlap matching and admission against plain loops."""

import itertools
import random
import struct
import time

import numpy as np
import xxhash

from lexiline.operators import aggregate, metrics
from lexiline.operators.compile import compiled_cover, owned_paths

LAYERS = "source_id long, layer long, ms long, cost long, bid string, rank long"
QUOTES = "source_id long, section long, start_ms long, end_ms long"


def test_owned_paths_are_the_best_of_all(spark):
    rng = random.Random(34)
    layers, quotes, durations = [], [], []
    for source in range(300):
        n, top = rng.randrange(1, 5), rng.randrange(20, 60)
        durations.append((source, top))
        layers += [(source, layer, rng.randrange(-3, 65), rng.randrange(4), f"b{rng.randrange(100)}-{i}", 1) for layer in range(n) for i in range(rng.randrange(1, 5))]
        for section in range(n + 1):
            quotes += [(source, section, a, a + rng.randrange(0, 5)) for a in [max(0, int(top * (section + 0.5) / (n + 1)) + rng.randrange(-6, 6))] if rng.random() < 0.6]
    durations += [(900, 50)]  # without any cut
    paths = owned_paths(*(spark.createDataFrame(x, t) for x, t in ((layers, LAYERS), (quotes, QUOTES), (durations, "source_id long, duration_ms long"))))
    got: dict[int, list] = {}
    for r in sorted(paths.collect(), key=lambda r: (r["source_id"], r["layer"])):
        got.setdefault(r["source_id"], []).append(r)
    none = 0
    for source, top in durations[:-1]:
        own = [[r for r in layers if r[:2] == (source, k)] for k in sorted({r[1] for r in layers if r[0] == source})]
        best = None
        for p in itertools.product(*own):
            cuts = [0, *(r[2] for r in p), top]
            if all(a < b for a, b in zip(cuts, cuts[1:])) and all(2 * cuts[q[1]] <= q[2] + q[3] < 2 * cuts[q[1] + 1] for q in quotes if q[0] == source):
                key = (sum(r[3] for r in p), [r[2] for r in p], [r[4] for r in p])
                best = key if best is None or key < best else best
        if best is None:
            none += 1
            assert [r["layer"] for r in got[source]] == [-1]
        else:
            assert ([r["total"] for r in got[source]], [r["ms"] for r in got[source]], [r["bid"] for r in got[source]]) == ([best[0]] * len(own), best[1], best[2])
    assert 30 < none < 270
    cover: dict[int, list] = {}
    for r in sorted(compiled_cover(paths, spark.createDataFrame(durations, "source_id long, duration_ms long")).collect(), key=lambda r: (r["source_id"], r["section"])):
        cover.setdefault(r["source_id"], []).append((r["start_ms"], r["end_ms"], r["start_bid"], r["end_bid"]))
    for source, top in durations:
        cuts = [] if source == 900 else [(r["ms"], r["bid"]) for r in got[source]]
        edges = [(0, None), *cuts, (top, None)]
        assert cover.get(source) == (None if cuts and cuts[0][0] is None else [(a[0], b[0], a[1], b[1]) for a, b in zip(edges, edges[1:])])


def test_bootstrap_draws_are_recomputed(spark):
    rng = random.Random(18)
    deltas = {"one": [0.25], "two": [0.5, -1.0], "many": [rng.randrange(-64, 64) / 64 for _ in range(23)]}
    rows = [(k, i, x) for k, v in deltas.items() for i, x in enumerate(v)]
    rng.shuffle(rows)
    got = {r["key"]: r for r in aggregate.bootstrap_interval(spark.createDataFrame(rows, "key string, pair long, delta double"), 400, 7).collect()}
    for key, v in deltas.items():
        assert got[key]["n"] == len(v) and abs(got[key]["mean"] - np.mean(v)) < 1e-6
        if len(v) == 1:
            assert got[key]["low"] is None and got[key]["high"] is None
            continue
        means = []
        for r in range(400):
            total = 0.0
            for k in range(len(v)):
                h = 42
                for part in (struct.pack("<i", 7), key.encode(), struct.pack("<i", r), struct.pack("<q", k)):
                    h = xxhash.xxh64_intdigest(part, seed=h)
                total += v[(h - (1 << 64) if h >> 63 else h) % len(v)]
            means.append(total / len(v))
        means.sort()
        assert abs(got[key]["low"] - means[9]) < 1e-6 and abs(got[key]["high"] - means[389]) < 1e-6


def test_overlap_matching(spark):
    rng = random.Random(8)
    rows = []
    for source in range(60):
        for side in (0, 1):
            for _ in range(rng.randrange(0, 6)):
                a = rng.randrange(0, 40)
                rows.append((source, a, a + rng.randrange(1, 20), side))
    got = {r["source_id"]: r["f1"] for r in metrics.overlap_match(spark.createDataFrame(rows, "source_id long, start_ms long, end_ms long, side int")).collect()}
    for source in {r[0] for r in rows}:
        ref, hyp = ([r for r in sorted(r[1:3] for r in rows if r[0] == source and r[3] == side)] for side in (0, 1))
        pairs = []
        for i, (a, b) in enumerate(ref):
            for j, (c, d) in enumerate(hyp):
                both = min(b, d) - max(a, c)
                if both > 0:
                    pairs.append((both / (max(b, d) - min(a, c)), i, j))
        total = 0.0
        for t in metrics.IOU_STEPS:
            left, right = set(), set()
            for v, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
                if v >= t and i not in left and j not in right:
                    left.add(i), right.add(j)
            total += 2 * len(left) / (len(ref) + len(hyp))
        assert abs(got[source] - total / len(metrics.IOU_STEPS)) < 1e-6, source


def test_admission_streams(spark):
    rng = random.Random(15)
    rows = [(run, i, rng.randrange(0, 50)) for run in range(4) for i in range(16_000 if run == 0 else 50)]
    frame = spark.createDataFrame(rows, "run long, attempt long, cost long").repartition(3)
    frame.count()
    began = time.perf_counter()
    got = {(r["run"], r["attempt"]): (r["running"], r["admitted"]) for r in aggregate.admission(frame, 600_000, 20_000).collect()}
    took = time.perf_counter() - began
    for run in range(4):
        spent = n = 0
        for _, i, cost in [r for r in rows if r[0] == run]:
            fits = spent + cost <= 600_000 and n < 20_000
            spent, n = (spent + cost, n + 1) if fits else (spent, n)
            assert got[run, i] == (spent, fits)
    assert took < 20


SF = "/root/testdata/sf0.001"


def largest_matching(ref, hyp, tolerance):
    """Pairs of points that are near, each point once, as many as possible: by augmenting paths, in any order of points."""
    near = {i: [j for j, y in enumerate(hyp) if abs(x - y) <= tolerance] for i, x in enumerate(ref)}
    taken: dict[int, int] = {}

    def place(i, seen):
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in near)


def test_agreement_of_segmenters(spark):
    from lexiline.operators.segment import sentence_grid
    from lexiline.sources.timeline import words

    grid = sentence_grid(words(spark, SF)).select("source_id", "end_ms", "pause_after_ms").collect()
    points = {k: {} for k in (700, 1500, 2500)}
    for r in grid:
        for k, own in points.items():
            if r["pause_after_ms"] is not None and r["pause_after_ms"] >= k:
                own.setdefault(r["source_id"], []).append(r["end_ms"])
    want = {}
    for a, b in itertools.combinations(points, 2):
        for source in points[a].keys() | points[b].keys():
            r, h = points[a].get(source, []), points[b].get(source, [])
            n = largest_matching(r, h, metrics.TOLERANCE_MS)
            p, c = (n / len(h) if h else 0.0), (n / len(r) if r else 0.0)
            want[source, a, b] = round(2 * p * c / (p + c), 6) if p + c else 0.0
    assert {(r["source_id"], r["a"], r["b"]): r["f1"] for r in metrics.QUERIES["g9_agreement"](spark, SF).collect()} == want and want


def test_compiled_sections_follow_the_path(spark):
    from lexiline.operators.compile import QUERIES

    path: dict[int, list] = {}
    for r in QUERIES["h3_shortest_paths"](spark, SF).collect():
        if r["layer"] >= 0:
            path.setdefault(r["source_id"], []).append((r["layer"], r["ms"]))
    want = set()
    for source, cuts in path.items():
        ms = [m for _, m in sorted(cuts)]
        assert ms == sorted(set(ms))
        want |= {(source, i + 1, a, b) for i, (a, b) in enumerate(zip(ms, [*ms[1:], None]))}
    got = [(r["source_id"], r["section"], r["start_ms"], r["end_ms"]) for r in QUERIES["h4_compiled_sections"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
