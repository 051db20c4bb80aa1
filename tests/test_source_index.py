"""The check of a source index against the same rules written as loops over one source."""

import math
import random

import numpy as np
import pytest

from lexiline.operators.source_index import NODES, source_index, source_index_violations

SENTENCES = "source_id long, sentence_id long, start_ms long, end_ms long, text string"
NODE_TYPES = "source_id long, id string, kind string, parent string, ordinal long, place long, child_ids array<string>, first_sentence long, last_sentence long, start_ms long, end_ms long, sentences long, keywords array<string>, preview string, embedding array<double>"


@pytest.fixture(scope="module")
def index(spark):
    """A source with twenty regions in three sections, one with one sentence, and one without words."""
    rng = random.Random(6)
    vocabulary = ["Alpha", "beta", "the", "gamma", "delta", "it's", "x", "eps", "zeta", "eta", "theta", "iota", "kappa", "mu"]
    rows = [(1, 3 * i, 100 * i, 100 * i + 90, " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 70))) + "\n") for i in range(600)] + [(2, 5, 0, 9, "Alone here."), (3, 0, 0, 1, "…"), (3, 1, 1, 2, " ")]
    vectors = [(s, k, [rng.gauss(0.3, 1) for _ in range(4)]) for s, k, *_ in rows]
    nodes = source_index(spark.createDataFrame(rows, SENTENCES), spark.createDataFrame(vectors, "source_id long, sentence_id long, vec array<double>"))
    return rows, [r.asDict() for r in nodes.collect()]


def words(texts):
    import regex

    stop = set("a an and are as at be but by for from had has have he her his i if in is it its me my not of on or our she so that the their them then there they this to us was we were what when where which who will with you your".split())
    count: dict[str, int] = {}
    for w in regex.findall(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?", " ".join(texts)):
        if len(w) > 1 and w.lower() not in stop:
            count[w.lower()] = count.get(w.lower(), 0) + 1
    return sorted(count, key=lambda w: (-count[w], w))[:10]


def shown(texts):
    return " … ".join(texts[i].strip()[:240] for i in dict.fromkeys((0, len(texts) // 2, len(texts) - 1)))


def mean(children):
    v = np.average([c["embedding"] for c in children], axis=0, weights=[c["sentences"] for c in children])
    return v / np.linalg.norm(v)


def broken(rows, nodes, source):
    """Rules that nodes of a source break, one level after the other."""
    said = sorted(r for r in rows if r[0] == source)
    at = {r[1]: i for i, r in enumerate(said)}
    own = sorted((n for n in nodes if n["source_id"] == source), key=lambda n: n["place"])
    out, kinds = set(), {k: [n for n in own if n["kind"] == k] for k in ("episode", "section", "region")}
    if not all(kinds.values()):
        out.add((None, "incomplete"))
    rank = {"episode": 0, "section": 1, "region": 2}
    for before, n in zip([None, *own], own):
        flag = lambda rule, cond, n=n: cond and out.add((n["id"], rule))
        flag("duplicate", sum(m["id"] == n["id"] for m in own) > 1)
        flag("order", before is not None and (rank[n["kind"]] < rank[before["kind"]] or n["kind"] == before["kind"] == "episode"))
        norm = math.sqrt(sum(x * x for x in n["embedding"])) if n["embedding"] else math.nan
        flag("vector", not math.isclose(norm, 1, rel_tol=1e-4, abs_tol=1e-4))
    ranges = {}
    cursor = 0
    for i, r in enumerate(kinds["region"]):
        lo, hi = at.get(r["first_sentence"]), at.get(r["last_sentence"])
        if lo is None or hi is None:
            out.add((r["id"], "unknown"))
        else:
            if lo != cursor or hi < lo:
                out.add((r["id"], "partition"))
            if lo <= hi:
                ranges["region", i] = (lo, hi)
        cursor = None if hi is None else hi + 1
        if i == len(kinds["region"]) - 1 and hi != len(said) - 1:
            out.add((r["id"], "coverage"))
    for i, s in enumerate(kinds["section"]):
        parts = [ranges["region", j] for j in range(8 * i, 8 * i + 8) if ("region", j) in ranges]
        if parts:
            ranges["section", i] = (parts[0][0], parts[-1][1])
    parts = [ranges["region", j] for j in range(len(kinds["region"])) if ("region", j) in ranges]
    if parts:
        ranges["episode", 0] = (parts[0][0], parts[-1][1])
    for kind, of in kinds.items():
        for i, n in enumerate(of):
            flag = lambda rule, cond, n=n: cond and out.add((n["id"], rule))
            children = {"episode": kinds["section"] if i == 0 else [], "section": kinds["region"][8 * i : 8 * i + 8], "region": []}[kind]
            flag("name", n["id"] != ("episode" if kind == "episode" else f"{kind}-{i + 1:04d}"))
            flag("ordinal", n["ordinal"] != i)
            flag("parent", n["parent"] != {"episode": None, "section": "episode", "region": f"section-{i // 8 + 1:04d}"}[kind])
            flag("children", n["child_ids"] != [c["id"] for c in children])
            if (kind, i) in ranges:
                lo, hi = ranges[kind, i]
                texts = [r[4] for r in said[lo : hi + 1]]
                flag("count", n["sentences"] != hi - lo + 1)
                flag("span", kind != "region" and (n["first_sentence"], n["last_sentence"]) != (said[lo][1], said[hi][1]))
                flag("times", (n["start_ms"], n["end_ms"]) != (said[lo][2], said[hi][3]))
                regions = {"episode": range(len(kinds["region"])), "section": range(8 * i, 8 * i + 8), "region": [i]}[kind]
                owned = [t for j in regions if ("region", j) in ranges for t in (r[4] for r in said[ranges["region", j][0] : ranges["region", j][1] + 1])]
                flag("keywords", n["keywords"] != words(owned))
                flag("preview", n["preview"] != shown(texts))
            if kind != "region":
                flag("mean", not children or len(n["embedding"]) != len(children[0]["embedding"]) or not np.allclose(n["embedding"], mean(children), rtol=1e-6, atol=1e-6))
    return out


def found(spark, rows, indexes):
    """Violations of many indexes in one call: {source: (sentences' source, nodes)} under sources of their own."""
    nodes = [tuple(source if c == "source_id" else n[c] for c in NODES) for source, (of, own) in indexes.items() for n in own if n["source_id"] == of]
    said = [(source, *r[1:]) for source, (of, _) in indexes.items() for r in rows if r[0] == of]
    got = [tuple(r) for r in source_index_violations(spark.createDataFrame(nodes, NODE_TYPES), spark.createDataFrame(said, SENTENCES)).collect()]
    assert len(set(got)) == len([g for g in got if g[2] != "duplicate"]) + len({g for g in got if g[2] == "duplicate"}), "one row for each node and rule"
    return {source: {(i, r) for s, i, r in got if s == source} for source in indexes}


def test_a_built_index_breaks_nothing(spark, index):
    rows, nodes = index
    assert len([n for n in nodes if n["kind"] == "region"]) >= 19 + 2 and len([n for n in nodes if n["kind"] == "section"]) >= 5
    assert found(spark, rows, {source: (source, nodes) for source in (1, 2, 3)}) == {1: set(), 2: set(), 3: set()} == {source: broken(rows, nodes, source) for source in (1, 2, 3)}


CHANGES = {
    "child list": ("section-0002", {"child_ids": ["region-0009"]}), "preview": ("region-0003", {"preview": "x"}), "keywords": ("episode", {"keywords": []}), "count": ("region-0004", {"sentences": 99}),
    "renamed": ("region-0005", {"id": "region-5"}), "twice": ("region-0006", {"id": "region-0007"}), "placed first": ("region-0001", {"place": -1}), "unknown": ("region-0008", {"first_sentence": 1}),
    "gap": ("region-0009", {"first_sentence": 3 * 260}), "end": ("region-0010", {"end_ms": 1}), "vectorless": ("section-0001", {"embedding": []}), "parent": ("section-0003", {"parent": None}), "span": ("section-0002", {"last_sentence": 0}),
}


def test_changed_and_missing_nodes(spark, index):
    """One source for each change: a node with other values, vectors that are off by little and by more, and levels that are missing."""
    rows, nodes = index
    marred = {name: [n | change if n["source_id"] == 1 and n["id"] == ident else n for n in nodes] for name, (ident, change) in CHANGES.items()}
    for name, by in (("within", 1e-8), ("beyond", 1e-3)):
        marred[name] = [n | {"embedding": [x * (1 + by) for x in n["embedding"]]} if n["source_id"] == 1 and n["id"] == "episode" else n for n in nodes]
    for kind in ("episode", "section", "region"):
        marred[f"no {kind}"] = [n for n in nodes if n["source_id"] != 1 or n["kind"] != kind]
    got = found(spark, rows, {100 + k: (1, own) for k, own in enumerate(marred.values())} | {2: (2, [])})
    for k, (name, own) in enumerate(marred.items()):
        want = broken(rows, own, 1)
        if name.startswith("no "):
            assert (None, "incomplete") in got[100 + k] and (None, "incomplete") in want, name
        else:
            assert got[100 + k] == want and bool(want) == (name != "within"), name
    assert got[2] == {(None, "incomplete")} and broken(rows, marred["beyond"], 1) == {("episode", "vector"), ("episode", "mean")}
