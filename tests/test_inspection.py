"""Pages of reads against a plain loop over sentences, and literal traces."""

import hashlib
import random

import pytest

from lexiline.operators.inspection import CALLS, inspection_violations, read_pages
from lexiline.operators.source_index import _placed

NAMES = [x.rsplit(" ", 1)[0] for x in CALLS.split(", ")]
SENTENCES = "source_id long, sentence_id long, start_ms long, end_ms long, text string"
NODES = "source_id long, id string, kind string, ordinal long, child_ids array<string>"
TRACES = "trace long, source_id long, role string, retained array<long>"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(16)
    return {2 * i: "x" * rng.choice([0, 5, 900, 900, 5000, 16_000, 16_001, 40_000]) for i in range(120)}


def frame(spark, calls):
    return spark.createDataFrame([tuple(c.get(n) for n in NAMES) for c in calls], CALLS)


def page(texts, c):
    """What a read gives: (ids, next sentence, complete, fragment, next character), or None where its arguments name no range."""
    ids = sorted(texts)
    start = c["first"] if c.get("cursor_sentence") is None else c["cursor_sentence"]
    limit, character = 40 if c.get("limit") is None else c["limit"], c.get("cursor_character") or 0
    if not {c["first"], c["last"], start} <= set(ids) or not 1 <= limit <= 80 or not c["first"] <= start <= c["last"]:
        return None
    text = texts[start]
    if not 0 <= character < max(1, len(text)):
        return None
    after = lambda i: next((x for x in ids if i < x <= c["last"]), None)
    if len(text) > 16_000:
        end = min(len(text), character + 16_000)
        mark = hashlib.sha256(f"{start}:{character}:{end}".encode()).hexdigest()
        return ([], start, False, [mark], end) if end < len(text) else ([], after(start), after(start) is None, [mark], None)
    if character:
        return None
    own, chars = [], 0
    for i in (x for x in ids if start <= x <= c["last"]):
        if len(own) == limit or own and chars + len(texts[i]) > 16_000:
            break
        own.append(i)
        chars += len(texts[i])
    return own, after(own[-1]), after(own[-1]) is None, [], None


def test_pages(spark, texts):
    rng = random.Random(5)
    calls = []
    for k in range(400):
        a, b, c = sorted(rng.randrange(-1, 121) * 2 for _ in range(3))
        calls.append({"trace": 1, "seq": k, "tool": "read_source", "first": a, "last": rng.choice([b, b + 2, c, c, a - 2]), "cursor_sentence": rng.choice([None, b]), "limit": rng.choice([None, 1, 3, 80, 80, 0, 81]), "cursor_character": rng.choice([None, 0, 0, 16_000, 32_000, -1])})
    said = spark.createDataFrame([(7, i, 0, 1, t) for i, t in texts.items()], SENTENCES)
    from pyspark.sql import functions as F

    got = {r["seq"]: r for r in read_pages(frame(spark, calls).withColumn("source_id", F.lit(7).cast("long")), _placed(said)).collect()}
    kinds = set()
    for c in calls:
        r, want = got[c["seq"]], page(texts, c)
        assert r["fine"] == (want is not None), c
        if want is not None:
            mark = [hashlib.sha256(f"{r['fragment']}:{r['from']}:{r['upto']}".encode()).hexdigest()] if r["fragment"] is not None else []
            assert (r["ids"], r["after"], r["done"], mark, r["after_character"]) == want, c
            kinds.add((bool(want[0]), want[2], bool(want[3]), want[4] is None))
    assert len(kinds) >= 5


def whole_trace(trace, texts, role="author"):
    """Everything as it should be: browse in pages, a search, and all of the source."""
    sections = {f"section-{i}": [f"region-{4 * i + j}" for j in range(4)] for i in range(3)}
    calls = []
    for parent, children in {"episode": list(sections), **sections}.items():
        for a in range(0, len(children), 2):
            end = min(len(children), a + 2)
            calls.append({"tool": "browse_source", "parent_id": None if parent == "episode" else parent, "cursor": a or None, "limit": 2, "node_ids": children[a:end], "next_cursor": end if end < len(children) else None, "complete": end == len(children)})
    calls.append({"tool": "search_source", "query": "q", "cursor": 6, "node_ids": [f"region-{i}" for i in range(11, 5, -1)], "complete": True})
    calls.append({"tool": "search_source", "query": "q", "limit": 5, "node_ids": [f"region-{i}" for i in range(5)], "next_cursor": 5, "complete": False})
    if role != "author":
        calls = []
    at, character = min(texts), None
    while at is not None:
        c = {"tool": "read_source", "first": min(texts), "last": max(texts), "cursor_sentence": at, "cursor_character": character, "limit": 80}
        ids, at, done, marks, character = page(texts, c)
        calls.append(c | {"sentence_ids": ids, "next_sentence": at, "complete": done, "fragment_ids": marks, "next_character": character})
    return [c | {"trace": trace, "seq": 10 * k} for k, c in enumerate(calls)]


def test_traces(spark, texts):
    long_ = next(i for i, t in texts.items() if len(t) == 40_000)
    change = lambda t, where, **to: [c | to if where(c) else c for c in whole_trace(t, texts)]
    drop = lambda t, where: [c for c in whole_trace(t, texts) if not where(c)]
    browse, search, read = (lambda c, tool=tool: c["tool"] == tool for tool in ("browse_source", "search_source", "read_source"))
    seq = lambda k: lambda c: c["seq"] == k
    part = next(c["seq"] for c in whole_trace(0, texts) if c.get("cursor_sentence") == long_ and c["cursor_character"] == 16_000)
    once = next(c["seq"] for c in whole_trace(0, texts) if c.get("sentence_ids"))
    cases = {
        1: (whole_trace(1, texts), "author", [long_, 0], set()),
        2: (whole_trace(2, texts, "cold_reviewer"), "cold_reviewer", None, set()),
        3: (change(3, seq(0), cursor=1), "author", None, {(0, "browse_cursor")}),
        4: (change(4, seq(10), node_ids=["section-1"]), "author", None, {(10, "browse_page")}),
        5: (change(5, seq(20), next_cursor=3), "author", None, {(20, "browse_next"), (30, "browse_cursor")}),
        6: (drop(6, seq(30)), "author", None, {(40, "browse_cursor"), (50, "browse_cursor"), (60, "browse_cursor"), (70, "browse_cursor"), (None, "browse_incomplete")}),
        7: (whole_trace(7, texts) + [c | {"seq": 5} for c in whole_trace(7, texts)[1:2]], "author", None, None),
        8: (drop(8, search), "author", None, {(None, "no_search")}),
        9: (change(9, search, node_ids=["region-1", "region-1"]), "author", None, {(80, "search"), (90, "search")}),
        10: (change(10, search, complete=None), "author", None, {(80, "search_next"), (90, "search_next")}),
        11: (change(11, seq(once), limit=99), "author", None, {(once, "read_range")}),
        12: (change(12, seq(once), next_sentence=None), "author", None, {(once, "read_page")}),
        13: (drop(13, seq(part)), "author", [long_], {(None, "retained")}),
        14: (drop(14, read), "author", None, {(None, "no_speech")}),
        15: (change(15, seq(once), sentence_ids=[1]), "author", [0, 0], {(once, "read_page"), (None, "unknown_speech"), (None, "retained")}),
        16: (whole_trace(16, texts), "cold_reviewer", [], {(10 * k, "tool") for k in range(10)}),
    }
    rows = [(1, "episode", "episode", 0, [f"section-{i}" for i in range(3)])] + [(1, f"section-{i}", "section", i, [f"region-{4 * i + j}" for j in range(4)]) for i in range(3)] + [(1, f"region-{i}", "region", i, []) for i in range(12)]
    calls = frame(spark, [c for own, *_ in cases.values() for c in own])
    traces = spark.createDataFrame([(t, 1, role, kept) for t, (_, role, kept, _) in cases.items()], TRACES)
    got = inspection_violations(calls, traces, spark.createDataFrame(rows, NODES), spark.createDataFrame([(1, i, 0, 1, t) for i, t in texts.items()], SENTENCES)).collect()
    for t, (*_, want) in cases.items():
        found = {(r["seq"], r["rule"]) for r in got if r["trace"] == t}
        assert found == want if want is not None else any(rule.startswith("browse") for _, rule in found), (t, found)
