"""The corpus operators against brute force on small tables: copies, near copies, shared passages, nulls, empty and long texts, repeated rows,
columns with clashing names, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiline.llm import op1_packing, op2_near_dedup, op3_chat_format, op4_warc, op5_substring_dedup, op6_license_scan, op7_decontaminate, op8_token_output, op9_quality, op10_suffix_dedup
from lexiline.llm.tokens import word_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, g long, bucket int, words string, kept int, copy long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts: list[str | None] = []
    for i in range(n):
        kind = rng.random()
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
            continue
        if kind < 0.45 and (old := [t for t in texts if t]):
            words = rng.choice(old).split()
            for _ in range(rng.randrange(1, 6)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.6:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        elif kind < 0.7:
            words = words[:12] * 4 + words
        text = " ".join(words)
        texts.append(text.replace(" ", rng.choice(["\n", " ", "  ", "\t"]), 3))
    texts += [None, "", "   \n", "one", "x" * 3000, " ".join(passage * 30)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b"]), len(t or ""), 0, 0, "w", 1, 2) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in corpus()}


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and null ids."""
    rows = [r for r in corpus(3, 12)]
    return spark.createDataFrame(rows + rows[:3] + [(None, *rows[0][1:]), (None, None, *rows[0][2:])], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(word_path())
    return ids_of.t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, texts, odd, none):
    rows = op1_packing.best_fit_packing(docs, word_path(), capacity=256, block_pieces=40).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for doc, text in texts.items():
        ids = [*ids_of(text), 0]
        total += len(ids)
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, a, len(ids[a : a + 256]), crc(ids[a : a + 256])) for k, a in enumerate(range(0, len(ids), 256))]
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))] and sum(r["length"] for r in own) <= 256
    assert len(by_sequence) <= -(-total // 256) + 3
    assert op1_packing.best_fit_packing(odd, word_path()).count() >= odd.count() and op1_packing.best_fit_packing(none, word_path()).count() == 0


def test_near_duplicates(docs, texts, odd, none):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op2_near_dedup.near_duplicates(docs).collect()}
    assert got == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
    assert op2_near_dedup.near_duplicates(odd).count() == odd.count() and op2_near_dedup.near_duplicates(none).count() == 0


def test_thresholds_of_near_duplicates(spark):
    """Higher thresholds keep only their own links, lower ones are refused."""
    words = [f"w{i}" for i in range(204)]
    rows = [(i, " ".join([*words[:at], f"x{i}", *words[at + 1 :]]) if at else " ".join(words)) for i, at in enumerate((0, 2, 100))] + [(3, " ".join(words[:184]))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (75, 90, 96):
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
        root = {i: i for i in sets}
        for _ in sets:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert {r["doc_id"]: r["component_id"] for r in op2_near_dedup.near_duplicates(frame, threshold).collect()} == root
    with pytest.raises(ValueError):
        op2_near_dedup.near_duplicates(frame, 74)


def test_rounds_of_near_duplicates(spark):
    """A chain of texts, each near the next one only, is one component."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(15):
        rows.append((i, " ".join(words)))
        words = words[6:] + [f"n{rng.randrange(10**6)}" for _ in range(6)]
    got = op2_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_short_near_duplicates(spark):
    """Pairs of 6 to 15 words at exactly the threshold are linked, whatever their hashes."""
    rng = random.Random(10)
    shapes = [(a, t, b) for a in range(2, 12) for b in range(2, 12) for t in range(a) if 4 * (min(a, t + b) - t) == 3 * max(a, t + b)]
    assert (3, 0, 4) in shapes and (7, 1, 7) in shapes and (6, 0, 8) in shapes
    rows, want = [], {}
    for i in range(900):
        a, t, b = shapes[i % len(shapes)]
        words = [f"w{rng.randrange(10**9)}" for _ in range(max(a, t + b) + 4)]
        rows += [(2 * i, " ".join(words[: a + 4])), (2 * i + 1, " ".join(words[t : t + b + 4]))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    for i in range(900, 950):  # 2 of 3
        words = [f"w{rng.randrange(10**9)}" for _ in range(7)]
        rows += [(2 * i, " ".join(words[:6])), (2 * i + 1, " ".join(words))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + 1}
    got = {r["doc_id"]: r["component_id"] for r in op2_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_substrings(docs, texts, odd, none):
    seen, want = set(), {}
    for d in sorted(texts):
        w = WORD.findall(texts[d])
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    rows = op5_substring_dedup.strip(docs, texts=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], " ".join(WORD.findall(r["text"]))) for r in rows} == want
    assert sum(x[1] for x in want.values()) > 500
    assert op5_substring_dedup.strip(odd).count() == odd.count() and op5_substring_dedup.strip(none).count() == 0
    assert all(r["n_removed"] == 0 for r in op5_substring_dedup.strip(odd).collect() if r["doc_id"] is None)


def test_suffixes(docs, texts, odd, none):
    first, want = {}, {}
    data = {d: t.encode() for d, t in texts.items()}
    for d in sorted(data):
        for i in range(len(data[d]) - 49):
            first.setdefault(data[d][i : i + 50], d)
    for d, t in data.items():
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[d] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, x in zip(t, gone) if not x)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op10_suffix_dedup.strip(docs).collect()}
    assert got == want
    assert op10_suffix_dedup.strip(odd).count() == odd.count() and op10_suffix_dedup.strip(none).count() == 0


def test_rows_of_one_doc_id(spark):
    """Two texts of one doc_id and three null ids: each row is judged by itself, and null ids are left alone."""
    rng = random.Random(15)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = noise(30)
    rows = [(1, f"{shared} {noise(10)}"), (2, f"{noise(5)} {shared} {noise(9)}"), (2, noise(25)), (2, noise(25)), (3, f"{shared}"), (None, shared), (None, shared), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in op5_substring_dedup.strip(docs).collect())
    assert got == [(0, 0, 0), (0, 30, 0), (0, 30, 0), (1, 40, 0), (2, 25, 0), (2, 25, 0), (2, 44, 30), (3, 30, 30)]
    size = lambda t: len((t or "").encode())
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in op10_suffix_dedup.strip(docs).collect())
    n = size(shared)
    assert [x[:2] for x in got] == sorted((d or 0, size(t)) for d, t in rows) and {x[2] for x in got if x[0] in (0, 1)} == {0}
    assert [x[2] for x in got if x[0] == 3] == [n] and sorted(x[2] > 0 for x in got if x[0] == 2) == [False, False, True]
    got = sorted(map(tuple, op2_near_dedup.near_duplicates(docs).select(F.coalesce("doc_id", F.lit(0)), "n_shingles", F.coalesce("component_id", F.lit(0)), "kept").collect()))
    assert got == [(0, 0, 0, True), (0, 26, 0, True), (0, 26, 0, True), (1, 36, 1, True), (2, 21, 2, True), (2, 21, 2, True), (2, 40, 2, True), (3, 26, 3, True)]


def test_many_near_misses(spark):
    """Families whose members are near a hub, near each other or near none: blocks and pivots lose no link."""
    rng = random.Random(16)
    rows, i = [], 0
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(1, 5)):
                own[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(own)))
            i += 1
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(56)} for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in op2_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: find(d) for d in sets} and len(set(got.values())) > 12


def test_hot_contexts(docs, texts, monkeypatch):
    monkeypatch.setattr(op10_suffix_dedup, "HOT", 1)
    plain = {r["doc_id"]: r["kept_sha256"] for r in op10_suffix_dedup.strip(docs).collect()}
    monkeypatch.undo()
    assert plain == {r["doc_id"]: r["kept_sha256"] for r in op10_suffix_dedup.strip(docs).collect()}


def test_common_prefixes_of_a_transform():
    rng = np.random.default_rng(5)
    t = np.append(rng.integers(1, 4, 300), 0)
    sa = op10_suffix_dedup.bounded_suffix_array(t, 8)
    shared = op10_suffix_dedup.open_pairs(t, sa, 6)
    key = lambda i: tuple(t[i : i + 6])
    assert [bool(x) for x in shared[1:]] == [key(a) == key(b) for a, b in zip(sa, sa[1:])]


def test_contamination(spark, docs, texts, odd, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = [(i, " ".join(cut(texts[d])[3 : 3 + n])) for i, (d, n) in enumerate([(5, 12), (8, 30), (11, 7), (14, 3), (20, 10), (21, 1)])] + [(90, None), (91, ""), (92, "zzz yyy xxx")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = cut(t or "")
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {}
    for d, t in texts.items():
        w, hit, found = cut(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= own
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in op7_decontaminate.decontaminate(docs, bench).collect()}
    assert got == want and any(x[4] for x in want.values())
    assert op7_decontaminate.decontaminate(odd, bench).count() == odd.count() and op7_decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r["contaminated"] for r in op7_decontaminate.decontaminate(docs, bench.limit(0)).collect())



def test_contamination_near_the_window(spark):
    # nine shared words aren't a hit, though grams of five are shared; repeated words make equal grams; a hit lies at either end
    item = [f"w{k}" for k in range(14)]
    rows = [(1, item[:9]), (2, [*"abc", *item[2:12], "z"]), (3, ["x"] * 30), (4, [*item[:9], "q", *item[5:14]]), (5, [*item[4:14], *"de"]), (6, item[:5] * 3), (7, None)]
    docs = spark.createDataFrame([(d, w and " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", " ".join(["x"] * 12)), ("c", " ".join(item[3:13]))], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in op7_decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (0, 0), 2: (10, 1), 3: (30, 1), 4: (0, 0), 5: (10, 1), 6: (0, 0), 7: (0, 0)}

def test_token_files(docs, texts, odd, none, tmp_path):
    manifest = op8_token_output.write(docs, f"file://{tmp_path}/a", word_path())
    want, at = {}, 0
    for d in sorted(texts):
        ids = [*ids_of(texts[d]), 1]
        want[d] = (at, len(ids), crc(ids), ids)
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op8_token_output.read(manifest).collect()} == {d: x[:3] for d, x in want.items()}
    parts = sorted((r["doc_id"], r["first"], r["ids"]) for r in op8_token_output.read(manifest, with_ids=True).collect())
    whole: dict = {}
    for d, first, ids in parts:
        assert len(whole.setdefault(d, [])) == first
        whole[d] += ids
    assert whole == {d: x[3] for d, x in want.items()}
    assert op8_token_output.read(op8_token_output.write(odd, f"file://{tmp_path}/b", word_path())).count() == odd.count()
    assert op8_token_output.read(op8_token_output.write(none, f"file://{tmp_path}/c", word_path())).count() == 0


def test_control_strings():
    import pyarrow as pa

    from lexiline.llm.tokens import Encoder

    said = ["hi <|startoftext|> there<|startoftext|>", "a<|endoftext|>b, c. <|ENDOFTEXT|> X<|EndOfText|>y", "<|endoftext|>", "é<|endoftext|>É! <|startoftext |>", "W<|endoftext|>. ok?"]
    ids, offsets = Encoder(word_path()).ids(pa.array(said))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids_of(t) for t in said]


def test_crossover_beats_best_fit():
    """Pieces of a third to a half of a sequence, where best fit misses the bound: generations come nearer to it and no piece is lost."""
    rng, better = random.Random(3), 0
    for seed in range(4):
        sizes = []
        for _ in range(60):
            a, b = rng.randrange(300, 380), rng.randrange(300, 380)
            sizes += [a, b, 1000 - a - b]
        start = op1_packing.refit([], list(range(len(sizes))), sizes, 1000)
        best = op1_packing.evolve(sizes, 1000, seed, 8, 25)[0]
        assert sorted(i for b in best for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 1000 for b in best)
        assert len(best) <= len(start)
        better += len(best) < len(start)
    assert better


@pytest.mark.parametrize("top", [1, 2, 300, 70_000, 2**32 - 1])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(top % 97)
    ids = np.where(rng.random(9000) < 0.02, rng.integers(0, top + 1, 9000), rng.integers(0, min(top, 40) + 1, 9000)).astype(np.uint32)
    assert (op8_token_output.decode_blocks(op8_token_output.encode_blocks(ids, 0.95)) == ids).all()


def test_quality(docs, texts, odd, none):
    got = {r["doc_id"]: r for r in op9_quality.judge(op9_quality.measure(docs)).collect()}
    for d, t in texts.items():
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        again = {i + j for i, g in enumerate(seen) if seen.count(g) > 1 for j in range(5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert tuple(got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (got[d]["kept"] and want[-1])
    assert op9_quality.judge(op9_quality.measure(odd)).count() == odd.count() and op9_quality.judge(op9_quality.measure(none)).count() == 0


def test_thresholds_follow_their_group(spark):
    """A source of long words judges by long words; a document that is fine in one source is not in the other."""
    rng = random.Random(4)
    text = lambda n, k=60: " ".join("".join(rng.choice("abcdefgh") for _ in range(max(1, n + rng.randrange(-1, 2)))) for _ in range(k)) + "."
    rows = [(i, text(4), "en", "short") for i in range(1000)] + [(2000 + i, text(14), "en", "long") for i in range(1000)] + [(5000, text(14), "en", "short"), (5001, text(4), "en", "long"), (5002, text(4), "en", "short"), (5003, text(14), "en", "long")]
    judged = op9_quality.judge(op9_quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    got = {r["doc_id"]: r["kept"] for r in judged.collect()}
    assert [got[k] for k in (5000, 5001, 5002, 5003)] == [False, False, True, True] and sum(got.values()) == 2002
    limits = op9_quality.thresholds(judged).collect()
    assert len({r["most_word_length"] for r in limits}) == 2


def test_measuring_one_text_is_quick(spark):
    import time

    one = spark.createDataFrame([(1, "some words of a text that goes on and on " * 40, "en", "a", 7)], "doc_id long, text string, lang string, source string, n_words int")
    began = time.perf_counter()
    assert [r["n_words"] for r in op9_quality.judge(op9_quality.measure(one)).collect()] == [400]
    assert time.perf_counter() - began < 30


def test_sketches_merge(docs):
    m = op9_quality.measure(docs)
    halves = op9_quality.sketches(m.filter("doc_id % 2 = 0")).unionByName(op9_quality.sketches(m.filter("doc_id % 2 = 1")))
    merged = halves.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, merged.collect())) == sorted(map(str, op9_quality.sketches(m).collect()))


def test_licenses(spark, none, odd):
    notices = op6_license_scan.NOTICES
    rng = random.Random(8)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{noise(rng.randrange(60))}\n{t}\n{noise(rng.randrange(60))}") for i, t in enumerate([*notices.values()] * 5)] + [(100, noise(200)), (101, None), (102, "")]
    templates = spark.createDataFrame([*notices.items()], "license_id string, text string")
    got = {(r["doc_id"], r["license_id"]) for r in op6_license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    # the header's first line is the notice too
    assert got == {(i, n) for i, n in enumerate([*notices] * 5)} | {(i, "apache-2.0") for i, n in enumerate([*notices] * 5) if n == "apache-2.0-header"}
    many = [(f"l{i}", noise(400)) for i in range(70)]  # some 28,000 shingles
    cut = [(i, " ".join(t.split()[40:380]) if i % 2 else " ".join(t.split()[200:])) for i, (_, t) in enumerate(many[:20])]
    found = op6_license_scan.license_scan(spark.createDataFrame(cut, "doc_id long, text string"), spark.createDataFrame(many, "license_id string, text string"))
    assert sorted((r["doc_id"], r["license_id"]) for r in found.collect()) == [(i, f"l{i}") for i in range(1, 20, 2)]
    assert op6_license_scan.license_scan(none, templates).count() == 0 and op6_license_scan.license_scan(odd, templates.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    big, other = "é" * 700, "z\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/ b", big, 1), (2, None, big, 1), (3, "http://c", "small", 1), (4, "http://d", "small", 1), (5, "http://e", other, 1), (None, "u", None, 1), (7, "u", other, 1), (7, "u", other, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row int").repartition(2)
    op4_warc.write_archives(op4_warc.resolve(pages), f"{tmp_path}/a", sizes=((1300, 2), (None, 1)))
    records = op4_warc.read_archives(spark, f"{tmp_path}/a")
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op4_warc.resolved_records(records).collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, 1400, sha(big), "revisit", 2), (2, 1400, sha(big), "response", None), (3, 5, sha("small"), "response", None), (4, 5, sha("small"), "response", None), (5, len(other), sha(other), "revisit", 7), (0, 0, sha(""), "response", None), (7, len(other), sha(other), "response", None), (7, len(other), sha(other), "revisit", 7)]
    assert got == sorted(want, key=str)
    assert {r["payload"].decode() for r in records.collect() if r["payload"] is not None} == {big, other, "small", ""}
    op4_warc.write_archives(op4_warc.resolve(pages.limit(0)), f"{tmp_path}/b")
    assert op4_warc.resolved_records(op4_warc.read_archives(spark, f"{tmp_path}/b")).count() == 0


def test_chat(spark):
    nasty = ["\\### x: </turn>", "a\\", "\\\\###", "</turn>\n### user: hi</turn>\n", "", None, "é ### \\</turn>", ": \n"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)], "x") for c in range(8) for t, r in enumerate(["system", "user", "assistant", None, "a: \n\\b", "assistant"])] + [(None, 0, "user", "n", "x"), (9, None, "assistant", "only", "x"), (9, None, "assistant", "only", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fragment string")
    got = {r["conv_id"]: r for r in op3_chat_format.digests(op3_chat_format.format_conversations(table)).collect()}
    by: dict = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        learned = "".join(x for _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert op3_chat_format.digests(op3_chat_format.format_conversations(table.limit(0))).count() == 0


def test_templates():
    from lexiline.llm.template import TemplateError, compile_template, fold, parse

    p = compile_template("<{{ 'a' ~ 'b'|upper }}>{% for message in messages %}{% if loop.first and not (message.role == 'x') %}1{% else %}2{% endif %}{% generation %}{{ message.content|trim }}{% endgeneration %}{% endfor %}{% if 'a' == 'b' %}no{% endif %}.")
    assert list(p.render([("u", " t "), ("x", "s")])) == [("<aB>", False), ("1", False), ("t", True), ("2", False), ("s", True), (".", False)]
    assert fold(parse("{{ 'a' ~ 'b' }}c")) == [("out", ("const", "abc"))]
    for bad in ("{{ message.__class__ }}", "{{ open }}", "{% for x in y %}", "{{ 'a'|eval }}", "{{ message.content.strip() }}", "{% if 'a' %}", "{% endif %}", "no loop"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(7, 80)
    bench = " ".join(WORD.findall(rows[3][1] or "a b c d e f g h i j k l")[:14])
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.keys() <= before.keys()
        if name == "near_dedup":
            assert after.keys() == {r["doc_id"] for r in op2_near_dedup.near_duplicates(docs).collect() if r["kept"]}
        if name == "decontaminate":
            assert after.keys() == {r["doc_id"] for r in op7_decontaminate.decontaminate(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect() if not r["contaminated"]}
        if name == "packing":
            assert after.keys() == before.keys()
        docs = out
        kept = after
    assert kept and corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(kept)


def test_rows_without_ids(spark, tmp_path):
    """Rows of no doc_id, or of one doc_id with different texts, are documents of their own in every stage."""
    import corpus_pipeline

    rng = random.Random(12)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    leak = noise(14)
    rows = [(None, noise(30), "en", "a", 0), (None, f"{noise(9)} {leak}", "de", "b", 0), (None, noise(40), "fr", "c", 0), (1, noise(30), "en", "a", 0), (1, f"{leak} {noise(9)}", "de", "b", 0), (1, noise(35), "fr", "c", 0), (2, noise(5), "en", "a", 0)]
    rows = [(*r[:4], len(r[1])) for r in rows]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    order = lambda x: sorted(map(tuple, x), key=str)
    marked = op7_decontaminate.decontaminate(docs.filter("doc_id is null"), bench).collect()
    assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in marked) == [(23, 14, True), (30, 0, False), (40, 0, False)]
    assert order(corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == order(rows)
    once = spark.createDataFrame([r for r in rows if r[0] is None or r[2] != "de"], docs.schema)
    assert order(corpus_pipeline.substrings(spark, once, str(tmp_path)).collect()) == order(once.collect())
    assert order(corpus_pipeline.decontamination(spark, docs, str(tmp_path)).distinct().collect()) == order(r for r in rows if leak not in r[1])


def test_substring_index_that_lasts(spark, docs, tmp_path):
    """Batches added by calls that open the index anew give what one call over all documents gives, across a compaction."""
    whole = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op5_substring_dedup.strip(docs).collect()}
    ids, got = sorted(whole), {}
    cuts = [ids[len(ids) * k // 4] for k in range(4)] + [ids[-1] + 1]
    for a, b in zip(cuts, cuts[1:]):
        index = op5_substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index", expected_bytes=1 << 26, fanout=1)
        got |= {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in index.add(docs.filter((docs.doc_id >= a) & (docs.doc_id < b))).collect()}
    assert got == whole
    with pytest.raises(ValueError):
        op5_substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index").add(docs)
    last = op5_substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index")
    assert len(last.batches) == 4 and len(last.index.runs) == 2
    assert last.add(docs.limit(0)).count() == 0
