"""Token counts by transducers against the installed library, on whole texts of every kind."""

import random

import numpy as np
import pytest

from lexiline.llm import op12_token_counts
from lexiline.llm.op12_token_counts import Counter, Splitter
from lexiline.llm.tokens import word_path

DOCS = "doc_id long, text string, n_tokens string, n_bytes int, over_limit long, lang string"
PARTS = [
    *"aberstlvdm'''  \n\t1²½ÉéΣςİß中文字😀!?", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "\x1c", "\x85", " ", "é", "̇", "ﬁ", "각", "가", "Ǆ", "​", "\0", "th", "ing",
    "tion", "Ω", "٣", "'re", "'ll", "'S", "a" * 30, "zq" * 9, "</w>", "İstanbul", "Ὀδυσσεύς",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_path())


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    common = ["".join(rng.choice("aeiounrstl") for _ in range(rng.randrange(1, 400))) for _ in range(n // 10)]
    return mixed + words + common + ["x" * 20_000, "ab" * 9_000, "'" * 700, "'re" * 300, "é" * 999, "🙂" * 500]


def test_counts_are_those_of_the_library(library):
    given = texts(12, 4000)
    want = [len(e.ids) for e in library.encode_batch(given, add_special_tokens=False)]
    assert Counter.of(word_path()).counts(given).tolist() == want


@pytest.mark.parametrize(("lane", "step"), [(1, 40), (7, 1), (64, 200)])
def test_chunks_and_steps_may_end_anywhere(library, monkeypatch, lane, step):
    monkeypatch.setattr(op12_token_counts, "LANE", lane)
    monkeypatch.setattr(op12_token_counts, "STEP", step)
    given = texts(13, 150) + ["it's we've they'll don't " * 50]
    assert Counter(word_path()).counts(given).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in given]


def test_few_states_at_a_time_give_the_same(library, monkeypatch):
    for name in ("MOST_STATES", "MOST_PAIRS", "MOST_PIECES"):
        monkeypatch.setattr(op12_token_counts, name, 50)
    given = texts(14, 300)
    assert Counter(word_path()).counts(given).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in given]


def test_scan_of_maps_is_composition_in_order():
    splitter = Counter.of(word_path()).splitter
    rng = np.random.default_rng(5)
    maps = rng.integers(0, splitter.n_states, (37, splitter.n_states)).astype(np.uint8)
    one, all_ = np.arange(splitter.n_states, dtype=np.uint8), []
    for m in maps:
        one = m[one]
        all_.append(one)
    assert (splitter.scan(maps) == np.array(all_)).all()
    a, b, c = maps[:1], maps[1:2], maps[2:3]
    assert (Splitter.compose(Splitter.compose(a, b), c) == Splitter.compose(a, Splitter.compose(b, c))).all()
    lanes = rng.integers(0, splitter.next.shape[1], (9, 50)).astype(np.uint8)
    for row, found in zip(lanes, splitter.maps(lanes)):
        for state in range(splitter.n_states):
            at = state
            for c in row:
                at = splitter.next[at, c]
            assert found[state] == at


def test_words_agree_with_the_file_whatever_came_before(library):
    """States that many words share: counts of one machine, words in any order."""
    words, rng = Counter.of(word_path()).words, random.Random(3)
    stems = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    for w in [a + b for a in stems[:40] for b in stems[40:80]]:
        assert words.run(w.encode()) == len(library.model.tokenize(w))


def test_documents(spark, library):
    given = texts(15, 60)
    rows = [(i, t, "n", 1, 2, "en") for i, t in enumerate(given)] + [(None, "two words", "n", 1, 2, None), (None, None, None, None, None, None), (3, given[3], "n", 1, 2, "en"), (900, "", "", 0, 0, ""), (901, " \n", "", 0, 0, "")]
    rows.append((902, "word " * 3000, "", 0, 0, ""))
    got = op12_token_counts.token_counts(spark.createDataFrame(rows, DOCS).repartition(4), word_path()).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, *_ in rows]
    order = lambda x: (x[0] is None, *[v or 0 for v in x])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert any(r["over_limit"] for r in got)
    assert op12_token_counts.token_counts(spark.createDataFrame([], DOCS), word_path()).collect() == []


def test_other_kinds_of_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        Counter(public_tokenizers.path("byte_bpe_50k.json"))
