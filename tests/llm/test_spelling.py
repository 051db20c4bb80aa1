"""Spelling variants against brute force: every pair of words is compared by the definition."""

import random
import re
import zlib
from collections import Counter

import pytest

from lexiline.llm import op11_spelling
from lexiline.llm.common import workspace

DOCS = "doc_id long, text string, word string, n int, block long, own string, near_n string"


def corpus() -> list[tuple]:
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdéß") for _ in range(rng.randrange(3, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aabaa", "abaaa", "ÿÿÿÿÿÿ"]

    def typo(w: str) -> str:
        i, kind = rng.randrange(len(w)), rng.random()
        return w[:i] + w[i + 1 :] if kind < 0.3 else w[:i] + rng.choice("abcdé") + w[i + (kind < 0.6) :]

    texts: list[str | None] = []
    for _ in range(50):
        words = [rng.choice(stems) for _ in range(rng.randrange(0, 60))]
        words = [typo(w) if rng.random() < 0.3 else w for w in words]
        texts.append(rng.choice([" ", "-", "\n", "7"]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    texts += [None, "", "123 ...", "x" * 5000, "Élan élan ÉLAN élan", texts[0], texts[0]]
    rows = [(i, t, "w", 1, 2, "o", "n") for i, t in enumerate(texts)]
    return rows + rows[:2] + [(None, *rows[3][1:]), (None, None, *rows[3][2:])]


def counted(rows, every, shortest, rarest):
    found = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= rarest}


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    out = {}
    for w, n in words.items():
        own = [v for v in words if near(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        out[w] = (n, len(own), best if own and words[best] >= 2 * n else None)
    for w in words:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w] += (None if out[w][2] is None else words[out[w][2]], root)
    return out


@pytest.mark.parametrize(("every", "shortest", "rarest"), [(97, 5, 3), (3, 1, 1), (1, 2, 2)])
def test_variants(spark, every, shortest, rarest):
    rows = corpus()
    words = op11_spelling.vocabulary(spark.createDataFrame(rows, DOCS).repartition(3), every, shortest, rarest)
    got = op11_spelling.spelling_variants(words, workspace(spark)).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == expected(counted(rows, every, shortest, rarest))
    assert len(got) == len({r["word"] for r in got}) and any(r["form"] for r in got)


def test_small_steps_give_the_same(spark, monkeypatch):
    """Groups are whole however few rows a task holds, and counts add up however often its table is emptied."""
    monkeypatch.setattr(op11_spelling, "GROUP_ROWS", 3)
    rows = corpus()
    found = counted(rows, 97, 3, 1)
    pairs = op11_spelling.near_pairs(spark.createDataFrame(list(found.items()), "word string, n long")).collect()
    assert sorted((r["word"], r["near"], r["near_n"]) for r in pairs) == sorted((a, b, n) for a in found for b, n in found.items() if near(a, b))


def test_neighbourhood_is_whole_and_without_repeats():
    letters = "abc"
    made = op11_spelling.Neighbourhood(letters)
    for word in ("a", "aab", "abcabcc", "bbbb"):
        w, found = made.matrix([word]), []
        edge = op11_spelling.bounds(len(word))
        for j in range(len(edge) - 1):
            for hashed, counts, kind, place in made.edits(w, edge[j], edge[j + 1]):
                for c in range(hashed.shape[1]):
                    if counts[0, c]:
                        candidate = made.spelt(word, kind, place, c)
                        assert not candidate or made.hashed(made.matrix([candidate]))[0] == hashed[0, c]
                        found.append(candidate)
        every = {word[:i] + x + word[i + d :] for i in range(len(word) + 1) for d in (0, 1) for x in ("", *letters) if (d or x) and i + d <= len(word)} - {word}
        assert sorted(found) == sorted(every)


def test_chains_and_hot_roots(spark):
    """A chain of forms, and many words of one root."""
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [(f"v{i}", "w0") for i in range(1500)]
    got = {r["word"]: r["root"] for r in op11_spelling.roots(spark.createDataFrame(chain, "word string, form string"), workspace(spark)).collect()}
    assert set(got.values()) == {"w20"} and len(got) == len(chain)


def test_empty_table(spark):
    words = op11_spelling.vocabulary(spark.createDataFrame([], DOCS))
    assert op11_spelling.spelling_variants(words, workspace(spark)).collect() == []
