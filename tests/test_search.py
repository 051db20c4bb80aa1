"""Searches against a plain search of every place."""

import random
import unicodedata

import regex

from lexiline.operators import search

ROWS = "source_id long, ord long, text string, norm string, terms int"


def plain(t):
    return unicodedata.normalize("NFKC", t).lower()


def places(rows, queries):
    found = set()
    for source in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "") for r in rows if r[0] == source)
        tokens = [(t, ord_) for ord_, text in own for t in regex.findall(r"[\p{L}\p{M}\p{N}]+", plain(text))]
        for q, text in queries.items():
            if not (needle := plain(text.strip(search.EDGE))):
                continue
            found |= {(source, q, ord_, ord_) for ord_, word in own if needle in plain(word)}
            want = regex.findall(r"[\p{L}\p{M}\p{N}]+", plain(text))
            if len(want) > 1:
                for i in range(len(tokens) - len(want) + 1):
                    if [t for t, _ in tokens[i : i + len(want)]] == want:
                        found.add((source, q, tokens[i][1], tokens[i + len(want) - 1][1]))
    return found


def test_matches(spark):
    rng = random.Random(9)
    parts = ["a", "b", "A", "ab", "a-a-a", "a’b", "ｆｉ", "ﬁ", "fi", "Ⅷ", "é", "é", "...", "", "ΑΣ", "ß", "１２", "b!", "—", "가"]
    rows = [(s, i, rng.choice(parts), "n", 1) for s in range(6) for i in range(rng.randrange(0, 120))] + [(7, 0, None, None, None), (None, 1, "a", "", 0), (None, 2, "b", "", 0)]
    queries = {1: "a b", 2: "A  A", 3: "fi", 4: "b a b", 5: "  ", 6: "a-a", 7: "é", 8: "12 b", 9: "viii", 10: "a a a", 11: "ΑΣ", 12: "b! a", 13: "—", 14: "", 15: "a b a b a", 16: "fi fi"}
    got = [tuple(r) for r in search.find_matches(spark.createDataFrame(rows, ROWS).repartition(3), queries).collect()]
    assert len(got) == len(set(got)) and set(got) == places(rows, queries)
    assert {q for _, q, a, b in got if b > a} >= {1, 2, 4, 10}
    assert search.find_matches(spark.createDataFrame([], ROWS), queries).collect() == [] == search.find_matches(spark.createDataFrame(rows, ROWS), {}).collect()


def test_automaton_is_a_search_of_every_place():
    rng = random.Random(2)
    for _ in range(200):
        patterns = {k: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for k in range(6)}
        text = "".join(rng.choice("abc") for _ in range(40))
        machine, state, got = search.Automaton(patterns.items()), 0, set()
        for i, x in enumerate(text):
            state = machine.step(state, x)
            got |= {(k, i) for k in machine.ends[state]}
        assert got == {(k, i) for k, p in patterns.items() for i in range(len(text)) if text[: i + 1].endswith(p)}
