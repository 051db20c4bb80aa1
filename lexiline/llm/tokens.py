"""Token ids of whole texts by a public tokenizer file, a word at a time.

The vocabulary drops white space before it splits, so ids of a text are those of its words (parts
between ASCII white space) in order: every different word of a batch is encoded once, and kept in a
bounded cache. It also splits letters and digits from the signs after them and lower-cases, so signs at a word's end are words
of their own here, and words of LATIN letters, which have no other form under normalization, are kept in lower case and go straight to
the file's model, in its byte-level alphabet. The path of the file is a parameter; files are only read.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexiline.llm.common import words_of

#: text that is encoded in one step
TOKEN_BYTES = 8 << 20
#: a letter (of those that stay one letter when composed and lower-cased) or digit, then signs that end a word
WORD_END = "([0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F\u0391-\u03A9\u03B1-\u03C9\u0410-\u044F])([.,;:!?]+)([ \\n]|$)"
LATIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


def byte_alphabet() -> list[str]:
    """The character of each byte in byte-level vocabularies: itself where it prints, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """ids(texts) gives all ids in one array and the offsets of the texts in it."""

    def __init__(self, path: str, most_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # control strings in a text get their own ids, as the file's tokenizer gives them; words that would be one in lower case keep theirs
        self.control = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)", re.I)
        self.model, self.alphabet = self.tokenizer.model, {b: c for b, c in enumerate(byte_alphabet())}
        self.most_words = most_words
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _add(self, words: list[str]) -> None:
        tokenize, alphabet, latin = self.model.tokenize, self.alphabet, LATIN.fullmatch
        others = [w for w in words if not latin(w)]
        rest = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        spelt = lambda w: w if w.isascii() else w.encode().decode("latin-1").translate(alphabet)
        ids = [[t.id for t in tokenize(spelt(w))] if latin(w) else next(rest).ids for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        more, n = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), len(self.place)
        while self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(ids) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + len(more)] = more
        self.starts[n + 1 : n + 1 + len(ids)] = self.used + np.cumsum(lengths)
        self.used += len(more)
        self.place.update(zip(words, range(n, n + len(words))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, offsets = words_of(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), WORD_END, r"\1 \2\3"))
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = words.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        # words with other letters keep their case: composing marks with capitals differs
        latin = LATIN.fullmatch
        control = self.control.search
        different = [w.lower() if latin(w) or w.isascii() and not ("<" in w and control(w)) else w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        if len(self.place) + len(different) > self.most_words:
            self.clear()
        at = np.fromiter(map(self.place.get, different, repeat(-1)), np.int64, len(different))
        if len(missing := np.flatnonzero(at < 0)):
            self._add([*dict.fromkeys(different[i] for i in missing)])
            at[missing] = [self.place[different[i]] for i in missing]
        at = at[coded.indices.to_numpy()]
        parts, counts = [], [np.zeros(1, np.int64)]
        for a in range(0, len(at), 1 << 18):  # what is expanded at once is bounded
            own = at[a : a + (1 << 18)]
            first, length = self.starts[own], self.starts[own + 1] - self.starts[own]
            ends = np.cumsum(length)
            parts.append(self.flat[np.arange(ends[-1]) + np.repeat(first - (ends - length), length)])
            counts.append(length)
        return np.concatenate(parts), np.cumsum(np.concatenate(counts))[offsets]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one id more after each text."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))


def word_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
