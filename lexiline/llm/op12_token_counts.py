"""Token counts by finite-state transducers that are compiled from a public tokenizer file.

Two deterministic transducers give the number of tokens without making any.

Splitter: the file's pattern (contractions, runs of letters, single numbers, runs of other signs) as a machine of a few states over classes of
characters, which the installed library itself tells apart. Its transitions say where a piece begins. A batch of texts is cut into chunks
of LANE characters, wherever that falls; each chunk gives a map from every state at its start to the state at its end, the maps are
composed by a parallel prefix scan (doubling), and then every chunk runs from its known state. All chunks advance together.

Words: byte-pair encoding of a piece as a transducer over bytes. Encodings are local: a row of tokens is the encoding of its bytes if each two
neighbours are that of theirs. So the last token before any place decides what may follow, and a state is: for each suffix of what was read that
begins a token, its place in the tree of tokens, the last token before it, and how many tokens more or less lie up to there. A
transition carries the change of the number of tokens, and a state what the end of the word adds to it. States are made where a text first
leads to them and are kept in a bounded table, as is the count of each short piece; which neighbours go together is asked of the file's own merges.

A null text is empty and has no tokens. Control strings in a text are one token each, as the library takes them. Long texts are worked
through in steps of STEP characters, cut at white space, where every state leads to the first one; only a text without white space is one step. Rows of one doc_id or
of none are counted each, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lexiline.llm.common import slices, table
from lexiline.llm.tokens import byte_alphabet, word_path

#: characters of a chunk, and of a step
LANE, STEP = 256, 2 << 20
#: states, checked neighbours and counted pieces that are kept at once; longer pieces aren't kept
MOST_STATES, MOST_PAIRS, MOST_PIECES, PIECE = 400_000, 2_000_000, 500_000, 48
#: what follows the literals in patterns of this kind
RUNS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: letters and signs that composing leaves alone and that have one lower-case form each, whatever stands beside them
PLAIN = re.compile("[\0-ɏΑ-ΡΣ-Ωα-ωА-я‐-‧‰-※€一-鿿]*")
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
FRESH, IN_LETTERS, IN_OTHERS = 0, 1, 2
BEGINS, LATE = 1, 2


class Splitter:
    """The pattern of a tokenizer file as a transducer. Output of a transition: a piece BEGINS at this character, or LATE, at the one before."""

    def __init__(self, tokenizer, pattern: str):
        literals = pattern[: -len(RUNS)].strip("|").split("|") if pattern.endswith(RUNS) else []
        if not pattern.endswith(RUNS) or any(not re.fullmatch(r"'[a-z]{1,2}", x) for x in literals if x):
            raise ValueError(f"no transducer for this pattern: {pattern}")
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        marks = sorted({c for x in literals for c in x[1:]})
        self.apostrophe = OTHER + 1
        own = {c: OTHER + 2 + i for i, c in enumerate(marks)}
        n_classes = OTHER + 2 + len(marks)
        after = sorted({x[1] for x in literals if len(x) == 3})
        opened, waiting = IN_OTHERS + 1, {c: IN_OTHERS + 2 + i for i, c in enumerate(after)}  # after the sign, and after it and a letter
        self.n_states = IN_OTHERS + 2 + len(after)
        self.next, self.out = np.zeros((self.n_states, n_classes), np.uint8), np.full((self.n_states, n_classes), BEGINS, np.uint8)
        letters = [LETTER, *own.values()]
        for state in range(self.n_states):
            self.next[state, letters], self.next[state, OTHER], self.next[state, self.apostrophe] = IN_LETTERS, IN_OTHERS, opened
        self.out[IN_LETTERS, letters] = 0
        for state in (IN_OTHERS, opened):
            self.next[state, [OTHER, self.apostrophe]], self.out[state, [OTHER, self.apostrophe]] = IN_OTHERS, 0
        for c, state in waiting.items():
            self.next[opened, own[c]], self.out[opened, own[c]] = state, 0
            self.out[state] |= LATE
            self.out[state, letters] = LATE
        for x in literals:
            state = opened if len(x) == 2 else waiting[x[1]]
            self.next[state, own[x[-1]]], self.out[state, own[x[-1]]] = FRESH, 0
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        for c, k in own.items():
            self.classes[ord(c)] = k
        self.classes[ord("'")] = self.apostrophe

    def normal(self, text: str) -> str:
        if PLAIN.fullmatch(text):
            return text.replace("Σ", "σ").lower()
        return self.normalizer.normalize_str(text)

    def class_of(self, c: str) -> int:
        if self.normalizer.normalize_str(c) == " ":
            return SPACE
        pieces = lambda s: len(self.pre_tokenizer.pre_tokenize_str(s))
        return LETTER if pieces("a" + c) == 1 else NUMBER if pieces(c + c) == 2 else OTHER

    def classed(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if (found == UNKNOWN).any():
            for code in np.unique(codes[found == UNKNOWN]).tolist():
                self.classes[code] = self.class_of(chr(code))
            found = self.classes[codes]
        return found

    def maps(self, lanes: np.ndarray) -> np.ndarray:
        """For each chunk (a row of classes) the state at its end for each state at its start."""
        state, n = np.tile(np.arange(self.n_states, dtype=np.uint8), (len(lanes), 1)), self.next.shape[1]
        step = self.next.reshape(-1)
        for k in range(lanes.shape[1]):
            state = step[state * np.uint8(n) + lanes[:, k, None]]
        return state

    @staticmethod
    def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Maps that do `first`, then `then`; associative."""
        return np.take_along_axis(then, first, axis=1)

    def scan(self, maps: np.ndarray) -> np.ndarray:
        """The map from the start of all to the end of each chunk, by doubling."""
        found, reach = maps, 1
        while reach < len(maps):
            found = np.concatenate([found[:reach], self.compose(found[:-reach], found[reach:])])
            reach *= 2
        return found

    def begins(self, classes: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character; the last one has to be a space."""
        n = -(-len(classes) // LANE)
        lanes = np.full(n * LANE, SPACE, np.uint8)
        lanes[: len(classes)] = classes
        lanes = np.ascontiguousarray(lanes.reshape(n, LANE))
        state = np.concatenate([np.array([FRESH], np.uint8), self.scan(self.maps(lanes))[:-1, FRESH]])
        out, width = np.empty((LANE, n), np.uint8), np.uint8(self.next.shape[1])
        step, shown = self.next.reshape(-1), self.out.reshape(-1)
        for k in range(LANE):
            at = state * width + lanes[:, k]
            out[k], state = shown[at], step[at]
        flat = out.T.reshape(-1)
        begins = flat & BEGINS > 0
        begins[:-1] |= flat[1:] & LATE > 0
        return begins[: len(classes)]


class Words:
    """Byte-pair encoding with word ends as a transducer over bytes; count(piece) is the number of its tokens."""

    def __init__(self, model: dict, file_model):
        from tokenizers import models

        suffix = model.get("end_of_word_suffix") or ""
        if not suffix or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("no transducer for this kind of model")
        self.inner = models.BPE(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]).tokenize
        self.last = file_model.tokenize
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.child: list[dict[int, int]] = [{}]
        self.token, self.end = [-1], [-1]  # at each node of the tree: the token that it is, and the one that it is at a word's end
        self.body: dict[int, str] = {}
        for content, i in model["vocab"].items():
            body = content.removesuffix(suffix) if content != suffix else content
            if not all(c in byte_of for c in body):
                continue  # control strings
            node = 0
            for c in body:
                node = self.child[node].setdefault(byte_of[c], len(self.child))
                if node == len(self.child):
                    self.child.append({}), self.token.append(-1), self.end.append(-1)
            (self.end if body != content else self.token)[node] = i
            self.body[i] = body
        if any(self.token[self.child[0][b]] < 0 or self.end[self.child[0][b]] < 0 for b in range(256) if b in self.child[0]) or len(self.child[0]) < 256:
            raise ValueError("every byte must be a token, inside and at the end of words")
        self.pieces: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets all states."""
        self.pairs: dict[tuple[int, int], bool] = {}
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.ends: list[int] = []
        self.steps: dict[int, tuple[int, int]] = {}
        self.start = self._state(((0, -1, 0),), 0)

    def _state(self, chain: tuple, end: int) -> int:
        key = (chain, end)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(chain)
            self.ends.append(end)
        return found

    def _follows(self, before: int, token: int, last: bool) -> bool:
        """Whether the two tokens (or, at a word's start, the one) are the encoding of their bytes."""
        key = (before, token << 1 | last)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            made = (self.last if last else self.inner)((self.body[before] if before >= 0 else "") + self.body[token])
            found = self.pairs[key] = [t.id for t in made] == ([before, token] if before >= 0 else [token])
        return found

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: the next state and the change of the number of tokens."""
        moved, now, end, token = [], None, None, -1
        for node, before, count in self.states[state]:  # the longest suffix comes first
            node = self.child[node].get(byte)
            if node is None:
                continue
            if now is None and self.token[node] >= 0 and self._follows(before, self.token[node], False):
                now, token = count + 1, self.token[node]
            if end is None and self.end[node] >= 0 and self._follows(before, self.end[node], True):
                end = count + 1
            if self.child[node]:
                moved.append((node, before, count))
        found = self.steps[state << 8 | byte] = (self._state((*[(node, before, count - now) for node, before, count in moved], (0, token, 0)), end - now), now)
        return found

    def run(self, piece: bytes) -> int:
        """The number of tokens of a piece."""
        state, count, steps = self.start, 0, self.steps
        for byte in piece:
            found = steps.get(state << 8 | byte)
            if found is None:
                found = self._step(state, byte)
            state = found[0]
            count += found[1]
        count += self.ends[state]
        if len(self.states) > MOST_STATES:
            self.clear()
        return count

    def counts(self, pieces: list[str]) -> np.ndarray:
        if len(self.pieces) > MOST_PIECES:
            self.pieces = {}
        known, run = self.pieces, self.run
        found = list(map(known.get, pieces))
        for i, n in enumerate(found):
            if n is None:
                piece = pieces[i]
                n = known.get(piece)
                if n is None:
                    n = run(piece.encode())
                    if len(piece) <= PIECE:
                        known[piece] = n
                found[i] = n
        return np.array(found, np.int64)


class Counter:
    """Both transducers of a file."""

    _made: dict[str, Counter] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        said = json.loads(tokenizer.to_str())
        first, *others = (said["pre_tokenizer"] or {}).get("pretokenizers") or [{"type": None}]
        if not (first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and [x["type"] for x in others] == ["ByteLevel"]):
            raise ValueError("no transducer for this kind of file")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
            raise ValueError("control strings of this kind aren't known here")
        self.control = re.compile("|".join(re.escape(t["content"]) for t in sorted(said["added_tokens"], key=lambda t: -len(t["content"]))) or "(?!)")
        self.splitter, self.words = Splitter(tokenizer, first["pattern"]["Regex"]), Words(said["model"], tokenizer.model)

    @classmethod
    def of(cls, path: str) -> Counter:
        """The transducers of a file, compiled once in a process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of some STEP characters, cut after white space."""
        a = 0
        while len(text) - a > STEP:
            cut = max(text.rfind(" ", a, a + STEP), text.rfind("\n", a, a + STEP)) + 1
            if not cut:
                found = re.compile("[ \n]").search(text, a + STEP)
                cut = found.end() if found else len(text)
            yield text[a:cut]
            a = cut
        yield text[a:]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        total, waiting, own, size = np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            pieces = [text]
            if "<" in text and self.control.search(text):
                total[i] += len(self.control.findall(text))
                pieces = self.control.split(text)
            for piece in pieces:
                for part in self.parts(piece):
                    if size + len(part) > STEP and waiting:
                        np.add.at(total, own, self._counted(waiting))
                        waiting, own, size = [], [], 0
                    waiting.append(self.splitter.normal(part)), own.append(i)
                    size += len(part)
        if waiting:
            np.add.at(total, own, self._counted(waiting))
        return total

    def _counted(self, parts: list[str]) -> np.ndarray:
        joined = " ".join(parts) + " "
        classes = self.splitter.classed(np.frombuffer(joined.encode("utf-32-le"), "<u4"))
        begins = np.flatnonzero(self.splitter.begins(classes))
        ends = np.append(begins[1:], len(joined))
        full = classes[begins] != SPACE
        begins, ends = begins[full], ends[full]
        found = self.words.counts([joined[a:b] for a, b in zip(begins.tolist(), ends.tolist())])
        upto = np.concatenate([[0], np.cumsum(found)])
        edge = np.cumsum([0, *[len(p) + 1 for p in parts]])
        at = np.searchsorted(begins, edge)
        return upto[at[1:]] - upto[at[:-1]]


COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document, by the tokenizer file at a path that all machines have."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for batch in slices(batches):
            text = pc.fill_null(batch.column("text").cast(pa.string()), "")
            n = counter.counts(text.to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": pc.binary_length(text).cast(pa.int64()), "n_tokens": n, "over_limit": n > limit})

    return docs.select("doc_id", "text").mapInArrow(task, COUNTED)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), word_path())
