"""Chat formatting: conversations rendered by a compiled template, with the parts that a model is to learn.

The output has a row for each turn: its place in the conversation, its fragment of the formatted
conversation (the fragments in order are the whole of it) and the spans of the fragment under the loss mask, in code
points. Conversations of any length stream through a task: rows are dealt by conversation and sorted, and
nothing is held but the current turn.

A null role or text is empty, a null conv_id is a conversation of its own, a null turn comes first; rows of the
same turn follow in the order of role and text, and repeated rows are turns each. An empty table
gives no rows (op3_chat_format: conversation -7 alone). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline.llm.common import partitions, table
from lexiline.llm.template import DEFAULT, TURN, compile_template, unescape

FRAGMENTS = "conv_id long, ord long, fragment string, learned array<struct<start:long,length:long>>"


def format_conversations(conversations: DataFrame, template: str = DEFAULT) -> DataFrame:
    """A row for each turn: conv_id, ord (from 0), fragment, learned; in order within a conversation and a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, current, index, held = compile_template(template), object(), 0, None
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])

            def put(row: tuple) -> None:
                conv, place, parts = row
                spans, at = [], 0
                for text, learned in parts:
                    if learned:
                        spans.append({"start": at, "length": len(text)})
                    at += len(text)
                out[0].append(conv), out[1].append(place), out[2].append("".join(t for t, _ in parts)), out[3].append(spans)

            for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if conv != current:
                    if held:
                        put((held[0], held[1], held[2] + program.after()))
                        held = None
                    index, opening, current = 0, program.before(), conv
                else:
                    index, opening = index + 1, []
                if held:
                    put(held)
                held = (conv, index, opening + program.each(role or "", text or "", index))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], LEARNED)], ["conv_id", "ord", "fragment", "learned"])
        if held:
            conv, place, parts = held[0], held[1], held[2] + program.after()
            spans, at = [], 0
            for text, learned in parts:
                if learned:
                    spans.append({"start": at, "length": len(text)})
                at += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([place], pa.int64()), pa.array(["".join(t for t, _ in parts)], pa.string()), pa.array([spans], LEARNED)], ["conv_id", "ord", "fragment", "learned"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(task, FRAGMENTS)


LEARNED = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(fragments: DataFrame) -> DataFrame:
    """What the formatted text says when it is read back: turns, learned text and lengths of each conversation."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def done() -> pa.RecordBatch:
            conv, n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            for conv, fragment, learned in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "fragment", "learned"))):
                if state is None or conv != current:
                    if state is not None:
                        yield done()
                    current, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                for m in TURN.finditer(fragment):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv}: no turn at {at}")
                    role, text = unescape(fragment[m.start() + 4 : m.start(2) - 2]), unescape(m[2])
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    at = m.end()
                if at != len(fragment):
                    raise ValueError(f"conversation {conv}: no turn at {at}")
                for span in learned:
                    text = unescape(fragment[span["start"] : span["start"] + span["length"]])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(fragment)
        if state is not None:
            yield done()

    ordered = fragments.repartition(partitions(fragments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "ord")
    return ordered.mapInArrow(task, DIGEST)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(more)))
