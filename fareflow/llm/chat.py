"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>[INST]role\\ntext[/INST]</s>``. The rendered turn is read by a deterministic parser; if what it
recovers isn't the source, the conflicting content is escaped and the turn is rendered again, until both are identical.
Turns end in a control string that no accepted text holds, so a conversation is the turns one after another, and the
loss mask is the span of each assistant text.

Defined results: a null text is empty; a null role reads back as null and counts as an empty role in a digest; turns are in
the order of ``turn`` (null first), then role and text; repeated rows are repeated turns; a null conversation is one of its
own; an empty table has no conversations (but the query's own).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import table

HEAD, STOP = "<s>[INST]", "[/INST]</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
NO_ROLE = "\\0"
_CONFLICT = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(HEAD) + r"(?P<role>(?:\\.|[^\\\n])*)\n(?P<text>(?:\\.|[^\\])*?)" + re.escape(STOP), re.S)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile(r"\\(.)", re.S)


def escaped(text: str) -> str:
    """A backslash before each backslash and after the first character of each control string."""
    return _CONFLICT.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """A turn as a string, and where its text begins and ends in it."""
    head = HEAD + (NO_ROLE if role is None else escaped(role).replace("\n", "\\\n")) + "\n"
    return head + text + STOP, len(head), len(head) + len(text)


def parse(rendered: str) -> list[tuple[str | None, str, int, int]]:
    """Turns of a rendered string: role, text and the span of the text; an error if anything is left over."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if _CONTROL.search(m["text"]) or _CONTROL.search(m["role"]):
            raise ValueError(f"a control string inside the turn at {at}")
        role = None if m["role"] == NO_ROLE else unescaped(m["role"])
        turns.append((role, unescaped(m["text"]), m.start("text"), m.end("text")))
        at = m.end()
    return turns


def formatted_turn(role: str | None, text: str) -> tuple[str, int, int]:
    """Rendered as it is if that reads back identical, else with its conflicts escaped."""
    for content in (text, escaped(text)):
        out, start, end = render(role, content)
        try:
            if parse(out) == [(role, text, start, end)]:
                return out, start, end
        except ValueError:
            continue
    raise ValueError("a turn does not read back")


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, rendered, loss_start, loss_end (the span of an assistant's text, else null).

    The rendered conversation is its rows in order of turn, role and text, one after another.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [formatted_turn(None if pd.isna(r) else r, "" if pd.isna(t) else t)
                    for r, t in zip(b["role"], b["text"], strict=True)]
            speaks = b["role"] == "assistant"
            yield pd.DataFrame({
                "conv_id": b["conv_id"].astype("Int64"), "turn": b["turn"].astype("Int64"), "role": b["role"], "text": b["text"],
                "rendered": [m[0] for m in made],
                "loss_start": pd.array([m[1] if s else None for m, s in zip(made, speaks, strict=True)], "Int64"),
                "loss_end": pd.array([m[2] if s else None for m, s in zip(made, speaks, strict=True)], "Int64")})

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInPandas(
        rows, "conv_id bigint, turn bigint, role string, text string, rendered string, loss_start bigint, loss_end bigint")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what its rendered turns read back as. ``turns``: of ``formatted``.

    A digest of ordered turns is sequential, so a conversation is read by one task; it holds one turn and two hash states,
    whatever the length of the conversation. Conversations are spread by their id.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def closed() -> None:
            if state is not None:
                done.append((current[0], state["n"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            labels = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            columns = list(zip(*done, strict=True)) or [[]] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=labels)
            done.clear()
            return batch

        for b in batches:
            for conv, rendered, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
                if current != (conv,):
                    closed()
                    current = (conv,)
                    state = {"n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
                for role, text, _, _ in parse(rendered):
                    state["all"].update(f"{role or ''}\n{text}\n".encode())
                    state["n"] += 1
                if lo is not None:
                    said = unescaped(rendered[lo:hi])
                    state["loss"].update(said.encode())
                    state["chars"] += len(said)
                state["size"] += len(rendered)
            if len(done) > 5000:
                yield flush()
        closed()
        yield flush()

    ordered = (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
               .select("conv_id", "rendered", "loss_start", "loss_end"))
    return ordered.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                    "loss_sha256 string, formatted_chars bigint")


PROBE = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings, read back from the formatted output."""
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(formatted(given.unionByName(probe)))
