"""Chat formatting by a finite-state machine over roles.

A template, plain data, gives each role its markers and says which role may follow which.
The machine reads a conversation's turns in order, checks each step, and emits text segments
with a loss flag. Control strings of the template that stand in a text are escaped by a
letter put after their first character, and can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import table

START = "start"


class Template(NamedTuple):
    markers: dict[str, tuple[str, str]]  # role: what opens and what closes its turn
    other: tuple[str, str, str]  # any other role: opening, between role and text, closing
    follows: dict[str, tuple[str, ...]]  # role, or START: roles allowed next
    learned: tuple[str, ...]  # roles whose text is under the loss mask
    escape: str = "~"

    def controls(self) -> list[str]:
        found = {m for pair in self.markers.values() for m in pair} | set(self.other)
        return sorted(found, key=len, reverse=True)


TEMPLATE = Template(
    markers={
        "system": ("[SYS]", "[/SYS]"),
        "user": ("[INST]", "[/INST]"),
        "assistant": ("[ANS]", "</s>"),
    },
    other=("[ROLE]", "[TEXT]", "[/ROLE]"),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    learned=("assistant",),
)


class Codec:
    """Escapes and reads back the control strings of a template."""

    def __init__(self, template: Template):
        self.template, controls = template, template.controls()
        first, mark = {c[0] for c in controls}, template.escape
        # A control string starts nowhere inside another one, so marks never hide one.
        if any(len(c) < 2 or first & set(c[1:]) or mark in c for c in controls):
            raise ValueError("control strings need two characters or more, of which the first ones start all")
        m = re.escape(mark)
        whole = "|".join(f"{re.escape(c[0])}{{0}}(?={m}*{re.escape(c[1:])})" for c in controls)
        self._escape, self._unescape = re.compile(whole.format("")), re.compile(whole.format(m))
        self._control = re.compile("|".join(map(re.escape, controls)))

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0] + self.template.escape, text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: m[0][:-1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of one turn: (text, under the loss mask)."""
        if role in self.template.markers:
            opening, closing = self.template.markers[role]
        else:
            a, b, closing = self.template.other
            opening = a + self.escape(role) + b
        return [(opening, False), (self.escape(text), role in self.template.learned), (closing, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        parts, found, at = [], [], 0
        for m in self._control.finditer(formatted):
            parts.append(formatted[at : m.start()])
            found.append(m[0])
            at = m.end()
        if tuple(found) == self.template.other:
            return self.unescape(parts[1]), self.unescape(parts[2])
        role = next(r for r, pair in self.template.markers.items() if pair == tuple(found))
        return role, self.unescape(parts[1])


def format_turns(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, turn_no, state, valid, segments) per turn, in order within each partition.

    ``segments`` is an array of (text, loss). ``valid`` says whether the machine allows the
    turn after the one before; turns that it does not allow are formatted all the same, and
    the machine goes on from their role. Turns are ordered by turn, then role and text, so
    ties and repeated rows have a fixed order. Null roles and texts are empty; rows of a null
    conv_id form one conversation. Rows stream through in batches, so a conversation of any
    length takes bounded memory; other columns are ignored.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spread = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(spread, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(template)
        now, state, number = object(), START, 0
        for batch in batches:
            out = []
            for conv_id, role, text in zip(_plain(batch["conv_id"]), batch["role"], batch["text"]):
                if conv_id != now:
                    now, state, number = conv_id, START, 0
                valid = role in template.follows.get(state, ())
                pieces = [{"text": t, "loss": loss} for t, loss in codec.segments(role, text)]
                out.append((conv_id, number, role, valid, pieces))
                state, number = role, number + 1
            yield pd.DataFrame(out, columns=["conv_id", "turn_no", "state", "valid", "segments"])

    schema = f"conv_id {kind}, turn_no long, state string, valid boolean, segments array<struct<text: string, loss: boolean>>"
    return ordered.mapInPandas(run, schema)


def _plain(ids: pd.Series) -> list:
    return [None if pd.isna(x) else x for x in ids.tolist()]


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row of digests per conversation, taken from formatted turns as ``format_turns`` left them."""
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(template)
        now, sums = object(), None

        def close():
            return (now, sums[0], sums[1].hexdigest(), sums[2], sums[3].hexdigest(), sums[4], sums[5])

        for batch in batches:
            out = []
            for conv_id, valid, segments in zip(_plain(batch["conv_id"]), batch["valid"], batch["segments"]):
                if conv_id != now:
                    if sums:
                        out.append(close())
                    now, sums = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                whole = "".join(s["text"] for s in segments)
                role, text = codec.read(whole)
                learned = "".join(codec.unescape(s["text"]) for s in segments if s["loss"])
                sums[0] += 1
                sums[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                sums[2] += len(learned)
                sums[3].update(learned.encode("utf-8", "surrogatepass"))
                sums[4] += len(whole)
                sums[5] &= bool(valid)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if sums:
            yield pd.DataFrame([close()], columns=columns)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    columns = [part.split()[0] for part in schema.split(", ")]
    return formatted.mapInPandas(run, schema)


def op5(spark, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(turns.dtypes)
    own = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(format_turns(turns.unionByName(own)))
