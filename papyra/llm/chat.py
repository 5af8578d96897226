"""Chat formatting: a finite-state machine over roles writes text segments with loss flags, from a declarative template."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import ship

FORMATTED = "conv_id long, position long, role string, in_order boolean, segments array<struct<text: string, loss: boolean>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_out_of_order long, complete boolean"


@dataclass(frozen=True)
class Template:
    """How turns are marked and which may follow which.

    ``follow[state][role]`` is the state after a turn; the start state is "".
    A role with no entry is out of order: the turn is still written, is marked,
    and the machine goes on as after that role.
    """

    follow: dict = field(
        default_factory=lambda: {
            "": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant", "tool": "tool"},
        }
    )
    final: tuple = ("assistant",)
    loss: tuple = ("assistant",)
    head: str = "### "
    colon: str = ": "
    close: str = "</turn>"
    after: str = "\n"

    def step(self, state: str, role: str) -> tuple[str, bool]:
        to = self.follow.get(state, {}).get(role)
        return (role, False) if to is None else (to, True)

    @property
    def controls(self) -> list[str]:
        return [self.head.strip(), self.close]

    def escape(self, text: str, extra: str = "") -> str:
        """Put a backslash before each backslash and control string; ``unescape`` undoes it exactly."""
        return re.sub("|".join(map(re.escape, ["\\", *self.controls, *extra])), lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\|:|" + "|".join(map(re.escape, self.controls)) + ")", lambda m: m[1], text)

    def segments(self, role: str, text: str) -> list[dict]:
        head = self.head + self.escape(role, ":") + self.colon
        return [{"text": head, "loss": False}, {"text": self.escape(text), "loss": role in self.loss}, {"text": self.close + self.after, "loss": False}]

    def parse(self, formatted: str) -> tuple[str, str]:
        """Role and text of a written turn."""
        m = re.fullmatch(re.escape(self.head) + r"((?:[^\\:]|\\.)*)" + re.escape(self.colon) + "(.*)" + re.escape(self.close + self.after), formatted, re.S)
        if not m:
            raise ValueError(f"not a turn: {formatted[:80]!r}")
        return self.unescape(m[1]), self.unescape(m[2])


def _streamed(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def render(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per turn: its place, whether it is in order, and its segments.

    Turns are read in the order of (turn, role, text), nulls first; a null
    text or role is empty. Conversations pass as sorted streams, so a long one
    is never held in memory. A null conv_id is a conversation of its own.
    """
    ship(conversations.sparkSession)
    t = template or Template()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches):
        conv, state, place = object(), "", 0
        for b in batches:
            ids, roles, places, fine, parts = b.column("conv_id").to_pylist(), b.column("role").to_pylist(), [], [], []
            for c, role, text in zip(ids, roles, b.column("text").to_pylist(), strict=True):
                if c != conv:
                    conv, state, place = c, "", 0
                state, ok = t.step(state, role)
                places.append(place)
                fine.append(ok)
                parts.append(t.segments(role, text))
                place += 1
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(places, pa.int64()), b.column("role"), pa.array(fine, pa.bool_()), pa.array(parts, kind)], names=["conv_id", "position", "role", "in_order", "segments"])

    return _streamed(rows, ["turn", "role", "text"]).mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, parsed back from the written segments: digests of its turns and of all text under the loss mask.

    The digests are of the conversation as one string, so its turns pass one
    after the other through one task, as a stream.
    """
    ship(formatted.sparkSession)
    t = template or Template()
    names, kinds = [c.split()[0] for c in DIGEST.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches):
        conv, done, s = object(), [], None

        def row():
            return (conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["odd"], s["role"] in t.final)

        for b in batches:
            for c, fine, parts in zip(b.column("conv_id").to_pylist(), b.column("in_order").to_pylist(), b.column("segments").to_pylist(), strict=True):
                if s is None or c != conv:
                    if s is not None:
                        done.append(row())
                    conv, s = c, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "odd": 0, "role": ""}
                written = "".join(p["text"] for p in parts)
                role, text = t.parse(written)
                under = t.unescape("".join(p["text"] for p in parts if p["loss"]))
                s["n"] += 1
                s["turns"].update(f"{role}\n{text}\n".encode())
                s["loss_chars"] += len(under)
                s["loss"].update(under.encode())
                s["chars"] += len(written)
                s["odd"] += not fine
                s["role"] = role
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        if s is not None:
            done.append(row())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return _streamed(formatted, ["position"]).mapInArrow(run, DIGEST)
