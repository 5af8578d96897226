"""Texts cut at sentence ends into overlapping chunks, in time linear in their length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the source data's language counts it, and what ends a sentence.
BLANKS = "\t\n\x0b\f\r  " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
ENDS = ".!?다요함됨"


def cutter(limit: int, overlap: int):
    """A function from a text to its chunks; it carries all it needs, so workers need no package of ours."""
    blanks, ends = BLANKS, ENDS

    def cut(text: str) -> list[str]:
        import re
        from bisect import bisect_right

        if len(text) <= limit:
            return [text]
        sentences = [s for s in re.split(f"(?<=[{ends}])[{blanks}]+", text) if s]
        # reach[k]: characters of the first k sentences, each with the space before it.
        reach = [0]
        for s in sentences:
            reach.append(reach[-1] + len(s) + 1)
        out, i, tail = [], 0, None
        while i < len(sentences):
            # The next cut is the first sentence past the limit; a chunk has one sentence at least.
            room = limit + reach[i] + 1 if tail is None else limit - len(tail) + reach[i]
            j = max(i + 1, bisect_right(reach, room) - 1)
            now = " ".join(sentences[i:j]) if tail is None else tail + " " + " ".join(sentences[i:j])
            out.append(now.strip(blanks))
            i, tail = j, now[max(0, len(now) - overlap) :]
        return out if out[-1:] != [""] else out[:-1]

    return cut


def chunks(text: Column, limit: int = 2200, overlap: int = 180) -> Column:
    """Sentences packed to ``limit`` characters; each further chunk starts with the last ``overlap`` characters of the one before.

    A sentence over the limit stays whole. The places of all cuts follow from
    running lengths by bisection, so no text is copied more than once. A null
    text has null chunks, an empty one itself.
    """
    cut = cutter(limit, overlap)

    def run(texts):
        import pyarrow as pa

        return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)
