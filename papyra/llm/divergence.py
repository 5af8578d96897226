"""How far the sources of one language differ in their terms, in exact whole numbers.

Words are counted within tasks, then per (language, source, term). A pair of
sources isn't compared term by term: tasks tally how often each combination
(count here, count there) occurs among the kept terms that both hold; the cells
with a zero are implied by the sources' own counts and the number of kept
terms. The difference of two shares is then worked out once per combination
and multiplied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm.common import ship
from papyra.scratch import settle

#: Bytes of terms: A-Z, a-z and all that is not ASCII.
LETTERS = B._table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Shares are whole parts of SCALE; SMOOTH is added to every count first.
SCALE, SMOOTH = 1_000_000_000, 5
#: Pairs of cells expanded at a time; bounds a task's working memory.
STEP = 1 << 20


def _tally_terms(group: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a run of texts, for each group and term in it: the group, a byte range that holds the term, occurrences and texts."""
    w = B.Words(data, offsets, LETTERS)
    text = w.text_of()
    key = B.mix(B.range_hashes(data, w.start, w.end) ^ B.mix(group[text].astype(np.uint64) + B.U(1)))
    order = np.argsort(key, kind="stable")  # words of one term stay in the order of texts
    key, text, start, end = key[order], text[order], w.start[order], w.end[order]
    # Terms are told apart by hash, group, length and their first and last eight bytes.
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    parts = key, group[text], end - start, eights[start] & B._FIRST[np.minimum(end - start, 8)], eights[np.maximum(end - 8, start)] & B._FIRST[np.minimum(end - start, 8)]
    new = np.ones(len(key), bool)
    new[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in parts])
    in_text = new.copy()
    in_text[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(key)))
    texts = np.add.reduceat(in_text.astype(np.int64), first) if len(first) else n
    return group[text[first]], start[first], end[first], n.astype(np.int64), texts


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(start - ends[:-1], size) + np.arange(int(ends[-1]))]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and texts of each term; one row with a null term for each group, so that none is lost.

    Null texts, languages and sources count as ''; A-Z count as a-z and nothing
    else is folded. Each row is a document, also one that equals another. No
    other column is read; an empty table gives no rows. Whole texts are read,
    four megabytes or one text at a time.
    """
    ship(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            known: dict = {}
            group = np.array([known.setdefault(k, len(known)) for k in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], np.int64)
            lang, source = (pa.array([k[i] for k in known], pa.string()) for i in (0, 1))
            zero = pa.array(np.zeros(len(known), np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(known), pa.string()), zero, zero], names=names)
            for i, j, piece, off in B.pieces(data, offsets, 4 * B.BLOCK):
                lower = B.LOWER[piece]
                of, start, end, n, texts = _tally_terms(group[i:j], lower, off)
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(of)), source.take(pa.array(of)), _strings(lower, start, end), pa.array(n), pa.array(texts)], names=names)

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    out = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = 30) -> DataFrame:
    """(lang, term, n, cells): the terms that at least ``least`` documents of a language hold, with their count in each source that has them (one cell a source)."""
    per = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return per.filter(F.col("docs") >= least).drop("docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), in decimals that hold every product; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", wide(F.lit(SCALE)) * wide(count + SMOOTH), F.nullif(wide(total + SMOOTH * terms), wide(F.lit(0))))


def _tally_pairs(size: np.ndarray, lang: np.ndarray, place: np.ndarray, n: np.ndarray):
    """Of terms with ``size`` cells each, in order of places: (lang, a, b, x, y, times) of each pair of places and counts, a step at a time."""
    later = np.repeat(np.cumsum(size), size) - np.arange(len(n)) - 1  # cells of the same term after each cell
    total = np.concatenate([[0], np.cumsum(later)])
    lang = np.repeat(lang, size)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, total[i] + STEP, "right")) - 1)
        left = np.repeat(np.arange(i, j), later[i:j])
        right = left + 1 + np.arange(len(left)) - (total[left] - total[i])
        i = j
        if not len(left):
            continue
        # Each of the three has at most STEP values, so their product fits 64 bits.
        width = int(place.max()) + 1
        pair, pair_at = np.unique((lang[left] * width + place[left]) * width + place[right], return_inverse=True)
        x, x_at = np.unique(n[left], return_inverse=True)
        y, y_at = np.unique(n[right], return_inverse=True)
        key, times = np.unique((pair_at * len(x) + x_at) * len(y) + y_at, return_counts=True)
        both = pair[key // (len(x) * len(y))]
        yield both // width // width, both // width % width, both % width, x[key // len(y) % len(x)], y[key % len(y)], times


def joint_counts(kept: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, times): in how many kept terms that both hold the sources a < b have the counts x and y."""
    ship(kept.sparkSession)
    names = ["lang", "a", "b", "x", "y", "times"]

    def coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The values in order of their UTF-8 bytes, and each row's place among them."""
        values = pc.unique(column)
        values = values.take(pa.array(sorted(range(len(values)), key=lambda k: values[k].as_py().encode())))
        return values, pc.index_in(column, values).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches):
        for b in batches:
            cells = b.column("cells")
            size, flat = np.diff(cells.offsets.to_numpy()), cells.flatten()
            langs, lang = coded(b.column("lang"))
            sources, place = coded(flat.field("source"))
            n = flat.field("n").to_numpy(zero_copy_only=False)
            order = np.lexsort((place, np.repeat(np.arange(len(size)), size)))
            for at, p, q, x, y, times in _tally_pairs(size, lang, place[order], n[order]):
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(at)), sources.take(pa.array(p)), sources.take(pa.array(q)), pa.array(x), pa.array(y), pa.array(times.astype(np.int64))], names=names)

    out = kept.select("lang", "cells").mapInArrow(run, "lang string, a string, b string, x long, y long, times long")
    return out.groupBy("lang", "a", "b", "x", "y").agg(F.sum("times").alias("times"))


def _all_cells(joint: DataFrame, ends: DataFrame, own: DataFrame) -> DataFrame:
    """The joint counts of every pair with the implied cells that have a zero: a source's own counts less what both hold, and the rest of the kept terms."""
    cell = lambda x, y, t: F.struct(F.lit(x).cast("long").alias("x") if x == 0 else F.col(x).alias("x"), F.lit(y).cast("long").alias("y") if y == 0 else F.col(y).alias("y"), t.alias("times"))
    t = F.col("times")
    keys = ["lang", "a", "b"]
    both = joint.select(*keys, F.explode(F.array(cell("x", "y", t), cell("x", 0, -t), cell(0, "y", -t), cell(0, 0, t))).alias("c"))
    pairs = ends.select(*keys)
    one = pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select(*keys, F.explode(F.array(cell("n", 0, t), cell(0, 0, -t))).alias("c"))
    two = pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select(*keys, F.explode(F.array(cell(0, "n", t), cell(0, 0, -t))).alias("c"))
    rest = ends.select(*keys, cell(0, 0, F.col("terms")).alias("c"))
    every = both.unionByName(one).unionByName(two).unionByName(rest)
    return every.groupBy(*keys, "c.x", "c.y").agg(F.sum("c.times").alias("times"))


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and its ``top`` terms above the language's share.

    Part 'pair' has every other source, part 'term' kept terms. Ranks run from
    1 by falling value, then by the item's bytes. A language without kept
    terms gives pairs of value 0; one with a single source gives none.
    """
    counts = settle(term_counts(docs), "term-counts")
    kept = settle(kept_terms(counts, least), "kept-terms")
    cells = kept.select("lang", "term", F.col("n").alias("n_lang"), F.explode("cells").alias("c")).select("lang", "term", "n_lang", "c.source", "c.n")
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0)
    groups = settle(groups, "source-groups")

    other = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    ends = groups.withColumnRenamed("source", "a").join(other, "lang").filter("a < b")
    own = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    every = _all_cells(joint_counts(kept), ends, own).join(ends, ["lang", "a", "b"])
    apart = F.abs(share(F.col("x"), F.col("total"), F.col("terms")) - share(F.col("y"), F.col("total_b"), F.col("terms")))
    far = every.groupBy("lang", "a", "b").agg(F.sum(F.col("times") * F.coalesce(apart, F.lit(0))).cast("long").alias("value"))
    pairs = far.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "value")
    pairs = pairs.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")

    above = cells.join(groups, ["lang", "source"])
    above = above.withColumn("value", (share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))).cast("long"))
    above = above.filter("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
