"""Exact substring deduplication: bytes that a repeated string of ``length`` bytes covers.

Ranks of substrings are refined over growing lengths, each rerank an
aggregation over what the last left in doubt, until unique or at the
threshold. Plain prefix doubling would sort every position at every offset,
over a hundred bytes moved per byte of text, so positions are grouped first:

1. All windows whose smallest hash of ``gram`` bytes is the same and that
   follow each other form a run. Equal windows have equal smallest grams, so a
   run whose gram is nowhere else, and once in it, holds no repeated window
   and is dropped.
2. A run whose whole stretch of bytes occurs twice is repeated throughout.
3. Windows of runs that share their gram with different stretches are ranked
   in cells of neighbours at equal distance from it: what all of a cell share
   must occur twice, and if what they span does, all are repeated.
4. Windows of cells still in doubt are ranked one by one at the full length.

Ranks are 64-bit hashes of the bytes at each length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm.common import bitmap_of, in_bitmap, ship, text_rows
from papyra.scratch import release, settle

RUNS = "t long, g long, bh long, nw int, lo long, at int, again boolean"
#: Windows that are ranked together first.
CELL = 16
#: Bytes worked on at a time; bounds the working memory of a task.
PART = B.BLOCK // 4
_BIG = 2**63 - 1


def text_key(raw) -> int:
    """A 64-bit name of a text's bytes."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _extreme(h: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """The minimum (or maximum) of each ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        h = of(h[:-size], h[size:])
        size *= 2
    return of(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def _places(h: np.ndarray, low: np.ndarray, start: np.ndarray, g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run one place of its smallest gram, and whether it has others; ``low`` is 0 at windows that cross texts."""
    pad = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero((_extreme(np.concatenate([pad, low, pad]), width, np.maximum) == h) & (h > 0))
    # A smallest gram's run is at or before that of the window starting there.
    run, value = np.searchsorted(start, places, "right") - 1, h[places]
    first, count = np.full(len(start), -1), np.zeros(len(start), np.int64)
    while len(run):
        good = g[run] == value
        np.add.at(count, run[good], 1)
        first[run[good]] = places[good]
        run, value, places = run[~good] - 1, value[~good], places[~good]
        keep = run >= 0
        run, value, places = run[keep], value[keep], places[keep]
    return first, count != 1


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, gram and stretch hash of each run, the gram's place in it, and whether it has others."""
    size = np.diff(offsets)
    if not len(size) or size.max() < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64), np.zeros(0, bool))
    run = B.Stretches(data)
    grams = run.every(gram)
    low = _extreme(grams, length - gram + 1)
    long = np.flatnonzero(size >= length)
    step = np.zeros(len(low) + 1, np.int8)
    np.add.at(step, offsets[long], 1)
    np.add.at(step, offsets[long + 1] - length + 1, -1)
    inside = np.cumsum(step[:-1]) > 0
    p = np.flatnonzero(inside)
    m = low[p]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (m[1:] != m[:-1])]))
    count = np.diff(np.concatenate([first, [len(p)]]))
    start = p[first]
    text = np.searchsorted(offsets, start, "right") - 1
    at, again = _places(grams, np.where(inside, low, B.U(0)), start, m[first], length - gram + 1)
    return text, start - offsets[text], count, m[first], run.of(start, start + count + length - 1), at - start, again


def _segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of short texts, or parts of a long one that overlap so that each window is in one: first text, place, bytes, offsets."""
    for i, j, piece, off in B.pieces(data, offsets, PART):
        if len(piece) <= 2 * PART or j - i > 1:
            yield i, 0, piece, off
            continue
        for at in range(0, len(piece) - length + 1, PART):
            part = piece[at : at + PART + length - 1]
            yield i, at, part, np.array([0, len(part)])


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of all texts, and one row (nw -1, g the id, bh the size) for each text."""

    def run(batches):
        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            ids = b.column("doc_id").fill_null(_BIG).to_numpy(zero_copy_only=False)
            keys = np.array([text_key(data[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            yield _batch(keys, ids, np.diff(offsets), np.full(len(keys), -1), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool))
            for i, at, piece, off in _segments(data, offsets, length):
                text, lo, count, g, bh, place, again = runs_of(piece, off, length, gram)
                yield _batch(keys[i + text], g.view(np.int64), bh.view(np.int64), count, lo + at, place, again)

    return docs.mapInArrow(run, RUNS)


def _batch(t, g, bh, nw, lo, at, again):
    return pa.RecordBatch.from_arrays([pa.array(t), pa.array(g), pa.array(bh), pa.array(nw.astype(np.int32)), pa.array(lo), pa.array(at.astype(np.int32)), pa.array(again)], names=[c.split()[0] for c in RUNS.split(", ")])


def _from_texts(docs: DataFrame, parts: DataFrame, make, schema: str, length: int) -> DataFrame:
    """``make(hashes, base, parts)`` for the parts (t, doc, lo, nw and what make needs) of each text, read from one text of its key t; hashes are of the text's bytes from ``base`` on."""
    parts = settle(parts, "substring-parts")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(parts.select(F.expr("t ^ doc").alias("k")), "k"))
    names = [c.split()[0] for c in schema.split(", ")]
    fields = [c for c in parts.columns if c not in ("t", "doc")]

    def pick(batches):
        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            ids = b.column("doc_id").fill_null(_BIG).to_numpy(zero_copy_only=False)
            keys = np.array([text_key(data[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            hit = pa.array(np.flatnonzero(in_bitmap(wanted.value, (keys ^ ids).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(keys).take(hit), b.column("text").take(hit)], names=["t", "text"])

    def batch(t, out):
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in out), pa.array(np.full(len(out[0]), t, np.int64))], names=names)

    def run(batches):
        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            at, values = _lists(b.column("parts"), fields)
            for k, t in enumerate(b.column("t").to_numpy().tolist()):
                own = {f: v[at[k] : at[k + 1]] for f, v in values.items()}
                size = int(offsets[k + 1] - offsets[k])
                if size <= 2 * PART:
                    yield batch(t, make(B.Stretches(data[offsets[k] : offsets[k + 1]]), 0, own))
                    continue
                for i in range(len(own["lo"])):  # of a long text only the parts' own bytes
                    one = {f: v[i : i + 1] for f, v in own.items()}
                    lo, end = int(one["lo"][0]), int(one["lo"][0] + one["nw"][0]) + length - 1
                    yield batch(t, make(B.Stretches(data[offsets[k] + lo : offsets[k] + end]), lo, one))

    grouped = parts.groupBy("t").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    out = settle(docs.mapInArrow(pick, "t long, text string").join(grouped, "t").select("t", "text", "parts").mapInArrow(run, schema), "substring-ranks")
    release(parts)
    return out


def _lists(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a column of lists of structs: where each row's begin, and each field's values; a null list is empty."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(lengths)]), {f: flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields}


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that stand for several: the row of each and its number in it."""
    k = np.repeat(np.arange(len(count)), count)
    return k, np.arange(len(k)) - (np.cumsum(count) - count)[k]


def _cells(docs: DataFrame, stretches: DataFrame, length: int) -> DataFrame:
    """Windows by their distance to their smallest gram, CELL to a row: ranks of the bytes that all of a cell's windows share and, if all CELL windows are in the run, of the bytes they span together (else 0)."""

    def make(run, base, r):
        begin = (r["at"] - r["nw"] + 1) // CELL
        k, i = _spread(r["at"] // CELL - begin + 1)
        c, lo, nw = begin[k] + i, r["lo"][k] - base, r["nw"][k]
        last = r["at"][k] - CELL * c
        first = last - CELL + 1
        low, high = np.maximum(first, 0), np.minimum(last, nw - 1)
        core = B.mix(run.of(lo + last, lo + first + length) + c.astype(np.uint64))
        whole = (low == first) & (high == last)
        span = np.where(whole, B.mix(run.of(lo + low, lo + np.minimum(last, nw - 1) + length) + c.astype(np.uint64)) | B.U(1), B.U(0))
        return core, span, r["cnt"][k], base + lo + low, high - low + 1

    return _from_texts(docs, stretches, make, "core long, span long, cnt long, lo long, nw long, t long", length)


def _windows(docs: DataFrame, parts: DataFrame, length: int) -> DataFrame:
    """The full-length rank of each window."""

    def make(run, base, r):
        k, i = _spread(r["nw"])
        p = r["lo"][k] + i
        return run.of(p - base, p - base + length), r["cnt"][k], p

    return _from_texts(docs, parts, make, "wh long, cnt long, p long, t long", length)


def _merged(ranges: DataFrame) -> DataFrame:
    """(t, cuts) from ranges (t, lo, hi) of bytes: those that overlap or touch as one, in order."""
    order = Window.partitionBy("t").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    span = ranges.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = span.groupBy("t", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return each.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("cuts"))


def _often(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose rows stand for two places or more."""
    return rows.groupBy(key).agg(F.sum("cnt").alias("places")).filter("places > 1").select(key)


def repeated(docs: DataFrame, length: int = 200, gram: int = 32) -> DataFrame:
    """(t, whole, cuts) per text with repeated windows: whole if the text itself repeats, else the ranges of bytes that such windows cover."""
    rows = settle(_runs(docs, length, gram), "substring-runs")
    texts = settle(rows.filter("nw < 0").groupBy("t").agg(F.count("*").alias("mult"), F.min("g").alias("doc"), F.max("bh").alias("size")), "substring-texts")
    found = rows.filter("nw > 0")
    shared = found.groupBy("g").agg(F.count("*").alias("total"), F.max("again").alias("again")).filter("total > 1 or again").select("g")
    runs = settle(found.join(shared, "g"), "substring-shared")
    release(rows)
    # One row for each stretch: how often it occurs, and one place.
    each = settle(runs.groupBy("g", "bh", "nw").agg(F.count("*").alias("cnt"), F.min(F.struct("t", "lo", "at")).alias("one"), F.max("again").alias("again")).select("g", "bh", "nw", "cnt", "one.t", "one.lo", "one.at", "again"), "substring-each")
    # In doubt: stretches of a gram of which some occur once, if it has others or stands more than once in one.
    open_ = each.groupBy("g").agg(F.count("*").alias("kinds"), F.min("cnt").alias("least"), F.max("again").alias("some")).filter("least = 1 and (kinds > 1 or some)").select("g", "some")
    doubt = settle(each.join(open_, "g").join(texts.select("t", "doc"), "t").select("t", "doc", "lo", F.col("nw").cast("long").alias("nw"), "at", "cnt", "some"), "substring-doubt")
    cells = _cells(docs, doubt.filter("not some").drop("some"), length)
    alive = settle(cells.join(_often(cells, "core"), "core"), "substring-cells")
    release(cells)
    # Cells at the ends of a run have no span, and would all meet in one task.
    spanned, ends = alive.filter("span <> 0"), alive.filter("span = 0").withColumn("sure", F.lit(False))
    spans = _often(spanned, "span").withColumn("sure", F.lit(True))
    known = settle(spanned.join(spans, "span", "left").withColumn("sure", F.coalesce("sure", F.lit(False))).unionByName(ends), "substring-alive")
    release(alive)
    unsure = known.filter("cnt = 1 and not sure").select("core").distinct()
    # Equal spans go on as one.
    rest = known.join(unsure, "core")
    once = rest.filter("span = 0").select("t", "lo", "nw", "cnt")
    merged = rest.filter("span <> 0").groupBy("core", "span").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("t", "lo", "nw")).alias("one")).select("one.t", "one.lo", "one.nw", "cnt")
    fine = once.unionByName(merged).join(texts.select("t", "doc"), "t").select("t", "doc", "lo", "nw", "cnt")
    windows = _windows(docs, fine.unionByName(doubt.filter("some").select("t", "doc", "lo", "nw", "cnt")), length)
    single = texts.filter("mult = 1").select("t")
    points = windows.filter("cnt = 1").join(_often(windows, "wh"), "wh").select("t", F.col("p").alias("lo"), (F.col("p") + length).alias("hi"))
    often = each.filter("cnt > 1").select("g", "bh", "nw")
    full = runs.join(single, "t", "left_semi").join(often, ["g", "bh", "nw"]).select("t", "lo", F.col("nw").cast("long").alias("nw")).unionByName(known.filter("cnt = 1 and sure").select("t", "lo", "nw"))
    cuts = _merged(points.unionByName(full.select("t", "lo", (F.col("lo") + F.col("nw") + length - 1).alias("hi")))).join(single, "t", "left_semi")
    whole = texts.filter(f"mult > 1 and size >= {length}").select("t", F.lit(True).alias("whole"))
    out = settle(cuts.withColumn("whole", F.lit(False)).unionByName(whole, allowMissingColumns=True).select("t", "whole", "cuts"), "substring-repeated")
    release(texts, runs, each, doubt, known, windows)
    return out


def dedup(docs: DataFrame, length: int = 200, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row.

    Every byte inside a string of ``length`` bytes that also starts elsewhere,
    in the same text or another, goes; all copies go, as strings are judged on
    the input. Cuts may fall inside a character, so ``kept`` is binary (null
    unless ``keep_bytes``). A null text is empty; texts shorter than
    ``length`` stay whole; equal rows are copies of each other.
    """
    ship(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    found = repeated(rows, length, gram)
    cut = docs.sparkSession.sparkContext.broadcast(bitmap_of(found.filter("not whole").select("t"), "t"))

    def mark(batches):
        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            keys = np.array([text_key(data[s:e]) for s, e in bounds], np.int64)
            near = in_bitmap(cut.value, keys.view(np.uint64))
            sha = [None if near[k] else hashlib.sha256(data[s:e]).hexdigest() for k, (s, e) in enumerate(bounds)]
            held = [data[s:e].tobytes() if near[k] or keep_bytes else None for k, (s, e) in enumerate(bounds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys), pa.array(np.diff(offsets)), pa.array(sha, pa.string()), pa.array(held, pa.binary())], names=["doc_id", "t", "n_bytes", "sha", "held"])

    def finish(batches):
        for b in batches:
            data, offsets = B.utf8(b.column("held"))
            at, cuts = _lists(b.column("cuts"), ["lo", "hi"])
            whole, sizes, out = b.column("whole").to_numpy(zero_copy_only=False), b.column("n_bytes").to_numpy(), []
            for k, sha in enumerate(b.column("sha").to_pylist()):
                if whole[k]:
                    out.append((int(sizes[k]), 1, hashlib.sha256(b"").hexdigest(), b"" if keep_bytes else None))
                    continue
                own, lo, hi = data[offsets[k] : offsets[k + 1]], cuts["lo"][at[k] : at[k + 1]], cuts["hi"][at[k] : at[k + 1]]
                if not len(lo):
                    out.append((0, 0, sha or hashlib.sha256(own).hexdigest(), own.tobytes() if keep_bytes else None))
                    continue
                ends = zip([0, *hi.tolist()], [*lo.tolist(), len(own)], strict=True)
                kept = b"".join(own[x:y].tobytes() for x, y in ends)
                out.append((int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    marked = rows.mapInArrow(mark, "doc_id long, t long, n_bytes long, sha string, held binary")
    joined = marked.join(found, "t", "left").select("doc_id", "n_bytes", "sha", "held", F.coalesce("whole", F.lit(False)).alias("whole"), "cuts")
    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
