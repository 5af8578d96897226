"""Benchmark decontamination: a broadcast hash set of test n-grams against the windows of every text.

Windows are hashed from word hashes in one pass, looked up in a sorted array
behind a small bit table, and each hit is verified word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm.common import ship, text_rows
from papyra.scratch import settle

WINDOW = 10
_BITS = 20
_OUT = "doc_id long, text string, n_words long, hit_start array<long>, hit_end array<long>, items array<string>"


class TestNgrams:
    """The different windows of benchmark items, by length: sorted hashes with a place of each over one buffer of normalised words, and the items that have it.

    Items are numbered in the order of their ids as strings, each id once.
    """

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        data, offsets = B.utf8(pa.array(texts, pa.large_string()))
        w = B.Words(data, offsets, B.ALNUM)
        hashes, size = w.hashes(lower=True), w.end - w.start
        self.ids = sorted({str(i) for i in ids if i is not None})
        number = {i: k for k, i in enumerate(self.ids)}
        number_of = np.array([-1 if i is None else number[str(i)] for i in ids], np.int32)
        # The words with one space between, so that any window is a slice.
        self.begin = np.cumsum(size + 1) - size - 1
        self.end = self.begin + size
        self.text = np.full(int(size.sum()) + len(w), 0x20, np.uint8)
        place = np.flatnonzero(B.ALNUM[data])
        self.text[place + np.repeat(self.begin - w.start, size)] = B.LOWER[data[place]]
        length = np.minimum(w.count, window)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(length[length > 0]).tolist():
            start, count = B.gram_texts(w.first, n)
            item = np.repeat(np.arange(len(count)), count)
            start, item = start[length[item] == n], item[length[item] == n]
            keys = B.grams(hashes, n)[start]
            order = np.argsort(keys, kind="stable")
            keys, start, item = keys[order], start[order], number_of[item[order]]
            first, group = self._different(keys, start, n)
            # The items of each window, each once, as one array with bounds.
            pair = np.unique(group.astype(np.int64) << 32 | item.astype(np.int64) + 1)
            pair = pair[(pair & 0xFFFFFFFF) > 0]
            bounds = np.searchsorted(pair >> 32, np.arange(len(first) + 1))
            table = np.zeros(1 << _BITS, bool)
            table[(keys & B.U((1 << _BITS) - 1)).astype(np.int64)] = True
            self.by_length[n] = keys[first], start[first], bounds, ((pair & 0xFFFFFFFF) - 1).astype(np.int32), table

    def _window(self, start: int, n: int) -> bytes:
        return self.text[self.begin[start] : self.end[start + n - 1]].tobytes()

    def _different(self, keys: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each different window among sorted keys, and which of them each place has."""
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        # Windows of one hash are nearly always equal; the few that aren't become windows of their own.
        for k in np.flatnonzero(~head).tolist():
            head[k] = self._window(start[k], n) != self._window(start[k - 1], n)
        return np.flatnonzero(head), np.cumsum(head) - 1

    def items_of(self, n: int, k: int) -> np.ndarray:
        """The numbers of the items that have window k of n words."""
        _, _, bounds, items, _ = self.by_length[n]
        return items[bounds[k] : bounds[k + 1]]

    def hits(self, w: B.Words) -> list[tuple[int, int, int]]:
        """Each place (first word, words) of a run of texts where a window occurs, and its number. Equal windows are compared once, whatever number of items have them."""
        hashes, out = w.hashes(lower=True), []
        for n, (keys, start, _, _, table) in self.by_length.items():
            at, _ = B.gram_texts(w.first, n)
            h = B.grams(hashes, n)[at]
            near = np.flatnonzero(table[(h & B.U((1 << _BITS) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, h[near], "left"), np.searchsorted(keys, h[near], "right")
            some = hi > lo
            for p, x, y in zip(at[near[some]].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                own = b" ".join(w.span(p, p + n, lower=True))
                same = [k for k in range(x, y) if self._window(start[k], n) == own]
                out += [(p, n, k) for k in same]
        return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = 8 << 20) -> DataFrame:
    """Every document with the word ranges that benchmark windows cover and the items they come from.

    The benchmark's texts are measured first. What fits in ``block_bytes`` is
    broadcast whole; a larger benchmark goes in blocks of items of at most
    that size (a longer item alone), one scan of the documents each, and the
    ranges found so far go along. A null or empty text has no words and no
    hits; items without words have no window; item ids may repeat. Windows of
    items with a null id cover words like any others, and name no item.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = text_rows(docs, id_col, text_col)
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        t = part.toArrow()
        tests = spark.sparkContext.broadcast(TestNgrams(t["item_id"].to_pylist(), t["text"].to_pylist(), window))
        out = out.mapInArrow(_scanner(tests, k > 0), _OUT)
        if k < blocks - 1:
            out = settle(out, "decontaminate-block")
    return out


def _scanner(tests, carried: bool):
    def run(batches):
        known = tests.value
        names = pa.array(known.ids, pa.string())
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            data, offsets = B.utf8(texts)
            for i, j, piece, off in B.pieces(data, offsets):
                w = B.Words(piece, off, B.ALNUM)
                flags, owner = np.zeros(len(w) + 1, np.int64), np.repeat(np.arange(j - i), w.count)
                windows: list[set[tuple[int, int]]] = [set() for _ in range(i, j)]
                for p, n, k in known.hits(w):
                    flags[p] += 1
                    flags[p + n] -= 1
                    windows[owner[p]].add((n, k))
                items = [np.unique(np.concatenate([known.items_of(*x) for x in found])) if found else np.zeros(0, np.int32) for found in windows]
                hit = np.cumsum(flags)[:-1] > 0
                starts, ends, lists = [], [], []
                for d in range(j - i):
                    lo, hi = int(w.first[d]), int(w.first[d + 1])
                    own = hit[lo:hi].copy()
                    if carried:
                        for s, e in zip(b.column("hit_start")[i + d].as_py(), b.column("hit_end")[i + d].as_py(), strict=True):
                            own[s:e] = True
                        lists.append(sorted({known.ids[k] for k in items[d]} | set(b.column("items")[i + d].as_py())))
                    s, e = _runs(own) if own.any() else ([], [])
                    starts.append(s)
                    ends.append(e)
                if carried:
                    listed = pa.array(lists, pa.list_(pa.string()))
                else:
                    at = np.concatenate([[0], np.cumsum([len(x) for x in items])])
                    listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.take(pa.array(np.concatenate(items) if items else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), texts.slice(i, j - i), pa.array(w.count), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), listed],
                    names=["doc_id", "text", "n_words", "hit_start", "hit_end", "items"],
                )

    return run


def report(found: DataFrame) -> DataFrame:
    """Counts per document from what ``find`` returns."""
    n_hit = F.aggregate(F.zip_with("hit_end", "hit_start", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_start") > 0).alias("contaminated"),
    )


def strip(found: DataFrame) -> DataFrame:
    """(doc_id, text) with the covered words, and what stands between them, cut out of each text.

    A null text stays null and one without hits stays as it is; repeated rows
    are cut alike, and an empty table gives no rows.
    """
    ship(found.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for text, starts, ends in zip(b.column("text"), b.column("hit_start"), b.column("hit_end"), strict=True):
                raw, starts, ends = text.as_py(), starts.as_py(), ends.as_py()
                if raw and starts:
                    data = np.frombuffer(raw.encode(), np.uint8)
                    w = B.Words(data, np.array([0, len(data)]), B.ALNUM)
                    keep = np.ones(len(data), bool)
                    for s, e in zip(starts, ends, strict=True):
                        keep[w.start[s] : w.end[e - 1]] = False
                    raw = data[keep].tobytes().decode()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return found.select("doc_id", "text", "hit_start", "hit_end").mapInArrow(run, "doc_id long, text string")


def items_digest(items: list[str]) -> str:
    """The digest that ``report`` gives for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
