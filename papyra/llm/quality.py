"""Quality rules: rule statistics of every text, and an isolation forest over them.

The forest (random axis splits; short paths mark anomalies) is grown a level
at a time from all rows, each of which is dealt to some of the trees, and its
threshold is counted over all labelled rows. Only the trees' nodes, of bounded
number, and the threshold reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm.common import ship, text_rows
from papyra.scratch import settle

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_chars long, n_alpha long"
_SYMBOL = B._table(lambda b: chr(b) in "#*$%&|<>")
_ALPHA = B._table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
WINDOW = 5


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _owned(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys that are equal only within one owner."""
    return B.mix(keys ^ B.mix(owner.astype(np.uint64) + B.U(1)))


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that the rules and the forest use, for each text of a run."""
    n = len(offsets) - 1
    w = B.Words(data, offsets, B.SPACED)
    lead = (data & 0xC0) != 0x80
    out = {
        "n_words": w.count,
        "word_chars": _per_text(B.SPACED[data] & lead, offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_chars": _per_text(lead, offsets),
        "n_alpha": _per_text(_ALPHA[data] & lead, offsets),
    }
    # Lines: between a text's start, its newlines and its end.
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    owner = np.repeat(np.arange(n), 1 + _per_text(data == 10, offsets))
    seen = np.concatenate([[0], np.cumsum(B.SPACED[data])])
    worded = seen[end] > seen[start]
    keys = _owned(B.range_hashes(data, start[worded], end[worded]), owner[worded])
    _, at = np.unique(keys, return_index=True)
    lines = np.bincount(owner[worded], minlength=n)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(owner[worded][at], minlength=n)
    # Words inside windows that the same text has at least twice.
    at, count = B.gram_texts(w.first, WINDOW)
    keys = _owned(B.grams(w.hashes(), WINDOW)[at], np.repeat(np.arange(n), count))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = at[twice]
    step = np.bincount(hit, minlength=len(w) + 1) - np.bincount(hit + WINDOW, minlength=len(w) + 1)
    out["n_repeat_words"] = _per_text(np.cumsum(step[:-1]) > 0, w.first)
    return out


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per text; null and empty texts have zeros, repeated rows are counted alike."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            ids = b.column("doc_id")
            for i, j, piece, off in B.pieces(data, offsets):
                s = text_statistics(piece, off)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(s[c.split()[0]].astype(np.int64)) for c in STATS.split(", ")[1:])], names=[c.split()[0] for c in STATS.split(", ")])

    return text_rows(docs, id_col, text_col).mapInArrow(run, STATS)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that don't grow with a text's length, and the logarithm of the length."""
    f = {k: np.asarray(v, np.float64) for k, v in s.items()}
    words, chars, lines = (np.maximum(f[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    return np.column_stack(
        [
            np.log1p(f["n_words"]),
            f["word_chars"] / words,
            f["n_symbols"] / words,
            f["n_dup_lines"] / lines,
            f["n_repeat_words"] / words,
            f["n_alpha"] / chars,
        ]
    )


#: How many features there are.
WIDTH = 6
_EXTREMES = "tree int, node int, n long, " + ", ".join(f"{e}{k} double" for e in ("lo", "hi") for k in range(WIDTH))


def _extremes(trees: int, each: int, depth: int, feature: np.ndarray, cut: np.ndarray):
    """A function over batches of statistics: count and extremes of the rows in each node of a depth, for the trees that a row is dealt to."""
    names = [c.split()[0] for c in STATS.split(", ")][1:]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = features({c: b.column(c).to_numpy(zero_copy_only=False) for c in names})
            row = np.repeat(np.arange(len(x)), each)
            tree = (np.repeat(b.column("deal").to_numpy(zero_copy_only=False), each) + np.tile(np.arange(each), len(x))) % trees
            at, live = np.ones(len(row), np.int64), np.ones(len(row), bool)
            for _ in range(depth):
                f = feature[tree, at]
                live &= f >= 0
                at = 2 * at + (x[row, np.maximum(f, 0)] >= cut[tree, at])
                at[~live] = 1
            key, row = (tree * feature.shape[1] + at)[live], row[live]
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, part = key[order], x[row[order]]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            low, high = np.minimum.reduceat(part, first), np.maximum.reduceat(part, first)
            columns = [(key[first] // feature.shape[1]).astype(np.int32), (key[first] % feature.shape[1]).astype(np.int32), np.diff(np.append(first, len(key))), *low.T, *high.T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _EXTREMES.split(", ")])

    return run


@dataclass
class IsolationForest:
    """Trees of random splits, held as flat arrays; ``score`` is the usual 2 ** (-path / c(n)), high for anomalies."""

    trees: int = 64
    rows: int = 256
    seed: int = 7
    nodes: list = field(default_factory=list)

    @staticmethod
    def expected(n) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, np.float64)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def fit(self, sound: DataFrame) -> IsolationForest:
        """Grow the trees from all rows of the statistics: a row goes to one tree or more, so that trees of small tables have ``rows`` rows too.

        A tree's nodes stand as in a heap, its root at 1. Extremes and counts
        don't depend on the order of rows, so neither do the trees.
        """
        of = sound.withColumn("deal", F.pmod(F.xxhash64("doc_id", "n_words", "n_chars"), F.lit(self.trees)))
        n = sound.count()
        self.nodes, self.depth = [], int(np.ceil(np.log2(self.rows)))
        if not n:
            return self
        each = min(self.trees, max(1, -(-self.trees * self.rows // n)))
        self.used = n * each / self.trees
        size = 2 << self.depth
        feature, cut, length = np.full((self.trees, size), -1), np.zeros((self.trees, size)), np.zeros((self.trees, size))
        for depth in range(self.depth + 1):
            for r in of.mapInArrow(_extremes(self.trees, each, depth, feature.copy(), cut.copy()), _EXTREMES).groupBy("tree", "node").agg(F.sum("n").alias("n"), *[F.min(f"lo{k}") for k in range(WIDTH)], *[F.max(f"hi{k}") for k in range(WIDTH)]).collect():
                low, high = np.array(r[3 : 3 + WIDTH]), np.array(r[3 + WIDTH :])
                can = np.flatnonzero(high > low)
                if depth == self.depth or not len(can):
                    length[r["tree"], r["node"]] = depth + float(self.expected(r["n"]))
                    continue
                rng = np.random.default_rng([self.seed, r["tree"], r["node"]])
                k = int(rng.choice(can))
                feature[r["tree"], r["node"]], cut[r["tree"], r["node"]] = k, rng.uniform(low[k], high[k])
                length[r["tree"], 2 * r["node"] : 2 * r["node"] + 2] = depth + 1  # of a side without rows
        here = np.arange(size)
        for t in range(self.trees):
            leaf = feature[t] < 0
            child = np.column_stack([np.where(leaf, here, 2 * here), np.where(leaf, here, 2 * here + 1)])
            self.nodes.append((np.maximum(feature[t], 0), cut[t], child, length[t]))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.nodes:
            return np.zeros(len(x))
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, cut, child, length in self.nodes:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = child[at, (x[rows, feature[at]] >= cut[at]).astype(np.int64)]
            total += length[at]
        return 2.0 ** (-(total / len(self.nodes)) / max(float(self.expected(self.used)), 1e-9))


def threshold(good: np.ndarray, bad: np.ndarray, good_loss: float) -> float:
    """The score up to which rows are kept: that of the least mean of the shares of good rows lost and bad rows kept.

    Of equal ones the highest. Without bad rows it is the score that a share
    of ``good_loss`` of the good ones exceeds; without good ones, none.
    """
    if not len(good):
        return np.inf
    if not len(bad):
        return float(np.quantile(good, 1 - good_loss, method="higher"))
    at = np.unique(np.concatenate([good, bad]))
    lost = 1 - np.searchsorted(np.sort(good), at, "right") / len(good)
    passed = np.searchsorted(np.sort(bad), at, "right") / len(bad)
    error = lost + passed
    return float(at[np.flatnonzero(error <= error.min() + 1e-12)[-1]])


#: Scores are added up by so many bins first, then within each bin.
BINS = 1 << 16


def exact_threshold(scored: DataFrame, good_loss: float) -> float:
    """``threshold`` of all rows (score, quality), counted by Spark; two figures and the limit reach the driver."""
    each = scored.groupBy("score").agg(F.sum(F.expr("int(quality = 1)")).alias("good"), F.sum(F.expr("int(quality = 0)")).alias("bad"))
    each = settle(each.withColumn("bin", F.floor(F.col("score") * BINS)), "quality-scores")
    n_good, n_bad = (x or 0 for x in each.agg(F.sum("good"), F.sum("bad")).first())
    if not n_good:
        return np.inf
    bins = each.groupBy("bin").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("g").over(before), F.lit(0)).alias("g"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    up_to = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    run = each.join(F.broadcast(bins), "bin").select("score", (F.col("g") + F.sum("good").over(up_to)).alias("g"), (F.col("b") + F.sum("bad").over(up_to)).alias("b"))
    if not n_bad:
        return run.filter(F.col("g") >= int(np.ceil((n_good - 1) * (1 - good_loss))) + 1).agg(F.min("score")).first()[0]
    big = lambda c: F.col(c).cast("decimal(19,0)")
    error = (F.lit(n_good) - big("g")) * F.lit(n_bad).cast("decimal(19,0)") + big("b") * F.lit(n_good).cast("decimal(19,0)")
    return -run.agg(F.min(F.struct(error.alias("e"), (-F.col("score")).alias("s"))).alias("m")).first()["m"]["s"]


def judge(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    good_loss: float = 0.005,
    max_repeat_percent: int = 20,
    min_words: int = 10,
) -> DataFrame:
    """Statistics, base rule, anomaly score and verdict of every document.

    The forest is grown from all rows that pass the base rule, the threshold
    counts all labelled ones of them, good and bad: see ``threshold``.
    An id that is labelled both good and bad has no label. Without labels (or
    with none that match) only the base rule rejects. A null or empty text has no words and fails the base
    rule; equal rows get equal verdicts; an empty table gives an empty result.
    """
    stats = settle(rule_statistics(docs, id_col, text_col), "quality-stats")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    sound = stats.filter(~base)
    forest = IsolationForest().fit(sound)
    names = [c.split()[0] for c in STATS.split(", ")]

    def run(batches):
        for b in batches:
            s = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names[1:]}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(features(s)))], names=[*b.schema.names, "score"])

    def scored(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(run, f"{STATS}, score double")

    limit = np.inf
    if labels is not None:
        marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
        marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
        known = sound.join(marked, "doc_id", "left_semi")
        limit = exact_threshold(scored(known).select("doc_id", "score").join(marked, "doc_id").select("score", "quality"), good_loss)

    failed = scored(stats).withColumn("base_failed", base)
    return failed.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= F.lit(limit)))
