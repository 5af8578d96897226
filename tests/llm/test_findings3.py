"""What the third round of findings asked for, against plain versions."""

from __future__ import annotations

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import DATA  # noqa: E402

from papyra.llm import line_dedup, mixing, quality  # noqa: E402
from papyra.llm import queries as Q  # noqa: E402


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Sources are filled up round by round, what they can't take dealt again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= weight[s] * level}
        out |= {s: most * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left, open_ = left - sum(most * sizes[s] for s in full), open_ - full if full else set()
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 101}, {"a": 3, "b": 7, "c": 0, "d": 50, "e": 20, "": 9, None: 30, "é": 400}, {"x": 0, "y": 0}, {None: 5}])
def test_mix_targets_with_several_sources_below_their_limit(spark, sizes):
    docs = [(k, "w " * n, s) for k, (s, n) in enumerate(sizes.items())]
    got = {r["source_size"]: r["target"] for r in mixing.counts(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {sizes[s]: pytest.approx(v) for s, v in plain_targets(sizes).items()}


def test_mix_targets_of_the_tables(spark):
    got = Q.op2_mix_sources(spark, DATA).join(Q.table(spark, DATA, "documents").select("doc_id", "source"), "doc_id").collect()
    sizes = {r["source"]: r["source_size"] for r in got}
    assert {r["source"]: r["target"] for r in got} == {s: pytest.approx(v) for s, v in plain_targets(sizes).items()}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_quality_threshold_counts_every_labelled_row(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), int(q)) for x, q in zip(rng.integers(0, 9000, 30000) / 10000, rng.integers(0, 9, 30000) > 0)]
    rows += [(0.95, 0)] * 7
    good, bad = (np.array([x for x, q in rows if q == k]) for k in (1, 0))
    frame = spark.createDataFrame(rows, "score double, quality int")
    assert quality.exact_threshold(frame, 0.005) == quality.threshold(good, bad, 0.005)
    assert quality.exact_threshold(frame.filter("quality = 1"), 0.005) == quality.threshold(good, bad[:0], 0.005)
    assert quality.exact_threshold(frame.filter("quality = 0"), 0.005) == np.inf


def test_quality_forest_sees_every_row(spark):
    """Of 20000 rows one stands out: trees must have its extreme, wherever it is, and be the same however rows are dealt over tasks."""
    rows = [(k, 100 + k % 7, 500, 0, 5, 0, 0, 600, 500 + k % 5) for k in range(20000)]
    for odd in (5, 19990):
        rows[odd] = (odd, 100, 500, 60, 5, 0, 0, 600, 500)
        frame = spark.createDataFrame(rows, quality.STATS)
        forest = quality.IsolationForest().fit(frame.repartition(3))
        again = quality.IsolationForest().fit(frame.repartition(7))
        assert all(np.array_equal(a, b) for x, y in zip(forest.nodes, again.nodes, strict=True) for a, b in zip(x, y, strict=True))
        # n_symbols differs in one row only, so only a tree that has it can split on it.
        assert any((f[c[:, 0] != c[:, 1]] == 2).any() for f, _, c, _ in forest.nodes)
        rows[odd] = (odd, 100, 500, 0, 5, 0, 0, 600, 500)


def test_lines_that_share_one_phrase_only_are_never_paired(spark, monkeypatch):
    """300 unlike lines with one phrase in common: SimHashes rule nearly all pairs out before they are made, and a near line is found among them."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstu"), 8))
    lines = [" ".join([word() for _ in range(14)] + ["on that very", "same day"] + [word() for _ in range(14)]) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(lines), (300, lines[7].replace("same day", "same old day"))], "doc_id long, text string")
    made, verifier = [], line_dedup._verifier
    monkeypatch.setattr(line_dedup, "SKETCH", 40)  # every run is a block

    def counting(*of):
        verify = verifier(*of)
        return lambda pairs: made.append(pairs.count()) or verify(pairs)

    monkeypatch.setattr(line_dedup, "_verifier", counting)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(docs, all_lines=True).collect()}
    assert got[300] == 1 and sum(got.values()) == 1
    assert sum(made) < 5000  # of 44850
