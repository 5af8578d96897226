"""Links that depend on frequent tokens, hashes of odd texts, and near lines against all pairs."""

from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm import line_dedup, ngram_join


def brute(texts: list[str], n: int, percent: int) -> list[int]:
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            same = len(x & sets[j])
            if same and 100 * same >= percent * (len(x) + len(sets[j]) - same):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("frequent, percent, n", [(2, 90, 3), (5000, 90, 3), (2, 60, 2), (2, 40, 1)])
def test_links_equal_all_pairs(spark, monkeypatch, frequent, percent, n):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 30, 24)]
        for _ in range(6):
            own = list(base)
            for at in rng.choice(24, rng.integers(0, 3), replace=False):
                own[at] = f"v{rng.integers(0, 4)}"
            texts.append(" ".join(own[: rng.integers(20, 25)]))
    texts += ["", "one", "one", "one two", "w1 w2 w3"]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, n, percent)


def test_rare_and_frequent_prefix_token(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 100)
    tail = "all rights are reserved by the owner of this page"
    rows = [(2 * g + k, ("x " if k else "") + f"r{g} {tail}") for g in range(300) for k in (0, 1)]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    near = [g for g in range(300) if 100 * len(sets[2 * g] & sets[2 * g + 1]) >= 90 * len(sets[2 * g] | sets[2 * g + 1])]
    assert all(got[2 * g + 1] == got[2 * g] for g in near)


def test_columns_that_clash_and_null_ids(spark):
    rows = [(1, "a b c d e", 5, "x"), (None, "a b c d e", 6, "y"), (None, "q r s t u", 6, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long, sig string")
    assert sorted((r.component_id is None, r.component_id) for r in ngram_join.join(df, 3, 90).collect()) == [(False, 1), (False, 1), (True, None)]
    assert ngram_join.join(df.limit(0), 3, 90).count() == 0


def test_thue_morse_words_differ(spark):
    bits = [0]
    for _ in range(11):
        bits += [1 - x for x in bits]
    a, b = (bytes(97 + (x ^ k) for x in bits) for k in (0, 1))
    data = np.frombuffer(a + b" " + b, np.uint8)
    words = B.Words(data, np.array([0, len(data)]), B.SPACED)
    assert len(set(words.hashes().tolist())) == 2 and len(set(B.Stretches(data).of(words.start, words.end).tolist())) == 2
    got = ngram_join.join(spark.createDataFrame([(1, a.decode()), (2, b.decode())], "doc_id long, text string"), 1, 90).collect()
    assert {r.component_id for r in got} == {1, 2}


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 60_000).astype(np.uint8)
    data[rng.random(60_000) < 0.1] = 32
    w, by = B.Words(data, np.array([0, len(data)]), B.SPACED), defaultdict(set)
    for k, h in enumerate(w.hashes().tolist()):
        by[h].add(data[w.start[k] : w.end[k]].tobytes())
    assert all(len(x) == 1 for x in by.values())


def test_near_lines_against_all_pairs(spark):
    """Of all pairs of different lines of the table that are near in words, nine in ten end in one group."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lines = line_dedup._lines(line_dedup._keyed(docs, "doc_id", "text"), 5, 0.8, True).filter("counts and sigs is not null").cache()
    known = {r.node: r.line.split(" ") for r in lines.select("node", "line").distinct().collect()}
    group = {r.node: r.root for r in line_dedup.groups(lines, 0.8).collect()}

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x):
            last, row[0] = row[0], i + 1
            for j, b in enumerate(y):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (a != b))
        return row[-1]

    items, near, found = sorted(known.items(), key=lambda x: len(x[1])), 0, 0
    bags = {k: set(v) for k, v in items}
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if len(x) < 0.8 * len(y):
                break
            # A pair near in words shares most of its different words, or has few of them.
            if len(bags[a] & bags[b]) >= 0.3 * min(len(bags[a]), len(bags[b])) and edits(x, y) <= 0.2 * len(y) + 1e-9:
                near += 1
                found += group.get(a, a) == group.get(b, b)
    assert found >= 0.9 * near
    assert lines.filter(F.col("n") > 0).count() > 0
