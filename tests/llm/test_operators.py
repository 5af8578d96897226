"""Each operator against a plain version, and over nulls, empty and repeated rows, and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm import chat, decontaminate, language, licenses, line_dedup, mixing, ngram_join, quality, queries, substrings, tokens

SPEC = open(queries.tokenizer_file(), encoding="utf-8").read()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string"
LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [(1, None, "en", "a"), (2, "", None, None), (3, "One two three four five six.", "en", "a"), (3, "One two three four five six.", "en", "a"), (None, "x " * 30, "de", None), (5, LONG, "en", "b"), (6, LONG + " end", "en", "b"), (7, LONG, "en", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 1, "clash") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert same(queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


def test_tokens(spark, odd, none, tmp_path):
    for k, df in enumerate((odd, none)):
        tokens.write(df, str(tmp_path / f"t{k}"), queries.tokenizer_file())
    enc = tokens.encoder(SPEC)
    want, start = [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*enc.tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, tokens.documents(tokens.read(spark, str(tmp_path / "t0"))).collect()), key=lambda r: r[1])
    assert got == want
    assert tokens.documents(tokens.read(spark, str(tmp_path / "t1"))).count() == 0
    assert tokens.occurrences(tokens.read(spark, str(tmp_path / "t0")), 2).count() == len(ROWS)


@pytest.mark.parametrize("text", ["it's o'clock. Don't", "a<|endoftext|>b", "Éa\u0301. e\u0301x «x». 12ab3.4", "a\u00a0b\u3000c", "ΑΣ. İstanbul ǅ", ""])
def test_units_equal_whole_texts(text):
    enc = tokens.encoder(SPEC)
    data, off = B.utf8(pa.array([text, "plain words"]))
    ids, n = enc.encode(data, off, 2)
    assert ids[: n[0]].tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_wavelet_matrix():
    ids = np.random.default_rng(3).integers(0, 700, 5000).astype(np.uint32)
    w = tokens.WaveletMatrix.build(ids)
    assert (w.decode() == ids).all()
    for i in (0, 511, 512, 4999):
        assert w.access(i) == ids[i]
    at = np.flatnonzero(ids == ids[77])
    assert w.count(int(ids[77])) == len(at) and [w.select(int(ids[77]), k) for k in range(len(at))] == at.tolist()
    assert w.count(9999) == 0


def test_mix(odd, none):
    got = mixing.counts(odd).collect()
    assert len(got) == len(ROWS) and mixing.counts(none).count() == 0
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(odd).columns == odd.columns
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.counts(odd).collect()))


def test_mix_nears_targets(spark):
    rows = [(k, "w " * (k % 50), None, "abc"[k % 3], 0, 0, "") for k in range(3000)]
    got = mixing.counts(spark.createDataFrame(rows, SCHEMA)).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) < 0.02 * r.target for r in got)


def test_chat(spark):
    t = chat.Template()
    for role, text in [("user", r"\### Assistant: </turn> ok"), ("a:\\b\n", "####\\\\###</turn>\\"), ("", "")]:
        assert t.parse("".join(s["text"] for s in t.segments(role, text))) == (role, text)
    df = spark.createDataFrame([(1, 0, "user", None), (1, 1, "user", "b"), (None, None, None, "c")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.render(df)).collect()}
    assert got[1].n_turns == 2 and got[1].n_out_of_order == 1 and not got[1].complete
    assert got[None].turns_sha256 == hashlib.sha256(b"\nc\n").hexdigest()
    assert chat.digest(chat.render(df.limit(0))).count() == 0


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 40, rng.integers(1, 60))) for _ in range(25)]
    for t in texts[:15]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.integers(len(v))] = "new"
            texts.append(" ".join(v))
    texts += ["", None, "two words", "Two Words"]
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, n, percent).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_rare_and_frequent(spark, monkeypatch, n, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT", 50)
    core = " ".join(f"t{i}" for i in range(11))
    texts = [f"{core} z{i}" for i in range(300)] + [f"{core} same", f"{core} same extra"]
    rng = np.random.default_rng(2)
    for k in range(20):
        words = core.split() + [f"k{k}x{i}" for i in range(rng.integers(1, 40))]
        texts += [" ".join(words), " ".join([*words, f"end{k}"])]
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * len(a & b) >= percent * len(a | b)]
    for _ in range(8):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(df, n, percent).collect()} == dict(enumerate(root))


def test_licenses(odd, none):
    assert licenses.scan(odd).count() == len(ROWS) and licenses.scan(none).count() == 0
    text = "Foo. Released under the MIT License, or the Apache License. " + licenses.TEMPLATES["bsd"].upper()
    data, off = B.utf8(pa.array([text, "", "cc by cc by"]))
    a, b, c = licenses.LicenseScanner().scan(data, off)
    assert a[1:4] == (2, 4, 8) and a[4] == "apache,mit" and a[5] == "apache,bsd,mit" and a[6] == 1.0
    assert b == (0, 0, None, None, "", "", 0.0) and c[1:5] == (2, 0, 2, "cc-by")


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100, 115))), (2, "six"), (3, None), (4, "")], "item_id long, text string")
    for size in (1 << 20, 8):
        found = decontaminate.find(odd, items, block_bytes=size)
        got = [(r.doc_id, r.n_hit, r.n_items) for r in decontaminate.report(found).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, [(1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (None, 0, 0), (5, 15, 1), (6, 15, 1), (7, 15, 1)]))
    left = {r.doc_id: r.text for r in decontaminate.strip(found).collect()}
    words = set(left[5].split())
    assert {"w99", "w115"} <= words and not words & {f"w{i}" for i in range(100, 115)}
    assert decontaminate.find(none, items).count() == 0


def test_decontaminate_items_without_id(spark, odd):
    items = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(100, 115))), (2, "six")], "item_id long, text string")
    for size in (1 << 20, 8):
        got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(decontaminate.find(odd, items, block_bytes=size)).collect()}
        assert got[5] == (15, 0, decontaminate.items_digest([]), True) and got[3] == (1, 1, decontaminate.items_digest(["2"]), True) and not got[1][3]


def test_line_dedup(spark, odd, none):
    line = "the quick brown fox jumps over the lazy dog while forty other animals watch from far away in the green hills of the old country side"
    rows = [(1, f"{line}\nshort"), (2, f"own words that nobody else has at all\n{line.upper()}!"), (3, "short")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("own words that nobody else has at all", 1), 3: ("short", 0)}
    assert line_dedup.dedup(odd).count() == len(ROWS) and line_dedup.dedup(none).count() == 0


def test_line_dedup_of_all_lines(spark, tmp_path):
    wide = "这是一行没有空格的很长的中文文字用来检查重复的行是否会被删除因为每一份文件都带有同样的说明文字"
    lines = ["Les.", "---", wide, "the same boilerplate", "", "***", "กี่"]
    rows = [(1, "\n".join(lines)), (2, "les\n---\n\nown\nกา"), (3, f"{wide}。\nThe same boilerplate!\n \nกี่"), (4, "house\nmouse")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(df, all_lines=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nown\nกา", 2), 3: (" ", 3), 4: (rows[3][1], 0)}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 2, 3: 3, 4: 0}


def test_line_dedup_finds_small_edits(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(2, 9)))
    rows = []
    for k in range(60):
        line = " ".join(word() for _ in range(rng.integers(6, 40)))
        other = list(line)
        for at in rng.choice(len(line), max(1, len(line) // 40), replace=False):
            other[at] = "z"
        rows += [(2 * k, line), (2 * k + 1, "".join(other))]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 0 for k in range(60)) and sum(got[2 * k + 1] for k in range(60)) >= 59


def test_substrings(spark, odd, none):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdé "), 300)) for _ in range(6)]
    texts = [base[0] + base[1], base[1][20:] + base[2], base[2][:90] + base[3], base[3], base[3], "ab" * 200, base[4] + base[4], base[5], "", None, "z" * 150]
    raw, length = [(t or "").encode() for t in texts], 60
    seen = Counter(x[p : p + length] for x in raw for p in range(len(x) - length + 1))
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length, 16).collect()}
    for i, x in enumerate(raw):
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        assert (got[i].n_removed, bytes(got[i].kept)) == (int(gone.sum()), kept), i
    assert substrings.dedup(odd).count() == len(ROWS) and substrings.dedup(none).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.train(docs.filter("doc_id % 2 = 0"))
    test = docs.filter("doc_id % 2 = 1 and n_chars > 100").select("lang", "text").collect()
    right = sum(model.langs[int(model.evidence(r.text.encode()).argmax())] == r.lang for r in test)
    assert right > 0.95 * len(test)
    pages = spark.createDataFrame([(1, None, None), (2, "http://x.de/", '<html lang="de">'), (2, "http://x.de/", '<html lang="de">')], "page_id long, url string, html string")
    assert language.identify(pages, model).count() == 3 and language.identify(pages.limit(0), model).count() == 0


def test_quality(spark, odd, none):
    got = quality.judge(odd).collect()
    assert len(got) == len(ROWS) and quality.judge(none).count() == 0
    assert {r.doc_id: r.base_failed for r in got} == {1: True, 2: True, 3: True, None: True, 5: False, 6: False, 7: False}
    data, off = B.utf8(pa.array(["a b\na b\n \nc", "x y z u v x y z u v"]))
    s = quality.text_statistics(data, off)
    assert s["n_dup_lines"].tolist() == [1, 0] and s["n_repeat_words"].tolist() == [0, 10]


def test_quality_threshold_of_both_classes(spark):
    top = DATA.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{top}/labels.parquet")
    got = quality.judge(spark.read.parquet(f"{top}/documents.parquet"), labels).join(labels, "doc_id").filter("not base_failed")
    kept = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[0] < 0.1 and kept[1] > 0.9
    good, bad = np.array([0.3, 0.4, 0.5]), np.array([0.45, 0.6])
    assert quality.threshold(good, bad, 0.01) == 0.4 and quality.threshold(good, bad[:0], 0.4) == 0.5
    assert quality.threshold(good[:0], bad, 0.01) == np.inf


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and 0 < out.count() <= 2 * docs.count()
        docs = spark.createDataFrame(out.toArrow())
    assert cp.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
