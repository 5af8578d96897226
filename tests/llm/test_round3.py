"""The filter audit, prefix counts and source divergence against plain versions."""

from __future__ import annotations

import itertools
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import DATA, same  # noqa: E402

from papyra.llm import decontaminate, divergence, filter_audit, language, licenses, line_dedup, prefix_counts, quality  # noqa: E402
from papyra.llm import queries as Q  # noqa: E402

ODD = [
    (1, None, "en", None), (2, "", None, "a"), (3, "", "en", ""), (None, "same text here", "en", "a"), (None, "same text here", "en", "a"), (4, "same text here", "en", "a"),
    (4, "same text here", "en", "a"), (9, "same text here", "en", "b"), (5, "ABC " * 60, "en", "b"), (6, "word" * 70000 + " #", "xx", "b"), (7, " \t\n ", "en", "b"), (8, "one # two", "en", "b"),
]


def odd(spark, extra: bool = True):
    """Null, empty, blank, long, repeated and unnamed rows, with further columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 AS mask", "'x' AS part", "2 AS n", "'t' AS term", "0 AS same", "3 AS steps") if extra else df


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_source_divergence"])
def test_against_sql(spark, name):
    assert same(Q.queries()[name](spark, DATA), Q.oracle_sql()[name])


def plain_audit(docs, labels):
    """Every order applied one document at a time."""
    import re

    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, text, _, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in docs)
        rows.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, total = {}, {}
    for part, order in itertools.product({r[0] for r in rows}, itertools.permutations("ABCDE")):
        left = [r for r in rows if r[0] == part]
        for step, f in enumerate(order, 1):
            gone = [r for r in left if f in r[1]]
            left = [r for r in left if f not in r[1]]
            failing = [r for r in rows if r[0] == part and f in r[1]]
            out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(len(r[1]) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
            total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_of_odd_rows(spark):
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, None), (9, 0, 1), (None, 1, 1), (8, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "5 AS good", "6 AS id")
    got = filter_audit.audit(filter_audit.joint_failures(filter_audit.masks(odd(spark), frame)))
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in cols) for r in got.collect()} == plain_audit(ODD, labels)


def test_filter_audit_of_nothing(spark):
    docs, labels = odd(spark).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.joint_failures(filter_audit.masks(docs, labels))).count() == 0


def plain_divergence(docs, least, top):
    """All shares of all terms, compared one by one."""
    import re

    words = [(k, lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for k, (_, text, lang, source) in enumerate(docs)]
    out = set()
    for lang in {w[1] for w in words}:
        of = [w for w in words if w[1] == lang]
        terms = [t for t in {t for w in of for t in w[3]} if sum(t in w[3] for w in of) >= least]
        count = {s: {t: sum(w[3].count(t) for w in of if w[2] == s) for t in terms} for s in {w[2] for w in of}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(terms)) for t in terms}
        p = {s: share(c) for s, c in count.items()}
        q = share({t: sum(c[t] for c in count.values()) for t in terms})
        for s in p:
            for part, rows in (
                ("pair", [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in p if o != s]),
                ("term", [(q[t] - p[s][t], t.encode(), t) for t in terms if count[s][t] and p[s][t] > q[t]]),
            ):
                for rank, (v, _, item) in enumerate(sorted(rows), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, -v, rank))
    return out


TERMS = [
    (k, text, lang, source)
    for k, (text, lang, source) in enumerate(
        [("The cat ÄÖ the", "en", "a"), ("the dog the CAT 3dogs", "en", "b"), ("the É é cat", "en", "b"), (None, "en", "c"), ("dog dog dog the cat", "en", None), ("dog dog dog the cat", "en", None),
         ("alone", "fr", "a"), ("only", "fr", "b"), ("", None, "z"), ("b a b a", "es", "one"), ("a b", "es", "one")]
    )
]


@pytest.mark.parametrize("least,top", [(1, 50), (2, 2), (3, 1), (99, 50)])
def test_divergence_against_plain(spark, least, top):
    docs = spark.createDataFrame(TERMS, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS cells", "4 AS total")
    got = divergence.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_divergence(TERMS, least, top)


def test_divergence_of_odd_rows_and_nothing(spark):
    rows = [tuple(r) for r in divergence.audit(odd(spark), 1).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert set(rows) == plain_divergence(ODD, 1, 50)
    assert divergence.audit(odd(spark).limit(0)).count() == 0


def test_divergence_steps_of_pairs(spark, monkeypatch):
    """A term's pairs may span several steps of expansion."""
    monkeypatch.setattr(divergence, "STEP", 5)
    import numpy as np

    size, lang = np.array([4, 1, 6]), np.array([0, 1, 1])
    place, n = np.array([0, 1, 2, 3, 2, 0, 1, 2, 3, 4, 5]), np.array([1, 1, 2, 2, 9, 3, 3, 3, 3, 3, 3])
    got: dict = {}
    for *cols, times in divergence._tally_pairs(size, lang, place, n):
        for row, t in zip(zip(*(c.tolist() for c in cols)), times.tolist()):
            got[row] = got.get(row, 0) + t
    want: dict = {}
    for k, (first, many) in enumerate(zip([0, 4, 5], size)):
        for i, j in itertools.combinations(range(first, first + many), 2):
            row = int(lang[k]), int(place[i]), int(place[j]), int(n[i]), int(n[j])
            want[row] = want.get(row, 0) + 1
    assert got == want


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_file())


def test_prefix_counts_of_every_prefix(spark):
    texts = [
        "", "the quick brown fox's INTERNATIONAL misunderstanding, isn't it?", "'r 're 'rex ''re a're .'re don't we'll '!'ress", "x<|endoftext|>y <|startoftext|", "!!!!!!!!!!!!!!! ...", "a" * 300,
        "été ȩ́ 한글 café İstanbul ΟΣ ΣΑ", "中文字 กำั \U0001f600\U0001f44d\U0001f3fd 2½ 1234 　 x y", "no-break​space_and#signs|x" * 5,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = prefix_counts.index(docs, Q.tokenizer_file())
    asked = spark.createDataFrame([(k, n) for k, t in enumerate(texts) for n in range(len(t) + 1)] + [(0, 99), (77, 1), (None, 2)], "doc_id long, n_chars long")
    got = {(r["doc_id"], r["n_chars"]): r["tokens"] for r in prefix_counts.count_at(index, asked).collect()}
    t = library()
    want = {(k, n): len(t.encode(x[:n], add_special_tokens=False).ids) for k, x in enumerate(texts) for n in range(len(x) + 1)}
    assert got == want | {(0, 99): 0}
    for budget in (0, 1, 3, 10, 10**6):
        fit = {r["doc_id"]: (r["fit_chars"], r["fit_tokens"]) for r in prefix_counts.truncate(index, budget).collect()}
        for k, x in enumerate(texts):
            n = max(n for n in range(len(x) + 1) if want[k, n] <= budget)
            assert fit[k] == (n, want[k, n])


def test_prefix_counts_of_odd_rows(spark):
    got = sorted((tuple(r) for r in prefix_counts.index(odd(spark), Q.tokenizer_file()).select("doc_id", "n_bytes", "n_chars", "n_tokens").collect()), key=repr)
    t = library()
    want = [(i, len((x or "").encode()), len(x or ""), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in ODD]
    assert got == sorted(want, key=repr)
    assert prefix_counts.index(odd(spark).limit(0), Q.tokenizer_file()).count() == 0


def test_prefix_counts_query(spark):
    t = library()
    docs = Q.table(spark, DATA, "documents").collect()
    want = {r["doc_id"]: (len(r["text"].encode()), len(t.encode(r["text"], add_special_tokens=False).ids)) for r in docs}
    for r in Q.op12_prefix_counts(spark, DATA).collect():
        assert (r["n_bytes"], r["n_tokens"]) == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 2048)
        assert (r["fit_tokens"] <= 2048) and (r["over_limit"] or r["fit_tokens"] == r["n_tokens"])


def edits(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def is_near(a: str, b: str, least: float = 0.8) -> bool:
    x, y = a.split(), b.split()
    most = lambda n, part: int(part * n + 1e-9)
    size, e = max(len(x), len(y)), edits(x, y)
    return e <= most(size, 1 - least) or (e <= most(size, 0.5) and edits(a, b) <= most(max(len(a), len(b)), 1 - least))


@pytest.mark.parametrize("letters", [0xD000, 5])
def test_line_links_are_near_whatever_words_collide(spark, monkeypatch, letters):
    """Words that share a letter while candidates are sorted out aren't taken for equal: each group is one of near lines or of chains of them."""
    import random
    import string

    monkeypatch.setattr(line_dedup, "LETTERS", letters)
    rng = random.Random(letters)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(9))
    lines = [f"order {word()} {word()} was sent by us today" for _ in range(60)]
    for _ in range(20):
        base = [word() for _ in range(rng.choice([6, 10, 14]))]
        lines.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.choice([1, 2, 4])):
                other[rng.randrange(len(other))] = word()
            lines.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    made = line_dedup._lines(line_dedup._keyed(docs, "doc_id", "text"), 5, 0.8, True).filter("counts").cache()
    of = {r["node"]: r["line"] for r in made.select("node", "line").collect()}
    found: dict = {}
    for r in line_dedup.groups(made, 0.8).collect():
        found.setdefault(r["root"], []).append(of[r["node"]])
    root = {x: x for x in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if is_near(a, b):
            root[top(a)] = top(b)
    assert any(len(g) > 1 for g in found.values())
    for group in found.values():
        assert len({top(x) for x in group}) == 1
    assert all(r["n_removed"] == 0 for r in line_dedup.dedup(docs.filter("doc_id < 60"), all_lines=True).collect())


def plain_fusion(pages, model):
    """Every page's score from all other pages, one at a time."""
    import math

    k, seen = len(model.langs), []
    for i, url, html in pages:
        host, domain, suffix, declared, raw = language.page_evidence(url, html)
        ll = list(model.evidence(raw))
        whole = sum(map(math.exp, ll))
        seen.append((i, host, domain, suffix, declared if declared in model.langs or not declared else "other", ll, [math.exp(x) / whole for x in ll]))
    n_suffix = len({r[3] for r in seen if r[1]})
    out = {}
    for me, (i, host, domain, suffix, declared, ll, _) in enumerate(seen):
        others = [r for j, r in enumerate(seen) if j != me]
        total = lambda test, a: sum(r[6][a] for r in others if test(r))
        size = lambda test: sum(1 for r in others if test(r))
        score = []
        for a in range(k):
            every = (total(lambda r: True, a) + 1) / (len(others) + k)
            x = ll[a]
            if declared:
                x += math.log((total(lambda r: r[4] == declared, a) + 0.5) / (total(lambda r: True, a) + 0.5 * (k + 2)))
            if host:
                x += math.log((total(lambda r: r[1] and r[3] == suffix, a) + 0.5) / (total(lambda r: True, a) + 0.5 * n_suffix))
                of_domain = (total(lambda r: r[1] and r[2] == domain, a) + language.SMOOTHING * every) / (size(lambda r: r[1] and r[2] == domain) + language.SMOOTHING)
                x += math.log(max((total(lambda r: r[1] == host, a) + language.SMOOTHING * of_domain) / (size(lambda r: r[1] == host) + language.SMOOTHING), 1e-9))
            else:
                x += math.log(every)
            score.append(x)
        out[i] = (model.langs[score.index(max(score))], 1 / sum(math.exp(x - max(score)) for x in score))
    return out


def test_language_of_pages_that_only_other_evidence_can_decide(spark):
    model = language.train(Q.table(spark, DATA, "documents"))
    texts = {r["lang"]: r["text"] for r in Q.table(spark, DATA, "documents").filter("length(text) > 600").collect()}
    langs = sorted(texts)[:3]
    page = lambda lang, text: f"<html lang='{lang}'><p>{text}</p>" if lang else f"<p>{text}</p>"
    pages = []
    for n in range(12):
        for lang in langs:
            host = f"http://{'www' if n % 2 else 'm'}.{lang}site.{'com' if n % 3 else lang}/a{n}"
            pages.append((len(pages), host if n % 4 else None, page(lang if n % 3 else None, texts[lang][40 * n : 40 * n + 200])))
    first = len(pages)
    empty = [(f"http://m.{langs[0]}site.com/", ""), (None, page(langs[1], "")), (None, None), ("", ""), (f"http://new.{langs[2]}site.com", "<p></p>"), ("http://x.net", page("zz", "")), (None, page(langs[1], "&lt;&amp;"))]
    pages += [(first + n, u, h) for n, (u, h) in enumerate(empty)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS p", "3 AS n")
    got = {r["page_id"]: (r["lang"], r["confidence"]) for r in language.identify(df, model).collect()}
    want = plain_fusion(pages, model)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    assert [got[first + n][0] for n in (0, 1, 4)] == [langs[0], langs[1], langs[2]]


def test_declared_language_of_an_empty_page_without_address(spark):
    model = language.train(Q.table(spark, DATA, "documents"))
    texts = {r["lang"]: r["text"][:400] for r in Q.table(spark, DATA, "documents").filter("length(text) > 600").collect()}
    pages = [(n, f"http://h{n % 5}.example.{'com' if n % 2 else 'org'}/{n}", f"<html lang='{'en' if n % 2 else 'fr'}'>{texts['en' if n % 2 else 'fr']}") for n in range(40)] + [(99, None, "<html lang='en'>")]
    got = {r["page_id"]: r["lang"] for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert got[99] == "en"


def plain_windows(docs, items, n=10):
    """Hit words and items of each document by comparing every window."""
    import hashlib
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict = {}
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + min(n, len(w))]), set()).add(i)
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (own := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[own]
        ids = sorted(str(x) for x in found if x is not None)
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_shared_benchmark_windows(spark, block_bytes):
    """Items with one opening, repeated and missing ids, and short items; in one block and in several."""
    opening = "which of the following statements about the passage above is true"
    items = [(k, f"{opening} x{k} y{k} z{k}") for k in range(30)] + [(5, f"{opening.upper()} again"), (None, opening + " lost"), (None, "only nameless words stand in this one item here"), (40, "two words"), (41, "Two, words!"), (42, ""), (43, None)]
    docs = [(1, f"text {opening} x3 y3 z3 and more"), (2, f"{opening}"), (3, "so only nameless words stand in this one item here"), (4, "these two words, and two words"), (5, None), (6, ""), (7, opening[:40])]
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(found).collect()}
    assert got == plain_windows(docs, items)


def test_license_base_against_plain(spark):
    """op5's base columns on given and odd texts: places of phrases word by word."""
    import re

    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    docs = [(r["doc_id"], r["text"]) for r in Q.table(spark, DATA, "documents").collect()]
    docs += [(-1, None), (-2, ""), (-3, "MIT License, mit LICENSE"), (-4, "cc by cc by-sa"), (-5, "gnu gnu general public license apache license mit"), (-6, "é cc\u00a0by cc/by"), (-7, "x " * 70000 + "apache license"), (-3, "MIT License, mit LICENSE")]
    want = []
    for i, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        at, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    rows = got.collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in rows))) == sorted(map(repr, want))
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in rows)


def test_quality_base_against_plain(spark):
    """op10's counts on given and odd texts."""
    import re

    docs = [(r["doc_id"], r["text"]) for r in Q.table(spark, DATA, "documents").collect()]
    docs += [(-1, None), (-2, ""), (-3, "a b c d e a b c d e"), (-4, "x\n\nx\n x \nx"), (-5, "# * $%&|<> é"), (-6, "w " * 3000), (-7, "one two three four five six\u00a0seven"), (-3, "a b c d e a b c d e")]
    want = []
    for i, text in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count: dict = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        twice = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), len(w) < 10 or 100 * len(twice) > 20 * len(w)))
    got = quality.judge(spark.createDataFrame(docs, "doc_id long, text string"), Q.table(spark, DATA, "labels"))
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(tuple(r)[:7] for r in rows) == sorted(want) and not any(r["base_failed"] and r["kept"] for r in rows)


def test_phrases_of_one_word(spark):
    scanner = licenses.LicenseScanner(phrases={"mit": "mit", "apache license": "apache"})
    docs = spark.createDataFrame([(1, "foo mit bar"), (2, "MIT, mit and apache license"), (3, "apache"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs, scanner=scanner).collect()}
    assert got == {1: (1, 1, 1, "mit"), 2: (3, 0, 3, "apache,mit"), 3: (0, None, None, ""), 4: (0, None, None, "")}


PASSAGE = "Sharing one long passage of many different words makes two documents alike even if their ends differ slightly here"
PIPED = [
    (1, f"{PASSAGE} alpha beta gamma delta"), (2, f"{PASSAGE} alpha beta gamma delta"), (3, f"{PASSAGE} alpha beta gamma omega"), (4, None), (5, ""), (6, "too short"), (7, "other words entirely stand here for the seventh document of this small table"),
    (7, "other words entirely stand here for the seventh document of this small table"), (None, "a document without an id that has its own different words to be kept by all"), (8, " ".join(f"word{k}" for k in range(30000))),
]


def piped(spark):
    return spark.createDataFrame([(i, t, "en", "a" if t else None, len(t or ""), "clash", 1) for i, t in PIPED], "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is None, i))


def test_pipeline_stages_of_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing names: every stage's own decisions, and nothing else, take effect."""
    import corpus_pipeline as cp

    docs, stages = piped(spark), dict(cp.STAGES)
    out = {name: stage(spark, docs, DATA) for name, stage in cp.STAGES}
    for name in list(stages)[:-1]:
        assert out[name].columns == docs.columns
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(docs, Q.table(spark, DATA, "labels")).collect()}
    assert set(ids(out["quality_rules"])) == {i for i, _ in PIPED if verdict[i]} and not {4, 5, 6} & set(ids(out["quality_rules"]))
    # 1 to 3 are near or equal, 7 stands twice, texts without words are linked with nothing.
    assert ids(out["near_duplicates"]) == [1, 4, 5, 6, 7, 8, None]
    bench = Q.table(spark, DATA, "benchmark").first()["text"]
    with_test = docs.unionByName(docs.limit(1).withColumn("doc_id", F_lit(50)).withColumn("text", F_lit(f"before {bench} after")))
    assert ids(stages["benchmark_decontamination"](spark, with_test, DATA)) == ids(docs)
    mixed = out["source_mix"].collect()
    assert all(sum(r["text"] == t and r["doc_id"] == i for r in mixed) <= 2 * sum(x == (i, t) for x in PIPED) for i, t in PIPED)
    assert out["token_ids"].count() == len(PIPED)


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_pipeline_stages_of_an_empty_table(spark):
    import corpus_pipeline as cp

    for _, stage in cp.STAGES:
        assert stage(spark, piped(spark).limit(0), DATA).count() == 0


def test_substrings_of_two_hundred_bytes(spark):
    """op8 at its own length, with texts of several bytes a character and runs over piece borders."""
    import random

    from papyra.llm import substrings

    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé 한") for _ in range(n)) for n in (400, 150, 260, 3000)]
    texts = [base[0] + base[1], base[1] + base[0][30:], base[2] * 3, base[3], base[3][1000:] + "x", "y" * 450, "z" * 199, "", None, base[2][:120]]
    raw = [(t or "").encode() for t in texts]
    seen: dict = {}
    for x in raw:
        for p in range(len(x) - 199):
            seen[x[p : p + 200]] = seen.get(x[p : p + 200], 0) + 1
    want = {}
    for i, x in enumerate(raw):
        gone = [False] * len(x)
        for p in range(len(x) - 199):
            if seen[x[p : p + 200]] > 1:
                gone[p : p + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i] = len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 200).collect()}
    assert got == want


def test_mix_of_other_column_names(spark):
    from papyra.llm import mixing

    docs = Q.table(spark, DATA, "documents")
    plain = mixing.counts(docs, weights=(5, 2, 1), share=1.5, most=2.0)
    other = mixing.counts(docs.selectExpr("doc_id AS i", "text AS t", "source AS s", "'x' AS text"), text_col="t", source_col="s", id_col="i", weights=(5, 2, 1), share=1.5, most=2.0)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, other.collect()))


def test_strip_of_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"a, {item}. b"), (2, None), (3, "clean"), (4, ""), (None, item), (1, f"a, {item}. b")], "doc_id long, text string")
    found = decontaminate.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = sorted(map(repr, map(tuple, decontaminate.strip(found).collect())))
    assert got == sorted(map(repr, [(1, "a, . b"), (1, "a, . b"), (2, None), (3, "clean"), (4, ""), (None, "")]))
    assert decontaminate.strip(found.limit(0)).count() == 0
