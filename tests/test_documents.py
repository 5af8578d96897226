"""The queries of plans.documents against SQL, and their operators against plain versions."""

from __future__ import annotations

import csv
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from papyra.functions import chunking as C
from papyra.functions import text as T
from papyra.operators import batch as B
from papyra.operators import corrections as K
from papyra.operators import evidence as E
from papyra.operators import layout as L
from papyra.operators import matching as M
from papyra.operators import relational as R
from papyra.operators import rules as U
from papyra.plans import documents as D
from papyra.plans import queries as Q
from papyra.sources import split_csv


@pytest.mark.parametrize("name", sorted(D.queries()))
def test_against_sql(spark, name):
    assert same(D.queries()[name](spark, DATA), D.oracle_sql()[name])


def test_chunk_documents_against_sql(spark):
    assert same(Q.chunk_documents(spark, DATA), D.CHUNK_DOCUMENTS)


def as_reader(raw: str) -> list[tuple]:
    """Cells as the csv module reads them with line ends kept; rows without a value dropped, short ones filled."""
    rows = list(csv.reader(raw.lstrip("﻿").splitlines(keepends=True)))
    return sorted(tuple((r + [""] * 9)[: len(rows[0])]) for r in rows[1:] if any(r))


@pytest.mark.parametrize("range_bytes", [64, 1000, None])
def test_split_csv(spark, tmp_path, range_bytes):
    rng, want = random.Random(3), []
    cells = ["", "a", 'he said "x"', "multi\nline", "crlf\r\nin", "comma, here", "한글", "q\"\n\"q\n\n\n", "\n", "long " * 60, '""']
    for f in range(2):
        quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') or rng.random() < 0.2 else c
        raw = '﻿"id","na,me",note\r\n' + "".join(f"{f}-{k},{quoted(rng.choice(cells))},{quoted(rng.choice(cells))}\r\n" if rng.random() < 0.95 else rng.choice([",,\r\n", "\r\n", f"{f}short\r\n"]) for k in range(120))
        raw += f'{f}-last,"no line\nend",' if f else ""
        (tmp_path / f"f{f}.csv").write_text(raw, newline="")
        want += as_reader(raw)
    df = split_csv.read_csv(spark, f"file://{tmp_path}", range_bytes)
    assert df.columns == ["id", "na,me", "note"] and sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_split_csv_uses_several_tasks_a_file(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n" + "".join(f'{k},"x\ny"\n' for k in range(3000)), newline="")
    lines = split_csv._lines(spark, f"file://{tmp_path}", 2000)
    assert split_csv.ranges(lines).count() > 4 and lines.rdd.getNumPartitions() > 4
    got = split_csv.read_csv(spark, f"file://{tmp_path}", 2000)
    assert got.count() == 3000 and got.filter("b <> 'x\ny'").count() == 0


@pytest.mark.parametrize("rows", [1, 7, 10000])
def test_split_csv_with_records_over_batches(spark, tmp_path, rows):
    """Records that begin in one Arrow batch and end in a later one, with a range's border among them."""
    raw = "a,b\n" + "".join(f'{k},"{"x" * (k % 3)}\n{chr(10) * (k % 11)}""{k}"\n' if k % 4 else f"{k},plain\n" for k in range(400))
    (tmp_path / "one.csv").write_text(raw, newline="")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        for size in (500, 1 << 24):
            got = split_csv.read_csv(spark, f"file://{tmp_path}", size).collect()
            assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in csv.reader(raw.splitlines(keepends=True)) if r != ["a", "b"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_csv_round_trip_starts_few_tasks(spark, monkeypatch):
    """Tasks with little to read cost more than what they read: a gigabyte of CSV is under a hundred ranges."""
    seen, read = [], split_csv.read_csv
    monkeypatch.setattr(split_csv, "read_csv", lambda s, path, range_bytes=None: seen.append(range_bytes) or read(s, path, range_bytes))
    assert same(D.csv_round_trip(spark, DATA), D.oracle_sql()["csv_round_trip"])
    assert seen and seen[0] * 100 > 1 << 30


def test_split_csv_with_a_cell_over_many_ranges(spark, tmp_path):
    long = "line\n" * 900
    (tmp_path / "one.csv").write_text(f'a,b\n1,"{long}"\n2,z\n', newline="")
    assert sorted(tuple(r) for r in split_csv.read_csv(spark, f"file://{tmp_path}", 300).collect()) == [("1", long), ("2", "z")]


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("days", [30, 3])
def test_asof_against_plain(spark, keyed, days):
    """Few times mean crowded ones, which lie in several ranges."""
    rng = random.Random(days)
    keys = ["a", "b", "c", None] if keyed else ["a"]
    events = [(rng.choice(keys), rng.choice([None, *range(days)]), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    points = [(k, rng.choice(keys), rng.choice([None, *range(-2, days + 3)])) for k in range(150)] + [(7, "a", 1)] * 3
    e, p = spark.createDataFrame(events, "g string, at int, v int"), spark.createDataFrame(points, "id int, g string, t int")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.asof(p, e, "t", "at", "v", ["g"]) if keyed else R.asof(p, e, "t", "at", "v")
        rows = sorted(map(repr, map(tuple, got.collect())))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)

    def best(g, t):
        able = [(at, v) for h, at, v in events if None not in (at, v, t) and at <= t and (not keyed or (g == h and g is not None))]
        return max(able)[1] if able else None

    assert got.columns == ["id", "g", "t", "v"] and rows == sorted(repr((k, g, t, best(g, t))) for k, g, t in points)


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_contained_names(spark, limit):
    names, texts = ["ab", "b", "abc", "", None, "한", "bc", "b"], [(1, "abcab 한한"), (2, None), (3, ""), (3, "bcbc"), (3, "bcbc"), (None, "ab")]
    n, x = spark.createDataFrame([(v,) for v in names], "name string"), spark.createDataFrame(texts, "id int, text string")
    want = sorted(repr((k, v, sum(t.startswith(v, i) for i in range(len(t))))) for k, t in texts for v in {v for v in names if v} if t and v in t)
    assert sorted(repr(tuple(r)) for r in M.contained(x, "id", "text", n, "name", limit).collect()) == want
    assert M.contained(x, "id", "text", n.limit(0), "name", limit).count() == 0 and M.contained(x.limit(0), "id", "text", n, "name", limit).count() == 0


def test_longest_suffix(spark):
    labels = spark.createDataFrame([(1, "g", "fund A-e"), (2, "g", "fund e"), (3, "h", "fund A-e"), (4, None, "x"), (5, "g", None), (6, "g", "fund A-e"), (7, "g", "z"), (8, "g", "")], "i int, g string, l string")
    names = spark.createDataFrame([("g", "e"), ("g", "A-e"), ("g", "-e"), ("h", "d"), ("g", ""), (None, "x"), ("g", "z"), ("g", "very long indeed")], "g string, name string")
    got = {r["i"]: r["name"] for r in M.longest_suffix(labels, "g", "l", names, "name").collect()}
    assert got == {1: "A-e", 2: "e", 3: None, 4: None, 5: None, 6: "A-e", 7: "z", 8: None}


def fold(text, limit, overlap):
    """Chunks made a sentence at a time."""
    if len(text) <= limit:
        return [text]
    out, now = [], ""
    for s in [x for x in re.split(f"(?<=[{C.ENDS}])[{C.BLANKS}]+", text) if x]:
        if now and len(now) + len(s) + 1 > limit:
            out.append(now.strip(C.BLANKS))
            now = now[max(0, len(now) - overlap) :] + " " + s
        else:
            now += (" " if now else "") + s
    return [*out, now.strip(C.BLANKS)] if now.strip(C.BLANKS) else out


def test_chunks_against_fold(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "bb ", "ccc. ", "d! ", "다 ", "e", "  ", " .", ". . "]) for _ in range(rng.randrange(80))) for _ in range(1500)] + ["x. " * 40000, "y" * 5000, "   " * 20, ""]
    for limit, overlap in ((10, 3), (20, 0), (15, 20), (2200, 180)):
        cut = C.cutter(limit, overlap)
        assert all(cut(t) == fold(t, limit, overlap) for t in texts)
    df = spark.createDataFrame([(t,) for t in texts[:50]] + [(None,)], "t string").select(C.chunks(F.col("t"), 10, 3).alias("c"))
    assert [r["c"] for r in df.collect()] == [fold(t, 10, 3) for t in texts[:50]] + [None]


def test_exact_decimals(spark):
    rng = random.Random(2)
    xs = [1.005, 2.675, 0.125, 0.375, 2.5, -2.5, 0.5, -0.5, 1e-7, 0.0, -0.001, 123456789.125, 8.345, 99.995, 5e-324, 1e15 + 0.5, 1 / 3, 2.0**52 + 1]
    xs += [rng.uniform(-1e4, 1e4) for _ in range(500)] + [rng.randrange(-(10**6), 10**6) / 8 for _ in range(300)] + [rng.randrange(-(10**7), 10**7) / 1000 for _ in range(300)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for n in (0, 1, 2, 4):
        for r in df.select("x", T.to_fixed(F.col("x"), n).alias("s")).collect():
            assert r["s"] == ("-" if r["x"] < 0 else "") + f"{abs(Decimal(r['x'])).quantize(Decimal(1).scaleb(-n), rounding=ROUND_HALF_UP):f}"
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-0.0,), (1e300,)], "x double").select(T.to_fixed(F.col("x")).alias("s"))
    assert [r["s"] for r in odd.collect()] == [None, "NaN", "Infinity", "0.00", "1.0E300"]


SNIPPETS = "file string, total_pages int, cover string, " + ", ".join(f"{c} struct<page:int,text:string>" for c in ("summary", "classes", "fees", "performance", "aum"))


def test_batch_of_odd_files(spark):
    files = [
        ("a", 30, "1. 집합투자기구 명칭 미래  자산 (주식) 2. 집합투자업자 x 작성 기준일 2024년 3월 5일 5. 끝", (2, "(AB123) <요약정보> 투자위험등급 2등급"),
         (3, "종류A AB111 x 종류형 QQ111 종류C-Pe BC222 종류A ZZ999 종류N none 2. 집합투자기구의 종류 종류Z ZZ000"), (4, "구분 지급비용 종류A 1 2 종류A 0.1 0.2 0.01 0.02 0.33 - - 종류C-Pe 0.1 0.2 0.01 0.02 0.33 - 0.2"),
         (5, "종류A 2010 1.1 2.2 - 4.4 5.5 종류Q 1 2 3 4 5 종류C-Pe 1 2 3 투자신탁 비교지수 0.5 0.6 0.7 - 0.9"), (6, "합계 1 2 3 4 5 6 7 8 9 10 11 -")),
        ("b", None, None, None, None, None, None, None),
    ]
    rows = B.tagged(spark.createDataFrame(files, SNIPPETS), spark.createDataFrame(U.CLASS_RULES, U.SCHEMA), "미래에셋자산운용").cache()
    table = lambda name: [tuple(r) for r in B.table_of(rows, name).orderBy("file", "pos").collect()]
    assert table("documents") == [("a", 0, "a", "2024-03-05", None, 30), ("b", 0, "b", None, None, None)]
    assert table("funds") == [("a", 0, "미래 자산 (주식)", "미래자산(주식)", "AB123", 2, "주식형", None), ("b", 0, None, None, None, None, "채권형", None)]
    assert [r[2:16] for r in table("classes")] == [("AB111", "A", "일반", "오프라인", 1.0, 0.0, 0.1, 0.2, 0.01, 0.02, 0.33, 0.33, "3|4", "[p.3] 종류A; 코드 AB111"), ("BC222", "C-Pe", "연금저축", "온라인", 0.0, 0.0, *[None] * 6, "3|4", "[p.3] 종류C-Pe; 코드 BC222")]
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in table("performance")] == [("A", "1Y", 1.1, 0.5, "2024-03-05"), ("A", "2Y", 2.2, 0.6, "2024-03-05"), ("A", "5Y", 4.4, None, "2024-03-05"), ("A", "SINCE_INCEPTION", 5.5, 0.9, "2024-03-05")]
    assert table("aum") == [] and [(r[0], r[3], r[4]) for r in table("issues")] == [("a", "aum", B.SPLIT_REASON), ("a", "class.fees.C-Pe", B.FEE_REASON), ("b", "aum", B.AUM_REASON)]


def test_rules_of_issuers(spark):
    rules = spark.createDataFrame([("x", "k", 2, "b", "second"), ("x", "k", 1, "a|b$", "first"), ("y", "k", 1, "", "any"), ("z", "other", 1, "", "no")], U.SCHEMA)
    rows = lambda *r: spark.createDataFrame(list(r), "issuer string, label string")
    got = U.classified(rows(("x", "ab"), ("x", "bc"), ("y", None), ("y", "q")), rules, "issuer", "label", ["k"])
    assert [r["k"] for r in got.collect()] == ["first", "second", "any", "any"]
    for row, message in ((("z", "a"), "no rules for k of issuer z"), (("x", "q"), "no rule of x for k matches q"), (("x", None), "matches null"), ((None, "a"), "issuer null")):
        with pytest.raises(Exception, match=message):
            U.classified(rows(row), rules, "issuer", "label", ["k"]).collect()
    with pytest.raises(ValueError, match="two rules"):
        U.classified(rows(("x", "a")), rules.union(rules), "issuer", "label", ["k"])


def test_corrections_in_order(spark):
    base = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (None, "c", 3.0)], "id int, name string, fee double")
    patches = spark.createDataFrame(
        [(1, "name", 2, "B", "s2"), (1, "name", 1, "A", "s1"), (1, "fee", 5, None, "s3"), (2, "fee", 1, "2.5", "s4"), (2, "fee", 2, "2.5", "s5"), (9, "name", 1, "x", "s6"), (2, "colour", 1, "x", "s7"), (2, "name", 3, "q", "s8"), (2, "name", 3, "p", "s9")],
        "id int, field string, seq int, value string, source string",
    )
    log = K.patch_log(base, patches, "id", ["name", "fee"])
    got = {(r["id"], r["field"], r["seq"], r["value"], r["source"]): (r["replaced"], r["status"]) for r in log.collect()}
    assert got == {
        (1, "name", 1, "A", "s1"): ("a", "OVERRULED"), (1, "name", 2, "B", "s2"): ("A", "APPLIED"), (1, "fee", 5, None, "s3"): ("1.5", "APPLIED"), (2, "fee", 1, "2.5", "s4"): (None, "CONFIRMED"), (2, "fee", 2, "2.5", "s5"): ("2.5", "APPLIED"),
        (9, "name", 1, "x", "s6"): (None, "ORPHAN"), (2, "colour", 1, "x", "s7"): (None, "UNKNOWN_FIELD"), (2, "name", 3, "p", "s9"): ("b", "OVERRULED"), (2, "name", 3, "q", "s8"): ("p", "APPLIED"),
    }
    out = {r["id"]: (r["name"], r["fee"], r["sources"]) for r in K.corrected(base, patches, "id", ["name", "fee"]).collect()}
    assert out == {1: ("B", None, {"name": "s2", "fee": "s3"}), 2: ("q", 2.5, {"fee": "s5", "name": "s8"}), None: ("c", 3.0, {})}
    issues = spark.createDataFrame([(1, "name"), (2, "colour"), (3, "fee")], "id int, field string")
    assert sorted(map(tuple, K.open_issues(issues, log, "id").collect())) == [(2, "colour"), (3, "fee")]


def test_strict_join_fails_whatever_is_read(spark):
    base, evidence = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    for act in (lambda d: d.count(), lambda d: d.select("k").collect(), lambda d: d.collect()):
        with pytest.raises(Exception, match="no evidence for 2"):
            act(E.strict(base, evidence, ["k"], "v"))
    empty = spark.createDataFrame([(1, None), (2, "y")], "k int, v string")
    assert sorted((r["k"], r["v"] or "") for r in E.strict(base, empty, ["k"], "v").collect()) == [(1, ""), (2, "y")]


def test_chunk_ids_past_six_digits(spark):
    many = spark.range(1_000_003).selectExpr("'k' AS kind", "id AS doc", "1L AS page", "'same' AS body")
    out = E.chunk_table([many], "CHUNK")
    assert out.select("chunk_id").distinct().count() == 1_000_003 and out.filter("seq = 1000002").first()["chunk_id"] == "CHUNK1000002" and out.filter("seq = 7").first()["chunk_id"] == "CHUNK000007"
    few = spark.createDataFrame([("k", 1, 1, "a"), ("k", 1, 1, "a"), ("k", 1, 2, "a"), ("k", 1, 3, "b")], "kind string, doc int, page int, body string")
    assert [(r["seq"], r["page"], r["body"]) for r in E.chunk_table([few], "C", keep_by=["doc", "page"]).orderBy("seq").collect()] == [(1, 1, "a"), (2, 2, "a"), (3, 3, "b")]


def test_lines_of_cells(spark):
    cells = [(1, 50.0, 700.2, "b"), (1, 10.0, 700.0, "a"), (1, 10.0, 699.7, "c"), (1, 5.0, 10.0, "z"), (2, 1.0, 1.0, "q"), (2, None, 1.0, "n")]
    got = L.lines(spark.createDataFrame(cells, "page int, x double, y double, str string"), ["page"]).orderBy("page", "line").collect()
    assert [(r["page"], r["line"], r["y"], [c["str"] for c in r["cells"]]) for r in got] == [(1, 1, 700.0, ["a", "b"]), (1, 2, 699.5, ["c"]), (1, 3, 10.0, ["z"]), (2, 1, 1.0, ["q"])]


def test_files_of_issuers(spark, tmp_path):
    from papyra.sources import files

    for issuer, name in (("Alpha", "a.PDF"), ("Alpha", "b.pdf"), ("Beta", "c.txt")):
        (tmp_path / issuer).mkdir(exist_ok=True)
        (tmp_path / issuer / name).write_bytes(name.encode())
    got = files.list_files(spark, f"file://{tmp_path}").select("issuer", "size", "sha256").collect()
    assert sorted((r["issuer"], r["size"]) for r in got) == [("Alpha", 5), ("Alpha", 5)] and len({r["sha256"] for r in got}) == 2


def test_loose_dates(spark):
    rows = ["2024. 3. 5", "2024년 3월 5일", "on 2024/03/05.", "2024　3　5", "2024-3-05", "24. 3. 5", "none", None]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(T.iso_date(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in got] == ["2024-03-05"] * 5 + [None] * 3


def test_enrich_and_backlog(spark):
    base = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, l string")
    more = spark.createDataFrame([(1, "a", 1, "old"), (1, "a", 2, "new"), (1, None, 1, "x"), (2, "c", 1, "y")], "k int, l string, seq int, v string")
    assert sorted(map(repr, map(tuple, R.enrich(base, more, ["k", "l"], ["seq"]).collect()))) == sorted(map(repr, [(1, "a", "new"), (1, None, None), (2, "b", None)]))
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "file_name string")
    got = E.backlog(names("a", "b", "c", "c"), names("a", "z"), names("c", "c", "q"))
    assert sorted(map(tuple, got.collect())) == [("b", False), ("c", True), ("c", True)]
