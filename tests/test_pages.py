from papyra.operators import pages as P
from papyra.operators import parsers as X
from pyspark.sql import functions as F


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_last_heading_wins(spark):
    assert one(spark, "9.투자전략본문10.투자위험", P.heading) == "risk"
    assert one(spark, "10.투자위험11.매입,환매", P.heading) == "purchase_redemption"
    assert one(spark, "10.투자위험상기의11.매입,환매", P.heading) == "risk"
    assert one(spark, "110.투자위험", P.heading) is None
    assert one(spark, None, P.heading) is None


def test_sections_carry_end_and_give_way(spark):
    rows = [(1, 1, "12. 기준가격"), (1, 2, "x"), (1, 5, "x"), (1, 6, "x"), (1, 7, "제3부 9. 투자전략"), (1, 8, "연평균 수익률"), (1, 9, "x"), (1, 10, "제4부"), (2, 1, "x")]
    got = P.sections(spark.createDataFrame(rows, "doc_id long, page long, text string")).orderBy("doc_id", "page").collect()
    assert [r.section for r in got] == ["pricing", "pricing", "pricing", None, "investment_strategy", "performance", "investment_strategy", None, None]


def test_keeping_and_chunking(spark):
    long = "위험 이다. " * 20
    rows = [(1, 1, "10. 투자위험 " + long), (1, 2, "short"), (1, 3, "목차 제1부 " + long)]
    pages = spark.createDataFrame(rows, "doc_id long, page long, text string")
    got = P.chunk_pages(pages, limit=60, overlap=5)
    assert {r.page for r in got.collect()} == {1}
    assert got.select("chunk_hash").distinct().count() == got.count() > 1


def test_dated_list(spark):
    rows = [(1, 2, "B", "b", None, "NOT_DISCLOSED", "[p.3] x [p.4]"), (1, 1, "A", "a", "2020-01-02", "ESTABLISHED", "[p.4]"), (2, 1, "C", "c", None, "NOT_DISCLOSED", "[p.1]")]
    df = spark.createDataFrame(rows, "f long, o long, n string, c string, d string, s string, src string")
    got = P.dated_list(df, "f", "o", F.col("n"), F.col("c"), F.col("d"), F.col("s"), F.col("src"), {"NOT_DISCLOSED": "unknown"}).collect()
    assert [(r.f, r.text, r.pages) for r in got] == [(1, "A(a): 2020-01-02; B(b): unknown", "4|3")]


def test_issue_chunks(spark):
    df = spark.createDataFrame([("I1", "OPEN", "wrong", None)], "issue_id string, status string, reason string, note string")
    r = P.issue_chunks(df, ["reason", "note"]).first()
    assert (r.quality_status, r.issue_status, r.chunk) == ("OPEN", "OPEN", "reason:wrong")


def test_eligibility(spark):
    rows = [(1, 1, "intro"), (1, 2, "foo START who DATE 종류 A - 2020.1.2 종류 B -"), (1, 3, " none 종류 C - 2021-03-04 END 종류 D - 2022-01-01"), (2, 1, "none")]
    pages = spark.createDataFrame(rows, "d long, p long, t string")
    got = X.eligibility(pages, "d", "p", "t", ["START", "DATE"], "START", "END", r"종류\s*([A-Z])\s+(?=-)").orderBy("label").collect()
    assert [(r.label, r.date, r.status, r.page) for r in got] == [("A", "2020-01-02", "ESTABLISHED", 2), ("B", None, "NOT_ESTABLISHED", 2), ("C", "2021-03-04", "ESTABLISHED", 3)]


def test_dates_by_row(spark):
    rows = [("a", "2020-01-01", ""), ("a", "2020-01-01", ""), ("b", "2020-01-01", ""), ("b", "2021-01-01", ""), ("c", None, "not set up"), ("d", None, "")]
    df = spark.createDataFrame(rows, "k string, d string, n string")
    got = {r.k: (r.status, r.date) for r in X.dates_by_row(df, ["k"], "d", F.col("n") == "not set up").collect()}
    assert got == {"a": ("ESTABLISHED", "2020-01-01"), "b": ("REVIEW_REQUIRED", None), "c": ("NOT_ESTABLISHED", None), "d": ("REVIEW_REQUIRED", None)}


def test_fee_row(spark):
    good = one(spark, "0.5 0.3 - 0.1 0.9 x 1 -", X.fee_row)
    assert (good.management_fee, good.trust_fee, good.total_fee, good.total_expense_ratio, good.bad) == (0.5, 0.0, 0.9, 0.9, False)
    bad = one(spark, "0.5 0.3 0 0.1 0.8 1 0.9", X.fee_row)
    assert bad.bad and bad.management_fee is None and bad.total_fee is None
    assert one(spark, "1 2 3", X.fee_row) is None
    assert one(spark, "합계 1 2 3,456 9", lambda c: X.total_value(c, "합계", 3)) == 3456


def test_table_events(spark):
    def line(n, *cells):
        return (1, 1, n, [(float(x), t) for x, t in cells])

    def event(n, name, values, date="2020-01-01"):
        return line(n, (0, name), (50, date), *[(60 + k, v) for k, v in enumerate(values)])

    rows = [
        line(1, (0, "Fund")),
        event(2, "운용", ["1", "2", "3", "4", "5"]),
        event(3, "x (주식) C-e", ["1", "-", "3", "4", "5.5"]),
        event(4, "비교지수", ["9", "8", "-", "6", "5"]),
        event(5, "수익률 변동성", ["0", "0", "0", "0", "0"]),
        event(6, "unknown", ["1", "1", "1", "1", "1"]),
        line(7, (0, "tail")),
    ]
    lines = spark.createDataFrame(rows, "d long, page long, line long, cells array<struct<x: double, text: string>>")
    classes = spark.createDataFrame([(1, "e"), (1, "C-e")], "d long, class_name string")
    values, issues = X.table_events(lines, classes, "d")
    got = [(r.class_name, r.period, r.return_pct, r.benchmark_return_pct) for r in values.orderBy(F.col("class_name").asc_nulls_first(), "period").collect()]
    assert got[5:] == [("C-e", "1Y", 1.0, 9.0), ("C-e", "3Y", 3.0, None), ("C-e", "5Y", 4.0, 6.0), ("C-e", "SINCE_INCEPTION", 5.5, 5.0)]
    assert {g[0] for g in got[:5]} == {None}
    assert [r.label for r in issues.collect()] == ["unknown tail"]


def test_duplicate_groups(spark):
    df = spark.createDataFrame([("a", None, "n"), ("b", None, "n"), ("c", "k", "n")], "f string, code string, name string")
    assert [(r.group_key, r.members) for r in P.duplicate_groups(df, "f", "code", "name").collect()] == [("n", ["a", "b"])]
