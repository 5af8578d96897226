"""One pass over the page snippets of prospectuses that gives the rows of six tables.

Every file's snippets are read once; what they hold becomes rows that carry the
name of their table, so one write splits them by table and one read of a
partition gives a table back. Nothing but built-in expressions is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators.rules import compiled

# Labels around the values in the source texts, periods in the order of a row of returns, and reasons.
NAME = r"1\. 집합투자기구 명칭 (.*?) 2\. 집합투자업자"
WRITTEN = r"작성 기준일\s*(.*?)\s*5\."
IN_FORCE = r"효력발생일\s*(.*?)\s*6\."
CODE_IN_SUMMARY = r"\(([A-Z0-9]{5})\)\s*<요약정보>"
CODE_IN_CLASSES = r"금융투자협회 펀드코드 .*? ([A-Z0-9]{5})\s+종류"
RISK = [r"투자위험등급\s*(\d)등급", r"(\d)등급으로 분류"]
BENCHMARK = [r"\(주1\) 비교지수\s*:\s*(.*?)(?:<|\(주2\))", r"비교지수는\s*(.*?)(?:이며|이고|\.)"]
CLASS = r"종류([A-Za-z0-9-]+)\s+"
END_OF_CLASSES = r"2\. 집합투자기구의 종류"
FEE_TABLE = r"구분 지급비용(?:\(연간%\))?"
END_OF_ANNUAL = r"나\. 연도별 수익률|연도별 수익률 추이"
PERIODS = ["1Y", "2Y", "3Y", "5Y", "SINCE_INCEPTION"]
EQUITY = r"\(주식\)|\[주식\]"
FEE_REASON = "보수표 자동 구문분석 불일치로 추정 적재하지 않음"
AUM_REASON = "자산총액 자동 구문분석 실패"
SPLIT_REASON = "자산총액 OCR 분리 오류"

_NUMBER = r"(-?\d+(?:\.\d+)?|-)"
_FIVE = r"\s+".join([_NUMBER] * 5)
FEES = ["management_fee", "sales_fee", "trust_fee", "admin_fee", "total_fee"]

#: The columns of each table, in order.
TABLES = {
    "documents": "file_name string, document_date string, effective_date string, total_pages int",
    "funds": "fund_name_raw string, fund_name_normalized string, fund_code string, risk_grade int, asset_type_l1 string, benchmark string",
    "classes": "class_code string, class_name_raw string, account_type string, channel string, front_load double, back_load double, management_fee double, sales_fee double, trust_fee double, admin_fee double, "
    "total_fee double, total_expense_ratio double, source_page string, source_text string",
    "performance": "class_name_raw string, period string, return_pct double, benchmark_return_pct double, as_of_date string, source_page string",
    "aum": "aum_value_raw string, aum_value_krw long, as_of_date string, source_page string",
    "issues": "file_name string, field string, reason string",
}


def _first(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[T.first_match(text, p) for p in patterns])


def _segments(text: Column) -> Column:
    """An array of (label, segment): what stands between each class label and the next."""
    labels = F.regexp_extract_all(text, F.lit(CLASS), F.lit(1))
    rest = F.slice(F.split(text, CLASS, -1), F.lit(2), F.greatest(F.size(labels), F.lit(0)))
    return F.zip_with(labels, rest, lambda a, b: F.struct(a.alias("label"), b.alias("segment")))


def _fields(**columns) -> Column:
    pairs = [x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))]
    return F.create_map(*pairs)


def _row(table: str, fields: Column, pos: Column | int = 0) -> Column:
    return F.struct(F.lit(table).alias("table"), (F.lit(pos) if isinstance(pos, int) else pos).cast("int").alias("pos"), fields.alias("fields"))


def tagged(files: DataFrame, rules: DataFrame, issuer: str) -> DataFrame:
    """(file, table, pos, fields) of every row that the files give, from (file, total_pages, cover, summary, classes, fees, performance, aum).

    The last five are structs of a page and its text, or null. Class names are
    classified by the issuer's rules. A class stands once, with the first code
    found; fees whose parts don't sum to the total (0.001), or whose total is
    above the expense ratio, are left out and reported, as is a file without a
    total of its assets. A dash is 0 among fees and nothing among returns.
    """
    texts = {c: F.regexp_replace(F.coalesce(F.col(f"{c}.text"), F.lit("")), T.WS + "+", " ") for c in ("summary", "classes", "fees", "performance", "aum")}
    x = files.select("file", "total_pages", F.regexp_replace(F.coalesce("cover", F.lit("")), T.WS + "+", " ").alias("cover"), *[t.alias(c) for c, t in texts.items()], *[F.col(f"{c}.page").cast("string").alias(f"{c}_page") for c in texts])
    x = x.withColumns(
        {
            "name": _first(F.col("cover"), NAME), "written": T.iso_date(_first(F.col("cover"), WRITTEN)),
            "listed": _segments(F.split("classes", END_OF_CLASSES, 2)[0]),
            "fee_rows": _segments(F.coalesce(F.get(F.split("fees", FEE_TABLE), F.lit(1)), F.col("fees"))),
            "annual": F.split("performance", END_OF_ANNUAL, 2)[0],
        }
    )
    coded = F.transform("listed", lambda s: F.struct(s["label"].alias("label"), T.first_match(s["segment"], r"\b([A-Z0-9]{5})\b").alias("code")))
    x = x.withColumn("coded", F.filter(coded, lambda s: s["code"].isNotNull() & (s["label"] != "형")))
    x = x.withColumn("named", F.filter("coded", lambda s, i: F.array_position(F.transform("coded", lambda o: o["label"]), s["label"]) == i + 1))
    numbers = lambda s: F.regexp_extract_all(s, F.lit(rf"(?:^|\s){_NUMBER}(?=\s|$)"), F.lit(1))
    of = lambda label: F.get(F.filter(F.col("fee_rows"), lambda r: (r["label"] == label) & (F.size(numbers(r["segment"])) >= 7)), F.lit(0))
    x = x.withColumn("fee_values", F.transform("named", lambda c: F.transform(numbers(of(c["label"])["segment"]), lambda v: F.when(v == "-", "0").otherwise(v).cast("double"))))
    x = x.withColumn("dash", F.transform("named", lambda c: F.get(numbers(of(c["label"])["segment"]), F.lit(6)) == "-"))
    fee = lambda i, k: F.get(F.get(F.col("fee_values"), i), F.lit(k))
    expense = lambda i: F.when(F.get(F.col("dash"), i), fee(i, 4)).otherwise(fee(i, 6))
    parts = lambda i: F.round(fee(i, 0) + fee(i, 1) + fee(i, 2) + fee(i, 3), 4)
    bad = lambda i: F.coalesce((F.abs(parts(i) - fee(i, 4)) > 0.001) | (expense(i) < fee(i, 4)), F.lit(False))
    good = lambda i, c: F.when(~bad(i), c)

    classified = {k: compiled(rules, F.lit(issuer), F.col("label"), k) for k in ("account_type", "channel")}
    with_fee = lambda i: F.get(F.col("fee_values"), i).isNotNull() & (F.size(F.get(F.col("fee_values"), i)) > 0)

    def class_row(c: Column, i: Column) -> Column:
        n = c["label"]
        return _row("classes", _fields(
            class_code=c["code"], class_name_raw=n, front_load=F.when(n == "A", 1.0).when(n.rlike("^A-e|^Ae"), 0.5).otherwise(0.0), back_load=F.when(n == "S", 0.15).otherwise(0.0),
            **{f: good(i, fee(i, k)) for k, f in enumerate(FEES)}, total_expense_ratio=good(i, expense(i)),
            source_page=F.concat_ws("|", "classes_page", F.when(with_fee(i), F.col("fees_page"))),
            source_text=F.concat(F.lit("[p."), F.coalesce("classes_page", F.lit("")), F.lit("] 종류"), n, F.lit("; 코드 "), c["code"]),
        ), i)

    # Returns: the five values that end a class's segment; the benchmark's stand in a row of their own.
    bench = lambda j: T.first_match(F.col("annual"), rf"비교지수\s+{_FIVE}", j + 1)
    day = F.regexp_replace(T.first_match(F.col("annual"), r"~\s*(\d{2}[.년]\s*\d{2}[.월]\s*\d{2})"), "[년월]", ".")
    as_of = F.coalesce(T.short_year(day, F.lit(None)), F.col("written"))
    x = x.withColumns({"as_of": as_of, "returns": F.transform(_segments(F.col("annual")), lambda s: F.struct(s["label"].alias("label"), F.regexp_replace(s["segment"], r"\s+투자신탁.*$", "").alias("segment")))})
    x = x.withColumn("returns", F.filter("returns", lambda r: F.exists("named", lambda c: c["label"] == r["label"]) & r["segment"].rlike(rf"(?:^|\s){_FIVE}\s*$")))
    x = x.withColumn("returns", F.filter("returns", lambda r, i: F.array_position(F.transform("returns", lambda o: o["label"]), r["label"]) == i + 1))

    def return_rows(r: Column, i: Column) -> Column:
        value = lambda j: F.nullif(F.regexp_extract(r["segment"], rf"(?:^|\s){_FIVE}\s*$", j + 1), F.lit("-"))
        rows = [_row("performance", _fields(class_name_raw=r["label"], period=F.lit(p), return_pct=value(j), benchmark_return_pct=F.nullif(bench(j), F.lit("-")), as_of_date=F.col("as_of"), source_page=F.col("performance_page")), i * len(PERIODS) + j) for j, p in enumerate(PERIODS)]
        return F.filter(F.array(*rows), lambda row: row["fields"]["return_pct"].isNotNull())

    total = T.first_match(F.col("aum"), r"합계\s+(?:[-\d,]+\s+){11}([-\d,]+)")
    worth = F.replace(total, F.lit(","), F.lit("")).try_cast("long")
    x = x.withColumns({"total": total, "worth": worth})
    aum_date = F.coalesce(T.iso_date(T.first_match(F.col("aum"), r"(20\d{2}[.년]\s*\d{1,2}[.월]\s*\d{1,2})")), F.col("written"))
    aum = F.when(F.col("worth").isNotNull(), F.array(_row("aum", _fields(aum_value_raw=F.concat("total", F.lit("백만원")), aum_value_krw=F.col("worth") * 1_000_000, as_of_date=aum_date, source_page=F.col("aum_page")))))
    no_aum = F.when(F.col("worth").isNull(), F.array(_row("issues", _fields(file_name=F.col("file"), field=F.lit("aum"), reason=F.when(F.col("total").isNotNull(), SPLIT_REASON).otherwise(AUM_REASON)))))
    wrong = F.filter(F.transform("named", lambda c, i: F.when(bad(i), _row("issues", _fields(file_name=F.col("file"), field=F.concat(F.lit("class.fees."), c["label"]), reason=F.lit(FEE_REASON)), i + 1))), lambda r: r.isNotNull())
    none = F.array().cast("array<struct<table:string,pos:int,fields:map<string,string>>>")
    rows = F.concat(
        F.array(
            _row("documents", _fields(file_name=F.col("file"), document_date=F.col("written"), effective_date=T.iso_date(_first(F.col("cover"), IN_FORCE)), total_pages=F.col("total_pages"))),
            _row("funds", _fields(
                fund_name_raw=F.col("name"), fund_name_normalized=F.replace("name", F.lit(" "), F.lit("")), fund_code=F.coalesce(_first(F.col("summary"), CODE_IN_SUMMARY), _first(F.col("classes"), CODE_IN_CLASSES)),
                risk_grade=F.coalesce(_first(F.col("summary"), RISK[0]), _first(F.col("cover"), RISK[1])), asset_type_l1=F.when(F.col("name").rlike(EQUITY), "주식형").otherwise("채권형"),
                benchmark=F.trim(F.coalesce(_first(F.col("summary"), BENCHMARK[0]), _first(F.col("performance"), BENCHMARK[1]))))),
        ),
        F.transform("named", class_row), F.flatten(F.transform("returns", return_rows)), F.coalesce(aum, none), F.coalesce(no_aum, none), wrong,
    )
    out = x.select("file", F.explode(rows).alias("r")).select("file", "r.table", "r.pos", "r.fields")
    # Labels are classified as plain columns, where a rule's error can be raised for one row only.
    label = F.col("fields")["class_name_raw"]
    marked = out.withColumn("label", F.when(F.col("table") == "classes", label))
    extra = F.create_map(*[y for k, c in classified.items() for y in (F.lit(k), c)])
    return marked.withColumn("fields", F.when(F.col("label").isNotNull(), F.map_concat("fields", extra)).otherwise(F.col("fields"))).drop("label")


def write(rows: DataFrame, path: str) -> None:
    """The tagged rows, a folder per table."""
    rows.write.partitionBy("table").parquet(path)


def table_of(rows: DataFrame, name: str) -> DataFrame:
    """One table of tagged rows: file, pos and its own columns in their types."""
    kinds = [c.strip().split(" ") for c in TABLES[name].split(",")]
    return rows.filter(F.col("table") == name).select("file", "pos", *[F.col("fields")[c].cast(k).alias(c) for c, k in kinds])
