"""Each integrity rule on rows that break it, stated apart from the rule data, and the shapes of operators.reshape."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from papyra.operators import audit as A
from papyra.operators import relational as R
from papyra.operators import reshape as S
from papyra.operators import validation as V

SCHEMAS = {
    "documents": "doc_id string, fund_id string, document_date string, effective_date string, total_pages double",
    "funds": "fund_id string, source_doc_id string, risk_grade int, inception_status string, inception_date string, inception_scheduled_date string, source_page int, source_text string",
    "classes": "class_id string, fund_id string, class_name_normalized string, management_fee double, sales_fee double, trust_fee double, admin_fee double, total_fee double, total_expense_ratio double, "
    "class_inception_status string, class_inception_date string, fund_inception_date string, source_doc_id string, source_page int, source_text string",
    "schedules": "fee_schedule_id string, class_id string, fund_id string, period_type string, rate_type string, formula string, management_fee double, sales_fee double, trust_fee double, admin_fee double, total_fee double, "
    "total_expense_ratio double, min_management_fee double, max_management_fee double, min_total_fee double, max_total_fee double, source_doc_id string",
    "performance": "performance_id string, class_id string, fund_id string, period string, return_pct double, benchmark_return_pct double, as_of_date string, source_doc_id string, source_page int, source_text string",
    "aum": "fund_id string",
    "issues": "issue_id string, fund_id string, source_doc_id string, status string, official_confirmation string, confidence double, affected_field string, issue_type string, severity string, source_value string, "
    "source_page string, handling_action string, reason string",
    "links": "issue_id string, table_name string, record_key string, field_name string, relation_type string",
    "chunks": "chunk_id string, issue_id string, section string, source_doc_id string, source_page string, source_text string",
}
GOOD = {
    "documents": dict(fund_id="F", document_date="2024-01-01", effective_date="2024-01-02", total_pages=3.0),
    "funds": dict(source_doc_id="D", risk_grade=3, inception_status="ESTABLISHED", inception_date="2020-01-01", inception_scheduled_date=None, source_page=1, source_text="t"),
    "classes": dict(fund_id="F", class_name_normalized=None, management_fee=0.1, sales_fee=0.2, trust_fee=0.01, admin_fee=0.02, total_fee=0.33, total_expense_ratio=0.4, class_inception_status="ESTABLISHED",
                    class_inception_date="2021-01-01", fund_inception_date="2020-01-01", source_doc_id="D", source_page=1, source_text="t"),
    "schedules": dict(class_id=None, fund_id="F", period_type="P", rate_type="FIXED", formula=None, management_fee=0.1, sales_fee=0.2, trust_fee=0.01, admin_fee=0.02, total_fee=0.33, total_expense_ratio=0.33,
                      min_management_fee=0.0, max_management_fee=1.6, min_total_fee=0.23, max_total_fee=1.83, source_doc_id="D"),
    "performance": dict(class_id=None, fund_id="F", period="1Y", return_pct=1.0, benchmark_return_pct=None, as_of_date="2024-01-01", source_doc_id="D", source_page=2, source_text="t"),
    "issues": dict(fund_id="F", source_doc_id="D", status="REQUIRES_REVIEW", official_confirmation="UNCONFIRMED", confidence=0.5, affected_field="a", issue_type="i", severity="LOW", source_value="v", source_page="1", handling_action="h", reason="r"),
    "chunks": dict(issue_id=None, section="fees", source_doc_id="D", source_page="1", source_text="t"),
}
#: The key of a case's row (its place names it), the table, what is changed, and the rules that it breaks.
CASES = [
    ("documents", {}, ""), ("documents", dict(fund_id="no"), "V3"), ("documents", dict(document_date="2024-1-1"), "V4"), ("documents", dict(document_date=None), "V4"), ("documents", dict(effective_date="2024-01-02x"), "V5"),
    ("documents", dict(total_pages=0.0), "V6"), ("documents", dict(total_pages=1.5), "V6"), ("documents", dict(total_pages=None), "V6"),
    ("funds", dict(source_doc_id="no"), "V8 V26"), ("funds", dict(risk_grade=7), "V9"), ("funds", dict(risk_grade=0), "V9"), ("funds", dict(risk_grade=None), "V9"), ("funds", dict(source_page=0), "V10"), ("funds", dict(source_text=""), "V10"),
    ("funds", dict(inception_status="SOON"), "V27 V29"), ("funds", dict(inception_date=None), "V28"), ("funds", dict(inception_date="2020-01"), "V28"), ("funds", dict(inception_status="NOT_DISCLOSED"), "V29"),
    ("funds", dict(inception_status="NOT_DISCLOSED", inception_date=""), ""), ("funds", dict(inception_scheduled_date="soon"), "V30"),
    ("classes", {}, ""), ("classes", dict(sales_fee=-0.2, total_fee=-0.07), "V12"), ("classes", dict(total_fee=0.34), "V13"), ("classes", dict(trust_fee=None), "V13"), ("classes", dict(trust_fee=None, total_fee=0.32), ""), ("classes", dict(total_fee=None), ""),
    ("classes", dict(total_expense_ratio=0.3), "V14"), ("classes", dict(total_expense_ratio=None), ""), ("classes", dict(class_inception_status="SOON", class_inception_date=""), "V15 V32"), ("classes", dict(class_inception_date="x2021-01-01"), "V16 V33"),
    ("classes", dict(class_inception_status="NOT_DISCLOSED"), "V17 V34"), ("classes", dict(class_inception_status="", class_inception_date="2019-01-01"), ""), ("classes", dict(source_page=0), "V18"), ("classes", dict(source_doc_id=None), "V18"),
    ("classes", dict(fund_id="no"), "V31"), ("classes", dict(class_inception_date="2019-12-31"), "V35"),
    ("schedules", {}, ""), ("schedules", dict(fund_id="no"), "V36"), ("schedules", dict(class_id="no"), "V37"), ("schedules", dict(source_doc_id=None), "V38"), ("schedules", dict(rate_type="FORMULA", formula="f"), ""),
    ("schedules", dict(rate_type="FORMULA", formula="f", min_total_fee=0.3), "V40"), ("schedules", dict(rate_type="FORMULA", formula="f", min_total_fee=None), "V40"), ("schedules", dict(rate_type="FORMULA", formula="f", max_management_fee=1.5), "V41"),
    ("schedules", dict(rate_type="FORMULA", formula=""), "V42"), ("schedules", dict(total_fee=0.3), "V43"), ("schedules", dict(rate_type=None, total_fee=None), "V43"), ("schedules", dict(total_expense_ratio=0.32), "V44"), ("schedules", dict(total_expense_ratio=None), "V44"),
    ("performance", {}, ""), ("performance", dict(period="10Y"), "V20"), ("performance", dict(return_pct=None), "V21"), ("performance", dict(return_pct=float("nan")), "V21"), ("performance", dict(return_pct=1000.5), "V21"), ("performance", dict(return_pct=-100.0), ""),
    ("performance", dict(benchmark_return_pct=-101.0), "V22"), ("performance", dict(as_of_date="24-01-01"), "V23"), ("performance", dict(source_page=0), "V24"), ("performance", dict(fund_id="no"), "V45"), ("performance", dict(class_id="no"), "V46"),
    ("issues", {}, "V60"), ("issues", dict(fund_id=None), "V49 V60"), ("issues", dict(source_doc_id="no"), "V50 V60"), ("issues", dict(status="OPEN"), "V51 V60"), ("issues", dict(official_confirmation=None), "V52 V60"), ("issues", dict(confidence=1.1), "V53 V60"),
    ("issues", dict(severity=""), "V54 V60"), ("issues", dict(status="CONFIRMED_SOURCE_ERROR"), "V55 V60"),
    ("chunks", {}, ""), ("chunks", dict(source_page=""), "V72"), ("chunks", dict(source_text=None), "V72"),
]
KEYS = {"documents": "doc_id", "funds": "fund_id", "classes": "class_id", "schedules": "fee_schedule_id", "performance": "performance_id", "issues": "issue_id", "chunks": "chunk_id"}


def tables(spark):
    """The cases' rows beside a document D, its fund F and a class C, which are in order."""
    rows = {t: [] for t in SCHEMAS}
    rows["documents"].append(GOOD["documents"] | dict(doc_id="D"))
    rows["funds"].append(GOOD["funds"] | dict(fund_id="F"))
    rows["classes"].append(GOOD["classes"] | dict(class_id="C", class_name_normalized="C"))
    for n, (table, change, _) in enumerate(CASES):
        own = GOOD[table] | {KEYS[table]: f"case{n}"}
        if table == "classes":
            own["class_name_normalized"] = f"case{n}"
        if table == "schedules":
            own |= dict(class_id="C", period_type=f"case{n}")
        if table == "performance":
            own["class_id"] = "C"
            own["as_of_date"] = f"2{n:03d}-01-01"
        rows[table].append(own | change)
        if table == "documents":  # every document of the cases has a chunk
            rows["chunks"].append(GOOD["chunks"] | dict(chunk_id=f"of{n}", source_doc_id=f"case{n}"))
        if table == "funds":  # and every fund a document
            rows["documents"].append(GOOD["documents"] | dict(doc_id=f"of{n}", fund_id=f"case{n}"))
            rows["chunks"].append(GOOD["chunks"] | dict(chunk_id=f"of{n}", source_doc_id=f"of{n}"))
    return rows


def frames(spark, rows):
    return {t: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in SCHEMAS[t].split(", ")) for r in rows[t]], SCHEMAS[t]) for t in SCHEMAS}


def test_each_row_rule(spark):
    got = V.violations(frames(spark, tables(spark))).collect()
    of = {}
    for r in got:
        of.setdefault(r["key"], set()).add(r["rule_id"])
    for n, (table, change, rules) in enumerate(CASES):
        assert of.pop(f"case{n}", set()) == set(rules.split()), (table, change)
    assert of == {}


def test_keys_links_and_chunks(spark):
    rows = {t: [] for t in SCHEMAS}
    rows["documents"] = [GOOD["documents"] | dict(doc_id=d, fund_id=f) for d, f in (("D", "F"), ("D", "F"), (None, "F"), ("E", "F"))]
    rows["funds"] = [GOOD["funds"] | dict(fund_id=f) for f in ("F", "G", "G")]
    rows["classes"] = [GOOD["classes"] | dict(class_id=c, class_name_normalized=n) for c, n in (("C", "x"), ("C", "y"), ("K", "x"))]
    rows["schedules"] = [GOOD["schedules"] | dict(fee_schedule_id=s, class_id="C") for s in ("S", "T")]
    rows["performance"] = [GOOD["performance"] | dict(performance_id=str(k), class_id=c, fund_id=f) for k, (c, f) in enumerate([("C", "F"), ("C", "F"), (None, "F"), (None, "F"), (None, "G")])]
    rows["aum"] = [dict(fund_id="F"), dict(fund_id="no")]
    rows["issues"] = [GOOD["issues"] | dict(issue_id=i) for i in ("I", "J")]
    link = dict(table_name="classes", record_key="C", field_name="f", relation_type="LOADED_RECORD")
    rows["links"] = [link | x for x in (dict(issue_id="I"), dict(issue_id="I"), dict(issue_id="no"), dict(issue_id="J", record_key="no"), dict(issue_id="J", table_name="documents", record_key="no"), dict(issue_id="J", table_name="funds", record_key="F"),
                                        dict(issue_id="J", field_name=""), dict(issue_id="J", record_key="gone", relation_type="SOURCE_ONLY"))]
    rows["chunks"] = [GOOD["chunks"] | x for x in (dict(chunk_id="1", issue_id="I", section="source_quality_issue"), dict(chunk_id="2", issue_id="J", section="fees"))]
    got = {(r["rule_id"], r["table_name"], r["key"]) for r in V.violations(frames(spark, rows)).collect()}
    assert got == {
        ("V1", "documents", "D"), ("V25", "documents", "D"), ("V25", "documents", None), ("V2", "funds", "G"), ("V25", "funds", "G"), ("V7", "funds", "G"), ("V11", "classes", "F|x"), ("V25", "classes", "C"), ("V39", "schedules", "C|P"),
        ("V19", "performance", "C|1Y|2024-01-01"), ("V19", "performance", "F|FUND|1Y|2024-01-01"), ("V47", "performance", "C|1Y|2024-01-01"), ("V48", "aum", "no"), ("V56", "links", "no"), ("V57", "links", "J"),
        ("V58", "links", "I|classes|C|f"), ("V59", "links", "J"), ("V60", "issues", "J"), ("V73", "documents", "E"), ("V73", "documents", None),
    }


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b"), (6, "a")], "i int, k string")
    assert sorted(r["i"] for r in R.repeated_rows(df, ["k"], ["i"]).collect()) == [2, 4, 6]


def test_vectors_and_measures(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0], [9.0]), (2, [5.0], None), (3, None, None)], "i int, v array<double>, b array<double>")
    got = S.vector_rows(df, ["i"], "v", {1: ["ALL"], 3: ["1Y", "2Y", "ALL"]}, "b", default=[7.0])
    assert sorted(map(tuple, got.collect())) == [(1, "1Y", 1.0, 9.0), (1, "ALL", 3.0, None), (2, "ALL", 5.0, 7.0)]
    with pytest.raises(Exception, match="no labels for a vector of 3"):
        S.vector_rows(df, ["i"], "v", {1: ["ALL"]}).collect()
    own = spark.createDataFrame([(1, [1.0, 2.0], ["x", "y"])], "i int, v array<double>, l array<string>")
    assert sorted(map(tuple, S.vector_rows(own, ["i"], "v", F.col("l")).collect())) == [(1, "x", 1.0, None), (1, "y", 2.0, None)]
    maps = spark.createDataFrame([(1, {"Y1": (1.0, 2.0)}), (2, None)], "i int, m map<string,struct<r:double,b:double>>")
    assert list(map(tuple, S.measure_rows(maps, ["i"], "m", {"Y1": "1Y"}).collect())) == [(1, "1Y", 1.0, 2.0)]
    with pytest.raises(Exception, match="unknown measure Y1"):
        S.measure_rows(maps, ["i"], "m", {"Y2": "2Y"}).collect()


def test_summary_report(spark):
    counts = spark.createDataFrame([("funds", 2), ("classes", 5)], "metric string, value long")
    rates = spark.createDataFrame([("fee", 0.25)], "metric string, rate double")
    kinds = spark.createDataFrame([("a", 3), ("NULL", 1)], "value string, n long")
    broken = spark.createDataFrame([("V1",), ("V1",)], "rule_id string")
    report = A.summary(counts, {"kind": kinds}, rates, broken, at=F.lit("2024-05-06 07:08:09").cast("timestamp"))
    assert report["generated_at"] == "2024-05-06T07:08:09Z" and report["status"] == "failed" and report["errors"] == {"V1": 2} and report["counts"] == {"classes": 5, "funds": 2}
    assert report["distributions"] == {"kind": {"a": 3, "NULL": 1}} and report["null_policy"]["dash_as_null"] and json.dumps(report)
    assert A.summary(counts, {}, rates, broken.limit(0))["status"] == "passed"
    with pytest.raises(ValueError, match="kind has over 1 values"):
        A.summary(counts, {"kind": kinds}, rates, broken, most=1)


def test_names_of_rules_are_added_after_the_count(spark):
    rule = V.Unique("V1", "documents", ("doc_id",), "duplicate doc_id")
    found = V._repeated(spark.range(5).selectExpr("id % 4 as doc_id"), [rule])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "duplicate doc_id" not in plan[plan.index("Aggregate") :]
    assert [tuple(r) for r in found.collect()] == [("V1", "documents", "0", "duplicate doc_id")]
