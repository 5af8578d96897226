import pytest
from conftest import DATA, same
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import evidence as E
from papyra.operators import validation as V
from papyra.plans import catalog as C


@pytest.mark.parametrize("name", sorted(C.oracle_sql()))
def test_matches_sql(spark, name):
    got = C.queries()[name](spark, DATA)
    assert same(got, C.oracle_sql()[name])


def test_each_rule_fires_or_not(spark):
    good = ("D1", "F1", "2024-01-02", "2024-01-02", 3)
    bad = ("D2", "F9", "2024-1-2", None, 0)
    docs = spark.createDataFrame([good, bad, bad], "doc_id string, fund_id string, document_date string, effective_date string, total_pages int")
    funds = spark.createDataFrame([("F1", "D1"), ("F2", "D7")], "fund_id string, source_doc_id string")
    rules = [r for r in V.RULES if r.rule in ("V1", "V3", "V4", "V5", "V6", "V7", "V8")]
    got = sorted((r.rule_id, r.key) for r in V.violations({"documents": docs, "funds": funds}, rules).collect())
    assert got == sorted([("V1", "D2"), *[(v, "D2") for v in ("V3", "V4", "V5", "V6") for _ in range(2)], ("V7", "F2"), ("V8", "F2")])
    assert V.violations({"documents": docs.limit(0), "funds": funds.limit(0)}, rules).count() == 0


def test_strict_evidence_fails_on_a_miss(spark):
    base, known = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(PySparkException):
        E.strict(base, known, ["k"], "v").collect()


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("x"))
    assert [(r.x, r.seq) for r in E.numbered(rows, ["x"]).orderBy("x").collect()] == [(k, k + 1) for k in range(1000)]
    assert E.numbered(rows.limit(0), ["x"]).count() == 0


def test_scalars(spark):
    row = spark.createDataFrame([("a\\b", "x.y\\Ez", "as of 24. 3. 7", 2.0, float("nan"))], "p string, t string, d string, n double, bad double")
    got = row.select(T.slashes(F.col("p")), F.col("t").rlike("nothing"), F.regexp(F.col("t"), T.literal(F.col("t"))), T.short_year(F.col("d"), F.lit("z")), T.short_year(F.lit("none"), F.lit("z")), T.is_integer(F.col("n")), T.is_finite(F.col("bad"))).first()
    assert list(got) == ["a/b", False, True, "2024-03-07", "z", True, False]
