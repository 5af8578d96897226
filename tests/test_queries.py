import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import relational as R
from papyra.plans import queries as Q
from papyra.sources import files


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    assert same(Q.queries()[name](spark, DATA), Q.oracle_sql()[name])


def packed(text, limit, overlap):
    import re

    if len(text) <= limit:
        return [text]
    out, now = [], ""
    for s in filter(None, re.split(r"(?<=[.!?])\s+", text)):
        if now and len(now) + len(s) + 1 > limit:
            out.append(now.strip())
            now = now[-overlap:] + " " + s
        else:
            now = f"{now} {s}" if now else s
    return [*out, now.strip()] if now.strip() else out


def test_page_diff_next_covers_all_ids(spark, tmp_path):
    rows = [(-5, 0, "a"), (3, 0, "a"), (3, 1, "b"), (5000, 1, "c"), (5000, None, "n"), (None, 0, "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in Q.queries()["page_diff_next"](spark, str(tmp_path)).collect()}
    assert got == {(-5, 3, 1, None, "b"), (3, 5000, 0, "a", None), (3, 5000, 1, "b", "c"), (3, 5000, None, None, "n")}


@pytest.mark.parametrize("text", ["", "One.", "A b. " * 40, "x" * 90 + ". y. z.", "One two! Three? Four. " * 9])
def test_chunks(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.chunks(F.col("t"), 60, 10).alias("c")).first().c
    assert got == packed(text, 60, 10)


def test_clean_knows_wide_spaces(spark):
    df = spark.createDataFrame([(" a\u3000b\ufeff 페이지 3 / 9 c\u00a0",)], "t string")
    assert df.select(T.clean(F.col("t"))).first()[0] == "a b c"
    assert df.select(T.compact(F.col("t"))).first()[0] == "ab페이지3/9c"


def test_state_reset_and_expiry(spark):
    rows = [(1, p, k) for p, k in enumerate(["a", "", "", "r", "b", ""])]
    df = spark.createDataFrame(rows, "d long, p int, k string")
    out = R.carry_forward(df, "d", "p", F.col("k").isin("a", "b"), F.col("k"), {"a": 2, "b": 9}, F.col("k") == "r")
    assert [r.state for r in out.orderBy("p").collect()] == ["a", "a", None, None, "b", "b"]


def test_last_evidence_wins_and_overrides(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    ev = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k long, e string, o int")
    assert {r.k: r.e for r in R.enrich(base, ev, ["k"], ["o"]).collect()} == {1: "new", 2: None}
    fix = spark.createDataFrame([(2, "z")], "k long, v string")
    assert {r.k: r.v for r in R.override(base, fix, "k", ["v"]).collect()} == {1: "x", 2: "z"}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "hi"'), ("line\nbreak", None)], "x string, y string")
    files.write_csv(df, str(tmp_path / "c"), ["y", "x"])
    got = files.read_csv(spark, str(tmp_path / "c"))
    assert got.columns == ["y", "x"]
    assert {(r.x, r.y) for r in got.collect()} == {("a,b", 'say "hi"'), ("line\nbreak", "")}


def test_duplicates_are_dealt_before_they_are_counted(spark):
    """No task counts the keys of what it scans, so its memory follows the shuffle's partitions, not the files."""
    df = spark.createDataFrame([(k % 90, None if k % 7 else 1) for k in range(100)], "k long, m long")
    got = R.duplicates(df, ["k", "m"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {(r["k"], r["m"]): r["n"] for r in got.collect()} == {(k, None if k % 7 or (k + 90) % 7 else 1): 2 for k in range(10) if (k % 7 == 0) == ((k + 90) % 7 == 0)}
    scan_side = plan.rsplit("Exchange", 1)[1]
    assert "HashAggregate" not in scan_side and plan.count("Exchange") == 1
