"""Audit of a chunk table in long form (metric, value), rules on it, and readiness of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rule: the metric it reads and what it must equal, a total or nothing.
AUDIT_RULES = {
    "V62": ("documents_total", "documents"), "V63": ("documents_chunked", "documents"), "V64": ("chunks_total", "chunks"), "V65": ("source_issue_chunks", "issues"),
    "V66": ("empty_chunks", None), "V67": ("missing_provenance_chunks", None), "V68": ("within_document_duplicate_hash_groups", None),
    "V69": ("documents_without_chunks", None), "V70": ("documents_missing_core_sections", None),
}


def _long(df: DataFrame, **metrics) -> DataFrame:
    """One aggregate over ``df`` as rows (metric, value)."""
    one = df.agg(*[F.coalesce(m, F.lit(0)).cast("long").alias(k) for k, m in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("m")).select("m.*")


def chunk_facts(documents: DataFrame, chunks: DataFrame, core: list[str]) -> DataFrame:
    """(metric, value) over documents (doc_id, total_pages) and chunks (source_doc_id, source_page, source_text, section, issue_id).

    A document without chunks misses no section, as it is counted by itself.
    Blank texts are empty chunks and have no hash. Two empty tables give zeros.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    lost = blank("source_doc_id") | blank("source_page") | blank("source_text")
    hashed = chunks.filter(~blank("source_text")).groupBy("source_doc_id", F.sha2("source_text", 256).alias("h")).agg(F.count("*").alias("n"))
    across = hashed.groupBy("h").agg(F.count("*").alias("docs"))
    has = chunks.filter("source_doc_id is not null").groupBy("source_doc_id").agg(*[F.max(F.when(F.col("section") == s, 1).otherwise(0)).alias(f"core{k}") for k, s in enumerate(core)])
    known = documents.select("doc_id").join(has, F.col("doc_id") == F.col("source_doc_id"), "left")
    missing = reduce(lambda a, b: a | b, [F.col(f"core{k}") == 0 for k in range(len(core))], F.lit(False))
    pages = chunks.select("source_doc_id", "source_page").filter("source_doc_id is not null and source_page is not null").distinct()
    return reduce(DataFrame.unionByName, [
        _long(documents, documents_total=F.count("*"), pages_total=F.sum("total_pages")),
        _long(chunks, chunks_total=F.count("*"), empty_chunks=F.count_if(blank("source_text")), missing_provenance_chunks=F.count_if(lost), source_issue_chunks=F.count("issue_id")),
        _long(pages, pages_selected=F.count("*")),
        _long(hashed, within_document_duplicate_hash_groups=F.count_if(F.col("n") > 1)),
        _long(across, cross_document_duplicate_hash_groups=F.count_if(F.col("docs") > 1)),
        _long(known, documents_chunked=F.count("source_doc_id"), documents_without_chunks=F.count_if(F.col("source_doc_id").isNull()), documents_missing_core_sections=F.count_if(missing)),
    ])


def audit_violations(spark: SparkSession, audit: DataFrame | None, totals: dict[str, DataFrame]) -> DataFrame:
    """(rule_id, metric, value, expected) where an audit (metric, value) differs from the tables it is of.

    No audit at all violates V61 alone. A metric that it lacks violates its rule with a null value.
    """
    if audit is None:
        return spark.createDataFrame([("V61", "audit", None, None)], "rule_id string, metric string, value long, expected long")
    rules = spark.createDataFrame([(r, m, t) for r, (m, t) in AUDIT_RULES.items() if t is None or t in totals], "rule_id string, metric string, of string")
    counted = [df.agg(F.count("*").alias("expected")).select(F.lit(t).alias("of"), "expected") for t, df in totals.items()]
    want = rules.join(F.broadcast(reduce(DataFrame.unionByName, counted)), "of", "left") if counted else rules.withColumn("expected", F.lit(None).cast("long"))
    want = want.select("rule_id", "metric", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))
    # Both sides have one row a metric.
    return want.join(F.broadcast(audit.select("metric", "value")), "metric", "left").filter("not value <=> expected").select("rule_id", "metric", "value", "expected")


def missing_files(documents: DataFrame, name: str, files: DataFrame) -> DataFrame:
    """Documents whose file isn't among ``files`` (path, ...), by the last part of the path."""
    there = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("__file"))
    return documents.join(there, documents[name] == F.col("__file"), "left_anti")


def unexpected_counts(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """(value, n, expected) where a value's number of rows isn't the expected (value, expected); a value of one side only counts as 0 on the other."""
    got = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    both = got.join(expected.withColumnRenamed("value", "__value"), got["value"].eqNullSafe(F.col("__value")), "full")
    both = both.select(F.coalesce("value", "__value").alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))
    return both.filter("n <> expected")


def segments(df: DataFrame, key: str, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """(key, segment) for each pattern found in the columns joined by spaces; nulls are left out of the text."""
    text = F.concat_ws(" ", *columns)
    return df.select(key, F.explode(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(s)) for s, p in patterns.items()]))).alias("segment"))


def readiness(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(category, rows, filled, status): READY if a category's field is filled in every row, PARTIAL in some, else NOT_READY; one scan."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f"c_{c}") for c, f in fields.items()])
    long = one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"c_{c}").alias("filled")) for c in fields])).alias("m"))
    status = F.when(F.col("m.filled") == 0, "NOT_READY").when(F.col("m.filled") < F.col("rows"), "PARTIAL").otherwise("READY")
    return long.select("m.category", "rows", "m.filled", status.alias("status"))


def issue_reasons(issues: DataFrame) -> DataFrame:
    """The short form of the issue registry: its keys and ``reason [status; confirmation]``; a missing part is empty."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return issues.select("issue_id", "source_doc_id", "affected_field", F.concat(part("reason"), F.lit(" ["), part("status"), F.lit("; "), part("official_confirmation"), F.lit("]")).alias("reason"))


def listed(df: DataFrame, key: str, lists: dict[str, Column]) -> DataFrame:
    """(list, key): each row under every list whose condition holds for it; null conditions don't."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lists.items()]))
    return df.select(F.explode(hits).alias("list"), F.col(key).alias("key"))


def examples(lists: DataFrame, most: int = 20) -> DataFrame:
    """(list, n, first): how long each list is, and its first ``most`` keys in order.

    Each task keeps its own first keys only, so a list of any length reaches no
    task whole.
    """
    order = Window.partitionBy("list").orderBy("key")
    top = lists.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    first = top.groupBy("list").agg(F.array_sort(F.collect_list("key")).alias("first"))
    return lists.groupBy("list").agg(F.count("*").alias("n")).join(first, "list")


# The policies that a summary states.
POLICIES = {
    "null_policy": {"dash_as_null": True, "unknown_as_null": True, "zero_preserved_only_when_explicit": True},
    "source_quality_policy": {"source_values_never_overwritten": True, "official_confirmation_required_for_confirmed_error": True, "unconfirmed_issues_labeled_as_candidates": True},
}


def summary(counts: DataFrame, distributions: dict[str, DataFrame], rates: DataFrame, broken: DataFrame, at: Column | None = None, most: int = 1000) -> dict:
    """A report of counts (metric, value), distributions (value, n), null rates (metric, rate) and broken rules, with the policies and the time.

    Status is failed if any rule is broken. Distributions are of coded fields:
    one with over ``most`` values is an error.
    """
    spark, out = counts.sparkSession, {}
    stamp = spark.range(1).select(F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t")).first()["t"]
    errors = broken.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy("rule_id").collect()
    for name, df in distributions.items():
        rows = df.orderBy(F.desc("n"), "value").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has over {most} values")
        out[name] = {r["value"]: r["n"] for r in rows}
    return {
        "generated_at": stamp, "status": "failed" if errors else "passed", "counts": {r["metric"]: r["value"] for r in counts.orderBy("metric").collect()}, "distributions": out,
        "null_rates": {r["metric"]: r["rate"] for r in rates.orderBy("metric").collect()}, **POLICIES, "errors": {r["rule_id"]: r["n"] for r in errors},
    }
