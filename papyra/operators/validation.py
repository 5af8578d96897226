"""Named integrity rules as data, evaluated with one scan a table.

A rule is violated by a row for which its SQL condition holds, by a key that
several rows have, or by a value that no row of another table has. All row
rules of a table are evaluated in the same scan. Conditions are plain SQL, so
the same rules can be run by any other engine over the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What statuses, periods and confirmations may be, and how dates look.
STATUSES = "('ESTABLISHED', 'NOT_ESTABLISHED', 'NOT_DISCLOSED', 'REVIEW_REQUIRED')"
PERIODS = "('1Y', '2Y', '3Y', '5Y', 'SINCE_INCEPTION')"
ISSUE_STATUSES = "('SUSPECTED_SOURCE_ERROR', 'INTERNAL_CONFLICT', 'RESOLVED_WITH_EVIDENCE', 'REQUIRES_REVIEW', 'CONFIRMED_SOURCE_ERROR')"
CONFIRMATIONS = "('UNCONFIRMED', 'CONFIRMED')"


@dataclass(frozen=True)
class Row:
    """Violated by each row for which ``condition`` is true."""

    rule: str
    table: str
    key: str
    condition: str
    message: str


@dataclass(frozen=True)
class Unique:
    """Violated once by each value of ``columns`` (SQL expressions) that several rows have, of rows for which ``where`` holds."""

    rule: str
    table: str
    columns: tuple[str, ...]
    message: str
    where: str = "true"


@dataclass(frozen=True)
class Exists:
    """Violated by each row, of those for which ``where`` holds, whose ``column`` no row of ``other`` for which ``other_where`` holds has."""

    rule: str
    table: str
    key: str
    column: str
    other: str
    other_column: str
    message: str
    where: str = "true"
    other_where: str = "true"


def not_iso(c: str) -> str:
    digits = "and ".join(f"substr({c}, {k}, 1) between '0' and '9' " for k in (1, 2, 3, 4, 6, 7, 9, 10))
    return f"not coalesce(length({c}) = 10 and substr({c}, 5, 1) = '-' and substr({c}, 8, 1) = '-' and {digits}, false)"


def blank(*columns: str) -> str:
    return " or ".join(f"coalesce(cast({c} as string), '') = ''" for c in columns)


def total(*columns: str) -> str:
    """A sum in which what is missing counts as 0."""
    return " + ".join(f"coalesce({c}, 0)" for c in columns)


#: Page 0 is no page.
_PROVENANCE = blank("source_doc_id", "source_page", "source_text") + " or cast(source_page as string) = '0'"
_PARTS = total("management_fee", "sales_fee", "trust_fee", "admin_fee")
_FIXED = total("sales_fee", "trust_fee", "admin_fee")
#: A return of no class is the fund's own.
_OF_CLASS_OR_FUND = "coalesce(cast(class_id as string), concat(coalesce(cast(fund_id as string), ''), '|FUND'))"
_FORMULA = "rate_type = 'FORMULA'"

RULES = [
    Unique("V1", "documents", ("doc_id",), "duplicate doc_id"),
    Unique("V2", "funds", ("fund_id",), "duplicate fund_id"),
    Exists("V3", "documents", "doc_id", "fund_id", "funds", "fund_id", "orphan fund_id"),
    Row("V4", "documents", "doc_id", not_iso("document_date"), "invalid document_date"),
    Row("V5", "documents", "doc_id", not_iso("effective_date"), "invalid effective_date"),
    Row("V6", "documents", "doc_id", "total_pages is null or total_pages <> floor(total_pages) or total_pages < 1", "invalid total_pages"),
    Exists("V7", "funds", "fund_id", "fund_id", "documents", "fund_id", "no linked document"),
    Exists("V8", "funds", "fund_id", "source_doc_id", "documents", "doc_id", "invalid source_doc_id"),
    Row("V9", "funds", "fund_id", "coalesce(risk_grade, 0) < 1 or risk_grade > 6", "invalid risk_grade"),
    Row("V10", "funds", "fund_id", _PROVENANCE, "missing provenance"),
    Unique("V11", "classes", ("fund_id", "class_name_normalized"), "duplicate class"),
    Row("V12", "classes", "class_id", "least(management_fee, sales_fee, trust_fee, admin_fee) < 0 or total_fee < 0 or total_expense_ratio < 0", "negative fee"),
    Row("V13", "classes", "class_id", f"abs({_PARTS} - total_fee) > 0.00001", "component sum differs from total_fee"),
    Row("V14", "classes", "class_id", "total_expense_ratio + 0.00001 < total_fee", "total_expense_ratio below total_fee"),
    Row("V15", "classes", "class_id", f"class_inception_status <> '' and class_inception_status not in {STATUSES}", "invalid class_inception_status"),
    Row("V16", "classes", "class_id", f"class_inception_status = 'ESTABLISHED' and {not_iso('class_inception_date')}", "established class missing valid inception date"),
    Row("V17", "classes", "class_id", "class_inception_status <> '' and class_inception_status <> 'ESTABLISHED' and class_inception_date <> ''", "non-established class has inception date"),
    Row("V18", "classes", "class_id", _PROVENANCE, "missing provenance"),
    Unique("V19", "performance", (_OF_CLASS_OR_FUND, "period", "as_of_date"), "duplicate performance"),
    Row("V20", "performance", "performance_id", f"coalesce(period, '') not in {PERIODS}", "invalid period"),
    Row("V21", "performance", "performance_id", "return_pct is null or not (return_pct >= -100 and return_pct <= 1000)", "unreasonable return"),
    Row("V22", "performance", "performance_id", "benchmark_return_pct is not null and not (benchmark_return_pct >= -100 and benchmark_return_pct <= 1000)", "unreasonable benchmark"),
    Row("V23", "performance", "performance_id", not_iso("as_of_date"), "invalid as_of_date"),
    Row("V24", "performance", "performance_id", _PROVENANCE, "missing provenance"),
    *[Row("V25", t, k, blank(k), f"missing {k}") for t, k in (("documents", "doc_id"), ("funds", "fund_id"), ("classes", "class_id"), ("schedules", "fee_schedule_id"), ("issues", "issue_id"))],
    *[Unique("V25", t, (k,), f"duplicate {k}", f"not ({blank(k)})") for t, k in (("documents", "doc_id"), ("funds", "fund_id"), ("classes", "class_id"), ("schedules", "fee_schedule_id"), ("issues", "issue_id"))],
    Exists("V26", "funds", "fund_id", "source_doc_id", "documents", "doc_id", "orphan source_doc_id"),
    Row("V27", "funds", "fund_id", f"coalesce(inception_status, '') not in {STATUSES}", "invalid fund inception status"),
    Row("V28", "funds", "fund_id", f"inception_status = 'ESTABLISHED' and {not_iso('inception_date')}", "established fund missing inception date"),
    Row("V29", "funds", "fund_id", "coalesce(inception_status, '') <> 'ESTABLISHED' and inception_date <> ''", "non-established fund has inception date"),
    Row("V30", "funds", "fund_id", f"inception_scheduled_date <> '' and {not_iso('inception_scheduled_date')}", "invalid scheduled inception date"),
    Exists("V31", "classes", "class_id", "fund_id", "funds", "fund_id", "orphan fund_id"),
    Row("V32", "classes", "class_id", f"class_inception_status <> '' and class_inception_status not in {STATUSES}", "invalid class inception status"),
    Row("V33", "classes", "class_id", f"class_inception_status = 'ESTABLISHED' and {not_iso('class_inception_date')}", "invalid class inception date"),
    Row("V34", "classes", "class_id", "class_inception_status <> '' and class_inception_status <> 'ESTABLISHED' and class_inception_date <> ''", "non-established class has inception date"),
    Row("V35", "classes", "class_id", "class_inception_status <> '' and class_inception_date <> '' and fund_inception_date <> '' and class_inception_date < fund_inception_date", "class inception precedes fund inception"),
    Exists("V36", "schedules", "fee_schedule_id", "fund_id", "funds", "fund_id", "orphan fund_id"),
    Exists("V37", "schedules", "fee_schedule_id", "class_id", "classes", "class_id", "orphan class_id"),
    Exists("V38", "schedules", "fee_schedule_id", "source_doc_id", "documents", "doc_id", "orphan source_doc_id"),
    Unique("V39", "schedules", ("class_id", "period_type"), "duplicate class/period"),
    Row("V40", "schedules", "fee_schedule_id", f"{_FORMULA} and abs({_FIXED} + coalesce(min_management_fee, 0) - coalesce(min_total_fee, 0)) > 0.000001", "minimum fee components do not sum to minimum total"),
    Row("V41", "schedules", "fee_schedule_id", f"{_FORMULA} and abs({_FIXED} + coalesce(max_management_fee, 0) - coalesce(max_total_fee, 0)) > 0.000001", "maximum fee components do not sum to maximum total"),
    Row("V42", "schedules", "fee_schedule_id", f"{_FORMULA} and ({blank('formula')})", "formula rate missing formula"),
    Row("V43", "schedules", "fee_schedule_id", f"not coalesce({_FORMULA}, false) and abs({_PARTS} - coalesce(total_fee, 0)) > 0.000001", "fee components do not sum to total"),
    Row("V44", "schedules", "fee_schedule_id", f"not coalesce({_FORMULA}, false) and coalesce(total_expense_ratio, 0) < coalesce(total_fee, 0)", "total_expense_ratio below total_fee"),
    Exists("V45", "performance", "performance_id", "fund_id", "funds", "fund_id", "orphan fund"),
    Exists("V46", "performance", "performance_id", "class_id", "classes", "class_id", "orphan class", "class_id is not null"),
    Unique("V47", "performance", ("class_id", "period", "as_of_date"), "duplicate class, period and date", "class_id is not null"),
    Exists("V48", "aum", "fund_id", "fund_id", "funds", "fund_id", "orphan fund"),
    Exists("V49", "issues", "issue_id", "fund_id", "funds", "fund_id", "orphan fund_id"),
    Exists("V50", "issues", "issue_id", "source_doc_id", "documents", "doc_id", "orphan source_doc_id"),
    Row("V51", "issues", "issue_id", f"coalesce(status, '') not in {ISSUE_STATUSES}", "invalid status"),
    Row("V52", "issues", "issue_id", f"coalesce(official_confirmation, '') not in {CONFIRMATIONS}", "invalid official_confirmation"),
    Row("V53", "issues", "issue_id", "confidence is null or not (confidence >= 0 and confidence <= 1)", "invalid confidence"),
    Row("V54", "issues", "issue_id", blank("affected_field", "issue_type", "severity", "source_value", "source_page", "handling_action", "reason"), "missing mandatory field"),
    Row("V55", "issues", "issue_id", "status = 'CONFIRMED_SOURCE_ERROR' and coalesce(official_confirmation, '') <> 'CONFIRMED'", "confirmed error lacks official confirmation"),
    Exists("V56", "links", "issue_id", "issue_id", "issues", "issue_id", "orphan issue"),
    Row("V57", "links", "issue_id", blank("table_name", "record_key", "field_name", "relation_type"), "incomplete link"),
    Unique("V58", "links", ("issue_id", "table_name", "record_key", "field_name"), "duplicate link"),
    *[Exists("V59", "links", "issue_id", "record_key", t, k, f"missing record of {t}", f"relation_type = 'LOADED_RECORD' and table_name = '{t}'") for t, k in (("classes", "class_id"), ("documents", "doc_id"), ("funds", "fund_id"))],
    Exists("V60", "issues", "issue_id", "issue_id", "chunks", "issue_id", "issue without a chunk", other_where="section = 'source_quality_issue'"),
    Row("V72", "chunks", "chunk_id", blank("source_doc_id", "source_page", "source_text"), "missing provenance"),
    Exists("V73", "documents", "doc_id", "doc_id", "chunks", "source_doc_id", "document without chunks"),
]
COLUMNS = ["rule_id", "table_name", "key", "message"]


def _named(found: DataFrame, rules: list) -> DataFrame:
    """Rows (rule, key) with the names of the rule that has this place in the list: names aren't carried through counts and joins."""
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("rule") + 1)
    return found.select(of([r.rule for r in rules]).alias("rule_id"), F.lit(rules[0].table).alias("table_name"), "key", of([r.message for r in rules]).alias("message"))


def _repeated(df: DataFrame, rules: list[Unique]) -> DataFrame:
    """All uniqueness rules of a table in one scan and one count by (rule, key)."""
    keys = lambda r: F.array(*[F.expr(c).cast("string") for c in r.columns])
    asked = F.array_compact(F.array(*[F.when(F.expr(r.where), F.struct(F.lit(i).alias("rule"), keys(r).alias("k"))) for i, r in enumerate(rules)]))
    twice = df.select(F.explode(asked).alias("a")).groupBy("a.rule", "a.k").agg(F.count("*").alias("n")).filter("n > 1")
    return _named(twice.select("rule", F.array_join(F.transform("k", lambda c: F.coalesce(c, F.lit(""))), "|").alias("key")), rules)


def _orphans(child: DataFrame, parent: DataFrame, rules: list[Exists]) -> DataFrame:
    """All references of a table to one column of another in one scan and one join."""
    asked = F.array_compact(F.array(*[F.when(F.expr(r.where), F.struct(F.lit(i).alias("rule"), F.col(r.key).cast("string").alias("key"), F.col(r.column).cast("string").alias("ref"))) for i, r in enumerate(rules)]))
    refs = child.select(F.explode(asked).alias("a")).select("a.*")
    return _named(refs.join(parent, F.col("ref") == F.col("parent_key"), "left_anti").select("rule", "key"), rules)


def violations(tables: dict[str, DataFrame], rules: list = RULES) -> DataFrame:
    """(rule_id, table_name, key, message) of each violation of the rules whose tables are given.

    A null compares as unknown and violates no condition that doesn't ask for
    nulls; a null reference is an orphan; null keys are equal to each other.
    An empty table violates nothing.
    """
    known, out = [r for r in rules if r.table in tables and getattr(r, "other", r.table) in tables], []
    for name in dict.fromkeys(r.table for r in known):
        rows = [r for r in known if r.table == name and isinstance(r, Row)]
        if rows:  # all in one scan
            hits = F.array_compact(F.array(*[F.when(F.expr(r.condition), F.struct(F.lit(r.rule).alias("rule_id"), F.lit(r.message).alias("message"))) for r in rows]))
            found = tables[name].select(F.col(rows[0].key).cast("string").alias("key"), F.explode(hits).alias("v"))
            out.append(found.select("v.rule_id", F.lit(name).alias("table_name"), "key", "v.message"))
    for name in dict.fromkeys(r.table for r in known if isinstance(r, Unique)):
        out.append(_repeated(tables[name], [r for r in known if r.table == name and isinstance(r, Unique)]))
    parents = dict.fromkeys((r.table, r.other, r.other_column, r.other_where) for r in known if isinstance(r, Exists))
    for place in parents:
        own = [r for r in known if isinstance(r, Exists) and (r.table, r.other, r.other_column, r.other_where) == place]
        out.append(_orphans(tables[place[0]], tables[place[1]].filter(place[3]).select(F.col(place[2]).cast("string").alias("parent_key")), own))
    return reduce(DataFrame.unionByName, out)


def as_sql(prefix: str, tables: list[str], rules: list = RULES) -> str:
    """The rules as one SQL query over tables named with ``prefix``."""
    out, known = [], [r for r in rules if r.table in tables and getattr(r, "other", r.table) in tables]
    for r in known:
        key = "concat_ws('|', " + ", ".join(f"coalesce(cast({c} as string), '')" for c in r.columns) + ")" if isinstance(r, Unique) else f"cast({r.key} as string)"
        rest = {
            Row: lambda r: f"where {r.condition}",
            Unique: lambda r: f"where {r.where} group by {', '.join(r.columns)} having count(*) > 1",
            Exists: lambda r: f"where ({r.where}) and not exists (select 1 from {prefix}{r.other} p where {r.other_where} and cast(p.{r.other_column} as string) = cast(c.{r.column} as string))",
        }[type(r)](r)
        out.append(f"select '{r.rule}' as rule_id, '{r.table}' as table_name, {key} as key, '{r.message}' as message from {prefix}{r.table} c {rest}")
    return "\nunion all ".join(out)
