"""Tables read out of page text and positioned cells, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as T

# The periods of a row of returns, and the order of fees in a row of fees.
PERIODS = ["1Y", "2Y", "3Y", "5Y", "SINCE_INCEPTION"]
FEES = ["management_fee", "sales_fee", "trust_fee", "admin_fee", "total_fee"]
NUMBER = r"^(-?\d+(\.\d+)?|-)$"


def segments(df: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """(key, pos, label, segment, at): what stands between each marker and the next; group 1 of ``marker`` is the label, ``at`` its offset. One row of ``df`` per key."""
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(marker), F.lit(1)).alias("label"),
        F.regexp_extract_all(text, F.lit(marker), F.lit(0)).alias("mark"),
        F.slice(F.split(text, marker, -1), F.lit(2), F.size(F.split(text, marker, -1))).alias("segment"),
    )
    rows = df.select(key, F.length(F.split(text, marker, 2)[0]).alias("__lead"), F.posexplode(zipped).alias("pos", "z")).select(key, "__lead", "pos", "z.*")
    before = F.sum(F.length("mark") + F.length("segment")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(key, "pos", "label", "segment", (F.col("__lead") + F.coalesce(before, F.lit(0))).alias("at"))


def page_span(pages: DataFrame, doc: str, page: str, text: str, begin: list[str], head: str, stop: str) -> DataFrame:
    """(doc, body, starts): the pages from the first that all of ``begin`` match up to the first ``stop``, as one text, cut at ``head`` and ``stop``; ``starts`` holds each page's offset."""
    hit = F.lit(True)
    for p in begin:
        hit = hit & F.col(text).rlike(p)
    every, so_far = Window.partitionBy(doc), Window.partitionBy(doc).orderBy(page)
    rows = pages.withColumn("__start", F.min(F.when(hit, F.col(page))).over(every)).filter(F.col(page) >= F.col("__start"))
    cut = F.regexp_instr(F.col(text), F.lit(head))
    rows = rows.withColumn("__t", F.when((F.col(page) == F.col("__start")) & (cut > 0), F.expr(f"substring(`{text}`, regexp_instr(`{text}`, '{_quoted(head)}'))")).otherwise(F.col(text)))
    rows = rows.withColumn("__end", F.min(F.when(F.col("__t").rlike(stop), F.col(page))).over(every)).filter(F.col("__end").isNull() | (F.col(page) <= F.col("__end")))
    rows = rows.withColumn("__t", F.concat(F.lit(" "), F.split(F.col("__t"), stop, 2)[0]))
    rows = rows.withColumn("__at", F.sum(F.length("__t")).over(so_far) - F.length("__t"))
    got = rows.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col("__at").alias("at"), F.col(page).alias("page"), F.col("__t").alias("t")))).alias("x"))
    return got.select(doc, F.array_join("x.t", "").alias("body"), F.transform("x", lambda s: F.struct(s["at"].alias("at"), s["page"].alias("page"))).alias("starts"))


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def eligibility(pages: DataFrame, doc: str, page: str, text: str, begin: list[str], head: str, stop: str, marker: str, date: str = r"(?:19|20)\d{2}[./-]\d{1,2}[./-]\d{1,2}") -> DataFrame:
    """(doc, label, date, status, page): per marked segment its first date; ESTABLISHED with one, else NOT_ESTABLISHED; the page is the one the marker stands on."""
    span = page_span(pages, doc, page, text, begin, head, stop)
    rows = segments(span, doc, "body", marker).join(span.select(doc, "starts"), doc)
    found = T.iso_date(T.first_match(F.col("segment"), date, 0))
    on = F.element_at(F.filter("starts", lambda s: s["at"] <= F.col("at")), -1)["page"]
    return rows.select(doc, "label", found.alias("date"), F.when(found.isNull(), "NOT_ESTABLISHED").otherwise("ESTABLISHED").alias("status"), on.alias("page"))


def resolve(classes: DataFrame, found: DataFrame, keys: list[str], floor: str | None = None) -> DataFrame:
    """``classes`` with date and status: none found, several that differ, or a date before column ``floor`` give REVIEW_REQUIRED without a date."""
    one = found.groupBy(*keys).agg(F.count_distinct(F.struct("date", "status")).alias("__n"), F.min("date").alias("__d"), F.min("status").alias("__s"))
    out = classes.join(one, keys, "left")
    bad = F.col("__n").isNull() | (F.col("__n") > 1)
    if floor:
        bad = bad | F.coalesce(F.col("__d") < F.col(floor), F.lit(False))
    status = F.when(bad, "REVIEW_REQUIRED").otherwise(F.col("__s"))
    return out.withColumn("status", status).withColumn("date", F.when(F.col("status") == "ESTABLISHED", F.col("__d"))).drop("__n", "__d", "__s")


def dates_by_row(rows: DataFrame, keys: list[str], date: str, footnote: Column) -> DataFrame:
    """Per key one distinct date: ESTABLISHED; several: REVIEW_REQUIRED; none: NOT_ESTABLISHED if a footnote says so, else REVIEW_REQUIRED."""
    got = rows.groupBy(*keys).agg(F.count_distinct(date).alias("__n"), F.min(date).alias("__d"), F.bool_or(footnote).alias("__f"))
    status = F.when(F.col("__n") == 1, "ESTABLISHED").when((F.col("__n") == 0) & F.col("__f"), "NOT_ESTABLISHED").otherwise("REVIEW_REQUIRED")
    return got.select(*keys, status.alias("status"), F.when(F.col("__n") == 1, F.col("__d")).alias("date"))


def fee_row(segment: Column) -> Column:
    """A struct of the fees in FEES and the expense ratio from a segment of seven or more numbers ("-" is 0 as a fee, the total as expense); ``bad`` where the parts miss the total by over 0.001 or the expense is below it, the values being null then. Null for fewer numbers."""
    n = F.filter(F.split(segment, r"\s+"), lambda x: x.rlike(NUMBER))
    v = [F.when(F.get(n, F.lit(k)) == "-", 0.0).otherwise(F.get(n, F.lit(k)).try_cast("double")) for k in range(5)]
    expense = F.when(F.get(n, F.lit(6)) == "-", v[4]).otherwise(F.get(n, F.lit(6)).try_cast("double"))
    bad = (F.abs(F.round(v[0] + v[1] + v[2] + v[3], 4) - v[4]) > 0.001) | (expense < v[4])
    return F.when(F.size(n) >= 7, F.struct(*[F.when(~bad, x).alias(c) for c, x in zip([*FEES, "total_expense_ratio"], [*v, expense], strict=True)], bad.alias("bad")))


def total_value(text: Column, word: str, place: int = 12) -> Column:
    """The number in the given place of the line that starts with ``word``, as a long; null without it or for "-"."""
    raw = T.first_match(text, rf"{word}\s+(?:[-\d,]+\s+){{{place - 1}}}([-\d,]+)")
    return F.replace(F.nullif(raw, F.lit("-")), F.lit(","), F.lit("")).try_cast("long")


def table_events(lines: DataFrame, classes: DataFrame, doc: str, skip: str = "수익률 변동성", benchmark: str = "비교지수", fund: str = "운용") -> tuple[DataFrame, DataFrame]:
    """Returns from positioned lines (doc, page, line, cells array<struct<x, text>>): (values, issues).

    A line with an ISO date and five or more numbers right of it is an event.
    Its label is all text left of the date from after the event before it to
    before the next one. Its class is the longest name in ``classes`` (doc,
    class_name) that ends the label. Lines with ``skip`` give nothing; those
    with ``benchmark`` fill in the class before them, the last one counting. A
    label without a class is the fund's own if it says ``fund`` or nothing
    came before it in the document; others are issues. Dashes give no row.
    """
    text = F.array_join(F.col("cells.text"), " ")
    rows = lines.withColumn("__d", F.try_element_at(F.filter("cells", lambda c: F.trim(c["text"]).rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(1)))
    values = F.slice(F.transform(F.filter("cells", lambda c: (c["x"] > F.col("__d.x")) & F.trim(c["text"]).rlike(NUMBER)), lambda c: F.trim(c["text"])), 1, 5)
    rows = rows.withColumn("__v", values).withColumn("__e", F.coalesce(F.size("__v") >= 5, F.lit(False)) & F.col("__d").isNotNull())
    inside = Window.partitionBy(doc, "page").orderBy("line")
    rows = rows.withColumn("__s", F.sum(F.col("__e").cast("int")).over(inside))
    when = lambda c: F.when(F.col("__e"), c)
    after = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(~F.col("__e"), F.struct("line", "cells")))), lambda r: r["cells"]))
    spans = rows.groupBy(doc, "page", "__s").agg(F.max(when(F.col("line"))).alias("line"), F.first(when(F.col("cells")), True).alias("own"), F.first(when(F.col("__d.x")), True).alias("x"), F.first(when(F.col("__v")), True).alias("v"), F.first(when(text), True).alias("line_text"), after.alias("after"))
    before = F.lag("after").over(Window.partitionBy(doc, "page").orderBy("__s"))
    left = F.filter(F.concat(F.coalesce(before, F.slice("after", 1, 0)), "own", "after"), lambda c: c["x"] < F.col("x"))
    events = spans.withColumn("label", left).filter("__s > 0").withColumn("label", F.trim(F.regexp_replace(F.array_join(F.col("label.text"), " "), T.WS + "+", " ")))
    names = classes.groupBy(doc).agg(F.collect_set("class_name").alias("names"))
    tail = F.element_at(F.split(T.compact(F.col("label")), r"\)", -1), -1)
    events = events.join(names, doc, "left").withColumn("__tail", tail)
    events = events.withColumn("class_name", F.array_max(F.transform(F.filter("names", lambda n: F.endswith(F.col("__tail"), n)), lambda n: F.struct(F.length(n).alias("n"), n.alias("name"))))["name"])
    kind = F.when(F.contains("line_text", F.lit(skip)), "skip").when(F.contains("line_text", F.lit(benchmark)), "benchmark").otherwise("class")
    events = events.withColumn("kind", kind).filter("kind <> 'skip'")
    order = Window.partitionBy(doc).orderBy("page", "line")
    gave = ((F.col("kind") == "class") & F.exists("v", lambda x: x != "-")).cast("int")
    events = events.withColumn("__gave", F.coalesce(F.sum(gave).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    known = F.col("class_name").isNotNull() | F.col("label").rlike(fund) | (F.col("__gave") == 0)
    events = events.withColumn("known", known).withColumn("at", F.sum((F.col("kind") == "class").cast("int")).over(order))
    bench = events.filter("kind = 'benchmark'").groupBy(doc, "at").agg(F.max_by("v", F.struct("page", "line")).alias("b"))
    own = events.filter("kind = 'class'")
    out = own.filter("known").join(bench, [doc, "at"], "left").select(doc, "page", "label", "class_name", F.posexplode("v").alias("k", "value"), "b").filter("value <> '-'")
    number = lambda c: F.nullif(c, F.lit("-")).cast("double")
    found = out.select(doc, "page", "label", "class_name", F.get(F.array(*map(F.lit, PERIODS)), F.col("k")).alias("period"), number(F.col("value")).alias("return_pct"), number(F.get("b", F.col("k"))).alias("benchmark_return_pct"))
    return found, own.filter("not known").select(doc, "page", "label")


def fee_phases(df: DataFrame, keys: list[str], base: str, others: list[str], low: float = 0.0, high: float = 1.6) -> DataFrame:
    """Two phases per row: one at the fixed rate, one by formula within bounds; totals are the fixed other fees and the management fee."""
    rest = sum((F.coalesce(c, F.lit(0.0)) for c in others), F.lit(0.0))
    none = F.lit(None).cast("double")
    phase = lambda name, rate, m, lo, hi: F.struct(F.lit(name).alias("period_type"), F.lit(rate).alias("rate_type"), m.alias("management_fee"), F.round(rest + m, 6).alias("total_fee"), F.round(rest + lo, 6).alias("min_total_fee"), F.round(rest + hi, 6).alias("max_total_fee"))
    both = F.array(phase("INITIAL_FIXED_RATE", "FIXED", F.col(base), F.col(base), F.col(base)), phase("PERFORMANCE_LINKED_RATE", "FORMULA", none, F.lit(low), F.lit(high)))
    return df.select(*keys, F.explode(both).alias("p")).select(*keys, "p.*")


def formula_fee(base: Column, gain: Column, against: Column, by: float = 0.1, low: float = 0.0, high: float = 1.6) -> Column:
    """base + (gain - against) * by, kept within bounds."""
    return T.clamp(base + (gain - against) * by, F.lit(low), F.lit(high))
