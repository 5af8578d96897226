"""Sections of paged documents, page selection, chunk tables and their audit.

Pages are rows (doc, page, text). Rules are data, so that other layouts can be
given; the defaults are fixed values of prospectus pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import relational as R

# Headings on compacted text, in order; how many pages a section may go on; which sections a document must have.
HEADINGS = [
    ("investment_objective", r"(?:^|[^0-9])7\.?(?:집합투자기구의)?투자목적"),
    ("investment_target", r"(?:^|[^0-9])8\.?(?:집합투자기구의)?투자대상"),
    ("investment_strategy", r"(?:^|[^0-9])9\.?(?:집합투자기구의)?투자전략"),
    ("risk", r"(?:^|[^0-9])10\.?(?:집합투자기구의)?투자위험"),
    ("purchase_redemption", r"(?:^|[^0-9])11\.?매입,환매(?:,전환)?(?:절차및기준가격적용기준|기준|및전환기준)?"),
    ("pricing", r"(?:^|[^0-9])12\.?기준가격"),
    ("fees", r"(?:^|[^0-9])13\.?보수및수수료"),
    ("tax_distribution", r"(?:^|[^0-9])14\.?이익분배및과세에관한사항"),
]
SPANS = {"investment_objective": 8, "investment_target": 15, "investment_strategy": 15, "risk": 16, "purchase_redemption": 10, "pricing": 5, "fees": 12, "tax_distribution": 8}
CROSS_REFERENCE = {"purchase_redemption": (18, "제[0-9]부의|아래|상기|참조")}
CORE = ["investment_strategy", "risk", "fees"]
CONTENTS = "목차제1부|투자결정시유의사항안내"
# Phrases that name a page's section whatever is carried: (section, pattern, carried sections it holds in, carried sections it doesn't hold in).
PHRASES = [
    ("risk", r"10\.?(?:집합투자기구의)?투자위험", None, []),
    ("investment_strategy", "주요투자전략및위험관리", None, []),
    ("performance", "집합투자기구의투자실적추이|연평균수익률|연도별수익률|투자실적추이", None, []),
    ("asset_composition", r"집합투자기구(?:의)?자산구성현황|집합투자기구(?:의)?자산구성내역|자산구성현황\(단위", None, []),
    ("fees", "집합투자기구에부과되는보수및비용|수수료및보수비용의투자기간별예시|성과연동운용보수율산정", None, []),
    ("risk", "세부구분투자위험주요내용|투자원본손실위험|일반위험.*특수위험", ["risk", "investment_strategy"], []),
    ("investment_strategy", "투자전략(?:및위험관리|,위험관리|및수익구조)|주요투자전략|위험관리방법", ["investment_target", "investment_strategy"], []),
    ("purchase_redemption", "매입,환매,전환기준|매입및환매절차|환매수수료", None, ["fees", "tax_distribution"]),
    ("tax_distribution", "이익분배및과세에관한사항|집합투자기구의과세|수익자에대한과세", None, []),
]


def heading(text: Column, rules=HEADINGS, not_after=CROSS_REFERENCE) -> Column:
    """The section whose first heading stands last in ``text``; null without one, or for a null text.

    ``not_after`` gives for a section a width and a pattern: a heading with the
    pattern in so many characters before it only refers to the section.
    """
    found = []
    for k, (name, pattern) in enumerate(rules):
        at = F.regexp_instr(text, F.lit(pattern))
        ok = at > 0
        if name in not_after:
            width, refers = not_after[name]
            start = F.greatest(at - width, F.lit(1))
            ok = ok & ~F.substring(text, start, at - start).rlike(refers)
        found.append(F.when(ok, F.struct(at.alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name"))))
    return F.array_max(F.array(*found))["name"]


def page_section(text: Column, carried: Column, phrases=PHRASES) -> Column:
    """The section of one page: that of the first phrase that holds, else the carried one."""
    out = F
    for name, pattern, within, without in phrases:
        hit = text.rlike(pattern)
        if within is not None:
            hit = hit & (carried.isNull() | carried.isin(within))
        if without:
            hit = hit & (carried.isNull() | ~carried.isin(without))
        out = out.when(hit, F.lit(name))
    return out.otherwise(carried)


def sections(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", reset: str = r"제[345]부") -> DataFrame:
    """The pages with ``section``: headings carried on over their span, a new part ending them, phrases of a page coming first."""
    flat = pages.withColumn("__flat", T.compact(F.col(text))).withColumn("__head", heading(F.col("__flat")))
    out = R.carry_forward(flat, doc, page, F.col("__head").isNotNull(), F.col("__head"), SPANS, F.col("__flat").rlike(reset))
    return out.withColumn("section", page_section(F.col("__flat"), F.col("state"))).drop("__flat", "__head", "state")


def worth_keeping(section: Column, text: Column, least: int = 80, short: int = 800, contents: str = CONTENTS) -> Column:
    """Pages of a known section that are neither nearly empty nor a short table of contents."""
    listing = (F.length(text) < short) & T.compact(text).rlike(contents)
    return F.coalesce(section.isNotNull() & (F.length(text) >= least) & ~listing, F.lit(False))


def chunk_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", limit: int = 2200, overlap: int = 180) -> DataFrame:
    """(doc, page, section, part, chunk, chunk_hash) of the kept pages; equal chunks of one page and section once."""
    kept = sections(pages.withColumn(text, T.clean(F.col(text))), doc, page, text).filter(worth_keeping(F.col("section"), F.col(text)))
    parts = kept.select(doc, page, "section", F.posexplode(T.chunks(F.col(text), limit, overlap)).alias("part", "chunk"))
    return R.keep_first(parts.withColumn("chunk_hash", F.sha2("chunk", 256)), [doc, page, "section", "chunk_hash"], ["part"])


def dated_list(rows: DataFrame, group: str, order: str, name: Column, code: Column, date: Column, status: Column, sources: Column, labels: dict[str, str]) -> DataFrame:
    """One text per group: "name(code): date or label" of its rows with a status in order, and the pages named as [p.n] in their sources; no row for a group without a date."""
    label = F.coalesce(*[F.when(status == k, v) for k, v in labels.items()], status)
    item = F.struct(F.col(order), F.concat(name, F.lit("("), code, F.lit("): "), F.coalesce(date, label)).alias("s"), F.regexp_extract_all(sources, F.lit(r"\[p\.(\d+)\]"), F.lit(1)).alias("p"))
    got = rows.filter(status.isNotNull()).groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("x"), F.count(date).alias("dated")).filter("dated > 0")
    return got.select(group, F.array_join(F.col("x.s"), "; ").alias("text"), F.array_join(F.array_distinct(F.flatten("x.p")), "|").alias("pages"))


def issue_chunks(issues: DataFrame, parts: list[str]) -> DataFrame:
    """One chunk per issue: its fields in one text; the issue's status is the chunk's quality."""
    body = F.concat_ws(" ", *[F.when(T.blank_to_null(F.col(c)).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c))) for c in parts])
    return issues.select("issue_id", F.col("status").alias("issue_status"), F.col("status").alias("quality_status"), body.alias("chunk"), F.sha2(body, 256).alias("chunk_hash"))


def chunk_audit(docs: DataFrame, chunks: DataFrame, doc: str, section: str, text: str, core: list[str]) -> DataFrame:
    """(metric, value) of a chunk table: documents, chunks, empty chunks, repeats within and across documents, documents without chunks or without a core section."""
    h = chunks.withColumn("__h", F.sha2(F.col(text), 256))
    own = h.groupBy("__h", doc).agg(F.count("*").alias("n"))
    groups = own.groupBy("__h").agg(F.count("*").alias("docs"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("within"))
    repeats = groups.agg(F.coalesce(F.sum("within"), F.lit(0)).alias("within_document_duplicates"), F.count(F.when(F.col("docs") > 1, 1)).alias("cross_document_duplicates"))
    sizes = chunks.agg(F.count("*").alias("chunks"), F.count(F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 1)).alias("empty_chunks"))
    has = chunks.groupBy(doc).agg(*[F.max(F.when(F.col(section) == s, 1).otherwise(0)).alias(f"__{s}") for s in core])
    whole = sum((F.coalesce(F.col(f"__{s}"), F.lit(0)) for s in core), F.lit(0)) == len(core)
    cover = docs.select(doc).distinct().join(has.withColumn("__any", F.lit(1)), doc, "left").agg(F.count("*").alias("documents"), F.count(F.when(F.col("__any").isNull(), 1)).alias("without_chunks"), F.count(F.when(~whole, 1)).alias("missing_core_sections"))
    long = lambda d: d.select([F.col(c).cast("long") for c in d.columns]).unpivot([], d.columns, "metric", "value")
    return long(sizes).union(long(repeats)).union(long(cover))


def scan_audit(pages: DataFrame, doc: str, page: str, text: str, fields: dict[str, str], tags: dict[str, str]) -> DataFrame:
    """Per document its pages, fields found on its first page, pages that each tag's pattern hits, and the hash of all its text."""
    first = F.min_by(text, page)
    hits = [F.sort_array(F.collect_set(F.when(F.col(text).rlike(p), F.col(page)))).alias(f"{n}_pages") for n, p in tags.items()]
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, text))), lambda x: x[text]), "\n")
    out = pages.groupBy(doc).agg(F.count("*").alias("total_pages"), first.alias("__first"), F.sha2(body, 256).alias("sha256"), *hits)
    return out.withColumns({n: T.first_match(F.col("__first"), p) for n, p in fields.items()}).drop("__first")


def duplicate_groups(audit: DataFrame, doc: str, *keys: str) -> DataFrame:
    """(group_key, members) of documents that share the first key that isn't null."""
    return audit.groupBy(F.coalesce(*keys).alias("group_key")).agg(F.sort_array(F.collect_list(doc)).alias("members")).filter(F.size("members") > 1)


def history(pages: DataFrame, doc: str, page: str, text: str, where: str, date: str) -> DataFrame:
    """(doc, date, page, earliest) of all dates on the pages that match ``where``; of a date on several pages the last page."""
    found = pages.filter(F.col(text).rlike(where)).select(doc, page, F.explode(F.regexp_extract_all(text, F.lit(date), F.lit(0))).alias("raw"))
    dates = found.groupBy(doc, T.iso_date(F.col("raw")).alias("date")).agg(F.max(page).alias("page")).filter("date is not null")
    return dates.withColumn("earliest", F.min("date").over(Window.partitionBy(doc)) == F.col("date"))
