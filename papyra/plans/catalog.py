"""The catalog's tables made from the driver's tables, and queries over them.

The model is plain SQL that Spark and DuckDB both read, so a query and its SQL
counterpart start from the same rows. Some rows break each kind of rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import audit as A
from papyra.operators import evidence as E
from papyra.operators import relational as R
from papyra.operators import validation as V

_DAY = "cast(cast(o_orderdate as date) as string)"
MODEL = {
    "documents": f"""select case when o_orderkey % 5000 = 0 then 1 else o_orderkey end as doc_id, case when o_custkey % 10 = 0 then o_custkey + 1 else o_custkey end as fund_id, case when o_orderkey % 311 = 0 then substr({_DAY}, 1, 7) else {_DAY} end as document_date,
        case when o_orderkey % 401 = 0 then null else {_DAY} end as effective_date, o_orderkey % 60 as total_pages, o_orderpriority as source_file from orders""",
    "funds": """select case when c_custkey % 70 = 1 then 2 else c_custkey end as fund_id, c_custkey * 9 as source_doc_id, c_custkey % 8 as risk_grade, 1 as source_page, case when c_custkey % 77 = 0 then '' else c_name end as source_text,
        case c_custkey % 5 when 0 then 'NOT_ESTABLISHED' when 1 then 'NOT_DISCLOSED' when 2 then 'REVIEWED' else 'ESTABLISHED' end as inception_status,
        case when c_custkey % 5 >= 3 and c_custkey % 7 > 0 then '1995-06-17' when c_custkey % 45 = 0 then '1996-01-01' end as inception_date,
        case when c_custkey % 50 = 0 then '1996-13' end as inception_scheduled_date from customer where c_custkey % 40 <> 3""",
    "classes": """select l_orderkey * 8 + l_linenumber as class_id, l_orderkey % 1700 as fund_id, concat(cast(l_orderkey as string), case when l_linenumber = 7 then '6' else cast(l_linenumber as string) end) as class_name_normalized,
        cast(l_discount as double) as management_fee, cast(l_tax as double) as sales_fee, case when l_orderkey % 901 = 0 then -0.01 else 0.01 end + 0e0 as trust_fee, 0.02e0 as admin_fee,
        case when l_orderkey % 13 = 0 then null else round(cast(l_discount as double) + l_tax + 0.03e0 + case when l_orderkey % 97 = 0 then 0.5e0 else 0e0 end, 4) end as total_fee,
        case when l_orderkey % 11 = 0 then 0.03e0 else 0.9e0 end as total_expense_ratio, l_orderkey as source_doc_id, l_linenumber as source_page, case when l_orderkey % 333 = 0 then '' else l_returnflag end as source_text,
        case l_linenumber when 1 then 'ESTABLISHED' when 2 then 'NOT_DISCLOSED' when 3 then 'UNKNOWN' when 4 then null else 'ESTABLISHED' end as class_inception_status,
        case when l_linenumber = 1 then '1995-01-01' when l_linenumber = 2 and l_orderkey % 50 = 0 then '1996-02-03' when l_linenumber = 5 then '1996-02-03' end as class_inception_date from lineitem""",
    "schedules": """select l_orderkey * 8 + l_linenumber as fee_schedule_id, l_orderkey % 1700 as fund_id, l_orderkey * 8 + l_linenumber + case when l_orderkey % 71 = 0 then 1 else 0 end as class_id, l_orderkey as source_doc_id,
        case when l_linenumber % 2 = 0 then 'INITIAL_FIXED_RATE' else 'PERFORMANCE_LINKED_RATE' end as period_type, case when l_linenumber % 2 = 0 then 'FIXED' else 'FORMULA' end as rate_type,
        case when l_orderkey % 19 = 0 then '' else 'base plus excess' end as formula, cast(l_discount as double) as management_fee, cast(l_tax as double) as sales_fee, 0.01e0 as trust_fee, 0.02e0 as admin_fee,
        0e0 as min_management_fee, 1.6e0 as max_management_fee, round(l_tax + 0.03e0 + case when l_orderkey % 37 = 0 then 0.2e0 else 0e0 end, 4) as min_total_fee, round(l_tax + 1.63e0 + case when l_orderkey % 23 = 0 then 0.1e0 else 0e0 end, 4) as max_total_fee,
        round(cast(l_discount as double) + l_tax + case when l_orderkey % 29 = 0 then 0.1e0 else 0.03e0 end, 4) as total_fee, case when l_orderkey % 31 = 0 then 0e0 else 2e0 end as total_expense_ratio from lineitem where l_linenumber <= 2""",
    "performance": """select l_orderkey * 8 + l_linenumber as performance_id, l_orderkey % 1700 as fund_id, case when l_linenumber = 7 then null else l_orderkey * 8 + case when l_linenumber = 6 then 5 else l_linenumber end end as class_id,
        concat(cast(l_orderkey as string), '|', cast(l_linenumber % 6 as string)) as class_or_fund, case l_linenumber when 1 then '1Y' when 2 then '2Y' when 3 then '10Y' else '5Y' end as period,
        cast(l_quantity as double) * 21 as return_pct, case when l_orderkey % 3 = 0 then null else 50e0 - l_quantity * 4 end as benchmark_return_pct,
        case when l_orderkey % 203 = 0 then '96.1.1' else '1996-01-01' end as as_of_date, l_orderkey as source_doc_id, case when l_orderkey % 41 = 0 then 0 else l_linenumber end as source_page, l_returnflag as source_text from lineitem""",
    "aum": "select s_suppkey * 16 as fund_id, cast(s_acctbal as double) as amount from supplier",
    "issues": """select case when p_partkey % 700 = 0 then 7 else p_partkey end as issue_id, p_partkey as fund_id, p_partkey as source_doc_id,
        case p_partkey % 6 when 0 then 'SUSPECTED_SOURCE_ERROR' when 1 then 'INTERNAL_CONFLICT' when 2 then 'RESOLVED_WITH_EVIDENCE' when 3 then 'REQUIRES_REVIEW' when 4 then 'CONFIRMED_SOURCE_ERROR' else 'OPEN' end as status,
        case p_partkey % 3 when 0 then 'CONFIRMED' when 1 then 'UNCONFIRMED' end as official_confirmation, p_size / 40e0 as confidence, 'total_fee' as affected_field, p_type as issue_type, 'HIGH' as severity,
        case when p_partkey % 90 = 0 then '' else p_brand end as source_value, p_size as source_page, 'keep' as handling_action, p_name as reason from part""",
    "links": """select p_partkey + case when p_partkey % 150 = 0 then 100000 else 0 end as issue_id, case p_partkey % 3 when 0 then 'classes' when 1 then 'documents' else 'funds' end as table_name,
        cast(p_partkey * 5 as string) as record_key, case when p_partkey % 80 = 0 then '' else 'total_fee' end as field_name, case when p_partkey % 4 = 0 then 'SOURCE_ONLY' else 'LOADED_RECORD' end as relation_type from part
        union all select p_partkey, 'funds', '1', 'name', 'LOADED_RECORD' from part where p_size = 3 union all select p_partkey, 'funds', '1', 'name', 'LOADED_RECORD' from part where p_size = 3 and p_partkey % 2 = 0""",
    "chunks": """select conv_id * 100 + turn as chunk_id, case when turn % 3 = 0 then conv_id end as issue_id, conv_id as source_doc_id, turn + 1 as source_page, case when turn % 6 = 3 then 'source_quality_issue' else role end as section, case when turn = 4 then '' else text end as source_text from conversations""",
}
_FROM = {"documents": ["orders"], "funds": ["customer"], "classes": ["lineitem"], "schedules": ["lineitem"], "performance": ["lineitem"], "aum": ["supplier"], "issues": ["part"], "links": ["part"], "chunks": ["conversations"]}
#: The fund's date stands in the class's row before rules read it.
_DATED = "select c.*, f.inception_date as fund_inception_date from {0} c left join (select fund_id as dated_fund, min(inception_date) as inception_date from {1} group by fund_id) f on f.dated_fund = c.fund_id"

_Q: dict = {}
_SQL: dict[str, str] = {}


def model(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        source = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in _FROM[name]}
        sql = MODEL[name]
        for t in source:
            sql = sql.replace(f"from {t}", f"from {{{t}}}")
        out[name] = spark.sql(sql, **source)
    return out


def dated(classes: DataFrame, funds: DataFrame) -> DataFrame:
    dates = funds.groupBy(F.col("fund_id").alias("dated_fund")).agg(F.min("inception_date").alias("fund_inception_date"))
    return classes.join(dates, F.col("fund_id") == F.col("dated_fund"), "left").drop("dated_fund")


def _with(names) -> str:
    parts = [f"m_{n} as ({MODEL[n]})" if n != "classes" else f"m_classes_ as ({MODEL[n]})" for n in names]
    if "classes" in names:
        parts.append("m_classes as (" + (_DATED.format("m_classes_", "m_funds") if "funds" in names else "select *, cast(null as string) as fund_inception_date from m_classes_") + ")")
    return "with " + ",\n".join(parts) + "\n"


def _group(title: str, of: list[str], needs: list[str]) -> None:
    """A query of all rules on the tables ``of``, and its SQL."""
    rules = [r for r in V.RULES if r.table in of]

    def run(spark, sf):
        tables = model(spark, sf, *of, *needs)
        if "classes" in tables:
            tables["classes"] = dated(tables["classes"], tables["funds"]) if "funds" in tables else tables["classes"].withColumn("fund_inception_date", F.lit(None).cast("string"))
        return V.violations(tables, rules)

    run.__name__, run.__doc__ = title, f"Rules of {', '.join(of)}."
    _Q[title], _SQL[title] = run, _with([*of, *needs]) + V.as_sql("m_", [*of, *needs], rules)


_group("rules_documents", ["documents"], ["funds", "chunks"])
_group("rules_funds", ["funds"], ["documents"])
_group("rules_classes", ["classes"], ["funds"])
_group("rules_schedules", ["schedules"], ["funds", "classes", "documents"])
_group("rules_performance", ["performance", "aum"], ["funds", "classes"])
_group("rules_issues", ["issues", "links", "chunks"], ["funds", "documents", "classes"])


def query(sql: str, *names: str):
    def add(f):
        _Q[f.__name__] = f
        _SQL[f.__name__] = (_with(names) if names else "") + sql
        return f

    return add


@query("""select f.fund_id, coalesce(d.document_date, 'NOT_DISCLOSED') as date, d.total_pages as page from m_funds f
left join (select doc_id, min(document_date) as document_date, min(total_pages) as total_pages from m_documents group by 1) d on d.doc_id = f.source_doc_id""", "funds", "documents")
def evidence_lookup(spark, sf):
    m = model(spark, sf, "funds", "documents")
    nested = m["documents"].groupBy("doc_id").agg(F.struct(F.min("document_date").alias("date"), F.min("total_pages").alias("page")).alias("evidence"))
    return E.nested_lookup(m["funds"], nested, "source_doc_id", "doc_id", "evidence", {"date": "NOT_DISCLOSED"}).select("fund_id", "date", "page")


@query("""select c.c_custkey, coalesce(o.v, n.n_name) as page, case when o.v is not null then 'hit' when n.n_name is not null then 'fallback' end as tier from customer c
left join (select o_custkey, min(o_orderpriority) as v from orders where o_orderstatus = 'F' group by 1) o on o.o_custkey = c.c_custkey left join nation n on n.n_nationkey = c.c_nationkey""")
def evidence_two_tier(spark, sf):
    r = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    first = r("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("value"))
    second = r("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("value"))
    return E.two_tier(r("customer"), first, "c_custkey", second, "c_nationkey", "page").select("c_custkey", "page", "tier")


@query("""select s.s_suppkey, case when s.s_nationkey < 5 then 'reviewed' else s.s_name end as s_name, case when s.s_nationkey < 5 then [1, 2, 9] else [1, 2] end as pages,
case when s.s_nationkey < 5 then concat(s.s_name, ' ', 'see page 9') else s.s_name end as note from supplier s""")
def override_with_pages(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_name", F.array(F.lit(1), F.lit(2)).alias("pages"), F.col("s_name").alias("note"))
    fixes = s.filter("s_nationkey < 5").select("s_suppkey", F.lit("reviewed").alias("s_name"), F.array(F.lit(9), F.lit(2)).alias("pages"), F.lit("see page 9").alias("note"))
    return E.override(s, fixes, ["s_suppkey"], replace=["s_name"], union=["pages"], append=["note"]).select("s_suppkey", "s_name", "pages", "note")


@query("select c.c_custkey, n.n_nationkey as id from customer c join nation n on n.n_nationkey = c.c_nationkey")
def name_to_id(spark, sf):
    c, n = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    named = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"))
    return E.strict(named, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")), ["name"], "id").select("c_custkey", "id")


@query("""with f as (select page_id, regexp_extract(url, '([^/]+)$', 1) as file from pages), s as (select distinct regexp_extract(url, '([^/]+)$', 1) as file from pages where page_id % 3 = 0)
select page_id, file from f where file <> '' and file not in (select file from s)""")
def unlisted_files(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    listed = E.names_in(p.filter("page_id % 3 = 0"), "url", "([^/]+)$")
    return p.select("page_id", F.regexp_extract("url", "([^/]+)$", 1).alias("file")).filter("file <> ''").join(listed, F.col("file") == F.col("name"), "left_anti")


@query("""select row_number() over (order by ordinal, doc, page, part) as seq, concat('CHUNK', case when row_number() over (order by ordinal, doc, page, part) < 1000000 then lpad(cast(row_number() over (order by ordinal, doc, page, part) as string), 6, '0') else cast(row_number() over (order by ordinal, doc, page, part) as string) end) as chunk_id, kind, doc, page, part, sha256(body) as chunk_hash, length(body) as chars
from (select 0 as ordinal, 'page' as kind, conv_id as doc, turn as page, 1 as part, text as body from conversations where text is not null
union all select 1, 'inception', o_custkey, null, 1, concat('Inception ', min(cast(cast(o_orderdate as date) as string))) from orders where o_orderstatus = 'F' group by o_custkey
union all select 2, 'issue', p_partkey, p_size, 1, concat(p_type, ': ', p_name) from part where p_size < 5)""")
def chunk_table(spark, sf):
    r = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    page = r("conversations").filter("text is not null").select(F.lit("page").alias("kind"), F.col("conv_id").cast("long").alias("doc"), F.col("turn").cast("long").alias("page"), F.col("text").alias("body"))
    born = r("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("long").alias("doc")).agg(F.concat(F.lit("Inception "), F.min(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("body")).withColumn("kind", F.lit("inception"))
    issue = r("part").filter("p_size < 5").select(F.lit("issue").alias("kind"), F.col("p_partkey").cast("long").alias("doc"), F.col("p_size").cast("long").alias("page"), F.concat_ws(": ", "p_type", "p_name").alias("body"))
    return E.chunk_table([page, born, issue], "CHUNK").select("seq", "chunk_id", "kind", "doc", "page", "part", "chunk_hash", F.length("body").cast("long").alias("chars"))


@query("""select doc, concat('{', string_agg(concat('"', section, '":', cast(n as string)), ',' order by section), '}') as sections from (select conv_id as doc, role as section, count(*) as n from conversations group by 1, 2) group by 1""")
def section_counts(spark, sf):
    counted = E.count_map(spark.read.parquet(f"{sf}/conversations.parquet").withColumnRenamed("conv_id", "doc"), "doc", "role", "sections")
    return counted.withColumn("sections", F.to_json("sections"))


@query("select conv_id, list_filter(['system', 'user', 'assistant'], lambda x: not list_contains(list(role), x)) as missing from conversations group by 1")
def missing_core(spark, sf):
    return E.missing_of(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", "role", ["system", "user", "assistant"])


@query("""select l_orderkey, l_linenumber, floor(abs(l_extendedprice) * 100 + 0.5) >= 0 as finite, l_quantity = floor(l_quantity) as whole, regexp_replace(l_comment_, 'fee [0-9]+', '', 'g') as cleaned, concat('20', lpad(cast(l_linenumber as string), 2, '0'), '-01-05') as as_of
from (select *, concat('a fee ', cast(l_linenumber as string), ' b') as l_comment_ from lineitem)""")
def scalar_checks(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    note = F.concat(F.lit("a fee "), F.col("l_linenumber").cast("string"), F.lit(" b"))
    short = F.concat(F.lit("as of "), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(". 1. 5"))
    return x.select("l_orderkey", "l_linenumber", T.is_finite(F.col("l_extendedprice")).alias("finite"), T.is_integer(F.col("l_quantity")).alias("whole"), F.regexp_replace(note, "fee [0-9]+", "").alias("cleaned"), T.short_year(short, F.lit(None)).alias("as_of"))


@query("""select c.class_id, date_diff('month', cast('1996-02-03' as date), date '1998-02-03') / 12 as years from m_classes c where c.class_inception_status = 'ESTABLISHED' and c.class_inception_date = '1996-02-03'""", "funds", "classes")
def track_record(spark, sf):
    """Q23: years since inception of established classes."""
    c = model(spark, sf, "classes")["classes"].filter("class_inception_status = 'ESTABLISHED' and class_inception_date = '1996-02-03'")
    return c.select("class_id", T.years_between(F.col("class_inception_date"), F.lit("1998-02-03")).alias("years"))


@query("""select l.record_key, l.table_name, i.issue_id, i.status from m_links l join m_issues i on i.issue_id = l.issue_id where i.status <> 'OPEN'""", "issues", "links")
def source_quality(spark, sf):
    """Q27: the issues of each loaded record."""
    m = model(spark, sf, "issues", "links")
    return m["links"].join(m["issues"].filter("status <> 'OPEN'"), "issue_id").select("record_key", "table_name", "issue_id", "status")


@query("""select c.class_id, coalesce(s.total_fee, c.total_fee) as total_fee, s.class_id is not null as scheduled from m_classes c left join (select class_id, max(total_fee) as total_fee from m_schedules group by 1) s on s.class_id = c.class_id""", "funds", "classes", "schedules")
def fees(spark, sf):
    """Q3: a class's fee, that of its schedule before its own."""
    m = model(spark, sf, "classes", "schedules")
    s = m["schedules"].groupBy("class_id").agg(F.max("total_fee").alias("of_schedule"), F.lit(True).alias("scheduled"))
    return m["classes"].join(s, "class_id", "left").select("class_id", F.coalesce("of_schedule", "total_fee").alias("total_fee"), F.coalesce("scheduled", F.lit(False)).alias("scheduled"))


@query("""select p.performance_id, p.period, p.return_pct, c.class_name_normalized as class_name from m_performance p left join m_classes c on c.class_id = p.class_id where p.period in ('1Y', '2Y') and p.as_of_date = '1996-01-01' and p.return_pct > 500""", "funds", "classes", "performance")
def returns(spark, sf):
    """Q2 and Q13: returns by period and date above a bound, with the class."""
    m = model(spark, sf, "classes", "performance")
    p = m["performance"].filter(F.col("period").isin("1Y", "2Y") & (F.col("as_of_date") == "1996-01-01") & (F.col("return_pct") > 500))
    return p.join(m["classes"].select("class_id", F.col("class_name_normalized").alias("class_name")), "class_id", "left").select("performance_id", "period", "return_pct", "class_name")


@query("""select chunk_id, source_page, section from m_chunks where section = 'assistant' and regexp_matches(source_text, '[0-9]')""", "chunks")
def cited_chunks(spark, sf):
    """Q18, Q25 and Q26: chunks of a section by pattern, with the page to cite."""
    return model(spark, sf, "chunks")["chunks"].filter((F.col("section") == "assistant") & F.col("source_text").rlike("[0-9]")).select("chunk_id", "source_page", "section")


@query("""select fund_id, risk_grade, case when inception_scheduled_date is null then null else inception_scheduled_date > '1996' end as late from m_funds where risk_grade between 1 and 3 and inception_status = 'ESTABLISHED'""", "funds")
def fund_filter(spark, sf):
    """Q1, Q5 and Q24: funds by grade and status; unknown stays unknown."""
    f = model(spark, sf, "funds")["funds"].filter("risk_grade between 1 and 3 and inception_status = 'ESTABLISHED'")
    return f.select("fund_id", "risk_grade", (F.col("inception_scheduled_date") > "1996").alias("late"))


_CORE = ["system", "user", "assistant"]
_FACTS = """b as (select *, coalesce(trim(cast(source_text as string)), '') = '' as e, coalesce(trim(cast(source_text as string)), '') = '' or source_page is null or source_doc_id is null as lost from m_chunks),
h as (select source_doc_id, sha256(source_text) as h, count(*) as n from b where not e group by 1, 2),
s as (select source_doc_id, min(case when k = 3 then 1 else 0 end) as whole from (select source_doc_id, count(distinct case when section in ('system', 'user', 'assistant') then section end) as k from m_chunks group by 1) group by 1),
f as (select 'documents_total' as metric, count(*) as value from m_documents union all select 'pages_total', cast(coalesce(sum(total_pages), 0) as bigint) from m_documents
union all select 'chunks_total', count(*) from m_chunks union all select 'empty_chunks', count(*) from b where e union all select 'missing_provenance_chunks', count(*) from b where lost
union all select 'source_issue_chunks', count(issue_id) from m_chunks union all select 'pages_selected', count(*) from (select distinct source_doc_id, source_page from m_chunks where source_doc_id is not null and source_page is not null)
union all select 'within_document_duplicate_hash_groups', count(*) from h where n > 1 union all select 'cross_document_duplicate_hash_groups', count(*) from (select h from h group by 1 having count(*) > 1)
union all select 'documents_chunked', count(*) from m_documents where doc_id in (select source_doc_id from s) union all select 'documents_without_chunks', count(*) from m_documents where doc_id not in (select source_doc_id from s where source_doc_id is not null)
union all select 'documents_missing_core_sections', count(*) from m_documents d join s on s.source_doc_id = d.doc_id where whole = 0)
"""


@query("," + _FACTS + "select metric, value from f", "documents", "chunks")
def chunk_facts(spark, sf):
    """All of a chunk table's audit figures."""
    m = model(spark, sf, "documents", "chunks")
    return A.chunk_facts(m["documents"], m["chunks"], _CORE)


@query("," + _FACTS + """select r.rule_id, r.metric, f.value, r.expected from (values ('V62', 'documents_total', (select count(*) from m_documents)), ('V63', 'documents_chunked', (select count(*) from m_documents)),
('V64', 'chunks_total', (select count(*) from m_chunks)), ('V65', 'source_issue_chunks', (select count(*) from m_issues)), ('V66', 'empty_chunks', 0), ('V67', 'missing_provenance_chunks', 0),
('V68', 'within_document_duplicate_hash_groups', 0), ('V69', 'documents_without_chunks', 0), ('V70', 'documents_missing_core_sections', 0)) r(rule_id, metric, expected)
join f on f.metric = r.metric where f.value <> r.expected""", "documents", "chunks", "issues")
def rules_audit(spark, sf):
    """V62 to V70 on the audit of the chunk table."""
    m = model(spark, sf, "documents", "chunks", "issues")
    return A.audit_violations(spark, A.chunk_facts(m["documents"], m["chunks"], _CORE), m)


@query("," + _FACTS.replace("m_documents", "old_documents").replace("m_chunks", "old_chunks").replace("b as (select", "old_documents as (select * from m_documents union all select * from m_documents), old_chunks as (select * from m_chunks union all select * from m_chunks), b as (select", 1) + """select r.rule_id, r.metric, f.value, r.expected from (values ('V62', 'documents_total', (select count(*) from m_documents)), ('V63', 'documents_chunked', (select count(*) from m_documents)),
('V64', 'chunks_total', (select count(*) from m_chunks)), ('V65', 'source_issue_chunks', (select count(*) from m_issues)), ('V66', 'empty_chunks', 0), ('V67', 'missing_provenance_chunks', 0),
('V68', 'within_document_duplicate_hash_groups', 0), ('V69', 'documents_without_chunks', 0), ('V70', 'documents_missing_core_sections', 0)) r(rule_id, metric, expected)
join f on f.metric = r.metric where f.value <> r.expected""", "documents", "chunks", "issues")
def rules_audit_stale(spark, sf):
    """V62 to V70 on the audit of a loading that doubled every row, held against the tables as they are."""
    m = model(spark, sf, "documents", "chunks", "issues")
    twice = lambda n: m[n].unionAll(m[n])
    return A.audit_violations(spark, A.chunk_facts(twice("documents"), twice("chunks"), _CORE), m)


@query(""", l as (select 'missing_inception_date' as list, fund_id as key from m_funds where coalesce(inception_date, '') = '' union all select 'unresolved_status', fund_id from m_funds where coalesce(inception_status, '') in ('', 'REVIEWED')
union all select 'missing_aum', fund_id from m_funds where fund_id not in (select fund_id from m_aum) union all select 'missing_classes', fund_id from m_funds where fund_id not in (select fund_id from m_classes)
union all select 'high_risk', fund_id from m_funds where risk_grade <= 1),
r as (select *, row_number() over (partition by list order by key) as n from l)
select list, count(*) as n, array_to_string(list(cast(key as varchar) order by key) filter (where n <= 20), '|') as first from r group by 1""", "funds", "aum", "classes")
def gap_lists(spark, sf):
    """Funds under each gap, and the first twenty of each."""
    m = model(spark, sf, "funds", "aum", "classes")
    has = lambda n: m[n].select(F.col("fund_id").alias("key_of"), F.lit(True).alias(f"has_{n}")).distinct()
    f = m["funds"]
    for n in ("aum", "classes"):
        f = f.join(has(n), F.col("fund_id") == F.col("key_of"), "left").drop("key_of")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lists = A.listed(f, "fund_id", {
        "missing_inception_date": blank("inception_date"), "unresolved_status": blank("inception_status") | (F.col("inception_status") == "REVIEWED"), "missing_aum": F.col("has_aum").isNull(),
        "missing_classes": F.col("has_classes").isNull(), "high_risk": F.col("risk_grade") <= 1,
    })
    return A.examples(lists).select("list", "n", F.array_join(F.col("first").cast("array<string>"), "|").alias("first"))


@query("""select c.class_id, c.class_inception_date as since, date_diff('month', cast(c.class_inception_date as date), date '2002-01-01') as months from m_classes c
where c.class_inception_status = 'ESTABLISHED' and length(c.class_inception_date) = 10""", "funds", "classes")
def months_since(spark, sf):
    """Q23 over all dates: whole months from each class's own date, for established classes only."""
    c = model(spark, sf, "classes")["classes"].filter("class_inception_status = 'ESTABLISHED' and length(class_inception_date) = 10")
    day = F.col("class_inception_date").cast("date")
    months = (2002 - F.year(day)) * 12 + 1 - F.month(day)
    return c.select("class_id", F.col("class_inception_date").alias("since"), months.cast("long").alias("months"))


@query("""select chunk_id, source_doc_id, source_page, section from m_chunks where section = 'assistant' and contains(source_text, 'the') union all
select chunk_id, source_doc_id, source_page, section from m_chunks where section = 'user' and regexp_matches(source_text, 'an (of|the|ou)|lea')""", "chunks")
def cited_by_keyword(spark, sf):
    """Q18, Q25 and Q26: chunks of a section by keywords, with the page to cite."""
    c = model(spark, sf, "chunks")["chunks"]
    hit = ((F.col("section") == "assistant") & F.col("source_text").contains("the")) | ((F.col("section") == "user") & F.col("source_text").rlike("an (of|the|ou)|lea"))
    return c.filter(hit).select("chunk_id", "source_doc_id", "source_page", "section")


@query("""select p_partkey, segment from part, (values ('steel', 'STEEL'), ('tin', 'TIN|NICKEL'), ('promo', 'PROMO|ECONOMY'), ('plated', 'PLATED')) s(segment, pattern)
where regexp_matches(concat_ws(' ', p_name, p_type), pattern)""")
def fund_segments(spark, sf):
    """Q7 to Q10: records by patterns over several columns."""
    return A.segments(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey", ["p_name", "p_type"], {"steel": "STEEL", "tin": "TIN|NICKEL", "promo": "PROMO|ECONOMY", "plated": "PLATED"})


@query("""select f.fund_id, f.risk_grade, a.amount, coalesce(c.n, 0) as n_classes from m_funds f left join m_aum a on a.fund_id = f.fund_id
left join (select fund_id, count(*) as n from m_classes group by 1) c on c.fund_id = f.fund_id""", "funds", "aum", "classes")
def fund_card(spark, sf):
    """Q4 and Q6: classes and amount of each fund."""
    m = model(spark, sf, "funds", "aum", "classes")
    counted = m["classes"].groupBy("fund_id").agg(F.count("*").alias("n"))
    return m["funds"].join(m["aum"], "fund_id", "left").join(counted, "fund_id", "left").select("fund_id", "risk_grade", "amount", F.coalesce("n", F.lit(0)).alias("n_classes"))


@query("""select category, rows, filled, case when filled = 0 then 'NOT_READY' when filled < rows then 'PARTIAL' else 'READY' end as status from (
select 'risk' as category, count(*) as rows, count(risk_grade) as filled from m_funds union all select 'inception', count(*), count(nullif(inception_date, '')) from m_funds
union all select 'scheduled', count(*), count(nullif(inception_scheduled_date, '')) from m_funds union all select 'evidence', count(*), count(nullif(source_text, '')) from m_funds)""", "funds")
def question_readiness(spark, sf):
    """How far the fields behind each kind of question are filled."""
    return A.readiness(model(spark, sf, "funds")["funds"], {"risk": "risk_grade", "inception": "inception_date", "scheduled": "inception_scheduled_date", "evidence": "source_text"})


@query("select issue_id, source_doc_id, affected_field, concat(coalesce(reason, ''), ' [', coalesce(status, ''), '; ', coalesce(official_confirmation, ''), ']') as reason from m_issues", "issues")
def issue_reasons(spark, sf):
    """The short form of the issue registry."""
    return A.issue_reasons(model(spark, sf, "issues")["issues"])


@query("""select class_id, fund_id, class_name_normalized from (select c.*, row_number() over (partition by fund_id, class_name_normalized order by class_id) as n from m_classes c) where n > 1""", "classes")
def duplicate_offenders(spark, sf):
    """Each row that repeats a key, not the key alone."""
    return R.repeated_rows(model(spark, sf, "classes")["classes"], ["fund_id", "class_name_normalized"], ["class_id"]).select("class_id", "fund_id", "class_name_normalized")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
