"""Queries over documents, ledgers and prospectuses that Spark makes from the driver's tables, with their SQL.

Files (PDF, CSV) are written from the tables and read again; the SQL works
from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import chunking as C
from papyra.functions import text as T
from papyra.operators import batch as B
from papyra.operators import corrections as K
from papyra.operators import evidence as E
from papyra.operators import layout as L
from papyra.operators import matching as M
from papyra.operators import relational as R
from papyra.operators import reshape as S
from papyra.operators import rules as U
from papyra.scratch import new_path, settle
from papyra.sources import files, pdf, pdf_sink, split_csv

_Q: dict = {}
_SQL: dict[str, str] = {}
_WS = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, greatest(1, ceil(length(text) / 3000.0))::INT AS n_pages FROM documents)
SELECT doc_id, page::INT AS page, n_pages, trim(regexp_replace(substr(text, 3000 * (page - 1) + 1, 3000), '{_WS}', ' ', 'g')) AS text FROM d, unnest(range(1, n_pages + 1)) AS u(page)
""")
def pdf_pages(spark, sf):
    """Every document printed as a PDF file, a line of text a line, and read back page by page."""
    d = t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paged = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / 3000).cast("int") - 1)), lambda k: F.substring(d["text"], k * 3000 + 1, F.lit(3000)))).alias("pos", "body"))
    lines = paged.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("path"), (F.col("pos") + 1).alias("page"), F.posexplode(F.split("body", "\n")).alias("line", "str"))
    placed = lines.select("path", "page", F.lit(50.0).alias("x"), (800.0 - 10 * F.col("line")).alias("y"), "str")
    printed = settle(pdf_sink.render(placed), "printed")
    got = pdf.page_text(printed)
    return got.select(F.substring_index("path", "-", -1).cast("long").alias("doc_id"), "page", "n_pages", "text")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS k FROM lineitem)
SELECT l_suppkey, (k // 40 + 1)::INT AS page, (k % 40 + 1)::INT AS line, l_orderkey || '|' || l_partkey || '|' || l_returnflag || l_linestatus AS cells FROM r WHERE (k // 40 + 1) % 2 = 1
""")
def pdf_table_lines(spark, sf):
    """A price list a supplier, of which only odd pages are asked for, decoded and put into lines."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    r = t(spark, sf, "lineitem").withColumn("k", F.row_number().over(order) - 1).withColumn("path", F.concat(F.lit("s-"), F.col("l_suppkey")))
    at = lambda x, c: F.struct(F.lit(x).alias("x"), c.cast("string").alias("str"))
    cells = F.explode(F.array(at(300.0, F.concat("l_returnflag", "l_linestatus")), at(50.0, F.col("l_orderkey")), at(200.0, F.col("l_partkey")))).alias("c")
    # Cells of one line differ in height by less than the half step that lines are told apart by.
    placed = r.select("path", (F.floor(F.col("k") / 40) + 1).cast("int").alias("page"), (800.0 - 15 * (F.col("k") % 40)).alias("y"), cells).select("path", "page", "c.x", (F.col("y") + F.col("c.x") / 2000).alias("y"), "c.str")
    printed = settle(pdf_sink.render(placed), "price-lists")
    wanted = pdf.page_counts(printed).select("path", F.explode(F.sequence(F.lit(1), F.col("n_pages"), F.lit(2))).alias("page"))
    lines = L.lines(pdf.positioned(printed, wanted), ["path", "page"])
    return lines.select(F.substring_index("path", "-", -1).cast("long").alias("l_suppkey"), "page", "line", F.array_join("cells.str", "|").alias("cells"))


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents")
def csv_round_trip(spark, sf):
    """All documents as CSV with quoted line ends, read by a task for every 16 MB of a file."""
    path = new_path(spark, "csv")
    files.write_csv(t(spark, sf, "documents"), path, ["doc_id", "lang", "text", "source"])
    return split_csv.read_csv(spark, path, range_bytes=1 << 24)


@query("""
WITH p AS (SELECT user_id, ts, max(event_id) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, p.last_purchase FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def asof_by_user(spark, sf):
    """The last purchase of the same user at or before each event."""
    e = t(spark, sf, "events").select("event_id", "user_id", "ts")
    bought = t(spark, sf, "events").filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_purchase"))
    return R.asof(e, bought, "ts", "at", "last_purchase", by=["user_id"]).select("event_id", "last_purchase")


@query("""
WITH c AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, length(text) + 1 AS size FROM conversations),
n AS (SELECT conv_id, sum(size) AS total FROM c GROUP BY ALL)
SELECT n.conv_id, place::BIGINT AS place, c.turn FROM n, unnest(range(0, total::BIGINT, 100)) AS u(place) JOIN c ON c.conv_id = n.conv_id AND c.first <= place AND place < c.first + c.size
""")
def page_at_offset(spark, sf):
    """J15 by document: the turn that every hundredth character of a conversation is in."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = t(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", (F.length("text") + 1).cast("long").alias("size"))
    starts = c.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    places = c.groupBy("conv_id").agg(F.sum("size").alias("total")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(100).cast("long"))).alias("place"))
    return R.asof(places, starts, "place", "first", "turn", by=["conv_id"]).select("conv_id", "place", "turn")


@query("""
WITH n AS (SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(string_split(text, ' ')[1:12]) AS w FROM benchmark) WHERE length(w) >= 3)
SELECT doc_id, name FROM documents JOIN n ON contains(lower(text), name)
""")
def contained_names(spark, sf):
    """Which of the benchmark items' first words stand in each document, inside other words too."""
    words = t(spark, sf, "benchmark").select(F.explode(F.slice(F.split("text", " "), 1, 12)).alias("w")).filter("length(w) >= 3")
    docs = t(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return M.contained(docs, "doc_id", "text", words.select(F.lower("w").alias("name")), "name").select("doc_id", "name")


@query("""
WITH n AS (SELECT DISTINCT p_brand, substr(p_name, k) AS name FROM part, unnest([-3, -4, -6]) AS u(k) WHERE p_partkey % 2 = 0 AND length(p_name) >= -k),
l AS (SELECT p_partkey, p_brand, p_type || ' ' || p_name AS label FROM part)
SELECT l.p_partkey, arg_max(n.name, length(n.name)) AS token FROM l LEFT JOIN n ON n.p_brand = l.p_brand AND ends_with(l.label, n.name) GROUP BY 1
""")
def suffix_tokens(spark, sf):
    """The longest token of a part's brand that ends its label."""
    p = t(spark, sf, "part")
    names = p.filter("p_partkey % 2 = 0").select("p_brand", F.explode(F.expr("transform(filter(array(3, 4, 6), k -> k <= length(p_name)), k -> right(p_name, k))")).alias("token"))
    labels = p.select("p_partkey", "p_brand", F.concat_ws(" ", "p_type", "p_name").alias("label"))
    return M.longest_suffix(labels, "p_brand", "label", names, "token").select("p_partkey", "token")


# What the batch queries read: a prospectus a supplier, a class a line number.
_CLASSES = ["A", "A-e", "C", "C-e", "C-P", "C-P2e", "S"]
_LINES = """select l_suppkey as s, l_linenumber as k, min(l_orderkey) as o, round(max(l_discount), 2) as d, round(max(l_tax), 2) as t, cast(max(l_quantity) as double) as q from lineitem group by l_suppkey, l_linenumber"""


def _prospectuses(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.sql(_LINES.replace("from lineitem", "from {l}"), l=t(spark, sf, "lineitem"))
    n = F.element_at(F.array(*map(F.lit, _CLASSES)), F.col("k"))
    total = F.round(F.col("d") + F.col("t") + 0.03, 4)
    c = c.select(
        "s", "k", "o", F.concat(F.lit("종류"), n, F.lit(" K"), F.lpad(((F.col("s") * 7 + F.col("k")) % 10000).cast("string"), 4, "0")).alias("code"),
        F.concat_ws(" ", F.concat(F.lit("종류"), n), "d", "t", F.lit("0.01"), F.lit("0.02"), F.when(F.col("o") % 5 == 0, F.round(total + 0.5, 4)).otherwise(total), F.lit("-"), F.when(F.col("o") % 3 == 0, "-").otherwise(F.round(total + 1, 4).cast("string"))).alias("fee"),
        F.concat_ws(" ", F.concat(F.lit("종류"), n), F.lit("2010"), F.col("q"), -F.col("q") / 2, F.when(F.col("o") % 2 == 0, "-").otherwise("3.25"), F.lit("4.5"), F.lit("-")).alias("gain"),
    )
    by = c.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", "code", "fee", "gain"))).alias("c"))
    text = lambda page, c: F.struct(F.lit(page).alias("page"), c.alias("text"))
    s = F.col("s").cast("string")
    return by.select(
        F.concat(F.lit("file-"), s).alias("file"), (F.col("s") % 50 + 10).cast("int").alias("total_pages"),
        F.concat(F.lit("1. 집합투자기구 명칭 투자신탁 "), s, F.when(F.col("s") % 2 == 0, " (주식)").otherwise(" (채권)"), F.lit(" 2. 집합투자업자 갑 작성 기준일 2024년 3월 "), (F.col("s") % 28 + 1).cast("string"), F.lit("일 5. 효력발생일 2024. 4. 1 6. 끝 "), (F.col("s") % 6 + 1).cast("string"), F.lit("등급으로 분류")).alias("cover"),
        text(2, F.concat(F.lit("(AB1"), F.lpad((F.col("s") % 100).cast("string"), 2, "0"), F.lit(") <요약정보> (주1) 비교지수 : INDEX "), s, F.lit(" (주2)"))).alias("summary"),
        text(3, F.concat(F.array_join("c.code", " "), F.lit(" 2. 집합투자기구의 종류 종류Z ZZ000"))).alias("classes"),
        text(4, F.concat(F.lit("구분 지급비용(연간%) "), F.array_join("c.fee", " "))).alias("fees"),
        text(5, F.concat(F.lit("~ 24.01.31 "), F.array_join("c.gain", " "), F.lit(" 투자신탁 비교지수 0.5 0.6 0.7 - 0.9 나. 연도별 수익률"))).alias("performance"),
        F.when(F.col("s") % 7 != 0, text(6, F.concat(F.lit("2024.02.03 합계 "), F.repeat(F.lit("1 "), 11), F.format_number(F.col("s") * 1001 + 5, 0)))).alias("aum"),
    )


def _batch(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """The tagged rows of all prospectuses, written by table; one table of them."""
    path = new_path(spark, "batch")
    B.write(B.tagged(_prospectuses(spark, sf), spark.createDataFrame(U.CLASS_RULES, U.SCHEMA), "미래에셋자산운용"), path)
    return B.table_of(spark.read.parquet(path), table)


_BATCH = f"""WITH c AS (SELECT *, (['{"','".join(_CLASSES)}'])[k] AS n, round(d + t + 0.03, 4) + CASE WHEN o % 5 = 0 THEN 0.5 ELSE 0 END AS total, o % 5 = 0 AS bad FROM ({_LINES})), f AS (SELECT DISTINCT s, 'file-' || s AS file FROM c)
"""


@query(_BATCH + "SELECT file, 0 AS pos, file AS file_name, '2024-03-' || lpad((s % 28 + 1)::VARCHAR, 2, '0') AS document_date, '2024-04-01' AS effective_date, (s % 50 + 10)::INT AS total_pages FROM f")
def batch_documents(spark, sf):
    return _batch(spark, sf, "documents")


@query(_BATCH + """SELECT file, 0 AS pos, '투자신탁 ' || s || CASE WHEN s % 2 = 0 THEN ' (주식)' ELSE ' (채권)' END AS fund_name_raw, '투자신탁' || s || CASE WHEN s % 2 = 0 THEN '(주식)' ELSE '(채권)' END AS fund_name_normalized,
'AB1' || lpad((s % 100)::VARCHAR, 2, '0') AS fund_code, (s % 6 + 1)::INT AS risk_grade, CASE WHEN s % 2 = 0 THEN '주식형' ELSE '채권형' END AS asset_type_l1, 'INDEX ' || s AS benchmark FROM f""")
def batch_funds(spark, sf):
    return _batch(spark, sf, "funds")


@query(_BATCH + """SELECT 'file-' || s AS file, (row_number() OVER (PARTITION BY s ORDER BY k) - 1)::INT AS pos, 'K' || lpad(((s * 7 + k) % 10000)::VARCHAR, 4, '0') AS class_code, n AS class_name_raw,
CASE n WHEN 'C-P' THEN '연금저축' WHEN 'C-P2e' THEN '퇴직연금' ELSE '일반' END AS account_type, CASE n WHEN 'A-e' THEN '온라인' WHEN 'C-e' THEN '온라인' WHEN 'C-P2e' THEN '온라인' WHEN 'S' THEN '온라인슈퍼' ELSE '오프라인' END AS channel,
CASE n WHEN 'A' THEN 1.0 WHEN 'A-e' THEN 0.5 ELSE 0.0 END::DOUBLE AS front_load, CASE n WHEN 'S' THEN 0.15 ELSE 0.0 END::DOUBLE AS back_load,
CASE WHEN NOT bad THEN d END AS management_fee, CASE WHEN NOT bad THEN t END AS sales_fee, CASE WHEN NOT bad THEN 0.01::DOUBLE END AS trust_fee, CASE WHEN NOT bad THEN 0.02::DOUBLE END AS admin_fee, CASE WHEN NOT bad THEN total END AS total_fee,
CASE WHEN NOT bad THEN CASE WHEN o % 3 = 0 THEN total ELSE round(total + 1, 4) END END AS total_expense_ratio, '3|4' AS source_page, '[p.3] 종류' || n || '; 코드 K' || lpad(((s * 7 + k) % 10000)::VARCHAR, 4, '0') AS source_text FROM c""")
def batch_classes(spark, sf):
    return _batch(spark, sf, "classes")


@query(_BATCH + """, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS i FROM c),
v AS (SELECT s, i, n, unnest([{'j': 0, 'p': '1Y', 'v': q, 'b': 0.5}, {'j': 1, 'p': '2Y', 'v': -q / 2, 'b': 0.6}, {'j': 2, 'p': '3Y', 'v': CASE WHEN o % 2 = 0 THEN NULL ELSE 3.25 END, 'b': 0.7}, {'j': 3, 'p': '5Y', 'v': 4.5, 'b': NULL}]) AS x FROM r)
SELECT 'file-' || s AS file, (i * 5 + x.j)::INT AS pos, n AS class_name_raw, x.p AS period, x.v::DOUBLE AS return_pct, x.b::DOUBLE AS benchmark_return_pct, '2024-01-31' AS as_of_date, '5' AS source_page FROM v WHERE x.v IS NOT NULL""")
def batch_performance(spark, sf):
    return _batch(spark, sf, "performance")


@query(_BATCH + "SELECT file, 0 AS pos, format('{:,}', s * 1001 + 5) || '백만원' AS aum_value_raw, ((s * 1001 + 5) * 1000000)::BIGINT AS aum_value_krw, '2024-02-03' AS as_of_date, '6' AS source_page FROM f WHERE s % 7 <> 0")
def batch_aum(spark, sf):
    return _batch(spark, sf, "aum")


@query(_BATCH + f""", r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) AS i FROM c)
SELECT file, 0 AS pos, file AS file_name, 'aum' AS field, '{B.AUM_REASON}' AS reason FROM f WHERE s % 7 = 0
UNION ALL SELECT 'file-' || s, i::INT, 'file-' || s, 'class.fees.' || n, '{B.FEE_REASON}' FROM r WHERE bad""")
def batch_issues(spark, sf):
    return _batch(spark, sf, "issues")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN contains(label, '퇴직연금') THEN '퇴직연금' WHEN contains(label, '개인연금') THEN '연금저축' ELSE '일반' END
    ELSE CASE WHEN contains(label, 'P2') OR contains(label, 'rp') THEN '퇴직연금' WHEN contains(label, '-P') THEN '연금저축' ELSE '일반' END END AS account_type,
  CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN contains(label, '온라인슈퍼') THEN '온라인슈퍼' WHEN contains(label, '온라인') THEN '온라인' WHEN contains(label, '오프라인') THEN '오프라인' ELSE '미분류' END
    ELSE CASE WHEN label LIKE '%e' THEN '온라인' WHEN label = 'S' THEN '온라인슈퍼' WHEN contains(label, 'F') OR contains(label, 'I') THEN '기관' ELSE '오프라인' END END AS channel
FROM (SELECT p_partkey, (['C-e', '온라인슈퍼(S)', 'S', '온라인 개인연금(C-Pe)', 'F', '오프라인 퇴직연금(C-P2)', 'C-P2', 'C-P', '온라인 C-rp'])[p_partkey % 9 + 1] AS label FROM part)
""")
def issuer_rules(spark, sf):
    """labels of two issuers whose rules disagree on the same ones."""
    labels = ["C-e", "온라인슈퍼(S)", "S", "온라인 개인연금(C-Pe)", "F", "오프라인 퇴직연금(C-P2)", "C-P2", "C-P", "온라인 C-rp"]
    issuer = F.when(F.col("p_partkey") % 2 == 0, "마이다스에셋자산운용").otherwise("미래에셋자산운용")
    rows = t(spark, sf, "part").select("p_partkey", issuer.alias("issuer"), F.element_at(F.array(*map(F.lit, labels)), (F.col("p_partkey") % 9 + 1).cast("int")).alias("label"))
    return U.classified(rows, spark.createDataFrame(U.CLASS_RULES, U.SCHEMA), "issuer", "label", ["account_type", "channel"]).select("p_partkey", "account_type", "channel")


# Patches of the correction queries: reviewers disagree, repeat each other, and name records and fields that don't exist.
_PATCHES = """select * from (select o_custkey + case when o_orderkey % 211 = 0 then 1000000 else 0 end as c_custkey, case o_orderkey % 5 when 0 then 'c_name' when 1 then 'c_acctbal' when 2 then 'c_mktsegment' when 3 then 'c_name' else 'c_phone' end as field,
o_orderkey as seq, case o_orderkey % 5 when 1 then cast(o_orderkey % 3 as string) when 2 then case when o_orderkey % 3 = 0 then null else 'MACHINERY' end else concat('reviewed ', cast(o_orderkey % 2 as string)) end as value, o_orderpriority as source from {orders}) p"""
_LOG = f"""WITH p AS ({_PATCHES.replace("{orders}", "orders")}), b AS (SELECT c_custkey AS id, c_name, cast(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer),
l AS (SELECT p.*, b.id IS NULL AS orphan, field NOT IN ('c_name', 'c_acctbal', 'c_mktsegment') AS unknown, row_number() OVER w AS k, lag(value) OVER w AS before, lead(value) OVER w AS after, lead(seq) OVER w IS NULL AS last,
  CASE field WHEN 'c_name' THEN c_name WHEN 'c_acctbal' THEN c_acctbal WHEN 'c_mktsegment' THEN c_mktsegment END AS was
  FROM p LEFT JOIN b ON b.id = p.c_custkey WINDOW w AS (PARTITION BY p.c_custkey, field ORDER BY seq, value NULLS FIRST)),
log AS (SELECT c_custkey, field, seq, value, source, CASE WHEN orphan OR unknown THEN NULL WHEN k = 1 THEN was ELSE before END AS replaced,
  CASE WHEN orphan THEN 'ORPHAN' WHEN unknown THEN 'UNKNOWN_FIELD' WHEN last THEN 'APPLIED' WHEN after IS NOT DISTINCT FROM value THEN 'CONFIRMED' ELSE 'OVERRULED' END AS status FROM l)
"""
_FIELDS = ["c_name", "c_acctbal", "c_mktsegment"]


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_PATCHES, orders=t(spark, sf, "orders"))


@query(_LOG + "SELECT * FROM log")
def correction_log(spark, sf):
    """What became of each patch."""
    return K.patch_log(t(spark, sf, "customer"), _patches(spark, sf), "c_custkey", _FIELDS)


@query(_LOG + """, a AS (SELECT * FROM l WHERE last AND NOT unknown AND NOT orphan)
SELECT c.c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.value ELSE c.c_name END AS c_name, CASE WHEN m.c_custkey IS NOT NULL THEN m.value::DOUBLE ELSE c.c_acctbal END AS c_acctbal,
CASE WHEN s.c_custkey IS NOT NULL THEN s.value ELSE c.c_mktsegment END AS c_mktsegment, n.source AS name_source FROM customer c
LEFT JOIN a n ON n.c_custkey = c.c_custkey AND n.field = 'c_name' LEFT JOIN a m ON m.c_custkey = c.c_custkey AND m.field = 'c_acctbal' LEFT JOIN a s ON s.c_custkey = c.c_custkey AND s.field = 'c_mktsegment'""")
def corrected_records(spark, sf):
    """Records with the last patch of each field, and where it is from."""
    out = K.corrected(t(spark, sf, "customer"), _patches(spark, sf), "c_custkey", _FIELDS)
    return out.select("c_custkey", *_FIELDS, F.col("sources")["c_name"].alias("name_source"))


@query(_LOG + """SELECT c_custkey, field FROM (SELECT c_custkey, 'c_name' AS field FROM customer UNION ALL SELECT c_custkey, 'c_phone' FROM customer) i
WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.c_custkey = i.c_custkey AND log.field = i.field AND status IN ('APPLIED', 'CONFIRMED'))""")
def open_issues(spark, sf):
    """Issues less those that a patch has settled."""
    c = t(spark, sf, "customer").select("c_custkey", F.explode(F.array(F.lit("c_name"), F.lit("c_phone"))).alias("field"))
    return K.open_issues(c, K.patch_log(t(spark, sf, "customer"), _patches(spark, sf), "c_custkey", _FIELDS), "c_custkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_extendedprice * 8 = floor(l_extendedprice * 8) AND (l_extendedprice * 8)::BIGINT * 25 % 2 = 1
  THEN printf('%.2f', ((l_extendedprice * 8)::BIGINT * 25 + 1) // 2 / 100.0) ELSE printf('%.2f', l_extendedprice) END AS shown,
  printf('%.1f', CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber * 0.25 + 0.01 ELSE l_linenumber * 0.25 + 0.001 END) AS quarter, printf('%.2f', l_linenumber + 0.005::DOUBLE) AS under_half FROM lineitem
""")
def fixed_decimals(spark, sf):
    """decimals by the exact binary value."""
    q = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber") * 0.25 + 0.01).otherwise(F.col("l_linenumber") * 0.25 + 0.001)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", T.to_fixed(F.col("l_extendedprice")).alias("shown"), T.to_fixed(q, 1).alias("quarter"), T.to_fixed(F.col("l_linenumber") + 0.005).alias("under_half"))


# Chunks by recursion: one sentence at a time is added, and a full chunk is put out. Cleaned texts have single spaces.
def _chunked(of: str, keys: str, limit: int, overlap: int) -> str:
    full = f"length(r.now) + length(s.s) + 1 > {limit}"
    return f"""
b AS (SELECT {keys}, row_number() OVER () AS id, body FROM ({of})),
s0 AS (SELECT id, list_filter(string_split(regexp_replace(body, '([.!?다요함됨]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS l FROM b WHERE length(body) > {limit}),
s AS (SELECT id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS s FROM s0),
r AS (SELECT id, 1::BIGINT AS k, NULL::VARCHAR AS done, s AS now FROM s WHERE k = 1
  UNION ALL SELECT r.id, s.k, CASE WHEN {full} THEN trim(r.now) END, CASE WHEN {full} THEN right(r.now, {overlap}) || ' ' || s.s ELSE r.now || ' ' || s.s END FROM r JOIN s ON s.id = r.id AND s.k = r.k + 1),
z AS (SELECT id, max(k) AS k FROM s GROUP BY 1),
x AS (SELECT id, k, done AS chunk FROM r WHERE done IS NOT NULL UNION ALL SELECT r.id, r.k + 1, trim(r.now) FROM r JOIN z USING (id, k) UNION ALL SELECT id, 1, body FROM b WHERE length(body) <= {limit}),
parts AS (SELECT {keys}, row_number() OVER (PARTITION BY id ORDER BY x.k) AS part, chunk, sha256(chunk) AS chunk_hash FROM x JOIN b USING (id))"""


#: SQL of the flagship query, which stands in ``plans.queries``.
CHUNK_DOCUMENTS = f"""WITH RECURSIVE {_chunked(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS body FROM documents WHERE text IS NOT NULL", "doc_id", 2200, 180)}
SELECT doc_id, (part - 1)::INT AS part, chunk, chunk_hash FROM parts QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_hash ORDER BY part) = 1"""


@query(f"""WITH RECURSIVE {_chunked(f"SELECT conv_id AS doc, turn AS page, role AS section, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS body FROM conversations WHERE text IS NOT NULL", "doc, page, section", 300, 40)},
kept AS (SELECT 0 AS ordinal, 'page' AS kind, * FROM parts QUALIFY row_number() OVER (PARTITION BY doc, page, section, chunk_hash ORDER BY part) = 1),
every AS (SELECT ordinal, kind, doc, page, section, 'conversation ' || doc AS source_file, part, chunk_hash FROM kept
  UNION ALL SELECT 1, 'issue', p_partkey, p_size, 'source_quality_issue', p_brand, 1, sha256(p_type || ': ' || p_name) FROM part)
SELECT seq, 'CHUNK' || CASE WHEN seq < 1000000 THEN lpad(seq::VARCHAR, 6, '0') ELSE seq::VARCHAR END AS chunk_id, * EXCLUDE (seq, ordinal, part), part::INT AS part
FROM (SELECT row_number() OVER (ORDER BY ordinal, doc, page, part) AS seq, * FROM every)""")
def chunk_rows(spark, sf):
    """Pages cut at sentences, equal chunks of a page kept once, with where they are from, and issues after them."""
    page = t(spark, sf, "conversations").filter("text is not null").select(
        F.lit("page").alias("kind"), F.col("conv_id").cast("long").alias("doc"), F.col("turn").cast("long").alias("page"), F.col("role").alias("section"), F.concat(F.lit("conversation "), F.col("conv_id")).alias("source_file"), T.clean(F.col("text")).alias("body")
    )
    issue = t(spark, sf, "part").select(F.lit("issue").alias("kind"), F.col("p_partkey").cast("long").alias("doc"), F.col("p_size").cast("long").alias("page"), F.lit("source_quality_issue").alias("section"), F.col("p_brand").alias("source_file"), F.concat_ws(": ", "p_type", "p_name").alias("body"))
    out = E.chunk_table([page, issue], "CHUNK", parts=lambda body: C.chunks(body, 300, 40), keep_by=["ordinal", "doc", "page", "section"])
    return out.select("seq", "chunk_id", "kind", "doc", "page", "section", "source_file", "part", "chunk_hash")


@query("""
WITH v AS (SELECT l_orderkey, list(l_tax ORDER BY l_linenumber, l_partkey, l_tax) AS vals, list(l_discount ORDER BY l_linenumber, l_partkey, l_tax) AS other, min(l_linenumber) AS k FROM lineitem GROUP BY 1 HAVING count(*) <= 5),
l AS (SELECT *, CASE len(vals) WHEN 5 THEN ['1Y', '2Y', '3Y', '5Y', 'SINCE_INCEPTION'] WHEN 4 THEN ['1Y', '2Y', '3Y', 'SINCE_INCEPTION'] WHEN 3 THEN ['1Y', '2Y', 'SINCE_INCEPTION'] WHEN 2 THEN ['1Y', 'SINCE_INCEPTION'] ELSE ['SINCE_INCEPTION'] END AS p FROM v)
SELECT l_orderkey, p[i] AS label, vals[i] AS value, CASE WHEN k = 1 THEN other[i] ELSE [4.5, 4.6, 3.8, 2.8, 2.6][i] END::DOUBLE AS beside FROM l, unnest(range(1, len(vals) + 1)) AS u(i)
""")
def ragged_vectors(spark, sf):
    """Vectors of one to five values with the labels of their length, and a default vector where a row has none."""
    order = F.struct("l_linenumber", "l_partkey", "l_tax", "l_discount")
    v = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("r"), F.min("l_linenumber").alias("k")).filter("size(r) <= 5")
    v = v.select("l_orderkey", F.col("r.l_tax").alias("vals"), F.when(F.col("k") == 1, F.col("r.l_discount")).alias("other"))
    periods = B.PERIODS
    labels = {n: [*periods[: n - 1], periods[-1]] if n < 5 else periods for n in range(1, 6)}
    return S.vector_rows(v, ["l_orderkey"], "vals", labels, "other", default=[4.5, 4.6, 3.8, 2.8, 2.6])


@query("""SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN '1Y' WHEN 'N' THEN '2Y' ELSE 'SINCE_INCEPTION' END AS label, sum(l_quantity) AS value, max(l_tax) AS beside FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def measure_objects(spark, sf):
    """A map of named measures a record as rows."""
    per = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("value"), F.max("l_tax").alias("bench"))
    maps = per.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct("value", "bench")))).alias("m"))
    return S.measure_rows(maps, ["l_orderkey"], "m", {"A": "1Y", "N": "2Y", "R": "SINCE_INCEPTION"})


@query("""SELECT conv_id, turn, 'CLASS' || CASE WHEN n < 1000000 THEN lpad(n::VARCHAR, 6, '0') ELSE n::VARCHAR END AS id FROM (SELECT conv_id, turn, conv_id * 9000 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)""")
def position_ids(spark, sf):
    """Ids from a group's start and the row's place in it."""
    c = t(spark, sf, "conversations").select("conv_id", "turn")
    starts = c.select("conv_id").distinct().withColumn("start", F.col("conv_id") * 9000)
    return S.position_ids(c, "conv_id", ["turn"], starts, "start", "CLASS")


@query("""SELECT o_orderkey, CASE WHEN ok THEN round(o_totalprice / 100000, 3) END AS total_fee, CASE WHEN ok THEN 0.12::DOUBLE END AS management_fee, CASE WHEN ok THEN 0.01::DOUBLE END AS trust_fee,
CASE WHEN ok THEN round(round(o_totalprice / 100000, 3) - 0.13, 3) END AS sales_fee FROM (SELECT *, o_orderstatus = 'F' AS ok FROM orders)""")
def exact_components(spark, sf):
    """Components where the total is known to be made of them, nothing elsewhere."""
    o = t(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 100000, 3).alias("total_fee"), "o_orderstatus")
    return S.exact_components(o, "total_fee", {"management_fee": 0.12, "trust_fee": 0.01}, "sales_fee", F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("""SELECT c_custkey, CASE WHEN f.id IS NOT NULL THEN NULL ELSE born END AS inception_date, CASE WHEN f.id IS NOT NULL THEN 'NOT_ESTABLISHED' WHEN born IS NULL THEN 'NOT_DISCLOSED' ELSE 'ESTABLISHED' END AS inception_status, f.planned AS inception_scheduled_date,
  CASE WHEN f.id IS NULL THEN '4|9' ELSE '4|9|11' END AS source_page, c_name || CASE WHEN f.id IS NULL THEN '' ELSE ' | [p.9|11] new' END AS source_text
FROM customer LEFT JOIN (SELECT o_custkey, min(strftime(o_orderdate, '%Y-%m-%d')) AS born FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT s_suppkey * 5 AS id, CASE WHEN s_suppkey % 2 = 0 THEN '2023-04-03' END AS planned FROM supplier) f ON f.id = c_custkey""")
def fund_status(spark, sf):
    """Status by date, then reviewed overrides that replace date, status and plan, with pages united and texts joined."""
    born = t(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("inception_date"))
    funds = t(spark, sf, "customer").join(born, "c_custkey", "left").select("c_custkey", "inception_date", F.lit("4|9").alias("source_page"), F.col("c_name").alias("source_text"))
    fixes = t(spark, sf, "supplier").select((F.col("s_suppkey") * 5).alias("c_custkey"), F.lit(None).cast("string").alias("inception_date"), F.lit("NOT_ESTABLISHED").alias("inception_status"),
        F.when(F.col("s_suppkey") % 2 == 0, "2023-04-03").alias("inception_scheduled_date"), F.lit("9|11").alias("source_page"), F.lit("new").alias("source_text"))
    return E.status_with_overrides(funds, fixes, "c_custkey")


@query("""WITH f AS (SELECT url AS file_name, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages), h AS (SELECT host FROM f GROUP BY 1 HAVING count(*) > 1)
SELECT file_name, host, host IN (SELECT host FROM h) AS duplicate FROM f WHERE file_name NOT IN (SELECT url FROM pages JOIN labels ON labels.doc_id = pages.page_id)""")
def file_backlog(spark, sf):
    """Pages that no label is of yet, flagged where their host has several."""
    p = t(spark, sf, "pages").select(F.col("url").alias("file_name"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "page_id")
    done = p.join(t(spark, sf, "labels"), F.col("page_id") == F.col("doc_id"), "left_semi")
    several = p.join(R.duplicates(p, ["host"]), "host", "left_semi")
    return E.backlog(p.drop("page_id"), done, several)


@query("""WITH s AS (SELECT o_custkey, o_orderstatus, max_by(o_orderpriority, struct_pack(a := o_orderkey, b := o_orderpriority)) AS last_priority FROM orders GROUP BY ALL)
SELECT c_custkey, k.status, s.last_priority FROM customer CROSS JOIN (SELECT unnest(['F', 'O', 'P', 'X']) AS status) k LEFT JOIN s ON s.o_custkey = c_custkey AND s.o_orderstatus = k.status""")
def enrich_by_two_keys(spark, sf):
    """Enrichment by a key of two columns, of which the last row wins."""
    c = t(spark, sf, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, "FOPX"))).alias("status"))
    e = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), "o_orderkey", F.col("o_orderpriority").alias("last_priority"))
    return R.enrich(c, e, ["c_custkey", "status"], ["o_orderkey"]).select("c_custkey", "status", "last_priority")


@query("""SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS written, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders
QUALIFY place <= 3 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def latest_of_listed(spark, sf):
    """The three latest orders of customers outside an exclusion list, dates compared as loose text made whole."""
    shapes = F.array(*[F.date_format("o_orderdate", p) for p in ("yyyy. M. d", "yyyy-MM-dd", "yyyy년 M월 d일", "yyyy/M/d")])
    loose = F.get(shapes, (F.col("o_orderkey") % 4).cast("int"))
    out = t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = t(spark, sf, "orders").join(out, "o_custkey", "left_anti").withColumn("written", T.iso_date(loose))
    ranked = o.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("written"), "o_orderkey")))
    return ranked.filter("place <= 3").select("o_orderkey", "o_orderdate", "written", F.col("place").cast("long").alias("place"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL) | {"chunk_documents": CHUNK_DOCUMENTS}
