"""Named queries over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import chunking as C
from papyra.functions import text as T
from papyra.operators import pages as P
from papyra.operators import parsers as X
from papyra.operators import relational as R

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_WS = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, regexp_replace(text, '{_WS}', '', 'g') AS compacted FROM documents")
def compact_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.compact(F.col("text")).alias("compacted"))


@query()
def chunk_documents(spark, sf):
    """Cleaned texts in overlapping chunks, hashed; the first of equal chunks of a document stays."""
    docs = t(spark, sf, "documents").select("doc_id", T.clean(F.col("text")).alias("body"))
    parts = docs.select("doc_id", F.posexplode(C.chunks(F.col("body"))).alias("part", "chunk")).withColumn("chunk_hash", F.sha2("chunk", 256))
    return R.keep_first(parts, ["doc_id", "chunk_hash"], ["part"])


@query("SELECT sha256(text) AS chunk_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def chunk_hash_dups_cross(spark, sf):
    return R.duplicates(t(spark, sf, "documents").select(F.sha2("text", 256).alias("chunk_hash")), ["chunk_hash"])


@query("SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL HAVING count(*) > 1")
def chunk_hash_dups_within(spark, sf):
    return R.duplicates(t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")), ["doc_id", "line"])


@query("SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def keep_first_dedup(spark, sf):
    return R.keep_first(t(spark, sf, "documents").withColumn("h", F.sha2("text", 256)), ["h"], ["doc_id"]).select("doc_id", "source", "n_chars")


@query("SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def latest_per_key(spark, sf):
    last = R.keep_first(t(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True)
    return last.join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_orderpriority")


@query("""
WITH m AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN turn - a < 2 THEN 'user' END AS state FROM m""")
def section_carry_forward(spark, sf):
    c = t(spark, sf, "conversations")
    return R.carry_forward(c, "conv_id", "turn", F.col("role") == "user", F.col("role"), {"user": 2}).select("conv_id", "turn", "state")


@query("SELECT conv_id, min(turn) FILTER (WHERE length(text) > 400) AS first_turn, max(turn) FILTER (WHERE length(text) > 400) AS last_turn FROM conversations GROUP BY 1")
def page_hits(spark, sf):
    hit = F.when(F.length("text") > 400, F.col("turn"))
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.min(hit).alias("first_turn"), F.max(hit).alias("last_turn"))


@query("WITH f AS (SELECT conv_id, min(turn) AS p FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT c.conv_id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations c JOIN f USING (conv_id) WHERE turn BETWEEN p AND p + 1 GROUP BY 1")
def page_window_concat(spark, sf):
    c = t(spark, sf, "conversations")
    first = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("p"))
    return c.join(first, "conv_id").filter("turn between p and p + 1").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("body"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS bag FROM conversations GROUP BY 1")
def text_bag_per_key(spark, sf):
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("bag"))


@query("SELECT page_id, list_filter(['<nav>', 'http', 'track('], lambda x: contains(html, x)) AS hits FROM pages")
def term_hits(spark, sf):
    terms = F.array(*[F.lit(x) for x in ("<nav>", "http", "track(")])
    return t(spark, sf, "pages").select("page_id", F.filter(terms, lambda x: F.contains(F.col("html"), x)).alias("hits"))


@query("SELECT page_id, list_filter([CASE WHEN regexp_matches(html, '(?i)<table') THEN 'table' END, CASE WHEN regexp_matches(html, '(?i)<li>') THEN 'list' END], lambda x: x IS NOT NULL) AS tags FROM pages")
def page_pattern_tags(spark, sf):
    tag = lambda p, n: F.when(F.col("html").rlike(p), n)
    return t(spark, sf, "pages").select("page_id", F.array_compact(F.array(tag("(?i)<table", "table"), tag("(?i)<li>", "list"))).alias("tags"))


@query("SELECT coalesce(a.turn, b.turn) AS turn, a.text AS x, b.text AS y FROM (SELECT * FROM conversations WHERE conv_id = 0) a FULL JOIN (SELECT * FROM conversations WHERE conv_id = 1) b ON a.turn = b.turn WHERE a.text IS DISTINCT FROM b.text")
def page_diff(spark, sf):
    c = t(spark, sf, "conversations")
    a, b = (c.filter(F.col("conv_id") == k).select("turn", F.col("text").alias(n)) for k, n in ((0, "x"), (1, "y")))
    return a.join(b, "turn", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("turn", "x", "y")


@query("""
WITH i AS (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS next_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
a AS (SELECT conv_id, next_id, turn, text FROM conversations JOIN i USING (conv_id) WHERE next_id IS NOT NULL),
b AS (SELECT i.conv_id, i.next_id, turn, text FROM conversations c JOIN i ON c.conv_id = i.next_id)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.next_id, b.next_id) AS next_id, coalesce(a.turn, b.turn) AS turn, a.text AS x, b.text AS y
FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.text IS DISTINCT FROM b.text""")
def page_diff_next(spark, sf):
    """Each conversation against the one of the next higher id, turn by turn; no id is left out."""
    c = t(spark, sf, "conversations").filter("conv_id is not null")
    # The next id, by ranges of 1024 ids: only a range's ends meet those of the others.
    ids = c.select("conv_id").distinct().withColumn("r", F.expr("shiftright(conv_id, 10)"))
    ranges = ids.groupBy("r").agg(F.min("conv_id").alias("low")).withColumn("after", F.lead("low").over(Window.orderBy("r"))).select("r", "after")
    within = F.lead("conv_id").over(Window.partitionBy("r").orderBy("conv_id"))
    pairs = ids.withColumn("n", within).join(ranges, "r").select("conv_id", F.coalesce("n", "after").alias("next_id")).filter("next_id is not null")
    a = c.join(pairs, "conv_id").select("conv_id", "next_id", "turn", F.col("text").alias("x"))
    b = c.withColumnRenamed("conv_id", "next_id").join(pairs, "next_id").select("conv_id", "next_id", "turn", F.col("text").alias("y"))
    return a.join(b, ["conv_id", "next_id", "turn"], "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("conv_id", "next_id", "turn", "x", "y")


@query("SELECT doc_id, quality, CASE WHEN quality IS NULL THEN 'NOT_DISCLOSED' WHEN quality = 1 THEN 'ESTABLISHED' ELSE 'NOT_ESTABLISHED' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def status_derivation(spark, sf):
    j = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return j.select("doc_id", "quality", F.when(F.col("quality").isNull(), "NOT_DISCLOSED").when(F.col("quality") == 1, "ESTABLISHED").otherwise("NOT_ESTABLISHED").alias("status"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_missing(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_present(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def zero_kept_counts(spark, sf):
    n = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT 'fk_order' AS rule_id, 'lineitem' AS table_name, l_orderkey::VARCHAR AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'fk_label', 'documents', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'enum_status', 'orders', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'range_discount', 'lineitem', l_orderkey::VARCHAR FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.08
UNION ALL SELECT 'iso_date', 'orders', o_orderkey::VARCHAR FROM orders WHERE NOT regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
UNION ALL SELECT 'unique_key', 'lineitem', l_orderkey::VARCHAR FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def integrity_violations(spark, sf):
    line, orders, docs = (t(spark, sf, n) for n in ("lineitem", "orders", "documents"))
    return R.violations(
        ("fk_order", "lineitem", R.orphans(line, orders, "l_orderkey", "o_orderkey"), F.col("l_orderkey")),
        ("fk_label", "documents", R.orphans(docs, t(spark, sf, "labels"), "doc_id", "doc_id"), F.col("doc_id")),
        ("enum_status", "orders", orders.filter(~F.col("o_orderstatus").isin("F", "O")), F.col("o_orderkey")),
        ("range_discount", "lineitem", line.filter(~F.col("l_discount").between(0, 0.08)), F.col("l_orderkey")),
        ("iso_date", "orders", orders.filter(~T.is_iso(F.date_format("o_orderdate", "yyyy-MM-dd"))), F.col("o_orderkey")),
        ("unique_key", "lineitem", R.duplicates(line, ["l_orderkey", "l_linenumber"]), F.col("l_orderkey")),
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(coalesce(l_tax, 0) + coalesce(l_discount, 0) - 0.1) > 0.00001")
def component_sum_check(spark, sf):
    total = F.coalesce("l_tax", F.lit(0.0)) + F.coalesce("l_discount", F.lit(0.0))
    return t(spark, sf, "lineitem").filter(F.abs(total - 0.1) > 0.00001).select("l_orderkey", "l_linenumber")


@query("SELECT 'lang' AS metric, round(avg(CASE WHEN lang IS NULL OR trim(lang) = '' THEN 1.0::DOUBLE ELSE 0 END), 4) AS rate FROM documents UNION ALL SELECT 'text', round(avg(CASE WHEN text IS NULL OR trim(text) = '' THEN 1.0::DOUBLE ELSE 0 END), 4) FROM documents")
def null_rates(spark, sf):
    return R.null_rates(t(spark, sf, "documents"), ["lang", "text"])


@query("SELECT lang, round(100.0::DOUBLE * count(quality) / greatest(1, count(*)), 1) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage_pct(spark, sf):
    j = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.round(100.0 * F.count("quality") / F.greatest(F.lit(1), F.count("*")), 1).alias("coverage"))


@query("SELECT coalesce(nullif(source, ''), 'NULL') AS value, count(*) AS n FROM documents GROUP BY 1")
def distributions(spark, sf):
    return R.distribution(t(spark, sf, "documents"), "source")


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY 1")
def multi_measure_group(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("n"))


@query("SELECT o_orderdate, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 2")
def cohort_counts(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderdate", "o_orderpriority").agg(F.count("*").alias("n")).filter("n >= 2")


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY count(*) OVER (PARTITION BY o_orderdate, o_orderpriority) >= 2")
def cohort_ranking(spark, sf):
    w = Window.partitionBy("o_orderdate", "o_orderpriority")
    o = t(spark, sf, "orders").withColumn("n", F.count("*").over(w)).withColumn("place", F.rank().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return o.filter("n >= 2").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT p_type, max(p_retailprice) FILTER (WHERE p_size <= 25) AS small, max(p_retailprice) FILTER (WHERE p_size > 25) AS large FROM part GROUP BY 1")
def pair_compare(spark, sf):
    p = t(spark, sf, "part")
    return p.groupBy("p_type").agg(F.max(F.when(F.col("p_size") <= 25, F.col("p_retailprice"))).alias("small"), F.max(F.when(F.col("p_size") > 25, F.col("p_retailprice"))).alias("large"))


@query("SELECT l_orderkey, l_linenumber, l_discount - l_tax AS excess, l_extendedprice / nullif(l_quantity, 0) AS ratio FROM lineitem")
def excess_and_ratio(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") - F.col("l_tax")).alias("excess"), F.expr("try_divide(l_extendedprice, l_quantity)").alias("ratio"))


@query("SELECT vec_id, i AS pos, embedding[i] AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)")
def wide_to_long(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return e.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), "value")


@query("SELECT l_orderkey, l_linenumber, period, value FROM (SELECT l_orderkey, l_linenumber, unnest(['tax', 'discount']) AS period, unnest([l_tax, l_discount]) AS value FROM lineitem) WHERE value IS NOT NULL")
def ragged_zip(spark, sf):
    z = F.arrays_zip(F.array(F.lit("tax"), F.lit("discount")).alias("period"), F.array("l_tax", "l_discount").alias("value"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.inline(z).alias("period", "value")).filter("value is not null")


@query("SELECT l_orderkey, floor(l_quantity * 2 + 0.5) / 2 AS y, list(l_linenumber ORDER BY l_linenumber) AS cells FROM lineitem GROUP BY ALL")
def line_grouping(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey", T.half_steps(F.col("l_quantity")).alias("y")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("cells"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)promo') THEN 'promo' WHEN regexp_matches(p_type, '(?i)standard') THEN 'standard' ELSE 'other' END AS kind FROM part")
def classify_label(spark, sf):
    return t(spark, sf, "part").select("p_partkey", T.classify(F.col("p_type"), [("(?i)promo", "promo"), ("(?i)standard", "standard")], "other").alias("kind"))


@query("SELECT e.event_id, (SELECT max(o.ts) FROM events o WHERE o.event_type = 'purchase' AND o.ts <= e.ts) AS last_ts FROM events e")
def asof_lookup(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "event_type")
    known = e.filter("event_type = 'purchase'").select(F.col("ts").alias("at"), F.col("ts").alias("last_ts"))
    return R.asof(e.select("event_id", "ts"), known, "ts", "at", "last_ts").select("event_id", "last_ts")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'reviewed' ELSE s_name END AS s_name FROM supplier")
def override_merge(spark, sf):
    s = t(spark, sf, "supplier")
    fixes = s.filter("s_nationkey < 5").select("s_suppkey", F.lit("reviewed").alias("s_name"))
    return R.override(s, fixes, "s_suppkey", ["s_name"]).select("s_suppkey", "s_name")


@query("SELECT page_id, nullif(regexp_extract(url, '://([^/]+)', 1), '') AS host, list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) IS NOT NULL AS linked, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))::BIGINT AS n_links FROM pages")
def regex_extract(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return t(spark, sf, "pages").select("page_id", T.first_match(F.col("url"), "://([^/]+)").alias("host"), links.isNotNull().alias("linked"), F.size(links).cast("long").alias("n_links"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def loose_date_to_iso(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", T.iso_date(F.date_format("o_orderdate", "yyyy. M. d")).alias("iso"))


@query("SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.6, 0.8 + (l_tax - l_discount) * 10)) AS fee FROM lineitem")
def clamp_formula(spark, sf):
    x = F.lit(0.8) + (F.col("l_tax") - F.col("l_discount")) * 10
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.clamp(x, F.lit(0.0), F.lit(1.6)).alias("fee"))


@query("SELECT o_orderkey, (o_custkey * CASE WHEN o_orderstatus = 'F' THEN 100000000 ELSE 1000000 END)::BIGINT AS won FROM orders")
def unit_scaling(spark, sf):
    unit = F.when(F.col("o_orderstatus") == "F", "억원").otherwise("백만원")
    return t(spark, sf, "orders").select("o_orderkey", T.money(F.col("o_custkey"), unit).alias("won"))


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def backlog_anti(spark, sf):
    return R.orphans(t(spark, sf, "pages"), t(spark, sf, "labels"), "page_id", "doc_id").select("page_id")


@query("SELECT sha256(text) AS h, list(doc_id ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_registry(spark, sf):
    g = t(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.sort_array(F.collect_list("doc_id")).alias("members"))
    return g.filter(F.size("members") > 1)


@query("SELECT r_regionkey AS k, r_name AS name, 0 AS ordinal FROM region UNION ALL SELECT n_nationkey, n_name, 1 FROM nation")
def union_ordinal(spark, sf):
    return R.union_ordinal(t(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def except_resolved(spark, sf):
    return R.orphans(t(spark, sf, "nation"), t(spark, sf, "supplier"), "n_nationkey", "s_nationkey").select("n_nationkey")


@query("SELECT 'DOC' || lpad(doc_id::VARCHAR, 6, '0') AS id, source || '|' || lang AS pages FROM documents")
def surrogate_ids(spark, sf):
    return t(spark, sf, "documents").select(T.padded_id("DOC", F.col("doc_id")).alias("id"), T.union_pages(F.col("source"), F.col("lang"), F.col("source")).alias("pages"))


@query("""
WITH e AS (SELECT page_id, 'nav' AS name, 0 AS k, strpos(html, '<nav') AS place FROM pages UNION ALL SELECT page_id, 'table', 1, strpos(html, '<table') FROM pages UNION ALL SELECT page_id, 'list', 2, strpos(html, '<li>') FROM pages)
SELECT page_id, arg_max(name, place * 10 + k) FILTER (WHERE place > 0) AS section FROM e GROUP BY 1""")
def top_section(spark, sf):
    rules = [("nav", "<nav"), ("table", "<table"), ("list", "<li>")]
    return t(spark, sf, "pages").select("page_id", P.heading(F.col("html"), rules, {}).alias("section"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[?]') THEN 'question' WHEN regexp_matches(text, '[0-9]') AND role = 'user' THEN 'number' WHEN regexp_matches(text, ',') AND role <> 'user' THEN 'list' ELSE role END AS section FROM conversations")
def page_phrases(spark, sf):
    rules = [("question", "[?]", None, []), ("number", "[0-9]", ["user"], []), ("list", ",", None, ["user"])]
    return t(spark, sf, "conversations").select("conv_id", "turn", P.page_section(F.col("text"), F.col("role"), rules).alias("section"))


@query("SELECT doc_id FROM documents WHERE source IS NOT NULL AND length(text) >= 80 AND NOT (length(text) < 800 AND regexp_matches(text, 'license'))")
def pages_worth_keeping(spark, sf):
    return t(spark, sf, "documents").filter(P.worth_keeping(F.col("source"), F.col("text"), contents="license")).select("doc_id")


@query("SELECT page_id, i - 1 AS pos, parts[i + 1] AS segment, length(array_to_string(parts[1:i], '<li>')) AS at FROM (SELECT page_id, string_split(html, '<li>') AS parts FROM pages), unnest(range(1, len(parts))) AS u(i)")
def marker_segments(spark, sf):
    return X.segments(t(spark, sf, "pages"), "page_id", "html", "<(li)>").select("page_id", F.col("pos").cast("long"), "segment", F.col("at").cast("long"))


@query("""
SELECT l_orderkey, l_linenumber, 'INITIAL_FIXED_RATE' AS period_type, 'FIXED' AS rate_type, l_discount AS management_fee, round(l_tax + l_discount, 6) AS total_fee, round(l_tax + l_discount, 6) AS min_total_fee, round(l_tax + l_discount, 6) AS max_total_fee FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'PERFORMANCE_LINKED_RATE', 'FORMULA', NULL, NULL, round(l_tax, 6), round(l_tax + 1.6, 6) FROM lineitem""")
def fee_phases(spark, sf):
    return X.fee_phases(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_discount", ["l_tax"])


@query("""
WITH h AS (SELECT sha256(text) AS h, conv_id, count(*) AS n FROM conversations GROUP BY ALL), g AS (SELECT h, count(*) AS docs, count(*) FILTER (WHERE n > 1) AS within FROM h GROUP BY 1),
c AS (SELECT d.doc_id, count(v.conv_id) AS k, coalesce(bool_or(role = 'user') AND bool_or(role = 'assistant'), false) AS whole FROM documents d LEFT JOIN conversations v ON v.conv_id = d.doc_id GROUP BY 1)
SELECT 'chunks' AS metric, count(*)::BIGINT AS value FROM conversations UNION ALL SELECT 'empty_chunks', count(*) FROM conversations WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT 'within_document_duplicates', coalesce(sum(within), 0)::BIGINT FROM g UNION ALL SELECT 'cross_document_duplicates', count(*) FROM g WHERE docs > 1
UNION ALL SELECT 'documents', count(*) FROM c UNION ALL SELECT 'without_chunks', count(*) FROM c WHERE k = 0 UNION ALL SELECT 'missing_core_sections', count(*) FROM c WHERE NOT whole""")
def chunk_audit(spark, sf):
    chunks = t(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id")
    return P.chunk_audit(t(spark, sf, "documents"), chunks, "doc_id", "role", "text", ["user", "assistant"])


@query("SELECT conv_id, count(*) AS total_pages, nullif(regexp_extract(arg_min(text, turn), '^([A-Za-z]+)', 1), '') AS opening, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256, coalesce(list(turn ORDER BY turn) FILTER (WHERE regexp_matches(text, '[?]')), []) AS question_pages FROM conversations GROUP BY 1")
def scan_audit(spark, sf):
    return P.scan_audit(t(spark, sf, "conversations"), "conv_id", "turn", "text", {"opening": "^([A-Za-z]+)"}, {"question": "[?]"})


@query("WITH d AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date, max(o_orderkey) AS page FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY ALL) SELECT *, min(date) OVER (PARTITION BY o_custkey) = date AS earliest FROM d")
def inception_history(spark, sf):
    rows = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat_ws(" on ", "o_orderpriority", F.date_format("o_orderdate", "yyyy.MM.dd")).alias("line"))
    return P.history(rows, "o_custkey", "o_orderkey", "line", "^1", r"[0-9]{4}\.[0-9]{2}\.[0-9]{2}").withColumnRenamed("o_orderkey", "page")


@query("""
WITH f AS (SELECT o_custkey AS c_custkey, count(DISTINCT o_orderdate) AS n, min(strftime(o_orderdate, '%Y-%m-%d')) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s AS (SELECT c_custkey, d, CASE WHEN n IS NULL OR n > 1 OR d < '1996-01-01' THEN 'REVIEW_REQUIRED' ELSE 'ESTABLISHED' END AS status FROM customer LEFT JOIN f USING (c_custkey))
SELECT c_custkey, status, CASE WHEN status = 'ESTABLISHED' THEN d END AS date FROM s""")
def resolve_dates(spark, sf):
    found = t(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("ESTABLISHED").alias("status"))
    base = t(spark, sf, "customer").select("c_custkey", F.lit("1996-01-01").alias("floor"))
    return X.resolve(base, found, ["c_custkey"], "floor").select("c_custkey", "status", "date")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
