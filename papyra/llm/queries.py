"""The registered queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import chat, decontaminate, divergence, filter_audit, language, licenses, line_dedup, mixing, ngram_join, prefix_counts, quality, substrings, tokens
from papyra.scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokens.write(table(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=2)
    return tokens.documents(tokens.read(spark, path))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.counts(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, k, r, r"\### Assistant: </turn> ok") for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    path = new_path(spark, "chat")
    chat.render(rows).write.parquet(path)
    return chat.digest(spark.read.parquet(path)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"), all_lines=True)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), length=200, keep_bytes=False).drop("kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), language.train(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_mask = filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(filter_audit.joint_failures(by_mask))


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "prefix-counts")
    prefix_counts.index(table(spark, sf_dir, "documents"), tokenizer_file()).write.option("compression", "zstd").parquet(path)
    stored = prefix_counts.truncate(spark.read.schema(prefix_counts.FORMAT).parquet(path), budget=2048)
    return stored.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fit_chars", "fit_tokens")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_wavelet_tokens, op2_mix_sources, op3_chat_format, op4_ngram_jaccard, op5_license_scan, op6_decontaminate, op7_line_dedup, op8_substring_dedup, op9_language_id, op10_quality_rules, op11_filter_audit, op12_prefix_counts, op13_source_divergence)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ESCAPE = r"replace(replace(replace({}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

OP2 = r"""
WITH d AS (
  SELECT doc_id, source,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce('t' || text, '')) AS tie
  FROM documents),
h AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || tie), 1, 8))::BIGINT AS hash FROM d),
s AS (SELECT skey, sum(size)::BIGINT AS source_size, count(*) AS n FROM h GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::BIGINT] AS weight, 2.0::DOUBLE * source_size AS full_size FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY full_size / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT skey, source_size, n,
    CASE WHEN full_size / weight <= level THEN full_size ELSE weight * min(CASE WHEN full_size / weight > level THEN level END) OVER () END AS target,
    greatest(ceil(n / 1024.0), 1)::BIGINT AS buckets,
    ('0x' || substr(md5('11:' || skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM l),
p AS (SELECT h.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, t.off,
    row_number() OVER (PARTITION BY h.skey ORDER BY h.hash % t.buckets, size, doc_id NULLS FIRST, tie) AS place
  FROM h JOIN t USING (skey)),
c AS (SELECT *, (floor(place * rate + off) - floor((place - 1) * rate + off))::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target::DOUBLE AS target, copies * size AS taken, copies FROM c
"""

OP3 = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length('### ') + length(replace({_ESCAPE.format("role")}, ':', '\:')) + length(': ') + length({_ESCAPE.format("text")}) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS g FROM d, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS node, y AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(seen) AS c FROM r GROUP BY 1) m ON m.node = d.doc_id
"""

OP6 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
dw AS (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw) AS z, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT k, count(DISTINCT p)::BIGINT AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY k),
items AS (SELECT k, count(DISTINCT item_id)::BIGINT AS n_items, sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS sha FROM hit GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)} AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, good, toxic, fails, count(*)::BIGINT AS n FROM f GROUP BY ALL),
z AS (SELECT unnest(string_split('ABCDE', '')) AS z),
o AS (SELECT a.z || b.z || c.z || d.z || e.z AS filter_order FROM z a, z b, z c, z d, z e
  WHERE len(list_distinct([a.z, b.z, c.z, d.z, e.z])) = 5),
s AS (SELECT part, good, toxic, n, fails, filter_order, step, filter_order[step] AS f, len(list_filter(string_split(filter_order[1 : step - 1], ''), lambda x: x <> '' AND fails[x])) > 0 AS gone
  FROM g, o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, filter_order, step::INT AS step, f,
    sum(CASE WHEN NOT gone AND NOT fails[f] THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails[f] THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND fails[f] THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails[f] AND len(list_filter(map_values(fails), lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND fails[f] AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails[f] AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, {_LOWER} AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
kept AS (SELECT lang, t FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN kept USING (lang, t) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.t, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0)::HUGEINT + 5 * v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // ((sum(sum(n)) OVER (PARTITION BY lang))::HUGEINT + 5 * (count(*) OVER (PARTITION BY lang))) AS q FROM c GROUP BY lang, t),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((
    SELECT sum(abs(x.p - y.p)) FROM p AS x JOIN p AS y ON y.lang = a.lang AND y.source = b.source AND y.t = x.t WHERE x.lang = a.lang AND x.source = a.source), 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, p - q AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
r AS (SELECT * FROM pair UNION ALL SELECT * FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2, "op3_chat_format": OP3, "op4_ngram_jaccard": OP4, "op6_decontaminate": OP6, "op11_filter_audit": OP11, "op13_source_divergence": OP13}
