"""Joins of rows with the evidence for them, and the table of text chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import padded_id, union_pages
from papyra.operators.relational import keep_first
from papyra.scratch import settle


def nested_lookup(base: DataFrame, evidence: DataFrame, base_key: str, key: str, nested: str, defaults: dict) -> DataFrame:
    """``base`` with the fields of the evidence struct ``nested``; a field without evidence takes its default or stays null. Keys of evidence are unique."""
    found = evidence.select(F.col(key).alias("evidence_key"), F.col(nested).alias("evidence_of_key"))
    joined = base.join(found, F.col(base_key) == F.col("evidence_key"), "left")
    fields = evidence.schema[nested].dataType.names
    return joined.select(*[joined[c] for c in base.columns], *[F.coalesce(f"evidence_of_key.{f}", F.lit(defaults[f])).alias(f) if f in defaults else F.col(f"evidence_of_key.{f}").alias(f) for f in fields])


def strict(base: DataFrame, evidence: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``base`` with ``value`` of the evidence, null values too; a row without evidence fails the query and names its key, whichever columns are read."""
    joined = base.join(evidence.select(*keys, F.col(value).alias("strict_value"), F.lit(True).alias("strict_hit")), keys, "left")
    miss = F.raise_error(F.concat(F.lit("no evidence for "), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])))
    # A filter isn't pruned when the value isn't read.
    found = joined.filter(F.when(F.col("strict_hit").isNull(), miss.cast("boolean")).otherwise(True))
    return found.withColumn(value, F.col("strict_value")).drop("strict_value", "strict_hit")


def two_tier(base: DataFrame, first: DataFrame, first_key: str, second: DataFrame, second_key: str, name: str) -> DataFrame:
    """``base`` with ``value`` of the first table, else of the second, and which tier it came from."""
    joined = base.join(first.select(first_key, F.col("value").alias("tier1")), first_key, "left").join(second.select(second_key, F.col("value").alias("tier2")), second_key, "left")
    tier = F.when(F.col("tier1").isNotNull(), "hit").when(F.col("tier2").isNotNull(), "fallback")
    return joined.withColumn(name, F.coalesce("tier1", "tier2")).withColumn("tier", tier).drop("tier1", "tier2")


def override(base: DataFrame, fixes: DataFrame, keys: list[str], replace=(), union=(), append=()) -> DataFrame:
    """``base`` where fixes win: values replaced, arrays (pages) united in order, texts appended. A null fix changes nothing; fixes have unique keys."""
    own = fixes.select(*keys, *[F.col(c).alias(f"fix_{c}") for c in (*replace, *union, *append)])
    joined, new = base.join(own, keys, "left"), {}
    for c in replace:
        new[c] = F.coalesce(f"fix_{c}", c)
    for c in union:
        new[c] = F.array_sort(F.array_union(F.coalesce(c, f"fix_{c}"), F.coalesce(f"fix_{c}", c)))
    for c in append:
        new[c] = F.concat_ws(" ", c, f"fix_{c}")
    return joined.withColumns(new).select(*base.columns)


def status_with_overrides(funds: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """``funds`` (key, inception_date, source_page, source_text) with status and scheduled date.

    A fund with a date is ESTABLISHED, one without NOT_DISCLOSED. A fix, one a
    key, replaces date, status and schedule, nulls too; its pages are united
    with the fund's and its text is joined on behind them.
    """
    named = {c: f"fix_{c}" for c in ("inception_date", "inception_status", "inception_scheduled_date", "source_page", "source_text")}
    joined = funds.join(fixes.select(key, *[F.col(c).alias(n) for c, n in named.items()], F.lit(True).alias("fixed")), key, "left")
    fixed = F.col("fixed").isNotNull()
    note = F.concat(F.coalesce("source_text", F.lit("")), F.lit(" | [p."), F.col("fix_source_page"), F.lit("] "), F.col("fix_source_text"))
    return joined.select(
        key, F.when(fixed, F.col("fix_inception_date")).otherwise(F.col("inception_date")).alias("inception_date"),
        F.when(fixed, F.col("fix_inception_status")).when(F.coalesce("inception_date", F.lit("")) == "", "NOT_DISCLOSED").otherwise("ESTABLISHED").alias("inception_status"),
        F.col("fix_inception_scheduled_date").alias("inception_scheduled_date"), union_pages("source_page", "fix_source_page").alias("source_page"), F.when(fixed, note).otherwise(F.col("source_text")).alias("source_text"),
    )


def names_in(texts: DataFrame, text: str, pattern: str) -> DataFrame:
    """The distinct ``name``s that group 1 of the pattern finds in the texts: the build side of a join by contained name."""
    return texts.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("name")).distinct()


def backlog(files: DataFrame, done: DataFrame, duplicates: DataFrame, name: str = "file_name") -> DataFrame:
    """The files whose name no row of ``done`` has, each with ``duplicate``: whether its name is among ``duplicates``. Files without a name are in no list."""
    left = files.join(done.select(F.col(name).alias("done_name")), F.col(name) == F.col("done_name"), "left_anti")
    flagged = duplicates.select(F.col(name).alias("same_name"), F.lit(True).alias("flag")).distinct()
    return left.join(flagged, F.col(name) == F.col("same_name"), "left").select(*files.columns, F.coalesce("flag", F.lit(False)).alias("duplicate"))


def count_map(rows: DataFrame, key: str, of: str, name: str) -> DataFrame:
    """(key, name): how many rows each value of ``of`` has, as a map; null values count under no key."""
    each = rows.filter(F.col(of).isNotNull()).groupBy(key, of).agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(of, "n")))).alias(name))


def missing_of(rows: DataFrame, key: str, of: str, core: list[str]) -> DataFrame:
    """(key, missing): which of ``core`` none of the key's rows has."""
    has = [F.max(F.when(F.col(of) == x, F.lit(x))).alias(f"has_{k}") for k, x in enumerate(core)]
    flat = rows.groupBy(key).agg(*has)
    return flat.select(key, F.array_compact(F.array(*[F.when(F.col(f"has_{k}").isNull(), F.lit(x)) for k, x in enumerate(core)])).alias("missing"))


def numbered(rows: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """``rows`` with a number from 1 in the given order, without one window over all of them.

    The rows are dealt to ranges of the order and written; ranges are counted,
    and a row's number is its place in its range after those before. Rows that
    are equal in the whole order are numbered among each other in any order.
    """
    ranged = settle(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("range_no", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("range_no").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("range_no").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    out = ranged.withColumn("place", within).join(F.broadcast(sizes.select("range_no", before.alias("before"))), "range_no")
    return out.withColumn(name, (F.col("before") + F.col("place")).cast("long")).drop("range_no", "place", "before")


def chunk_table(kinds: list[DataFrame], prefix: str, parts=lambda body: F.array(body), keep_by: list[str] | None = None) -> DataFrame:
    """Chunks of several kinds (kind, doc, page, body) as one table: parts from 1, one sequence over all in order of kind, document, page and part, ids and hashes.

    Columns that a kind lacks are null, further ones (provenance) stay.
    ``parts`` cuts a body. With ``keep_by`` only the first of the chunks with
    equal text and equal ``keep_by`` stays, and the sequence has no gaps. Ids
    have six digits, or more where the sequence is longer.
    """
    given = [k.withColumn("ordinal", F.lit(i)) for i, k in enumerate(kinds)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), given)
    cut = rows.select("*", F.posexplode(parts(F.col("body"))).alias("pos", "piece")).withColumn("part", F.col("pos") + 1).withColumn("body", F.col("piece")).drop("pos", "piece")
    order, columns = ["ordinal", "doc", "page", "part"], [c for c in cut.columns if c != "ordinal"]
    cut = cut.withColumn("chunk_hash", F.sha2("body", 256))
    if keep_by is not None:
        cut = keep_first(cut, [*keep_by, "chunk_hash"], order)
    out = numbered(cut, order)
    return out.select("seq", padded_id(prefix, F.col("seq")).alias("chunk_id"), *columns, "chunk_hash")
