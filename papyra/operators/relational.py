"""Keyed enrichment, deduplication, profiling and reshaping over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.scratch import settle


def keep_first(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in a total order."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("__rn = 1").drop("__rn")


def enrich(df: DataFrame, evidence: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Left join to evidence of which the last row per key wins."""
    return df.join(keep_first(evidence, keys, order, last=True).drop(*[c for c in order if c not in keys]), keys, "left")


def override(df: DataFrame, fixes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of reviewed rows win over the table's own."""
    f = fixes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.join(f, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def union_ordinal(*tables: DataFrame) -> DataFrame:
    """Union of tables with the number of the source each row is from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("ordinal", F.lit(k)) for k, t in enumerate(tables)])


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, rate) of blank values, 4 places; 0 over an empty table. One pass."""
    miss = lambda c: F.avg(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1.0).otherwise(0.0))
    wide = df.agg(*[F.round(F.coalesce(miss(c), F.lit(0.0)), 4).alias(c) for c in columns])
    return wide.unpivot([], columns, "metric", "rate")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n) with blanks under NULL."""
    v = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("NULL"))
    return df.groupBy(v.alias("value")).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that stand several times.

    Rows are dealt by key before they are counted: nearly all keys differ, and
    a task that counts what it scans would hold all keys of its part of the file.
    The number of partitions is given, as Spark would join them up to some bytes
    as compressed, which take many times that in a task's table of keys.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*keys).repartition(parts, *keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def repeated_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that repeat an earlier one's key, in a total order: all but the first of each key. Null keys are equal to each other.

    Only rows of keys that stand several times are sorted.
    """
    twice = duplicates(df, keys).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(twice[f"__k{i}"]) for i, c in enumerate(keys)])
    of = df.join(twice, same, "left_semi").withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return of.filter("__rn > 1").drop("__rn")


def carry_forward(df: DataFrame, group: str, order: str, event: Column, value: Column, spans: dict[str, int], reset: Column | None = None) -> DataFrame:
    """Column ``state``: the last event's value, cleared by a reset, and ended once the order has moved on by the value's span. An event wins over a reset on its own row."""
    w = Window.partitionBy(group).orderBy(order)
    mark = F.when(event, F.struct(value.alias("v"), F.col(order).alias("at")))
    if reset is not None:
        mark = mark.when(reset, F.struct(F.lit(None).cast("string").alias("v"), F.col(order).alias("at")))
    out = df.withColumn("__m", F.last(mark, ignorenulls=True).over(w))
    span = reduce(lambda e, kv: F.when(F.col("__m.v") == kv[0], kv[1]).otherwise(e), spans.items(), F.lit(None).cast("int"))
    alive = span.isNull() | (F.col(order) - F.col("__m.at") < span)
    return out.withColumn("state", F.when(alive, F.col("__m.v"))).drop("__m")


def asof(points: DataFrame, events: DataFrame, left_on: str, right_on: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Each point with the value of the latest event at or before it (of equal keys ``by``), by one sorted union instead of a range join.

    Points and events are dealt to ranges of their whole order, so neither a
    crowded day nor a crowded key stays in one task, and written. A window runs
    within each range; what the ranges before it end with, one row each, goes
    on into a range's first key. Of events at one time the largest value
    counts; null times and null keys have none, and a null value hides earlier
    ones no more than a missing event.
    """
    by = by or []
    keys = [f"__by{k}" for k in range(len(by))]
    e = events.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(right_on).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__k"), F.lit(0).cast("long").alias("__h"))
    e = e.filter(" and ".join(f"{c} is not null" for c in (*keys, "__t", "__v")))
    own = points.columns
    p = points.withColumns({k: F.col(c) for c, k in zip(by, keys, strict=True)} | {"__t": F.col(left_on), "__v": F.lit(None).cast(events.schema[value].dataType), "__k": F.lit(1), "__h": F.xxhash64(*own)})
    order = [*keys, "__t", "__k", "__v", "__h"]
    ranged = settle(p.unionByName(e, allowMissingColumns=True).repartitionByRange(*order).withColumn("__r", F.spark_partition_id()), "asof")
    key = F.struct(*keys) if keys else F.lit(0)
    within = Window.partitionBy("__r", *keys).orderBy("__t", "__k", "__v", "__h").rowsBetween(Window.unboundedPreceding, 0)
    # Each range's first and last key, and the last value of the last key.
    last = F.max(F.when(F.col("__k") == 0, F.struct(*keys, "__t", "__v")))
    ends = ranged.groupBy("__r").agg(F.min(key).alias("first"), F.max(key).alias("end"), last.alias("l"))
    mine = F.when(F.struct(*[F.col("l")[k] for k in keys]) == F.col("end"), F.col("l.__v")) if keys else F.col("l.__v")
    ends = ends.select("__r", "first", "end", mine.alias("v"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("v").isNotNull(), F.struct(F.col("end").alias("k"), F.col("v").alias("v"))), ignorenulls=True).over(before)
    ends = ends.select("__r", "first", carried.alias("c")).filter("c.k = first").select("__r", "first", F.col("c.v").alias("__before"))
    now = ranged.withColumn("__now", F.last("__v", ignorenulls=True).over(within)).filter("__k = 1")
    out = now.join(F.broadcast(ends), (now["__r"] == ends["__r"]) & (key == F.col("first")), "left")  # one row a range
    return out.withColumn("__got", F.coalesce("__now", "__before")).select(*own, F.col("__got").alias(value))


def violations(*rules: tuple[str, str, DataFrame, Column]) -> DataFrame:
    """Rules (id, table, broken rows, key) as one table (rule_id, table_name, key)."""
    parts = [rows.select(F.lit(rule).alias("rule_id"), F.lit(table).alias("table_name"), key.cast("string").alias("key")) for rule, table, rows, key in rules]
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """The child rows without a parent. The parent's keys aren't made distinct first, as a task would hold all it scans."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
