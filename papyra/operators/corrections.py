"""Reviewed corrections of records, applied in order, with a log of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def patch_log(base: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, seq, value, source, replaced, status) of each patch, in the order of ``seq`` within a record's field.

    ``replaced`` is what the patch found there: the base value or that of the
    patch before. Status is APPLIED for the last one, OVERRULED for one that a
    later one replaced by another value, CONFIRMED for one that a later one
    repeats, ORPHAN without a record and UNKNOWN_FIELD for a field that isn't
    among ``fields``. Patches of equal ``seq`` go by value.
    """
    known = F.col("field").isin(*fields)
    pairs = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("string") for f in fields]))
    records = base.select(F.col(key).alias("__k"), pairs.alias("__was"))
    within = Window.partitionBy(key, "field").orderBy("seq", "value")
    joined = patches.select(key, "field", "seq", "value", "source").join(records, F.col(key) == F.col("__k"), "left")
    there = F.col("__k").isNotNull() & known
    before, after = F.lag("value").over(within), F.lead(F.struct("value")).over(within)
    place = F.row_number().over(within)
    status = (
        F.when(F.col("__k").isNull(), "ORPHAN").when(~known, "UNKNOWN_FIELD").when(after.isNull(), "APPLIED").when(after["value"].eqNullSafe(F.col("value")), "CONFIRMED").otherwise("OVERRULED")
    )
    replaced = F.when(there, F.when(place == 1, F.col("__was")[F.col("field")]).otherwise(before))
    return joined.select(key, "field", "seq", "value", "source", replaced.alias("replaced"), status.alias("status"))


def corrected(base: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` with the last patch of each record's field in place, and ``sources``: where each patched field's value is from, as a map.

    A patch may set a field to null. Values are cast to the field's own type,
    and one that doesn't fit fails the query. Base rows with a null or equal
    key: the former keep their values, the latter are all patched.
    """
    last = patches.filter(F.col("field").isin(*fields)).groupBy(key, "field").agg(F.max_by(F.struct("value", "source"), F.struct("seq", "value")).alias("p"))
    wide = last.groupBy(F.col(key).alias("__k")).agg(F.map_from_entries(F.collect_list(F.struct("field", "p"))).alias("__p"))  # one entry a field
    joined = base.join(wide, base[key] == F.col("__k"), "left")
    has = lambda f: F.coalesce(F.map_contains_key("__p", F.lit(f)), F.lit(False))
    kinds = dict(base.dtypes)
    columns = [F.when(has(c), F.col("__p")[c]["value"].cast(kinds[c])).otherwise(base[c]).alias(c) if c in fields else base[c] for c in base.columns]
    sources = F.transform_values(F.coalesce("__p", F.expr("map()").cast("map<string,struct<value:string,source:string>>")), lambda _, v: v["source"])
    return joined.select(*columns, sources.alias("sources"))


def open_issues(issues: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """The issues (key, field) that no applied or confirmed patch has settled."""
    settled = log.filter("status in ('APPLIED', 'CONFIRMED')").select(key, "field").distinct()
    return issues.join(settled, [key, "field"], "left_anti")
