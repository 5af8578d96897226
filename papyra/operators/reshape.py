"""Vectors and maps of measures as rows, and ids by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled(values: Column, labels: dict[int, list[str]] | Column) -> Column:
    """An array of (label, value) of a vector: the labels of its length, or a column's own.

    Positions mean nothing by themselves (four values may be the first four
    periods, or leave out one in between), so a vector of a length without
    labels, or of another length than its own labels, is an error.
    """
    pairs = lambda names: F.zip_with(names, values, lambda n, v: F.struct(n.alias("label"), v.alias("value")))
    wrong = F.raise_error(F.concat(F.lit("no labels for a vector of "), F.size(values).cast("string"), F.lit(" values")))
    if isinstance(labels, Column):
        return F.when(F.size(labels) == F.size(values), pairs(labels)).when(values.isNotNull(), wrong.cast("array<struct<label:string,value:double>>"))
    known = reduce(lambda e, kv: F.when(F.size(values) == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(e), labels.items(), wrong.cast("array<string>"))
    return F.when(values.isNotNull(), pairs(known))


def vector_rows(df: DataFrame, key: list[str], values: str, labels: dict[int, list[str]] | Column, beside: str | None = None, default: list | None = None) -> DataFrame:
    """(key.., label, value, beside): a row per value that isn't null; ``beside`` is a second vector by position, taken from ``default`` where a row has none."""
    named = labelled(F.col(values).cast("array<double>"), labels)
    second = F.lit(None).cast("array<double>") if beside is None else F.col(beside).cast("array<double>")
    if default is not None:
        second = F.coalesce(second, F.array(*[F.lit(x).cast("double") for x in default]))
    rows = df.select(*key, second.alias("__b"), F.posexplode(named).alias("__p", "__v"))
    return rows.select(*key, "__v.label", "__v.value", F.get("__b", F.col("__p")).alias("beside")).filter("value is not null")


def measure_rows(df: DataFrame, key: list[str], measures: str, names: dict[str, str]) -> DataFrame:
    """(key.., label, value, beside) of a map from a measure's name to (value, beside); a name that ``names`` doesn't know is an error."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    label = F.coalesce(known[F.col("__k")], F.raise_error(F.concat(F.lit("unknown measure "), F.col("__k"))).cast("string"))
    return df.select(*key, F.explode(measures).alias("__k", "__v")).select(*key, label.alias("label"), F.col("__v")[df.schema[measures].dataType.valueType.names[0]].alias("value"), F.col("__v")[df.schema[measures].dataType.valueType.names[1]].alias("beside"))


def position_ids(df: DataFrame, group: str, order: list[str], starts: DataFrame, start: str, prefix: str, width: int = 6) -> DataFrame:
    """``df`` with ``id``: prefix and the group's start number plus the row's place in the group (from 0). Groups without a start give no rows."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    number = (F.col("__start") + place).cast("string")
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    joined = df.join(starts.select(group, F.col(start).alias("__start")), group)
    return joined.withColumn("id", F.concat(F.lit(prefix), padded)).select(*df.columns, "id")


def exact_components(df: DataFrame, total: str, known: dict[str, float], rest: str, where: Column, digits: int = 3) -> DataFrame:
    """Fee components of the rows for which ``where`` holds and a total is given: ``known`` as they are, ``rest`` what is left of the total; elsewhere all, the total too, are null."""
    exact = where & F.col(total).isNotNull()
    left = F.round(F.col(total) - sum(known.values()), digits)
    return df.withColumns({c: F.when(exact, F.lit(v)) for c, v in known.items()} | {rest: F.when(exact, left), total: F.when(exact, F.col(total))})
