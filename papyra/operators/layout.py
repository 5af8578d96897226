"""Positioned text put into lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import half_steps


def lines(cells: DataFrame, page: list[str], x: str = "x", y: str = "y", text: str = "str") -> DataFrame:
    """(page.., line, y, cells): the cells of each line, by their height to the nearest half, from the top, each line from left to right.

    Cells of one place go by their text. A line is as many cells as stand at
    one height of one page. Rows without a height or a place have no line.
    """
    placed = cells.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__y", half_steps(F.col(y)))
    each = placed.groupBy(*page, "__y").agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("str")))).alias("cells"))
    number = F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("__y")))
    return each.select(*page, number.alias("line"), F.col("__y").alias("y"), "cells")
