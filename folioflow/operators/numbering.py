"""Ordered numbering: pages, lists, chunks, repeated names and bounded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_numbers(pages: DataFrame, folder: list[str], order: list[str]) -> DataFrame:
    """``n`` from 1 within the folder, and ``label`` with at least two digits."""
    n = F.row_number().over(Window.partitionBy(*folder).orderBy(*order))
    return pages.withColumn("n", n).withColumn("label", F.format_string("%02d", n))


def list_ordinals(lines: DataFrame, group: list[str], order: str, numbered: Column, reset: bool) -> DataFrame:
    """``ordinal`` of numbered siblings, 0 for others; with ``reset`` a sibling without number starts anew.

    Gaps and islands: the count of breaks so far names the island, the count of numbered siblings in it the ordinal.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_num = numbered.cast("int")
    if not reset:
        return lines.withColumn("ordinal", F.when(numbered, F.sum(is_num).over(w)).otherwise(F.lit(0)))
    marked = lines.withColumn("__island", F.sum(1 - is_num).over(w))
    inner = Window.partitionBy(*group, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("ordinal", F.when(numbered, F.sum(is_num).over(inner)).otherwise(F.lit(0))).drop("__island")


def chunk_numbers(pages: DataFrame, parent: str, start: Column, number: Column) -> DataFrame:
    """``new_number`` of pages merged from chunked folders (`Pages 101-200`), padded to the widest of the parent."""
    n = (start - 1 + number).cast("bigint")
    width = F.greatest(F.lit(2), F.length(F.max(n).over(Window.partitionBy(parent)).cast("string")))
    return pages.withColumn("__n", n).withColumn("__w", width).withColumn("new_number", F.expr("lpad(cast(__n as string), __w, '0')")).drop("__n", "__w")


def repeated_names(rows: DataFrame, holder: str, name: str, order: list[str]) -> DataFrame:
    """``unique_name``: the second and later rows of a holder with the same name get its count behind it."""
    n = F.row_number().over(Window.partitionBy(holder, name).orderBy(*order))
    return rows.withColumn("unique_name", F.when(n > 1, F.concat_ws(" ", F.col(name), n.cast("string"))).otherwise(F.col(name)))


def bounded_lists(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with ``n``; Spark prunes each task's rows before the shuffle. The remainder is counted by :func:`remainders`."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("n", n).where(F.col("n") <= limit)


def remainders(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """(group, n_rows, n_more) of lists cut at ``limit``."""
    return rows.groupBy(group).agg(F.count("*").alias("n_rows")).withColumn("n_more", F.greatest(F.lit(0), F.col("n_rows") - limit))
