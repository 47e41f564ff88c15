"""Nearest-path page differencing, the method named for problem 1.

Pages are paired by path within each notebook (the host of a page's path): a page's mate is the neighbour in path
order with the longer common path. The lines of both are aligned by longest common subsequence, and the lines
they share are deleted. What pages of one place repeat (banners, footers) goes; what is a page's own stays.

It is kept beside :mod:`markup` for that. It can't give what problem 1 asks: a notation in a shared line goes with the line, and pages
that say the same lose all of it. README.md has the measured loss.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.session import cut

RESIDUE = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_shared", T.IntegerType())])


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of both line lists, by dynamic programming over the part that differs.

    Equal lines at both ends are always in one. Empty lines are never shared.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    kept = {*range(head), *range(len(a) - tail, len(a))}
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y and not set(x).isdisjoint(y):
        kept |= {head + i for i in _subsequence(x, y)}
    return {i for i in kept if a[i].strip()}


def _subsequence(x: list[str], y: list[str]) -> list[int]:
    """Places in ``x`` of a longest common subsequence: the longest rising chain of places in ``y`` (Hunt and Szymanski)."""
    places: dict[str, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j], []).append(j)
    ends: list[int] = []  # the smallest last place of a chain of each length
    chain: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(x):
        for j in places.get(line, ()):
            k = bisect_left(ends, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(node)
            else:
                ends[k] = j
                chain[k] = node
    node = chain[-1] if chain else None
    out = []
    while node:
        out.append(node[0])
        node = node[1]
    return out


def residue(text: str | None, mate: str | None) -> tuple[str | None, int, int]:
    """(the text without the lines that its mate shares, number of lines, number of shared lines)."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    gone = shared_lines(lines, mate.split("\n")) if mate else set()
    return "\n".join(t for i, t in enumerate(lines) if i not in gone), len(lines), len(gone)


@F.pandas_udf(RESIDUE)
def residues(texts: pd.Series, mates: pd.Series) -> pd.DataFrame:
    rows = [residue(t if isinstance(t, str) else None, m if isinstance(m, str) else None) for t, m in zip(texts, mates)]
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_shared"])


def mates(pages: DataFrame, key: str, host: str, path: str) -> DataFrame:
    """(key, mate) of pages that have a neighbour in their host: the one before or after in path order that shares more of the path, the earlier on ties.

    Keys are unique. The order is one over all hosts, cut into ranges of rows, so a host with a third of all pages is many tasks: a row's
    place is its number within its range, and only the first and last row of each range meet the ranges beside it.
    """
    rows = pages.select(F.col(key).alias("key"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    ranged = cut(rows.repartitionByRange("host", "path", "key").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy("host", "path", "key")
    here = F.struct("host", "path", "key")
    near = ranged.withColumn("before", F.lag(here).over(inside)).withColumn("after", F.lead(here).over(inside))
    # the neighbours of a range's ends are the ends of the ranges beside it: two rows a range
    ends = ranged.groupBy("range").agg(F.min(here).alias("low"), F.max(here).alias("high"))
    order = Window.orderBy("low")
    ends = ends.select("range", F.lag("high").over(order).alias("high_before"), F.lead("low").over(order).alias("low_after"))
    near = near.join(ends, "range").withColumn("before", F.coalesce("before", "high_before")).withColumn("after", F.coalesce("after", "low_after"))
    before, after = _common(F.col("before")), _common(F.col("after"))
    pick = F.when((before >= 0) & (before >= after), F.col("before.key")).when(after >= 0, F.col("after.key"))
    return near.select(F.col("key").alias(key), pick.alias("mate")).where("mate is not null")


def _common(other):
    """Characters that two paths of one host share from the start; -1 for none or another host."""
    parts = F.transform(F.arrays_zip(F.split("path", "").alias("a"), F.split(other["path"], "").alias("b")), lambda p: p["a"].eqNullSafe(p["b"]))
    first_off = F.array_position(parts, F.lit(False))
    shared = F.when(first_off == 0, F.size(parts)).otherwise(first_off - 1)
    return F.when(other.isNotNull() & (other["host"] == F.col("host")), shared).otherwise(-1)


def difference(pages: DataFrame, key: str, host: str, path: str, body: str) -> DataFrame:
    """(key, text, n_lines, n_shared) of every page: its body without the lines it shares with its mate.

    Keys are unique. NULL bodies give NULL, empty ones stay empty, a page alone in its host keeps all lines; rows are
    neither added nor dropped, and other columns are ignored.
    """
    paired = pages.select(key, body).join(mates(pages, key, host, path), key, "left")
    other = pages.select(F.col(key).alias("mate"), F.col(body).alias("mate_body"))
    both = paired.join(other, "mate", "left").withColumn("r", residues(F.col(body), F.col("mate_body")))
    return both.select(key, "r.text", "r.n_lines", "r.n_shared")
