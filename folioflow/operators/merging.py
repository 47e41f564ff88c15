"""Last-writer-wins merges, positional zips, duplicates, clashes and shared folders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import common_parts, dirname, extension, stem


def last_writer(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row a key: each value from the latest row, in the order given. One aggregate with map-side combine, no sort, no window."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, F.struct(*order)).alias(v) for v in values])


def last_writer_by_part(rows: DataFrame, keys: list[str], part: str, order: list[str], value: str, parts: dict[int, str]) -> DataFrame:
    """One row a key with a column a part: the latest value of that part (partitions of an object's revisions)."""
    wins = [F.max(F.when(F.col(part) == p, F.struct(*order, F.col(value).alias("v"))))["v"].alias(name) for p, name in parts.items()]
    return rows.groupBy(*keys).agg(*wins)


def zip_positions(a: Column, b: Column, names: tuple[str, str] = ("a", "b")) -> Column:
    """Array of structs of the i-th elements; the shorter side ends in NULLs."""
    return F.arrays_zip(a.alias(names[0]), b.alias(names[1]))


def resolve_references(holders: DataFrame, key: str, refs: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Each reference with its position, joined to its target; unknown and NULL references are dropped, order stays in ``pos``."""
    exploded = holders.select(key, F.posexplode(refs).alias("pos", "ref"))
    return exploded.join(targets, F.col("ref") == F.col(target_key), "inner")


def first_of_copies(rows: DataFrame, keys: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """The first row of each group of copies, and how many there are; rows with a NULL key are one group."""
    first = F.min(F.struct(*order, *[k for k in kept if k not in order])).alias("first")
    return rows.groupBy(*keys).agg(first, F.count("*").alias("n_copies")).select(*keys, *[F.col(f"first.{k}").alias(k) for k in kept], "n_copies")


def clash_suffix(rows: DataFrame, path: str, key: Column, order: list[str]) -> DataFrame:
    """``final``: the path, with ` (2)`, ` (3)` ... before the extension for all but the first holder of a key.

    One pass: a made name may clash with a given one; :func:`settle_clashes` repeats until none does.
    """
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    folder, base, ext = dirname(path), stem(path), extension(path)
    made = F.concat(F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/"))), base, F.lit(" ("), n.cast("string"), F.lit(")"), ext)
    return rows.withColumn("rank", n).withColumn("final", F.when(n == 1, F.col(path)).otherwise(made))


COUNTED, DASHED = (" (", ")", 2), ("-", "", 1)  # what stands around a number that sets names apart, and the first number


def free_numbers(losers: DataFrame, taken: DataFrame, form: tuple[str, str, int] = COUNTED) -> DataFrame:
    """``n`` of each loser: the smallest numbers from the form's first on that no taken name of the same head and tail bears, in order of ``orig``."""
    before, behind, first = (re.escape(form[0]), re.escape(form[1]), form[2])
    # keys that a number was put into: of names without and with an extension
    keys = [rf"(?s)^(.*){before}([1-9]\d*){behind}{tail}\z" for tail in ("()", r"(\.[^./]*)")]
    parts = [F.struct(F.regexp_extract("k", p, 1).alias("kh"), F.regexp_extract("k", p, 3).alias("kt"), F.regexp_extract("k", p, 2).try_cast("bigint").alias("h")) for p in keys]
    held = taken.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where(F.col("h") >= first)
    held = held.join(losers.select("kh", "kt").distinct(), ["kh", "kt"], "left_semi").distinct()
    w = Window.partitionBy("kh", "kt")
    # the j-th taken number h leaves h - first + 1 - j free ones below it; a loser passes all taken numbers with fewer free ones than its rank
    skips = held.select("kh", "kt", (F.col("h") - first + 1 - F.row_number().over(w.orderBy("h"))).alias("at"), F.lit(1).alias("skip"))
    asks = losers.select("orig", "head", "tail", "kh", "kt", F.row_number().over(w.orderBy("orig")).cast("bigint").alias("at"), F.lit(0).alias("skip"))
    both = asks.unionByName(skips, allowMissingColumns=True)
    n = F.col("at") + first - 1 + F.sum("skip").over(w.orderBy("at", "skip").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("n", n).where("skip = 0").drop("at", "skip")


def settle_names(wanted: DataFrame, taken: DataFrame, key, form: tuple[str, str, int] = COUNTED) -> DataFrame:
    """(orig, final) of (orig, head, tail): head + tail where no other name has that key (k of ``taken``), else head + a number in its form, ` (n)`, + tail.

    ``key`` maps a Column to its comparison key. Names are given in order of ``orig``. All losers of a name get
    different free numbers at once, so two rounds do however many want it. It goes on until none is left: every round
    settles the first holder of each key, so it ends.
    """
    from folioflow.session import cut

    left = wanted.select("orig", "head", "tail", key(F.col("head")).alias("kh"), key(F.col("tail")).alias("kt"), F.lit(0).cast("bigint").alias("n"))
    settled = None
    while True:
        made = F.when(F.col("n") > 0, F.concat(F.lit(form[0]), F.col("n").cast("string"), F.lit(form[1]))).otherwise(F.lit(""))
        tried = left.withColumn("final", F.concat("head", made, "tail")).withColumn("k", F.concat("kh", made, "kt")).join(taken.withColumn("t", F.lit(True)), "k", "left")
        tried = cut(tried.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("n", "orig"))))
        good = tried.where("t is null and r = 1")
        settled = good.select("orig", "final") if settled is None else settled.unionByName(good.select("orig", "final"))
        bad = tried.where("t is not null or r > 1")
        if bad.isEmpty():
            return settled
        taken = cut(taken.union(good.select("k")))
        left = free_numbers(bad, taken, form)


def settle_clashes(rows: DataFrame, path: str, key, order: list[str]) -> DataFrame:
    """``final`` without any clash: the first holder of a key keeps its path, the others get the smallest free ` (n)`.

    ``order`` tells the rows apart. No given path is taken by a made one, and it goes on until all keys differ. Rows without a path have none.
    """
    from folioflow.session import cut

    ranked = cut(rows.where(F.col(path).isNotNull()).select(F.struct(*order).alias("orig"), F.col(path).alias("p"), key(F.col(path)).alias("k")))
    firsts = ranked.groupBy("k").agg(F.min_by(F.struct("orig", "p"), "orig").alias("x")).select("k", "x.orig", "x.p")
    others = ranked.join(firsts.select("orig"), "orig", "left_anti")
    folder = F.when(dirname("p") != "", F.concat(dirname("p"), F.lit("/"))).otherwise(F.lit(""))
    made = settle_names(others.select("orig", F.concat(folder, stem("p")).alias("head"), extension("p").alias("tail")), firsts.select("k"), key)
    final = firsts.select("orig", F.col("p").alias("final")).unionByName(made)
    return rows.withColumn("__o", F.struct(*order)).join(final.withColumnRenamed("orig", "__o"), "__o", "left").drop("__o")


def shared_folder(users: DataFrame, item: str, folder: str) -> DataFrame:
    """(item, folder, n_users): the longest folder that all users of an item share.

    Folders are compared part by part: what the smallest and the largest list of parts share, all share. So a hot item needs
    two values a task, never its list. NULL folders are no users.
    """
    parts = F.split(F.col(folder), "/")
    agg = users.where(F.col(folder).isNotNull()).groupBy(item).agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"), F.count("*").alias("n_users"))
    return agg.select(item, common_parts(F.col("lo"), F.col("hi")).alias("folder"), "n_users")


def levels_of(path: str | Column) -> Column:
    """Array of all folders above a path, from the top."""
    p = F.split(dirname(path), "/")
    return F.when(dirname(path) != "", F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).otherwise(F.array())


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Bag union of frames with the same columns, whatever their order."""
    return reduce(lambda a, b: a.unionByName(b), parts)

