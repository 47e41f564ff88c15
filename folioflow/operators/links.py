"""Links in Markdown text: tokens, targets, backlinks, broken links and rewriting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import col, decode_path, dirname, md_path

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
LINK = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("dest", T.StringType()),
    T.StructField("is_image", T.BooleanType()), T.StructField("alt", T.StringType()),
])
_OPEN = re.compile(r"(!\[(?P<alt>(?:[^\[\]]|\[[^\[\]]*\])*)\]\()|\]\(")
_STOP = re.compile(r"[()\\\n]")
_TITLE = re.compile(r'\s+"[^"]*"\s*\Z')


def _destination(text: str, at: int) -> tuple[int, int, str] | None:
    """(start, end, destination) after an opening bracket at ``at``: angle form, or balanced brackets on one line."""
    while at < len(text) and text[at] in " \t":
        at += 1
    if text.startswith("<", at):
        close = text.find(">", at)
        return None if close < 0 or "\n" in text[at:close] else (at, close + 1, text[at + 1 : close])
    open_, pos = 0, at
    while m := _STOP.search(text, pos):
        sign, pos = m.group(), m.end()
        if sign == "\\" and m.end() < len(text):
            pos += 1
        elif sign == "(":
            open_ += 1
        elif sign == "\n":
            return None
        elif sign == ")":
            if open_:
                open_ -= 1
                continue
            raw = text[at : m.start()]
            title = _TITLE.search(raw)
            dest = raw[: title.start()] if title else raw.rstrip()
            return (at, at + len(dest), dest) if dest else None
    return None


def tokens(text: str | None) -> list[tuple[int, int, str, bool, str]]:
    """Inline link and image destinations of a text, in order; brackets in destinations nest to any depth."""
    if not text or "](" not in text:
        return []
    alts = {m.end(): m.group("alt") for m in _OPEN.finditer(text) if m.group("alt") is not None}
    out = []
    at = text.find("](")
    while at >= 0:
        where = _destination(text, at + 2)
        if where:
            alt = alts.get(at + 2)
            out.append((*where, alt is not None, alt or ""))
        at = text.find("](", at + 2)
    return out


@F.pandas_udf(T.ArrayType(LINK))
def link_tokens(texts: pd.Series) -> pd.Series:
    """Array of (start, end, dest, is_image, alt); nesting is not regular, so no built-in can do it."""
    return texts.map(lambda t: [dict(zip(("start", "end", "dest", "is_image", "alt"), x)) for x in tokens(t if isinstance(t, str) else None)])


def links(notes: DataFrame, key: str, body: str) -> DataFrame:
    """One row a link: key, ord, start, end, dest, is_image, alt. Texts without `](` never reach Python."""
    some = notes.where(F.col(body).contains("](")).select(key, link_tokens(F.col(body)).alias("__l"))
    return some.select(key, F.posexplode("__l").alias("ord", "l")).select(key, "ord", "l.*")


def is_external(dest: str | Column) -> Column:
    """Addresses with a scheme, anchors, absolute and network paths."""
    d = col(dest)
    return d.rlike(SCHEME) | d.startswith("#") | d.startswith("/") | d.startswith("\\")


def normal_path(path: str | Column) -> Column:
    """The path without `.` and `..` parts; one that leaves the top starts with `..`. An empty path is `.`."""
    parts = F.filter(F.split(col(path), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(
        (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    ).otherwise(F.array_append(acc, p)))
    return F.coalesce(F.nullif(F.array_join(walked, "/"), F.lit("")), F.lit("."))


def target_path(note_path: str | Column, dest: str | Column) -> Column:
    """Where a local link points, from the note's folder; NULL for external links and those that leave the export."""
    folder = dirname(note_path)
    full = normal_path(F.concat_ws("/", F.nullif(folder, F.lit("")), decode_path(dest)))
    return F.when(~is_external(dest) & (full != "..") & ~full.startswith("../"), full)


def relative_path(target: str | Column, folder: str | Column) -> Column:
    """A path as seen from a folder."""
    t, f = F.split(col(target), "/"), F.when(col(folder) == "", F.array().cast("array<string>")).otherwise(F.split(col(folder), "/"))
    n = F.aggregate(F.arrays_zip(t.alias("t"), f.alias("f")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, p: F.struct(
        F.when(acc["go"] & F.coalesce(p["t"] == p["f"], F.lit(False)), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["go"] & F.coalesce(p["t"] == p["f"], F.lit(False))).alias("go")))["n"]
    ups = F.array_repeat(F.lit(".."), F.size(f) - n)
    return F.array_join(F.concat(ups, F.slice(t, n + 1, F.greatest(F.size(t) - n, F.lit(0)))), "/")


def resolve(found: DataFrame, note_path: str, items: DataFrame, item_path: str, key) -> DataFrame:
    """Links with ``target`` and the item they reach (left join on the path key); ``inside`` tells local links."""
    aimed = found.withColumn("target", target_path(note_path, "dest")).withColumn("inside", F.col("target").isNotNull()).withColumn("__k", key(F.col("target")))
    goals = items.withColumn("__k2", key(F.col(item_path)))
    return aimed.join(goals, F.col("__k") == F.col("__k2"), "left").drop("__k", "__k2")


def rewrite(notes: DataFrame, key: str, body: str, changes: DataFrame) -> DataFrame:
    """``body`` with each span of ``changes`` (key, start, end, new) replaced; notes without changes stay as they are.

    The spans of one note are gathered and spliced from their positions in order; a note's own text bounds them. A span
    that starts inside an earlier one goes with it.
    """
    gathered = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("__c"))
    joined = notes.join(gathered, key, "left")
    spliced = F.aggregate(
        F.col("__c"), F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")),
        lambda acc, c: F.when(c["start"] < acc["pos"], acc).otherwise(F.struct(F.concat(acc["out"], F.substring(F.col(body), acc["pos"] + 1, c["start"] - acc["pos"]), c["new"]).alias("out"), c["end"].alias("pos"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col(body), acc["pos"] + 1, F.length(body))))
    return joined.withColumn(body, F.when(F.col("__c").isNotNull(), spliced).otherwise(F.col(body))).drop("__c")


def backlinks(resolved: DataFrame, item: str, note: str) -> DataFrame:
    """(item, n_links, n_notes, first_note) of items that a note links to."""
    return resolved.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("n_links"), F.countDistinct(note).alias("n_notes"), F.min(note).alias("first_note"))


def encoded(path: str | Column) -> Column:
    return md_path(path)
