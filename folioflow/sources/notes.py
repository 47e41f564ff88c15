"""Notes as text: front matter, and a vault of files as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.scan import TEXT_FILES, TEXT_LIMIT
from folioflow.functions.text import basename, col, extension, strip

KEY = r"^([A-Za-z_][\w-]*):(?:[ \t]+(.*))?$"
ENTRY = "struct<k:string,v:string,raw:array<string>>"


def front_matter(text: str | Column) -> Column:
    """struct(has_fm, fm, body) of a note: the entries of the block between `---` lines, in order, and the text behind it.

    An entry is (k, v, raw): v is the JSON value as text (a quoted string without its quotes, anything else as
    written); lines that name no key belong to the entry above, or are an entry without key. A block without
    end is no block. NULL gives an empty note.
    """
    lines = F.split(F.coalesce(col(text), F.lit("")), "\n")
    ends = F.array_position(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: strip(x) == "---"), F.lit(True))
    has = (F.get(lines, F.lit(0)) == "---") & (ends > 0)
    block = F.slice(lines, F.lit(2), F.greatest((ends - 1).cast("int"), F.lit(0)))
    empty = F.array().cast(f"array<{ENTRY}>")

    def fold(acc: Column, line: Column) -> Column:
        raw = strip(F.regexp_extract(line, KEY, 2))
        value = F.when(raw.rlike(r'^".*"$'), F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x"), raw)).otherwise(raw)
        fresh = F.struct(F.regexp_extract(line, KEY, 1).alias("k"), value.alias("v"), F.array(line).alias("raw"))
        last = F.element_at(acc, -1)
        longer = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["k"].alias("k"), last["v"].alias("v"), F.array_append(last["raw"], line).alias("raw")))
        lone = F.struct(F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v"), F.array(line).alias("raw"))
        return F.when(line.rlike(KEY), F.array_append(acc, fresh)).when(F.size(acc) > 0, longer).otherwise(F.array(lone)).cast(f"array<{ENTRY}>")

    fm = F.when(has, F.aggregate(block, empty, fold)).otherwise(empty)
    rest = F.array_join(F.slice(lines, (ends + 2).cast("int"), F.size(lines)), "\n")
    return F.struct(has.alias("has_fm"), fm.alias("fm"), F.when(has, rest).otherwise(F.coalesce(col(text), F.lit(""))).alias("body"))


def get_field(fm: Column, name: str) -> Column:
    """The first value of a key, or NULL."""
    return F.get(F.filter(fm, lambda e: e["k"] == name), F.lit(0))["v"]


def drop_fields(fm: Column, names: list[str]) -> Column:
    return F.filter(fm, lambda e: e["k"].isNull() | ~e["k"].isin(*names)) if names else fm


def json_scalar(value: Column) -> Column:
    """A text as a JSON string, letters of any script kept."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("x"))), r'^\{"x":(.*)\}$', 1)


def set_field(fm: Column, name: str, value: Column) -> Column:
    """The entries with a key's value replaced, or added at the end."""
    line = F.concat(F.lit(f"{name}: "), json_scalar(value))
    entry = F.struct(F.lit(name).alias("k"), value.alias("v"), F.array(line).alias("raw"))
    first = F.array_position(F.transform(fm, lambda e: F.coalesce(e["k"] == name, F.lit(False))), F.lit(True))
    return F.when(first > 0, F.transform(fm, lambda e, i: F.when(i == first - 1, entry).otherwise(e))).otherwise(F.array_append(fm, entry))


def front_matter_text(fm: Column) -> Column:
    return F.concat(F.lit("---\n"), F.array_join(F.transform(F.flatten(F.transform(fm, lambda e: e["raw"])), lambda r: F.concat(r, F.lit("\n"))), ""), F.lit("---\n"))


def page_head(title: Column, notebook: Column, section: Column, level: Column, created: Column, modified: Column) -> Column:
    """Front matter of an exported page: one JSON value a line, empty values left out."""
    fields = [("title", json_scalar(title), title), ("notebook", json_scalar(notebook), notebook), ("section", json_scalar(section), section),
              ("level", level.cast("string"), level.cast("string")), ("created", json_scalar(created), created), ("modified", json_scalar(modified), modified)]
    lines = F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), shown)) for k, shown, v in fields])
    return F.concat(F.lit("---\n"), F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), F.lit("\n---\n\n"))


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """One row a file: path, length, is_note, unreadable, text (notes), attached (text attachments), content digest.

    Files are listed and read in parallel; notes that are no UTF-8 are assets and marked unreadable. Line ends
    are folded. ``attached`` is the text of other files with an extension of TEXT_FILES and at most TEXT_LIMIT bytes, bad bytes
    replaced; of all else the bytes are only hashed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), "/+$", "")
    rel = F.regexp_replace(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.concat(F.regexp_replace(base, "^(?:file:)?/*", "/"), F.lit("/")), F.lit("")), "^/+", "")
    md = F.lower(basename("path")).endswith(".md")
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(md & readable, F.regexp_replace(F.col("content").cast("string"), r"\r\n?", "\n"))
    texts = F.lower(extension("path")).isin(*TEXT_FILES) & (F.col("length") <= TEXT_LIMIT)
    attached = F.when(~(md & readable) & texts, F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n"))
    return files.select(rel.alias("path"), "length", (md & readable).alias("is_note"), (md & ~readable).alias("unreadable"), text.alias("text"), attached.alias("attached"), F.sha1("content").alias("digest"))


def read_renames(spark: SparkSession, path: str) -> DataFrame:
    """(path, new_title) of a rename file; blanks are left out, the last entry of a path wins, a byte-order mark is skipped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns]).withColumn("__n", F.monotonically_increasing_id())
    rows = rows.where("trim(coalesce(new_title, '')) <> '' and path is not null")
    return rows.groupBy("path").agg(F.max_by(F.trim("new_title"), "__n").alias("new_title"))
