"""Files that an export writes: pages with front matter, older versions, dumps and indexes as rows, and a sink for them.

Texts are made as columns; the sink writes a task's rows one after the other, to any file system that the executors reach.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import iso, md_path, safe_name
from folioflow.sources.notes import json_scalar, page_head

INDEX_ROWS = 1000  # pages in one part of an index
PAGE_HEAD = "| # | Page | Level | Created | Modified | Paragraphs | Chars |\n|---|---|---|---|---|---|---|"
NOTEBOOK_HEAD = "| Section | Pages | Old versions | Paragraphs | Chars |\n|---|---|---|---|---|"


def section_folder() -> Column:
    """`notebook/group/section` with safe names; a group may have several levels."""
    groups = F.transform(F.filter(F.split(F.coalesce("grp", F.lit("")), "/"), lambda g: g != ""), lambda g: safe_name(g))
    return F.array_join(F.flatten(F.array(F.array(safe_name("notebook")), groups, F.array(safe_name("section")))), "/")


def page_file() -> Column:
    return F.concat(F.format_string("%02d", "idx"), F.lit(" - "), safe_name("title"), F.lit(".md"))


def page_files(pages: DataFrame) -> DataFrame:
    """(path, text) of current pages (notebook, grp, section, idx, title, level, created, modified, body): front matter, heading, body. Times are texts or timestamps."""
    head = page_head(F.col("title"), F.col("notebook"), F.col("section"), F.col("level"), _time(pages, "created"), _time(pages, "modified"))
    return pages.select(F.concat(section_folder(), F.lit("/"), page_file()).alias("path"), F.concat(head, F.lit("# "), "title", F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"))


def version_files(versions: DataFrame) -> DataFrame:
    """(path, text) of older versions (as pages, with ``n``, their number in the section, and ``version_time``)."""
    saved = _time(versions, "version_time")
    head = page_head(F.col("title"), F.col("notebook"), F.col("section"), F.col("level"), _time(versions, "created"), _time(versions, "modified"))
    more = F.concat(F.lit("version_of: "), json_scalar(F.col("title")), F.when(saved != "", F.concat(F.lit("\nversion_saved: "), json_scalar(saved))).otherwise(F.lit("")))
    head = F.regexp_replace(head, r"\n---\n\n$", "")
    when = F.coalesce(F.nullif(F.replace(F.substring(saved, 1, 19), F.lit(":"), F.lit("-")), F.lit("")), F.lit("unknown"))
    name = F.concat(safe_name("title"), F.lit(" - version "), F.col("n").cast("string"), F.lit(" - "), when, F.lit(".md"))
    text = F.concat(head, F.lit("\n"), more, F.lit("\n---\n\n# "), "title", F.lit(" (older version)\n\n"), F.coalesce("body", F.lit("")))
    return versions.select(F.concat(section_folder(), F.lit("/_versions/"), name).alias("path"), text.alias("text"))


def index_row() -> Column:
    """The row of one page in its section's index."""
    indent = F.repeat(F.lit("&nbsp;&nbsp;&nbsp;"), F.col("level") - 1)
    return F.concat(F.lit("| "), F.col("idx").cast("string"), F.lit(" | "), indent, F.lit("["), "title", F.lit("]("), md_path(page_file()), F.lit(") | "), F.concat_ws(" | ", F.col("level").cast("string"), "created", "modified", F.col("paragraphs").cast("string"), F.col("text_chars").cast("string")), F.lit(" |"))


def section_indexes(pages: DataFrame) -> DataFrame:
    """(path, part, text) of every section's README: its head, and rows of its pages in order.

    A section may hold a third of all pages, so its index comes in parts of INDEX_ROWS page numbers; part 0 has the head. The parts of a
    path, one after the other, are its file.
    """
    shown = pages.withColumn("created", _time(pages, "created")).withColumn("modified", _time(pages, "modified"))
    rows = shown.select("notebook", F.coalesce("grp", F.lit("")).alias("grp"), "section", section_folder().alias("folder"), F.expr(f"idx div {INDEX_ROWS}").alias("part"), F.struct("idx", index_row().alias("row")).alias("r"))
    parts = rows.groupBy("notebook", "grp", "section", "folder", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "\n").alias("rows"))
    first = parts.groupBy("folder").agg(F.min("part").alias("first"))
    group = F.when(F.col("grp") != "", F.concat(F.lit(" / "), "grp")).otherwise(F.lit(""))
    head = F.concat(F.lit("# "), "section", F.lit("\n\nNotebook: **"), "notebook", F.lit("**"), group, F.lit("  \nSource: `"), "section", F.lit(".one`\n\n" + PAGE_HEAD + "\n"))
    text = F.concat(F.when(F.col("part") == F.col("first"), head).otherwise(F.lit("")), "rows", F.lit("\n"))
    return parts.join(first, "folder").select(F.concat("folder", F.lit("/README.md")).alias("path"), (F.col("part") - F.col("first")).alias("part"), text.alias("text"))


def section_stats(pages: DataFrame) -> DataFrame:
    """(notebook, grp, section, pages, versions, chars, paragraphs, n_warnings) of pages with ``is_version``."""
    now = ~F.col("is_version")
    return pages.groupBy("notebook", F.coalesce("grp", F.lit("")).alias("grp"), "section").agg(
        F.count_if(now).alias("pages"), F.count_if("is_version").alias("versions"), F.sum(F.when(now, F.col("text_chars")).otherwise(0)).alias("chars"), F.sum(F.when(now, F.col("paragraphs")).otherwise(0)).alias("paragraphs"),
        F.sum(F.when(now & F.col("warnings").isNotNull(), F.size("warnings")).otherwise(0)).alias("n_warnings"))


def notebook_indexes(stats: DataFrame) -> DataFrame:
    """(path, part, text) of every notebook's README: a row a section (sections of one notebook, not its pages), in order of group and section."""
    label = F.concat(F.when(F.col("grp") != "", F.concat("grp", F.lit(" / "))).otherwise(F.lit("")), "section")
    link = F.concat(F.when(F.col("grp") != "", F.concat(safe_name("grp"), F.lit("/"))).otherwise(F.lit("")), safe_name("section"), F.lit("/README.md"))
    row = F.concat(F.lit("| ["), label, F.lit("]("), md_path(link), F.lit(") | "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in ("pages", "versions", "paragraphs", "chars")]), F.lit(" |"))
    rows = stats.groupBy("notebook").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "section", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    return rows.select(F.concat(safe_name("notebook"), F.lit("/README.md")).alias("path"), F.lit(0).cast("bigint").alias("part"), F.concat(F.lit("# "), "notebook", F.lit("\n\n" + NOTEBOOK_HEAD + "\n"), "rows", F.lit("\n")).alias("text"))


def summaries(stats: DataFrame) -> DataFrame:
    """(notebook, grp, section, line): what an export says of each section."""
    line = F.concat("section", F.lit(": "), F.col("pages").cast("string"), F.lit(" pages, "), F.col("paragraphs").cast("string"), F.lit(" paragraphs, "), F.col("chars").cast("string"), F.lit(" chars, "), F.col("versions").cast("string"), F.lit(" old versions"),
                    F.when(F.col("n_warnings") > 0, F.concat(F.lit(", "), F.col("n_warnings").cast("string"), F.lit(" warnings"))).otherwise(F.lit("")))
    return stats.select("notebook", "grp", "section", line.alias("line"))


def _time(df: DataFrame, name: str) -> Column:
    return iso(name) if df.schema[name].dataType.typeName().startswith("timestamp") else F.coalesce(name, F.lit(""))


# ---------------------------------------------------------------- sink
def _system(uri: str):
    """(file system, path) of a target, on whatever machine it is asked."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_files(files: DataFrame, target: str, source: str | None = None) -> None:
    """Write rows (path, text) below ``target``: a path or an address that all executors reach.

    A row has ``text``, or bytes as ``content``; one with neither is copied from ``source``/``orig``, byte by byte. Rows with ``part`` of one path are one file, in order of
    their parts. The target must not exist: the files are staged beside it and renamed when all are there, so a run that fails leaves nothing
    that looks whole. A task that runs again writes the same files again.
    """
    if exists(files.sparkSession, target):
        raise FileExistsError(target)
    stage = target.rstrip("/") + ".staging"
    remove(files.sparkSession, stage)
    have = files.columns
    def held(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind).alias(name)

    rows = files.select("path", held("text", "string"), held("content", "binary"), held("orig", "string"), held("part", "bigint"))
    if "part" in have:
        rows = rows.repartition("path").sortWithinPartitions("path", "part")

    def put(task: Iterator) -> None:
        system, root = _system(stage)
        last, out = None, None
        for r in task:
            if out is not None and r["path"] != last:
                out.close()
                out = None
            to = f"{root}/{r['path']}"
            if r["path"] != last:
                system.create_dir(to.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(to)
                last = r["path"]
            if r["text"] is not None:
                out.write(r["text"].encode("utf-8", "surrogatepass"))
            elif r["content"] is not None:
                out.write(bytes(r["content"]))
            else:
                old, base = _system(source)
                with old.open_input_stream(f"{base.rstrip('/')}/{r['orig']}") as f:
                    while chunk := f.read(1 << 20):
                        out.write(chunk)
        if out is not None:
            out.close()

    rows.foreachPartition(put)
    rename(files.sparkSession, stage, target)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file, or a folder that is not empty."""
    system, place = _hadoop(spark, path)
    return system.exists(place) and (not system.getFileStatus(place).isDirectory() or len(system.listStatus(place)) > 0)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _hadoop(spark, path)
    system.delete(place, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    system, place = _hadoop(spark, old)
    to = _hadoop(spark, new)[1]
    if system.exists(place):
        system.delete(to, False) if system.exists(to) else None
        system.rename(place, to)


def taken_names(spark: SparkSession, names: list[str], output: str) -> list[str]:
    """The names (of notebooks: a small list) that an output folder holds already."""
    return sorted(n for n in set(names) if exists(spark, f"{output.rstrip('/')}/{n}"))


def in_place(spark: SparkSession, source: str, cleaned: str) -> str:
    """Put a cleaned folder in the place of its source; the source is kept beside it under the name that is returned."""
    n = 1
    while exists(spark, backup := f"{source.rstrip('/')}.before-{n}"):
        n += 1
    rename(spark, source, backup)
    rename(spark, cleaned, source)
    return backup
