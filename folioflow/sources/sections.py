"""The section files of notebooks, in the order that tables of contents give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import basename, dirname
from folioflow.session import cut
from folioflow.sources import container as co
from folioflow.sources.render import toc_entries

TOC_NAME = "Open Notebook.onetoc2"


def read_toc(files: DataFrame) -> DataFrame:
    """(folder, name, rank, n_listed) of tables of contents (path, content).

    A table is a container behind other bytes: it begins where its signature stands. What has no signature, or cannot
    be read, lists nothing.
    """
    at = F.expr(f"locate(X'{co.SIGNATURE.hex()}', content)")
    inner = files.withColumn("at", at).where("at > 0").select("path", F.expr("substring(content, at)").alias("content"))
    listed = toc_entries(co.facts(inner)).select(dirname("file").alias("folder"), F.lower("name").alias("name"), "rank", "index", "display")
    sizes = listed.groupBy("folder").agg(F.count("*").alias("n_listed"))
    return listed.join(sizes, "folder")


def find_sections(paths: DataFrame, toc: DataFrame) -> DataFrame:
    """(path, notebook, grp, section, n): section files (path below a root folder) with their place in their notebook.

    The first folder is the notebook, folders below it are groups (`a/b`). Within a folder the files come first,
    then the folders; each by its rank in the folder's table of contents, unlisted ones behind, then by lower-case name. A path
    without folder is a notebook of its own, named `Notebook`.
    """
    files = cut(paths.where(F.lower("path").endswith(".one")).select("path").distinct())
    parts = F.split("path", "/")
    steps = files.select("path", F.size(parts).alias("depth"), F.posexplode(parts).alias("at", "part"), parts.alias("parts"))
    steps = steps.select("path", "at", "part", (F.col("at") < F.col("depth") - 1).alias("inner"), F.array_join(F.slice("parts", F.lit(1), F.col("at")), "/").alias("folder"))
    kept = cut(toc.select("folder", F.col("name").alias("low"), "rank", "n_listed"))
    sizes = kept.select("folder", "n_listed").distinct()
    ranked = steps.withColumn("low", F.lower("part")).join(kept.select("folder", "low", "rank"), ["folder", "low"], "left").join(sizes, "folder", "left")
    place = F.struct("at", "inner", F.coalesce("rank", "n_listed", F.lit(0)).alias("rank"), "low")
    order = ranked.groupBy("path").agg(F.array_sort(F.collect_list(place)).alias("place"))
    got = order.withColumn("folder", dirname("path"))
    notebook = F.when(F.col("folder") == "", F.lit("Notebook")).otherwise(F.substring_index("folder", "/", 1))
    got = got.select("path", "place", notebook.alias("notebook"), F.regexp_replace("folder", "^[^/]*/?", "").alias("grp"), F.regexp_replace(basename("path"), r"(?i)\.one$", "").alias("section"))
    # the sections of one notebook, not its pages
    n = F.row_number().over(Window.partitionBy("notebook").orderBy(F.slice("place", 2, 1000), "path"))
    return got.select("path", "notebook", "grp", "section", n.alias("n"))


def read_notebooks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(section files (path, content, rel), sections in order) of all notebooks below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.regexp_replace(F.lit(root), "/+$", ""), "^(?:file:)?/*", "/")
    rel = F.regexp_replace(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.concat(base, F.lit("/")), F.lit("")), "^/+", "")
    files = files.select("path", "content", rel.alias("rel"))
    toc = read_toc(files.where(basename("rel") == TOC_NAME).select(F.col("rel").alias("path"), "content"))
    sections = files.where(F.lower("rel").endswith(".one"))
    return sections, find_sections(sections.select(F.col("rel").alias("path")), toc)
