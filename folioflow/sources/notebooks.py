"""Whole notebooks as files: sections read, rendered, numbered, indexed, with their attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import md_path
from folioflow.session import cut
from folioflow.sources import container as co
from folioflow.sources import export as ex
from folioflow.sources import render as re_
from folioflow.sources.sections import read_notebooks


def section_pages(sections: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, assets) of section files (rel, content) with the notebook, group and section of each."""
    found = co.facts(sections.select(F.col("rel").alias("path"), "content"))
    held = re_.graph(found)
    pages, assets = re_.place_assets(re_.render_pages(found, held))
    where = order.select(F.col("path").alias("file"), "notebook", "grp", "section")
    return pages.join(where, "file"), assets.join(where, "file")


def notebook_files(spark: SparkSession, root: str, versions: bool = False) -> DataFrame:
    """Files (path, part, text, content) of all notebooks below a folder: notes, attachments and indexes, older versions if asked for."""
    sections, order = read_notebooks(spark, root)
    pages, assets = section_pages(sections, cut(order))
    pages = cut(pages)
    now, old = pages.where("not is_version"), pages.where("is_version")
    files = [ex.page_files(now), ex.section_indexes(now), ex.notebook_indexes(ex.section_stats(pages))]
    if versions:
        n = F.row_number().over(Window.partitionBy("file").orderBy("idx"))
        files.append(ex.version_files(old.withColumn("n", n)))
    else:  # attachments of older versions only are not written
        used = now.select("file", F.explode(F.regexp_extract_all("body", F.lit(r"\]\((assets/[^)]*)\)"), F.lit(1))).alias("dest")).distinct()
        assets = assets.withColumn("dest", md_path("path")).join(used, ["file", "dest"], "left_semi")
    files.append(assets.select(F.concat(ex.section_folder(), F.lit("/"), "path").alias("path"), "content"))
    every = files[0]
    for f in files[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    return every.withColumn("part", F.coalesce("part", F.lit(0)))
