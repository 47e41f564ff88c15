"""Queries over page containers: all pages of the tables are packed into container files, and read, ordered and rendered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.plans.queries import PAGES, _pages, _strip, query
from folioflow.session import cut
from folioflow.sources import container as co
from folioflow.sources import packing as pk
from folioflow.sources import properties as pr
from folioflow.sources import render as re_
from folioflow.sources import sections as se
from folioflow.sources import spaces as sp

COLUMNS = ("path", "title", "notebook", "grp", "section", "idx", "level", "created", "modified", "is_version")
# What each page holds, for the SQL: q has a row a page, f its file.
Q = f"""p AS (SELECT * FROM {PAGES}), c AS (SELECT greatest(1, count(*) // {pk.PAGES_A_FILE}) AS files FROM p),
  q AS (SELECT p.*, page_id % files AS f, len(string_split(path, '/')) AS parts, coalesce({_strip('title')}, '') <> '' AS titled, row_number() OVER (PARTITION BY page_id % files, is_version ORDER BY page_id) AS place FROM p, c)"""
_KEPT: dict[tuple[str, str], "Store"] = {}


class Store:
    """The packed pages of one data folder. The pages are written once a session; files are made, read and forgotten file by file in each query, for they are far larger than what is asked of them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.pages = cut(pk.assigned(_pages(spark, sf_dir, *COLUMNS)))
        self.files = pk.pack(self.pages)
        self._placed: tuple[DataFrame, DataFrame] | None = None

    def placed(self) -> tuple[DataFrame, DataFrame]:
        """(pages, assets), rendered once a session."""
        if self._placed is None:
            self._placed = re_.place_assets(sp.pages(self.files))
        return self._placed

    def ids(self) -> DataFrame:
        """(page_id, file, is_version, idx): pages are packed in order of their ids."""
        n = F.row_number().over(Window.partitionBy("file", "is_version").orderBy("page_id"))
        return self.pages.select("page_id", "file", "is_version", n.cast("bigint").alias("idx"))


def store(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = Store(spark, sf_dir)
    return _KEPT[key]


_SECONDS = "to_timestamp(epoch(strptime(substring({0}, 1, 19), '%Y-%m-%d %H:%M:%S')))"


@query(f"""WITH {Q} SELECT page_id, is_version, place AS idx, CASE WHEN titled THEN {_strip('title')} ELSE 'Untitled page' END AS title, level, coalesce(created, '') AS created, coalesce(modified, '') AS modified,
  CASE WHEN is_version THEN coalesce(modified, '') ELSE '' END AS saved, (11 + parts + titled::int)::bigint AS paragraphs,
  (length(section) + length('Notebook , level ') + length(notebook) + length(level::varchar) + length(path) - (parts - 1) + length('Check ') + 2 * length(page_id::varchar) + length('pagelevelshort|row') + length(level::varchar)
   + 1 + length('HYPERLINK "https://notes.example/"') + length(page_id::varchar) + length('sourceid = ') + length(page_id::varchar) + CASE WHEN titled THEN length(title) ELSE 0 END)::bigint AS text_chars, (page_id % 3 = 1)::int AS n_warnings FROM q""")
def container_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page out of its container: order, title, level, times, sizes and warnings."""
    s = store(spark, sf_dir)
    got = sp.pages(s.files).join(s.ids(), ["file", "is_version", "idx"])
    return got.select("page_id", "is_version", "idx", "title", "level", tx.iso("created").alias("created"), tx.iso("modified").alias("modified"), tx.iso("version_time").alias("saved"), "paragraphs", "text_chars", F.size("warnings").alias("n_warnings"))


_ASSETS = f"""{Q}, a AS (SELECT *, CASE page_id % 3 WHEN 0 THEN 'plan ' || (page_id % 5) || '.png' ELSE 'sheet ' || (page_id % 4) || '.pdf' END AS base, CASE page_id % 3 WHEN 0 THEN 'i' || (page_id % 7) ELSE 'f' || (page_id % 6) END AS bytes FROM q WHERE page_id % 3 <> 1),
  g AS (SELECT f, bytes, arg_min(base, (is_version, place)) AS base, min((is_version, place)) AS met FROM a GROUP BY f, bytes),
  n AS (SELECT f, bytes, base, row_number() OVER (PARTITION BY f, base ORDER BY met) - 1 AS k FROM g),
  named AS (SELECT f, bytes, CASE WHEN k = 0 THEN base ELSE regexp_replace(base, '\\.[^.]*$', '') || '-' || k || regexp_extract(base, '\\.[^.]*$') END AS name FROM n)"""


@query(f"""WITH {_ASSETS} SELECT page_id, '### ' || section || '  ' || chr(10) || 'Notebook **' || notebook || '**, level *' || level || '*' || chr(10) || chr(10)
  || array_to_string(list_transform(string_split(path, '/'), lambda p, i: i || '. ' || p), chr(10)) || chr(10) || CASE WHEN page_id % 2 = 0 THEN '- [x] ' ELSE '- [ ] ' END || 'Check ' || page_id || chr(10) || chr(10)
  || '| page | level |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | ' || level || ' |' || chr(10) || '| short\\|row |  |' || chr(10) || '[source](https://notes.example/' || page_id || ')  ' || chr(10)
  || '```' || chr(10) || 'id = ' || page_id || chr(10) || '```' || chr(10)
  || CASE page_id % 3 WHEN 0 THEN '![Plan ' || page_id || '](assets/' || replace(name, ' ', '%20') || ')' WHEN 1 THEN '![lost ' || page_id || '.png](missing-image)' ELSE '📎 [sheet ' || (page_id % 4) || '](assets/' || replace(name, ' ', '%20') || ')' END || chr(10) AS body
  FROM q LEFT JOIN named ON q.f = named.f AND bytes = CASE page_id % 3 WHEN 0 THEN 'i' || (page_id % 7) WHEN 2 THEN 'f' || (page_id % 6) END""")
def container_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown of every page: styles, formats, lists, tasks, tables, links, code and attachments."""
    s = store(spark, sf_dir)
    return s.placed()[0].join(s.ids(), ["file", "is_version", "idx"]).select("page_id", "body")


@query(f"""WITH {_ASSETS} SELECT '/packed/' || f || '.one' AS file, 'assets/' || name AS path,
  sha1(CASE WHEN bytes[1] = 'i' THEN '\\x89PNG\\x0D\\x0A\\x1A\\x0A'::blob ELSE '%PDF-'::blob END || from_hex(lpad(bytes[2:], 2, '0'))) AS digest FROM named""")
def container_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of every file: equal bytes once, names set apart by numbers, extensions from their bytes."""
    return store(spark, sf_dir).placed()[1].select("file", "path", "digest")


@query(f"""WITH {Q}, h AS (SELECT count(DISTINCT f) AS files, count(DISTINCT CASE WHEN is_version THEN f END) AS histories, count(*) AS pages, count(*) FILTER (page_id % 4 = 0) AS bases, count(DISTINCT CASE WHEN page_id % 3 <> 1 THEN page_id END) AS blobs FROM q)
  SELECT unnest(['cell', 'current', 'revision_map', 'revision', 'group_ref', 'root', 'blob']) AS kind,
    unnest([pages + files + histories, pages + files + histories, pages + files + histories + bases, pages + files + histories + bases, pages + files + histories + bases, 2 * (pages + bases) + files + histories, blobs]) AS n FROM h""")
def container_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all containers by kind (objects are counted by container_nodes)."""
    return co.told(store(spark, sf_dir).files, "kind").where("kind <> 'object'").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {Q}, t AS (SELECT count(*) AS pages, sum(parts) AS parts, sum(titled::int) AS titled, count(*) FILTER (page_id % 4 = 0) AS bases, count(*) FILTER (NOT is_version) AS cur, count(*) FILTER (is_version) AS old,
    count(DISTINCT f) AS files, count(DISTINCT CASE WHEN is_version THEN f END) AS histories, count(*) FILTER (page_id % 3 = 2) AS held FROM q), s AS (SELECT count(*) FILTER (page_id % 3 <> 1) AS data FROM q)
  SELECT unnest(['section', 'series', 'history', 'version', 'meta', 'manifest', 'page', 'outline', 'text', 'list', 'ink', 'element', 'table', 'row', 'cell', 'image', 'file', 'title']) AS kind,
    unnest([files, files, histories, old, pages + cur, pages, pages, pages + titled + bases, 15 * pages + parts + titled, pages, pages + data, 11 * pages + parts + titled, pages, 3 * pages, 5 * pages, pages - held, held, titled])::bigint AS n FROM t, s""")
def container_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of all page spaces by kind: newest revision over its base, the base's own objects kept."""
    nodes = sp.nodes(store(spark, sf_dir).files, "jcid")
    names = F.create_map(*[F.lit(x) for pair in pr.KIND_NAMES.items() for x in pair])
    return nodes.select(F.coalesce(F.try_element_at(names, F.col("jcid").cast("int")), F.format_string("jcid_%08X", "jcid")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {Q}, t AS (SELECT count(*) AS pages, sum(parts) AS parts, sum(titled::int) AS titled, count(*) FILTER (NOT is_version) AS cur, count(created) AS c, count(modified) AS m, count(*) FILTER (is_version AND modified IS NOT NULL) AS saved, count(*) FILTER (is_version) AS old,
    count(*) FILTER (page_id % 3 = 2) AS held, count(*) FILTER (page_id % 3 = 0) AS seen FROM q)
  SELECT unnest(['text', 'run_index', 'run_formats', 'cached_title', 'level', 'created', 'modified', 'version_time', 'version_refs', 'bold', 'italic', 'style', 'style_id', 'number_format', 'lists', 'tag_states', 'tag_label', 'image_name', 'image_alt', 'file_name', 'picture', 'is_title']) AS name,
    unnest([10 * pages + parts + titled, 2 * pages, pages, pages + cur, pages + cur, c, m, saved, old, pages, pages, 2 * pages, 2 * pages, pages, parts, pages, pages, pages - held, seen, held, seen, titled])::bigint AS n FROM t""")
def container_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded properties of all objects by name (references are counted by container_edges)."""
    props = sp.properties(store(spark, sf_dir).files, "name")
    counted = props.where(~F.col("name").isin("children", "content", "structure", "page_spaces", "page_metas", "file", "tag_shape"))
    return counted.groupBy("name").agg(F.count("*").alias("n"))


@query(f"""WITH {Q}, t AS (SELECT count(*) AS pages, sum(parts) AS parts, sum(titled::int) AS titled, count(*) FILTER (NOT is_version) AS cur, count(*) FILTER (is_version) AS old, count(DISTINCT f) AS files, count(*) FILTER (page_id % 3 <> 1) AS data FROM q)
  SELECT unnest(['children', 'content', 'structure', 'lists', 'run_formats', 'style', 'page_metas', 'held bytes']) AS name,
    unnest([files + old + 21 * pages + parts + 2 * titled, pages + 11 * pages + parts + titled, titled, parts, 4 * pages, 2 * pages, cur, data])::bigint AS n FROM t""")
def container_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between objects by property, positions kept, each resolved to an object of its space."""
    links = sp.edges(store(spark, sf_dir).files, "pid", "known")
    names = {pr.PROPS[k]: k for k in ("children", "content", "structure", "lists", "run_formats", "style", "page_metas")} | {pr.PROPS[k]: "held bytes" for k in ("picture", "file")}
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return links.where("known").select(F.try_element_at(label, F.col("pid").cast("int")).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


@query(f"""WITH {Q} SELECT page_id, 'manifest' AS kind, 'page' AS inner_kind, (6 + parts)::int AS n_elements, 'Check ' || page_id AS task FROM q""")
def container_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON dump of each page's objects, and what it says at some places."""
    s = store(spark, sf_dir)
    told = sp.dumps(s.files)
    elements = "$.content[0].children[0].children"
    parts = F.json_array_length(F.get_json_object("json", elements))
    task = F.get(F.from_json(F.get_json_object("json", elements), "array<struct<content:array<struct<text:string>>>>"), parts - 4)
    said = told.select("file", "is_version", "idx", F.get_json_object("json", "$.kind").alias("kind"), F.get_json_object("json", "$.content[0].kind").alias("inner_kind"), parts.alias("n_elements"), F.get(task["content"], F.lit(0))["text"].alias("task"))
    return said.join(s.ids(), ["file", "is_version", "idx"]).select("page_id", "kind", "inner_kind", "n_elements", "task")


@query(f"""WITH {Q} SELECT '/packed/' || f || '.one' AS file, unnest(['cut', 'other format', 'empty']) AS fault FROM (SELECT DISTINCT f FROM q)""")
def container_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file cut short, of another format, and empty: each gives one row that says so, and no other fact."""
    bad = [F.struct(F.concat(F.lit(f"{fault}:"), "path").alias("path"), content.alias("content")) for fault, content in (
        ("cut", F.expr("substring(content, 1, length(content) - 1)")), ("other format", F.expr("concat(X'00', content)")), ("empty", F.expr("X''")))]
    found = co.told(store(spark, sf_dir).files.select(F.inline(F.array(*bad))), "file", "kind")
    only = found.groupBy("file").agg(F.count("*").alias("n"), F.max("kind").alias("kind")).where("n = 1 and kind = 'error'")
    return only.select(F.substring_index("file", ":", -1).alias("file"), F.substring_index("file", ":", 1).alias("fault"))


@query(f"""WITH s AS (SELECT DISTINCT notebook, coalesce(grp, '') AS grp, section FROM {PAGES}),
  toc AS (SELECT notebook, grp, section, row_number() OVER (PARTITION BY notebook, grp ORDER BY length(section) DESC, section) AS r FROM s WHERE NOT ends_with(section, '2')),
  n AS (SELECT notebook, grp, count(*) AS listed FROM toc GROUP BY ALL)
  SELECT s.notebook, s.grp, s.section, row_number() OVER (PARTITION BY s.notebook ORDER BY s.grp <> '', lower(s.grp), coalesce(r - 1, listed, 0), lower(s.section || '.one'))::int AS n
  FROM s LEFT JOIN toc ON toc.notebook = s.notebook AND toc.grp = s.grp AND toc.section = s.section LEFT JOIN n ON n.notebook = s.notebook AND n.grp = s.grp""")
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every notebook and group in the order of its table of contents, which leaves out those that end in 2."""
    sections = _pages(spark, sf_dir, "notebook", "grp", "section").select("notebook", F.coalesce("grp", F.lit("")).alias("grp"), "section").distinct()
    folder = F.concat_ws("/", "notebook", F.nullif(F.col("grp"), F.lit("")))
    listed = sections.where(~F.col("section").endswith("2")).select(folder.alias("folder"), "section")
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(F.length("section").desc(), "section"))
    entries = F.collect_list(F.struct("rank", "section"))

    @F.udf("binary")
    def toc(rows) -> bytes:
        # every entry twice: a later one of the same name in other letters counts no more
        return pk.toc_file([(r["section"] + ".one", r["rank"] * 3, r["section"]) for r in rows] + [(r["section"].upper() + ".ONE", 1000 + r["rank"], "again") for r in rows])

    files = listed.withColumn("rank", rank).groupBy("folder").agg(entries.alias("e")).select(F.concat("folder", F.lit(f"/{se.TOC_NAME}")).alias("path"), toc("e").alias("content"))
    junk = files.select(F.regexp_replace("path", "^", "zz/").alias("path"), F.encode(F.lit("no table"), "utf-8").alias("content"))
    ordered = se.find_sections(sections.select(F.concat_ws("/", folder, F.concat("section", F.lit(".one"))).alias("path")), se.read_toc(files.unionByName(junk)))
    return ordered.select("notebook", "grp", "section", "n")
