"""Queries over the clean-up: all pages and attachments of the tables as a vault, cleaned by one step at a time or by all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import merging as me
from folioflow.plans import cleanup as cl
from folioflow.plans.queries import PAGES, _dir, _name, _pages, _strip, _stripnum, query
from folioflow.session import cut, table
from folioflow.sources.notes import page_head

DATE = "*Monday, 4 June 2018 9:15*"
TAIL = "\n\nAttachments:\n"
INDEX = "# Index\n\n| # | Page | Level |\n|---|---|---|\n"

# SQL: v has a row a page with its folder and title, a one a distinct attachment path of the vault.
_TITLE = f"coalesce(nullif({_strip('title')}, ''), {_stripnum('path')})"
V = f"""v AS (SELECT page_id, path, {_dir('path')} AS folder, split_part(path, '/', 1) AS top, {_TITLE} AS title, notebook, section, level, created, modified, coalesce(body, '') AS body,
    list_contains(string_split({_dir('path')}, '/'), '_versions') AS old, regexp_matches({_name('path')}, '(?i)^\\d+ - .+\\.md$') AS numbered, try_cast(regexp_extract({_name('path')}, '^(\\d+) - ', 1) AS bigint) AS num FROM {PAGES}),
  a AS (SELECT page_path, name, arg_min(coalesce(alt, ''), asset_id) AS alt, arg_min(digest, asset_id) AS digest, {_dir('page_path')} AS folder FROM page_asset WHERE name IS NOT NULL AND page_path IN (SELECT path FROM v) GROUP BY page_path, name)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir, "path", "title", "notebook", "section", "level", "created", "modified", "body")
    return p.withColumn("title", tx.page_title("title", "path")).withColumn("body", F.coalesce("body", F.lit("")))


def attachments(spark: SparkSession, sf_dir: str, held: DataFrame) -> DataFrame:
    """(page_path, name, alt, digest): one row an attachment name of a page."""
    a = table(spark, sf_dir, "page_asset").where("name is not null").join(held.select(F.col("path").alias("page_path")), "page_path", "left_semi")
    first = F.min_by(F.struct(F.coalesce("alt", F.lit("")).alias("alt"), "digest"), "asset_id")
    return a.groupBy("page_path", "name").agg(first.alias("x")).select("page_path", "name", "x.alt", "x.digest")


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, is_note, text, digest) of a vault of all pages: front matter, heading, date, body, and links to their attachments, to the notebook's plan and to what is not there."""
    p = pages(spark, sf_dir)
    a = attachments(spark, sf_dir, p)
    shown = F.concat(F.lit("!["), "alt", F.lit("](assets/"), tx.md_path("name"), F.lit(")"))
    tails = a.groupBy(F.col("page_path").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(shown)), "\n").alias("tail"))
    up = F.repeat(F.lit("../"), F.size(F.split("path", "/")) - 2)
    lines = F.concat_ws("\n", F.concat(F.lit("[plan]("), up, F.lit("assets/plan.pdf)")), F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("[gone](assets/gone%20"), F.col("page_id").cast("string"), F.lit(".png)"))), "tail")
    head = page_head(*[F.col(c) for c in ("title", "notebook", "section", "level", "created", "modified")])
    text = F.concat(head, F.lit("# "), "title", F.lit(f"\n\n{DATE}\n\n"), "body", F.lit(TAIL), lines)
    blank = F.concat(head, F.lit("# "), "title", F.lit("\n"))
    whole = F.when(tx.strip("body") == "", blank).otherwise(text)
    notes = p.join(tails, "path", "left").select("path", F.lit(True).alias("is_note"), whole.alias("text"), F.sha1(whole).alias("digest"))
    none = F.lit(None).cast("string")
    files = a.select(F.concat(tx.dirname("page_path"), F.lit("/assets/"), "name").alias("path"), F.lit(False).alias("is_note"), none.alias("text"), "digest").groupBy("path", "is_note", "text").agg(F.min("digest").alias("digest"))
    plans = p.select(F.concat(F.substring_index("path", "/", 1), F.lit("/assets/plan.pdf")).alias("path")).distinct().select("path", F.lit(False).alias("is_note"), none.alias("text"), F.sha1("path").alias("digest"))
    return notes.unionByName(files).unionByName(plans)


def _cleaned(spark: SparkSession, files: DataFrame, *only: str, **options) -> dict[str, DataFrame]:
    return cl.run(cut(files), cl.Options(only=frozenset(only), **options))


_STEPPED: dict[tuple, cl.State] = {}
_KEPT: dict[tuple, dict[str, DataFrame]] = {}


def _stepped_vault(spark: SparkSession, sf_dir: str, *only: str) -> cl.State:
    """The vault after these steps, once a session; its links are left as they are."""
    key = (spark.sparkContext.applicationId, sf_dir, only)
    if key not in _STEPPED:
        _STEPPED[key] = cl.stepped(cut(vault(spark, sf_dir)), cl.Options(only=frozenset(only)))
    return _STEPPED[key]


def _cleaned_vault(spark: SparkSession, sf_dir: str, *only: str) -> dict[str, DataFrame]:
    """The vault cleaned by these steps, once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, only)
    if key not in _KEPT:
        _KEPT[key] = cl.finished(_stepped_vault(spark, sf_dir, *only))
    return _KEPT[key]


@query(f"""WITH {V}, f AS (SELECT DISTINCT folder FROM v) SELECT path, 'older page version' AS detail FROM v WHERE old
  UNION ALL SELECT folder || '/README.md', CASE WHEN list_contains(string_split(folder, '/'), '_versions') THEN 'older page version' ELSE 'generated index' END FROM f
  UNION ALL SELECT folder || '/.DS_Store', 'system file' FROM f UNION ALL SELECT folder || '/OneNote_RecycleBin/01 - Out.md', CASE WHEN list_contains(string_split(folder, '/'), '_versions') THEN 'older page version' ELSE 'deleted in OneNote' END FROM f
  UNION ALL SELECT folder || '/assets/' || name, 'older page version' FROM (SELECT DISTINCT folder, name FROM a) WHERE list_contains(string_split(folder, '/'), '_versions')""")
def cleaned_scaffolding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first two steps delete from the vault, with an index, a system file and a bin in every folder, and why."""
    files = cut(vault(spark, sf_dir))
    folder = files.where("is_note").select(tx.dirname("path").alias("d")).distinct()
    extra = [folder.select(F.concat("d", F.lit(name)).alias("path"), F.lit(note).alias("is_note"), F.lit(text).alias("text"), F.lit("x").alias("digest")) for name, note, text in (
        ("/README.md", True, INDEX), ("/.DS_Store", False, None), ("/OneNote_RecycleBin/01 - Out.md", True, "out"))]
    got = _cleaned(spark, me.union_all([files, *extra]), "scaffolding", "recycle-bin")
    return got["actions"].where("action = 'delete'").select("path", "detail")


_PAR = f"""{V}, c AS (SELECT * FROM v WHERE numbered AND NOT old), par AS (SELECT c.path, (SELECT arg_max(b.path, (b.num, b.page_id)) FROM c b WHERE b.folder = c.folder AND b.level < c.level AND b.num < c.num) AS parent FROM c)"""


@query(f"""WITH {_PAR} SELECT path, CASE WHEN EXISTS (SELECT 1 FROM par WHERE par.parent = c.path) THEN 'keep folder' ELSE 'delete' END AS action FROM c WHERE {_strip('body')} = ''""")
def cleaned_blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without content: deleted, or kept as folders of their sub-pages."""
    return _cleaned_vault(spark, sf_dir, "blank-pages")["actions"].select("path", "action")


_LEAD = r"^(?:[ \t\r\x0b\f\x{85}\p{Z}]*\n)*(?:[ \t\r\x0b\f\x{85}\p{Z}]+$)?"
_TAILED = f"""t AS (SELECT v.path, '[plan](' || repeat('../', len(string_split(v.path, '/')) - 2) || 'assets/plan.pdf)' || CASE WHEN page_id % 10 = 0 THEN chr(10) || '[gone](assets/gone%20' || page_id || '.png)' ELSE '' END
    || coalesce(chr(10) || (SELECT string_agg('![' || alt || '](assets/' || replace(name, ' ', '%20') || ')', chr(10) ORDER BY '![' || alt || '](assets/' || replace(name, ' ', '%20') || ')') FROM a WHERE a.page_path = v.path), '') AS tail FROM v)"""


@query(f"""WITH {V}, {_TAILED} SELECT path, CASE WHEN {_strip('body')} = '' THEN chr(10) ELSE chr(10) || regexp_replace(body || chr(10) || chr(10) || 'Attachments:' || chr(10) || tail, '{_LEAD}', '') END AS text FROM v JOIN t USING (path)""")
def cleaned_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note behind its front matter once its heading and date line are gone."""
    items = _cleaned_vault(spark, sf_dir, "header")["items"]
    return items.where("is_note").select("path", F.col("body").alias("text"))


@query(f"""WITH {V} SELECT path, '---' || chr(10) || array_to_string(list_filter(['title: ' || to_json(title), 'level: ' || level, CASE WHEN coalesce(created, '') <> '' THEN 'created: ' || to_json(created) END, CASE WHEN coalesce(modified, '') <> '' THEN 'modified: ' || to_json(modified) END], lambda x: x IS NOT NULL), chr(10)) || chr(10) || '---' || chr(10) AS head FROM v""")
def cleaned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front matter of every note once the fields that its folders show are gone."""
    items = _cleaned_vault(spark, sf_dir, "frontmatter")["items"]
    return items.where("is_note").select("path", F.regexp_extract("text", r"(?s)\A---\n.*?\n---\n", 0).alias("head"))


# users' folders part by part: the shared folder ends before the first place where parts differ or a user has none
_PLANS = """u AS (SELECT top, folder FROM v WHERE NOT old AND {body} <> ''), parts AS (SELECT top, i, count(DISTINCT string_split(folder, '/')[i]) AS kinds, count(string_split(folder, '/')[i]) AS n, min(string_split(folder, '/')[i]) AS part FROM u, LATERAL (SELECT unnest(generate_series(1, 12)) AS i) GROUP BY top, i),
  users AS (SELECT top, count(*) AS users FROM u GROUP BY top), off AS (SELECT top, min(i) AS i FROM parts JOIN users USING (top) WHERE kinds <> 1 OR n <> users GROUP BY top),
  shared AS (SELECT parts.top, string_agg(part, '/' ORDER BY parts.i) AS folder FROM parts JOIN off ON parts.top = off.top AND parts.i < off.i GROUP BY parts.top)""".format(body=_strip("body"))
_MOVED = f"""{V}, {_PLANS}, m AS (SELECT folder || '/assets/' || name AS path, folder || '/' || name AS target, min(digest) AS digest, bool_or(used) AS used
      FROM (SELECT a.*, (SELECT {_strip('body')} <> '' AND NOT old FROM v WHERE v.path = a.page_path) AS used FROM a) GROUP BY folder, name
    UNION ALL SELECT DISTINCT v.top || '/assets/plan.pdf', coalesce(shared.folder, v.top) || '/plan.pdf', sha1(v.top || '/assets/plan.pdf'), shared.folder IS NOT NULL FROM v LEFT JOIN shared USING (top)),
  d AS (SELECT *, min(path) OVER (PARTITION BY lower(target), digest) AS first FROM m), k AS (SELECT path, target, row_number() OVER (PARTITION BY lower(target) ORDER BY path) AS n FROM d WHERE path = first)"""


@query(f"""WITH {_MOVED} SELECT path AS orig, CASE WHEN n = 1 THEN target ELSE regexp_replace(target, '\\.[^.]*$', '') || ' (' || n || ')' || regexp_extract(target, '\\.[^.]*$') END AS path FROM k""")
def cleaned_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the attachments stand once each has moved to the folder that its pages share; doubles have merged."""
    items = _cleaned_vault(spark, sf_dir, "attachments")["items"]
    return items.where("not is_note").select("orig", "path")


@query(f"""WITH {V} SELECT path, 'assets/gone%20' || page_id || '.png' AS dest, 'missing' AS why FROM v WHERE page_id % 10 = 0 AND {_strip('body')} <> ''""")
def cleaned_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the vault's own kind that nothing satisfies (bodies hold others too, which are left out here)."""
    return _cleaned_vault(spark, sf_dir, "attachments")["broken"].where("dest like 'assets/gone%'")


@query(f"""WITH {V}, w AS (SELECT path, folder, coalesce(regexp_extract(section, '(\\d+)$', 1), '') AS d, num, numbered, notebook, title FROM v WHERE NOT old),
  x AS (SELECT *, top || '/Pages ' || d || '01-' || (d::int + 1) || '00' AS chunk FROM (SELECT w.*, regexp_replace(folder, '/[^/]*$', '') AS top FROM w WHERE d <> '')),
  y AS (SELECT path, chunk || '/' || {_name('path')} AS orig, top, CASE WHEN numbered THEN d::int * 100 + num END AS n FROM x), z AS (SELECT *, greatest(2, length((coalesce(max(n) OVER (PARTITION BY top), 0))::varchar)) AS width FROM y)
  SELECT orig, top || '/' || CASE WHEN n IS NULL THEN {_name('path')} ELSE lpad(n::varchar, width::int, '0') || ' - ' || {_stripnum('path')} || '.md' END AS path FROM z""")
def cleaned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of folders such as `Pages 101-200`, as numbered sections here become, merged into the folder above and renumbered."""
    p = pages(spark, sf_dir).where(~F.array_contains(F.split(tx.dirname("path"), "/"), "_versions") & F.col("section").rlike(r"\d+$"))
    d = F.regexp_extract("section", r"(\d+)$", 1)
    chunk = F.concat(F.regexp_replace(tx.dirname("path"), "/[^/]*$", ""), F.lit("/Pages "), d, F.lit("01-"), (d.cast("int") + 1).cast("string"), F.lit("00/"), tx.basename("path"))
    files = p.select(chunk.alias("path"), F.lit(True).alias("is_note"), F.lit("text").alias("text"), F.sha1("path").alias("digest"))
    return _cleaned(spark, files, "chunks")["items"].select("orig", "path")


@query(f"""WITH {V} SELECT top || ' (Evernote import on 2019-01-' || lpad(((length(top) % 28) + 1)::varchar, 2, '0') || 'T03-04)' || substring(path, length(top) + 1) AS orig, path FROM v""")
def cleaned_import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks that bear the suffix of an import lose it, each with another date."""
    top = F.substring_index("path", "/", 1)
    day = F.lpad((F.length(top) % 28 + 1).cast("string"), 2, "0")
    path = F.concat(top, F.lit(" (Evernote import on 2019-01-"), day, F.lit("T03-04)"), F.substring("path", F.length(top) + 1, F.length("path")))
    files = pages(spark, sf_dir).select(path.alias("path"), F.lit(True).alias("is_note"), F.lit("text").alias("text"), F.sha1("path").alias("digest"))
    return _cleaned(spark, files, "evernote-names")["items"].select("orig", "path")


@query(f"""WITH {V}, r AS (SELECT path, arg_max({_strip('new_title')}, rename_id) AS new_title FROM renames WHERE {_strip("coalesce(new_title, '')")} <> '' GROUP BY path)
  SELECT path, title AS old_title, new_title, 'renames file' AS source FROM v JOIN r USING (path) WHERE numbered AND NOT old AND new_title <> title""")
def cleaned_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a rename file gives another title."""
    r = table(spark, sf_dir, "renames").where(tx.strip(F.coalesce("new_title", F.lit(""))) != "")
    renames = me.last_writer(r.withColumn("new_title", tx.strip("new_title")), ["path"], ["rename_id"], ["new_title"])
    return _cleaned(spark, vault(spark, sf_dir), "titles", renames=renames)["renames"].select("path", "old_title", "new_title", "source")


@query()
def cleaned_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole clean-up of the whole vault: where every file that stays has gone."""
    return _cleaned_vault(spark, sf_dir)["items"].select("orig", "path", "is_note", F.length("text").alias("n_chars"))


@query()
def cleaned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole clean-up did, by step and action."""
    return cl.logged(_stepped_vault(spark, sf_dir)).groupBy("step", "action").agg(F.count("*").alias("n"))
