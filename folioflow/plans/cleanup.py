"""The ordered, logged clean-up of a vault: immutable item frames threaded through steps.

An item is one file: ``orig`` (its first path), ``path`` (its present one), ``is_note``, ``digest``, ``deleted``,
``merged_into`` (the orig of its double), ``title``, ``body``, ``fm``, ``has_fm``, ``parent`` (orig of the parent page),
``folder_only`` and ``number``. A step takes and gives the items and adds to the log. Only the steps, and the few levels
of nesting, are loops of the driver; every step is a plan over all items. After steps that move items the
lineage is cut by a written table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import titles as ti
from folioflow.functions.text import RESERVED, basename, col, dirname, extension, level, number, page_title, path_key, safe_name, stem, strip, strip_number
from folioflow.operators import links as li
from folioflow.operators.hierarchy import child_numbers, descendants, parents
from folioflow.operators.merging import levels_of, settle_names, shared_folder
from folioflow.session import cut
from folioflow.sources.notes import drop_fields, front_matter, front_matter_text, get_field, set_field

# Names and patterns that decide what is scaffolding, a header, code or a sync conflict.
JUNK = (".ds_store", "thumbs.db", "desktop.ini", ".localized")
INDEX_TABLE = r"(?m)^\| (?:#|Section|Notebook) \| (?:Page|Pages|Sections) \|"
IMPORT_SUFFIX = r"^(.*\S)\s+\(Evernote import on \d{4}-\d{2}-\d{2}T[\d-]+\)$"
CODE = (".php", ".py", ".js", ".ts", ".json", ".bin", ".exe", ".dll", ".sh", ".bat", ".cmd", ".ps1", ".sql", ".java", ".cs", ".rb", ".go", ".jar", ".msi", ".dmg", ".apk", ".vbs")
CONFLICT = r"(?i)conflicted copy|\.sync-conflict-|\(case conflict|-conflict-\d"
RECYCLE = "OneNote_RecycleBin"
BLANK = r"(?:[^\S\n]*\n)*"
HEADING = rf"(?U)^{BLANK}# ([^\n]*)(?:\n|$){BLANK}(?:[^\S\n]+$)?"
DATE = rf"(?U)^\*[^*\n]*\b(?:1[89]|20)\d\d\b[^*\n]*\*[ \t]*(?:\n|$){BLANK}(?:[^\S\n]+$)?"
DAY = r"(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,?\s+[A-Z][a-z]+\s+\d{1,2},?\s+\d{4}"
OLD = rf"(?U)^{BLANK}[^\S\n]*([^\n]*)\n[^\S\n]*{DAY}[^\S\n]*(?:\n|$)(?:[^\S\n]*(?i:\d{{1,2}}:\d{{2}}\s*[AP]M)[^\S\n]*(?:\n|$))?{BLANK}(?:[^\S\n]+$)?"
LONG_PATH, NEAR_EMPTY, LIST_LIMIT, SECTION_LIMIT = 200, 20, 40, 200


def scaffolding_reason(path: str | Column, index: Column, keep_versions: bool = False, keep_json: bool = False) -> Column:
    """Why a file is no content of its own, first reason first, or NULL. ``index`` tells generated index files."""
    p = col(path)
    name, folders = basename(p), F.split(dirname(p), "/")
    reason = F.when(F.lower(name).isin(*JUNK) | name.startswith("._") | F.array_contains(folders, "__MACOSX"), "system file")
    if not keep_versions:
        reason = reason.when(F.array_contains(folders, "_versions"), "older page version")
    if not keep_json:
        reason = reason.when(F.array_contains(folders, "_json"), "JSON dump")
    return reason.when(index, "generated index").when(F.array_contains(folders, RECYCLE), "deleted in OneNote")


def without_import_suffix(name: str | Column) -> Column:
    return F.regexp_replace(col(name), IMPORT_SUFFIX, "$1")


def is_code(name: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(name), r"(\.[^.]*)$", 1)).isin(*CODE)


def is_conflict(path: str | Column) -> Column:
    return basename(path).rlike(CONFLICT)


def header_end(body: Column, first_title: Column, title: Column) -> Column:
    """Characters before the content: a heading that repeats a title, and an italic date line under it; 0 if there is none."""
    head = F.regexp_extract(body, HEADING, 0)
    names = strip(F.regexp_extract(body, HEADING, 1))
    found = (head != "") & ((names == strip(first_title)) | (names == strip(title)))
    date = F.regexp_extract(F.substring(body, F.length(head) + 1, F.length(body)), DATE, 0)
    return F.when(found, F.length(head) + F.length(date)).otherwise(F.lit(0))


def old_header_end(body: Column, title: Column) -> Column:
    """Characters of a title, day and time block at the start of a text, or 0."""
    text = F.replace(body, F.lit("\u00a0"), F.lit(" "))
    block = F.regexp_extract(text, OLD, 0)
    def squeezed(c: Column) -> Column:
        return strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when((block != "") & (squeezed(F.regexp_extract(text, OLD, 1)) == squeezed(title)), F.length(block)).otherwise(F.lit(0))


def content(body: Column, first_title: Column, title: Column) -> Column:
    return F.substring(body, header_end(body, first_title, title) + 1, F.length(body))


@dataclass
class Options:
    skip: frozenset[str] = frozenset()
    only: frozenset[str] = frozenset()
    renames: DataFrame | None = None
    folder_note: str = "same-name"  # same-name, zero or index
    folder_numbers: bool = False
    drop: list[str] | None = None
    keep: list[str] = field(default_factory=list)
    keep_versions: bool = False
    keep_json: bool = False
    chunk_pattern: str = r"Pages \d+-\d+"
    namer: Callable[[DataFrame], DataFrame] | None = None  # (orig, title, raw, plain, folder, content) -> (orig, new_title, by); see namer.py


@dataclass
class State:
    items: DataFrame
    actions: list[DataFrame] = field(default_factory=list)
    renames: DataFrame | None = None
    unlinked: DataFrame | None = None
    aimed: DataFrame | None = None  # links of all live notes with what they aim at, while no step changes texts
    ran: list[str] = field(default_factory=list)
    files: DataFrame | None = None
    attached: DataFrame | None = None

    def log(self, rows: DataFrame, step: str) -> None:
        """Rows with orig, action, detail, to_path and from_path (the last three may be missing)."""
        have = rows.columns
        text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
        self.actions.append(rows.select(F.lit(len(self.actions)).alias("step_no"), F.lit(step).alias("step"), F.col("action"), F.col("orig").alias("path"), text("detail").alias("detail"), text("to_path").alias("to_path"), text("from_path").alias("from_path")))


def load(files: DataFrame) -> DataFrame:
    """Items of a vault (path, is_note, text, digest, attached if there is such a column). The hierarchy is taken before anything is deleted."""
    n = front_matter("text")
    attached = F.col("attached") if "attached" in files.columns else F.lit(None).cast("string")
    items = files.select("path", "is_note", "digest", attached.alias("attached"), F.when(F.col("is_note"), n).alias("n"))
    items = items.select(
        F.col("path").alias("orig"), "path", "is_note", "digest", "attached", F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("merged_into"),
        F.coalesce("n.has_fm", F.lit(False)).alias("has_fm"), F.col("n.fm").alias("fm"), F.col("n.body").alias("body"), F.lit(False).alias("folder_only"))
    items = items.withColumn("title", F.when(F.col("is_note"), page_title(get_field(F.col("fm"), "title"), "path"))).withColumn("first_title", F.col("title"))
    items = cut(items.withColumn("level", level(F.coalesce(get_field(F.col("fm"), "level"), F.lit("1")))))
    pages = items.where(F.col("is_note") & number("path").isNotNull() & ~F.array_contains(F.split(dirname("path"), "/"), "_versions"))
    pages = pages.select("orig", dirname("path").alias("f"), number("path").cast("bigint").alias("o"), "level")
    # parents() works on numbers: a 60-bit hash stands for the path
    coded = pages.withColumn("id", F.shiftright(F.xxhash64("orig"), 3))
    found = parents(coded, "f", "o", "level", "id")
    names = coded.select("id", "orig")
    tree = found.join(names, F.col("page_id") == F.col("id")).select("parent_id", "orig").join(names.select(F.col("id").alias("parent_id"), F.col("orig").alias("parent")), "parent_id").select("orig", "parent")
    return cut(items.join(tree, "orig", "left"))


def alive(items: DataFrame) -> DataFrame:
    return items.where("not deleted")


def is_page() -> Column:
    return F.col("is_note") & number("path").isNotNull() & ~F.array_contains(F.split(dirname("path"), "/"), "_versions") & ~F.col("folder_only")


def delete(state: State, doomed: DataFrame, step: str) -> None:
    """Mark (orig, detail) as deleted and log it."""
    doomed = doomed.select("orig", "detail")
    rows = state.items.join(doomed.withColumn("__d", F.lit(True)), "orig", "left")
    state.items = rows.withColumn("deleted", F.col("deleted") | F.coalesce("__d", F.lit(False))).drop("__d", "detail")
    state.log(doomed.withColumn("action", F.lit("delete")), step)


def place(state: State, moves: DataFrame, step: str, action: str = "move") -> None:
    """Move (orig, target): identical attachments of one target merge, other clashes get ` (2)`, ` (3)` ...; all is logged.

    Names are taken in order of the first paths. What stays where it is keeps its name; folders of live items are
    names too. All movers of one target are numbered at once.
    """
    moves = moves.select("orig", "target")
    live = alive(state.items)
    base = stem("target")
    named = F.when(F.upper(base).isin(*RESERVED), F.concat(F.when(dirname("target") != "", F.concat(dirname("target"), F.lit("/"))).otherwise(F.lit("")), base, F.lit("_"), extension("target"))).otherwise(F.col("target"))
    movers = live.join(moves, "orig").where("target <> path").select("orig", "path", "is_note", "digest", named.alias("target"))
    movers = cut(movers.withColumn("k", path_key("target")))
    if movers.isEmpty():
        return
    rest = live.join(movers.select("orig"), "orig", "left_anti")
    held = rest.select(path_key("path").alias("k"), "orig", "is_note", "digest")
    folders = rest.select(F.explode(levels_of("path")).alias("f")).union(movers.select(F.explode(levels_of("target")).alias("f"))).distinct().select(path_key("f").alias("k"))
    # doubles: same target, same bytes, no notes; the one in place or the first mover stays
    stay = held.where("not is_note").select("k", "digest", F.col("orig").alias("to_orig"))
    movers = movers.join(stay.groupBy("k", "digest").agg(F.min("to_orig").alias("to_orig")), ["k", "digest"], "left")
    first = F.min("orig").over(Window.partitionBy("k", "digest", "is_note"))
    movers = movers.withColumn("to_orig", F.when(~F.col("is_note"), F.coalesce("to_orig", F.when(first != F.col("orig"), first))))
    movers = cut(movers.select("orig", "path", "target", "to_orig"))
    merged = movers.where("to_orig is not null").select("orig", "to_orig")
    left = movers.where("to_orig is null").select("orig", "path", "target")
    taken = cut(held.select("k").union(folders).distinct())
    folder = F.when(dirname("target") != "", F.concat(dirname("target"), F.lit("/"))).otherwise(F.lit(""))
    settled = settle_names(left.select("orig", F.concat(folder, stem("target")).alias("head"), extension("target").alias("tail")), taken, path_key)
    done = cut(settled.join(left.select("orig", F.col("path").alias("before")), "orig"))
    items = state.items.join(done, "orig", "left").join(merged, "orig", "left")
    items = items.withColumn("path", F.coalesce("final", "path")).withColumn("deleted", F.col("deleted") | F.col("to_orig").isNotNull()).withColumn("merged_into", F.coalesce("to_orig", "merged_into"))
    state.items = cut(items.drop("final", "before", "to_orig"))
    state.log(done.select("orig", F.lit(action).alias("action"), F.col("final").alias("to_path"), F.when(F.col("before") != F.col("orig"), F.col("before")).alias("from_path")), step)
    state.log(merged.select("orig", F.lit("merge").alias("action"), F.concat(F.lit("identical to "), "to_orig").alias("detail")), step)


def unique_folders(state: State, wanted: DataFrame) -> DataFrame:
    """``final`` folder names (orig, folder) that no live file or folder bears yet, nor another of them."""
    live = alive(state.items)
    taken = cut(live.select("path").union(live.select(F.explode(levels_of("path")))).distinct().select(path_key("path").alias("k")).distinct())
    return settle_names(wanted.select("orig", F.col("folder").alias("head"), F.lit("").alias("tail")), taken, path_key)


# ---------------------------------------------------------------- steps
def scaffolding(state: State, o: Options) -> None:
    """Index files, older versions, dumps and system files go."""
    index = (F.lower(basename("path")) == "readme.md") & F.col("is_note") & ~F.col("has_fm") & F.coalesce(F.col("body").rlike(INDEX_TABLE), F.lit(False))
    reason = scaffolding_reason("path", index, o.keep_versions, o.keep_json)
    doomed = alive(state.items).select("orig", reason.alias("detail")).where("detail is not null and detail <> 'deleted in OneNote'")
    delete(state, doomed, "scaffolding")


def recycle_bin(state: State, o: Options) -> None:
    doomed = alive(state.items).where(F.array_contains(F.split(dirname("path"), "/"), RECYCLE)).select("orig", F.lit("deleted in OneNote").alias("detail"))
    delete(state, doomed, "recycle-bin")


def blank_pages(state: State, o: Options) -> None:
    """Pages without content go, but for those with live children, whose folder stays."""
    live = alive(state.items)
    blank = live.where(is_page() & (strip(content(F.col("body"), F.col("first_title"), F.col("title"))) == "")).select("orig")
    holders = live.where("parent is not null").select(F.col("parent").alias("orig")).distinct().withColumn("kids", F.lit(True))
    judged = cut(blank.join(holders, "orig", "left"))
    kept = judged.where("kids").select("orig", F.lit(True).alias("__f"))
    delete(state, judged.where("kids is null").select("orig", F.lit("no content").alias("detail")), "blank-pages")
    state.items = cut(state.items.join(kept, "orig", "left").withColumn("folder_only", F.col("folder_only") | F.coalesce("__f", F.lit(False))).drop("__f"))
    state.log(kept.select("orig", F.lit("keep folder").alias("action"), F.lit("blank page with sub-pages").alias("detail")), "blank-pages")


def chunks(state: State, o: Options) -> None:
    """Folders such as `Pages 101-200` are merged into the folder above, their pages renumbered."""
    rule = f"(?i)^(?:{o.chunk_pattern})$"
    parts = F.split(dirname("path"), "/")
    hit = F.array_max(F.transform(parts, lambda p, i: F.when(p.rlike(rule), i + 1)))
    rows = alive(state.items).select("orig", "path", "is_note", hit.alias("at")).where("at is not null")
    p = F.split("path", "/")
    rows = rows.select("orig", "path", "is_note", F.get(p, F.col("at") - 1).alias("chunk"), F.array_join(F.slice(p, F.lit(1), F.col("at") - 1), "/").alias("top"), F.array_join(F.slice(p, F.col("at") + 1, F.size(p)), "/").alias("rest"))
    start = F.coalesce(F.nullif(F.regexp_extract("chunk", r"\d+", 0), F.lit("")).cast("bigint"), F.lit(1))
    paged = F.col("is_note") & ~F.col("rest").contains("/") & number("rest").isNotNull()
    n = F.when(paged, start - 1 + number("rest").cast("bigint"))
    rows = rows.withColumn("n", n).withColumn("w", F.greatest(F.lit(2), F.length(F.coalesce(F.max("n").over(Window.partitionBy("top")), F.lit(0)).cast("string"))))
    new = F.when(F.col("n").isNotNull(), F.concat(F.expr("lpad(cast(n as string), greatest(w, length(cast(n as string))), '0')"), F.lit(" - "), strip_number("rest"), F.lit(".md"))).otherwise(F.col("rest"))
    place(state, rows.select("orig", F.concat(F.when(F.col("top") != "", F.concat("top", F.lit("/"))).otherwise(F.lit("")), new).alias("target")), "chunks")


def import_names(state: State, o: Options) -> None:
    """Folder names lose the suffix that an import left."""
    clean = F.array_join(F.transform(F.split(dirname("path"), "/"), without_import_suffix), "/")
    rows = alive(state.items).select("orig", "path", clean.alias("d")).where(F.col("d") != dirname("path"))
    place(state, rows.select("orig", F.concat("d", F.lit("/"), basename("path")).alias("target")), "evernote-names")


def retitle(state: State, o: Options) -> None:
    """Poor titles are replaced, by a rename file if there is one, else by rules or a namer."""
    live = alive(state.items).where(is_page())
    if o.renames is not None:
        wanted = o.renames.select(path_key("path").alias("k"), "new_title")
        jobs = live.withColumn("k", path_key("orig")).join(wanted, "k").where("new_title <> title").select("orig", "title", F.lit("renames file").alias("reason"), "new_title", F.lit("renames file").alias("source"))
    else:
        rows = live.select("orig", "title", content(F.col("body"), F.col("first_title"), F.col("title")).alias("content"))
        rows = rows.select("orig", "title", "content", F.inline_outer(F.array(ti.first_content("content"))))
        rows = rows.withColumn("reason", ti.title_problem("title", F.coalesce("plain", F.lit("")))).where("reason is not null")
        images = _image_names(state, rows.where("plain is null").select("orig"))
        rows = rows.join(images, "orig", "left")
        ruled = rows.withColumn("new_title", ti.heuristic_title("title", "raw", "plain", "image"))
        if o.namer is not None:
            named = o.namer(rows.select("orig", "title", "raw", "plain", dirname("orig").alias("folder"), "content")).select("orig", F.col("new_title").alias("named"), "by")
            ruled = ruled.join(named, "orig", "left").withColumn("source", F.when(F.col("named").isNotNull(), F.col("by")).when(F.col("new_title").isNotNull(), "rules").otherwise("kept")).withColumn("new_title", F.coalesce("named", "new_title"))
        else:
            ruled = ruled.withColumn("source", F.when(F.col("new_title").isNotNull(), "rules").otherwise("kept"))
        jobs = ruled.select("orig", "title", "reason", "new_title", "source")
    jobs = cut(jobs)
    state.renames = jobs.select(F.col("orig").alias("path"), F.col("title").alias("old_title"), F.coalesce("new_title", F.lit("")).alias("new_title"), "reason", "source")
    new = jobs.where("new_title is not null").select("orig", F.trim(F.regexp_replace("new_title", r"\s+", " ")).alias("__new"))
    items = state.items.join(new, "orig", "left")
    head = F.regexp_extract("body", HEADING, 1)
    repeats = (F.regexp_extract("body", HEADING, 0) != "") & ((strip(head) == F.col("title")) | (strip(head) == F.col("first_title")))
    lead = F.regexp_extract("body", rf"(?U)^{BLANK}# ", 0)
    body = F.when(repeats, F.concat(lead, F.col("__new"), F.substring("body", F.length(lead) + F.length(head) + 1, F.length("body")))).otherwise(F.col("body"))
    renamed = F.col("__new").isNotNull()
    items = items.withColumn("body", F.when(renamed, body).otherwise(F.col("body"))).withColumn("fm", F.when(renamed & F.col("has_fm"), set_field(F.col("fm"), "title", F.col("__new"))).otherwise(F.col("fm"))).withColumn("title", F.coalesce("__new", "title"))
    state.items, state.aimed = cut(items), None
    moves = state.items.where("__new is not null").select("orig", F.concat(F.when(dirname("path") != "", F.concat(dirname("path"), F.lit("/"))).otherwise(F.lit("")), number("path"), F.lit(" - "), safe_name("__new"), F.lit(".md")).alias("target"))
    state.items = state.items.drop("__new")
    place(state, moves, "titles", "rename")


def _image_names(state: State, pages: DataFrame) -> DataFrame:
    """(orig, image): the name that the first telling image of a page gives."""
    notes = alive(state.items).where("is_note").join(pages, "orig")
    seen = resolved_links(state, notes, shared=False).where("is_image and item is not null")
    name = F.coalesce(ti.name_from_alt("alt", basename("item_path")), F.when(~ti.is_generic_asset(basename("item_path")), stem("item_path")))
    return seen.select("note", "ord", name.alias("name")).where("name is not null").groupBy(F.col("note").alias("orig")).agg(F.min_by("name", "ord").alias("image"))


def header(state: State, o: Options) -> None:
    """The heading and the date line that repeat the front matter go."""
    end = header_end(F.col("body"), F.col("first_title"), F.col("title"))
    rest = F.substring("body", end + 1, F.length("body"))
    all_ = end + old_header_end(rest, F.col("title"))
    items = state.items.withColumn("__e", F.when(F.col("is_note") & F.col("has_fm") & ~F.col("deleted"), all_).otherwise(0))
    items = cut(items.withColumn("body", F.when(F.col("__e") > 0, F.concat(F.lit("\n"), F.substring("body", F.col("__e") + 1, F.length("body")))).otherwise(F.col("body"))))
    state.log(items.where("__e > 0").select("orig", F.lit("edit").alias("action"), F.lit("removed title heading and date line").alias("detail")), "header")
    state.items, state.aimed = items.drop("__e"), None


def folder_note_name(way: str, folder: str | Column, path: str | Column) -> Column:
    """What the page of a folder is called in it: `index.md`, `00 - Title.md`, or the folder's own name."""
    if way == "index":
        return F.lit("index.md")
    return F.concat(F.lit("00 - "), strip_number(path), F.lit(".md")) if way == "zero" else F.concat(basename(folder), F.lit(".md"))


def nest(state: State, o: Options) -> None:
    """Pages with sub-pages become folders that hold them; one round a level, from the top."""
    live = alive(state.items)
    kids = live.where("parent is not null").select("orig", "parent")
    front = live.where(F.col("is_note") & F.col("parent").isNull() & number("path").isNotNull()).select("orig")
    while True:  # one round a level of the hierarchy, which has no cycle
        holders = cut(front.join(kids.select(F.col("parent").alias("orig")).distinct(), "orig", "left_semi"))
        if holders.isEmpty():
            break
        now = alive(state.items).join(holders, "orig").select("orig", "path", "folder_only")
        label = F.when(F.lit(o.folder_numbers) & number("path").isNotNull(), F.concat(number("path"), F.lit(" - "), strip_number("path"))).otherwise(strip_number("path"))
        wanted = now.withColumn("folder", F.concat(F.when(dirname("path") != "", F.concat(dirname("path"), F.lit("/"))).otherwise(F.lit("")), label))
        made = cut(unique_folders(state, wanted).join(now, "orig"))
        note = folder_note_name(o.folder_note, "final", "path")
        delete(state, made.where("folder_only").select("orig", F.lit("blank page; its folder holds the sub-pages").alias("detail")), "nest")
        order = alive(state.items).select("orig", number("path").cast("bigint").alias("o"), "path")
        below = kids.join(made.select(F.col("orig").alias("parent"), "final"), "parent").join(order, "orig")
        below = child_numbers(below, "parent", ["o", "orig"])
        moves = made.where("not folder_only").select("orig", F.concat("final", F.lit("/"), note).alias("target")).union(
            below.select("orig", F.concat("final", F.lit("/"), "label", F.lit(" - "), strip_number("path"), F.lit(".md"))))
        place(state, moves, "nest")
        front = cut(below.select("orig"))


def aimed_links(state: State, notes: DataFrame) -> DataFrame:
    """Links of notes with ``goal``, the first path of what they aim at. Texts were written at first paths, so neither moves nor merges change it."""
    return li.resolve(li.links(notes.where("is_note"), "orig", "body"), "orig", state.items.select(F.col("orig").alias("goal")), "goal", path_key)


def resolved_links(state: State, notes: DataFrame, shared: bool = True) -> DataFrame:
    """Links of notes with the item they reach: note, here, ord, start, end, dest, is_image, alt, inside, item, item_path, item_note, item_deleted.

    Links are read from a note's first folder, for its text was written there; merged items stand for their doubles. With
    ``shared`` the texts of all live notes are read once for all steps that don't change them.
    """
    if shared:
        if state.aimed is None:
            state.aimed = cut(aimed_links(state, alive(state.items)))
        found = state.aimed.join(notes.where("is_note").select("orig"), "orig", "left_semi")
    else:
        found = aimed_links(state, notes)
    # doubles of doubles: each chain of merges ends at the item that stayed
    merged = descendants(state.items.where("merged_into is not null").select("orig", "merged_into"), "orig", "merged_into")
    last = merged.join(state.items.where("merged_into is not null").select(F.col("orig").alias("root_id"), "merged_into"), "root_id").select(F.col("page_id").alias("goal"), F.col("merged_into").alias("stays"))
    ends = state.items.select(F.col("orig").alias("item"), F.col("path").alias("item_path"), F.col("is_note").alias("item_note"), F.col("deleted").alias("item_deleted"))
    reached = found.join(last, "goal", "left").withColumn("item", F.coalesce("stays", "goal")).drop("goal", "stays")
    return reached.join(ends, "item", "left").withColumnRenamed("orig", "note")


def attachments(state: State, o: Options) -> None:
    """Attachments move to the folder that all their pages share; those without pages leave their `assets` folder."""
    live = alive(state.items)
    notes = live.where("is_note").where(~F.array_contains(F.split(dirname("path"), "/"), "_versions"))
    used = resolved_links(state, notes).where("item is not null and not item_deleted and not item_note").join(notes.select(F.col("orig").alias("note"), dirname("path").alias("folder")), "note")
    shared = shared_folder(used, "item", "folder").select(F.col("item").alias("orig"), "folder")
    assets = cut(live.where("not is_note").join(shared, "orig", "left").select("orig", "path", "folder"))
    parts = F.split(dirname("path"), "/")
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p == "assets", i)))
    goal = F.coalesce("folder", F.when(last.isNotNull(), F.array_join(F.slice(parts, F.lit(1), last), "/")))
    loose = assets.where(F.col("folder").isNull() & last.isNotNull()).select(F.col("orig").alias("path"))
    state.unlinked = loose if state.unlinked is None else state.unlinked.union(loose)
    moves = assets.withColumn("goal", goal).where(F.col("goal").isNotNull() & (F.col("goal") != dirname("path")))
    place(state, moves.select("orig", F.concat(F.when(F.col("goal") != "", F.concat("goal", F.lit("/"))).otherwise(F.lit("")), basename("path")).alias("target")), "attachments")


def attachment_names(state: State, o: Options) -> None:
    """Generic file names give way to the alternative text, or to the page's title and a count."""
    live = alive(state.items)
    notes = live.where("is_note").where(~F.array_contains(F.split(dirname("path"), "/"), "_versions"))
    used = resolved_links(state, notes).where("item is not null and not item_deleted and not item_note")
    first = used.groupBy("item").agg(F.min_by(F.struct("note", "alt"), F.struct("note", "ord")).alias("x")).select(F.col("item").alias("orig"), "x.note", "x.alt")
    jobs = live.where("not is_note").where(ti.is_generic_asset(basename("path"))).select("orig", "path").join(first, "orig").join(notes.select(F.col("orig").alias("note"), F.col("title").alias("t"), F.col("path").alias("np")), "note")
    jobs = jobs.withColumn("told", ti.name_from_alt("alt", basename("path"))).where(F.col("told").isNotNull() | ~strip("t").rlike(ti.UNTITLED))
    n = F.row_number().over(Window.partitionBy("np", "t", F.col("told").isNull()).orderBy("orig"))
    name = F.coalesce("told", F.when(n > 1, F.concat_ws(" ", "t", n.cast("string"))).otherwise(F.col("t")))
    place(state, jobs.select("orig", F.concat(F.when(dirname("path") != "", F.concat(dirname("path"), F.lit("/"))).otherwise(F.lit("")), safe_name(name), extension("path")).alias("target")), "attachment-names", "rename")


def fields(state: State, o: Options) -> None:
    """Front-matter fields that the folders now show go."""
    drop = o.drop if o.drop is not None else ["notebook", "section", *(["level"] if "nest" in state.ran else [])]
    drop = [f for f in drop if f not in o.keep]
    held = F.filter(F.array(*[F.lit(f) for f in drop]), lambda f: F.exists("fm", lambda e: e["k"] == f)) if drop else F.array().cast("array<string>")
    rows = state.items.withColumn("__h", F.when(F.col("is_note") & ~F.col("deleted"), held).otherwise(F.array().cast("array<string>")))
    rows = cut(rows.withColumn("fm", F.when(F.size("__h") > 0, drop_fields(F.col("fm"), drop)).otherwise(F.col("fm"))))
    state.log(rows.where("size(__h) > 0").select("orig", F.lit("edit").alias("action"), F.concat(F.lit("removed "), F.array_join("__h", ", ")).alias("detail")), "frontmatter")
    state.items = rows.drop("__h")


STEPS: list[tuple[str, Callable[[State, Options], None]]] = [
    ("scaffolding", scaffolding), ("recycle-bin", recycle_bin), ("blank-pages", blank_pages), ("chunks", chunks), ("evernote-names", import_names), ("titles", retitle),
    ("header", header), ("nest", nest), ("attachments", attachments), ("attachment-names", attachment_names), ("frontmatter", fields),
]


def finish_links(state: State) -> DataFrame:
    """Point every local link at the final place of its target, once; gives the links that nothing satisfies (note, dest, why)."""
    notes = alive(state.items).where("is_note")
    found = cut(resolved_links(state, notes).where("inside").join(notes.select(F.col("orig").alias("note"), F.col("path").alias("here")), "note"))
    broken = found.where("item is null or item_deleted").select(F.col("here").alias("path"), "dest", F.when(F.col("item").isNull(), "missing").otherwise("removed").alias("why"))
    new = li.encoded(li.relative_path("item_path", dirname("here")))
    changes = found.where("item is not null and not item_deleted").select(F.col("note").alias("orig"), "start", "end", new.alias("new"), "dest").where("new <> dest")
    state.items = cut(li.rewrite(state.items, "orig", "body", changes.drop("dest")))
    return broken


def stepped(files: DataFrame, options: Options | None = None) -> State:
    """A vault after its steps, links still as they were. Unknown step names raise ValueError."""
    o = options or Options()
    unknown = (set(o.skip) | set(o.only)) - {name for name, _ in STEPS}
    if unknown:
        raise ValueError(f"no such step: {', '.join(sorted(unknown))}")
    loaded = load(files)
    state = State(loaded.drop("attached"), files=files, attached=loaded.where("attached is not null").select("orig", "attached"))
    for name, step in STEPS:
        if name in o.skip or (o.only and name not in o.only):
            continue
        step(state, o)
        state.ran.append(name)
    return state


def logged(state: State) -> DataFrame:
    """All that the steps logged, in their order; pointing links at their targets logs nothing."""
    actions = state.items.sparkSession.createDataFrame([], "step_no int, step string, action string, path string, detail string, to_path string, from_path string")
    for a in state.actions:
        actions = actions.unionByName(a)
    return actions


def run(files: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """Clean a vault: items (with final paths and texts), actions, renames, findings, broken links and what needs attention. Nothing is written; see :func:`write`."""
    return finished(stepped(files, options))


def finished(state: State) -> dict[str, DataFrame]:
    from folioflow.functions.scan import scan

    files, attached = state.files, state.attached
    broken = finish_links(state)
    text = F.when(F.col("is_note"), F.when(F.col("has_fm"), F.concat(front_matter_text(F.col("fm")), "body")).otherwise(F.col("body")))
    items = cut(alive(state.items).select("path", "orig", "is_note", "digest", "title", "has_fm", "first_title", "body", text.alias("text")))
    inner = content(F.col("body"), F.col("first_title"), F.col("title"))
    sparse = F.length(F.regexp_replace(inner, r"(?U)\s", ""))
    lit = lambda kind, c: items.where(c).select(F.lit(kind).alias("kind"), "path")
    attention = (
        lit("near empty", F.col("is_note") & F.col("has_fm") & (sparse > 0) & (sparse < NEAR_EMPTY))
        .union(lit("code", ~F.col("is_note") & is_code(basename("path")) & ~F.array_contains(F.split(dirname("path"), "/"), "_json")))
        .union(lit("conflict", is_conflict("path"))).union(lit("long path", F.length("path") > LONG_PATH)))
    if "unreadable" in files.columns:
        attention = attention.union(files.where("unreadable").select(F.lit("unreadable").alias("kind"), "path"))
    if state.unlinked is not None:
        attention = attention.union(state.unlinked.select(F.lit("unlinked").alias("kind"), "path"))
    return {"items": items, "actions": logged(state), "renames": state.renames, "broken": broken, "attention": attention, "findings": scan(items.join(attached, "orig", "left").select("path", F.coalesce("text", "attached", F.lit("")).alias("text")))}


def report(result: dict[str, DataFrame]) -> str:
    """The report's text. Lists are cut at SECTION_LIMIT and LIST_LIMIT rows with the number of the rest; only those rows reach the driver."""
    lines = ["# Tidy report", "", "## Needs your attention", ""]
    a = result["attention"].unionByName(result["broken"].select(F.lit("broken link").alias("kind"), F.concat_ws(" → ", "path", "dest").alias("path")))
    a = a.unionByName(result["findings"].select(F.lit("sensitive").alias("kind"), F.concat("path", F.lit(" line "), F.col("line").cast("string"), F.lit(" – "), "kind", F.lit(": "), "sample").alias("path")))
    lines += _section(a, "kind", ["path"], F.col("path"), SECTION_LIMIT) or ["Nothing found.", ""]
    shown = F.concat_ws(" ", "action", F.concat(F.lit("`"), "path", F.lit("`")), F.concat(F.lit("→ `"), "to_path", F.lit("`")), F.concat(F.lit("("), "detail", F.lit(")")))
    lines += ["## Changes by step", ""] + _section(result["actions"], "step", ["step_no", "path"], shown, LIST_LIMIT)
    return "\n".join(lines) + "\n"


def _section(rows: DataFrame, group: str, order: list[str], shown: Column, limit: int) -> list[str]:
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    top = rows.withColumn("__n", n).where(F.col("__n") <= limit).select(group, "__n", shown.alias("__s")).orderBy(group, "__n").collect()
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect()}
    out: list[str] = []
    for g in sorted(sizes):
        out += [f"### {g} ({sizes[g]})", "", *[f"- {r['__s']}" for r in top if r[group] == g]]
        if sizes[g] > limit:
            out.append(f"- … and {sizes[g] - limit} more")
        out.append("")
    return out


def write(result: dict[str, DataFrame], source: str, target: str) -> None:
    """Write the cleaned files below ``target`` (which must not exist): notes anew, all else copied byte by byte. See :func:`folioflow.sources.export.write_files`."""
    from folioflow.sources.export import write_files

    write_files(result["items"].select("path", "orig", "text"), target, source)


def write_report(result: dict[str, DataFrame], folder: str) -> None:
    """`actions.jsonl` and `renames.csv`, each a folder of part files, and `report.md` below a folder that must not exist."""
    from folioflow.sources.export import write_files

    spark = result["actions"].sparkSession
    text = spark.createDataFrame([("report.md", report(result))], "path string, text string")
    write_files(text, folder)
    shown = result["actions"].select("step", "action", "path", "detail", F.col("to_path").alias("to"), F.col("from_path").alias("from"))
    shown.write.mode("errorifexists").json(f"{folder}/actions.jsonl")
    if result["renames"] is not None:
        result["renames"].write.mode("errorifexists").option("header", True).option("escape", '"').csv(f"{folder}/renames.csv")


def clean_folder(spark: SparkSession, source: str, options: Options | None = None) -> dict[str, DataFrame]:
    from folioflow.sources.notes import read_vault

    return run(read_vault(spark, source), options)
