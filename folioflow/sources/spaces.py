"""Section files in one pass each: the newest objects of every space, the order of the pages, and what is asked of them.

A file is decoded whole, so all that its parts say of each other is at hand in the same task: revisions, objects, order and
layout need no join, and nothing between the file and the answer is written or shuffled. The frames equal those of
`container.nodes`, `properties` and `render`, which join the facts of files that are kept as tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import filetime_exact
from folioflow.sources import container as co
from folioflow.sources import render as re_
from folioflow.sources.properties import KINDS, PROPS, decode_object, prop_name

ROWS_A_BATCH = 5000
ORDERING = frozenset(KINDS[k] for k in ("section", "series", "history", "version"))
_Q = "jcid bigint, props binary, refs array<string>, cells array<string>, file_data binary"


class Space:
    """The newest objects of a cell by id, each as [bytes that name its type, (data, refs, cells) of its properties, bytes of its file], and its roots by role."""

    __slots__ = ("objects", "roots")

    def __init__(self) -> None:
        self.objects: dict[str | None, list] = {}
        self.roots: dict[int | None, str | None] = {}

    def jcid(self, oid: str | None) -> int | None:
        """The type of an object, 0 where none is named; NULL if there is no such object."""
        held = self.objects.get(oid) if oid is not None else None
        return None if held is None else number(held[0])

    def node(self, oid: str, name: str | None = None, data: bool = True) -> re_.Node:
        type_, part, file_data = self.objects[oid]
        return re_.Node(name or oid, number(type_), decode_object(*part) if part else [], file_data if data else None)


def number(type_: bytes | None) -> int:
    return int.from_bytes(type_[:4], "little") if type_ and len(type_) >= 4 else 0


class Section:
    """A decoded file: its spaces by cell, in the order in which they are listed."""

    def __init__(self, rows: list[tuple]) -> None:
        by: dict[str, list[tuple]] = {}
        for row in rows:
            by.setdefault(row[0], []).append(row)
        get = lambda kind: by.get(kind, ())
        # the last row of a key counts; the first place of a cell is its place in the file
        self.places: dict[str, int] = {}
        self.names: dict[str, str] = {}
        elements: dict[str, str | None] = {}
        for _, ord_, cell, element, *_ in get("cell"):
            self.places.setdefault(cell, ord_)
            self.names[cell] = self.names[cell.partition("|")[0] + "|"] = cell
            elements[cell] = element
        current = {r[2]: r[3] for r in get("current")}
        mapping = {r[2]: r[3] for r in get("revision_map")}
        base = {r[2]: r[4] for r in get("revision")}
        blobs = {r[2]: r[8] for r in get("blob")}
        groups: dict[str | None, list[str | None]] = {}
        tops: dict[str | None, list[tuple]] = {}
        held: dict[str | None, list[tuple]] = {}
        for r in get("group_ref"):
            groups.setdefault(r[2], []).append(r[3])
        for r in get("root"):
            tops.setdefault(r[2], []).append((r[5], r[3]))
        for r in get("object"):
            held.setdefault(r[2], []).append(r)
        self.spaces: dict[str, Space] = {}
        for cell, element in elements.items():
            chain: dict[str, str] = {}
            revision = current.get(element) if element is not None else None
            while revision is not None and revision not in chain:
                manifest = mapping.get(revision)
                if manifest is None or manifest not in base:
                    break
                chain[revision] = manifest
                revision = base[manifest]
            space = Space()
            for manifest in reversed(chain.values()):  # from the oldest on: what comes later is newer
                for group in groups.get(manifest, ()):
                    for _, _, _, oid, blob, part, refs, cells, data in held.get(group, ()) if group is not None else ():
                        kept = space.objects.setdefault(oid, [None, None, None])
                        if not data and blob is not None:
                            data = blobs.get(blob, data)
                        if part == 4:
                            kept[0] = data
                        elif part == 1:
                            kept[1] = (data, refs, cells)
                        elif part == 2:
                            kept[2] = data
                space.roots.update(tops.get(manifest, ()))
            self.spaces[cell] = space

    def first(self, cell: str, oid: str, name: str):
        """The first value of an object's property; only objects that order pages have one here."""
        space = self.spaces[cell]
        if space.jcid(oid) not in ORDERING or not (part := space.objects[oid][1]):
            return None
        return next((v for pid, _, v in decode_object(*part) if pid == PROPS[name]), None)

    def order(self) -> list[tuple[int, str, str | None, str | None, bool, int | None]]:
        """(idx, cell, cell and id of the section's metadata, is_version, saved): current pages in section order, then older versions, as render.page_order has them."""
        tops = [(cell, self.spaces[cell].roots.get(1)) for cell in sorted(self.spaces, key=self.places.get)]
        kinds = [(cell, root, self.spaces[cell].jcid(root)) for cell, root in tops]
        section = next(((cell, root) for cell, root, kind in kinds if kind == KINDS["section"]), None)
        pages: list[tuple[str, str | None, str | None]] = []
        if section:
            cell, root = section
            for series in self.first(cell, root, "children") or ():
                if self.spaces[cell].jcid(series) != KINDS["series"]:
                    continue
                metas = [m for m in self.first(cell, series, "page_metas") or () if m is not None and m in self.spaces[cell].objects]
                for at, space in enumerate(self.first(cell, series, "page_spaces") or ()):
                    if space in self.names:
                        pages.append((self.names[space], *((cell, metas[at]) if at < len(metas) else (None, None))))
        else:
            pages = [(cell, None, None) for cell, _, kind in kinds if kind in (KINDS["manifest"], KINDS["page"])]
        current = {p[0] for p in pages}
        old: list[tuple[str, int | None]] = []
        for cell, root, kind in kinds:
            if kind == KINDS["history"]:
                for proxy in self.first(cell, root, "children") or ():
                    if proxy is None:
                        continue
                    found = [self.names[s] for s in self.first(cell, proxy, "version_refs") or () if s in self.names]
                    saved = self.first(cell, proxy, "version_time") if found else None
                    old += [(c, saved) for c in found if c not in current]
        return [(i, *p, False, None) for i, p in enumerate(pages, 1)] + [(i, c, None, None, True, saved) for i, (c, saved) in enumerate(old, 1)]

    def page(self, cell: str, meta_cell: str | None, meta_oid: str | None) -> dict:
        """A page laid out: see render.render."""
        space = self.spaces[cell]
        nodes = {oid: space.node(oid) for oid in space.objects if oid is not None}
        meta = nodes.get(space.roots.get(2))
        if meta is None and meta_cell is not None:
            meta = self.spaces[meta_cell].node(meta_oid, "meta", False)
        return re_.render(nodes, space.roots.get(1), meta)


def passed(files: DataFrame, schema: str, columns: tuple[str, ...], rows: Callable[[str, Section], Iterator[tuple]]) -> DataFrame:
    """What ``rows`` gives for each file of (path, content), all columns of ``schema`` or those named. A file that can't be decoded gives nothing (see container.facts)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    whole = _parse_datatype_string(schema)
    at = [whole.names.index(c) for c in columns or whole.names]
    kept = type(whole)([whole.fields[i] for i in at])
    arrow = to_arrow_schema(kept)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        lists = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(lists[i], f.type) for i, f in zip(at, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                found: list[tuple] = []
                path = path.as_py()
                try:
                    decoded = co.decode_rows(content.as_py())
                except (ValueError, EOFError):
                    continue
                for row in rows(path, Section(decoded)):
                    found.append(row)
                    if len(found) == ROWS_A_BATCH:
                        yield batch(found)
                        found = []
                if found:  # what a file gives is no larger than the file, what many give may be
                    yield batch(found)
                    found = []

    return files.select("path", "content").mapInArrow(run, kept)


def nodes(files: DataFrame, *columns: str) -> DataFrame:
    """(file, cell, oid, jcid, props, refs, cells, file_data): every object of every space, newest part of each kind."""

    def rows(path: str, section: Section) -> Iterator[tuple]:
        for cell, space in section.spaces.items():
            for oid, (type_, part, data) in space.objects.items():
                yield path, cell, oid, number(type_), *(part or (None, None, None)), data

    return passed(files, f"file string, cell string, oid string, {_Q}", columns, rows)


def properties(files: DataFrame, *columns: str) -> DataFrame:
    """(file, cell, oid, ord, pid, name, type): every property of every object."""

    def rows(path: str, section: Section) -> Iterator[tuple]:
        for cell, space in section.spaces.items():
            for oid, (_, part, _) in space.objects.items():
                if part:
                    for i, (pid, kind, _) in enumerate(decode_object(*part)):
                        yield path, cell, oid, i, pid, prop_name(pid), kind

    return passed(files, "file string, cell string, oid string, ord int, pid bigint, name string, type int", columns, rows)


def edges(files: DataFrame, *columns: str) -> DataFrame:
    """(file, cell, src, pid, pos, dst, known): references between objects, of several properties with one id the first; ``known`` tells whether the space holds the object."""

    def rows(path: str, section: Section) -> Iterator[tuple]:
        for cell, space in section.spaces.items():
            for oid, (_, part, _) in space.objects.items():
                seen: set[int] = set()
                for pid, kind, value in decode_object(*part) if part else ():
                    if kind in (8, 9) and pid not in seen:
                        seen.add(pid)
                        for pos, dst in enumerate(value if kind == 9 else [value]):
                            if dst is not None:
                                yield path, cell, oid, pid, pos, dst, dst in space.objects

    return passed(files, "file string, cell string, src string, pid bigint, pos int, dst string, known boolean", columns, rows)


def pages(files: DataFrame) -> DataFrame:
    """render.PAGE_ROWS of all pages; bodies hold tokens for attachments, which render.place_assets resolves."""
    schema = re_.PAGE_ROWS.replace("version_time timestamp", "version_time string")
    told = ("title", "level", "created", "modified", "body", "text_chars", "paragraphs", "warnings", "unknown", "assets")

    def rows(path: str, section: Section) -> Iterator[tuple]:
        for idx, cell, meta_cell, meta_oid, is_version, saved in section.order():
            got = section.page(cell, meta_cell, meta_oid)
            got["unknown"] = list(got["unknown"].items())
            yield path, idx, is_version, None if saved is None else str(saved), cell, *(got[k] for k in told)

    return passed(files, schema, (), rows).withColumn("version_time", filetime_exact(F.col("version_time").cast("decimal(20,0)")))


def dumps(files: DataFrame) -> DataFrame:
    """(file, is_version, idx, cell, json): the objects of each page's space from its root down, as render.node_json tells them."""

    def rows(path: str, section: Section) -> Iterator[tuple]:
        for idx, cell, _, _, is_version, _ in section.order():
            space = section.spaces[cell]
            if 1 not in space.roots or not space.objects:
                continue
            held = {oid: space.node(oid) for oid in space.objects if oid is not None}
            root = space.roots[1]
            yield path, is_version, idx, cell, json.dumps(re_.node_json(held, root) if root in held else {}, ensure_ascii=False, default=str)

    return passed(files, "file string, is_version boolean, idx bigint, cell string, json string", (), rows)
