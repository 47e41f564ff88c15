"""Writes page containers: bytes of single files, and whole tables of pages as container files."""

from __future__ import annotations

import struct
import uuid
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import spread_by
from folioflow.sources.container import FORMAT, OBJECT_TYPES, SIGNATURE
from folioflow.sources.properties import KINDS, PROPS


def compact(n: int) -> bytes:
    if n == 0:
        return b"\0"
    for width in range(1, 8):
        if n < 1 << 7 * width:
            return (n << width | 1 << (width - 1)).to_bytes(width, "little")
    return b"\x80" + n.to_bytes(8, "little")


@lru_cache(1 << 17)  # objects of all files bear the same numbers
def guid(n: int) -> bytes:
    return uuid.UUID(int=n).bytes_le


def name(g: int, n: int) -> str:
    return f"{uuid.UUID(int=g)}/{n}"


@lru_cache(1 << 17)
def xid(g: int | None, n: int = 1) -> bytes:
    return b"\0" if g is None else bytes([n << 3 | 4]) + guid(g)


def pair(g: int) -> bytes:
    return xid(g) + xid(g, 2)


def obj(kind: str, payload: bytes, *children: bytes) -> bytes:
    t = OBJECT_TYPES[kind]
    big = len(payload) >= 0x7FFF
    head = (0x7FFF if big else len(payload)) << 17 | t << 3 | (4 if children else 0) | 2
    out = struct.pack("<I", head) + (compact(len(payload)) if big else b"") + payload
    if children:
        out += b"".join(children) + (bytes([t << 2 | 1]) if t < 64 else struct.pack("<H", t << 2 | 3))
    return out


def element(g: int, kind: int, *children: bytes) -> bytes:
    return obj("element", xid(g) + b"\0" + compact(kind), *children)


def pset(*props: tuple[str | int, object]) -> tuple[bytes, list[int]]:
    """Bytes of an object's properties and the ids it refers to, in order; (name, value) with value by its type."""
    head, body, refs = b"", b"", []

    def values(items):
        nonlocal refs
        ids, data = b"", b""
        for key, v in items:
            pid = PROPS[key] if isinstance(key, str) else key
            kind = pid >> 26 & 0x1F
            ids += struct.pack("<I", pid | (0x80000000 if kind == 2 and v else 0))
            if kind in (3, 4, 5, 6):
                data += int(v).to_bytes({3: 1, 4: 2, 5: 4, 6: 8}[kind], "little")
            elif kind == 7:
                v = v.encode("utf-16-le") if isinstance(v, str) else v
                data += struct.pack("<I", len(v)) + v
            elif kind == 8:
                refs.append(v)
            elif kind in (9, 11, 13):
                data += struct.pack("<I", len(v))
                {9: refs, 11: cells, 13: contexts}[kind].extend(v)
            elif kind == 16:
                data += struct.pack("<I", len(v)) + (struct.pack("<I", 0x44000000) if v else b"") + b"".join(values(x) for x in v)
        return struct.pack("<H", len(items)) + ids + data

    cells: list[int] = []
    contexts: list[int] = []
    body = values(list(props))
    head = struct.pack("<I", len(refs) | (0 if cells or contexts else 0x80000000)) + b"\0" * 4 * len(refs)
    if cells or contexts:
        head += struct.pack("<I", len(cells) | (0x40000000 if contexts else 0)) + b"\0" * 4 * len(cells)
    if contexts:
        head += struct.pack("<I", len(contexts)) + b"\0" * 4 * len(contexts)
    return head + body, refs, cells + contexts


@lru_cache(1 << 17)
def declaration(n: int, *counts: int) -> bytes:
    return obj("object_declare", xid(n) + b"".join(map(compact, counts)))


@lru_cache
def type_data(kind: str) -> bytes:
    return obj("object_data", b"\0\0" + compact(4) + struct.pack("<I", KINDS[kind]))


def packed(n: int, kind: str, props: tuple) -> tuple[bytes, bytes]:
    """An object's declarations and data: its type, and its properties if it has any."""
    declared, held = declaration(n, 4, 4, 0, 0), type_data(kind)
    if props or kind != "ink":
        raw, refs, cells = pset(*props)
        declared += declaration(n, 1, len(raw), len(refs), len(cells))
        held += obj("object_data", compact(len(refs)) + b"".join(map(xid, refs)) + compact(len(cells)) + b"".join(map(pair, cells)) + compact(len(raw)) + raw)
    return declared, held


packed_alike = lru_cache(1 << 15)(packed)  # objects that hold references alone are the same in many files


class Space:
    """One object space: objects by number, in one group of one revision."""

    def __init__(self, g: int, root: int, meta: int | None = None) -> None:
        self.g, self.root, self.meta = g, root, meta
        self.objects: list[tuple[int, str, tuple, bytes | None]] = []

    def add(self, n: int, kind: str, *props, data: bytes | None = None) -> "Space":
        self.objects.append((n, kind, props, data))
        return self

    def group(self, g: int, blobs: dict[int, bytes]) -> bytes:
        declared, held = [], []
        for n, kind, props, data in self.objects:
            if all(type(v) is list and k != "tag_states" or v is True for k, v in props):
                d, h = packed_alike(n, kind, tuple([(k, v if v is True else tuple(v)) for k, v in props]))
            else:
                d, h = packed(n, kind, props)
            declared.append(d)
            held.append(h)
            if data is not None:
                blob = 1 << 40 | n
                blobs[blob] = data
                declared.append(obj("blob_declare", xid(n) + xid(blob) + compact(2) + compact(0) + compact(0)))
                held.append(obj("object_blob_ref", b"\0\0" + xid(blob)))
        return element(g, 5, obj("declarations", b"", *declared), obj("group_data", b"", *held))


def container(spaces: list[Space], extra: dict[int, Space] | None = None) -> bytes:
    """A file of these spaces; ``extra`` maps a space to an older one that its revision builds on."""
    elements, index, blobs = [], [], {}
    for i, s in enumerate(spaces, 1):
        e = 1 << 41 | i * 100
        base = (extra or {}).get(s.g)
        index.append(obj("cell_mapping", pair(s.g) + xid(e) + b"\0"))
        index.append(obj("revision_mapping", xid(e + 1) + xid(e + 2) + b"\0"))
        elements.append(element(e, 3, obj("cell_revision", xid(e + 1))))
        roots = [obj("revision_root", xid(7, 1) + xid(s.root))] + ([obj("revision_root", xid(7, 2) + xid(s.meta))] if s.meta else [])
        elements.append(element(e + 2, 4, obj("revision", xid(e + 1) + xid(e + 11 if base else None)), *roots, obj("revision_groups", xid(e + 3))))
        elements.append(s.group(e + 3, blobs))
        if base:
            index.append(obj("revision_mapping", xid(e + 11) + xid(e + 12) + b"\0"))
            elements.append(element(e + 12, 4, obj("revision", xid(e + 11) + xid(e + 1)), *roots, obj("revision_groups", xid(e + 13))))
            elements.append(base.group(e + 13, blobs))
    elements += [element(b, 10, obj("blob", compact(len(c)) + c)) for b, c in blobs.items()]
    body = obj("start", b"", obj("package", b"", element(1, 1, *index), *elements))
    return SIGNATURE + b"\0" * 32 + uuid.UUID(FORMAT).bytes_le + b"\0" * 4 + body


PAGES_A_FILE = 100
CHECK, NUMBERED = "To Do", "\x03\ufffd\x00."
PICTURES = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"GIF89a")


def page_space(g: int, row: dict) -> Space:
    """One page as an object space: a title, a heading, a run of formats, a numbered list, a task, a table, a link field, code, and a picture or an attachment."""
    n = iter(range(g * 1000, g * 1000 + 1000))
    root, meta, page, outline = (next(n) for _ in range(4))
    s = Space(g, root, meta).add(root, "manifest", ("content", [page]))
    s.add(meta, "meta", *((k, v) for k, v in (("cached_title", row["title"] or ""), ("level", row["level"]), ("created", row["created"])) if v is not None))
    elements: list[int] = []
    files: list[int] = []
    blank, bold, italic, listed, task, heading, code = (next(n) for _ in range(7))
    s.add(blank, "text").add(bold, "text", ("bold", True)).add(italic, "text", ("italic", True))
    s.add(listed, "list", ("number_format", NUMBERED)).add(task, "ink", ("tag_label", CHECK), ("tag_shape", 3))
    s.add(heading, "text", ("style_id", "h2")).add(code, "text", ("style_id", "code"))

    def element(text: str, *props, of_text: tuple = ()) -> int:
        e, t = next(n), next(n)
        s.add(e, "element", ("content", [t]), *props).add(t, "text", ("text", text), *of_text)
        return e

    elements.append(element(row["section"], of_text=(("style", heading),)))
    runs = ["Notebook ", row["notebook"], ", level ", str(row["level"])]
    ends = [sum(map(len, runs[: i + 1])) for i in range(3)]
    elements.append(element("".join(runs), of_text=(("run_index", struct.pack("<3I", *ends)), ("run_formats", [blank, bold, blank, italic]))))
    elements += [element(part, ("lists", [listed])) for part in row["path"].split("/")]
    e, t = next(n), next(n)
    elements.append(e)
    s.add(e, "element", ("content", [t])).add(t, "text", ("text", f"Check {row['page_id']}"), ("tag_states", [[("tag_definition", task), ("tag_status", 1 - row["page_id"] % 2)]]))
    rows = []
    for words in (("page", "level"), (str(row["page_id"]), str(row["level"])), ("short|row",)):
        cells = []
        for w in words:
            c = next(n)
            s.add(c, "cell", ("children", [element(w)]))
            cells.append(c)
        r = next(n)
        s.add(r, "row", ("children", cells))
        rows.append(r)
    table, holder = next(n), next(n)
    s.add(table, "table", ("children", rows)).add(holder, "element", ("content", [table]))
    elements.append(holder)
    field = f'\ufddfHYPERLINK "https://notes.example/{row["page_id"]}"'
    elements.append(element(field + "source", of_text=(("run_index", struct.pack("<I", len(field))),)))
    elements.append(element(f"id = {row['page_id']}", of_text=(("style", code),)))
    s.add(outline, "outline", ("children", elements))
    kind, file, data = row["page_id"] % 3, next(n), next(n)
    files.append(file)
    if kind == 0:
        s.add(file, "image", ("picture", data), ("image_name", f"plan {row['page_id'] % 5}.png"), ("image_alt", f"Plan {row['page_id']}")).add(data, "ink", data=PICTURES[0] + bytes([row["page_id"] % 7]))
    elif kind == 1:
        s.add(file, "image", ("image_name", f"lost {row['page_id']}.png"))
    else:
        s.add(file, "file", ("file", data), ("file_name", f"sheet {row['page_id'] % 4}")).add(data, "ink", data=b"%PDF-" + bytes([row["page_id"] % 6]))
    props = [("children", [outline, *files])]
    if (row["title"] or "").strip():
        title, block = next(n), next(n)
        s.add(block, "title", ("children", [title])).add(title, "outline", ("is_title", True), ("children", [element(row["title"])]))
        props.insert(0, ("structure", [block]))
    if row["modified"] is not None:
        props.append(("modified", row["modified"]))
    return s.add(page, "page", *props)


def older(s: Space, title: str) -> Space:
    """A revision that a page's space builds on: its page bears another title and has an outline that the newer one no longer names."""
    page = next(o[0] for o in s.objects if o[1] == "page")
    return Space(s.g, s.root, s.meta).add(page, "page", ("page_cached_title", title)).add(s.g * 1000 + 999, "outline", ("children", []))


def section_file(rows: list[dict]) -> bytes:
    """A section of these pages in their order: current ones listed by the section, older versions by its history. Every fourth page has a base revision."""
    spaces = [(10 + i, r) for i, r in enumerate(rows)]
    built = {g: page_space(g, r) for g, r in spaces}
    current, old = [g for g, r in spaces if not r["is_version"]], [(g, r) for g, r in spaces if r["is_version"]]
    section = Space(1, 1001).add(1001, "section", ("children", [1002])).add(1002, "series", ("page_spaces", current), ("page_metas", [1100 + g for g in current]))
    for g in current:
        section.add(1100 + g, "meta", ("cached_title", "listed"), ("level", 1))
    history = Space(2, 2001).add(2001, "history", ("children", [2100 + g for g, _ in old]))
    for g, r in old:
        history.add(2100 + g, "version", ("version_refs", [g]), *([("version_time", r["saved"])] if r["saved"] is not None else []))
    bases = {g: older(built[g], f"before {r['page_id']}") for g, r in spaces if r["page_id"] % 4 == 0}
    return container([section, *(built[g] for g in current), *(built[g] for g, _ in old), *([history] if old else [])], bases)


def toc_file(entries: list[tuple[str, int, str]]) -> bytes:
    """A table of contents of (file name, index, display name), behind some other bytes as it is served."""
    toc = Space(1, 1001).add(1001, "manifest", ("toc_children", [1100 + i for i in range(len(entries))]))
    for i, (name_, index, display) in enumerate(entries):
        toc.add(1100 + i, "ink", ("toc_name", name_), ("toc_index", index), ("toc_display", display))
    return b"stub" * 9 + container([toc])


def ticks(c: str):
    """`yyyy-MM-dd HH:mm:ss UTC` as tenths of microseconds since 1601; NULL stays NULL."""
    return (F.unix_timestamp(F.substring(c, 1, 19), "yyyy-MM-dd HH:mm:ss") + F.lit(11_644_473_600)) * 10_000_000


def assigned(pages: DataFrame) -> DataFrame:
    """Pages with ``file``: about PAGES_A_FILE pages a file, however many pages a section has."""
    files = max(1, pages.count() // PAGES_A_FILE)
    return pages.withColumn("file", F.concat(F.lit("/packed/"), F.pmod("page_id", F.lit(files)).cast("string"), F.lit(".one")))


def pack(pages: DataFrame) -> DataFrame:
    """(path, content) of container files that hold these pages (page_id, path, title, notebook, section, level, created, modified, is_version, file), in order of page_id.

    A file is one group of bounded size.
    """
    rows = pages.select("file", "page_id", F.coalesce("path", F.lit("")).alias("path"), "title", F.coalesce("notebook", F.lit("")).alias("notebook"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("level", F.lit(1)).alias("level"),
                        ticks("created").alias("created"), (F.unix_timestamp(F.substring("modified", 1, 19), "yyyy-MM-dd HH:mm:ss") - F.lit(315_532_800)).alias("modified"), ticks("modified").alias("saved"), "is_version")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("page_id").astype(object).where(group.notna(), None).to_dict("records")
        return pd.DataFrame([{"path": ordered[0]["file"], "content": section_file(ordered)}])

    return spread_by(rows, "file").groupBy("file").applyInPandas(one, "path string, content binary")


def sample() -> bytes:
    """A section with two pages (a list, a table, a picture used twice, formats, a link field, a tag) and an older version."""
    section = Space(50, 501).add(501, "section", ("children", [502])).add(502, "series", ("page_spaces", [60, 61]), ("page_metas", [503, 599, 504]))
    section.add(503, "meta", ("cached_title", "Stale"), ("level", 1)).add(504, "meta", ("cached_title", "From the section"), ("level", 2))
    page = Space(60, 601, 602).add(601, "manifest", ("content", [603])).add(602, "meta", ("cached_title", "Own meta"), ("level", 1), ("created", 129652901230000000))
    page.add(603, "page", ("structure", [604]), ("children", [606, 640]), ("modified", 0))
    page.add(604, "title", ("children", [605])).add(605, "outline", ("is_title", True), ("children", [607])).add(607, "element", ("content", [608])).add(608, "text", ("text", "Tide tables: notes"))
    page.add(606, "outline", ("children", [610, 611, 612, 613, 614]))
    page.add(610, "element", ("content", [620])).add(620, "text", ("text", "plain bold"), ("run_index", struct.pack("<I", 6)), ("run_formats", [630, 631]))
    page.add(630, "text").add(631, "text", ("bold", True), ("italic", True))
    page.add(611, "element", ("content", [621])).add(621, "text", ("text", "  second line"))
    page.add(632, "list", ("number_format", "\x03�\x00.")).add(612, "element", ("lists", [632]), ("content", [622])).add(622, "text", ("text", "one"))
    page.add(613, "element", ("lists", [632]), ("content", [623])).add(623, "text", ("text", "two"))
    page.add(633, "ink", ("tag_label", "To Do"), ("tag_shape", 3))
    page.add(614, "element", ("content", [624])).add(624, "text", ("text", "call"), ("tag_states", [[("tag_definition", 633), ("tag_status", 1)]]))
    page.add(640, "image", ("picture", 641), ("image_name", "a b.png"), ("image_alt", "A plan")).add(641, "ink", data=b"\x89PNG\r\n\x1a\nxyz")
    second = Space(61, 701).add(701, "manifest", ("content", [703])).add(703, "page", ("children", [710, 740, 741, 742]))
    second.add(710, "outline", ("children", [711, 712])).add(711, "element", ("content", [720]))
    second.add(720, "text", ("text", '﷟HYPERLINK "https://veldt.example/a"here'), ("run_index", struct.pack("<I", 36)))
    second.add(712, "element", ("content", [730])).add(730, "table", ("children", [731, 732])).add(731, "row", ("children", [733])).add(732, "row", ("children", [734, 735]))
    for cell, el, tx, word in ((733, 736, 750, "h|1"), (734, 737, 751, "x"), (735, 738, 752, "y")):
        second.add(cell, "cell", ("children", [el])).add(el, "element", ("content", [tx])).add(tx, "text", ("text", word))
    second.add(740, "image", ("picture", 745), ("image_name", "a b.png")).add(745, "ink", data=b"other bytes")
    second.add(741, "image", ("picture", 746), ("image_name", "copy.png")).add(746, "ink", data=b"\x89PNG\r\n\x1a\nxyz")
    second.add(742, "image", ("image_name", "lost.png"))
    old = Space(62, 801, 802).add(801, "manifest", ("content", [803])).add(802, "meta", ("cached_title", "Tide tables")).add(803, "page")
    history = Space(63, 901).add(901, "history", ("children", [902])).add(902, "version", ("version_refs", [62, 60]), ("version_time", 129652901230000000))
    return container([section, page, second, old, history])
