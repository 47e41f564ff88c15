"""Property sets of container objects: typed values, references by position, and the edges between objects."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.container import Cursor

# Property ids that pages are made of, by what they mean here.
PROPS = {
    "children": 0x24001C20, "content": 0x24001C1F, "lists": 0x24001C26, "structure": 0x24001D5F, "page_spaces": 0x2C001D63, "page_metas": 0x24003442,
    "text": 0x1C001C22, "text_ansi": 0x1C003498, "run_index": 0x1C001E12, "run_formats": 0x24001E13, "style": 0x2000342C, "style_id": 0x1C00345A,
    "bold": 0x08001C04, "italic": 0x08001C05, "underline": 0x08001C06, "strike": 0x08001C07, "superscript": 0x08001C08, "subscript": 0x08001C09,
    "is_link": 0x08001E14, "url": 0x1C001E20, "number_format": 0x1C001C1A, "is_title": 0x08001CB4, "is_date": 0x08001CB5, "cached_title": 0x1C001CF3,
    "page_cached_title": 0x1C001D3C, "level": 0x14001DFF, "picture": 0x20001C3F, "image_name": 0x1C001DD7, "image_alt": 0x1C001E58, "file": 0x20001D9B,
    "file_name": 0x1C001D9C, "tag_states": 0x40003489, "tag_definition": 0x20003488, "tag_label": 0x1C003468, "tag_shape": 0x10003464,
    "tag_status": 0x10003470, "tag_done": 0x1400346F, "modified": 0x14001D7A, "created": 0x18001C65, "version_time": 0x18001D77, "version_refs": 0x3400347B,
    "media_url": 0x1C0035F3, "toc_children": 0x24001CF6, "toc_name": 0x1C001D6B, "toc_index": 0x14001CB9, "toc_color": 0x14001CBE, "toc_display": 0x1C001D95,
}
# Object types.
KINDS = {
    "section": 0x60007, "series": 0x60008, "page": 0x6000B, "outline": 0x6000C, "element": 0x6000D, "text": 0x6000E, "image": 0x60011, "list": 0x60012,
    "group": 0x60019, "table": 0x60022, "row": 0x60023, "cell": 0x60024, "title": 0x6002C, "meta": 0x20030, "file": 0x60035, "manifest": 0x60037,
    "history": 0x6003C, "version": 0x6003D, "ink": 0x60014, "media": 0x60058,
}
KIND_NAMES = {v: k for k, v in KINDS.items()}
PROP_NAMES = {v: k for k, v in PROPS.items()}

NUMBERS = {3: 1, 4: 2, 5: 4, 6: 8}  # bytes of the numeric types
REFERENCES = {8: ("oid", False), 9: ("oid", True), 10: ("osid", False), 11: ("osid", True), 12: ("ctx", False), 13: ("ctx", True)}


class References:
    """Ids of an object, consumed by position; beyond the end there is None."""

    def __init__(self, oids: list, osids: list, contexts: list) -> None:
        self.left = {"oid": iter(oids), "osid": iter(osids), "ctx": iter(contexts)}

    def next(self, kind: str):
        return next(self.left[kind], None)


def kind_name(jcid: int) -> str:
    return KIND_NAMES.get(jcid, f"jcid_{jcid:08X}")


def prop_name(pid: int) -> str:
    return PROP_NAMES.get(pid, f"prop_{pid:08X}")


def stream_header(cur: Cursor) -> tuple[int, bool, bool]:
    """(number of ids, another stream follows, no second stream) of an id stream."""
    v = cur.uint(4)
    return v & 0xFFFFFF, bool(v >> 30 & 1), bool(v >> 31)


def decode_object(data: bytes, refs: list, cells: list) -> list[tuple[int, int, object]]:
    """(pid, type, value) of an object's properties in order; its ids stand in the order of its references."""
    cur = Cursor(data)
    n_oids, _, alone = stream_header(cur)
    cur.take(4 * n_oids)
    if alone:
        return property_set(cur, References(refs[:n_oids], [], []))
    n_osids = n_ctx = 0
    n_osids, more, _ = stream_header(cur)
    cur.take(4 * n_osids)
    if more:
        n_ctx, _, _ = stream_header(cur)
        cur.take(4 * n_ctx)
    return property_set(cur, References(refs[:n_oids], cells[:n_osids], cells[n_osids : n_osids + n_ctx]))


def property_set(cur: Cursor, refs: References) -> list[tuple[int, int, object]]:
    """All ids come first, then the values in their order."""
    n = cur.uint(2)
    out = []
    for prid in struct.unpack(f"<{n}I", cur.take(4 * n)):
        kind = prid >> 26 & 0x1F
        out.append((prid & 0x7FFFFFFF, kind, cur.take(cur.uint(4)) if kind == 7 else bool(prid >> 31) if kind == 2 else _value(cur, refs, prid)))
    return out


def _value(cur: Cursor, refs: References, prid: int) -> object:
    kind = prid >> 26 & 0x1F
    if kind == 1:
        return None
    if kind in NUMBERS:
        return cur.uint(NUMBERS[kind])
    if kind in REFERENCES:
        which, many = REFERENCES[kind]
        return [refs.next(which) for _ in range(cur.uint(4))] if many else refs.next(which)
    if kind == 16:
        n = cur.uint(4)
        if not n:
            return []
        cur.take(4)  # the id that all inner sets share
        return [property_set(cur, refs) for _ in range(n)]
    if kind == 17:
        return property_set(cur, refs)
    raise ValueError(f"no property has type {kind:#x}, at {cur.at}")


PROPERTY_ROWS = "file string, cell string, oid string, ord int, pid bigint, name string, type int, num decimal(20,0), flag boolean, bytes binary, refs array<string>, inner string"


def properties(nodes: DataFrame) -> DataFrame:
    """One row a property of every node; of several with the same id the first counts (lowest ``ord``).

    Inner property sets are told as text; the renderer reads them from the bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.props is None:
                    continue
                for i, (pid, kind, v) in enumerate(decode_object(bytes(r.props), _list(r.refs), _list(r.cells))):
                    ids = v if isinstance(v, list) and kind in (9, 11, 13) else [v] if kind in (8, 10, 12) else None
                    out.append((r.file, r.cell, r.oid, i, pid, prop_name(pid), kind, v if isinstance(v, int) and not isinstance(v, bool) else None, v if isinstance(v, bool) else None,
                                v if isinstance(v, bytes) else None, ids, str(v) if kind in (16, 17) else None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PROPERTY_ROWS.split(", ")])

    return nodes.select("file", "cell", "oid", "props", "refs", "cells").mapInPandas(run, PROPERTY_ROWS)


def _list(x) -> list:
    return [] if x is None else list(x)


def edges(props: DataFrame) -> DataFrame:
    """(file, cell, src, pid, pos, dst) of references between objects; empty references are left out, positions stay."""
    first = props.where("type in (8, 9)").groupBy("file", "cell", "oid", "pid").agg(F.min_by("refs", "ord").alias("refs"))
    return first.select("file", "cell", F.col("oid").alias("src"), "pid", F.posexplode("refs").alias("pos", "dst")).where("dst is not null")
