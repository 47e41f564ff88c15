"""Binary page containers: a reader that turns section files into tables of objects, properties and links.

A file is decoded in one pass over its bytes by an explicit stack (no recursion over the stream, so depth is
bounded by memory alone), inside Arrow batches of the executors; everything after that (revision closure,
last-writer merge, reference resolution) is relational and works on any number of files at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the published container format.
FORMAT = "638de92f-a6d4-4bc1-9a36-b3fc2511a5b7"
SIGNATURE = bytes.fromhex("e4525c7b8cd8a74daeb15378d02996d3")
OBJECT_TYPES = {
    "element": 0x01, "blob": 0x02, "blob_declare": 0x05, "revision_root": 0x0A, "cell_revision": 0x0B, "revision_mapping": 0x0D, "cell_mapping": 0x0E,
    "package": 0x15, "object_data": 0x16, "object_declare": 0x18, "revision_groups": 0x19, "revision": 0x1A, "object_blob_ref": 0x1C,
    "declarations": 0x1D, "group_data": 0x1E, "start": 0x7A,
}
ELEMENT_KINDS = {1: "index", 2: "storage", 3: "cell", 4: "revision", 5: "group", 6: "fragment", 10: "blob"}
SIMPLE = bytes([0, 0, 4 << 1 | 1])  # data without references or cells, of four bytes
TAGS = ((0x07, 0x04, 1, 3), (0x3F, 0x20, 2, 6), (0x7F, 0x40, 3, 7), (0xFF, 0x80, 5, 8))  # mask, tag, bytes, shift of an extended id


class Cursor:
    """A position in a buffer; reading past the end raises EOFError."""

    __slots__ = ("buffer", "at", "end")

    def __init__(self, buffer: bytes, at: int = 0, end: int | None = None) -> None:
        self.buffer, self.at, self.end = buffer, at, len(buffer) if end is None else end

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise EOFError(f"{n} bytes wanted at {self.at} of {self.end}")
        self.at += n
        return self.buffer[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def lead(self) -> int:
        if self.at >= self.end:
            raise EOFError(f"a byte wanted at {self.at}")
        return self.buffer[self.at]

    def compact(self) -> int:
        """A compact unsigned integer: as many bytes as its lowest set bit says."""
        lead = self.lead()
        if not lead:
            return self.uint(1)
        width = (lead & -lead).bit_length()
        if width == 8:
            return self.uint(9) >> 8
        return self.uint(width) >> width

    def guid(self) -> str:
        b = self.take(16)
        return f"{b[3::-1].hex()}-{b[5:3:-1].hex()}-{b[7:5:-1].hex()}-{b[8:10].hex()}-{b[10:].hex()}"

    def xid(self) -> str | None:
        """An extended id as `guid/n`; NULL for the empty id."""
        lead = self.lead()
        if not lead:
            self.at += 1
            return None
        for mask, tag, size, shift in TAGS:
            if lead & mask == tag:
                n = self.uint(size) >> shift
                return f"{self.guid()}/{n}"
        raise ValueError(f"no extended id starts with {lead:#x}, at {self.at}")

    def pair(self) -> str:
        """A cell id: two extended ids as `a|b`, empty ones as nothing."""
        a = self.xid()
        return f"{a or ''}|{self.xid() or ''}"

    def serial(self) -> None:
        kind = self.uint(1)
        if kind == 128:
            self.take(24)
        elif kind:
            raise ValueError(f"no serial number has type {kind}, at {self.at}")

    def many(self, one) -> list:
        return [one() for _ in range(self.compact())]

    def block(self) -> bytes:
        return self.take(self.compact())


class Entry(NamedTuple):
    """One stream object: its place in the file order, that of its parent, its type and the span of its payload."""

    id: int
    parent: int
    type: int
    start: int
    end: int


def header(cur: Cursor) -> tuple[bool, int, int, bool]:
    """(starts, type, length, holds others) of the next stream header."""
    kind = cur.lead() & 3
    if kind == 1:
        return False, cur.uint(1) >> 2, 0, False
    if kind == 3:
        return False, cur.uint(2) >> 2, 0, False
    if kind == 0:
        v = cur.uint(2)
        return True, v >> 3 & 0x3F, v >> 9, bool(v & 4)
    v = cur.uint(4)
    length = v >> 17
    return True, v >> 3 & 0x3FFF, cur.compact() if length == 0x7FFF else length, bool(v & 4)


def flatten(cur: Cursor) -> list[Entry]:
    """The stream object at the cursor and all it holds, parents before children."""
    return [Entry(*e) for e in _spans(cur)[0]]


def _spans(cur: Cursor) -> tuple[list[tuple], dict[int, list[tuple]]]:
    """The entries of :func:`flatten` as plain tuples, and those that each holds. Headers of usual form are read in place, for there is one every few bytes."""
    buffer, at, end = cur.buffer, cur.at, cur.end
    out: list[tuple] = []
    below: dict[int, list[tuple]] = {}
    open_: list[tuple] = []
    parent, siblings = -1, []
    word = struct.Struct("<I").unpack_from
    while True:
        if at >= end:
            if open_:
                raise EOFError(f"an object of type {open_[-1][2]:#x} does not end")
            raise EOFError(f"a byte wanted at {at}")
        lead = buffer[at]
        form = lead & 3
        if form == 2 and at + 4 <= end:
            v = word(buffer, at)[0]
            starts, kind, length, holds = True, v >> 3 & 0x3FFF, v >> 17, v & 4
            at += 4
            if length == 0x7FFF:
                cur.at = at
                length = cur.compact()
                at = cur.at
        elif form == 1:
            starts, kind = False, lead >> 2
            at += 1
        else:
            cur.at = at
            starts, kind, length, holds = header(cur)
            at = cur.at
        if starts:
            entry = (len(out), parent, kind, at, at + length)
            at += length
            if at > end:
                raise EOFError(f"{length} bytes wanted at {at - length} of {end}")
            out.append(entry)
            siblings.append(entry)
            if holds:
                open_.append(entry)
                parent = entry[0]
                siblings = below[parent] = []
        else:
            if not open_:
                raise ValueError(f"an end of type {kind:#x} without a start, at {at}")
            if open_[-1][2] != kind:
                raise ValueError(f"an end of type {kind:#x} for a start of type {open_[-1][2]:#x}, at {at}")
            open_.pop()
            parent = open_[-1][0] if open_ else -1
            siblings = below[parent] if open_ else []
        if not open_:
            cur.at = at
            return out, below


ROWS = "file string, kind string, ord bigint, key string, a string, b string, n bigint, refs array<string>, cells array<string>, data binary"


class Row(NamedTuple):
    """One fact of a file. What the columns hold depends on the kind:

    cell: key = cell, a = its element; revision_map: key = revision, a = its element; current: key = element, a = revision;
    revision: key = element, a = revision, b = base; root: key = element, n = role, a = object; group_ref: key = element, a = group;
    object: key = group, a = object, n = partition, b = blob, refs, cells, data; blob: key = element, data.
    """

    kind: str
    ord: int
    key: str | None = None
    a: str | None = None
    b: str | None = None
    n: int | None = None
    refs: list | None = None
    cells: list | None = None
    data: bytes | None = None


def decode(content: bytes) -> list[Row]:
    """All facts of one section file, in file order. A file of another format raises ValueError."""
    return [Row._make(r) for r in decode_rows(content)]


def decode_rows(content: bytes) -> list[tuple]:
    """The rows of :func:`decode` as plain tuples."""
    cur = Cursor(content)
    cur.take(48)
    if (found := cur.guid()) != FORMAT:
        raise ValueError(f"not a packaged page container (format {found})")
    cur.take(4)
    entries, below = _spans(cur)
    t = OBJECT_TYPES
    if entries[0][2] != t["start"]:
        raise ValueError(f"the package starts with type {entries[0][2]:#x}")
    package = next((e for e in below.get(0, ()) if e[2] == t["package"]), None)
    if package is None:
        raise ValueError("no data element package")
    rows: list[tuple] = []
    ids: dict[bytes, str] = {}
    for at, _, type_, start, end in below.get(package[0], ()):
        if type_ != t["element"]:
            continue
        c = Cursor(content, start, end)
        name = c.xid()
        c.serial()
        kind = ELEMENT_KINDS.get(c.compact())
        parts = below.get(at, ())
        if kind == "group":
            _objects(content, name, parts, below, rows, ids)
            continue
        for part in parts:
            type_, p = part[2], Cursor(content, part[3], part[4])
            n = len(rows)
            if kind == "index" and type_ == t["cell_mapping"]:
                cell = p.pair()
                rows.append(("cell", n, cell, p.xid(), None, None, None, None, None))
            elif kind == "index" and type_ == t["revision_mapping"]:
                rev = p.xid()
                rows.append(("revision_map", n, rev, p.xid(), None, None, None, None, None))
            elif kind == "cell" and type_ == t["cell_revision"]:
                rows.append(("current", n, name, p.xid(), None, None, None, None, None))
            elif kind == "revision" and type_ == t["revision"]:
                rev = p.xid()
                rows.append(("revision", n, name, rev, p.xid(), None, None, None, None))
            elif kind == "revision" and type_ == t["revision_root"]:
                role = p.xid()
                rows.append(("root", n, name, p.xid(), None, int(role.rpartition("/")[2]) if role else None, None, None, None))
            elif kind == "revision" and type_ == t["revision_groups"]:
                rows.append(("group_ref", n, name, p.xid(), None, None, None, None, None))
            elif kind == "blob" and type_ == t["blob"]:
                rows.append(("blob", n, name, None, None, None, None, None, p.block()))
    return rows


def _objects(content: bytes, group: str | None, parts: list[tuple], below: dict[int, list[tuple]], rows: list[tuple], ids: dict[bytes, str]) -> None:
    """Declarations and data of a group, paired by position; a blob is named by the declaration, else by the data.

    ``ids`` holds the ids of the file that were met before, by their bytes: most are met several times.
    """
    t = OBJECT_TYPES
    declare, blob_declare, object_data, blob_ref = t["object_declare"], t["blob_declare"], t["object_data"], t["object_blob_ref"]
    c = Cursor(content)

    def xid(at: int, end: int) -> str | None:
        """The id at a place, whose end is left in c.at."""
        if at + 17 <= end and content[at] & 7 == 4:
            c.at = at + 17
            key = content[at : at + 17]
            if (known := ids.get(key)) is None:
                known = ids[key] = f"{key[4:0:-1].hex()}-{key[6:4:-1].hex()}-{key[8:6:-1].hex()}-{key[9:11].hex()}-{key[11:].hex()}/{key[0] >> 3}"
            return known
        c.at, c.end = at, end
        return c.xid()

    def compact(end: int) -> int:
        at = c.at
        if at < end:
            lead = content[at]
            if lead & 1 or not lead:
                c.at = at + 1
                return lead >> 1
            if lead & 2 and at + 2 <= end:
                c.at = at + 2
                return (lead | content[at + 1] << 8) >> 2
        c.end = end
        return c.compact()

    held = {p[2]: below.get(p[0], ()) for p in reversed(parts)}
    declared: list[tuple[str | None, str | None, int]] = []
    for _, _, type_, start, end in held.get(t["declarations"], ()):
        if type_ == declare:
            key = content[start : start + 17]
            if start + 17 < end and key in ids and (lead := content[start + 17]) & 1:
                declared.append((ids[key], None, lead >> 1))
            else:
                declared.append((xid(start, end), None, compact(end)))
        elif type_ == blob_declare:
            declared.append((xid(start, end), xid(c.at, end), compact(end)))
    data = [d for d in held.get(t["group_data"], ()) if d[2] == object_data or d[2] == blob_ref]
    if len(data) > len(declared):
        raise ValueError(f"group {group} holds {len(data)} objects but declares {len(declared)}")
    n = len(rows)
    for (_, _, type_, start, end), (oid, blob, partition) in zip(data, declared):
        if type_ == object_data and end - start == 7 and content[start : start + 3] == SIMPLE:  # half of all objects tell a type
            rows.append(("object", n, group, oid, blob, partition, [], [], content[start + 3 : end]))
            n += 1
            continue
        c.at = start
        refs = [xid(c.at, end) for _ in range(compact(end))]
        cells = []
        if count := compact(end):
            c.end = end
            cells = [c.pair() for _ in range(count)]
        if type_ == object_data:
            c.end = end
            block = c.take(compact(end))
        else:
            block, blob = b"", blob or xid(c.at, end)
        rows.append(("object", n, group, oid, blob, partition, refs, cells, block))
        n += 1


def told(files: DataFrame, *columns: str) -> DataFrame:
    """Rows of ROWS for a frame of (path, content), all columns or those named, not written. A file that cannot be decoded gives one row of kind `error` with the reason in ``a``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    whole = _parse_datatype_string(ROWS)
    kept = type(whole)([whole[c] for c in columns or whole.names])
    arrow = to_arrow_schema(kept)
    at = [None if f.name == "file" else Row._fields.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path = path.as_py()
                try:
                    rows = decode_rows(content.as_py())
                except (ValueError, EOFError) as e:
                    rows = [Row("error", 0, a=str(e))]
                for i in range(0, len(rows), 5000):
                    part = rows[i : i + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part) if k is None else [r[k] for r in part], f.type) for k, f in zip(at, arrow)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, kept)


def facts(files: DataFrame) -> DataFrame:
    """The rows of :func:`told`. They are decoded once and written, for everything after reads them several times."""
    from folioflow.session import cut

    return cut(told(files))


def read_sections(spark: SparkSession, root: str) -> DataFrame:
    """Section files below a folder (any case of the extension), as (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[oO][nN][eE]").load(root)


def revision_groups(found: DataFrame) -> DataFrame:
    """(file, cell, revision, depth, element): the manifests of each cell's current revision and of its bases, newest first.

    The bases of all cells of all files are followed at once, by doubling: after round k a cell has met 2**k revisions of its chain
    and every revision knows the one 2**k steps below it. A chain ends where no base is, or where a revision comes again.
    """
    from folioflow.session import cut

    cells = _latest(found.where("kind = 'cell'")).select("file", F.col("key").alias("cell"), F.col("a").alias("element"))
    current = _latest(found.where("kind = 'current'")).select("file", F.col("key").alias("element"), F.col("a").alias("revision"))
    mapping = _latest(found.where("kind = 'revision_map'")).select("file", F.col("key").alias("revision"), F.col("a").alias("element"))
    manifest = _latest(found.where("kind = 'revision'")).select("file", F.col("key").alias("element"), F.col("b").alias("base"))
    steps = cut(mapping.join(manifest, ["file", "element"]))
    met = cut(cells.join(current, ["file", "element"]).select("file", "cell", "revision").join(steps.select("file", "revision"), ["file", "revision"], "left_semi").select("file", "cell", "revision", F.lit(0).cast("bigint").alias("depth")))
    jump = steps.where("base is not null").select("file", "revision", F.col("base").alias("below")).join(steps.select("file", F.col("revision").alias("below")), ["file", "below"], "left_semi")
    size = 1
    while True:
        far = met.join(jump, ["file", "revision"]).select("file", "cell", F.col("below").alias("revision"), (F.col("depth") + size).alias("depth"))
        # a revision that a cell has met before is no further one (a chain that runs in a circle ends)
        both = cut(met.withColumn("new", F.lit(False)).unionByName(far.withColumn("new", F.lit(True))).groupBy("file", "cell", "revision").agg(F.min("depth").alias("depth"), F.min("new").alias("new")))
        met = both.select("file", "cell", "revision", "depth")
        if both.where("new").isEmpty():
            break
        size *= 2
        jump = cut(jump.join(jump.select("file", F.col("revision").alias("below"), F.col("below").alias("lower")), ["file", "below"]).select("file", "revision", F.col("lower").alias("below")))
    return met.join(steps.select("file", "revision", "element"), ["file", "revision"])


def _latest(rows: DataFrame) -> DataFrame:
    """The last row of each key in a file; later entries override earlier ones."""
    return rows.groupBy("file", "key").agg(F.max_by(F.struct("a", "b"), "ord").alias("x")).select("file", "key", "x.a", "x.b")


def nodes(found: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """(file, cell, oid, jcid, props, refs, cells, file_data, ord): every object of every cell, newest part of each kind.

    Partition 4 names the type, 1 holds the properties, 2 the bytes of a file; an object is as new as its newest
    revision, within it as its last group. Blobs stand in where an object has no bytes of its own. ``chain`` is revision_groups, if it is at hand.
    """
    chain = revision_groups(found) if chain is None else chain
    refs = found.where("kind = 'group_ref'").select("file", F.col("key").alias("element"), F.col("a").alias("grp"), F.col("ord").alias("grp_ord"))
    held = found.where("kind = 'object'").select("file", F.col("key").alias("grp"), F.col("a").alias("oid"), F.col("b").alias("blob"), "n", "refs", "cells", "data", "ord")
    blobs = _blob(found)
    rows = chain.join(refs, ["file", "element"]).join(held, ["file", "grp"]).join(blobs, ["file", "blob"], "left")
    rows = rows.withColumn("data", F.when(F.length("data") > 0, F.col("data")).otherwise(F.coalesce("blob_data", F.col("data"))))
    newest = F.struct((-F.col("depth")).alias("d"), "grp_ord", "ord")
    def part(p: int, value):
        return F.max_by(value, F.when(F.col("n") == p, newest))
    got = F.struct("data", "refs", "cells")
    out = rows.groupBy("file", "cell", "oid").agg(part(4, F.col("data")).alias("type"), part(1, got).alias("p"), part(2, F.col("data")).alias("file_data"), F.min(F.struct(F.col("depth") * -1, "grp_ord", "ord")).alias("first"))
    jcid = _little_endian(F.col("type"))
    return out.select("file", "cell", "oid", jcid.alias("jcid"), F.col("p.data").alias("props"), F.col("p.refs").alias("refs"), F.col("p.cells").alias("cells"), "file_data", "first")


def _blob(found: DataFrame) -> DataFrame:
    return found.where("kind = 'blob'").groupBy("file", F.col("key").alias("blob")).agg(F.max_by("data", "ord").alias("blob_data"))


def _little_endian(b):
    """The first four bytes as an unsigned number; 0 for fewer."""
    h = F.hex(b)
    digits = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.when(F.length(b) >= 4, F.conv(digits, 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def roots(found: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """(file, cell, role, oid): the newest root object of each role of each cell."""
    chain = revision_groups(found) if chain is None else chain
    r = found.where("kind = 'root'").select("file", F.col("key").alias("element"), F.col("n").alias("role"), F.col("a").alias("oid"), "ord")
    return chain.join(r, ["file", "element"]).groupBy("file", "cell", "role").agg(F.max_by("oid", F.struct((-F.col("depth")).alias("d"), "ord")).alias("oid"))


class ContainerSource(DataSource):
    """``spark.read.format("pagestore").load(folder)``: the facts of all section files, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "pagestore"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options["path"])


class _FileReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        root = Path(self.path.removeprefix("file:"))
        files = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.suffix.lower() == ".one")
        return [InputPartition(str(p)) for p in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            content = f.read()
        try:
            rows = decode(content)
        except (ValueError, EOFError) as e:
            rows = [Row("error", 0, a=str(e))]
        for r in rows:
            yield (partition.value, *r)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
