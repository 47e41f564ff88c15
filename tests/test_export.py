import json

import pytest
from pyspark.sql import functions as F
from test_cleanup import tree

from folioflow.__main__ import main
from folioflow.functions.text import md_path
from folioflow.plans import namer as na
from folioflow.sources import export as ex
from folioflow.sources import packing as pk


def paths(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.startswith("."))


@pytest.fixture(scope="module")
def notebooks(tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    (root / "Log" / "Shelf").mkdir(parents=True)
    (root / "Log" / "Shelf" / "Tides.one").write_bytes(pk.sample())
    (root / "Log" / "Bad.one").write_bytes(b"junk")
    return root


def test_export_writes_notes_indexes_and_attachments(spark, notebooks, tmp_path):
    out = tmp_path / "out"
    assert main(["export", str(notebooks), "-o", str(out), "--versions"], spark) == 0
    assert paths(out) == ["Log/README.md", "Log/Shelf/Tides/01 - Tide tables notes.md", "Log/Shelf/Tides/02 - From the section.md", "Log/Shelf/Tides/README.md", "Log/Shelf/Tides/_versions/Tide tables - version 1 - 2011-11-09 05-28-43.md",
                          "Log/Shelf/Tides/assets/a b-1.png", "Log/Shelf/Tides/assets/a b.png"]
    note = (out / "Log/Shelf/Tides/01 - Tide tables notes.md").read_text()
    assert note.startswith('---\ntitle: "Tide tables: notes"\nnotebook: "Log"\nsection: "Tides"\nlevel: 1\ncreated: "2011-11-09 05:28:43 UTC"\nmodified: "1980-01-01 00:00:00 UTC"\n---\n\n# Tide tables: notes\n\nplain')
    assert (out / "Log/Shelf/Tides/assets/a b.png").read_bytes() == b"\x89PNG\r\n\x1a\nxyz"
    index = (out / "Log/Shelf/Tides/README.md").read_text().split("\n")
    assert index[:4] == ["# Tides", "", "Notebook: **Log** / Shelf  ", "Source: `Tides.one`"] and index[7].startswith("| 1 | [Tide tables: notes](01%20-%20Tide%20tables%20notes.md) | 1 | 2011-11-09 05:28:43 UTC | 1980-01-01 00:00:00 UTC | ")
    assert index[8].startswith("| 2 | &nbsp;&nbsp;&nbsp;[From the section](")
    assert "| [Shelf / Tides](Shelf/Tides/README.md) | 2 | 1 | " in (out / "Log/README.md").read_text()
    assert main(["export", str(notebooks), "-o", str(out)], spark) == 2  # it is there
    assert main(["export", str(tmp_path / "out" / "Log"), "-o", str(tmp_path / "none")], spark) == 1


def test_export_and_clean(spark, notebooks, tmp_path):
    out = tmp_path / "clean"
    assert main(["export", str(notebooks), "-o", str(out), "--tidy", "--skip", "titles,chunks,evernote-names,attachment-names,blank-pages,recycle-bin"], spark) == 0
    assert "Log/Shelf/Tides/Tide tables notes/Tide tables notes.md" in paths(out) and not any("README" in p for p in paths(out))
    assert not (tmp_path / "clean.export").exists() and (tmp_path / "clean-tidy-report" / "report.md").exists()


def test_clean_in_place(spark, tmp_path):
    source = tree(tmp_path / "vault")
    before = {p: (source / p).read_bytes() for p in paths(source)}
    assert main(["clean", str(source), "--in-place"], spark) == 0
    kept = tmp_path / "vault.before-1"
    assert {p: (kept / p).read_bytes() for p in paths(kept)} == before
    actions = [json.loads(x) for f in (tmp_path / "vault-tidy-report" / "actions.jsonl").glob("part-*") for x in f.read_text().splitlines()]
    assert {"step": "nest", "action": "delete", "path": "N/S/07 - Holder.md", "detail": "blank page; its folder holds the sub-pages"} in actions
    renames = spark.read.option("header", True).csv(str(tmp_path / "vault-tidy-report" / "renames.csv")).collect()
    assert [r["new_title"] for r in renames] == ["The pumps were moved before noon"]
    assert main(["clean", str(source), "-o", str(source / "inside")], spark) == 2 and main(["clean", str(source), "--skip", "nothing", "-o", str(tmp_path / "x")], spark) == 1


def test_dry_run_writes_a_report_only(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "01 - A.md").write_text("---\nlevel: 1\n---\n\ntext enough for a page\n")
    assert main(["clean", str(tmp_path / "v"), "--only", "frontmatter", "--dry-run", "--report", str(tmp_path / "r")], spark) == 0
    assert paths(tmp_path / "v") == ["01 - A.md"] and (tmp_path / "r" / "report.md").exists() and not (tmp_path / "v-tidy").exists()


def test_index_parts_follow_each_other(spark, tmp_path):
    pages = spark.range(1, 2501).select(F.lit("N").alias("notebook"), F.lit(None).cast("string").alias("grp"), F.lit("S").alias("section"), F.col("id").cast("int").alias("idx"), F.lit("T").alias("title"), F.lit(1).alias("level"), F.lit("").alias("created"), F.lit("").alias("modified"), F.lit(1).alias("paragraphs"), F.lit(1).alias("text_chars"))
    parts = ex.section_indexes(pages)
    assert parts.count() == 3
    ex.write_files(parts, str(tmp_path / "o"))
    rows = (tmp_path / "o" / "N" / "S" / "README.md").read_text().split("\n")
    assert len(rows) == 7 + 2500 + 1 and rows[7].startswith("| 1 |") and rows[-2].startswith("| 2500 |")
    assert ex.section_indexes(pages.limit(0)).count() == 0 and ex.taken_names(spark, ["N", "M"], str(tmp_path / "o")) == ["N"]


def test_namer(spark):
    rows = spark.createDataFrame([("a", "x...", "r", "p", "f", "secret password: hunter2 " + "y" * 3000), ("b", None, None, None, "f", None), ("c", "stop", "r", "p", "f", "t"), ("d", "late", "r", "p", "f", "t")], "orig string, title string, raw string, plain string, folder string, content string").coalesce(1)

    def ask(blocks):
        text = blocks[0]["text"]
        if "stop" in text:
            raise na.NoMore
        if "holds only the image" in text:
            return "no json"
        assert "hunter2" not in text and len(text) < 1700
        return '{"title": " A  new title. "}'

    got = {r["orig"]: r["new_title"] for r in na.namer(ask)(rows).collect()}
    assert got == {"a": "A new title", "b": None, "c": None, "d": None}
    images = spark.createDataFrame([("a.PNG", bytearray(b"xy")), ("a.txt", bytearray(b"xy")), ("b.jpg", bytearray(4_000_000))], "p string, c binary").select(na.image_block("p", "c").alias("b")).collect()
    assert images[0]["b"] == ("image/png", "eHk=") and images[1]["b"] is None and images[2]["b"] is None
    assert spark.range(1).select(md_path(F.lit("a b"))).first()[0] == "a%20b"
