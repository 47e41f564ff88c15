import pytest
from folioflow.sources.packing import Space, compact, container, guid, name, obj, pset, sample, xid

from folioflow.sources import container as co
from folioflow.sources import properties as pr
from folioflow.sources import render as re_


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 2**20, 2**35, 2**49 - 1, 2**60])
def test_compact_integers(n):
    assert co.Cursor(compact(n)).compact() == n


def test_extended_ids():
    assert co.Cursor(b"\0").xid() is None
    assert co.Cursor(xid(5, 3)).xid() == name(5, 3)
    assert co.Cursor(((700 << 6) | 0x20).to_bytes(2, "little") + guid(5)).xid() == name(5, 700)
    assert co.Cursor(((70000 << 7) | 0x40).to_bytes(3, "little") + guid(5)).xid() == name(5, 70000)
    assert co.Cursor(b"\x80" + (7).to_bytes(4, "little") + guid(5)).xid() == name(5, 7)
    with pytest.raises(ValueError):
        co.Cursor(b"\xff" * 20).xid()


def test_headers_and_tree():
    assert co.header(co.Cursor((0x0B << 3 | 5 << 9).to_bytes(2, "little"))) == (True, 0x0B, 5, False)
    assert co.header(co.Cursor(bytes([0x0B << 2 | 1]))) == (False, 0x0B, 0, False)
    inner = obj("blob", b"abc")
    got = co.flatten(co.Cursor(obj("declarations", b"x", inner)))
    assert [(e.parent, e.type, e.end - e.start) for e in got] == [(-1, 0x1D, 1), (0, 0x02, 3)]
    long = co.flatten(co.Cursor(obj("blob", b"z" * 40000)))
    assert long[0].end - long[0].start == 40000


def test_malformed_files_raise():
    with pytest.raises(ValueError):
        co.decode(b"\0" * 100)
    whole = obj("declarations", b"", obj("blob", b"abc"))
    with pytest.raises(EOFError):
        co.flatten(co.Cursor(whole[:-1]))
    with pytest.raises(ValueError):
        co.flatten(co.Cursor(whole[:-1] + bytes([0x02 << 2 | 1])))


def test_property_types():
    raw, refs, cells = pset(("bold", True), (0x0C001C03, 3), ("level", 2**32 - 1), ("created", 2**64 - 1), ("text", "aé"), ("children", [4, 5]), ("tag_states", [[("tag_status", 1)]]), ("page_spaces", [9]))
    got = pr.decode_object(raw, ["a", "b"], ["c"])
    assert [v for _, _, v in got[:6]] == [True, 3, 2**32 - 1, 2**64 - 1, "aé".encode("utf-16-le"), ["a", "b"]]
    assert got[6][2] == [[(pr.PROPS["tag_status"], 4, 1)]] and got[7][2] == ["c"]
    assert pr.decode_object(raw, ["a"], [])[5][2] == ["a", None]  # beyond the references there is nothing
    assert pr.prop_name(1) == "prop_00000001" and pr.kind_name(1) == "jcid_00000001"


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("/s/a.one", bytearray(sample())), ("/s/b.one", bytearray(b"junk"))], "path string, content binary")
    return files, co.facts(files).cache()


def test_bad_files_give_an_error_row(found):
    assert found[1].where("kind = 'error'").select("file").collect()[0][0] == "/s/b.one"


def test_pages_render(spark, found):
    pages, assets = re_.place_assets(re_.render_pages(found[1]))
    rows = {(r["is_version"], r["idx"]): r for r in pages.collect()}
    assert set(rows) == {(False, 1), (False, 2), (True, 1)}
    one, two, old = rows[False, 1], rows[False, 2], rows[True, 1]
    assert one["title"] == "Tide tables: notes" and one["level"] == 1 and one["created"].year == 2011 and one["modified"].year == 1980
    assert one["body"] == "plain ***bold***  \n  second line\n\n1. one\n2. two\n- [x] call\n![A plan](assets/a%20b.png)\n"
    # the unresolved second entry drops out, so the third stands second
    assert two["title"] == "From the section" and two["level"] == 2
    assert two["body"] == "[here](https://veldt.example/a)  \n| h\\|1 |  |\n| --- | --- |\n| x | y |\n![a b.png](assets/a%20b-1.png)\n![copy.png](assets/a%20b.png)\n![lost.png](missing-image)\n"
    assert two["warnings"] == ["image without data (filename='lost.png')"]
    assert old["title"] == "Tide tables" and old["version_time"].year == 2011
    assert sorted(r["path"] for r in assets.collect()) == ["assets/a b-1.png", "assets/a b.png"]


def test_newer_revision_wins(spark):
    new = Space(60, 601).add(601, "manifest", ("content", [603])).add(603, "page", ("page_cached_title", "new"))
    base = Space(60, 601).add(601, "manifest", ("content", [603])).add(603, "page", ("page_cached_title", "old")).add(605, "outline", ("children", []))
    files = spark.createDataFrame([("/s/c.one", bytearray(container([new], {60: base})))], "path string, content binary")
    nodes = {r["oid"]: r for r in co.nodes(co.facts(files)).collect()}
    assert len(nodes) == 3 and nodes[name(605, 1)]["jcid"] == 0x6000C
    page = pr.decode_object(bytes(nodes[name(603, 1)]["props"]), [], [])
    assert page[0][2] == "new".encode("utf-16-le")
    assert [r["title"] for r in re_.render_pages(co.facts(files)).collect()] == ["new"]


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_chains_of_revisions(spark, n):
    rows = [("f", "cell", 0, "c", "e", None), ("f", "current", 1, "e", "r0", None)]
    rows += [("f", "revision_map", 2 + i, f"r{i}", f"m{i}", None) for i in range(n)] + [("f", "revision", 50 + i, f"m{i}", f"r{i}", f"r{i + 1}" if i < n - 1 else "r0" if n == 7 else None) for i in range(n)]
    found = spark.createDataFrame(rows, "file string, kind string, ord bigint, key string, a string, b string")
    got = sorted((r["depth"], r["revision"], r["element"]) for r in co.revision_groups(found).collect())
    assert got == [(i, f"r{i}", f"m{i}") for i in range(n)]


def test_data_source(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.ONE").write_bytes(sample())
    co.register(spark)
    assert spark.read.format("pagestore").load(str(tmp_path)).where("kind = 'cell'").count() == 5
    assert co.read_sections(spark, str(tmp_path)).count() == 1


def test_properties_and_edges(found):
    props = pr.properties(co.nodes(found[1]))
    assert props.where("name = 'cached_title'").count() == 4
    assert pr.edges(props).where("src like '%/1'").count() > 20


def test_json_dump():
    n = {"a/1": re_.Node("a/1", 0x6000B, [(pr.PROPS["children"], 9, ["b/1", "a/1", None])], b"xy"), "b/1": re_.Node("b/1", 0x6000E, [(pr.PROPS["text"], 7, "hi".encode("utf-16-le"))], None)}
    got = re_.node_json(n, "a/1")
    assert got["children"][0]["text"] == "hi" and got["children"][1] == {"ref": "a/1"} and got["children"][2] is None and got["file_data_bytes"] == 2


@pytest.mark.parametrize(("text", "style", "marker", "want"), [
    ("T", "h1", "", ["## T"]), ("T", "h1", "- ", ["- T"]), ("a\nb", "code", "", ["```", "a", "b", "```"]), ("q", "blockquote", "", ["> q"]),
    ("c", "cite", "", ["*c*"]), ("a\nb", "", "- ", ["- a  ", "  b"]), ("", "h2", "", [""]),
])
def test_paragraph_styles(text, style, marker, want):
    assert re_.paragraph(text, style, "", marker) == want


def test_cells_and_clean_text():
    assert re_.cell_content(["a", "", "| x | y |", "| --- | --- |"]) == "a<br>x · y"
    assert re_.tidy_text("```\na\n```\n\n```\nb\n```\n") == "```\na\nb\n```\n"
    assert re_.tidy_text("a\n\n\n\n\nb\n  \nc") == "a\n\n\nb\n\nc\n"
