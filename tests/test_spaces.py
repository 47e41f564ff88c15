"""Section files read in one pass, against the joins of their facts."""

import pytest

import folioflow.session as session
from folioflow.plans import store_queries as sq
from folioflow.plans.queries import QUERIES
from folioflow.sources import container as co
from folioflow.sources import packing as pk
from folioflow.sources import properties as pr
from folioflow.sources import render as re_
from folioflow.sources import spaces as sp


def odd_files():
    """Sections of other shapes: a page twice in a series, unknown spaces and metadata, two series, versions of what is current or nowhere, no section at all, an older revision with more objects, a cut file."""
    page = lambda g, title: pk.Space(g, g * 10 + 1, g * 10 + 2).add(g * 10 + 1, "manifest", ("content", [g * 10 + 3])).add(g * 10 + 2, "meta", ("cached_title", title), ("level", 2)).add(g * 10 + 3, "page")
    section = pk.Space(50, 501).add(501, "section", ("children", [502, 599, 504, 505])).add(502, "series", ("page_spaces", [60, 99, 60, 61]), ("page_metas", [588, 511, 512]))
    section.add(504, "series", ("page_spaces", [62])).add(505, "list").add(511, "meta", ("cached_title", "first"), ("level", 3)).add(512, "meta", ("cached_title", "second"))
    bare = pk.Space(62, 621).add(621, "page", ("page_cached_title", "bare"), ("modified", 5))
    history = pk.Space(70, 701).add(701, "history", ("children", [702, 703, 799])).add(702, "version", ("version_refs", [63, 98, 60]), ("version_time", 129652901230000000)).add(703, "version", ("version_refs", [64]))
    base = pk.Space(61, 611, 612).add(613, "page", ("page_cached_title", "older")).add(619, "outline", ("children", [])).add(618, "ink", data=b"old bytes")
    whole = pk.container([section, page(60, "a"), page(61, "b"), bare, page(63, "c"), page(64, ""), history], {61: base})
    return {"whole": whole, "bare": pk.container([page(60, "x"), pk.Space(61, 611).add(612, "page"), page(62, "y")]), "sample": pk.sample(), "cut": whole[:-3], "section": pk.section_file([
        {"page_id": i, "path": f"N/S/{i}.md", "title": f"T{i}" if i % 3 else None, "notebook": "N", "section": "S", "level": 1, "created": 129652901230000000, "modified": i, "saved": 129652901230000000 + i, "is_version": i % 3 == 2} for i in range(9)])}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(f"/s/{k}.one", bytearray(v)) for k, v in odd_files().items()], "path string, content binary").cache()


@pytest.fixture(scope="module")
def graph(files):
    found = co.facts(files)
    return found, re_.graph(found)


def rows(df, *columns):
    return sorted(map(repr, df.select(*[df[c].cast("string") if kind == "timestamp" else df[c] for c, kind in df.select(*columns).dtypes]).collect()))


def test_objects_equal_the_joined_ones(files, graph):
    columns = ("file", "cell", "oid", "jcid", "props", "refs", "cells", "file_data")
    got = rows(sp.nodes(files), *columns)
    assert got == rows(graph[1][0], *columns) and len(got) > 300
    assert sp.nodes(files, "jcid").columns == ["jcid"]


def test_properties_and_edges_equal_the_joined_ones(files, graph):
    props = pr.properties(graph[1][0])
    columns = ("file", "cell", "oid", "ord", "pid", "name", "type")
    assert rows(sp.properties(files), *columns) == rows(props, *columns)
    columns = ("file", "cell", "src", "pid", "pos", "dst")
    assert rows(sp.edges(files), *columns) == rows(pr.edges(props), *columns)
    held = graph[1][0].selectExpr("file", "cell", "oid as dst")
    assert rows(sp.edges(files).where("known"), *columns) == rows(pr.edges(props).join(held, ["file", "cell", "dst"]), *columns)


def test_pages_and_dumps_equal_the_joined_ones(files, graph):
    want = re_.render_pages(*graph)
    assert rows(sp.pages(files), *want.columns) == rows(want, *want.columns) and want.count() > 15
    cells = want.select("file", "is_version", "idx", "cell")
    columns = ("file", "is_version", "idx", "cell", "json")
    assert rows(sp.dumps(files), *columns) == rows(re_.dump(*graph).join(cells, ["file", "cell"]), *columns)


def test_facts_are_told_by_column(files, graph):
    assert rows(co.told(files, "kind", "file"), "file", "kind") == rows(graph[0], "file", "kind")
    assert co.told(files, "kind").where("kind = 'error'").count() == 1


QUERIES_IN_ONE_PASS = ("container_facts", "container_nodes", "container_properties", "container_edges", "container_pages", "container_json", "container_faults")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    data = [(i, i, f"N/S/{i:02d} - T.md", f"T{i}", "N", None, "S", i, 1, "2020-01-02 03:04:05 UTC", None, i % 4 == 3) for i in range(12)]
    spark.createDataFrame(data, "row_id bigint, page_id bigint, path string, title string, notebook string, grp string, section string, idx bigint, level int, created string, modified string, is_version boolean").write.parquet(f"{out}/page_out.parquet")
    return out


@pytest.mark.parametrize("name", QUERIES_IN_ONE_PASS)
def test_containers_are_read_without_tables_between(spark, folder, name, monkeypatch):
    """The pages are written once; files, facts, objects and renderings, a hundred times as large, are not."""
    written = []
    whole = session.cut
    for module in (session, sq, re_):
        monkeypatch.setattr(module, "cut", lambda df: written.append(df.columns) or whole(df))
    sq._KEPT.clear()
    assert QUERIES[name](spark, folder).count() > 0
    assert len(written) == 1 and "page_id" in written[0]


def test_attachments_write_their_pages_once(spark, folder, monkeypatch):
    written = []
    whole = session.cut
    for module in (session, sq, re_):
        monkeypatch.setattr(module, "cut", lambda df: written.append(df.columns) or whole(df))
    sq._KEPT.clear()
    assert QUERIES["container_assets"](spark, folder).count() > 0 and QUERIES["container_bodies"](spark, folder).count() == 12
    assert sum("body" in columns for columns in written) == 1 and not any("refs" in columns for columns in written)
