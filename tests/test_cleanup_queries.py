"""The whole clean-up reads texts no more often than it must."""

import pytest

from folioflow.operators import links as li
from folioflow.plans import cleanup as cl
from folioflow.plans import cleanup_queries as cq

HEAD = "---\ntitle: {}\n---\n# {}\n\n"
NOTES = {
    "N/01 - A.md": HEAD.format("A", "A") + "[b](02%20-%20B.md) ![p](assets/image1.png)\n", "N/02 - B.md": HEAD.format("B", "B") + "[gone](03%20-%20C.md) [a](01%20-%20A.md)\n",
    "N/03 - Untitled page.md": HEAD.format("Untitled page", "Untitled page") + "![x](assets/Tide%20map.png)\n",
}


@pytest.fixture(scope="module")
def vault(spark):
    rows = [(path, True, text, path) for path, text in NOTES.items()] + [(f"N/assets/{n}", False, None, n) for n in ("image1.png", "Tide map.png")]
    return spark.createDataFrame(rows, "path string, is_note boolean, text string, digest string").cache()


def test_texts_are_read_for_links_once_after_the_last_change(vault, monkeypatch):
    read = []
    whole = li.links
    monkeypatch.setattr(li, "links", lambda *a: read.append(a) or whole(*a))
    got = {r["orig"]: r for r in cl.run(vault)["items"].collect()}
    assert len(read) == 2  # for images of pages without text before the titles change, and for all steps after that
    assert got["N/03 - Untitled page.md"]["path"] == "N/03 - Tide map.md" and "](02%20-%20B.md) ![p](A.png)" in got["N/01 - A.md"]["text"]


def test_the_log_needs_no_links_pointed_anew(spark, vault, monkeypatch):
    monkeypatch.setattr(cq, "vault", lambda spark, sf_dir: vault)
    monkeypatch.setattr(cl, "finish_links", lambda state: pytest.fail("links were pointed anew"))
    cq._STEPPED.clear() if hasattr(cq, "_STEPPED") else None
    got = {(r["step"], r["action"]): r["n"] for r in cq.cleaned_log(spark, "/no/folder").collect()}
    monkeypatch.undo()
    want = {}
    for r in cl.run(vault)["actions"].collect():
        want[r["step"], r["action"]] = want.get((r["step"], r["action"]), 0) + 1
    cq._STEPPED.clear()
    assert got == want and got["titles", "rename"] == 1
