"""The training-data operators on small tables: nulls, empty and repeated rows, extra columns, planted cases."""

import pytest
from pyspark.sql import functions as F

from folioflow.llm import encoding, langid, leakage, lookalike, markup, mixing, pii, queries, truncation

EN = "The librarian counted the {0} and the {1} on the {2}. Before closing the choir moved it to the {2}."
WORDS = ["pump", "kettle", "ledger", "seed tray", "rope", "map drawer", "lamp"]
SENTENCES = {
    "en": "The workshop team repaired the old {} before the meeting. Nobody had written down why it was there.",
    "de": "Die Werkstatt reparierte gestern den alten {} vor der Prüfung. Niemand hatte aufgeschrieben, warum er dort lag.",
    "nl": "De werkplaats herstelde gisteren het oude {} voor de controle. Niemand had opgeschreven waarom het daar lag.",
    "fr": "L’atelier a réparé hier le vieux {} avant la réunion. Personne n’avait noté pourquoi il était là.",
    "es": "El taller reparó ayer el viejo {} antes de la reunión. Nadie había escrito por qué estaba allí.",
    "pt": "A oficina reparou ontem o velho {} antes da reunião. Ninguém tinha escrito por que estava ali.",
    "it": "L’officina ha riparato ieri il vecchio {} prima della riunione. Nessuno aveva scritto perché era lì.",
    "pl": "Warsztat naprawił wczoraj stary {} przed zebraniem. Nikt nie zapisał, dlaczego tam leżał.",
    "ru": "Мастерская вчера починила старый {} перед собранием. Никто не записал, почему он там лежал.",
}


def test_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "# A *b* a@b.example Ã©", "z"), (3, "# A *b* a@b.example Ã©", "z")], "id int, body string, text string")
    m = {r["id"]: r for r in markup.clean_markup(rows).collect()}
    assert m[1]["body_clean"] is None and m[2]["body_clean"] == "" and m[3]["body_families"] == ["markdown"] and m[3]["text"] == "z"
    e = {r["id"]: r["body_repair"] for r in encoding.repair_encoding(rows, "body").collect()}
    assert e[1]["text"] is None and not e[2]["garbled"] and e[3]["text"].endswith("é")
    p = {r["id"]: r for r in pii.redact_columns(rows, "body", "text").collect()}
    assert p[1]["body_redacted"] is None and p[3]["body_kinds"] == ["email"] and p[3]["text_redacted"] == "z"
    c = {r["id"]: r for r in lookalike.consistent(rows, "body").collect()}
    assert c[1]["body_clean"] is None and c[2]["body_key"] == "" and c[3]["body_key"] == "# a *b* a@b.example ã©"
    for f in (lambda d: markup.clean_markup(d), lambda d: encoding.repair_encoding(d, "body"), lambda d: pii.redact_columns(d, "body"), lambda d: lookalike.consistent(d, "body")):
        assert f(rows.limit(0)).count() == 0


def test_same_look_pairs(spark):
    values = [(1, "rope A"), (2, "rоpe A"), (3, "rope\u00a0A"), (4, "Rope A"), (5, "rope A"), (6, None), (7, ""), (8, ""), (9, "alone"), (2, "rоpe A")]
    df = spark.createDataFrame(values, "page_id bigint, title string")
    shapes = {i: (lookalike.shape(v), v) for i, v in values if v}
    want = {(a, b) for a in shapes for b in shapes if a < b and shapes[a][0] == shapes[b][0] and shapes[a][1] != shapes[b][1]}
    got = [tuple(r) for r in lookalike.same_look(df, "page_id", "title").collect()]
    assert set(got) == want and len(got) == len(want)
    classes = {r["id"]: (r["class_id"], r["n_looks"]) for r in lookalike.look_classes(df, "page_id", "title").collect()}
    assert classes[1] == classes[3] == classes[5] and classes[1][1] == 3 and classes[4][1] == 1 and 6 not in classes
    assert lookalike.same_look(df.limit(0), "page_id", "title").count() == 0


def test_leaks(spark):
    long = "In the year of the sixth flood the peat cutters exhibited the lower quarry to honour a drowned cousin near the weir"
    items = spark.createDataFrame([(1, "r", long, "q", "a"), (2, "r", long, None, None), (3, "o", None, "What would a paper merchant give up in return for free passage over the river at night", "No"), (4, "o", "", None, None)], "item_id bigint, suite string, passage string, question string, answer string")
    docs = spark.createDataFrame([(1, f"Before. {long}. After."), (2, "In the year of the sixth flood nothing"), (3, None), (4, ""), (5, "- WHAT WOULD A PAPER MERCHANT GIVE UP IN RETURN FOR FREE PASSAGE"), (6, f"Before. {long}. After.")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (6, 1), (6, 2), (5, 3)}
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 and leakage.find_leaks(docs.limit(0), items).count() == 0


def test_leaks_in_blocks_are_the_same(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(6)]
    items = spark.createDataFrame([(i, "r", t, None, None) for i, t in enumerate(texts)], "item_id bigint, suite string, passage string, question string, answer string")
    docs = spark.createDataFrame([(i, "a b c " + t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 50)
    assert {(r[0], r[1]) for r in leakage.find_leaks(docs, items).select("doc_id", "item_id").collect()} == {(i, i) for i in range(6)}


def test_mix(spark):
    rows = [(i, EN.format(WORDS[i % 7], WORDS[i * 3 % 7], WORDS[i * 5 % 7]) + f" Number {i}.", "big") for i in range(60)]
    rows += [(100 + i, f"Die kleine Quelle {i} hat wenig Text.", "small") for i in range(6)] + [(200, rows[0][1], "big"), (201, None, "big"), (202, "", None), (203, "A text of no source at all.", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 1.0, 2), ("small", 1.0, 3), ("none", 0.5, 4), ("off", 0.0, None)], "source string, target_weight double, max_repeats int")
    got = mixing.mix(docs, targets)
    report = {r["source"]: r for r in got.report.collect()}
    assert {s for s, r in report.items() if r["out_of_reach"]} == {"small", "none"}
    assert report["small"]["most_copies"] == 3 and report["small"]["texts"] == 6 and report["off"]["tokens"] == 0
    assert abs(report["big"]["tokens"] - report["big"]["target_tokens"]) < 0.1 * report["big"]["target_tokens"]
    copies = {r["doc_id"]: r["copies"] for r in got.copies.collect()}
    assert 200 not in copies and max(copies.values()) <= 3
    assert mixing.mix(docs.limit(0), targets).report.where("out_of_reach").count() == 0


def test_language_on_held_out_texts(spark):
    train, test = [], []
    for k, (lang, text) in enumerate(SENTENCES.items()):
        for i in range(12):
            (train if i < 9 else test).append((100 * k + i, text.format(WORDS[i % 7]), lang))
    wrong = [(9001, SENTENCES["de"].format("Kessel"), "en"), (9002, SENTENCES["fr"].format("puits"), "?"), (9003, SENTENCES["it"].format("pozzo") + " " + SENTENCES["ru"].format("ключ"), "it"), (9004, None, "en"), (9005, "12 34", None)]
    docs = spark.createDataFrame(train, "doc_id bigint, text string, lang string")
    m = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(test + wrong, docs.schema), m).collect()}
    assert all(got[i]["found_lang"] == lang for i, _, lang in test)
    assert got[9001]["label_is"] == "wrong" and got[9002]["label_is"] == "missing" and {s["lang"] for s in got[9003]["segments"]} == {"it", "ru"}
    assert got[9004]["found_lang"] is None and got[9005]["segments"] == [] and got[9001]["confidence"] > 0.8


def test_truncation(spark):
    subjects = ["The night shift", "My brother", "The harbour pilot", "The choir", "Our neighbour"]
    verbs = ["sketched the frozen", "moved the old", "counted the blue", "repaired the second"]
    things = ["rope ladder", "map drawer", "seed tray", "weather chart", "lamp bracket"]
    whole = [f"{s} {v} {t}" for s in subjects for v in verbs for t in things]
    pages = [(i, i, t, "app", f"p/{i}.md", t + ". More text follows here.") for i, t in enumerate(whole)]
    cut = {1000: "The night shift sketched the froz", 1001: "My brother moved the old map dra", 1002: "The choir counted the blue weat…"}
    pages += [(i, i, t, "app", f"p/{i}.md", None) for i, t in cut.items()] + [(2000, 2000, None, None, "p/n.md", None), (2001, 2001, "", "app", None, ""), (1003, 1000, cut[1000], "app", "p/1000.md", None)]
    page = spark.createDataFrame(pages, "row_id bigint, page_id bigint, title string, origin string, path string, body string")
    renames = spark.createDataFrame([(1, "p/3.md", whole[3], whole[3], "rules"), (2, "p/4.md", whole[4][:27], "", "rules"), (3, None, None, None, None)], "rename_id bigint, path string, old_title string, new_title string, source string")
    found = truncation.detect(truncation.titles(page, renames)).cache()
    assert {(r["tbl"], r["record_id"]) for r in found.where("is_cut").collect()} == {("page_out", 1000), ("page_out", 1001), ("page_out", 1002), ("renames", 2)}
    shares = {(r["tbl"], r["source"]): r["n_cut"] for r in truncation.shares(found).collect()}
    assert shares["page_out", "app"] == 3 and shares["renames", "rules"] == 1
    assert truncation.detect(truncation.titles(page.limit(0), renames.limit(0))).count() == 0


def test_truncation_thresholds_count_false_alarms_over_all_values(spark):
    known = [("page_out", "pl", "inside", None, 6.0)] * 60 + [("page_out", "pl", "inside", None, -2.4)] + [("page_out", "pl", "whole", None, -5.0)] * 3
    undecided = [("page_out", "pl", None, None, 6.0)] * 40 + [("page_out", "pl", None, None, -2.0)] * 500 + [("page_out", "nl", None, None, -2.0)] * 50 + [("renames", "pl", None, None, -2.0)] * 50
    rows = spark.createDataFrame(known + undecided, "tbl string, lang string, body_says string, copy_says string, model double").withColumn("total", F.col("model"))
    got = {(r["tbl"], r["lang"]): r["threshold"] for r in truncation.thresholds(rows).collect()}
    assert set(got) == {("page_out", "pl"), ("page_out", "nl")} and all(-2 < t < 6 for t in got.values())


def test_catalogue_codes_of_any_length_end_a_title(spark):
    values = ["Valve handle EMZ-tzme", "Valve handle CH02-t20hc", "Valve handle UA6Q1-m1q6au", "Valve handle 6ΟS1-t1so6 m2", "Valve handle R7X–wx7r", "Valve handle COVID-19", "Valve handle half-empty", "Valve hand"]
    page = spark.createDataFrame([(i, i, v, "app", f"p/{i}.md", None) for i, v in enumerate(values)], "row_id bigint, page_id bigint, title string, origin string, path string, body string")
    renames = spark.createDataFrame([], "rename_id bigint, path string, old_title string, new_title string, source string")
    phrases = {r["record_id"]: r["phrase"] for r in truncation.titles(page, renames).collect()}
    assert [phrases[i] for i in range(len(values))] == ["Valve handle"] * 5 + ["Valve handle COVID-0", "Valve handle half-empty", "Valve hand"]


COLUMNS = {"p1_found": ["page_id", "family"], "p2_found": ["tbl", "record_id"], "p3_found": ["page_id", "field"], "p4_found": ["page_id", "field", "kind"], "p5_found": ["page_id_a", "page_id_b", "field"],
           "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id", "true_lang"]}


@pytest.mark.parametrize("name", COLUMNS)
def test_found_queries_on_test_data(spark, name):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    df = queries.queries()[name](spark, folder)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))
    assert df.select([F.count_if(F.col(c).isNull()) for c in df.columns]).first()[:] == (0,) * len(df.columns)


def test_soft_texts_keep_the_bound_of_their_source(spark):
    rows = [(i, f"The big kettle number {i} stands by the harbour wall.", "a") for i in range(20)] + [(50 + i, f"Die kleine Quelle {i} hat wenig Text.", "b") for i in range(20)]
    rows += [(100 + i, f"The big kettle by the harbour, no source {i}.", None) for i in range(8)] + [(200 + i, f"Die kleine Quelle ohne Herkunft {i}.", None) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 3.0, 10)], "source string, target_weight double, max_repeats int")
    got = mixing.mix(docs, targets)
    copies = got.copies.collect()
    assert {r["source"] for r in copies if r["doc_id"] >= 100} == {"a", "b"}
    assert max(r["copies"] for r in copies if r["source"] == "a") == 1
    report = {r["source"]: r for r in got.report.collect()}
    assert not any(r["out_of_reach"] for r in report.values()) and report["a"]["wanted_mix_tokens"] > 0
    assert all(r["shortfall_tokens"] == max(0, r["target_tokens"] - r["tokens"]) for r in report.values())


def test_differencing_pairs_by_path(spark):
    from folioflow.llm import differencing as d

    rows = [(i, "h" if i % 3 else None, f"p/{i // 10}/{i:03d}.md", f"own {i}\nfooter" if i % 7 else None) for i in range(60)] + [(99, "alone", "x/1.md", "a\nb")]
    pages = spark.createDataFrame(rows, "row_id bigint, notebook string, path string, body string").repartition(5)
    got = {r["row_id"]: r for r in d.difference(pages, "row_id", "notebook", "path", "body").collect()}
    assert len(got) == 61 and got[99]["text"] == "a\nb" and got[0]["text"] is None
    ordered = sorted((r for r in rows), key=lambda r: (r[1] or "", r[2], r[0]))
    want = {}
    for i, r in enumerate(ordered):
        def common(o):
            if o is None or (o[1] or "") != (r[1] or ""):
                return -1
            n = 0
            while n < min(len(o[2]), len(r[2])) and o[2][n] == r[2][n]:
                n += 1
            return n
        before, after = ordered[i - 1] if i else None, ordered[i + 1] if i + 1 < len(ordered) else None
        a, b = common(before), common(after)
        if max(a, b) >= 0:
            want[r[0]] = before[0] if a >= 0 and a >= b else after[0]
    assert {r["row_id"]: r["mate"] for r in d.mates(pages, "row_id", "notebook", "path").collect()} == want
    assert got[1]["text"] == "own 1" and got[1]["n_shared"] == 1
    assert d.difference(pages.limit(0), "row_id", "notebook", "path", "body").count() == 0
