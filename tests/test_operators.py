import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import hierarchy, merging, numbering


def stack_parents(rows):
    out, folders = {}, {}
    for f, o, lv, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        s = folders.setdefault(f, [])
        while s and s[-1][0] >= lv:
            s.pop()
        out[i] = s[-1][1] if s else None
        s.append((lv, i))
    return out


@pytest.mark.parametrize("blocks", [None, 1, 30])
def test_parents_match_a_stack_across_blocks(spark, blocks):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot", "hot", "a", "b"]), rnd.randint(1, 60), rnd.randint(1, 4), i) for i in range(200)]
    df = spark.createDataFrame(rows, "f string, o int, l int, id bigint")
    got = {r["page_id"]: r["parent_id"] for r in hierarchy.parents(df, "f", "o", "l", "id", blocks).collect()}
    assert got == stack_parents(rows)


def test_parents_of_empty_and_null_rows(spark):
    df = spark.createDataFrame([(None, 1, 1, 1), ("a", None, 1, 2), ("a", 1, None, 3)], "f string, o int, l int, id bigint")
    assert {r["page_id"]: r["parent_id"] for r in hierarchy.parents(df, "f", "o", "l", "id").collect()} == {1: None, 2: None, 3: None}
    assert hierarchy.parents(df.limit(0), "f", "o", "l", "id").count() == 0


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99), (7, 6)], "page_id bigint, parent_id bigint")
    got = {r["page_id"]: (r["root_id"], r["depth"]) for r in hierarchy.descendants(df).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 4), 6: (6, 0), 7: (6, 1)}


def test_cycles_have_no_root(spark):
    rows = [(1, None), (2, 1), (3, 2), (10, 12), (11, 10), (12, 11), (13, 10), (20, 21), (21, 20), (30, 30), (31, 30), (None, 1), (3, 2)]
    got = {r["page_id"]: (r["root_id"], r["depth"]) for r in hierarchy.descendants(spark.createDataFrame(rows, "page_id bigint, parent_id bigint")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), **{i: (None, None) for i in (10, 11, 12, 13, 20, 21, 30, 31)}}
    long = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "page_id bigint, parent_id bigint")
    assert sorted((r["depth"], r["root_id"]) for r in hierarchy.descendants(long).collect()) == [(i, 0) for i in range(300)]
    assert hierarchy.descendants(long.limit(0)).count() == 0


def test_child_numbers(spark):
    df = spark.createDataFrame([(i, 1) for i in range(101)], "page_id bigint, parent_id bigint")
    rows = hierarchy.child_numbers(df, "parent_id", ["page_id"]).orderBy("page_id").collect()
    assert rows[0]["label"] == "001" and rows[100]["label"] == "101"


def test_last_writer(spark):
    df = spark.createDataFrame([("a", 1, 4, "x"), ("a", 2, 4, "y"), ("a", 9, 1, None), ("a", 3, 1, "p"), (None, 1, 4, "n")], "k string, o int, part int, v string")
    assert {r["k"]: r["v"] for r in merging.last_writer(df, ["k"], ["o"], ["v"]).collect()} == {"a": None, None: "n"}
    got = {r["k"]: (r["t"], r["p"]) for r in merging.last_writer_by_part(df, ["k"], "part", ["o"], "v", {4: "t", 1: "p"}).collect()}
    assert got == {"a": ("y", None), None: ("n", None)}


def test_clashes_settle(spark):
    rows = [(1, "d/a.md"), (2, "d/A.md"), (3, "d/a (2).md"), (4, "d/a.md"), (5, "x"), (6, "x")]
    df = spark.createDataFrame(rows, "id int, path string")
    one = {r["id"]: r["final"] for r in merging.clash_suffix(df, "path", F.lower("path"), ["id"]).collect()}
    assert one == {1: "d/a.md", 2: "d/A (2).md", 3: "d/a (2).md", 4: "d/a (3).md", 5: "x", 6: "x (2)"}
    final = {r["id"]: r["final"] for r in merging.settle_clashes(df, "path", F.lower, ["id"]).collect()}
    assert len({v.lower() for v in final.values()}) == 6 and final[1] == "d/a.md" and final[3] == "d/a (2).md"


def test_many_clashes_settle(spark):
    rows = [(i, "d/a.png") for i in range(200)] + [(500 + i, f"d/A ({i}).PNG") for i in range(0, 60, 3)] + [(900, None)]
    df = spark.createDataFrame(rows, "id int, path string")
    final = {r["id"]: r["final"] for r in merging.settle_clashes(df, "path", F.lower, ["id"]).collect()}
    assert len(final) == 221 and final[900] is None and len({v.lower() for v in final.values() if v}) == 220
    assert final[0] == "d/a.png" and final[1] == "d/a (2).png" and final[2] == "d/a (4).png" and all(final[500 + i] == f"d/A ({i}).PNG" for i in range(0, 60, 3))


def test_shared_folder_by_parts(spark):
    df = spark.createDataFrame([(1, "X/Shelf A"), (1, "X/Shelf A 2"), (1, "X/Shelf A/Ideas"), (2, "a-b/c"), (2, "a/c"), (3, ""), (3, "a")], "i int, f string")
    assert {r["i"]: r["folder"] for r in merging.shared_folder(df, "i", "f").collect()} == {1: "X", 2: "", 3: ""}


def test_first_delivery(spark):
    from folioflow.session import first_delivery

    rows = [(1, 1, "a", 0), (2, 1, "late", 0), (3, 2, None, 0), (4, None, "n", 0), (5, None, "m", 0)]
    df = spark.createDataFrame(rows, "row_id bigint, page_id bigint, v string, extra int")
    assert sorted(map(tuple, first_delivery(df, "v").collect()), key=str) == sorted([(1, "a"), (2, None), (None, "n")], key=str)
    assert first_delivery(df.union(df), "v").count() == 3 and first_delivery(df.limit(0), "v").count() == 0


def test_shared_folder(spark):
    df = spark.createDataFrame([(1, "a/b"), (1, "a/bc"), (2, "a/b"), (3, "a"), (3, "b"), (4, None), (5, "a/b"), (5, "a/b/c")], "i int, f string")
    assert {r["i"]: r["folder"] for r in merging.shared_folder(df, "i", "f").collect()} == {1: "a", 2: "a/b", 3: "", 5: "a/b"}


def test_copies_and_levels(spark):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, None)], "id int, k string")
    assert {r["k"]: (r["id"], r["n_copies"]) for r in merging.first_of_copies(df, ["k"], ["id"], ["id"]).collect()} == {"k": (1, 2), None: (3, 1)}
    assert spark.range(1).select(merging.levels_of(F.lit("a/b/c.md")), merging.levels_of(F.lit("c.md"))).first()[:] == (["a", "a/b"], [])


def test_ordinals(spark):
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate("nnxnxxnn")], "g string, pos int, k string")
    def run(reset):
        return [r["ordinal"] for r in numbering.list_ordinals(df, ["g"], "pos", F.col("k") == "n", reset).orderBy("pos").collect()]
    assert run(True) == [1, 2, 0, 1, 0, 0, 1, 2] and run(False) == [1, 2, 0, 3, 0, 0, 4, 5]


def test_streams(spark, tmp_path):
    from folioflow.streaming import landing

    spark.sql("select 1L as event_id, timestamp_ntz'2024-01-01 10:10:00' as ts, 'a' as event_type, 1.5D as value union all select 2L, timestamp_ntz'2024-01-01 10:50:00', 'a', 2.0D").write.parquet(f"{tmp_path}/e.parquet")
    rows = landing.hourly_totals(spark, f"{tmp_path}/e.parquet").collect()
    assert [(r["event_type"], r["n"], r["total"]) for r in rows] == [("a", 2, 3.5)]
    batch = landing.watched_windows(spark.read.parquet(f"{tmp_path}/e.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert batch.count() == 2
