"""Page hierarchy from ordered levels, and its numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



def parents(pages: DataFrame, folder: str, order: str, level: str, page_id: str, blocks: int | None = None) -> DataFrame:
    """(page_id, parent_id): the nearest earlier page of the folder with a lower level; NULL at the top.

    All rows are cut into ranges of about equal size in page order, so a folder that holds a third of all rows is many
    blocks (a block is the part of a folder in one range), whatever its order values are. For each block the
    last page of every level before it is carried in (one small row a block and level), so each
    block is scanned alone, in linear time. Ties in the order are broken by
    page_id. Rows without folder, order or level are their own tops.
    """
    from folioflow.session import cut

    rows = pages.select(F.col(folder).alias("f"), F.col(order).cast("bigint").alias("o"), F.col(level).cast("int").alias("l"), F.col(page_id).cast("bigint").alias("id"))
    # written, for a range is drawn from a sample and would not fall the same way twice
    whole = cut(rows.where("f is not null and o is not null and l is not null").repartitionByRange(*([blocks] if blocks else []), "f", "o", "id").withColumn("b", F.spark_partition_id()))
    last = whole.groupBy("f", "b", "l").agg(F.max(F.struct("o", "id")).alias("last"))
    earlier = Window.partitionBy("f", "l").orderBy("b").rangeBetween(Window.unboundedPreceding, -1)
    # per block and level, the last page before the block: levels are few, blocks are folders and ranges
    marks = whole.select("f", "b").distinct().join(last.select("f", "l").distinct(), "f").join(last, ["f", "b", "l"], "left").withColumn("before", F.max("last").over(earlier))
    carry = marks.where("before is not null").groupBy("f", "b").agg(F.collect_list(F.struct(F.col("before.o").alias("o"), F.col("before.id").alias("id"), "l")).alias("carry"))
    ready = whole.join(carry, ["f", "b"], "left")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of whole blocks, sorted; a block may reach over several batches."""
        at, stack = None, []  # the block, and (level, id) of the open pages, levels rising
        for batch in batches:
            found = []
            for f, b, lv, i, carried in zip(batch["f"], batch["b"], batch["l"], batch["id"], batch["carry"]):
                if (f, b) != at:
                    at, stack = (f, b), []
                    for c in sorted(carried if carried is not None else [], key=lambda c: (c["o"], c["id"])):
                        while stack and stack[-1][0] >= c["l"]:
                            stack.pop()
                        stack.append((c["l"], c["id"]))
                while stack and stack[-1][0] >= lv:
                    stack.pop()
                found.append(stack[-1][1] if stack else None)
                stack.append((lv, i))
            yield pd.DataFrame({"page_id": batch["id"], "parent_id": pd.array(found, dtype="Int64")})

    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("parent_id", T.LongType())])
    ordered = ready.repartition("f", "b").sortWithinPartitions("f", "b", "o", "id")
    found = ordered.select("f", "b", "l", "id", "carry").mapInPandas(scan, schema)
    loose = rows.where("f is null or o is null or l is null").select(F.col("id").alias("page_id"), F.lit(None).cast("bigint").alias("parent_id"))
    return found.unionByName(loose)


def child_numbers(children: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Children with ``n`` (1, 2, ... under their parent), ``width`` (at least 2 digits, enough for all) and ``label``."""
    by_parent = Window.partitionBy(parent)
    numbered = children.withColumn("n", F.row_number().over(by_parent.orderBy(*order))).withColumn("width", F.greatest(F.lit(2), F.length(F.count("*").over(by_parent).cast("string"))))
    return numbered.withColumn("label", F.expr("lpad(cast(n as string), width, '0')"))


def descendants(edges: DataFrame, child: str = "page_id", parent: str = "parent_id") -> DataFrame:
    """(page_id, root_id, depth): the top of each page's chain, by pointer doubling.

    Chains halve with every join. A page whose pointer leads nowhere is its own root. Depths have no gaps, so once a round
    brings no page to its top, those left stand in a cycle or lead into one: they have neither root nor depth. A page with
    several parents follows the smallest.
    """
    from folioflow.session import cut

    first = edges.where(F.col(child).isNotNull()).groupBy(F.col(child).alias("page_id")).agg(F.min(F.col(parent)).alias("up"))
    known = first.select(F.col("page_id").alias("k"))
    now = cut(first.join(known, F.col("up") == F.col("k"), "left").select(
        "page_id", F.coalesce("k", "page_id").alias("at"), F.when(F.col("k").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("k").isNull().alias("top")))
    settled, open_ = now.where("top"), now.where("not top")
    while not open_.isEmpty():
        far = settled.unionByName(open_).select(F.col("page_id").alias("p2"), F.col("at").alias("at2"), F.col("depth").alias("d2"), F.col("top").alias("t2"))
        step = cut(open_.join(far, F.col("at") == F.col("p2")).select("page_id", F.col("at2").alias("at"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("t2").alias("top")))
        done, open_ = step.where("top"), step.where("not top")
        if done.isEmpty():
            break
        settled = settled.unionByName(done)
    none = F.lit(None)
    return settled.select("page_id", F.col("at").alias("root_id"), "depth").unionByName(
        open_.select("page_id", none.cast(edges.schema[child].dataType).alias("root_id"), none.cast("bigint").alias("depth")))
