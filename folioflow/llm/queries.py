"""The queries of problems 1 to 8 over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import differencing, encoding, langid, leakage, lookalike, markup, mixing, pii, truncation
from folioflow.session import spread, table


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, field, value) of titles and bodies; deliveries stay apart, they cost less than a shuffle of all bodies."""
    pages = table(spark, sf_dir, "page_out").select("page_id", "title", "body")
    return spread(pages).select("page_id", F.explode(F.array(
        F.struct(F.lit("title").alias("field"), F.col("title").alias("value")),
        F.struct(F.lit("body").alias("field"), F.col("body").alias("value")),
    )).alias("f")).select("page_id", "f.field", "f.value")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "page_out").select("page_id", "body").where("length(body) > 0"))
    parsed = markup.clean_markup(pages).select("page_id", F.explode("body_families").alias("family"))
    return parsed.distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "page_out").select("row_id", "body"))
    return markup.clean_markup(pages).select("row_id", F.col("body_clean").alias("text"), F.col("body_families").alias("families"), F.size("body_blocks").alias("n_blocks"))


def p1_differenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without the lines that the page nearest by path in its notebook shares (the method named; see README)."""
    return differencing.difference(table(spark, sf_dir, "page_out"), "row_id", "notebook", "path", "body")


def _truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.detect(truncation.titles(table(spark, sf_dir, "page_out"), table(spark, sf_dir, "renames")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncation(spark, sf_dir).where("is_cut").select("tbl", "record_id")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.shares(_truncation(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir).where(encoding.suspicious("value"))
    return encoding.repair_encoding(rows, "value").where("value_repair.garbled").select("page_id", "field").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir).where(encoding.suspicious("value"))
    fixed = encoding.repair_encoding(rows, "value").where("value_repair.garbled")
    return fixed.select("page_id", "field", F.col("value_repair.text").alias("text"), F.col("value_repair.restored").alias("restored")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir).where("length(value) > 0")
    return pii.redact_columns(rows, "value").select("page_id", "field", F.explode("value_kinds").alias("kind")).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "page_out").select("row_id", "title", "body"))
    return pii.redact_columns(pages, "title", "body").select("row_id", "title_redacted", "body_redacted")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_out")
    pairs = [
        lookalike.same_look(pages, "page_id", c).select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"), F.lit(c).alias("field"))
        for c in ("title", "body")
    ]
    return pairs[0].unionByName(pairs[1])


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_out")
    parts = [
        lookalike.look_classes(pages, "row_id", c).select(F.col("id").alias("row_id"), F.lit(c).alias("field"), "class_id", "n_looks")
        for c in ("title", "body")
    ]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("most_words"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report.where("out_of_reach").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).copies


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(spread(documents), langid.train(documents))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _languages(spark, sf_dir)
    held = F.array_distinct(F.transform(F.filter("segments", lambda s: s["sentences"] > 0), lambda s: s["lang"]))
    docs = docs.select("doc_id", "label_is", held.alias("held"))
    cases = docs.where("size(held) > 0 and (label_is in ('missing', 'wrong') or size(held) > 1)")
    return cases.select("doc_id", F.explode("held").alias("true_lang")).distinct()


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _languages(spark, sf_dir)
    return docs.select("doc_id", "found_lang", "confidence", "label_is", F.explode_outer("segments").alias("s")).select(
        "doc_id", "found_lang", "confidence", "label_is", F.col("s.lang").alias("lang"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.confidence").alias("segment_confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_clean, p1_differenced, p2_found, p2_shares, p3_found, p3_restored, p4_found, p4_redacted, p5_found, p5_classes,
        p6_found, p6_items, p7_found, p7_shares, p7_copies, p8_found, p8_segments)}


def oracle_sql() -> dict[str, str]:
    """None of the eight can be said in SQL: tests hold them against brute force, round trips and planted cases."""
    return {}
