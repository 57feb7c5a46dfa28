"""Layout tables of page-based files, and adapters for tools that may be absent."""

from __future__ import annotations

import importlib.util
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

TABLES = {
    "pages": schemas.PAGES,
    "spans": schemas.SPANS,
    "blocks_raw": schemas.BLOCKS_RAW,
    "links_raw": schemas.LINKS_RAW,
    "tables_raw": schemas.TABLES_RAW,
    "images_raw": schemas.IMAGES_RAW,
    "doc_meta": schemas.DOC_META,
}


def read_layout(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The layout tables of a folder, by name, with their fixed schemas."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in TABLES.items()}


def accepted(doc_meta: DataFrame) -> DataFrame:
    """doc_meta with status and error: files that need a password or have no pages are rejected."""
    error = F.when(F.coalesce("needs_pass", F.lit(False)), F.concat(F.lit("Cannot open '"), "filename", F.lit("': it is password-protected."))).when(
        F.coalesce("page_count", F.lit(0)) == 0, F.concat(F.lit("'"), "filename", F.lit("' has no pages."))
    )
    return doc_meta.withColumn("error", error).withColumn("status", F.when(error.isNotNull(), "rejected").otherwise("ok"))


def ocr_available() -> bool:
    """Whether text recognition can run: both programs and the package."""
    return bool(shutil.which("tesseract") and shutil.which("gs") and importlib.util.find_spec("ocrmypdf"))


def pdf_renderer_available() -> bool:
    return importlib.util.find_spec("weasyprint") is not None


def ocr_gate(doc_meta: DataFrame, scanned: DataFrame, available: bool) -> DataFrame:
    """Documents with a scanned page are rejected where recognition can't run, else marked for it."""
    needs = scanned.select("doc_id").distinct().withColumn("needs_ocr", F.lit(True))
    out = doc_meta.join(needs, "doc_id", "left").withColumn("needs_ocr", F.coalesce("needs_ocr", F.lit(False)))
    if available:
        return out
    refused = F.col("needs_ocr") & (F.col("status") == "ok")
    message = F.concat(F.lit("Cannot process '"), "filename", F.lit("': it looks scanned, and the text recognition tools aren't installed."))
    return out.withColumn("error", F.when(refused, message).otherwise(F.col("error"))).withColumn("status", F.when(refused, "rejected").otherwise(F.col("status")))


def recognised(doc_meta: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages that count as scanned after recognition: those found before, or all pages where the page count changed.

    `before` is the scanned set (doc_id, page_no), `after` (doc_id, page_count) of the rewritten files.
    """
    changed = doc_meta.select("doc_id", F.col("page_count").alias("n")).join(after, "doc_id").filter(F.col("n") != F.col("page_count"))
    every = changed.filter(F.col("page_count") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page_no"))
    return before.join(changed, "doc_id", "left_anti").select("doc_id", "page_no").unionByName(every)
