"""Images: placements, repetition, alternative text and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ALT_PLACEHOLDER, is_filename_like, mime_of

TINY, MIN_PAGES, MOST_PAGES = 24, 4, 0.5  # fixed values


def placed(images: DataFrame) -> DataFrame:
    """The first placement of each image of a page; those without a rectangle (soft masks) aren't placed."""
    key = ["doc_id", "page_no", "xref"]
    order = F.row_number().over(Window.partitionBy(*key).orderBy("placement_no"))
    return images.filter(F.col("bbox").isNotNull()).withColumn("k", order).filter("k = 1").drop("k")


def page_counts(images: DataFrame) -> DataFrame:
    """On how many pages each image is, placed or not."""
    return images.groupBy("doc_id", "xref").agg(F.count_distinct("page_no").alias("pages_with"))


def extracted(images: DataFrame) -> DataFrame:
    """Bytes and MIME type once for each image; what can't be extracted is empty and has no type."""
    first = images.groupBy("doc_id", "xref").agg(F.min_by(F.struct("data", "ext"), F.struct("page_no", "placement_no")).alias("x"))
    mime = F.when(F.col("x.data").isNotNull(), mime_of(F.col("x.ext")))
    return first.select("doc_id", "xref", F.coalesce("x.data", F.lit(b"")).alias("data"), mime.alias("mime_type"))


def judged(images: DataFrame, counts: DataFrame, docs: DataFrame) -> DataFrame:
    """Placed images with `decorative` (true, or null for unknown), `needs_review`, `reason` and `flag`: tiny ones and those on most pages are taken as decoration."""
    out = images.join(docs.select("doc_id", "page_count"), "doc_id").join(counts, ["doc_id", "xref"], "left")
    tiny = (F.col("bbox.x1") - F.col("bbox.x0") < TINY) | (F.col("bbox.y1") - F.col("bbox.y0") < TINY)
    often = (F.col("page_count") >= MIN_PAGES) & (F.coalesce("pages_with", F.lit(0)) / F.col("page_count") > MOST_PAGES)
    reason = F.when(tiny, "tiny").when(often, "repeated")
    return (
        out.withColumn("reason", reason)
        .withColumn("decorative", F.when(reason.isNotNull(), True))
        .withColumn("needs_review", F.lit(True))
        .withColumn("flag", F.when(reason.isNotNull(), "DECORATIVE_ASSUMED").otherwise("MISSING_ALT"))
    )


def markup_alt(alt: Column) -> Column:
    """(alt, needs_review, flag) of an image from markup: an empty or filename-like text is none."""
    bad = (F.coalesce(alt, F.lit("")) == "") | is_filename_like(alt)
    return F.struct(F.when(alt != "", alt).alias("alt"), bad.alias("needs_review"), F.when(bad, "MISSING_ALT").alias("flag"))


def rendered_alt(alt: Column, decorative: Column, needs_review: Column) -> Column:
    return F.when(F.coalesce(decorative, F.lit(False)), "").when(needs_review, ALT_PLACEHOLDER).otherwise(F.coalesce(alt, F.lit("")))


def source(data: Column, mime: Column) -> Column:
    """A data URI, or nothing without bytes or type."""
    known = (F.octet_length(data) > 0) & (F.coalesce(mime, F.lit("")) != "")
    # base64() breaks lines at 76 characters.
    return F.when(known, F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))).otherwise("")


def unknown_mime(data: Column, mime: Column) -> Column:
    return (F.octet_length(data) > 0) & (F.coalesce(mime, F.lit("")) == "")
