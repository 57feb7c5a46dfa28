"""Heading inference from font sizes, and repair of heading levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_points, quoted, shortened, strip

#: Fixed values of the inference.
SAMPLE_PAGES, MAX_LEVELS, MARGIN, DEFAULT_BODY = 25, 4, 1.08, 12.0
LONG_CHARS, SURE_GAP, SURE_CHARS, MIN_CONFIDENCE = 120, 0.5, 20, 0.5


def page_sample(docs: DataFrame, size: int, count: str = "page_count") -> DataFrame:
    """doc_id and page_no of an even sample: all pages up to `size`, the first alone for a size of 1 or less,
    else `size` places spread over the document and rounded half to even."""
    n = F.col(count)
    if size <= 1:
        spread = F.array(F.lit(0))
    else:
        spread = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.bround(i * ((n - 1) / F.lit(size - 1)), 0).cast("int"))
    pages = F.when(n <= size, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(F.array_distinct(spread))
    return docs.filter(n > 0).select("doc_id", F.explode(pages).alias("page_no"))


def span_order() -> list[str]:
    return ["page_no", "block_no", "line_no", "span_no"]


def size_histogram(spans: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Stripped characters by rounded size, with the first place each size is met; blank spans don't count."""
    rows = spans.withColumn("n", F.length(strip(F.col("text")))).filter("n > 0").drop("text")
    if sample is not None:  # an inner join, as Spark would push a semi join below, and shuffle texts
        rows = rows.join(sample.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"])
    return rows.groupBy("doc_id", half_points(F.col("size")).alias("size")).agg(
        F.sum("n").alias("chars"), F.min(F.struct(*span_order())).alias("first_at")
    )


def body_size(histogram: DataFrame, docs: DataFrame) -> DataFrame:
    """The size most characters have, the first met on ties; the default where there is no text."""
    # max_by on (chars, -position) needs a falling position, so the order is by the least of the rest.
    top = histogram.groupBy("doc_id").agg(F.min(F.struct((-F.col("chars")).alias("c"), "first_at", "size"))["size"].alias("body"))
    return docs.select("doc_id").join(top, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit(DEFAULT_BODY)).alias("body_size"))


def heading_tiers(histogram: DataFrame, body: DataFrame) -> DataFrame:
    """The largest sizes that stand out from the body get levels from 1 on."""
    out = histogram.join(body, "doc_id").filter(F.col("size") > F.col("body_size") * MARGIN)
    level = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    return out.select("doc_id", "size", "chars", "body_size", level.alias("level")).filter(F.col("level") <= MAX_LEVELS)


def block_size(spans: DataFrame, body: DataFrame) -> DataFrame:
    """A block's size: that of most of its characters, the first met on ties, the body's if all is blank."""
    key = ["doc_id", "page_no", "block_no"]
    rows = spans.withColumn("n", F.length(strip(F.col("text"))))
    sized = rows.filter("n > 0").groupBy(*key, half_points(F.col("size")).alias("size")).agg(
        F.sum("n").alias("chars"), F.min(F.struct("line_no", "span_no")).alias("first_at")
    )
    best = sized.groupBy(*key).agg(F.min(F.struct((-F.col("chars")).alias("c"), "first_at", "size"))["size"].alias("size"))
    # Rows of a block share its key, so both sides of this join are partitioned alike.
    return rows.select(*key).distinct().join(best, key, "left").join(body, "doc_id").select(*key, F.coalesce("size", "body_size").alias("rep_size"), "body_size")


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def confidence(rep_size: Column, body: Column, tier_chars: Column, text_length: Column) -> Column:
    """Mean of three scores: how far the size stands out, how much text has it, how short the text is."""
    gap = F.when(body > 0, clamped((rep_size / body - MARGIN) / SURE_GAP)).otherwise(1.0)
    support = clamped(F.coalesce(tier_chars, F.lit(0)) / SURE_CHARS)
    over = text_length - LONG_CHARS
    length = F.when(over <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - over / LONG_CHARS))
    return (gap + support + length) / 3


def headings(blocks: DataFrame, sizes: DataFrame, tiers: DataFrame, histogram: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_no, block_no, text) of a heading size, with level, confidence and whether it is low."""
    key = ["doc_id", "page_no", "block_no"]
    support = histogram.select("doc_id", F.col("size").alias("rep_size"), "chars")
    level = tiers.select("doc_id", F.col("size").alias("rep_size"), "level")
    out = blocks.join(sizes, key).join(level, ["doc_id", "rep_size"]).join(support, ["doc_id", "rep_size"], "left")
    score = confidence(F.col("rep_size"), F.col("body_size"), F.col("chars"), F.length("text"))
    return out.select(*key, "text", "level", "rep_size", score.alias("confidence")).withColumn("low", F.col("confidence") < MIN_CONFIDENCE)


def repaired_levels(found: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Headings (key, order, level, text) with `demoted` (later H1 to H2) and `level_final` (no level skipped), and the level before.

    The cap "at most one below the previous final level" is a fold; with i the place among the headings its closed form is
    i + min(0, least level - place so far).
    """
    doc = Window.partitionBy(key).orderBy(order)
    so_far = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h1 = F.sum((F.col("level") == 1).cast("int")).over(so_far)
    out = found.withColumn("demoted", F.when((F.col("level") == 1) & (h1 > 1), 2).otherwise(F.col("level"))).withColumn("i", F.row_number().over(doc))
    out = out.withColumn("level_final", (F.col("i") + F.least(F.lit(0), F.min(F.col("demoted") - F.col("i")).over(so_far))).cast("int"))
    return out.withColumn("level_before", F.coalesce(F.lag("level_final").over(doc), F.lit(0)))


def with_title(found: DataFrame, titles: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """The headings with the title as an H1 in front wherever a document (key, title) has no H1."""
    firsts = found.groupBy(key).agg(F.count_if(F.col("level") == 1).alias("h1"))
    missing = titles.join(firsts, key, "left").filter(F.coalesce("h1", F.lit(0)) == 0)
    made = missing.select(F.col(key), F.lit(-1).cast(found.schema[order].dataType).alias(order), F.lit(1).alias("level"), F.col("title").alias("text"), F.lit(True).alias("synthetic"))
    return found.select(key, order, F.col("level").cast("int").alias("level"), "text", F.lit(False).alias("synthetic")).unionByName(made)


def heading_fixes(repaired: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Autofix rows (key, fix_ord, code, wcag_sc, message, location): promotions, demotions, then skips, each in order."""
    where = F.concat(F.lit("heading: "), quoted(shortened(F.col("text"))))
    rows = [
        (F.col("synthetic"), 0, "TITLE_PROMOTED_TO_H1", "1.3.1", F.lit("No H1 was found; the document title was made the page's H1."), F.lit(None).cast("string")),
        (F.col("demoted") != F.col("level"), 1, "MULTIPLE_H1_DEMOTED", "1.3.1", F.concat(F.lit('The further top-level heading "'), "text", F.lit('" was demoted from H1 to H2.')), where),
        (
            F.col("level_final") != F.col("demoted"),
            2,
            "HEADING_SKIP_REPAIRED",
            "2.4.6",
            F.format_string('Heading "%s" jumped from level %d to %d; repaired to level %d.', "text", "level_before", "demoted", "level_final"),
            where,
        ),
    ]
    parts = [
        F.when(cond, F.struct(F.lit(rank).alias("rank"), F.lit(code).alias("code"), F.lit(sc).alias("wcag_sc"), message.alias("message"), location.alias("location")))
        for cond, rank, code, sc, message, location in rows
    ]
    fixes = repaired.select(key, order, F.explode(F.array_compact(F.array(*parts))).alias("f")).select(key, order, "f.*")
    number = F.row_number().over(Window.partitionBy(key).orderBy("rank", order)) - 1
    return fixes.select(key, number.alias("fix_ord"), "code", "wcag_sc", "message", "location")
