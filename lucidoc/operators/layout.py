"""Page layout: scans, reading order, lists and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area
from ..functions.text import is_list_item, is_numbered, strip
from .headings import page_sample

#: Fixed values of the page heuristics.
SCAN_ALL_PAGES, SCAN_SAMPLE, SCAN_CHARS, BIG_IMAGE, FEW_CHARS = 50, 10, 25, 0.5, 10
GUTTER, MIN_SHARE, MIN_COVERAGE = 0.04, 0.3, 0.6
PAGE = ["doc_id", "page_no"]


def looks_scanned(pages: DataFrame, spans: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with hardly any text and an image over half of them; any placement counts."""
    chars = spans.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*[c for c in ("block_no", "line_no", "span_no") if c in spans.columns], "text"))).alias("t"))
    chars = chars.select(*PAGE, F.length(strip(F.array_join(F.transform("t", lambda x: x["text"]), ""))).alias("chars"))
    big = images.filter(F.col("bbox").isNotNull()).join(pages, PAGE)
    big = big.filter((F.col("width") * F.col("height") > 0) & (area(F.col("bbox")) >= BIG_IMAGE * F.col("width") * F.col("height")))
    out = pages.join(chars, PAGE, "left").filter(F.coalesce("chars", F.lit(0)) < SCAN_CHARS)
    return out.join(big, PAGE, "left_semi").select(*PAGE, "page_count")


def scanned_pages(pages: DataFrame, spans: DataFrame, images: DataFrame) -> DataFrame:
    """Scan-like pages, of a long document those in the sample only."""
    docs = pages.select("doc_id", "page_count").distinct()
    sample = page_sample(docs.filter(F.col("page_count") > SCAN_ALL_PAGES), SCAN_SAMPLE)
    found = looks_scanned(pages, spans, images)
    short = found.filter(F.col("page_count") <= SCAN_ALL_PAGES)
    return short.unionByName(found.filter(F.col("page_count") > SCAN_ALL_PAGES).join(sample, PAGE, "left_semi")).select(*PAGE)


def low_yield(page_chars: DataFrame, scanned: DataFrame) -> DataFrame:
    """Scanned pages whose recovered text (page_chars: doc_id, page_no, chars) is next to nothing."""
    return scanned.join(page_chars, PAGE, "left").filter(F.coalesce("chars", F.lit(0)) < FEW_CHARS).select(*PAGE, F.coalesce("chars", F.lit(0)).alias("chars"))


def without_scan_rasters(images: DataFrame, pages: DataFrame, scanned: DataFrame) -> DataFrame:
    """Images with `excluded`: those over half of a scanned page are the scan itself."""
    marked = images.join(pages.select(*PAGE, "width", "height"), PAGE).join(scanned.withColumn("scanned", F.lit(True)), PAGE, "left")
    size = F.col("width") * F.col("height")
    out = F.coalesce(F.col("scanned"), F.lit(False)) & (size > 0) & (area(F.col("bbox")) >= BIG_IMAGE * size)
    return marked.withColumn("excluded", F.coalesce(out, F.lit(False))).drop("width", "height", "scanned")


def x_clusters(items: DataFrame) -> DataFrame:
    """Items (doc_id, page_no, item_no, width, bbox) with `cluster`: left edges further apart than the gutter begin a new one."""
    by_x = Window.partitionBy(*PAGE).orderBy("bbox.x0", "item_no")
    gap = F.col("bbox.x0") - F.lag("bbox.x0").over(by_x)
    new = F.when(gap > F.col("width") * GUTTER, 1).otherwise(0)
    return items.withColumn("new", new).withColumn("cluster", F.sum("new").over(by_x.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def column_test(clustered: DataFrame) -> DataFrame:
    """By page: clusters, items, and whether two clusters are genuine columns (each with its share of items and of height)."""
    sides = clustered.groupBy(*PAGE, "cluster").agg(F.count("*").alias("n"), F.min("bbox.y0").alias("top"), F.max("bbox.y1").alias("bottom"))
    page = sides.groupBy(*PAGE).agg(
        F.count("*").cast("int").alias("clusters"),
        F.sum("n").alias("items"),
        F.min("n").alias("least"),
        F.min("top").alias("page_top"),
        F.max("bottom").alias("page_bottom"),
        F.collect_list(F.struct("n", "top", "bottom")).alias("sides"),
    )
    height = F.col("page_bottom") - F.col("page_top")
    good = F.forall("sides", lambda s: (s["n"] / F.col("items") >= MIN_SHARE) & ((s["bottom"] - s["top"]) / height >= MIN_COVERAGE))
    split = (F.col("items") >= 4) & (F.col("clusters") == 2) & (F.col("least") >= 2)
    return page.select(
        *PAGE, "clusters", "items", split.alias("split"), F.when(split & (height > 0), good).otherwise(False).alias("columns")
    ).withColumn("uncertain", (F.col("items") >= 4) & ((F.col("clusters") >= 3) | (F.col("split") & ~F.col("columns"))))


def reading_order(items: DataFrame) -> DataFrame:
    """The items with `place` in their page: by columns where there are two, else from top to bottom."""
    clustered = x_clusters(items)
    tested = clustered.join(column_test(clustered).select(*PAGE, "columns", "uncertain"), PAGE)
    side = F.when(F.col("columns"), F.col("cluster")).otherwise(0)
    across = F.when(F.col("columns"), F.lit(0.0)).otherwise(F.col("bbox.x0"))
    order = Window.partitionBy(*PAGE).orderBy(side, F.col("bbox.y0"), across, F.col("item_no"))
    return tested.withColumn("place", F.row_number().over(order) - 1)


def line_groups(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page_no, block_no, line_no, text) of blocks with a list line, with `item` (0: before the first) and `ordered`.

    A line with a prefix begins an item and others continue it; whether the list is ordered is up to the block's first line.
    """
    block = Window.partitionBy(*PAGE, "block_no")
    by_line = block.orderBy("line_no")
    marked = lines.withColumn("starts", is_list_item(F.col("text")))
    marked = marked.withColumn("any", F.max("starts").over(block)).withColumn("item", F.sum(F.col("starts").cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("ordered", F.first(is_numbered(F.col("text"))).over(by_line.rowsBetween(Window.unboundedPreceding, 0))).filter("any").drop("any")


def merged_lists(items: DataFrame) -> DataFrame:
    """Blocks of a page (doc_id, page_no, place, kind, ordered, text) with `island`, `merged_kind` and `merged_ordered`.

    Neighbouring lists become one, ordered as the first; two or more neighbouring paragraphs that look like items
    become a list; a single one stays a paragraph.
    """
    kind = F.when(F.col("kind") == "list", "L").when((F.col("kind") == "paragraph") & is_list_item(F.col("text")), "P").otherwise("O")
    page = Window.partitionBy(*PAGE).orderBy("place")
    out = items.withColumn("class", kind).withColumn("was", F.lag("class").over(page))
    new = F.when((F.col("class") == "O") | F.col("was").isNull() | (F.col("class") != F.col("was")), 1).otherwise(0)
    out = out.withColumn("island", F.sum(new).over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    island = Window.partitionBy(*PAGE, "island")
    n = F.count("*").over(island)
    makes_list = (F.col("class") == "L") | ((F.col("class") == "P") & (n > 1))
    first = F.first(F.when(F.col("class") == "L", F.col("ordered")).otherwise(is_numbered(F.col("text")))).over(island.orderBy("place"))
    return out.withColumn("merged_kind", F.when(makes_list, "list").otherwise(F.col("kind"))).withColumn("merged_ordered", F.when(makes_list, first)).drop("was", "class")


def hyphen_joins(last: Column, first: Column) -> Column:
    """Whether a line's last text goes on in the next line's first: a letter and a hyphen, then a small letter."""
    return last.rlike(r"\p{L}-\z") & first.rlike(r"^\p{Ll}")


def merged_lines(lines: DataFrame, key: list[str]) -> DataFrame:
    """Text of each group of lines (key, line_no, text, and whether first and last runs are linked): joined at hyphens, else by a blank.

    A line whose text is one run goes on into later lines, which the boundary test sees as its own end, so testing neighbours is enough.
    """
    group = Window.partitionBy(*key).orderBy("line_no")
    joins = hyphen_joins(F.lag("text").over(group), F.col("text")) & ~F.coalesce(F.lag("linked").over(group), F.lit(False)) & ~F.col("linked")
    follows = F.coalesce(F.lead(F.lit(True)).over(group), F.lit(False))
    goes_on = F.coalesce(F.lead("joined").over(group), F.lit(False))
    out = lines.withColumn("joined", F.coalesce(joins, F.lit(False)))
    body = F.when(goes_on, F.expr("substring(text, 1, length(text) - 1)")).when(follows, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    out = out.withColumn("part", body)
    return out.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "").alias("text"), F.sum(F.col("joined").cast("int")).alias("joins"))
