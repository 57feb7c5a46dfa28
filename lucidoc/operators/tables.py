"""Tables: what lies inside, whether cells add up, and their flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import overlap_ratio
from ..functions.text import without_space

INSIDE = 0.95  # fixed value: share of a block's area that makes it part of a table
PAGE = ["doc_id", "page_no"]


def partition_blocks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Text blocks (block_no, bbox) with `table_no` of the first table that holds nearly all of them, or null."""
    right = tables.select(*PAGE, "table_no", F.col("bbox").alias("table_box"))
    inside = blocks.join(right, PAGE).filter(overlap_ratio(F.col("bbox"), F.col("table_box")) >= INSIDE)
    first = inside.groupBy(*PAGE, "block_no").agg(F.min("table_no").alias("table_no"))
    return blocks.join(first, [*PAGE, "block_no"], "left")


def surplus_characters(cells: DataFrame, inside: DataFrame, key: list[str]) -> DataFrame:
    """Characters (white space apart) that cells have more of than the text inside: a multiset difference by counts.

    Both inputs have the key and `text`.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        chars = F.explode(F.split(without_space(F.coalesce(F.col("text"), F.lit(""))), ""))
        return df.select(*key, chars.alias("ch")).filter("ch <> ''").groupBy(*key, "ch").agg(F.count("*").alias(name))

    both = counted(cells, "in_cells").join(counted(inside, "in_blocks"), [*key, "ch"], "left")
    return both.withColumn("surplus", F.col("in_cells") - F.coalesce("in_blocks", F.lit(0))).filter("surplus > 0").select(*key, "ch", "surplus")


def layout_flags(tables: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Flags of layout tables (doc_id, page_no, table_no, cells): the assumed header row, ragged rows, cells that don't add up."""
    where = F.format_string("page %d", F.col("page_no") + 1)
    sizes = F.transform("cells", lambda r: F.size(r))
    ragged = F.array_max(sizes) != F.array_min(sizes)
    marked = tables.join(uncertain.select(*PAGE, "table_no").distinct().withColumn("bad", F.lit(True)), [*PAGE, "table_no"], "left")
    flag = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit("1.3.1").alias("wcag_sc"), F.lit(message).alias("message"), where.alias("location"))
    flags = F.array_compact(
        F.array(
            flag("NO_HEADER_ROW_DETECTED", "The layout marks no header row; the first row was taken as one."),
            F.when(ragged, flag("COMPLEX_TABLE_STRUCTURE", "Rows have different numbers of cells; check merged cells and headers.")),
            F.when(F.col("bad"), flag("TABLE_EXTRACTION_UNCERTAIN", "Cells hold text that isn't inside the table's borders.")),
        )
    )
    return marked.select(*PAGE, "table_no", F.posexplode(flags).alias("flag_ord", "f")).select(*PAGE, "table_no", "flag_ord", "f.*")


def markup_flags(blocks: DataFrame) -> DataFrame:
    """Flags of tables from markup (doc_id, block_ord, header_row, cells): no header row, merged cells."""
    spans = F.exists("cells", lambda c: (c["colspan"] > 1) | (c["rowspan"] > 1))
    flag = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit("1.3.1").alias("wcag_sc"), F.lit(message).alias("message"), F.lit(None).cast("string").alias("location"))
    flags = F.array_compact(
        F.array(
            F.when(~F.col("header_row"), flag("NO_HEADER_ROW_DETECTED", "The source marks no header row; the first row will be one by default.")),
            F.when(spans, flag("COMPLEX_TABLE_STRUCTURE", "The table has merged cells; headers need a manual check.")),
        )
    )
    return blocks.filter("kind = 'table'").select("doc_id", "block_ord", F.posexplode(flags).alias("flag_ord", "f")).select("doc_id", "block_ord", "flag_ord", "f.*")
