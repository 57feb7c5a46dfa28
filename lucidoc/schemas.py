"""Row schemas of the engine, and the fixed dimension of report codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
FLAG = "struct<code:string,wcag_sc:string,message:string,location:string>"
RUN = "struct<text:string,bold:boolean,italic:boolean,link_text:string,link_href:string>"

PAGES = "doc_id long, page_no int, page_count int, width double, height double"
SPANS = f"doc_id long, page_no int, block_no int, line_no int, span_no int, text string, size double, style_flags int, bbox {RECT}"
BLOCKS_RAW = f"doc_id long, page_no int, block_no int, bbox {RECT}"
LINKS_RAW = f"doc_id long, page_no int, link_no int, uri string, bbox {RECT}"
TABLES_RAW = f"doc_id long, page_no int, table_no int, bbox {RECT}, cells array<array<string>>"
IMAGES_RAW = f"doc_id long, page_no int, xref int, placement_no int, bbox {RECT}, data binary, ext string"
DOC_META = "doc_id long, filename string, source_format string, meta_title string, meta_lang string, needs_pass boolean, page_count int"
HTML_IN = "doc_id long, filename string, html string"

#: A block of a document as the HTML and DOCX sources emit it; nested parts ride along as arrays.
BLOCK = (
    "block_ord int, kind string, level int, ordered boolean, header_row boolean, "
    f"runs array<{RUN}>, "
    f"items array<struct<item_path:array<int>,depth:int,ordered:boolean,runs:array<{RUN}>>>, "
    f"cells array<struct<row_no:int,col_no:int,header:boolean,colspan:int,rowspan:int,runs:array<{RUN}>>>, "
    "image struct<src:string,alt:string,link_href:string>, source_tag string"
)

#: Report code, requirement number, severity, success criterion.
CODES = [
    ("LANG_ASSUMED", "R15", "needs-human-review", "3.1.1"),
    ("LANG_DETECTED", "R15", "needs-human-review", "3.1.1"),
    ("TITLE_FROM_FILENAME", "R12", "needs-human-review", "2.4.2"),
    ("TITLE_CLEANED", "R12", "needs-human-review", "2.4.2"),
    ("MISSING_ALT", "R1b", "needs-human-review", "1.1.1"),
    ("IMAGE_UNKNOWN_MIME_TYPE", "R1", "needs-human-review", "1.1.1"),
    ("DECORATIVE_ASSUMED", "R1b", "needs-human-review", "1.1.1"),
    ("NO_HEADER_ROW_DETECTED", "R18", "needs-human-review", "1.3.1"),
    ("COMPLEX_TABLE_STRUCTURE", "R18", "needs-human-review", "1.3.1"),
    ("TABLE_EXTRACTION_UNCERTAIN", "R18", "needs-human-review", "1.3.1"),
    ("HEADER_ROW_AUTO_ADDED", "R18", "auto-fixed", "1.3.1"),
    ("UNMAPPED_BLOCK", "R2", "needs-human-review", "1.3.1"),
    ("GENERIC_LINK_TEXT", "R13", "needs-human-review", "2.4.4"),
    ("LINK_UNASSOCIATED", "R21", "needs-human-review", "2.4.4"),
    ("HEADING_SKIP_REPAIRED", "R14", "auto-fixed", "2.4.6"),
    ("MULTIPLE_H1_DEMOTED", "R2", "auto-fixed", "1.3.1"),
    ("TITLE_PROMOTED_TO_H1", "R2", "auto-fixed", "1.3.1"),
    ("HEADINGS_INFERRED", "R19", "info", "1.3.1"),
    ("HEADING_LOW_CONFIDENCE", "R19", "needs-human-review", "2.4.6"),
    ("READING_ORDER_UNCERTAIN", "R20", "needs-human-review", "1.3.2"),
    ("OCR_APPLIED", "R22", "needs-human-review", "1.1.1"),
    ("OCR_NO_TEXT_RECOVERED", "R22", "needs-human-review", "1.1.1"),
    ("SCAN_IMAGES_EXCLUDED", "R22", "info", "1.1.1"),
]
CRITERION = {code: sc for code, _, _, sc in CODES}
SEVERITIES = ("auto-fixed", "needs-human-review", "info")


def code_dim(spark: SparkSession) -> DataFrame:
    """23 rows: code, r_number, severity."""
    return spark.createDataFrame([c[:3] for c in CODES], "code string, r_number string, severity string")
