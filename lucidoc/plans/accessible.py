"""From blocks to accessible HTML and a compliance report; one plan for every source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language
from ..functions.text import cleaned_title, file_stem, run_text, strip
from ..operators import headings as hd
from ..operators import images as im
from ..operators import links as lk
from ..operators import render, report, tables
from ..sources.docx import IMAGE_SCHEME
from ..tables import scratch, stored

FLAG_COLUMNS = ["doc_id", "block_ord", "flag_ord", "code", "wcag_sc", "message", "location"]


@dataclass
class AccessibleDocuments:
    """Results of a plan, a row for each document in `html`, `report`, `report_json` and `report_html`."""

    docs: DataFrame
    headings: DataFrame
    flags: DataFrame
    fixes: DataFrame
    links: DataFrame
    items: DataFrame
    html: DataFrame
    report: DataFrame
    report_json: DataFrame
    report_html: DataFrame


def first_heading(blocks: DataFrame, top_only: bool) -> DataFrame:
    """doc_id and text of the first heading, of level 1 only where that is asked for."""
    found = blocks.filter(F.col("kind") == "heading")
    found = found.filter("level = 1") if top_only else found
    return found.groupBy("doc_id").agg(strip(F.min_by(run_text(F.col("runs")), "block_ord")).alias("heading"))


def titles(meta: DataFrame, blocks: DataFrame, layout: bool) -> DataFrame:
    """doc_id, title and flag (code or null) from metadata (doc_id, filename, meta_title), headings and file name.

    Layout files clean editor-generated titles and take headings of level 1 only.
    """
    own = strip(F.coalesce(F.col("meta_title"), F.lit("")))
    clean = cleaned_title(own) if layout else F.lit(None).cast("string")
    out = meta.join(first_heading(blocks, layout), "doc_id", "left")
    stem = file_stem(F.col("filename"))
    pick = lambda t, code: F.struct(t.alias("title"), F.lit(code).cast("string").alias("flag"))
    chosen = (
        F.when(clean.isNotNull(), pick(clean, "TITLE_CLEANED"))
        .when(own != "", pick(own, None))
        .when(F.coalesce("heading", F.lit("")) != "", pick(F.col("heading"), None))
        .otherwise(pick(stem, "TITLE_FROM_FILENAME"))
    )
    return out.select("doc_id", chosen.alias("t")).select("doc_id", "t.*")


def plain_texts(blocks: DataFrame) -> DataFrame:
    """doc_id and text: what blocks say, in order, with blanks between; blank parts are left out."""
    parts = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<runs:array<struct<text:string,bold:boolean,italic:boolean,link_text:string,link_href:string>>>>")), lambda x: run_text(x["runs"]))
    items = F.transform("items", lambda i: F.struct(i["runs"].alias("runs")))
    cells = F.transform("cells", lambda c: F.struct(c["runs"].alias("runs")))
    every = F.concat(F.array(F.coalesce(run_text(F.col("runs")), F.lit(""))), parts(items), parts(cells))
    shown = F.array_join(F.filter(every, lambda t: strip(t) != ""), " ")
    rows = blocks.select("doc_id", "block_ord", shown.alias("t")).filter("t <> ''")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_ord", "t"))), lambda x: x["t"]), " ").alias("text"))


def languages(meta: DataFrame, texts: DataFrame, detected: DataFrame) -> DataFrame:
    """doc_id, lang and flag from metadata (meta_lang), texts, and a classifier's (doc_id, code, confidence)."""
    out = meta.select("doc_id", "meta_lang").join(texts, "doc_id", "left").join(detected, "doc_id", "left")
    return out.select("doc_id", language.decision(F.col("meta_lang"), F.col("text"), F.col("code"), F.col("confidence")).alias("l"), "confidence").select("doc_id", "l.*", "confidence")


def document_flags(lang: DataFrame, title: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Document flags in order: those found earlier, then language, then title."""
    told = (
        F.when(F.col("flag") == "LANG_DETECTED", F.format_string("The language was detected as '%s' (confidence %.2f); verify it.", "lang", "confidence"))
        .when(F.col("flag") == "LANG_ASSUMED", "No language is declared or could be detected; 'en' was assumed.")
    )
    of_lang = lang.filter("flag IS NOT NULL").select("doc_id", F.lit(1_000_000).alias("flag_ord"), F.col("flag").alias("code"), F.lit("3.1.1").alias("wcag_sc"), told.alias("message"))
    named = F.when(F.col("flag") == "TITLE_CLEANED", F.concat(F.lit("The title looked editor-generated; cleaned to '"), "title", F.lit("'."))).otherwise(F.concat(F.lit("No title or heading was found; the file name '"), "title", F.lit("' is used.")))
    of_title = title.filter("flag IS NOT NULL").select("doc_id", F.lit(1_000_001).alias("flag_ord"), F.col("flag").alias("code"), F.lit("2.4.2").alias("wcag_sc"), named.alias("message"))
    out = of_lang.unionByName(of_title).withColumn("location", F.lit(None).cast("string"))
    return out if earlier is None else earlier.select(*out.columns).unionByName(out)


def markup_flags(blocks: DataFrame) -> DataFrame:
    """Flags of blocks from markup: unmapped blocks, tables, pictures without a description."""
    none = F.lit(None).cast("string")
    unmapped = blocks.filter((F.col("kind") == "paragraph") & F.col("source_tag").isin("div", "blockquote"))
    unmapped = unmapped.select("doc_id", "block_ord", F.lit(0).alias("flag_ord"), F.lit("UNMAPPED_BLOCK").alias("code"), F.lit("1.3.1").alias("wcag_sc"), F.concat(F.lit("A <"), "source_tag", F.lit("> was rendered as a paragraph; verify its structure.")).alias("message"), none.alias("location"))
    images = blocks.filter((F.col("kind") == "image") & F.col("needs_review"))
    images = images.select("doc_id", "block_ord", F.lit(0).alias("flag_ord"), F.lit("MISSING_ALT").alias("code"), F.lit("1.1.1").alias("wcag_sc"), F.lit("The image has no meaningful alternative text.").alias("message"), none.alias("location"))
    return unmapped.unionByName(images).unionByName(tables.markup_flags(blocks).select(*FLAG_COLUMNS))


def markup_blocks(blocks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Blocks of a markup source with what rendering needs; `images` is the registry (doc_id, idx, data, mime_type)."""
    idx = F.when(F.col("image.src").startswith(IMAGE_SCHEME), F.regexp_extract("image.src", r"(\d+)$", 1).cast("int"))
    out = blocks.withColumn("idx", idx)
    if images is not None:
        out = out.join(images, ["doc_id", "idx"], "left")
    else:
        out = out.withColumn("data", F.lit(None).cast("binary")).withColumn("mime_type", F.lit(None).cast("string"))
    alt = im.markup_alt(F.col("image.alt"))
    n_rows = F.coalesce(F.array_max(F.transform("cells", lambda c: c["row_no"])) + 1, F.lit(0))
    return (
        out.withColumn("data", F.coalesce("data", F.lit(b"")))
        .withColumn("alt", F.when(F.col("kind") == "image", alt["alt"]))
        .withColumn("needs_review", F.when(F.col("kind") == "image", alt["needs_review"]))
        .withColumn("decorative", F.lit(None).cast("boolean"))
        .withColumn("image_href", F.col("image.link_href"))
        .withColumn("n_rows", F.when(F.col("kind") == "table", n_rows))
    )


def table_fixes(blocks: DataFrame) -> DataFrame:
    """Tables whose first row becomes a header by default, located by their caption if they have one."""
    found = blocks.filter((F.col("kind") == "table") & ~F.col("header_row") & (F.col("n_rows") > 0))
    caption = F.col("caption") if "caption" in blocks.columns else F.lit(None).cast("string")
    location = F.when(F.coalesce(caption, F.lit("")) != "", caption).otherwise("table")
    return found.select("doc_id", (F.col("block_ord") + 1_000_000).alias("fix_ord"), F.lit("HEADER_ROW_AUTO_ADDED").alias("code"), F.lit("1.3.1").alias("wcag_sc"), F.lit("The first row was made a header row by default; verify it.").alias("message"), location.alias("location"))


def mime_flags(blocks: DataFrame) -> DataFrame:
    found = blocks.filter((F.col("kind") == "image") & im.unknown_mime(F.col("data"), F.col("mime_type")))
    return found.select("doc_id", "block_ord", F.lit(1).alias("flag_ord"), F.lit("IMAGE_UNKNOWN_MIME_TYPE").alias("code"), F.lit("1.1.1").alias("wcag_sc"), F.lit("The image's type is unknown, so it could not be shown.").alias("message"), F.lit(None).cast("string").alias("location"))


def rebuilt(docs: DataFrame, blocks: DataFrame, of_documents: DataFrame, of_blocks: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> AccessibleDocuments:
    """Repairs, HTML and report of documents (doc_id, title, lang) from their blocks and flags; `keep` may store what several of these read."""
    found = blocks.filter("kind = 'heading'").select("doc_id", F.col("block_ord").alias("ord"), "level", run_text(F.col("runs")).alias("text"))
    repaired = keep(hd.repaired_levels(hd.with_title(found, docs.select("doc_id", "title"))), "headings")
    fixes = hd.heading_fixes(repaired).unionByName(table_fixes(blocks))
    links = lk.inventory(blocks.withColumn("image", F.struct(F.col("image_href").alias("link_href"))))
    flags = keep(report.all_flags(of_documents, of_blocks.select(*FLAG_COLUMNS).unionByName(mime_flags(blocks)).unionByName(report.generic_link_flags(links).select(*FLAG_COLUMNS))), "flags")
    its = keep(report.items(flags, fixes), "items")
    levels = repaired.select("doc_id", F.col("ord").alias("block_ord"), "level_final")
    parts = render.blocks_html(blocks.join(levels, ["doc_id", "block_ord"], "left")).select("doc_id", "block_ord", "html")
    made = repaired.filter("synthetic").select("doc_id", F.col("ord").alias("block_ord"), F.concat(F.lit("<h"), F.col("level_final").cast("string"), F.lit(">"), render.escaped(F.col("text")), F.lit("</h"), F.col("level_final").cast("string"), F.lit(">")).alias("html"))
    html = render.documents_html(docs, parts.unionByName(made))
    nested = report.reports(docs, its, links)
    return AccessibleDocuments(docs, repaired, flags, fixes, links, its, html, nested, report.report_json(nested), report.report_html(nested, render.REPORT_STYLE))


def from_markup(meta: DataFrame, blocks: DataFrame, detected: DataFrame, images: DataFrame | None = None) -> AccessibleDocuments:
    """Documents of a markup source: meta (doc_id, filename, meta_title, meta_lang) and blocks.

    The blocks are stored, as titles, languages, flags, fixes, links and HTML each read them; so files are parsed once.
    """
    full = stored(markup_blocks(blocks, images), scratch(blocks.sparkSession), "blocks")
    title = titles(meta, full, layout=False)
    lang = languages(meta, plain_texts(full), detected)
    docs = title.select("doc_id", "title").join(lang.select("doc_id", "lang"), "doc_id")
    return rebuilt(docs, full, document_flags(lang, title), markup_flags(full))


def from_layout(found, detected: DataFrame) -> AccessibleDocuments:
    """Documents of a LayoutDocuments; titles, languages, headings, flags and items are stored, so that what is left to the caller is a small plan."""
    title = found.keep(titles(found.docs, found.blocks, layout=True), "titles")
    lang = found.keep(languages(found.docs, plain_texts(found.blocks), detected), "languages")
    docs = title.select("doc_id", "title").join(lang.select("doc_id", "lang"), "doc_id")
    return rebuilt(docs, found.blocks, document_flags(lang, title, found.document_flags), found.block_flags, found.keep)
