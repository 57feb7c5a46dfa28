"""Named queries: each operator over the driver's tables.

The tables hold no page layout, so text lines get one by an integer formula: a page has 20 lines 30 points
apart, odd lines of each third document stand in a second column, the first line of a document and short
ones are larger. Links, tables and images follow from the same lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, language, text as tx
from ..operators import headings as hd
from ..operators import images as im
from ..operators import layout as ly
from ..operators import links as lk
from ..operators import render, report, tables as tb
from ..schemas import code_dim
from ..sinks import downloads
from ..sources.docx import docx_documents
from ..sources.docx_writer import with_docx
from ..sources.html import html_blocks, html_links, html_meta
from ..sources.layout import accepted, ocr_gate, recognised
from ..streaming import jobs
from ..tables import scratch, stored, stored_within
from . import language_id, layout_documents, accessible

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PAGE = ["doc_id", "page_no"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text and the layout of every line of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    row = F.col("line_no") % 20
    size = F.when(F.col("line_no") == 0, 24).when(F.length("text") <= 40, 16).otherwise(11)
    x0 = F.when((F.col("doc_id") % 3 == 0) & (F.col("line_no") % 2 == 1), 320).otherwise(72)
    y0 = 72 + 30 * row
    out = docs.withColumn("page_no", F.floor(F.col("line_no") / 20).cast("int")).withColumn("size", size.cast("double"))
    return out.withColumn("bbox", rect(x0, y0, x0 + 5 * F.length("text"), y0 + size))


def layout(spark: SparkSession, sf_dir: str, keep: bool = False) -> dict[str, DataFrame]:
    """The layout tables that the formula gives; with `keep` what many come from is stored first: lines without their texts, tables, documents."""
    all_lines = lines(spark, sf_dir)
    folder = scratch(spark) if keep else ""
    kept = lambda df, name: stored_within(df, folder, name) if keep else df
    places = kept(all_lines.drop("text"), "places")
    spans = all_lines.select(*PAGE, F.col("line_no").alias("block_no"), F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), "text", "size", F.lit(0).alias("style_flags"), "bbox")
    pages = kept(places.groupBy("doc_id").agg((F.max("page_no") + 1).alias("page_count")), "documents")
    each = pages.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page_no"), "page_count")
    each = each.withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))
    linked = places.filter(F.col("line_no") % 7 == 3).select(*PAGE, F.col("line_no").alias("link_no"), F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit("/"), F.col("line_no").cast("string")).alias("uri"), "bbox")
    orphans = each.filter("page_no % 3 = 0").select(*PAGE, F.lit(1_000_000).alias("link_no"), F.lit("orphan").alias("uri"), rect(F.lit(590), F.lit(780), F.lit(600), F.lit(790)).alias("bbox"))
    grid = all_lines.filter("page_no % 2 = 1 AND line_no % 20 BETWEEN 4 AND 7").groupBy(*PAGE).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.slice(F.split("text", " "), 1, 3).alias("row")))), lambda x: x["row"]).alias("cells"))
    tables = grid.select(*PAGE, F.lit(0).alias("table_no"), rect(F.lit(60), F.lit(190), F.lit(400), F.lit(275)).alias("bbox"), "cells")
    tables = kept(tables, "tables")
    nothing = F.lit(None)
    sides = F.array(
        F.struct(F.lit(1).alias("xref"), F.lit(200).alias("side")),
        F.struct(F.lit(2).alias("xref"), F.lit(10).alias("side")),
        F.struct(F.lit(3).alias("xref"), F.lit(700).alias("side")),
        F.struct(F.lit(4).alias("xref"), F.lit(0).alias("side")),
    )
    on = F.filter(sides, lambda s: (s["xref"] == 1) | ((s["xref"] == 2) & (F.col("page_no") % 3 == 0)) | ((s["xref"] == 3) & (F.col("page_no") % 5 == 0)) | (s["xref"] == 4))
    images = each.select(*PAGE, F.explode(on).alias("s")).select(
        *PAGE, F.col("s.xref").alias("xref"), F.lit(0).alias("placement_no"), F.when(F.col("s.side") > 0, rect(F.lit(10), F.lit(10), 10 + F.col("s.side"), 10 + F.col("s.side"))).alias("bbox"),
        F.concat(F.lit("i"), F.col("s.xref").cast("string")).cast("binary").alias("data"), F.when(F.col("s.xref") == 1, "png").when(F.col("s.xref") == 2, "jpg").otherwise("svg").alias("ext"),
    )
    meta = pages.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit("pdf").alias("source_format"), nothing.cast("string").alias("meta_title"), nothing.cast("string").alias("meta_lang"), F.lit(False).alias("needs_pass"), "page_count")
    return {"pages": each, "spans": spans, "blocks_raw": places.select(*PAGE, F.col("line_no").alias("block_no"), "bbox"), "links_raw": linked.unionByName(orphans), "tables_raw": tables, "images_raw": images, "doc_meta": meta}


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def flat_box(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "bbox"], *[F.col(f"bbox.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")])


# Web pages -----------------------------------------------------------------


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("filename"), "html")


def web_rebuilt(spark: SparkSession, sf_dir: str) -> accessible.AccessibleDocuments:
    pages = web(spark, sf_dir)
    meta = html_meta(pages).join(pages.select("doc_id", "filename"), "doc_id")
    detected = inline(spark, [], "doc_id long, code string, confidence double")
    return accessible.from_markup(meta, html_blocks(pages), detected)


@query
def severity_by_page(spark, sf_dir):
    return report.totals(web_rebuilt(spark, sf_dir).items, web(spark, sf_dir))


@query
def report_totals(spark, sf_dir):
    return web_rebuilt(spark, sf_dir).items.groupBy("severity", "code", "r_number").agg(F.count("*").alias("items"))


@query
def page_blocks(spark, sf_dir):
    return html_blocks(web(spark, sf_dir)).groupBy("doc_id").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("source_tag") == "div").alias("unmapped"))


@query
def page_html(spark, sf_dir):
    return web_rebuilt(spark, sf_dir).html


@query
def report_json(spark, sf_dir):
    return web_rebuilt(spark, sf_dir).report_json


@query
def report_html(spark, sf_dir):
    return web_rebuilt(spark, sf_dir).report_html


#: Pages with links in every way of writing one.
LINK_PAGE = """<body><a class=x href='a?x=1&amp;y=2'>one</a> <a href="b"><b>two</b> and <i>more</i></a> <a href=c>three &eacute;</a><a href="">four</a><a name="n">none</a><script>"<a href='s'>s</a>"</script><p><A HREF = "d"><img src=i></a></body>"""


@query
def page_links(spark, sf_dir):
    pages = web(spark, sf_dir).select("doc_id", "html").unionByName(inline(spark, [(-1, LINK_PAGE), (-2, None), (-3, "")], "doc_id long, html string"))
    return html_links(pages)


@query
def generic_links(spark, sf_dir):
    more = inline(spark, [(-1, i, t, "h") for i, t in enumerate(("Click here", " more ", "https://a.b/c", "WWW.x.y", "see the plan", "www.", "", " here"))], "doc_id long, link_ord int, text string, href string")
    links = html_links(web(spark, sf_dir)).unionByName(more).withColumn("owner", F.lit("block"))
    return report.link_flags(links).select("doc_id", "link_ord", "text", "reason", "flagged")


@query
def page_language(spark, sf_dir):
    return html_meta(web(spark, sf_dir)).select("doc_id", language.declared(F.col("meta_lang")).alias("lang"))


@query
def page_title(spark, sf_dir):
    return html_meta(web(spark, sf_dir)).select("doc_id", "meta_title")


# Expressions ---------------------------------------------------------------


@query
def title_cleanup(spark, sf_dir):
    rows = ["Microsoft Word - Plan.docx", "microsoft word - a b.DOC", "Microsoft Word - x.rtf", "Microsoft Word - y", "Plan", "  Microsoft Word - z.doc  ", "Microsoft Word - .docx"]
    base = inline(spark, [(t,) for t in rows], "title string").unionByName(load(spark, sf_dir, "benchmark").select(F.concat(F.lit("Microsoft Word - "), "text", F.lit(".docx")).alias("title")))
    return base.select("title", tx.cleaned_title(F.col("title")).alias("cleaned"))


@query
def title_fallback(spark, sf_dir):
    found = lines(spark, sf_dir).filter("line_no < 3 AND doc_id % 2 = 0").select("doc_id", F.col("line_no").alias("block_ord"), F.lit("heading").alias("kind"), F.col("line_no").alias("level"), F.array(F.struct("text")).alias("runs"))
    meta = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("dir/file "), F.col("doc_id").cast("string"), F.lit(".v1.pdf")).alias("filename"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Microsoft Word - "), "source", F.lit(".docx"))).alias("meta_title"))
    return accessible.titles(meta, found, layout=True).select("doc_id", "title", "flag")


@query
def alt_filename(spark, sf_dir):
    rows = ["Picture1.jpg", "IMG_001.png", "image 3.jpeg", "DSC1234", "pic-7", "A chart of sales", "", "  ", "figure.png", "photo", "img12", "graphic__2.gif", "img.png.", None]
    base = inline(spark, [(t,) for t in rows], "alt string")
    a = im.markup_alt(F.col("alt"))
    return base.select("alt", tx.is_filename_like(F.col("alt")).alias("filename_like"), a["alt"].alias("alt_kept"), a["needs_review"].alias("needs_review"), a["flag"].alias("flag"))


@query
def list_lines(spark, sf_dir):
    more = inline(spark, [(-1, i, t) for i, t in enumerate(("• a", "– b", "1. c", "12) d", "1234. e", "a) f", "ab) g", "-h", "•", "  * i", "3.j"))], "doc_id long, line_no int, text string")
    rows = lines(spark, sf_dir).select("doc_id", "line_no", "text").unionByName(more)
    t = F.col("text")
    return rows.select("doc_id", "line_no", tx.is_bullet(t).alias("bullet"), tx.is_numbered(t).alias("numbered"), tx.is_list_item(t).alias("item"))


@query
def list_strip(spark, sf_dir):
    more = inline(spark, [(-1, i, t) for i, t in enumerate(("• a", "– b", "1. c", "12) d", " • e", "• 1. f", "1. • g", "plain"))], "doc_id long, line_no int, text string")
    rows = lines(spark, sf_dir).select("doc_id", "line_no", "text").unionByName(more)
    return rows.select("doc_id", "line_no", tx.strip_list_prefix(F.col("text")).alias("stripped"))


@query
def sanitize_filename(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", tx.sanitised_stem(F.concat(F.lit("a/"), F.replace("url", F.lit("/"), F.lit("|")), F.lit(".docx"))).alias("stem"))


@query
def valid_uuid(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.concat(F.lpad(F.hex("event_id"), 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(F.hex("user_id"), 11 + 1, "0"), F.when(F.col("event_id") % 3 == 0, "x").otherwise("")).alias("job_id"))
    return rows.select("event_id", tx.is_uuid(F.col("job_id")).alias("valid"))


@query
def html_escape(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(tx.escaped(F.col("html")).cast("binary")).alias("escaped_md5"))


@query
def python_quote(spark, sf_dir):
    rows = inline(spark, [(-1, "it's"), (-2, 'say "x"'), (-3, "it's \"x\""), (-4, "a\nb\\c")], "doc_id long, text string")
    both = load(spark, sf_dir, "documents").select("doc_id", "text").unionByName(rows)
    return both.select("doc_id", tx.quoted(tx.shortened(F.col("text"))).alias("quoted"))


@query
def artifact_lookup(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    names = F.element_at(F.array(*map(F.lit, ("pdf", "html", "report.json", "meta.json"))), (F.col("event_id") % 4 + 1).cast("int"))
    done = events.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "error", "error").otherwise("done").alias("state"), F.concat(F.lit("my file#"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("original_filename"))
    return downloads(done, events.select(F.col("event_id").alias("job_id"), names.alias("artifact")))


# Heading levels: turns of conversations stand in for headings ----------------


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), (1 + F.length("text") % 6).cast("int").alias("level"), "text")


def sequence_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence(spark, sf_dir).groupBy("doc_id").agg(F.concat(F.lit("conversation "), F.first("doc_id").cast("string")).alias("title"))


@query
def h1_demotion(spark, sf_dir):
    return hd.repaired_levels(sequence(spark, sf_dir)).select("doc_id", "ord", "level", "demoted")


@query
def title_promotion(spark, sf_dir):
    return hd.with_title(sequence(spark, sf_dir), sequence_titles(spark, sf_dir)).filter("synthetic").select("doc_id", "ord", "level", "text")


@query
def heading_skip_repair(spark, sf_dir):
    return hd.repaired_levels(sequence(spark, sf_dir)).select("doc_id", "ord", "demoted", "level_before", "level_final")


@query
def heading_repair_full(spark, sf_dir):
    full = hd.repaired_levels(hd.with_title(sequence(spark, sf_dir), sequence_titles(spark, sf_dir)))
    return hd.heading_fixes(full).select("doc_id", "fix_ord", "code", "wcag_sc", "location")


def flag_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Made-up flags: one for each turn, of the document for turn 0, with codes of the dimension and one beyond it."""
    codes = [r[0] for r in sorted(code_dim(spark).collect())] + ["SOMETHING_NEW"]
    table = F.array(*map(F.lit, codes))
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("flag_ord"), F.element_at(table, (F.length("text") % len(codes) + 1).cast("int")).alias("code"), F.lit("1.1.1").alias("wcag_sc"), F.col("role").alias("message"), F.lit(None).cast("string").alias("location"))
    return rows.filter("flag_ord = 0"), rows.filter("flag_ord > 0").withColumn("block_ord", F.col("flag_ord") % 3)


@query
def flags_union(spark, sf_dir):
    return report.all_flags(*flag_rows(spark, sf_dir)).select("doc_id", "scope", "code", F.col("flag_no").cast("long").alias("flag_no"))


@query
def report_items_ordered(spark, sf_dir):
    flags = report.all_flags(*flag_rows(spark, sf_dir))
    full = hd.repaired_levels(hd.with_title(sequence(spark, sf_dir), sequence_titles(spark, sf_dir)))
    return report.items(flags, hd.heading_fixes(full)).select("doc_id", F.col("item_ord").cast("long").alias("item_ord"), "r_number", "severity", "code")


# Layout --------------------------------------------------------------------


@query
def page_sample(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 300).cast("int").alias("page_count"))
    return hd.page_sample(docs, hd.SAMPLE_PAGES)


def sampled_histogram(t: dict[str, DataFrame]) -> DataFrame:
    return hd.size_histogram(t["spans"], hd.page_sample(t["doc_meta"], hd.SAMPLE_PAGES))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, as bodies, tiers, blocks and headings all read it."""
    return stored(sampled_histogram(layout(spark, sf_dir)), scratch(spark), "histogram")


@query
def size_histogram(spark, sf_dir):
    return sampled_histogram(layout(spark, sf_dir)).select("doc_id", "size", "chars")


@query
def half_point_sizes(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_extendedprice").cast("double") / 8).alias("raw")).distinct()
    return rows.select("raw", tx.half_points(F.col("raw")).alias("size"))


@query
def body_size(spark, sf_dir):
    return hd.body_size(histogram(spark, sf_dir), load(spark, sf_dir, "documents"))


@query
def heading_tiers(spark, sf_dir):
    h = histogram(spark, sf_dir)
    return hd.heading_tiers(h, hd.body_size(h, load(spark, sf_dir, "documents"))).select("doc_id", "size", "level")


@query
def block_size(spark, sf_dir):
    h = histogram(spark, sf_dir)
    spans = lines(spark, sf_dir).select(*PAGE, F.floor(F.col("line_no") / 3).alias("block_no"), "line_no", F.lit(0).alias("span_no"), "text", "size")
    return hd.block_size(spans, hd.body_size(h, load(spark, sf_dir, "documents"))).select(*PAGE, "block_no", "rep_size")


def layout_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = layout(spark, sf_dir, keep=True)
    h = stored(sampled_histogram(t), scratch(spark), "histogram")
    body = hd.body_size(h, t["doc_meta"])
    return hd.headings(t["spans"].select(*PAGE, "block_no", "text"), hd.block_size(t["spans"], body), hd.heading_tiers(h, body), h)


@query
def heading_confidence(spark, sf_dir):
    return layout_headings(spark, sf_dir).select(*PAGE, "block_no", "level", F.round("confidence", 6).alias("confidence"), "low")


@query
def confidence_range(spark, sf_dir):
    c = F.when(~F.col("low"), F.round("confidence", 6))
    return layout_headings(spark, sf_dir).groupBy("doc_id").agg(F.count(c).alias("sure"), F.min(c).alias("lo"), F.max(c).alias("hi"))


@query
def scanned_pages(spark, sf_dir):
    t = layout(spark, sf_dir)
    # Only short lines stand on the pages here, so that some look scanned.
    return ly.scanned_pages(t["pages"], t["spans"].filter("length(text) < 20"), t["images_raw"])


@query
def low_yield_pages(spark, sf_dir):
    t = layout(spark, sf_dir)
    chars = t["spans"].groupBy(*PAGE).agg(F.sum(F.length(tx.strip(F.col("text")))).alias("chars"))
    return ly.low_yield(chars, t["pages"].select(*PAGE))


@query
def scan_image_exclusion(spark, sf_dir):
    t = layout(spark, sf_dir)
    return ly.without_scan_rasters(im.placed(t["images_raw"]), t["pages"], t["pages"].filter("page_no % 2 = 0").select(*PAGE)).select(*PAGE, "xref", "excluded")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(*PAGE, F.col("line_no").alias("item_no"), F.lit(612.0).alias("width"), "bbox")


@query
def x_clusters(spark, sf_dir):
    return ly.x_clusters(line_items(spark, sf_dir)).select(*PAGE, "item_no", "cluster")


@query
def two_column_test(spark, sf_dir):
    return ly.column_test(ly.x_clusters(line_items(spark, sf_dir)))


@query
def reading_order(spark, sf_dir):
    return ly.reading_order(line_items(spark, sf_dir)).select(*PAGE, "item_no", F.col("place").cast("long").alias("place"), "uncertain")


@query
def list_groups(spark, sf_dir):
    rows = lines(spark, sf_dir).select(*PAGE, F.floor(F.col("line_no") / 4).alias("block_no"), "line_no", F.when(F.col("line_no") % 4 == F.col("doc_id") % 3, F.concat(F.lit("1. "), "text")).otherwise(F.col("text")).alias("text"))
    return ly.line_groups(rows).select(*PAGE, "block_no", "line_no", "starts", F.col("item").cast("long").alias("item"), "ordered")


@query
def list_merge(spark, sf_dir):
    kind = F.when(F.col("line_no") % 5 == 0, "list").when(F.col("line_no") % 11 == 7, "table").otherwise("paragraph")
    prefixed = F.when((F.col("line_no") + F.col("doc_id")) % 4 < 2, F.concat(F.lit("• "), "text")).otherwise(F.col("text"))
    rows = lines(spark, sf_dir).select(*PAGE, F.col("line_no").alias("place"), kind.alias("kind"), (F.col("line_no") % 2 == 0).alias("ordered"), prefixed.alias("text"))
    return ly.merged_lists(rows).select(*PAGE, "place", F.col("island").cast("long").alias("island"), "merged_kind", "merged_ordered")


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in blocks of four, some of which end in a hyphen."""
    ends = F.when(F.col("line_no") % 3 == 0, F.concat(F.lower("text"), F.lit("-"))).otherwise(F.lower("text"))
    return lines(spark, sf_dir).select("doc_id", F.floor(F.col("line_no") / 4).alias("block_no"), "line_no", ends.alias("text"), (F.col("line_no") % 5 == 0).alias("linked"))


@query
def hyphen_join(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = wrapped(spark, sf_dir)
    return rows.select("doc_id", "line_no", F.coalesce(ly.hyphen_joins(F.lag("text").over(order), F.col("text")), F.lit(False)).alias("joins"))


@query
def line_merge(spark, sf_dir):
    return ly.merged_lines(wrapped(spark, sf_dir), ["doc_id", "block_no"]).select("doc_id", "block_no", F.md5(F.col("text").cast("binary")).alias("text_md5"), "joins")


def line_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(*PAGE, F.col("line_no").alias("probe_no"), "bbox")


@query
def link_match(spark, sf_dir):
    return lk.greedy_matches(line_probes(spark, sf_dir), layout(spark, sf_dir)["links_raw"])


@query
def links_unassociated(spark, sf_dir):
    links = layout(spark, sf_dir)["links_raw"]
    return lk.unassociated(links, lk.greedy_matches(line_probes(spark, sf_dir), links)).select(*PAGE, "link_no", "uri")


@query
def table_partition(spark, sf_dir):
    t = layout(spark, sf_dir)
    return tb.partition_blocks(t["blocks_raw"], t["tables_raw"]).select(*PAGE, "block_no", "table_no")


@query
def cells_reconcile(spark, sf_dir):
    t = layout(spark, sf_dir)
    cells = t["tables_raw"].select(*PAGE, "table_no", F.explode(F.flatten("cells")).alias("text"))
    inside = tb.partition_blocks(t["blocks_raw"], t["tables_raw"]).filter("table_no IS NOT NULL").join(t["spans"].drop("bbox"), [*PAGE, "block_no"]).select(*PAGE, "table_no", "text")
    return tb.surplus_characters(cells, inside, [*PAGE, "table_no"])


@query
def table_flags(spark, sf_dir):
    t = layout(spark, sf_dir)
    none = inline(spark, [], "doc_id long, page_no int, table_no int")
    return tb.layout_flags(t["tables_raw"], none).select(*PAGE, "table_no", "code", "location")


@query
def image_page_counts(spark, sf_dir):
    return im.page_counts(layout(spark, sf_dir)["images_raw"])


@query
def image_decorative(spark, sf_dir):
    t = layout(spark, sf_dir)
    return im.judged(im.placed(t["images_raw"]), im.page_counts(t["images_raw"]), t["doc_meta"]).select(*PAGE, "xref", "decorative", "reason", "flag")


@query
def image_src(spark, sf_dir):
    data = im.extracted(layout(spark, sf_dir)["images_raw"])
    return data.select("doc_id", "xref", "mime_type", im.source(F.col("data"), F.col("mime_type")).alias("src"))


@query
def alt_choice(spark, sf_dir):
    rows = [(a, d, n) for a in ("A dog", "", None) for d in (True, False, None) for n in (True, False)]
    base = inline(spark, rows, "alt string, decorative boolean, needs_review boolean")
    return base.withColumn("shown", im.rendered_alt(F.col("alt"), F.col("decorative"), F.col("needs_review")))


@query
def overlap_ratios(spark, sf_dir):
    table = rect(F.lit(60), F.lit(190), F.lit(400), F.lit(275))
    return lines(spark, sf_dir).select("doc_id", "line_no", F.floor(geometry.overlap_ratio(F.col("bbox"), table) * 10000).alias("ratio"), geometry.covers_half(F.col("bbox"), table).alias("half"))


@query
def layout_intake(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), (F.col("doc_id") % 10 == 0).alias("needs_pass"), (F.col("n_chars") % 7).cast("int").alias("page_count"))
    scanned = docs.filter("doc_id % 4 = 1").select("doc_id", F.lit(0).alias("page_no"))
    return ocr_gate(accepted(docs), scanned, available=False).select("doc_id", "status", "error", "needs_ocr")


@query
def recognised_pages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 7 + 1).cast("int").alias("page_count"))
    scanned = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("page_no"))
    after = docs.select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.col("page_count") + 1).otherwise(F.col("page_count")).alias("page_count"))
    return recognised(docs, scanned, after.join(scanned.select("doc_id"), "doc_id"))


def layout_rebuilt(spark: SparkSession, sf_dir: str) -> accessible.AccessibleDocuments:
    detected = inline(spark, [], "doc_id long, code string, confidence double")
    return accessible.from_layout(layout_documents.LayoutDocuments(layout(spark, sf_dir, keep=True)), detected)


@query
def layout_blocks(spark, sf_dir):
    return layout_documents.LayoutDocuments(layout(spark, sf_dir, keep=True)).blocks.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query
def layout_report(spark, sf_dir):
    return layout_rebuilt(spark, sf_dir).items.groupBy("code", "severity").agg(F.count("*").alias("n"))


# Language ------------------------------------------------------------------


@query
def script_family(spark, sf_dir):
    rows = [(-1, "Hello 京都 and more English text around it, long enough to be Latin"), (-2, "これは日本語の文章です"), (-3, "Привет, мир"), (-4, "שלום עולם"), (-5, "123 456"), (-6, "abcdefg Ω Ж"), (-7, "ΑΒ ЖЗ"), (-8, "नमस्ते दुनिया")]
    texts = load(spark, sf_dir, "documents").select("doc_id", "text").unionByName(inline(spark, rows, "doc_id long, text string"))
    return texts.select("doc_id", language.script_family(F.col("text")).alias("family"))


@query
def language_decision(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    made = docs.select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" "), "lang", F.lit("-XX, en"))).alias("meta"), F.when(F.col("doc_id") % 7 == 0, "la").when(F.col("doc_id") % 7 == 1, "ru").otherwise(F.col("lang")).alias("code"), ((F.col("doc_id") % 10) / 10).alias("confidence"))
    return made.select("doc_id", language.decision(F.col("meta"), F.col("text"), F.col("code"), F.col("confidence")).alias("d")).select("doc_id", "d.lang", "d.flag")


@query
def language_grams(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return language_id.grams(docs).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@query
def language_id_accuracy(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    own = stored(language_id.grams(docs), scratch(spark), "grams")
    best = language_id.classify(docs, language_id.train(docs, own), own)
    return best.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "code")


# Rendering -----------------------------------------------------------------


@query
def render_runs(spark, sf_dir):
    cut = F.split("text", " ")
    run = lambda t, bold, italic, href: F.struct(t.alias("text"), F.lit(bold).alias("bold"), F.lit(italic).alias("italic"), (t if href else F.lit(None).cast("string")).alias("link_text"), F.lit(href).cast("string").alias("link_href"))
    runs = F.array(run(F.col("text"), True, True, None), run(F.concat(F.lit("a<b>&\n"), cut[0]), True, False, None), run(cut[0], False, False, 'x?a=1&b="2"'))
    return load(spark, sf_dir, "benchmark").select("item_id", render.runs_html(runs).alias("html"))


@query
def render_table_rows(spark, sf_dir):
    words = F.split("text", " ")
    cell = lambda i, j: F.struct(F.lit(i).alias("row_no"), F.lit(j).alias("col_no"), F.lit(False).alias("header"), F.lit(1 + j).alias("colspan"), F.lit(1).alias("rowspan"), F.array(F.struct(words[2 * i + j].alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(None).cast("string").alias("link_text"), F.lit(None).cast("string").alias("link_href"))).alias("runs"))
    cells = F.array(*[cell(i, j) for i in range(2) for j in range(2)])
    return load(spark, sf_dir, "benchmark").select("item_id", render.table_html(cells, F.lit(False), F.lit(2), F.lit("A & B"), F.col("item_id") % 2 == 0).alias("html"))


@query
def render_report_rows(spark, sf_dir):
    flags = report.all_flags(*flag_rows(spark, sf_dir))
    none = inline(spark, [], "doc_id long, fix_ord int, code string, wcag_sc string, message string, location string")
    its = report.items(flags, none)
    return its.select("doc_id", F.col("item_ord").cast("long").alias("item_ord"), report.item_row(F.struct("r_number", "wcag_sc", "severity", "code", "message", "location")).alias("html"))


@query
def html_shell(spark, sf_dir):
    parts = sequence(spark, sf_dir).select("doc_id", F.col("ord").alias("block_ord"), F.concat(F.lit("<p>"), tx.escaped(F.col("text")), F.lit("</p>")).alias("html"))
    docs = sequence_titles(spark, sf_dir).withColumn("lang", F.lit("fr"))
    html = F.regexp_replace("html", "(?s)<style>.*?</style>", "<style></style>")
    return render.documents_html(docs, parts).select("doc_id", F.md5(html.cast("binary")).alias("html_md5"))


# Office files --------------------------------------------------------------


@query
def docx_blocks(spark, sf_dir):
    found = docx_documents(with_docx(load(spark, sf_dir, "documents")))
    b = found.select("doc_id", "status", "meta_title", "meta_lang", F.explode_outer("blocks").alias("b"))
    return b.groupBy("doc_id", "status", "meta_title", "meta_lang").agg(F.count_if(F.col("b.kind") == "heading").alias("headings"), F.count_if(F.col("b.kind") == "paragraph").alias("paragraphs"), F.count_if(F.col("b.kind") == "list").alias("lists"), F.sum(F.coalesce(F.size("b.items"), F.lit(0))).alias("items"))


# Jobs ----------------------------------------------------------------------


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("at"), "event_id", F.col("event_type").alias("stage"), (F.col("value") % 1).alias("pct"))


@query
def job_latest_state(spark, sf_dir):
    return jobs.latest(job_log(spark, sf_dir)).select("job_id", "event_id", "stage")


@query
def stage_changes(spark, sf_dir):
    return jobs.stage_changes(job_log(spark, sf_dir)).select("job_id", "event_id", "stage", "was")


@query
def progress_rescale(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").select("event_id", F.round(jobs.rescaled(k, F.lit(100)), 6).alias("share"))
