"""Accessible HTML from blocks, as string projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped
from .images import rendered_alt, source

#: Relative units and dark colours: contrast of 7:1 and over for body and links.
STYLE = (
    "body{font-family:sans-serif;font-size:1em;line-height:1.5;color:#1a1a1a;background:#ffffff;max-width:45em;margin:0 auto;padding:1em}"
    "a{color:#0b3d91;text-decoration:underline}table{border-collapse:collapse}th,td{border:1px solid #595959;padding:.3em .6em;text-align:left}"
    "img{max-width:100%}"
)
REPORT_STYLE = STYLE + "tr.severity-auto-fixed td.severity{color:#14532d}tr.severity-needs-human-review td.severity{color:#7f1d1d}tr.severity-info td.severity{color:#333333}"


def run_html(r: Column) -> Column:
    """A link shows its own text, without style; else line breaks, bold inside italic."""
    text = F.replace(escaped(r["text"]), F.lit("\n"), F.lit("<br>"))
    bold = F.when(r["bold"], F.concat(F.lit("<strong>"), text, F.lit("</strong>"))).otherwise(text)
    styled = F.when(r["italic"], F.concat(F.lit("<em>"), bold, F.lit("</em>"))).otherwise(bold)
    link = F.concat(F.lit('<a href="'), escaped(r["link_href"]), F.lit('">'), escaped(F.coalesce(r["link_text"], F.lit(""))), F.lit("</a>"))
    return F.when(r["link_href"].isNotNull(), link).otherwise(styled)


def runs_html(runs: Column) -> Column:
    return F.array_join(F.transform(runs, run_html), "")


def cell_html(cell: Column, in_header: Column, header_col: Column) -> Column:
    """th with a scope for header rows and columns, else td; spans only beyond 1."""
    row_head = header_col & (cell["col_no"] == 0)
    is_head = cell["header"] | in_header | row_head
    tag = F.when(is_head, "th").otherwise("td")
    scope = F.when(in_header, ' scope="col"').when(row_head, ' scope="row"').otherwise("")
    over = lambda name: F.when(cell[name] > 1, F.concat(F.lit(f' {name}="'), cell[name].cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit("<"), tag, scope, over("colspan"), over("rowspan"), F.lit(">"), runs_html(cell["runs"]), F.lit("</"), tag, F.lit(">"))


def rows_html(cells: Column, rows: Column, in_header: Column, header_col: Column) -> Column:
    row = lambda k: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.filter(cells, lambda c: c["row_no"] == k), lambda c: cell_html(c, in_header, header_col)), ""), F.lit("</tr>"))
    return F.array_join(F.transform(rows, row), "")


def table_html(cells: Column, header_row: Column, n_rows: Column, caption: Column | None = None, header_col: Column | None = None) -> Column:
    """A table whose first row is a header, marked or by default, if it has rows."""
    caption = F.lit(None).cast("string") if caption is None else caption
    header_col = F.lit(False) if header_col is None else header_col
    title = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("<caption>"), escaped(caption), F.lit("</caption>"))).otherwise("")
    head = F.when(n_rows > 0, F.concat(F.lit("<thead>"), rows_html(cells, F.array(F.lit(0)), F.lit(True), header_col), F.lit("</thead>"))).otherwise("")
    rest = F.when(n_rows > 1, F.sequence(F.lit(1), n_rows - 1)).otherwise(F.array().cast("array<int>"))
    body = F.when((n_rows > 1) | ((n_rows == 0) & ~header_row), F.concat(F.lit("<tbody>"), rows_html(cells, rest, F.lit(False), header_col), F.lit("</tbody>"))).otherwise("")
    return F.concat(F.lit("<table>"), title, head, body, F.lit("</table>"))


def list_html(ordered: Column, items: Column) -> Column:
    """Nested lists from items in document order, each with its depth and whether its list is ordered.

    A fold keeps the open lists' tags: going deeper opens one, coming back closes down to the item's depth.
    """
    tag = lambda o: F.when(o, "ol").otherwise("ul")
    start = F.struct(F.lit("").alias("html"), F.array().cast("array<string>").alias("open"))

    def closed(state: Column, depth: Column) -> Column:
        """HTML that closes lists below a depth, from the innermost out."""
        n = F.size(state["open"])
        inner = F.slice(F.reverse(state["open"]), 1, F.greatest(n - depth, F.lit(0)))
        return F.array_join(F.transform(inner, lambda t: F.concat(F.lit("</li></"), t, F.lit(">"))), "")

    def add(state: Column, item: Column) -> Column:
        depth, n = item["depth"] + 1, F.size(state["open"])
        t = tag(item["ordered"])
        same = (n >= depth) & (F.get(state["open"], depth - 1) == t)
        back = closed(state, depth)
        opening = F.when(n < depth, F.concat(F.lit("<"), t, F.lit(">"))).when(same, "</li>").otherwise(F.concat(F.lit("</li></"), F.coalesce(F.get(state["open"], depth - 1), F.lit("ul")), F.lit("><"), t, F.lit(">")))
        text = F.concat(state["html"], F.when(n > depth, back).otherwise(""), opening, F.lit("<li>"), runs_html(item["runs"]))
        return F.struct(text.alias("html"), F.concat(F.slice(state["open"], 1, depth - 1), F.array(t)).alias("open"))

    end = lambda s: F.concat(s["html"], closed(s, F.lit(0)))
    return F.when(F.size(items) == 0, F.concat(F.lit("<"), tag(ordered), F.lit("></"), tag(ordered), F.lit(">"))).otherwise(F.aggregate(items, start, add, end))


def image_html(data: Column, mime: Column, alt: Column, decorative: Column, needs_review: Column, href: Column) -> Column:
    img = F.concat(F.lit('<img src="'), source(data, mime), F.lit('" alt="'), escaped(rendered_alt(alt, decorative, needs_review)), F.lit('">'))
    return F.when(F.coalesce(href, F.lit("")) != "", F.concat(F.lit('<a href="'), escaped(href), F.lit('">'), img, F.lit("</a>"))).otherwise(img)


def blocks_html(blocks: DataFrame) -> DataFrame:
    """Blocks with `html`. Needs kind, runs, level_final, ordered, items, cells, n_rows, header_row, and for images data, mime_type, alt, decorative, needs_review, image_href.

    No source sets a table's caption or header_col; blocks that have these columns are shown with them."""
    caption = F.col("caption") if "caption" in blocks.columns else None
    header_col = F.coalesce("header_col", F.lit(False)) if "header_col" in blocks.columns else None
    level = F.col("level_final").cast("string")
    kind = F.col("kind")
    html = (
        F.when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(">"), runs_html(F.col("runs")), F.lit("</h"), level, F.lit(">")))
        .when(kind == "paragraph", F.concat(F.lit("<p>"), runs_html(F.col("runs")), F.lit("</p>")))
        .when(kind == "list", list_html(F.col("ordered"), F.col("items")))
        .when(kind == "table", table_html(F.col("cells"), F.col("header_row"), F.col("n_rows"), caption, header_col))
        .when(kind == "image", image_html(F.col("data"), F.col("mime_type"), F.col("alt"), F.col("decorative"), F.col("needs_review"), F.col("image_href")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown block kind: "), kind)))
    )
    return blocks.withColumn("html", html)


def documents_html(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pages of documents (doc_id, title, lang) from their parts (doc_id, block_ord, html) in order, empty ones left out."""
    body = parts.filter("html <> ''").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_ord", "html"))), lambda x: x["html"]), "\n").alias("body"))
    out = docs.join(body, "doc_id", "left")
    page = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="'), escaped(F.col("lang")), F.lit('">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'),
        escaped(F.col("title")), F.lit(f"</title>\n<style>{STYLE}</style>\n</head>\n<body>\n"), F.coalesce("body", F.lit("")), F.lit("\n</body>\n</html>\n"),
    )
    return out.select("doc_id", page.alias("html"))
