"""The compliance report: flags and autofixes as items with requirement and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escaped, generic_reason
from ..schemas import SEVERITIES, code_dim

ITEM = ["r_number", "wcag_sc", "severity", "code", "message", "location"]


def link_flags(links: DataFrame) -> DataFrame:
    """Links (text, href, owner) with `reason` why their text says too little; images' links aren't tested."""
    return links.withColumn("reason", F.when(F.col("owner") != "image", generic_reason(F.col("text")))).withColumn("flagged", F.col("reason").isNotNull())


def generic_link_flags(links: DataFrame) -> DataFrame:
    """Flag rows of the links that link_flags() marks."""
    found = link_flags(links).filter("flagged")
    return found.select(
        "doc_id",
        "block_ord",
        F.col("link_ord").alias("flag_ord"),
        F.lit("GENERIC_LINK_TEXT").alias("code"),
        F.lit("2.4.4").alias("wcag_sc"),
        F.concat(F.lit('Link text "'), "text", F.lit('" is '), "reason", F.lit(" and doesn't describe the link's purpose.")).alias("message"),
        F.concat(F.lit("link href: "), "href").alias("location"),
    )


def all_flags(document_flags: DataFrame, block_flags: DataFrame) -> DataFrame:
    """Document flags, then block flags in document order, numbered by document.

    Both have doc_id, flag_ord, code, wcag_sc, message, location; block flags also block_ord.
    """
    columns = ["doc_id", "scope", "block_ord", "flag_ord", "code", "wcag_sc", "message", "location"]
    both = document_flags.withColumn("scope", F.lit("document")).withColumn("block_ord", F.lit(-1)).select(*columns).unionByName(
        block_flags.withColumn("scope", F.lit("block")).select(*columns)
    )
    order = Window.partitionBy("doc_id").orderBy("block_ord", "flag_ord", "code")
    return both.withColumn("flag_no", F.row_number().over(order) - 1)


def items(flags: DataFrame, fixes: DataFrame) -> DataFrame:
    """Report items in order: by severity (fixed first), requirement as a string, code, then as they came, flags before fixes.

    Codes outside the dimension belong to R2, flags to a human, fixes to the fixed.
    """
    columns = ["doc_id", "seq", "code", "wcag_sc", "message", "location", "fallback"]
    left = flags.select("doc_id", F.struct(F.lit(0).alias("k"), F.col("flag_no").cast("long").alias("n")).alias("seq"), "code", "wcag_sc", "message", "location").withColumn("fallback", F.lit("needs-human-review"))
    right = fixes.select("doc_id", F.struct(F.lit(1).alias("k"), F.col("fix_ord").cast("long").alias("n")).alias("seq"), "code", "wcag_sc", "message", "location").withColumn("fallback", F.lit("auto-fixed"))
    rows = left.select(*columns).unionByName(right.select(*columns))
    # 23 rows: a fixed dimension.
    out = rows.join(F.broadcast(code_dim(rows.sparkSession)), "code", "left")
    out = out.withColumn("severity", F.coalesce("severity", "fallback")).withColumn("r_number", F.coalesce("r_number", F.lit("R2")))
    rank = F.when(F.col("severity") == SEVERITIES[0], 0).when(F.col("severity") == SEVERITIES[1], 1).when(F.col("severity") == SEVERITIES[2], 2).otherwise(3)
    order = Window.partitionBy("doc_id").orderBy(rank, "r_number", "code", "seq")
    return out.withColumn("item_ord", F.row_number().over(order) - 1).select("doc_id", "item_ord", *ITEM)


def totals(report_items: DataFrame, docs: DataFrame) -> DataFrame:
    """By document: total_items and a count for each severity, zeros included."""
    counts = report_items.groupBy("doc_id").agg(
        F.count("*").alias("total_items"),
        F.count_if(F.col("severity") == "auto-fixed").alias("auto_fixed"),
        F.count_if(F.col("severity") == "needs-human-review").alias("needs_human_review"),
        F.count_if(F.col("severity") == "info").alias("info"),
    )
    return docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["total_items", "auto_fixed", "needs_human_review", "info"])


def reports(docs: DataFrame, report_items: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each document (doc_id, title): `report`, the nested report, with items and links in order."""
    its = report_items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("item_ord", *ITEM))).alias("its"))
    ls = link_flags(links).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("link_ord", "text", "href", "flagged"))).alias("ls"))
    out = docs.select("doc_id", "title").join(totals(report_items, docs), "doc_id").join(its, "doc_id", "left").join(ls, "doc_id", "left")
    pick = lambda c, names: F.coalesce(F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in names])), F.array())
    summary = F.struct("total_items", F.col("auto_fixed").alias("auto-fixed"), F.col("needs_human_review").alias("needs-human-review"), "info")
    its_, ls_ = pick(F.col("its"), ITEM), pick(F.col("ls"), ("text", "href", "flagged"))
    return out.select("doc_id", F.struct(F.col("title").alias("document_title"), summary.alias("summary"), its_.alias("items"), ls_.alias("links")).alias("report"))


def report_json(report: DataFrame) -> DataFrame:
    """doc_id and the report as indented JSON, null locations included."""
    return report.select("doc_id", F.to_json("report", {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def item_row(x):
    labels = F.create_map(F.lit("auto-fixed"), F.lit("Auto-fixed"), F.lit("needs-human-review"), F.lit("Needs human review"), F.lit("info"), F.lit("Informational"))
    cell = lambda open_, c, close: F.concat(F.lit(open_), escaped(F.coalesce(c, F.lit(""))), F.lit(close))
    return F.concat(
        F.lit('<tr class="severity-'), x["severity"], F.lit('">'),
        cell("<td>", x["r_number"], "</td>"), cell("<td>", x["wcag_sc"], "</td>"),
        cell('<td class="severity">', F.coalesce(F.try_element_at(labels, x["severity"]), x["severity"]), "</td>"),
        cell("<td><code>", x["code"], "</code></td>"), cell("<td>", x["message"], "</td>"), cell("<td>", x["location"], "</td>"), F.lit("</tr>"),
    )


def link_row(x):
    text = F.when(x["text"] == "", "<em>(no text)</em>").otherwise(escaped(x["text"]))
    return F.concat(F.lit("<tr><td>"), text, F.lit("</td><td><code>"), escaped(x["href"]), F.lit("</code></td><td>"), F.when(x["flagged"], "Flagged").otherwise(""), F.lit("</td></tr>"))


def report_html(report: DataFrame, style: str) -> DataFrame:
    """doc_id and the report as a page of its own."""
    r = F.col("report")
    heads = lambda names: "<thead><tr>" + "".join(f'<th scope="col">{n}</th>' for n in names) + "</tr></thead>\n"
    rows = F.when(F.size(r["items"]) == 0, '<tr><td colspan="5">No issues found.</td></tr>').otherwise(F.array_join(F.transform(r["items"], item_row), "\n"))
    links = F.when(F.size(r["links"]) == 0, "").otherwise(
        F.concat(
            F.lit("<h2>Link inventory (R13b)</h2>\n<p>Check that each link's text makes its purpose clear.</p>\n<table>\n" + heads(("Link text", "URL", "Status")) + "<tbody>\n"),
            F.array_join(F.transform(r["links"], link_row), "\n"),
            F.lit("\n</tbody>\n</table>\n"),
        )
    )
    title, s = escaped(r["document_title"]), r["summary"]
    line = lambda label, c: F.concat(F.lit(f"<li>{label}: "), c.cast("string"), F.lit("</li>\n"))
    page = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>Compliance report: '), title,
        F.lit(f"</title>\n<style>{style}</style>\n</head>\n<body>\n<h1>Compliance report</h1>\n<p>Document: <strong>"), title, F.lit("</strong></p>\n<h2>Summary</h2>\n<ul>\n"),
        line("Total items", s["total_items"]), line("Auto-fixed", s["auto-fixed"]), line("Needs human review", s["needs-human-review"]), line("Informational", s["info"]),
        F.lit("</ul>\n<h2>Items</h2>\n<table>\n" + heads(("R#", "WCAG SC", "Severity", "Code", "Message", "Location")) + "<tbody>\n"), rows, F.lit("\n</tbody>\n</table>\n"), links, F.lit("</body>\n</html>\n"),
    )
    return report.select("doc_id", page.alias("html"))
