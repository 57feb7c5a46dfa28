"""Links: matching with what they cover, inventory, and what is left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import covers_half

PAGE = ["doc_id", "page_no"]


def candidates(probes: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of a page's probes (probe_no, bbox) and links (link_no, uri, bbox) that share half the smaller area."""
    right = links.select(*PAGE, "link_no", "uri", F.col("bbox").alias("link_box"))
    return probes.join(right, PAGE).filter(covers_half(F.col("bbox"), F.col("link_box"))).select(*PAGE, "probe_no", "link_no", "uri")


def greedy_matches(probes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, page_no, probe_no, link_no, uri): probes in order take the first link that no probe before took.

    Where no link has two candidates and no probe has, that is the join itself. The pairs of a contested page, which are
    few, are folded in order: a pair counts if neither of its sides is taken yet.
    """
    pairs = candidates(probes, links.filter(F.coalesce("uri", F.lit("")) != ""))
    by_link = F.count("*").over(Window.partitionBy(*PAGE, "link_no"))
    by_probe = F.count("*").over(Window.partitionBy(*PAGE, "probe_no"))
    pages = pairs.withColumn("most", F.greatest(by_link, by_probe)).groupBy(*PAGE).agg(
        F.max("most").alias("most"), F.sort_array(F.collect_list(F.struct("probe_no", "link_no", "uri"))).alias("pairs")
    )

    def take(done: Column, pair: Column) -> Column:
        taken = F.exists(done, lambda d: (d["probe_no"] == pair["probe_no"]) | (d["link_no"] == pair["link_no"]))
        return F.when(taken, done).otherwise(F.concat(done, F.array(pair)))

    folded = F.aggregate("pairs", F.slice("pairs", 1, 0), take)
    kept = F.when(F.col("most") == 1, F.col("pairs")).otherwise(folded)
    return pages.select(*PAGE, F.explode(kept).alias("m")).select(*PAGE, "m.*")


def unassociated(links: DataFrame, matched: DataFrame) -> DataFrame:
    """Links that nothing took."""
    return links.filter(F.coalesce("uri", F.lit("")) != "").join(matched, [*PAGE, "link_no"], "left_anti")


def inventory(blocks: DataFrame) -> DataFrame:
    """Every link of blocks (doc_id, block_ord, runs, items, cells, image) in document order: link_ord, block_ord, owner, text, href."""
    linked = lambda runs, owner: F.transform(F.filter(runs, lambda r: r["link_href"].isNotNull()), lambda r: F.struct(r["link_text"].alias("text"), r["link_href"].alias("href"), F.lit(owner).alias("owner")))
    none = F.array().cast("array<struct<text:string,href:string,owner:string>>")
    nested = lambda parts, owner: F.coalesce(F.flatten(F.transform(parts, lambda p: linked(p["runs"], owner))), none)
    image = F.when(F.col("image.link_href").isNotNull(), F.array(F.struct(F.lit("").alias("text"), F.col("image.link_href").alias("href"), F.lit("image").alias("owner")))).otherwise(none)
    every = F.concat(F.coalesce(linked(F.col("runs"), "block"), none), nested(F.col("items"), "item"), nested(F.col("cells"), "cell"), image)
    rows = blocks.select("doc_id", "block_ord", F.posexplode(every).alias("k", "l")).select("doc_id", "block_ord", "k", "l.*")
    order = Window.partitionBy("doc_id").orderBy("block_ord", "k")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("link_ord"), "block_ord", "owner", "text", "href")
