"""Benchmark decontamination as a prefix-filtered set join on shingles of words.

An item's windows (of `window` words, or the whole of a shorter item) are sets of shingles at known offsets. A window
occurs only where all of its shingles do, so one of them is the prefix that must match: the rarest, by the number of
items that hold it. Neighbouring windows share it, so prefixes are a fraction of the benchmark's shingles.

One pass over the documents meets their shingles with the prefixes alone. A match proposes an alignment, which the bounds of
position and length test, and the words at that place, as many as the window has, are looked up among the windows and compared
with them. So neither documents' shingles nor their words are shuffled; what is written are true occurrences and a marker for
each document.

Prefixes and windows are broadcast in blocks of at most BLOCK windows, with a pass for each block: the bound holds for
benchmarks of any size. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, hot_join, scratch, stored, unlike

#: Words of a window and of a shingle, and windows of a block (some 13 words each, so about 15 MB).
WINDOW, SHINGLE, BLOCK = 13, 3, 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ROW = ("k1", "k2")


def words_of(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def shingle_at(words: Column, at: Column, width: int) -> Column:
    """A key for the `width` words from a position on; whoever uses it looks whether there are as many."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + i) for i in range(width)])


def by_width(width: Column, make) -> Column:
    """make(w) for the width w that a column holds, from 1 to that of a shingle."""
    out = F.when(width == 1, make(1))
    for w in range(2, SHINGLE + 1):
        out = out.when(width == w, make(w))
    return out


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """A row for each window of each item: item_id (a string), L and words of the window, s (width of its shingles) and
    its prefix: key h and offset in the window. Items without words have none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    k = F.size("words")
    items = items.select("item_id", "words", F.least(k, F.lit(window)).alias("L"), F.least(k, F.lit(min(window, SHINGLE))).alias("s"))
    each = items.select("item_id", "words", "s", F.explode(F.sequence(F.lit(0), k - F.col("s"))).alias("at"))
    keys = each.select("item_id", F.xxhash64("words").alias("version"), by_width(F.col("s"), lambda w: shingle_at(F.col("words"), F.col("at"), w)).alias("h"))
    rarity = keys.distinct().groupBy("h").agg(F.count("*").alias("held"))
    windows = items.select("item_id", "L", "s", F.explode(F.transform(F.sequence(F.lit(0), k - F.col("L")), lambda i: F.slice("words", i + 1, F.col("L")))).alias("words"))
    inside = windows.select("L", "s", "words").distinct().withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("L") - F.col("s"))))
    inside = inside.withColumn("h", by_width(F.col("s"), lambda w: shingle_at(F.col("words"), F.col("offset"), w))).join(rarity, "h")
    rarest = inside.groupBy("L", "s", "words").agg(F.min(F.struct("held", "h", "offset")).alias("r"))
    return windows.distinct().join(rarest.select("words", F.col("r.h").alias("h"), F.col("r.offset").alias("offset")), "words")


def window_key(words: Column) -> Column:
    return F.xxhash64(F.size(words), words)


def occurrences(docs: DataFrame, prefixes: DataFrame, windows: DataFrame, widths: list[int], marked: bool) -> DataFrame:
    """doc_id, k1, k2, n_words, start, L and wid of each place of a document at which a window of the block stands, and with
    `marked` a row for each document whose wid is null.

    All joins are with broadcast tables, so a position's row is never written unless it is an occurrence, and a
    document's words are held once, by reference, while its positions are gone through.
    """
    base = docs.select("doc_id", F.xxhash64("doc_id").alias("k1"), F.xxhash64(F.lit("t"), "text").alias("k2"), words_of(F.col("text")).alias("words"))
    base = base.withColumn("n_words", F.size("words"))
    first = -1 if marked else 0
    if not marked:
        base = base.filter("n_words > 0")
    rows = base.withColumn("pos", F.explode(F.sequence(F.lit(first), F.col("n_words") - 1)))
    here = lambda w: F.when((F.col("pos") >= 0) & (F.col("pos") + w <= F.col("n_words")), shingle_at(F.col("words"), F.col("pos"), w))
    if len(widths) == 1:
        rows = rows.withColumn("h", here(widths[0]))
    else:
        rows = rows.withColumn("s", F.explode(F.array(*map(F.lit, widths)))).filter((F.col("pos") >= 0) | (F.col("s") == widths[0]))
        rows = rows.withColumn("h", by_width(F.col("s"), here))
    marker = F.col("pos") < 0
    met = rows.join(F.broadcast(prefixes), "h", "left").filter(marker | F.col("places").isNotNull())
    met = met.withColumn("place", F.explode_outer("places")).withColumn("start", F.col("pos") - F.col("place.offset")).withColumn("L", F.col("place.L"))
    met = met.filter(marker | ((F.col("start") >= 0) & (F.col("start") + F.col("L") <= F.col("n_words"))))
    met = met.withColumn("there", F.slice("words", F.col("start") + 1, F.col("L"))).withColumn("key", window_key(F.col("there")))
    right = windows.select(F.col("key").alias("wkey"), F.col("words").alias("wwords"), "wid")
    found = met.join(F.broadcast(right), (F.col("key") == F.col("wkey")) & (F.col("there") == F.col("wwords")), "left")
    return found.filter(marker | F.col("wid").isNotNull()).select("doc_id", *ROW, "n_words", "start", "L", "wid")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes of id and text (k1, k2), n_words, n_hit, n_items, items (their ids as sorted strings) and
    contaminated, for each row of `docs`.

    A word is hit if it stands inside an occurrence of an item's window; a document with a hit is contaminated when 20 * n_hit >= n_words. Null and empty texts have no
    words and are clean; items without words match nothing; items with a null id hit words but aren't
    listed; an id that comes with several texts is listed once. Repeated rows get equal results; an empty table of either kind
    is fine; other columns are ignored, whatever they are called.
    """
    folder = scratch(docs.sparkSession)
    each = stored(benchmark_windows(benchmark, window), folder, "item-windows")
    windows = each.select("words", "L", "s", "h", "offset").distinct().withColumn("wid", F.monotonically_increasing_id())
    windows = stored(windows.withColumn("key", window_key(F.col("words"))), folder, "windows")
    size = windows.agg(F.count("*"), F.collect_set("s")).head()
    widths, blocks = sorted(size[1]) or [SHINGLE], max(1, -(-size[0] // BLOCK))
    found = None
    for k in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == k)
        # At most window ** 2 places for a key, however many windows have it.
        prefixes = own.groupBy("h").agg(F.collect_set(F.struct("offset", "L")).alias("places"))
        part = stored(occurrences(docs, prefixes, own, widths, marked=k == 0), folder, f"found-{k}", all_tasks=True)
        found = part if found is None else found.unionByName(part)
    every = found.filter("wid IS NULL").select("doc_id", *ROW, "n_words")

    # A document's hit words: its occurrences by place, each counted beyond the end of those before it.
    places = found.filter("wid IS NOT NULL").select(*ROW, "start", "L", "wid").distinct()
    end = F.col("start") + F.col("L")
    before = Window.partitionBy(*ROW).orderBy("start", "L").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    by_doc = places.withColumn("fresh", fresh).groupBy(*ROW).agg(F.sum("fresh").cast("long").alias("n_hit"), F.sort_array(F.collect_set("wid")).alias("wids"))
    by_doc = stored(by_doc, folder, "by-document")
    # Documents with the same windows have the same items, which are listed once for each such set.
    of_window = each.join(windows.select("words", "wid"), "words").select("wid", "item_id").filter("item_id IS NOT NULL").distinct()
    sets = by_doc.select("wids").distinct()
    listed = sets.withColumn("wid", F.explode("wids")).join(of_window, "wid").groupBy("wids").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    by_doc = hot_join(by_doc, stored(listed, folder, "items-of-sets"), "wids", "k1", by_doc.count(), "left")

    joined = every.join(by_doc, list(ROW), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id",
        *ROW,
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), F.lit(0)).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with all their columns, whatever these are called.

    Null and empty texts stay, rows that are repeated stay or go together, and an empty benchmark takes nothing away.
    """
    a, b = unlike(docs.columns, "bad_1", "bad_2")
    bad = contamination(docs, benchmark, window).filter("contaminated").select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    bad = stored(bad, scratch(docs.sparkSession), "contaminated")
    few = bad.count() <= 200_000  # 16 bytes each
    same = (F.xxhash64("doc_id") == F.col(a)) & (F.xxhash64(F.lit("t"), "text") == F.col(b))
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")
