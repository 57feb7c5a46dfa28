"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised by its quantiles, the cells of the grid are numbered along the curve,
rows are sorted by that number and cut into runs of equal row counts. A shard is then a compact
region of the metadata, so file statistics prune it for a filter on any dimension. Equal texts go
by the metadata of one of them, so copies share a shard wherever it holds them.

All of it is DataFrame work. Ranks come from a range partitioning of the whole sort key, which is
unique where rows are, so a hot source or a large group of copies spreads over partitions; only
counts by partition are ever gathered. The curve is computed for cells (at most 2 ** (bits *
dimensions) of them), not for rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discarded, hot_join, scratch, stored, unlike

SHARDS, BITS = 40, 4
DIMENSIONS = ("source", "lang", "size")


def curve_index(axes: Column, dimensions: int, bits: int) -> Column:
    """The Hilbert number of a cell given as an array of coordinates below 2 ** bits.

    The published transpose method: undo the excess work of each level from the top bit down,
    Gray-encode, and interleave the bits. Each loop is a fold over its steps.
    """
    levels = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in levels for i in range(dimensions)]) if levels else None

    def undo(x: Column, step: Column) -> Column:
        q, i, first = step["q"], step["i"], F.element_at(x, 1)
        own = F.get(x, i)
        low = q - 1
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = own.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, k: F.when(inverted, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when(i == 0, v).when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v)
            ),
        )

    x = F.aggregate(steps, axes, undo) if steps is not None else axes
    gray = F.aggregate(
        x, F.array().cast("array<int>"), lambda done, v: F.concat(done, F.array(v.bitwiseXOR(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)))))
    )
    last = F.array(*[F.lit(q) for q in levels]).cast("array<int>")

    def flip(rows: Column) -> Column:
        top = F.element_at(rows, -1)
        turn = F.aggregate(last, F.lit(0), lambda t, q: F.when(top.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(rows, lambda v: v.bitwiseXOR(turn))

    # A one-element array binds an expression to a name, so that it isn't computed again at each use.
    flipped = F.element_at(F.transform(F.array(gray), flip), 1)
    pairs = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dimensions)])

    def interleave(rows: Column) -> Column:
        return F.aggregate(
            pairs,
            F.lit(0).cast("long"),
            lambda n, p: n * 2 + F.get(rows, p["i"]).bitwiseAND(F.pow(F.lit(2), p["b"]).cast("int")).__gt__(0).cast("long"),
        )

    return F.element_at(F.transform(F.array(flipped), interleave), 1)


def quantised(meta: DataFrame, dimensions: tuple[str, ...], bits: int) -> DataFrame:
    """The rows with `cell`, an array of coordinates: 0 for null, else 1 and up by quantile.

    A string's rank is that of the six bytes after what all values of its dimension begin with.
    """
    kinds = {f.name: f.dataType for f in meta.schema.fields}
    texts = [d for d in dimensions if isinstance(kinds[d], T.StringType)]
    if texts:
        ends = meta.agg(*[f(d).alias(f"{n}_{d}") for d in texts for n, f in (("lo", F.min), ("hi", F.max))]).head()
    ranks = {}
    for d in dimensions:
        if d in texts:
            lo, hi = (ends[f"lo_{d}"] or "").encode(), (ends[f"hi_{d}"] or "").encode()
            shared = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
            rest = F.rpad(F.hex(F.substring(F.col(d).cast("binary"), shared + 1, 6)), 12, "0")
            ranks[d] = F.conv(rest, 16, 10).cast("double")
        else:
            ranks[d] = F.col(d).cast("double")
    cuts = [i / ((1 << bits) - 1) for i in range(1, (1 << bits) - 1)]
    found = meta.agg(*[F.percentile_approx(ranks[d], cuts, 1000).alias(f"c{i}") for i, d in enumerate(dimensions)]).head()
    cells = []
    for i, d in enumerate(dimensions):
        bounds = sorted(set(found[f"c{i}"] or []))
        over = sum(((ranks[d] > b).cast("int") for b in bounds), F.lit(1))
        cells.append(F.when(F.col(d).isNull(), 0).otherwise(over).cast("int"))
    return meta.withColumn("cell", F.array(*cells))


def _ranked(docs: DataFrame, shards: int, dimensions: tuple[str, ...], bits: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of each row, whether it is a stray (a copy that stands by another's
    metadata), and `row`, a struct of the columns in `carry`."""
    folder = scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    meta = docs.select(
        "doc_id",
        *[F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions) if d != "size"],
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    meta = stored(meta, folder, "meta", all_tasks=True)
    own = [f"d{i}" for i, d in enumerate(dimensions) if d != "size"]
    if own:
        # Equal texts take the place of the one with the least doc_id, so that they stand together.
        first = F.min(F.struct("doc_id", *own)).alias("first")
        groups = stored(meta.groupBy("h").agg(first, F.count("*").alias("copies")).filter("copies > 1").select("h", "first"), folder, "groups")
        meta = hot_join(meta, groups, "h", "doc_id", meta.count(), "left")
        copied = F.col("first").isNotNull()
        away = reduce(or_, (~F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in own))
        meta = meta.select(*[F.when(copied, F.col(f"first.{c}")).otherwise(F.col(c)).alias(c) if c in own else c for c in meta.columns if c != "first"], (copied & away).alias("stray"))
        meta = stored(meta, folder, "grouped", all_tasks=True)
    else:
        meta = meta.withColumn("stray", F.lit(False))
    names = tuple("size" if d == "size" else f"d{i}" for i, d in enumerate(dimensions))
    meta = quantised(meta, names, bits)
    cells = meta.select("cell").distinct().select("cell", curve_index(F.col("cell"), len(dimensions), bits).alias("curve"))
    order = ("curve", "h", "doc_id")
    placed = meta.join(F.broadcast(cells), "cell").select("doc_id", "size", "text_crc32", "curve", "h", "stray", *(["row"] if carry else []))
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), folder, "ordered", all_tasks=True)
    discarded(docs.sparkSession, folder, "meta", "groups", "grouped")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # A row for each partition of the sort: few enough for one window and a broadcast.
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    order = Window.orderBy("part")
    offsets = counts.select(
        "part",
        (F.sum("n").over(order) - F.col("n")).alias("before"),
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + within)
    ranked = ranked.withColumn("shard", F.expr(f"rank * {shards} div total"))
    slot = (F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long")
    return ranked.withColumn("slot", slot).withColumn("shard", F.col("shard").cast("int"))


def assign(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null) and curve of each row.

    `dimensions` are columns of `docs`, or "size": the text's UTF-8 bytes plus 16 (null text: 16, as
    for an empty one, with checksum 0). Equal texts are a group, which has the curve number of its row with the least doc_id
    (a null id before others). Rows go by curve number, then text and doc_id, so a group stands together and is cut only where
    a shard is full. Shard sizes differ by one row at most; with fewer rows
    than shards some are empty. Null metadata has a coordinate of its own; repeated rows each get a
    slot; an empty table gives no rows; other columns are ignored, whatever they are called.
    """
    ranked = _ranked(docs, shards, dimensions, bits)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> list[str]:
    """Write the documents, with all their columns, as a Parquet table with a directory for each shard, rows in order of slots.

    Copies that stand by the metadata of another row have files of their own in their shard, so that they don't widen the
    ranges of the others'. Returns the names of the columns that say shard, stray and slot: just these unless the documents have columns
    called so. A task of the sort holds a run of the curve, so a shard is a few files. Rows and nulls as in `assign`; an empty
    table makes an empty one.
    """
    shard, stray, slot = names = unlike(docs.columns, "shard", "stray", "slot")
    ranked = _ranked(docs, shards, dimensions, bits, tuple(docs.columns))
    ranked.select("row.*", F.col("slot").alias(slot), F.col("shard").alias(shard), F.col("stray").cast("int").alias(stray)).write.partitionBy(shard, stray).parquet(path)
    return names


def pruning(written: DataFrame, shard: str = "shard", stray: str = "stray", dimensions: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """dimension, value, and the share of shards and of rows that a filter on the value reads: those of files whose least and
    greatest values leave room for it, as file statistics tell. Null values aren't listed."""
    out = None
    for d in dimensions:
        # Two rows for each shard at most, and the number of shards is fixed by the caller.
        ranges = written.groupBy(F.col(shard).alias("shard"), (F.col(stray) == 1).alias("stray")).agg(F.min(d).alias("least"), F.max(d).alias("greatest"), F.count("*").alias("n"))
        total = ranges.agg(F.count_distinct("shard").alias("shards"), F.sum("n").alias("rows"))
        values = written.filter(F.col(d).isNotNull()).select(F.col(d).alias("value")).distinct()
        met = values.join(F.broadcast(ranges), F.col("value").between(F.col("least"), F.col("greatest")))
        met = met.groupBy("value").agg(F.count_distinct(F.when(~F.col("stray"), F.col("shard"))).alias("met"), F.sum("n").alias("n"))
        part = met.join(F.broadcast(total)).select(F.lit(d).alias("dimension"), F.col("value").cast("string").alias("value"), (F.col("met") / F.col("shards")).alias("shards_read"), (F.col("n") / F.col("rows")).alias("rows_read"))
        out = part if out is None else out.unionByName(part)
    return out
