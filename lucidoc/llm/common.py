"""Helpers shared by the operators: tables in the shared folder, word splitting, loading."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..shipping import ship

#: Words are runs of anything but the six ASCII blanks.
WORDS = re.compile("[^\x20\x09-\x0d]+")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
FOLD = str.maketrans(ASCII_UPPER, ASCII_LOWER)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Before work in Python: ship the package, and keep Arrow batches small, since a task holds several copies of one.

    A session that sets the batch size itself keeps it.
    """
    ship(spark)
    if ARROW_BYTES not in dict(spark.sparkContext.getConf().getAll()) and spark.conf.get(ARROW_BYTES, None) in (None, "67108864b", "64MB", "9223372036854775807b"):
        spark.conf.set(ARROW_BYTES, "8m")


class Memory(dict):
    """What `compute` makes of short strings, kept from one batch to the next.

    Python workers live on from stage to stage, so only the memory in use keeps anything:
    `begin` empties the others, and this one if it has grown beyond its bound.
    """

    every: list[Memory] = []

    def __init__(self, compute: Callable, longest: int = 48):
        self.compute, self.longest = compute, longest
        Memory.every.append(self)

    def __missing__(self, key: str):
        value = self.compute(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def begin(self, most: int) -> None:
        for other in Memory.every:
            if other and (other is not self or len(self) > most):
                other.clear()


def released(run: Callable) -> Callable:
    """`run`, a function of Arrow batches, which at its end gives the system back what the worker holds but doesn't use.

    Workers live on from stage to stage, and an idle one would keep the most it ever needed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return whole


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; it goes when the application ends."""
    prepare(spark)
    return tables.scratch(spark)


def stored(df: DataFrame, folder: str, name: str, all_tasks: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which cuts lineage and outlives executors.

    Each file costs the file system several calls, and some stores a process each; so twice as many tasks as there
    are cores write it, each going through its partitions in turn. `all_tasks` keeps the partitions apart, for long work.
    """
    most = 2 * df.sparkSession.sparkContext.defaultParallelism
    return tables.stored(df if all_tasks else df.coalesce(most), folder, name)


discarded = tables.discarded


def unlike(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column is called so (in either case)."""
    there, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        out.append(name)
    return out


def weighed(df: DataFrame, key: str, n: int) -> DataFrame:
    """The keys of `df` (n rows) that hold more than their share, as (key, pieces): into how many pieces to deal out their rows.

    A share is a hundred-thousandth of all rows, and 1000 at least, so there are at most 100,000 such keys: small enough to broadcast.
    """
    share = max(1000, n // 100_000)
    return df.groupBy(key).agg(F.count("*").alias("pieces")).filter(F.col("pieces") > share).select(key, F.ceil(F.col("pieces") / share).cast("int").alias("pieces"))


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, n: int, how: str = "inner") -> DataFrame:
    """left.join(right, key), where right has one row for each key and left may hold a large part of its n rows under one.

    The rows of such a key are dealt to tasks by a hash of `by` as well, and right's row is repeated for each piece. `left` is
    read twice, so it should be stored. `how` is inner or left; a null key matches nothing.
    """
    if n <= 20_000:
        return left.join(right, key, how)
    pieces, piece = unlike([*left.columns, *right.columns], "pieces", "piece")
    hot = weighed(left.select(key), key, n).withColumnRenamed("pieces", pieces)
    many = F.coalesce(pieces, F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(piece, F.pmod(F.xxhash64(by), many).cast("int")).drop(pieces)
    copies = right.join(F.broadcast(hot), key, "left").withColumn(piece, F.explode(F.sequence(F.lit(0), many - 1))).drop(pieces)
    return dealt.join(copies, [key, piece], how).drop(piece)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does that for pure ASCII at a fraction of translate()'s cost."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def slices(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds few texts' worth of bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index("text")
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def per_document(df: DataFrame, function: Callable[[list], dict], schema: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One output row for each input row: the keys, then what `function` makes of a list of texts
    (a list for each output column; a null text comes as None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = function(batch.column(len(keys)).to_pylist())
            arrays = [batch.column(i) for i in range(len(keys))]
            arrays += [pa.array(made[f.name], f.type) for f in arrow[len(keys) :]]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(arrow))

    prepare(df.sparkSession)
    base = df.select(*keys, F.col("text").cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(schema)
    full = StructType([base.schema[k] for k in keys] + extra.fields)
    arrow = [f.with_nullable(True) for f in to_arrow_schema(full)]
    return base.mapInArrow(released(run), full)
