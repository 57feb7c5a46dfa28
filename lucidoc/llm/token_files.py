"""Token ids in files of patched frame-of-reference blocks.

A file is a Parquet table part, so that Spark can write and read it in any store, whose rows are
segments of whole documents in ascending doc_id order. A segment's payload is

    "PFOR", version 1, block size        4s u2 u2
    number of ids, number of blocks      u4 u4
    byte offset of each block            u4 for each block   (the index of block starts)
    blocks

and a block is its minimum (u4), width (u1), exception count (u2), the packed low bits of each id
less the minimum (value i at bits i*width up, little-endian 64-bit words), the exceptions'
positions (u2 each) and their high parts, that is the value shifted right by the width (u4 each). The width is the least that
holds the block's differences up to a percentile; larger ones are exceptions. All numbers are
little-endian. The last block is filled up with its minimum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, slices
from .encoding import encoder

BLOCK, PERCENTILE, SEGMENT, END_ID = 128, 90, 262_144, 1
HEAD = struct.Struct("<4sHHII")
BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("patches", "<u2")])


def pack_bits(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of values under 2**width as rows of bytes."""
    n, size = rows.shape
    words = np.zeros((-(-size * width // 64) + 1, n), np.uint64)
    columns = np.ascontiguousarray(rows.T).astype(np.uint64)
    for i in range(size if width else 0):
        word, shift = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)[:, : -(-size * width // 8)]


def unpack_bits(packed: np.ndarray, width: int, size: int) -> np.ndarray:
    n = len(packed)
    whole = np.zeros((n, (-(-size * width // 64) + 1) * 8), np.uint8)
    whole[:, : packed.shape[1]] = packed
    words = np.ascontiguousarray(whole.view("<u8").T)
    out = np.zeros((size, n), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(size if width else 0):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        out[i] = value & mask
    return np.ascontiguousarray(out.T)


def encode_segment(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """The payload for unsigned 32-bit ids; of none, a payload without blocks."""
    n = len(ids)
    count = -(-n // block)
    if not count:
        return HEAD.pack(b"PFOR", 1, block, 0, 0)
    rows = np.full(count * block, ids[(count - 1) * block :].min(), np.uint32)
    rows[:n] = ids
    rows = rows.reshape(count, block)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    at = min(block - 1, percentile * block // 100)
    typical = np.partition(rows, at, axis=1)[:, at]
    widths = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    high = rows.astype(np.uint64) >> widths[:, None].astype(np.uint64)
    patched = high > 0
    patches = patched.sum(axis=1)
    heads = np.zeros(count, BLOCK_HEAD)
    heads["low"], heads["width"], heads["patches"] = low, widths, patches
    bodies: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        data = pack_bits(rows[which] & np.uint32((1 << width) - 1), width)
        for k, body in zip(which.tolist(), data):
            bodies[k] = body.tobytes()
    where, columns = np.nonzero(patched)
    positions, values = columns.astype("<u2").tobytes(), high[where, columns].astype("<u4").tobytes()
    ends = np.cumsum(patches).tolist()
    blocks, begin, head = [], 0, heads.tobytes()
    for k in range(count):
        end = ends[k]
        blocks.append(head[7 * k : 7 * k + 7] + bodies[k] + positions[2 * begin : 2 * end] + values[4 * begin : 4 * end])
        begin = end
    starts = np.cumsum([HEAD.size + 4 * count, *map(len, blocks[:-1])]).astype("<u4")
    return HEAD.pack(b"PFOR", 1, block, n, count) + starts.tobytes() + b"".join(blocks)


def decode_segment(payload: bytes, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of a payload, or of some of its blocks, which the index finds without reading others."""
    magic, version, block, n, count = HEAD.unpack_from(payload)
    if magic != b"PFOR" or version != 1:
        raise ValueError("not a payload of this format")
    starts = np.frombuffer(payload, "<u4", count, HEAD.size)
    chosen = np.arange(count)[blocks]
    if not len(chosen):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    heads = raw[starts[chosen].astype(np.int64)[:, None] + np.arange(7)].copy().view(BLOCK_HEAD).reshape(-1)
    rows = np.zeros((len(chosen), block), np.uint64)
    bodies = starts[chosen].astype(np.int64) + 7
    for width in np.unique(heads["width"]).tolist():
        which = np.flatnonzero(heads["width"] == width)
        size = -(-block * width // 8)
        rows[which] = unpack_bits(raw[bodies[which][:, None] + np.arange(size)], width, block)
    patches = heads["patches"].astype(np.int64)
    total = int(patches.sum())
    if total:
        owner = np.repeat(np.arange(len(chosen)), patches)
        k = np.arange(total) - np.repeat(np.cumsum(patches) - patches, patches)
        first = (bodies + -(-block * heads["width"].astype(np.int64) // 8))[owner]
        positions = raw[(first + 2 * k)[:, None] + np.arange(2)].copy().view("<u2").reshape(-1)
        values = raw[(first + 2 * patches[owner] + 4 * k)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        rows[owner, positions] |= values.astype(np.uint64) << heads["width"][owner].astype(np.uint64)
    ids = (rows + heads["low"][:, None]).astype(np.uint32)
    ends = [block] * len(chosen)
    if n % block and chosen[-1] == count - 1:
        return ids.reshape(-1)[: sum(ends) - block + n % block]
    return ids.reshape(-1)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encode whole texts (null: empty), append the end id to each and write files in doc_id order.

    Range partitions of doc_id, sorted, become a file each; `file_no` rises with doc_id, null ids come first. Rows of one
    doc_id stand in order of their texts' hashes, and are dealt to as many tasks as they need. Other columns are ignored; an empty
    table makes an empty table.
    """
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"file_no int, segment_no int, start long, n_ids long, doc_ids array<{kind}>, lengths array<long>, payload binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = encoder(tokenizer), end_id.to_bytes(4, "little")
        file_no, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list = []
        held = 0

        def made() -> pa.RecordBatch:
            nonlocal number, start, held
            payload = encode_segment(np.frombuffer(b"".join(ids), "<u4"))
            row = (file_no, number, start, held, list(names), [len(x) // 4 for x in ids], payload)
            number, start, held = number + 1, start + held, 0
            ids.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=pa.schema(arrow))

        for batch in slices(batches):
            for doc, data in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                ids.append(data + last)
                names.append(doc)
                held += len(ids[-1]) // 4
                if held >= segment:
                    yield made()
        if ids:
            yield made()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(schema))
    # The last keys part rows of one id, or rows that are repeated.
    base = base.withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ordered = base.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "text")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files, and with `with_ids`
    the ids. A null id is read as one; a repeated one has a row for each document; an empty table gives no rows."""
    files = spark.read.parquet(path)
    # A row for each file, so as many as tasks wrote: few enough for one window and a broadcast.
    totals = files.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    segments = files.join(F.broadcast(offsets), "file_no").select((F.col("before") + F.col("start")).alias("start"), "doc_ids", "lengths", "payload")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    schema = T._parse_datatype_string(f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, names, lengths, payload = (batch.column(k)[i].as_py() for k in range(4))
                data, begin = decode_segment(payload).tobytes(), 0
                rows = []
                for name, n in zip(names, lengths):
                    own = data[begin * 4 : (begin + n) * 4]
                    rows.append((name, at + begin, n, zlib.crc32(own)) + ((memoryview(own).cast("I").tolist(),) if with_ids else ()))
                    begin += n
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=pa.schema(arrow))

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(schema))
    return segments.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to a new shared folder and read them back; nulls and the like as in `write`."""
    path = f"{scratch(docs.sparkSession)}/ids"
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
