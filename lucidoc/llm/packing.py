"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document's ids (with an end id) are cut into full windows and one rest. Full windows stand
alone. The rests of a task go through a buffer of `group` pieces, each buffer being split into the
least number of windows that holds it: differencing merges the two partial partitions with the
largest imbalance in opposite order until one is left, which has near-equal sums; while its
largest sum exceeds the capacity, the number of windows rises by one.

A task reads its input split in order and keeps at most `group` rests, so memory doesn't grow
with the input, nothing is shuffled, and a task that runs again gives the same sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, released, slices
from .encoding import encoder

CAPACITY, GROUP, END_ID = 4096, 1024, 2


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of `sizes` in `ways` lists of near-equal sums (multiway differencing).

    A partial partition keeps its non-empty parts only, by falling sum: the others are zeros.
    """
    if ways == 1:
        return [list(range(len(sizes)))]
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # Part k of a (falling) meets part ways-1-k of b, so only the ends overlap.
        over = len(a) + len(b) - ways
        if over <= 0:
            parts = a + b
        else:
            parts = a[: len(a) - over] + b[: len(b) - over]
            parts += [(a[len(a) - over + k][0] + b[len(b) - 1 - k][0], (a[len(a) - over + k][1], b[len(b) - 1 - k][1])) for k in range(over)]
        parts.sort(key=lambda p: -p[0])
        low = parts[-1][0] if len(parts) == ways else 0
        heapq.heappush(heap, (low - parts[0][0], serial, parts))
        serial += 1
    out = []
    for _, tree in heap[0][2]:
        flat, todo = [], [tree]
        while todo:
            x = todo.pop()
            todo.extend(x) if isinstance(x, tuple) else flat.append(x)
        out.append(flat)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of `sizes` in as few windows as differencing fits within the capacity."""
    if not sizes:
        return []
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, ways)
        if max(sum(sizes[i] for i in part) for part in parts) <= capacity:
            return [p for p in parts if p]
        ways += 1


PIECES = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP, end_id: int = END_ID, keep_ids: bool = False, remember: int = 1_000_000) -> DataFrame:
    """One row per piece of the documents' ids: doc_id, start (ids of its document before it),
    length, ids_crc32, doc_tokens (with the end id), sequence_id, offset (where in the sequence it
    begins), and with `keep_ids` the ids themselves as little-endian unsigned 32-bit numbers. `remember` bounds the chunks whose ids a worker keeps.

    A null or empty text is its end id alone. Repeated rows and repeated or null ids are documents
    of their own. An empty table gives no rows. Other columns are ignored. Sequences are to be
    padded to the capacity unless their length is a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = encoder(path, remember), end_id.to_bytes(4, "little")
        serial = TaskContext.get().partitionId() << 40
        rests: list[tuple] = []
        rows: list[tuple] = []

        def settle() -> None:
            nonlocal serial
            for part in windows([r[2] for r in rests], capacity):
                at = 0
                for i in sorted(part):
                    rows.append((*rests[i][:5], serial, at, *rests[i][5:]))
                    at += rests[i][2]
                serial += 1
            rests.clear()

        def ids(data: bytes) -> tuple:
            return (data,) if keep_ids else ()

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=pa.schema(arrow))

        for batch in slices(batches):
            for doc, data in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                data += last
                total = len(data) // 4
                for start in range(0, total, capacity):
                    piece = data[start * 4 : (start + capacity) * 4]
                    n = len(piece) // 4
                    row = (doc, start, n, zlib.crc32(piece), total)
                    if n == capacity:
                        rows.append((*row, serial, 0, *ids(piece)))
                        serial += 1
                    else:
                        rests.append((*row, *ids(piece)))
                        if len(rests) == group:
                            settle()
            yield made()
        settle()
        yield made()

    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = T._parse_datatype_string(PIECES.format(kind) + (", ids binary" if keep_ids else ""))
    arrow = list(to_arrow_schema(schema))
    return base.mapInArrow(released(run), schema)


def assembled(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from `pack(..., keep_ids=True)`; a group has at most a capacity of ids.

    An empty table gives no rows; pieces that are repeated are joined as often."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"))
