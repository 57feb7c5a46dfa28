"""Near-duplicate detection with SetSketch registers.

1. Each text becomes the set of its word shingles (64-bit hashes). Texts with equal sets form a
   class; from here on a class counts once, however many copies it has.
2. A class gets a SetSketch: m registers, each the exponentially spaced, truncated minimum of an
   exponential hash over the set. Two registers agree with a probability close to the Jaccard
   similarity. Groups of `rows` registers are hashed to band keys; classes with a key in common are
   candidates. With 48 bands of 6, a pair at similarity 0.8 is missed with probability 5e-7, one at 0.9 with
   below 1e-15.
3. A candidate pair's similarity is estimated from its registers by joint maximum likelihood, given
   the sizes of the sets; pairs more than six standard deviations below the threshold go. The rest are verified
   on the full sets.
4. Pairs inside a band's bucket aren't all listed. First each class is compared with the least leader of its
   buckets, then with the leaders of buckets that still hold several components. Classes of such buckets then
   go through an exact join: pairs of different components that share a rare enough shingle at early
   enough places to be similar at all. So no link between components is lost there, and copies with many edits
   of their own, or texts with only a passage in common, make no pairs.

Large groups never meet in one task: buckets are reduced by partial aggregation, and the rows of a leader, a label or a
shingle that has more than its share are dealt out over tasks, the other side's row being repeated for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FOLD, WORDS, Memory, discarded, hot_join, per_document, released, scratch, slices, stored, unlike, weighed

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_535
SHINGLE, PERCENT = 5, 80
BLOOM_BITS = 1 << 23
BLOCK = 1 << 14
MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: str) -> int:
    """64 bits of a word after A-Z are lower-cased."""
    return xxhash.xxh3_64_intdigest(word.translate(FOLD).encode("utf-8", "surrogatepass"))


_memory = Memory(_hash)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of fewer words, one for the whole sequence; of none, none."""
    words = WORDS.findall(text) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    _memory.begin(100_000)
    h = np.fromiter(map(_memory.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    x = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        x = scrambled(x * MIX + h[k : len(words) - n + 1 + k])
    return np.unique(x)


def sketch(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of a non-empty set.

    Each element is the seed of a Poisson process of rate m whose points fall on random registers, so a register's
    first point is an exponential hash of the element, independent over registers. Points come in
    rising order, and an element is done once it is past the largest minimum: elements of large sets need few.
    """
    least = np.full(m, np.inf)
    for start in range(0, len(elements), BLOCK):  # minima merge, so a long text takes no more memory than a block
        alive = elements[start : start + BLOCK]
        at, serial = np.zeros(len(alive)), 0
        while len(alive):
            count = max(4, 3200 // len(alive) + 1)
            steps = np.arange(serial, serial + count, dtype=np.uint64) * MIX
            bits = scrambled(alive[:, None] + steps[None, :])
            gaps = -np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / m
            gaps[:, 0] += at
            points = np.cumsum(gaps, axis=1)
            register = ((scrambled(bits ^ MIX) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(least, register.astype(np.int64).reshape(-1), points.reshape(-1))
            at, serial = points[:, -1], serial + count
            keep = at < least.max()
            alive, at = alive[keep], at[keep]
    return np.clip(np.floor(1 - np.log(least / RATE) / np.log(BASE)), 0, TOP).astype("<u2")


def band_keys(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch (sketches are rows)."""
    parts = registers.reshape(len(registers), -1, rows).astype(np.uint64)
    x = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        x = scrambled(x * MIX + parts[:, :, k])
    return x.view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarities by joint maximum likelihood from registers (rows) and set sizes.

    Given u and v, the sizes' shares, a register is larger in the first set with probability p(u - vJ), in
    the second with p(v - uJ), where p(x) = -log_base(1 - x (base - 1) / base). The log-likelihood
    is concave in J, so its maximum is found by ternary search.
    """
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        first, second = p(u - v * j), p(v - u * j)
        rest = np.maximum(1 - first - second, 1e-300)
        return more * np.log(np.maximum(first, 1e-300)) + less * np.log(np.maximum(second, 1e-300)) + same * np.log(rest)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        up = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(up, low + third, low), np.where(up, high, high - third)
    return (low + high) / 2


def floor_of(percent: int, m: int = REGISTERS) -> float:
    """Estimates below this are over six standard deviations under the threshold."""
    t = percent / 100
    return t - 6 * (t * (1 - t) / m) ** 0.5


def _sketches(size: int, texts: list) -> dict:
    out: dict[str, list] = {"n": [], "sig": [], "regs": []}
    for text in texts:
        elements = shingle_set(text, size)
        out["n"].append(len(elements))
        out["sig"].append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None)
        out["regs"].append(sketch(elements).tobytes() if len(elements) else None)
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            registers = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(part.num_rows, -1)
            keys = band_keys(registers)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], names=["key", "nid"])


def _estimate(floor: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, na, nb, ra, rb) whose estimate isn't below the floor, as (a, b)."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            ra, rb = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<u2").reshape(part.num_rows, -1) for k in (4, 5))
            na, nb = (part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
            good = pa.array(estimated(ra, rb, na, nb) >= floor)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) with the sizes of their sets' intersection and union."""
    for batch in batches:
        both, either = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            common = len(np.intersect1d(x, y, assume_unique=True))
            both.append(common)
            either.append(len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "common", "total"]
        )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (nid, token) of sets (nid, elements)."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [np.frombuffer(x.as_buffer(), "<i8") for x in part.column(1)]
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["nid", "token"])


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node and label (least node reachable) of every node of the edges (a, b).

    Each round takes the least label among neighbours, for the node and for its old label and all who have it,
    then the label's label. So whole regions join at once, and long chains in any order of ids take rounds
    in proportion to the logarithm of their length; it goes on until nothing changes. Tables cut lineage.
    """
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select("b", "a")), folder, f"{name}-both")
    n = both.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = stored(labels, folder, f"{name}-0")
    for k in count(1):
        of_b = labels.select(F.col("node").alias("b"), "label")
        near = hot_join(both, of_b, "b", "a", n).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        low = stored(labels.join(near, "node").select("node", F.least("label", "m").alias("low"), F.col("label").alias("was")), folder, f"{name}-low-{k}")
        hooks = low.groupBy("was").agg(F.min("low").alias("hook"))
        own = hooks.select(F.col("was").alias("node"), F.col("hook").alias("own"))
        up = hot_join(low, hooks, "was", "node", n).join(own, "node", "left").select("node", F.least("low", "hook", "own").alias("up"), "was")
        up = stored(up, folder, f"{name}-up-{k}")
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        after = stored(hot_join(up, jump, "up", "node", n).select("node", F.col("far").alias("label"), "was"), folder, f"{name}-{k}")
        labels = after.select("node", "label")
        done = after.filter(F.col("label") != F.col("was")).isEmpty()
        discarded(spark, folder, f"{name}-{k - 1}", f"{name}-low-{k}", f"{name}-up-{k}", *([f"{name}-both"] if done else []))
        if done:
            return labels


class NearDuplicates:
    """The work of one call; tables go to a folder of their own."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.spark: SparkSession = docs.sparkSession
        self.docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        self.size, self.percent = size, percent
        self.folder, self.made = scratch(self.spark), []

    def keep(self, df: DataFrame, name: str, all_tasks: bool = False) -> DataFrame:
        self.made.append(name)
        return stored(df, self.folder, name, all_tasks)

    def near_sizes(self, na: str, nb: str):
        return (100 * F.least(na, nb) >= self.percent * F.greatest(na, nb))

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, h, n, sig) of each row, h being a hash of its text, and (sig, nid, least, label, component_id) of each class."""
        rows = self.docs.withColumn("h", F.xxhash64("text"))
        sketched = self.keep(per_document(rows, partial(_sketches, self.size), "n long, sig binary, regs binary", ("doc_id", "h")), "sketched", all_tasks=True)
        some = sketched.filter(F.col("n") > 0)
        classes = some.groupBy("sig", "n").agg(F.min("doc_id").alias("least"), F.min("regs").alias("regs"))
        nodes = self.keep(classes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
        bands = nodes.select("nid", "regs").mapInArrow(released(_bands), "key long, nid long")
        buckets = bands.groupBy("key").agg(F.min("nid").alias("leader"), F.max("nid").alias("last")).filter("leader < last").select("key", "leader")
        members = self.keep(bands.join(buckets, "key"), "members")
        first = members.groupBy("nid").agg(F.min("leader").alias("leader"))
        picked = self.keep(nodes.join(first, "nid").select("nid", "sig", "n", "least", "regs", "leader"), "picked")
        self.sets = self.keep(self.shingle_sets(picked), "sets")

        # First round: each class with the least leader of its buckets.
        pairs = picked.filter("nid <> leader").select(F.col("nid").alias("a"), F.col("leader").alias("b"))
        seen = self.keep(self.verified(pairs, picked, "first"), "seen-1")
        # Second: the leaders of buckets that hold several components.
        labels = self.labels(seen, picked, "one")
        open_members = self.open(members, labels)
        pairs = open_members.filter("label <> leader_label").select(F.col("nid").alias("a"), F.col("leader").alias("b")).distinct()
        pairs = pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")
        more = self.keep(self.verified(pairs, picked, "second"), "seen-2")
        seen = seen.unionByName(more)
        # Third: what remains in buckets of several components, by an exact prefix-filtered join.
        labels = self.labels(seen, picked, "two")
        rest = self.several(self.open(members, labels)).select("nid", "label").distinct()
        rest = self.keep(rest.join(picked.select("nid", "n"), "nid"), "rest")
        pairs = self.prefix_pairs(rest).join(seen.select("a", "b"), ["a", "b"], "left_anti")
        last = self.keep(self.exact(self.keep(pairs, "likely-third")), "seen-3")
        labels = self.labels(seen.unionByName(last), picked, "three")

        least = labels.join(nodes.select("nid", "least"), "nid")
        roots = least.groupBy("label").agg(F.min("least").alias("component_id"))
        linked = least.join(roots, "label").select("nid", "label", "component_id")
        of_class = nodes.select("sig", "nid", "least").join(linked, "nid", "left")
        of_class = of_class.select("sig", "nid", "least", F.coalesce("label", "nid").alias("label"), F.coalesce("component_id", "least").alias("component_id"))
        of_class = self.keep(of_class, "classes")
        discarded(self.spark, self.folder, *[name for name in self.made if name not in ("sketched", "classes")])
        return sketched.select("doc_id", "h", "n", "sig"), of_class

    def prefix_pairs(self, rest: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes with different labels that may be similar, by prefix and position.

        A set's shingles are ordered by rarity among these classes; those that only one set has come first and can't be
        shared, so they only shift positions. Similar sets share a shingle early in both: from the first one they share on, each
        must still have room for the overlap they need. With x the smaller set, a shingle at place i of x allows partners of at most
        `reach` elements, and one at place i of y partners of at most its `reach`; a row that allows none is dropped. So texts that have a passage in common
        and too much of their own, which would all meet at that passage's shingles, don't meet at all. What is left meets by shingle and by
        bucket of sizes (buckets grow by a sixteenth): x is in one, y looks in those it allows. For each shingle and bucket, classes outside its commonest
        label meet the others; those inside never meet.
        """
        explode = self.sets.join(rest.select("nid"), "nid", "left_semi").select("nid", "elements").mapInArrow(released(_elements), "nid long, token long")
        tokens = self.keep(explode, "tokens")
        n = tokens.count()
        shared = self.keep(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
        known = self.keep(hot_join(tokens, shared, "token", "nid", n), "tokens-shared")
        own = Window.partitionBy("nid")
        order = F.row_number().over(own.orderBy("df", "token")) - 1
        placed = known.select("nid", "token", order.alias("k"), F.count("*").over(own).alias("m"))
        placed = placed.join(rest, "nid").withColumn("i", F.col("n") - F.col("m") + F.col("k"))
        reach = F.floor(((F.col("n") - F.col("i")) * (100 + self.percent) - self.percent * F.col("n")) / self.percent)
        least = F.floor((self.percent * F.col("n") + 99) / 100)
        prefix = self.keep(placed.withColumn("reach", reach).filter(F.col("reach") >= least).select("token", "nid", "label", "n", "reach"), "prefix")
        bucket = lambda size: F.floor(F.log(size) / F.log(F.lit(17 / 16))).cast("int")
        x = prefix.filter("reach >= n").withColumn("bucket", bucket(F.col("n")))
        span = F.sequence(bucket(least), bucket(F.least("n", "reach")))
        y = prefix.withColumn("bucket", F.explode(span))
        x, y = (df.select(F.xxhash64("token", "bucket").alias("at"), *[F.col(c).alias(f"{side}_{c}") for c in ("token", "nid", "label", "n", "reach")]) for side, df in (("x", x), ("y", y)))
        x, y = self.keep(x, "prefix-x"), self.keep(y, "prefix-y")
        # Where all of a bucket have one label nothing meets; else the smaller side holds no class of the commonest one.
        counts = x.select("at", F.col("x_label").alias("label")).unionByName(y.select("at", F.col("y_label").alias("label"))).groupBy("at", "label").agg(F.count("*").alias("c"))
        main = counts.groupBy("at").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("labels")).filter("labels > 1")
        main = self.keep(main.select("at", "main"), "main")
        x = self.keep(hot_join(x, main, "at", "x_nid", x.count()), "meeting-x")
        y = self.keep(hot_join(y, main, "at", "y_nid", y.count()), "meeting-y")
        ordered = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_nid") < F.col("y_nid")))
        fits = (F.col("x_token") == F.col("y_token")) & ordered & (F.col("y_n") <= F.col("x_reach")) & (F.col("x_n") <= F.col("y_reach")) & self.near_sizes("x_n", "y_n")
        # Two halves: x outside the main label with any y of another, and x of the main label with y outside it.
        outside = x.filter("x_label <> main").drop("main").join(y.drop("main"), "at").filter(fits & (F.col("x_label") != F.col("y_label")))
        inside = x.filter("x_label = main").drop("main").join(y.filter("y_label <> main").drop("main"), "at").filter(fits)
        pair = [F.greatest("x_nid", "y_nid").alias("a"), F.least("x_nid", "y_nid").alias("b")]
        return outside.select(*pair).unionByName(inside.select(*pair)).distinct()

    def shingle_sets(self, picked: DataFrame) -> DataFrame:
        """nid and set of each picked class, from its least document's text.

        A Bloom filter of fixed size spares the other texts; the join that follows is exact.
        """
        spot = F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS))
        chunks = (
            picked.select(F.pmod(F.xxhash64(F.col("least")), F.lit(BLOOM_BITS)).alias("spot"))
            .groupBy(F.bitmap_bucket_number("spot").alias("chunk"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
            .collect()
        )
        filled = np.zeros((BLOOM_BITS // 32768 + 2, 4096), np.uint8)  # at most a fixed number of 4 kB rows
        for chunk, bits in chunks:
            filled[chunk] = np.frombuffer(bytes(bits), np.uint8)
        shared, size = self.spark.sparkContext.broadcast(filled), self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                bucket, place = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
                there = (shared.value[bucket, place // 8] >> (place % 8).astype(np.uint8)) & 1
                part = batch.filter(pa.array(there.astype(bool)))
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["least", "sig", "elements"]
                )

        base = self.docs.select("doc_id", "text", F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("place"))
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        sets = base.mapInArrow(released(run), f"least {kind}, sig binary, elements binary")
        wanted = picked.select("nid", "sig", "least")
        joined = sets.join(wanted, (sets["sig"] == wanted["sig"]) & sets["least"].eqNullSafe(wanted["least"])).select("nid", "elements")
        return joined.dropDuplicates(["nid"])

    def verified(self, pairs: DataFrame, picked: DataFrame, name: str) -> DataFrame:
        """a, b, common and total of the pairs that may be similar by size and by estimate."""
        pairs = self.keep(pairs, f"pairs-{name}")
        side = lambda s, r: picked.select(F.col("nid").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(r))
        sized = self.with_sides(pairs, side("a", "ra"), side("b", "rb")).filter(self.near_sizes("na", "nb"))
        likely = sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(released(partial(_estimate, floor_of(self.percent))), "a long, b long")
        return self.exact(self.keep(likely, f"likely-{name}"))

    def with_sides(self, pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs (a, b), stored, with the columns that `a` and `b` have for each. A leader with many pairs is dealt out."""
        n = pairs.count()
        if n <= 20_000:
            return pairs.join(a, "a").join(b, "b")
        # The wide columns of one side ride along only after both sides are dealt, so no task holds more than its share of either.
        hot_a, hot_b = weighed(pairs, "a", n), weighed(pairs, "b", n)
        many = F.coalesce("pieces", F.lit(1))
        dealt = pairs
        for side, other, hot in (("a", "b", hot_a), ("b", "a", hot_b)):
            dealt = dealt.join(F.broadcast(hot), side, "left").withColumn(f"at_{side}", F.pmod(F.xxhash64(other), many).cast("int")).drop("pieces")
        for side, hot, wide in (("a", hot_a, a), ("b", hot_b, b)):
            copies = wide.join(F.broadcast(hot), side, "left").withColumn(f"at_{side}", F.explode(F.sequence(F.lit(0), many - 1))).drop("pieces")
            dealt = dealt.join(copies, [side, f"at_{side}"])
        return dealt.drop("at_a", "at_b")

    def exact(self, likely: DataFrame) -> DataFrame:
        """a, b, common and total of pairs (a, b), stored, from the full sets."""
        sets = self.sets
        if likely.count() <= 200_000:  # 16 bytes each: small enough to send the ids to the sets
            ids = likely.select(F.col("a").alias("nid")).union(likely.select("b")).distinct()
            sets = sets.join(F.broadcast(ids), "nid", "left_semi")
        side = lambda s: sets.select(F.col("nid").alias(s), F.col("elements").alias(f"s{s}"))
        both = self.with_sides(likely, side("a"), side("b"))
        return both.select("a", "b", "sa", "sb").mapInArrow(released(_verify), "a long, b long, common long, total long")

    def labels(self, seen: DataFrame, picked: DataFrame, name: str) -> DataFrame:
        """nid and label of all picked classes."""
        links = seen.filter(100 * F.col("common") >= self.percent * F.col("total"))
        found = components(links, self.folder, name)
        return self.keep(
            picked.select("nid").join(found.withColumnRenamed("node", "nid"), "nid", "left").select("nid", F.coalesce("label", "nid").alias("label")), f"labels-{name}"
        )

    def open(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members with their label and their leader's."""
        of_leader = labels.select(F.col("nid").alias("leader"), F.col("label").alias("leader_label"))
        return members.join(labels, "nid").join(of_leader, "leader")

    def several(self, members: DataFrame) -> DataFrame:
        """Members of buckets with more than one label."""
        mixed = members.filter("label <> leader_label").select("key").distinct()
        return members.join(mixed, "key", "left_semi")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of each row of `docs`.

    Two texts are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id of all that links reach. Texts with fewer words than a shingle
    have one for the whole; null texts and texts without words have none and are linked with
    nothing. Repeated rows are equal texts; a null id is no component's name unless alone, and isn't kept. An
    empty table gives no rows; other columns are ignored.
    """
    rows, classes = NearDuplicates(docs, shingle, percent).run()
    out = rows.join(classes.select("sig", "component_id"), "sig", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each group, that of the least doc_id, and all rows without words.

    Where several rows share that id, the one with the least text hash stays, and of rows equal in
    both one. All columns stay as they are, whatever they are called. Null and empty texts are all kept, and an empty
    table gives no rows.
    """
    rows, classes = NearDuplicates(docs, shingle, percent).run()
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), "least", "nid")).alias("best")).select(F.col("best.nid").alias("nid"))
    best = classes.join(best, "nid", "left_semi").select("sig", "least")
    worded = rows.filter(F.col("n") > 0)
    of_best = worded.join(best, "sig").filter(F.col("doc_id").eqNullSafe(F.col("least")))
    stay = of_best.groupBy("sig", F.col("doc_id").alias("stay_id")).agg(F.min("h").alias("stay_h"))
    marked = worded.join(stay, "sig", "left").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("stay_id")) & F.col("h").eqNullSafe(F.col("stay_h")))
    marked = marked.withColumn("stays", F.coalesce("stays", F.lit(False)))
    gone_id, gone_h = unlike(docs.columns, "gone_id", "gone_h")
    gone = stored(marked.filter(~F.col("stays")).select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)).distinct(), scratch(docs.sparkSession), "gone")
    few = gone.count() <= 200_000  # 16 bytes each
    text = F.xxhash64(F.col("text").cast("string"))
    left = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (text == F.col(gone_h)), "left_anti")
    if marked.filter("stays").groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        return left
    empty = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return left.filter(~empty).dropDuplicates(["doc_id", "text"]).unionByName(left.filter(empty))
