"""Each operator against brute force on hard cases, and on an empty table."""

import base64
import gzip
import math
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucidoc.llm import common, decontaminate, encoding, hilbert, near_dup, packing, pii, quality_model, quality_rules, queries, secret_scan, token_files, word_pieces
from lucidoc.llm.encoding import vocabulary

from . import brute

FILE = vocabulary("word_bpe_49k.json")


def bag(rows):
    return Counter(repr(tuple(r)) for r in rows)


@pytest.fixture(scope="module")
def rows():
    return brute.hard_rows()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


# 1 -----------------------------------------------------------------------------


def greedy(word, first, further, most=None):
    i = n = 0
    most = most or max(map(len, first | further))
    while i < len(word):
        j = next((j for j in range(min(len(word), i + most), i, -1) if word[i:j] in (further if i else first)), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


pieces = st.sets(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(pieces, pieces, st.lists(st.text("abc", max_size=12), max_size=8))
def test_automaton_counts_greedy_pieces(first, further, words):
    match = word_pieces.LongestMatch(first, further)
    assert [match.count(w) for w in words] == [greedy(w, first, further) for w in words]


def test_token_counts(spark, rows):
    counter = word_pieces.WordPieceCounter(FILE, remember=5)
    import json

    with open(FILE) as f:
        known = {w[:-4] + word_pieces.END if w.endswith("</w>") else w for w in json.load(f)["model"]["vocab"]}
    most = max(map(len, known))

    def slow(text):
        words = [w for c in (text or "").split() for w in word_pieces.PRE_TOKEN.findall(counter.normal(c).lower())]
        return len(words), sum(greedy(w.encode().decode("latin-1").translate(counter.shown) + word_pieces.END, known, known, most) for w in words)

    long = [*rows, (-20, "ab" * 4000 + " é" * 900), (-21, "supercalifragilistic" * 700)]
    got = word_pieces.token_counts(brute.frame(spark, long), FILE).collect()
    assert bag(got) == bag((d, *slow(t)) for d, t in long)


# 2 -----------------------------------------------------------------------------


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 1), (1, 3)])
def test_curve_visits_neighbours(spark, dimensions, bits):
    import itertools

    cells = spark.createDataFrame([(list(c),) for c in itertools.product(range(1 << bits), repeat=dimensions)], "cell array<int>")
    path = [r.cell for r in cells.select("cell", hilbert.curve_index(F.col("cell"), dimensions, bits).alias("h")).orderBy("h").collect()]
    assert len(path) == 1 << bits * dimensions
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(path, path[1:]))


def test_shards(spark, rows):
    got = hilbert.assign(brute.frame(spark, rows)).collect()
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
    assert bag((r.doc_id, r["size"], r.text_crc32) for r in got) == bag(want)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 40
        slots[r.shard].append((r.slot, r.curve))
    counts = [len(slots[k]) for k in range(40)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)
    # Shard and slot by rank, and each group of equal texts in one run.
    n = len(rows)
    assert [(r.shard, r.slot) for r in ordered] == [(k * 40 // n, k - -(-(k * 40 // n) * n // 40)) for k in range(n)]
    texts = [(r["size"], r.text_crc32) for r in ordered]
    assert sum(a != b for a, b in zip(texts, texts[1:])) + 1 == len(set(texts))


def test_copies_share_a_shard(spark):
    rows = [(i, f"text number {i % 40}") for i in range(400)]
    docs = brute.frame(spark, rows)
    got = hilbert.assign(docs, 20).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.doc_id % 40].add(r.shard)
    assert all(len(v) == 1 for v in shards.values()) and len({r.shard for r in got}) == 20


def hilbert_point(index, dimensions, bits):
    """The cell of a curve index, by the published inverse: deal out the bits, undo the Gray code, then rotate from the least bit up."""
    x = [0] * dimensions
    for k in range(bits * dimensions):
        bit = index >> (bits * dimensions - 1 - k) & 1
        x[k % dimensions] = x[k % dimensions] << 1 | bit
    t = x[-1] >> 1
    for i in range(dimensions - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    q = 2
    while q < 1 << bits:
        for i in range(dimensions - 1, -1, -1):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q <<= 1
    return x


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 4)])
def test_curve_index_is_the_inverse_of_the_published_one(spark, dimensions, bits):
    rows = [(i, hilbert_point(i, dimensions, bits)) for i in range(1 << dimensions * bits)]
    cells = spark.createDataFrame(rows, "i long, cell array<int>")
    assert cells.filter(hilbert.curve_index(F.col("cell"), dimensions, bits) != F.col("i")).count() == 0


def test_cells_are_quantiles(spark):
    rows = spark.createDataFrame([(i, f"name{i:03}", None if i % 8 == 0 else i // 8) for i in range(64)], "size long, d0 string, d1 int")
    cells = {r["size"]: r.cell for r in hilbert.quantised(rows, ("size", "d0", "d1"), 2).collect()}
    for k in (0, 1):
        column = [cells[i][k] for i in range(64)]
        assert column == sorted(column) and set(column) == {1, 2, 3} and all(20 <= column.count(c) <= 23 for c in (1, 2, 3))
    assert all((cells[i][2] == 0) == (i % 8 == 0) for i in range(64))


def test_shards_as_files(spark, rows, tmp_path):
    docs = brute.frame(spark, rows)
    assert hilbert.write(docs, str(tmp_path / "shards"), 12) == ["shard_", "stray", "slot"]
    there = spark.read.parquet(str(tmp_path / "shards"))
    assert bag(there.select(docs.columns).collect()) == bag(docs.collect())
    want = hilbert.assign(docs, 12).select("doc_id", "shard", "slot").collect()
    assert bag(there.select("doc_id", "shard_", "slot").collect()) == bag(want)
    held = defaultdict(list)
    for r in there.collect():
        held[r["shard_"], r.stray].append(r.source)
    assert any(stray for _, stray in held)
    found = {r.value: r for r in hilbert.pruning(there, "shard_").collect() if r.dimension == "source"}
    assert set(found) == {f"src{i}" for i in range(3)}
    for value, r in found.items():
        met = [k for k, v in held.items() if min(v) <= value <= max(v)]
        assert r.shards_read == pytest.approx(len({k for k, stray in met if not stray}) / 12) and r.rows_read == pytest.approx(sum(len(held[k]) for k in met) / len(rows))


# 3 -----------------------------------------------------------------------------


def test_quality_model(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in queries.op3_quality_model(spark, sf).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [g.score for g, q in held if q], [g.score for g, q in held if not q]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97
    assert all(g.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and g.predicted == (g.score >= 0.3) for d, g in got.items())


def test_quality_model_on_hard_rows(spark, rows):
    labels = spark.createDataFrame([(d, None if i % 5 == 0 else i % 2) for i, (d, _) in enumerate(rows)], "doc_id long, quality int")
    weights = quality_model.train(brute.frame(spark, rows), labels, sample_rows=30, buckets=1 << 10)
    again = quality_model.train(brute.frame(spark, rows).repartition(7), labels, sample_rows=30, buckets=1 << 10)
    assert (weights == again).all() and len(weights) == (1 << 10) + 1
    got = quality_model.scored(brute.frame(spark, rows), weights).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows) and all(0 <= r.score <= 1 for r in got)
    none = quality_model.train(brute.frame(spark, rows), labels.limit(0), buckets=1 << 10)
    assert not none.any() and quality_model.score(none, None) == 0.5


def slow_ftrl(data, buckets, epochs, alpha=0.5, beta=0.2, l1=0.02, l2=0.5):
    """The published update, a coordinate at a time."""
    z, n = [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for text, y in data:
            tokens = quality_model.TOKENS.findall(text)
            code = lambda t: zlib.crc32(t.encode()) << 32 | zlib.crc32(t.encode()[::-1] + b"#")
            mask = (1 << 64) - 1

            def mixed(a, b):
                x = (a * 0x9E3779B97F4A7C15 & mask) ^ b
                return (x ^ x >> 29) * 0x9E3779B97F4A7C15 & mask

            h = [code(t) for t in tokens]
            pairs = [mixed(a, b) for a, b in zip(h, h[1:])]
            triples = Counter(mixed(a, b) for a, b in zip(pairs, h[2:]))
            places = [x * 0x9E3779B97F4A7C15 & mask for x in h] + pairs + [0] * sum(c - 1 for c in triples.values())
            counts = Counter(x >> 64 - buckets.bit_length() + 1 for x in places)
            x = {i: np.float64(quality_model.SCALE * c / max(1, len(places))) for i, c in counts.items()} | {buckets: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - step * w[i]
                n[i] += g * g
    return [weight(i) for i in range(buckets + 1)]


def test_ftrl_equals_the_published_update():
    import random

    r = random.Random(4)
    data = [(" ".join(r.choice(["good", "text", "bad", "!!", "a, b", "é"]) for _ in range(r.randint(0, 30))), r.randint(0, 1)) for _ in range(60)]
    buckets = 1 << 6
    examples = [(*quality_model.example(quality_model.features(t, buckets), buckets), y) for t, y in data]
    got, want = quality_model.fit(examples, buckets, 3), slow_ftrl(data, buckets, 3)
    assert np.allclose(got, want, atol=1e-5) and np.abs(got).max() > 0.1


def test_ftrl_separates_two_words():
    data = [(*quality_model.example(quality_model.features(t, 1 << 12), 1 << 12), y) for t, y in [("good fine text", 1), ("bad !! text !!", 0)] * 20]
    weights = quality_model.fit(data, 1 << 12)
    assert quality_model.score(weights, "fine good") > 0.5 > quality_model.score(weights, "!! bad !!")


# 4 -----------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=700), st.integers(0, 5))
def test_blocks_round_trip(ids, first):
    x = np.array(ids, np.uint32)
    payload = token_files.encode_segment(x)
    assert (token_files.decode_segment(payload) == x).all()
    assert (token_files.decode_segment(payload, slice(first, first + 2)) == x[first * 128 : first * 128 + 256]).all()


def test_token_files(spark, rows, library, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write(brute.frame(spark, rows), FILE, path, segment=2000)
    got = token_files.read(spark, path, with_ids=True).collect()
    ids = {(d, t): ids_of(library, t, 1) for d, t in rows}
    hashes = {r.text: r.h for r in brute.frame(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want, at = [], 0
    for d, t in ordered:
        own = ids[d, t]
        want.append((d, at, len(own), brute.crc(own), own))
        at += len(own)
    assert bag((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in got) == bag(want)


texts = st.text(st.one_of(st.sampled_from("abzABZ .,'\n\t-é0123ÀßΣ\x00\x1c京"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=4))
def test_chunks_encode_as_the_library_does(batch):
    coder = encoding.encoder(FILE)
    assert coder.splits
    assert coder.encode([*batch, None, "a<|endoftext|> b", "DON'T stop."]) == [coder._whole(t or "") for t in [*batch, None, "a<|endoftext|> b", "DON'T stop."]]


def test_files_without_the_property_are_encoded_whole():
    coder = encoding.ChunkEncoder(vocabulary("byte_bpe_50k.json"))
    assert not coder.splits and coder.encode(["a b c", None]) == [coder._whole("a b c"), b""]


# 5 -----------------------------------------------------------------------------


def test_near_duplicates(spark, rows):
    got = near_dup.near_duplicates(brute.frame(spark, rows), 4, 80).collect()
    want = [(d, n, c if n else d, d is not None and (not n or d == c)) for (d, _), (n, c) in zip(rows, brute.components(rows))]
    assert bag(got) == bag(want)


def test_near_duplicates_in_a_large_group(spark):
    """Copies of one text with edits of their own: links are neither all nor none."""
    import random

    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(150):
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(150)] = f"e{r.randint(0, 10**6)}"
        rows.append((d, " ".join(copy)))
    got = near_dup.near_duplicates(brute.frame(spark, rows), 4, 80).collect()
    want = [(d, n, c, d == c) for (d, _), (n, c) in zip(rows, brute.components(rows))]
    assert bag(got) == bag(want) and 1 < sum(w[3] for w in want) < 150


def test_components_of_a_long_chain_in_any_order(spark, tmp_path, monkeypatch):
    import random

    order = list(range(800))
    random.Random(3).shuffle(order)
    links = [(a + 1000 * part, b + 1000 * part) for part in (0, 1) for a, b in zip(order, order[1:])]
    names, store = [], near_dup.stored

    def counted(df, folder, name, *more):
        names.append(name)
        assert len(names) <= 45
        return store(df, folder, name, *more)

    monkeypatch.setattr(near_dup, "stored", counted)
    got = near_dup.components(spark.createDataFrame(links, "a long, b long"), str(tmp_path), "chain").collect()
    assert sorted(map(tuple, got)) == [(n + 1000 * part, 1000 * part) for part in (0, 1) for n in range(800)]


def test_texts_with_a_long_passage_in_common_do_not_meet(spark, monkeypatch):
    """170 shared and 26 own words: similarity is under the threshold, and no pairs are made, however many texts there are."""
    made = []
    monkeypatch.setattr(near_dup, "discarded", lambda spark, folder, *names: made.append(folder))
    for n in (100, 300):
        passage = " ".join(f"w{i}" for i in range(170))
        rows = [(d, passage + " " + " ".join(f"o{d}x{i}" for i in range(26))) for d in range(n)]
        got = near_dup.near_duplicates(brute.documents(spark, rows), 4, 80).collect()
        assert all(r.kept and r.n_shingles == 193 for r in got)
        folder = next(f for f in reversed(made) if f)
        x, y = (spark.read.parquet(f"{folder}/meeting-{side}").groupBy("at").count() for side in "xy")
        met = x.join(y.withColumnRenamed("count", "other"), "at").agg(F.sum(F.col("count") * F.col("other"))).head()[0] or 0
        assert met <= 10 * n


def test_hot_keys_are_dealt_out(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("pieces"))
    right = spark.range(5000).filter("id % 2 = 1").select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert [tuple(r) for r in common.weighed(left, "k", 30_000).collect()] == [(7, 11)]
    for how in ("inner", "left"):
        got = common.hot_join(left, right, "k", "pieces", 30_000, how)
        assert got.columns == ["k", "pieces", "v"] and bag(got.collect()) == bag(left.join(right, "k", how).collect())


def test_estimates_and_merging():
    r = np.random.default_rng(1)
    for j in (0.3, 0.8):
        common, own = int(600 * j), int(600 * (1 - j) / 2)
        pool = r.integers(0, 2**63, common + 2 * own, dtype=np.uint64)
        a, b = pool[: common + own], np.concatenate([pool[:common], pool[common + own :]])
        x, y = near_dup.sketch(a), near_dup.sketch(b)
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        est = near_dup.estimated(x[None], y[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(est - true) < 6 * math.sqrt(true * (1 - true) / near_dup.REGISTERS)
        assert (np.maximum(x, y) == near_dup.sketch(pool)).all()  # sketches of parts merge into the whole's


# 6 -----------------------------------------------------------------------------


def test_secrets(spark, rows):
    key = "a" * 33
    more = [(500, f"token = \"{key}\" AKIA{'A1' * 9} password: short secret=alsolongenough"), (501, "token: secret: abcdefghijk"), (502, "AKIAAKIA" + "Z" * 20), (503, "api_key='0123456789abcdef0123456789abcdef'"), (504, "Ω TOKEN=" + "x" * 20000)]
    every = rows + more
    got = secret_scan.digest(brute.frame(spark, every)).collect()
    want = []
    for d, t in every:
        base = brute.secrets(t)
        kinds = Counter(s.split(":")[0] for s in base)
        want.append((d, kinds["assign"], kinds["access"], kinds["hex"], brute.sha(base)))
    assert bag(tuple(r)[:5] for r in got) == bag(want)
    assert all(r.spans.split(",") if r.spans else True for r in got)


P = "password=hunter2hunter2"
LAYERED = [
    base64.b64encode(P.encode()).decode(),
    base64.b64encode(gzip.compress(P.encode())).decode(),
    base64.b64encode(zlib.compress(P.encode())).decode(),
    urllib.parse.quote(urllib.parse.quote('password = "hunter2hunter2"')),
    "".join(f"\\u{ord(c):04x}" for c in P),
    urllib.parse.quote(base64.b64encode(base64.b64encode(P.encode())).decode()),
]


@pytest.mark.parametrize("hidden", LAYERED)
def test_layers_are_unwrapped(hidden):
    text = f"Ω go {hidden} end"
    found = secret_scan.scan(text)
    assert found and all(5 <= a < b <= 5 + len(hidden) for a, _, b in found)
    assert "hunter2" not in secret_scan.mask(text) and secret_scan.mask(text).endswith(" end")


def b64(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize(
    "data",
    [
        gzip.compress(gzip.compress(P.encode())),
        gzip.compress(zlib.compress(P.encode())),
        zlib.compress(gzip.compress(zlib.compress(b64(P.encode()).encode()))),
        P.encode("utf-16"),
        b"\xff" + P.encode("utf-16-be"),
        gzip.compress(P.encode("utf-16-le")),
        b"\x00\x01" + P.encode() + b"\xff\xfe\x80",
        b"x\x9c " + P.encode(),
    ],
)
def test_bytes_are_inflated_to_the_end_and_read_whatever_they_hold(data):
    assert "assign" in {kind.split(".")[-1] for _, kind, _ in secret_scan.scan(f"go {b64(data)} end")}
    assert secret_scan.mask(f"go {b64(data)} end") == "go [SECRET] end"


MIME = base64.encodebytes(f"{'x' * 50} {P} {'y' * 90}".encode()).decode().rstrip()


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ('{"pass\\u0077ord": "hunter2hunter2"}', '{"[SECRET]"}'),
        ('go token%3D"abcdefgh12" end', 'go [SECRET]" end'),
        ("password: \\u0068unter2hunter2 end", "[SECRET] end"),
        ('"{\\"token\\": \\"abcdefgh12\\"}"', '"{\\"[SECRET]\\"}"'),
        ("%E2%82 é%C3%A9 password%3Dhunter2hunter2%20end", "%E2%82 é%C3%A9 [SECRET]%20end"),
        (f"go: {MIME} end", "go: [SECRET]" + MIME[MIME.index("\n", 80) :] + " end"),
    ],
)
def test_escapes_are_read_with_what_is_around_them(text, masked):
    assert secret_scan.mask(text) == masked


def test_wrapped_base64_is_read_over_its_lines():
    noise = "".join(f"{i * i:x} " for i in range(99))
    for data in (gzip.compress(f"{noise} {P}".encode()), f"{'x' * 50} {P}".encode(), f"{'x' * 50} {P}".encode() * 3):
        for wrapped in (base64.encodebytes(data).decode(), base64.encodebytes(data).decode().replace("\n", "\r\n  ")):
            assert any(kind.endswith("assign") for _, kind, _ in secret_scan.scan(f"go: {wrapped}\n end"))


@pytest.mark.parametrize("front", ["/files/", "key_", "id-", "a/b/c/", "x" * 21 + "_", "/", "below\n"])
@pytest.mark.parametrize("data", [P.encode(), f"é {P} é".encode(), P.encode("utf-16-le"), gzip.compress(P.encode()), zlib.compress(P.encode()), gzip.compress(zlib.compress(P.encode()))])
def test_what_stands_before_base64_does_not_hide_it(front, data):
    hidden = b64(data).rstrip("=")
    masked = secret_scan.mask(f"go {front}{hidden} end")
    assert "[SECRET]" in masked and hidden not in masked and masked.endswith(" end")


def test_joined_base64_is_read_part_by_part():
    text = f"/{b64(b'a first text').rstrip('=')}/{b64(P.encode()).rstrip('=')}/x"
    assert any(kind == "base64.assign" for _, kind, _ in secret_scan.scan(text))


def small_window(data):
    engine = zlib.compressobj(wbits=9)
    return engine.compress(data) + engine.flush()


@pytest.mark.parametrize(
    "data",
    [
        gzip.compress("é, ".encode() * 4_000_000 + P.encode()),
        gzip.compress(zlib.compress(b"-, " * 4_000_000 + P.encode(), 0)),
        gzip.compress(b"nothing, ") + gzip.compress(P.encode()),
        gzip.compress(b"pass") + b"\0" * 9 + gzip.compress(P[4:].encode()),
        small_window(P.encode()),
        gzip.compress(P.encode())[:-5] + b"wrong",
        gzip.compress(("é" * 6_000_000 + P).encode("utf-16-le")),
    ],
    ids=["long", "stored", "members", "padded", "window", "checksum", "wide"],
)
def test_streams_are_read_to_their_end(data):
    assert secret_scan.mask(f"go {b64(data)} end") == "go [SECRET] end"


def test_pieces_of_a_stream_are_small_and_part_nothing():
    long = "".join(f"{i}, {P}{i} " for i in range(200_000))
    pieces = [t for c, t in secret_scan.contents(gzip.compress(long.encode())) if c == "packed."]
    assert "".join(pieces) == long and max(map(len, pieces)) < 2 * secret_scan.CHUNK
    assert sum(len(secret_scan.finds(t)) for t in pieces) == 200_000


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab=%4\\u0A:/+Z token"), max_size=120))
def test_any_text_can_be_scanned(text):
    spans = secret_scan.scan(text)
    assert all(0 <= a < b <= len(text) for a, _, b in spans)
    base = [f"{k}:{a}:{b}" for a, k, b in spans if k in secret_scan.KINDS]
    assert base == brute.secrets(text)


def test_masking_keeps_rows_and_columns(spark, rows):
    docs = brute.documents(spark, rows + [(600, "a token=abcdefghijkl b")])
    got = secret_scan.masked(docs)
    assert got.schema == docs.schema and got.count() == len(rows) + 1
    assert [(r.text, r.n_chars) for r in got.filter("doc_id = 600").collect()] == [("a [SECRET] b", 12)]


# 7 -----------------------------------------------------------------------------


def test_contamination(spark, rows, monkeypatch):
    w = [f"q{i}" for i in range(40)]
    items = [(1, " ".join(w[:20])), (2, " ".join(w[10:30])), (2, " ".join(w[10:30])), (3, "tiny item"), (4, "solo"), (5, None), (6, "!!"), (None, " ".join(w[25:40])), (7, "A B c d e f g h i j k l m"), (8, "É ß x"), (9, " ".join(w[:20]))]
    more = [(700, " ".join(w)), (701, "x " * 500 + " ".join(w[3:16])), (702, " ".join(w[:12])), (703, "Tiny, ITEM!"), (704, "solo"), (705, "a b c d e f g h i j k l m " * 3), (706, "é ß x"), (707, "É ß X"), (708, " ".join(w[5:38])), (708, " ".join(w[5:38]))]
    every = rows + more
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, pos int")
    want = bag((d, *(x if i != 2 else x for i, x in enumerate(brute.contamination(t, items)))) for d, t in every)
    got = decontaminate.contamination(brute.frame(spark, every), table).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    assert bag(got.collect()) == want
    monkeypatch.setattr(decontaminate, "BLOCK", 5)  # several passes
    got = decontaminate.contamination(brute.frame(spark, every), table).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    assert bag(got.collect()) == want
    docs = brute.frame(spark, every).withColumn("bad_1", F.lit(1)).withColumn("BAD_2", F.lit(2))
    left = decontaminate.decontaminated(docs, table)
    assert left.schema == docs.schema
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, t in every if not brute.contamination(t, items)[3])


LONG = " ".join(f"q{i}" for i in range(20))


@pytest.mark.parametrize(
    "items",
    [[(1, LONG), (2, "a b c"), (3, "a b c d e")], [(1, "tiny item"), (2, "solo"), (3, "a b"), (None, "b c")], [(1, LONG), (2, "solo"), (3, "a b c d"), (4, "a b c x"), (5, LONG + " more")]],
    ids=["three words or more", "fewer", "mixed"],
)
@pytest.mark.parametrize("block", [decontaminate.BLOCK, 2])
def test_contamination_gives_each_row_once(spark, monkeypatch, items, block):
    """Documents that begin and end with windows, hold them over one another, or are repeated."""
    rows = [(1, LONG), (2, LONG), (2, LONG), (3, "a b c d"), (4, "x a b c"), (5, None), (6, ""), (7, LONG[:18]), (8, "a b"), (9, "solo tiny item solo"), (10, "a b a b c a b c x " * 9), (11, f"{LONG} {LONG} more")]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    got = decontaminate.contamination(brute.frame(spark, rows), table).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    assert bag(got.collect()) == bag((d, *brute.contamination(t, items)) for d, t in rows)


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_contamination_of_random_texts(spark, window):
    import random

    r = random.Random(window)
    made = lambda letters, most: " ".join(r.choice(letters) for _ in range(r.randint(0, most)))
    items, docs = [(i, made("ab", 9)) for i in range(4)], [(i, made("abcd", 30)) for i in range(80)]
    got = decontaminate.contamination(brute.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window)
    assert bag(got.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()) == bag((d, *brute.contamination(t, items, window)) for d, t in docs)


def test_documents_meet_prefixes_alone(spark):
    """Few of the benchmark's shingles are prefixes, and no join but with broadcast tables reads the documents."""
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(5)], "item_id long, text string")
    windows = decontaminate.benchmark_windows(items, 13)
    assert windows.count() == 5 * 48 and windows.select("h").distinct().count() < 5 * 58 / 3
    keyed = windows.withColumn("wid", F.lit(1)).withColumn("key", decontaminate.window_key(F.col("words")))
    prefixes = keyed.groupBy("h").agg(F.collect_set(F.struct("offset", "L")).alias("places"))
    found = decontaminate.occurrences(brute.frame(spark), prefixes, keyed, [3], True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in above and "SortMergeJoin" not in above and "Exchange hash" not in above


def test_contamination_without_a_benchmark(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(brute.frame(spark, rows), none).collect()
    assert len(got) == len(rows) and not any(r.contaminated or r.n_items for r in got)


def test_contamination_matches_sql(spark):
    from ..duck import both, connect

    sf = "/root/testdata/sf0.001"
    got, want = both(queries.op7_decontamination(spark, sf), queries.OP7, connect(sf))
    assert got == want


# 8 -----------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 150))
def test_differencing_fits_and_keeps_all(sizes, capacity):
    parts = packing.windows(sizes, capacity)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= capacity for p in parts)


def test_differencing_is_near_equal():
    # Published example: 8, 7, 6, 5, 4 in two ways differ by 2; in three ways sums are 8, 11, 11.
    sums = lambda n: sorted(sum((8, 7, 6, 5, 4)[i] for i in p) for p in packing.difference([8, 7, 6, 5, 4], n))
    assert sums(2) == [14, 16] and sums(3) == [8, 11, 11]


def test_packing(spark, rows, library):
    got = packing.pack(brute.frame(spark, rows), FILE, keep_ids=True).collect()
    whole = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.length > 0
        whole[r.sequence_id].append((r.offset, r.length))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    pieces = Counter(repr((r.doc_id, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens)) for r in got)
    want = Counter()
    for d, t in rows:
        ids = ids_of(library, t, 2)
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            want[repr((d, s, len(part), part, len(ids)))] += 1
    assert pieces == want
    sequences = packing.assembled(packing.pack(brute.frame(spark, rows), FILE, keep_ids=True)).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r.sequence_id].append((r.offset, bytes(r.ids)))
    assert bag((r.sequence_id, bytes(r.ids)) for r in sequences) == bag((k, b"".join(i for _, i in sorted(v))) for k, v in parts.items())
    # As few windows as the sums allow, or one more by each buffer of rests.
    assert len(parts) <= -(-sum(r.length for r in got) // 4096) + 3


def test_windows_rise_by_one_until_all_fit():
    for sizes in ([60, 60, 60], [100], [50, 50, 50, 50], [99, 2], []):
        least = next(k for k in range(len(sizes) + 2) if not sizes or k and max(sum(sizes[i] for i in p) for p in packing.difference(sizes, k)) <= 100)
        assert len(packing.windows(sizes, 100)) == least


# 9 -----------------------------------------------------------------------------


def test_quality_rules(spark, rows):
    more = [(800, ("same line here\n" * 40) + " ".join(f"v{i}" for i in range(60))), (801, " ".join(f"v{i} ###" for i in range(80))), (802, " ".join(f"v{i}!!" for i in range(80))), (803, " ".join(f"clean{i} word{i}" for i in range(80)))]
    every = rows + more
    got = quality_rules.measure(brute.frame(spark, every)).collect()
    assert bag(tuple(r)[:7] for r in got) == bag((d, *brute.quality(t)) for d, t in every)
    assert not any(r.kept and r.base_failed for r in got)
    kept = {r.doc_id: r.kept for r in got}
    assert [kept[d] for d in (800, 801, 802, 803)] == [False, False, False, True]
    decided = quality_rules.decide(brute.frame(spark, every)).collect()
    assert bag(decided) == bag((r.doc_id, r.kept) for r in got)
    docs = brute.documents(spark, every)
    assert bag(quality_rules.filtered(docs).select("doc_id").collect()) == bag((r.doc_id,) for r in got if r.kept)


def test_the_order_changes_no_verdict(rows):
    views = [quality_rules.TextView(t) for _, t in rows]
    names = list(quality_rules.RULES)
    assert [quality_rules.verdict(v, names) for v in views] == [quality_rules.verdict(v, names[::-1]) for v in views]


def test_the_cascade_stops_and_orders_by_rejection_per_cost(spark):
    calls = []

    def slow(view):
        calls.append(view.text)
        return sum(range(20_000)) < 0

    rules = {"slow": slow, "short": lambda v: v.n_words < 3}
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "a b c d") for i in range(40)], "doc_id long, text string")
    order = quality_rules.plan(docs, {"slow": lambda v: sum(range(20_000)) < 0, "short": lambda v: v.n_words < 3})
    assert order == ["short", "slow"]
    assert not quality_rules.verdict(quality_rules.TextView("a b"), order, rules) and not calls


def test_rules_are_judged_by_what_those_before_leave():
    """b rejects only what a rejects; c is dear unless a has made its measure."""
    measures = {"m": 5.0, "k": 1.0}
    row = lambda a, b, c: {"rejected": [a, b, c], "own": [0.1, 0.1, 0.1], "uses": [["m"], ["k"], ["m"]], "measures": measures}
    trials = [row(True, True, False)] * 6 + [row(True, False, False)] * 30 + [row(False, False, True)] * 4 + [row(False, False, False)] * 10
    assert quality_rules.ordered(trials, {"a": None, "b": None, "c": None}) == ["a", "c", "b"]


# 10 ----------------------------------------------------------------------------

PERSONAL = [
    "a@b.c_d@e.f x@y@z.com 1.2.3.4.5 300.1.1.1 +33 (0)1 23-45 67 8",
    "4111 1111 1111 1111, 4111-1111-1111-1112 " + "1 " * 3000,
    "é😀 a@b.co " * 500,
    "1" * 20000 + "+" * 300 + " a.b" * 300 + "@x.y",
    "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "0000255.1.1.1 00.0.0.0 256.1.1.1",
    "mail me: x.y%z@mail-1.example.com, or +1 (555) 123-4567; card 5500-0000-0000-0004",
]


def wide_texts():
    """(text, wide spans that are personal data) in many forms, and look-alikes that are none."""
    import random

    r = random.Random(8)
    n = lambda a, b: str(r.randint(a, b))
    rows = []
    for i in range(40):
        first, last, place = r.choice(pii.GIVEN_NAMES), r.choice(["Miller", "Schmidt", "Dupont", "García", "Okafor", "Novak"]), r.choice(pii.PLACES)
        email, phone = f"{first.lower()}{i} [at] mail{i} (dot) com", f"({n(200, 999)}) {n(200, 999)}-{n(1000, 9999)}"
        ssn, street = f"{n(100, 665)}-{n(10, 99)}-{n(1000, 9999)}", f"{n(1, 999)} Green {r.choice(['Street', 'Avenue', 'Road'])}"
        rows.append((f"Please write to {email} for more, or call {phone} today.", [email, phone]))
        rows.append((f"Her social security number is {ssn}, born in May.", [ssn]))
        rows.append((f"My name is {first} {last}, phone {phone}.", [f"{first} {last}", phone]))
        rows.append((f"They live at {street}, {place} now.", [street]))
        rows.append((f"Contact a{i}@b.org or +1 (555) {n(200, 999)}-{n(1000, 9999)}; server 10.0.{i}.7; card 4111 1111 1111 1111.", []))
        rows.append((f"See version 4.{n(300, 999)}.1.2, serial number {n(1000, 9999)}{n(1000, 9999)}{n(1000, 9999)}{n(10, 99)} and order 000-12-{n(1000, 9999)}.", []))
        rows.append((f"Plain words without anything, item {i} of {n(50, 90)}.", []))
    return rows


def test_personal_data(spark, rows):
    more = [t for t, _ in wide_texts()]
    every = rows + [(900 + i, t) for i, t in enumerate(PERSONAL + more)]
    got = pii.digest(brute.frame(spark, every)).collect()
    want = []
    for (d, t), spans in zip(every, brute.personal_spans([t for _, t in every])):
        base = brute.personal(t)
        assert set(base) <= set(spans)
        kinds = Counter(s.split(":")[0] for s in base)
        want.append((d, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], brute.sha(base), ",".join(spans), len(spans), bool(spans)))
    assert bag(got) == bag(want)


def test_wide_spans_are_found_and_look_alikes_left(spark):
    rows = wide_texts()
    got = {r.doc_id: r.spans for r in pii.digest(brute.frame(spark, [(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    hit = wrong = missed = 0
    for i, (text, planted) in enumerate(rows):
        base = set(brute.personal(text))
        added = {text[int(a) : int(b)] for s in got[i].split(",") if s and s not in base for _, a, b in [s.split(":")]}
        hit, wrong, missed = hit + len(added & set(planted)), wrong + len(added - set(planted)), missed + len(set(planted) - added)
    print("recall", hit / (hit + missed), "precision", hit / (hit + wrong))
    assert hit / (hit + missed) > 0.95 and hit / (hit + wrong) > 0.95


def test_reliabilities_are_found():
    """Votes drawn from known reliabilities, a third of the true candidates being known."""
    r = np.random.default_rng(2)
    rely = [(0.99, 0.03), (0.9, 0.2), (0.7, 0.4), (0.95, 0.5), (0.8, 0.3)]
    true = r.random(4000) < 0.6
    told = true & (r.random(4000) < 0.33)
    votes = np.array([[r.random() < (a if t else b) for a, b in rely] for t in true]).astype(int)
    counts, known = Counter(map(tuple, votes.tolist())), Counter(map(tuple, votes[told].tolist()))
    found, _, got = pii.estimate([("card", v, n, known[v]) for v, n in counts.items()])
    assert all(abs(got["card", i][0] - a) < 0.08 and abs(got["card", i][1] - b) < 0.12 for i, (a, b) in enumerate(rely))
    right = sum((found["card", tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), true)) / 4000
    assert right > 0.95


def test_data_outweigh_the_priors():
    """A labeler that says yes to most of what is false, against its prior."""
    counts = [("ip", (1, 1, -1, -1, 1), 200, 200), ("ip", (0, 1, -1, -1, 1), 150, 0), ("ip", (0, -1, -1, -1, 0), 50, 0)]
    found, share, rely = pii.estimate(counts)
    assert rely["ip", 4][1] > 0.7 and rely["ip", 0][1] < 0.1 and share["ip"] < 0.1 and found["ip", (0, 1, -1, -1, 1)] < 0.1


# All ---------------------------------------------------------------------------


def test_empty_tables(spark, tmp_path):
    none = brute.frame(spark, [])
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    results = [
        word_pieces.token_counts(none, FILE),
        hilbert.assign(none),
        quality_model.scored(none, quality_model.train(none, labels, buckets=64)),
        token_files.round_trip(none, FILE),
        near_dup.near_duplicates(none),
        secret_scan.digest(none),
        decontaminate.contamination(none, items),
        packing.pack(none, FILE),
        quality_rules.measure(none),
        pii.digest(none),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_stages_on_empty_and_hard_tables(spark, rows):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for docs in (brute.frame(spark, []), brute.frame(spark, rows).withColumn("bad_1", F.lit(1)).withColumn("gone_id", F.lit(2)).withColumn("ids", F.lit(3))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert k == 4 or out.schema == docs.schema
            assert out.count() <= (docs.count() if k < 4 else 10**6)
