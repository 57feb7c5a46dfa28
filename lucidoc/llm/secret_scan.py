"""Secret scans with a recursive decoding worklist.

Every layer of a text is scanned: the text itself, then what its URL-escaped, backslash-escaped,
base64 and compressed regions hold, and so on until no layer yields a new one. Bytes are inflated as long as they begin
like a compressed stream, and read with a character for each byte (and as UTF-16), so none are passed over. Decoded layers keep
a map to code points of the whole text, so a find inside them becomes a span of the text. Escapes are decoded over a whole
layer, base64 over line breaks and at every alignment. A find counts once, for the first layer that shows it.
A layer seen before (by digest, with its place) isn't decoded again, which ends cycles.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import io
import re
import tempfile
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_document, prepare, released

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: What any assignment holds; cheap to look for.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")

URL = re.compile("(?:%[0-9A-Fa-f]{2})+")
#: Runs of the alphabet, also over single line breaks (and the blanks that indent the next line).
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++[\x20\t]*+\r?\n[\x20\t]*+)++[A-Za-z0-9+/_-]++={0,2}")
LINE = re.compile("[A-Za-z0-9+/_-]+=*")
CHUNK = 1 << 18
#: No find and no escaped or base64 region holds such a character, so a layer may be cut after it.
APART = re.compile(r"[^A-Za-z0-9+/_.=:'\"%\\\s-]")


def finds(text: str) -> list[tuple[int, int, str]]:
    """Base finds of one layer as (start, kind number, end)."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


#: Text of ASCII characters of two bytes each, in either order; no find is shorter.
WIDE = (("utf-16-le", re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){8}")), ("utf-16-be", re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){8}")))


def readings(data: bytes) -> Iterator[tuple[str, str]]:
    """What the bytes say as text, as (coding, text): a character for each byte, and UTF-16 where it shows.

    All that is looked for is ASCII, which stands in such a reading as in UTF-8, whatever bytes are around it.
    """
    yield "", data.decode("latin-1")
    for coding, run in WIDE:
        for offset in sorted({m.start() % 2 for m in run.finditer(data)}):
            yield "utf16.", data[offset:].decode(coding, "replace")


def packed(head: bytes) -> bool:
    """Whether bytes begin like a gzip or a zlib stream (of any window, without a preset dictionary)."""
    if head[:2] == b"\x1f\x8b":
        return True
    return len(head) > 1 and head[0] & 15 == 8 and head[0] < 128 and not head[1] & 32 and (head[0] << 8 | head[1]) % 31 == 0


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a stream of gzip or zlib members inflates to, in chunks, as far as it is sound."""
    engine, fresh = zlib.decompressobj(47), True
    for data in chunks:
        full = False
        while data or full:
            if fresh:  # zeros may pad members
                data = data.lstrip(b"\0")
                fresh = not data
                if fresh:
                    break
            before = engine.copy()
            try:
                out = engine.decompress(data, CHUNK)
            except zlib.error:
                try:
                    for i in range(len(data)):
                        yield before.decompress(data[i : i + 1])
                except zlib.error:
                    return
                return
            yield out
            full = len(out) == CHUNK
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine, fresh, full = engine.unused_data, zlib.decompressobj(47), True, False


class Inflation:
    """One level of a compressed source; as its chunks pass, notes their digest, where UTF-16 shows, and keeps them
    (beyond 8 MB in a file) if they are compressed again."""

    def __init__(self, source):
        self.source, self.digest, self.wide, self.inner = source, hashlib.blake2b(digest_size=16), set(), None

    def again(self) -> Iterator[bytes]:
        self.source.seek(0)
        return filter(None, inflated(iter(lambda: self.source.read(CHUNK), b"")))

    def chunks(self) -> Iterator[bytes]:
        head = tail = b""
        n = 0
        for chunk in self.again():
            self.digest.update(chunk)
            if len(head) < 2:
                head += chunk
                if packed(head):
                    self.inner = tempfile.SpooledTemporaryFile(max_size=8_000_000)
                    self.inner.write(head)
            elif self.inner:
                self.inner.write(chunk)
            window = tail + chunk
            for coding, run in WIDE:
                self.wide |= {(coding, (n - len(tail) + m.start()) % 2) for m in run.finditer(window)}
            n += len(chunk)
            tail = window[-15:]
            yield chunk


def texts(chunks: Iterator[bytes], coding: str, offset: int = 0) -> Iterator[str]:
    """The text of the chunks in pieces that part nothing; a stretch without a place to cut is kept whole."""
    decoder, held = codecs.getincrementaldecoder(coding)("replace"), []
    for chunk in chunks:
        text = decoder.decode(chunk[offset:])
        offset = 0
        last = APART.search(text[::-1])
        if last:
            cut = len(text) - last.start()
            yield "".join([*held, text[:cut]])
            held, text = [], text[cut:]
        held.append(text)
    yield "".join([*held, decoder.decode(b"", True)])


def contents(data: bytes) -> Iterator[tuple[str, str]]:
    """The readings of the bytes and, while these are compressed, of what they inflate to, as (coding, text).

    Streams are read to their end, in pieces, so memory stays small; a level that was there before ends the descent.
    """
    for wide, text in readings(data):
        yield "base64." + wide, text
    coding, known = "", {hashlib.blake2b(data, digest_size=16).digest()}
    source = io.BytesIO(data) if packed(data) else None
    while source:
        coding += "packed."
        level = Inflation(source)
        for text in texts(level.chunks(), "latin-1"):
            yield coding, text
        for wide, offset in sorted(level.wide):
            for text in texts(level.again(), wide, offset):
                yield coding + "utf16.", text
        source.close()
        source = None if level.digest.digest() in known else level.inner
        known.add(level.digest.digest())


#: Where the characters of a decoded layer came from: the start of each, and its end.
Places = tuple[list[int], list[int]]


def unescape_url(text: str) -> tuple[str, Places]:
    """The text without percent escapes, and where each of its characters came from."""
    out, starts, stops, i = [], [], [], 0
    for m in URL.finditer(text):
        out += text[i : m.start()]
        starts += range(i, m.start())
        stops += range(i + 1, m.start() + 1)
        i = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            bad = 0xDC80 <= ord(c) <= 0xDCFF  # a byte that isn't UTF-8
            out.append(chr(ord(c) - 0xDC00) if bad else c)
            starts.append(i)
            i += 3 * (1 if bad else len(c.encode()))
            stops.append(i)
    out += text[i:]
    starts += range(i, len(text))
    stops += range(i + 1, len(text) + 1)
    return "".join(out), (starts, stops)


ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\([nrt\"'\\/])")


def unescape_backslash(text: str) -> tuple[str, Places]:
    out, starts, stops, i = [], [], [], 0
    for m in ESCAPE.finditer(text):
        out += text[i : m.start()]
        starts += range(i, m.start())
        stops += range(i + 1, m.start() + 1)
        code = next((g for g in m.groups()[:3] if g), None)
        if code is None:
            c = {"n": "\n", "r": "\r", "t": "\t"}.get(m[4], m[4])
        else:
            n = int(code, 16)
            c = chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"
        out.append(c)
        starts.append(m.start())
        i = m.end()
        stops.append(i)
    out += text[i:]
    starts += range(i, len(text))
    stops += range(i + 1, len(text) + 1)
    return "".join(out), (starts, stops)


def decoded(run: str) -> bytes:
    """The bytes of a run of the base64 alphabet, common or URL-safe; what is left over at its end goes."""
    body = run.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


#: The start of a gzip or zlib stream somewhere in bytes.
HEADER = re.compile(
    rb"\x1f\x8b\x08|" + b"|".join(re.escape(bytes([a])) + b"[" + b"".join(re.escape(bytes([b])) for b in range(256) if packed(bytes([a, b]))) + b"]" for a in range(8, 128, 16)),
    re.S,
)


def clean(data: bytes) -> bool:
    """Whether the bytes are UTF-8 text without control characters."""
    try:
        return not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", data.decode())
    except UnicodeDecodeError:
        return False


def inflates(data: bytes) -> bool:
    engine = zlib.decompressobj(47)
    try:
        return bool(engine.decompress(data, CHUNK)) or engine.eof
    except zlib.error:
        return False


def alignments(run: str) -> Iterator[tuple[int, str, str]]:
    """What a run of base64 holds, as (characters left out at its start, coding, text).

    Unless all of it is text, something else from the alphabet, such as a path or a name, may stand in front and shift
    it: one of four alignments is right for whatever follows. Streams may then begin anywhere in the bytes.
    """
    data = decoded(run)
    for coding, text in contents(data):
        yield 0, coding, text
    if clean(data):
        return
    for k in range(4):
        data = decoded(run[k:]) if k else data
        if k:
            for wide, text in readings(data):
                yield k, "base64." + wide, text
        for m in HEADER.finditer(data):
            at = m.start()
            if (k or at) and inflates(data[at : at + 256]):
                for coding, text in contents(data[at:]):
                    if coding.startswith("packed."):
                        yield k, coding, text


def layers(text: str):
    """The layers that the regions of a text hold: (coding, start, end, layer, places or None).

    Escapes are decoded over the whole text, so that what stands around them is read with them. Without places,
    the whole region stands for every place in the layer; in base64 of several lines the lines do.
    """
    if "%" in text and URL.search(text):
        yield "url", 0, len(text), *unescape_url(text)
    if "\\" in text and ESCAPE.search(text):
        yield "unicode", 0, len(text), *unescape_backslash(text)
    for m in BASE64.finditer(text):
        for _, coding, layer in alignments(m[0]):
            yield coding[:-1], m.start(), m.end(), layer, None
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            lines = [(x.start() + m.start(), x.end() + m.start(), x[0]) for x in LINE.finditer(m[0])]
            run = "".join(x for _, _, x in lines)
            if len(run) < 16:
                continue
            starts = [a for a, b, _ in lines for _ in range(a, b)]
            stops = [b for a, b, _ in lines for _ in range(a, b)]
            for k, coding, layer in alignments(run):
                places = None
                if coding == "base64.":
                    # The byte i has bits of the characters from 4 i / 3 to 4 (i + 1) / 3.
                    n = len(layer)
                    places = [starts[k + 4 * i // 3] for i in range(n)], [stops[k + (4 * i + 3) // 3] for i in range(n)]
                yield coding[:-1], m.start(), m.end(), layer, places


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """All finds of a text as (start, kind, end): base kinds for the text itself, and kinds such as
    "url.assign" or "base64.url.hex" for what its layers hold."""
    if not text:
        return []
    found: set[tuple[int, str, int]] = set()
    told: set[tuple[int, int, int]] = set()
    seen: set[tuple] = set()

    def inside(codings: str, layer: str, places: Places | None, span: tuple[int, int]) -> Iterator[tuple]:
        """Notes the layer's finds; yields the layers it holds that are new."""

        def place(i: int, j: int) -> tuple[int, int]:
            if not codings:
                return i, j
            return span if places is None else (places[0][i], places[1][j - 1])

        for start, kind, end in finds(layer):
            a, b = place(start, end)
            if (a, kind, b) not in told:  # what a layer leaves as it was is its outer layer's find
                told.add((a, kind, b))
                found.add((a, f"{codings}{KINDS[kind]}", b))
        for coding, start, end, inner, within in layers(layer):
            if not inner:
                continue
            a, b = place(start, end)
            key = (hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16).digest(), a, b)
            if key in seen:
                continue
            seen.add(key)
            if codings and places is None:
                within = None
            elif within is not None and codings:
                within = [places[0][p] for p in within[0]], [places[1][p - 1] for p in within[1]]
            yield f"{codings}{coding}.", inner, within, (a, b)

    # A worklist of layers (codings, layer, where its characters are in the text or None: as in the text, or all at the
    # span, its span), and the layer at work. An inflated piece has a worklist of its own, done before the next piece is made.
    work = [[deque([("", text, None, (0, len(text)))]), iter(())]]
    while work:
        todo, current = work[-1]
        item = next(current, None)
        if item is None:
            if todo:
                work[-1][1] = inside(*todo.popleft())
            else:
                work.pop()
        elif "packed" in item[0].split(".")[-3:]:
            work.append([deque([item]), iter(())])
        else:
            todo.append(item)
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[1]) if f[1] in KINDS else len(KINDS), f[1], f[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _digest(texts: list) -> dict:
    out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
    for text in texts:
        spans = scan(text)
        base = [s for s in spans if s[1] in KINDS]
        for k in KINDS:
            out[f"n_{k}"].append(sum(s[1] == k for s in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(spans))
    return out


def _spans(texts: list) -> dict:
    return {"spans": [[{"kind": k, "start": a, "end": b} for a, k, b in scan(t)] for t in texts]}


def secret_spans(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and `spans`, an array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have none. Repeated rows are scanned each; an empty table gives no rows;
    other columns are ignored.
    """
    return per_document(docs, _spans, "spans array<struct<kind:string,start:long,end:long>>", keys)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base finds, the SHA-256 of their list, and the list of all finds; nulls and the like as in `secret_spans`."""
    return per_document(docs, _digest, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str | None, fill: str = "[SECRET]") -> str | None:
    """The text with every found span replaced; spans that overlap go as one."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], fill]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, fill: str = "[SECRET]") -> DataFrame:
    """Documents with their secrets replaced and, where there is one, n_chars brought up to date;
    all rows and other columns stay as they are, whatever they are called. Null and empty texts stay; an empty table gives no rows."""
    prepare(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            texts = [mask(t, fill) for t in batch.column(names.index("text")).to_pylist()]
            columns = {n: batch.column(i) for i, n in enumerate(names)} | {"text": pa.array(texts, batch.column(names.index("text")).type)}
            if "n_chars" in names:
                old = batch.column(names.index("n_chars"))
                changed = [len(t) if t is not None and n is not None else n for t, n in zip(texts, old.to_pylist())]
                columns["n_chars"] = pa.array(changed, old.type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=batch.schema)

    return docs.mapInArrow(released(run), schema)
