"""Office documents (.docx), read with the standard library: a zip of XML parts."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BLOCK
from ..shipping import ship
from .markup import Node, blocks

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
DC = "{http://purl.org/dc/elements/1.1/}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
IMAGE_SCHEME = "doc-image:"


class Rejected(ValueError):
    """A file that can't be processed; the message says why."""


class Docx:
    """One document: `root` holds its content as markup nodes, `images` bytes and type by number."""

    def __init__(self, data: bytes, name: str):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            body = ElementTree.fromstring(self.zip.read("word/document.xml")).find(f"{W}body")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError) as e:
            raise Rejected(f"Cannot open '{name}': not a valid, unencrypted .docx file.") from e
        self.images: list[tuple[bytes, str | None]] = []
        self.relations = {
            r.get("Id"): (r.get("Target"), r.get("TargetMode")) for r in self._part("word/_rels/document.xml.rels").iter(f"{REL}Relationship")
        }
        types = self._part("[Content_Types].xml")
        self.types = {t.get("Extension", "").lower(): t.get("ContentType") for t in types.iter(f"{TYPES}Default")}
        self.styles = {s.get(f"{W}styleId"): s.find(f"{W}name").get(f"{W}val", "") for s in self._part("word/styles.xml").iter(f"{W}style") if s.find(f"{W}name") is not None}
        self.numbering = self._numbering()
        core = self._part("docProps/core.xml")
        self.title, self.lang = core.findtext(f".//{DC}title"), core.findtext(f".//{DC}language")
        self.root = Node("root")
        self._walk(body if body is not None else ElementTree.Element("none"), self.root)

    def _part(self, name: str) -> ElementTree.Element:
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except (KeyError, ElementTree.ParseError):
            return ElementTree.Element("none")

    def _numbering(self) -> dict[tuple[str, int], bool]:
        """Whether each level of each numbering is ordered."""
        part = self._part("word/numbering.xml")
        formats = {
            (a.get(f"{W}abstractNumId"), int(level.get(f"{W}ilvl", 0))): (level.find(f"{W}numFmt").get(f"{W}val") if level.find(f"{W}numFmt") is not None else "bullet")
            for a in part.iter(f"{W}abstractNum") for level in a.iter(f"{W}lvl")
        }
        out = {}
        for num in part.iter(f"{W}num"):
            ref = num.find(f"{W}abstractNumId")
            for (abstract, level), fmt in formats.items():
                if ref is not None and ref.get(f"{W}val") == abstract:
                    out[num.get(f"{W}numId"), level] = fmt != "bullet"
        return out

    def _image(self, drawing: ElementTree.Element) -> Node | None:
        blip = drawing.find(f".//{A}blip")
        target = self.relations.get(blip.get(f"{R}embed"), (None, None))[0] if blip is not None else None
        if not target:
            return None
        path = posixpath.normpath(posixpath.join("word", target)) if not target.startswith("/") else target[1:]
        try:
            data = self.zip.read(path)
        except KeyError:
            data = b""
        self.images.append((data, self.types.get(path.rpartition(".")[2].lower())))
        shown = drawing.find(f".//{WP}docPr")
        node = Node("img", {"src": f"{IMAGE_SCHEME}{len(self.images) - 1}"})
        if shown is not None and shown.get("descr"):
            node.attrs["alt"] = shown.get("descr")
        click = drawing.find(f".//{A}hlinkClick")
        href = self.relations.get(click.get(f"{R}id"), (None, None))[0] if click is not None else None
        if href:
            link = Node("a", {"href": href})
            link.children.append(node)
            return link
        return node

    def _run(self, r: ElementTree.Element, into: Node) -> None:
        style = r.find(f"{W}rPr")
        on = lambda name: style is not None and (x := style.find(f"{W}{name}")) is not None and x.get(f"{W}val", "1") not in ("0", "false", "none")
        target = into
        for name, tag in (("b", "strong"), ("i", "em")):
            if on(name):
                target.children.append(Node(tag))
                target = target.children[-1]
        for c in r:
            if c.tag == f"{W}t":
                target.children.append(c.text or "")
            elif c.tag == f"{W}tab":
                target.children.append("\t")
            elif c.tag in (f"{W}br", f"{W}cr"):
                target.children.append(Node("br"))
            elif c.tag in (f"{W}drawing", f"{W}pict"):
                image = self._image(c)
                if image is not None:
                    # A picture stands among the paragraph's children, where it ends the text before it.
                    into.children.append(image)

    def _inline(self, p: ElementTree.Element, into: Node) -> None:
        for c in p:
            if c.tag == f"{W}r":
                self._run(c, into)
            elif c.tag == f"{W}hyperlink":
                href = self.relations.get(c.get(f"{R}id"), (None, None))[0] or (f"#{c.get(f'{W}anchor')}" if c.get(f"{W}anchor") else "")
                link = Node("a", {"href": href})
                self._inline(c, link)
                into.children.append(link)
            elif c.tag in (f"{W}ins", f"{W}smartTag", f"{W}sdt", f"{W}sdtContent"):
                self._inline(c, into)

    def _table(self, t: ElementTree.Element) -> Node:
        out, head, body = Node("table"), Node("thead"), Node("tbody")
        rows = t.findall(f"{W}tr")
        grid: list[list[tuple[int, Node | None, bool]]] = []
        for tr in rows:
            line, at = [], 0
            for tc in tr.findall(f"{W}tc"):
                props = tc.find(f"{W}tcPr")
                wide = props.find(f"{W}gridSpan") if props is not None else None
                merge = props.find(f"{W}vMerge") if props is not None else None
                width = int(wide.get(f"{W}val", 1)) if wide is not None else 1
                goes_on = merge is not None and merge.get(f"{W}val", "continue") == "continue"
                cell = Node("td", {"colspan": str(width)} if width > 1 else {})
                for k, p in enumerate(tc.iter(f"{W}p")):
                    if k:
                        cell.children.append("\n")
                    self._inline(p, cell)
                line.append((at, None if goes_on else cell, goes_on))
                at += width
            grid.append(line)
        for i, line in enumerate(grid):
            for at, cell, _ in line:
                n = 1
                while cell is not None and i + n < len(grid) and any(a == at and on for a, _, on in grid[i + n]):
                    n += 1
                if n > 1:
                    cell.attrs["rowspan"] = str(n)
        leading = True
        for tr, line in zip(rows, grid):
            props = tr.find(f"{W}trPr")
            leading = leading and props is not None and props.find(f"{W}tblHeader") is not None
            row = Node("tr")
            for _, cell, _ in line:
                if cell is not None:
                    cell.tag = "th" if leading else "td"
                    row.children.append(cell)
            (head if leading else body).children.append(row)
        if head.children:
            out.children += [head, body]
        else:
            out.children += body.children
        return out

    def _walk(self, body: ElementTree.Element, root: Node) -> None:
        open_lists: list[Node] = []
        for c in body:
            if c.tag == f"{W}tbl":
                open_lists = []
                root.children.append(self._table(c))
            elif c.tag == f"{W}sdt":
                content = c.find(f"{W}sdtContent")
                if content is not None:
                    self._walk(content, root)
            elif c.tag == f"{W}p":
                props = c.find(f"{W}pPr")
                style = props.find(f"{W}pStyle") if props is not None else None
                name = self.styles.get(style.get(f"{W}val"), style.get(f"{W}val", "")).lower() if style is not None else ""
                num = props.find(f"{W}numPr") if props is not None else None
                listed = self._list_place(num, name)
                if listed is not None:
                    level, ordered = listed
                    open_lists = open_lists[: level + 1]
                    while len(open_lists) <= level:
                        fresh = Node("ol" if ordered else "ul")
                        parent = root
                        if open_lists:
                            if not open_lists[-1].children:
                                open_lists[-1].children.append(Node("li"))
                            parent = open_lists[-1].children[-1]
                        parent.children.append(fresh)
                        open_lists.append(fresh)
                    item = Node("li")
                    self._inline(c, item)
                    open_lists[-1].children.append(item)
                    continue
                open_lists = []
                heading = name.split()[-1] if name.startswith("heading ") else "1" if name == "title" else ""
                node = Node(f"h{heading}" if heading.isdigit() and 1 <= int(heading) <= 6 else "p")
                self._inline(c, node)
                if node.children:
                    root.children.append(node)

    def _list_place(self, num: ElementTree.Element | None, style: str) -> tuple[int, bool] | None:
        if num is not None and num.find(f"{W}numId") is not None:
            level = num.find(f"{W}ilvl")
            level = int(level.get(f"{W}val", 0)) if level is not None else 0
            return level, self.numbering.get((num.find(f"{W}numId").get(f"{W}val"), level), False)
        for prefix, ordered in (("list bullet", False), ("list number", True)):
            if style.startswith(prefix):
                last = style.split()[-1]
                return (int(last) - 1 if last.isdigit() else 0), ordered
        return None


def files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, filename, suffix, content and error of files below a path; formats other than .docx and .pdf are rejected."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return dispatched(raw.select("path", "content"))


def dispatched(raw: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    known = suffix.isin(".docx", ".pdf")
    return raw.select(
        F.xxhash64("path").alias("doc_id"),
        F.regexp_extract("path", r"([^/\\]*)$", 1).alias("filename"),
        suffix.alias("suffix"),
        F.when(known, F.col("content")).alias("content"),
        F.when(~known, F.concat(F.lit("Unsupported file type '"), suffix, F.lit("'; supported: .docx, .pdf"))).alias("error"),
    )


def docx_documents(found: DataFrame) -> DataFrame:
    """One row for each .docx of files(): status and error, title and language of its properties, blocks and images."""
    ship(found.sparkSession)
    schema = (
        "doc_id long, filename string, status string, error string, meta_title string, meta_lang string, "
        f"blocks array<struct<{BLOCK}>>, images array<struct<idx:int,data:binary,mime_type:string>>"
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, name, content in zip(batch["doc_id"], batch["filename"], batch["content"]):
                try:
                    d = Docx(bytes(content or b""), name)
                except Rejected as e:
                    rows.append((doc_id, name, "rejected", str(e), None, None, [], []))
                    continue
                images = [{"idx": i, "data": data, "mime_type": mime} for i, (data, mime) in enumerate(d.images)]
                rows.append((doc_id, name, "ok", None, d.title, d.lang, blocks(d.root), images))
            yield pd.DataFrame(rows, columns=["doc_id", "filename", "status", "error", "meta_title", "meta_lang", "blocks", "images"])

    return found.filter("suffix = '.docx'").select("doc_id", "filename", "content").mapInPandas(read, schema)
