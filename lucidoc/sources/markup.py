"""A small element tree and the walk from markup to blocks, on the standard library's HTML parser."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
HIDDEN = {"script", "style", "template"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Web pages keep their content inside these; their children count as the page's own.
WRAPPERS = {"html", "body", "main", "article", "section"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []  # children: nodes and strings

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, tag: str) -> Node | None:
        for c in self.children:
            if isinstance(c, Node):
                got = c if c.tag == tag else c.find(tag)
                if got is not None:
                    return got
        return None


class TreeBuilder(HTMLParser):
    """Builds nodes; an open paragraph ends where HTML says it does, and stray end tags are dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def end(self, *tags: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in ("td", "th", "table", "ul", "ol"):
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self.end("p")
        if tag == "li":
            self.end("li")
        elif tag in ("td", "th") and self.open[-1].tag in ("td", "th"):
            self.open.pop()
        elif tag == "tr":
            while self.open[-1].tag in ("td", "th", "tr"):
                self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(markup: str) -> Node:
    builder = TreeBuilder()
    builder.feed(markup)
    builder.close()
    return builder.root


def run(text: str, bold: bool, italic: bool, link: tuple[str, str] | None = None) -> dict:
    return {"text": text, "bold": bold, "italic": italic, "link_text": link and link[0], "link_href": link and link[1]}


def inline(node: Node, bold: bool = False, italic: bool = False) -> list[dict]:
    """Runs of a node's content. A link is one run of all its text; one around a picture alone shows its alternative text."""
    if node.tag in HIDDEN:
        return []
    bold, italic = bold or node.tag in ("b", "strong"), italic or node.tag in ("i", "em")
    if node.tag == "a":
        text, href = node.text(), node.attrs.get("href", "")
        picture = None if text else node.find("img")
        text = text or (picture is not None and (picture.attrs.get("alt") or "image")) or ""
        return [run(text, bold, italic, (text, href))] if text else []
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(run(c, bold, italic))
        elif c.tag == "br":
            out.append(run("\n", bold, italic))
        else:
            out += inline(c, bold, italic)
    return out


def kept(runs: list[dict]) -> list[dict]:
    return [r for r in runs if r["text"]]


def block(kind: str, **more) -> dict:
    base = {"kind": kind, "level": None, "ordered": None, "header_row": None, "runs": [], "items": [], "cells": [], "image": None, "source_tag": None}
    return base | more


def picture(node: Node, href: str | None = None) -> dict:
    return block("image", image={"src": node.attrs.get("src", ""), "alt": node.attrs.get("alt"), "link_href": href}, source_tag="img")


def paragraph(node: Node) -> list[dict]:
    """Paragraphs and pictures of a <p>: a picture among its children, linked or not, ends the paragraph before it."""
    out, runs = [], []

    def flush() -> None:
        if kept(runs):
            out.append(block("paragraph", runs=kept(runs), source_tag="p"))
        runs.clear()

    for c in node.children:
        if isinstance(c, str):
            runs.append(run(c, False, False))
        elif c.tag == "img":
            flush()
            out.append(picture(c))
        elif c.tag == "a" and not c.text() and c.find("img") is not None:
            flush()
            out.append(picture(c.find("img"), c.attrs.get("href", "")))
        elif c.tag == "br":
            runs.append(run("\n", False, False))
        else:
            runs += inline(c)
    flush()
    return out


def items(node: Node, path: tuple[int, ...] = (), depth: int = 0) -> list[dict]:
    """Items of a list and its sub-lists in document order, with the path of places that leads to each."""
    out = []
    rows = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
    for k, li in enumerate(rows):
        runs, subs = [], []
        for c in li.children:
            if isinstance(c, str):
                runs.append(run(c, False, False))
            elif c.tag in ("ul", "ol"):
                subs.append(c)
            elif c.tag == "br":
                runs.append(run("\n", False, False))
            else:
                runs += inline(c)
        out.append({"item_path": [*path, k], "depth": depth, "ordered": node.tag == "ol", "runs": kept(runs)})
        for j, sub in enumerate(subs):
            out += items(sub, (*path, k, j), depth + 1)
    return out


def span(node: Node, name: str) -> int:
    try:
        return max(1, int(node.attrs.get(name, 1)))
    except ValueError:
        return 1


def table(node: Node) -> dict:
    """Cells by row: those of the head, then of the body, or direct rows where there is neither."""
    nodes = [c for c in node.children if isinstance(c, Node)]
    head = next((c for c in nodes if c.tag == "thead"), None)
    body = next((c for c in nodes if c.tag == "tbody"), None)
    parts = [p for p in (head, body) if p is not None] or [node]
    rows = [r for p in parts for r in p.children if isinstance(r, Node) and r.tag == "tr"]
    cells = []
    for i, row in enumerate(rows):
        for j, c in enumerate([c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]):
            cells.append({"row_no": i, "col_no": j, "header": c.tag == "th", "colspan": span(c, "colspan"), "rowspan": span(c, "rowspan"), "runs": kept(inline(c))})
    return block("table", header_row=head is not None, cells=cells, source_tag="table")


def blocks(root: Node, descend: bool = False) -> list[dict]:
    """Blocks among a root's children, in order; with `descend`, through the wrappers of web pages too."""
    out: list[dict] = []
    for c in root.children:
        if isinstance(c, str):
            continue
        if c.tag in HEADINGS:
            runs = kept(inline(c))
            if runs:
                out.append(block("heading", level=HEADINGS[c.tag], runs=runs, source_tag=c.tag))
        elif c.tag == "p":
            out += paragraph(c)
        elif c.tag in ("ul", "ol"):
            out.append(block("list", ordered=c.tag == "ol", items=items(c), source_tag=c.tag))
        elif c.tag == "table":
            out.append(table(c))
        elif c.tag == "img":
            out.append(picture(c))
        elif c.tag in ("blockquote", "div"):
            runs = kept(inline(c))
            if runs:
                out.append(block("paragraph", runs=runs, source_tag=c.tag))
        elif descend and c.tag in WRAPPERS:
            out += blocks(c, True)
    return [b | {"block_ord": k} for k, b in enumerate(out)]
