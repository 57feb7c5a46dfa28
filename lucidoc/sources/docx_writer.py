"""Minimal .docx files from plain text, for round trips."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/></Types>',
    "word/styles.xml": f'<w:styles xmlns:w="{MAIN}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H3"><w:name w:val="heading 3"/></w:style><w:style w:styleId="LB"><w:name w:val="List Bullet"/></w:style><w:style w:styleId="LB2"><w:name w:val="List Bullet 2"/></w:style></w:styles>',
}
#: What XML can't hold.
UNFIT = {c: None for c in range(32) if c not in (9, 10, 13)} | {0xFFFE: None, 0xFFFF: None}


def paragraph(text: str, style: str | None = None) -> str:
    style = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text.translate(UNFIT))}</w:t></w:r></w:p>'


def docx_bytes(body: str, title: str | None = None, lang: str | None = None, more: dict[str, str | bytes] | None = None) -> bytes:
    """A file with the given body XML and core properties; `more` adds or replaces parts."""
    core = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">'
    core += f"<dc:title>{escape(title)}</dc:title>" if title else ""
    core += f"<dc:language>{escape(lang)}</dc:language>" if lang else ""
    parts = PARTS | {"docProps/core.xml": core + "</cp:coreProperties>", "word/document.xml": f'<w:document xmlns:w="{MAIN}"><w:body>{body}</w:body></w:document>'} | (more or {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def body_of(text: str) -> str:
    """First line a heading, every seventh a list item, others paragraphs; empty lines are empty paragraphs."""
    out = []
    for i, line in enumerate(text.split("\n")):
        out.append(paragraph(line, "H1" if i == 0 else "LB" if i % 7 == 6 else None))
    return "".join(out)


def with_docx(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang) as files: doc_id, filename, suffix, content."""
    ship(docs.sparkSession)

    def write(batches):
        for b in batches:
            rows = [(d, f"doc{d}.docx", ".docx", docx_bytes(body_of(t or ""), None, lang)) for d, t, lang in zip(b["doc_id"], b["text"], b["lang"])]
            yield pd.DataFrame(rows, columns=["doc_id", "filename", "suffix", "content"])

    return docs.select("doc_id", "text", "lang").mapInPandas(write, "doc_id long, filename string, suffix string, content binary")
