"""Whole plans on small inputs: markup, office files, layout tables, jobs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lucidoc.operators import headings as hd
from lucidoc.operators import layout as ly
from lucidoc.operators import links as lk
from lucidoc import tables
from lucidoc.functions import text as tx
from lucidoc.plans import catalogue, layout_documents, accessible
from lucidoc.sinks import write_files
from lucidoc.sources.docx import dispatched, docx_documents
from lucidoc.sources.docx_writer import docx_bytes, paragraph
from lucidoc.sources.html import html_blocks, html_meta
from lucidoc.streaming import jobs

META = "doc_id long, filename string, meta_title string, meta_lang string"
NOT_DETECTED = "doc_id long, code string, confidence double"


def from_html(spark, html, title=None, lang=None):
    pages = spark.createDataFrame([(1, "f.docx", html)], "doc_id long, filename string, html string")
    meta = spark.createDataFrame([(1, "f.docx", title, lang)], META)
    return accessible.from_markup(meta, html_blocks(pages, False), spark.createDataFrame([], NOT_DETECTED))


def codes(result):
    return [r.code for r in result.items.orderBy("item_ord").collect()]


def test_markup_end_to_end(spark):
    html = (
        "<h1>Fixture</h1><h3>Deep</h3><p>go <a href='u'>click here</a></p><ul><li>one<ul><li>two</li></ul></li></ul>"
        "<table><tr><td>Region</td><td>Count</td></tr><tr><td>North</td><td>12</td></tr></table><p><img src='x'></p>"
    )
    result = from_html(spark, html, lang="fr-FR, en")
    page = result.html.first().html
    assert '<html lang="fr-FR">' in page and "<h2>Deep</h2>" in page and "<ul><li>one<ul><li>two</li></ul></li></ul>" in page
    assert '<thead><tr><th scope="col">Region</th><th scope="col">Count</th></tr></thead>' in page
    assert codes(result) == ["HEADING_SKIP_REPAIRED", "HEADER_ROW_AUTO_ADDED", "GENERIC_LINK_TEXT", "NO_HEADER_ROW_DETECTED", "MISSING_ALT"]
    report = result.report.first().report
    assert report.summary.total_items == 5 and report.summary["auto-fixed"] == 2
    assert [(x.text, x.href, x.flagged) for x in report.links] == [("click here", "u", True)]


def test_empty_document_gets_its_file_name(spark):
    result = from_html(spark, "")
    assert "<h1>f</h1>" in result.html.first().html
    assert sorted(codes(result)) == ["LANG_ASSUMED", "TITLE_FROM_FILENAME", "TITLE_PROMOTED_TO_H1"]


def test_merged_cells(spark):
    result = from_html(spark, "<table><thead><tr><th colspan=2>H</th></tr></thead><tbody><tr><td rowspan='x'>a</td><td>b</td></tr></tbody></table>", "T", "en")
    assert codes(result) == ["TITLE_PROMOTED_TO_H1", "COMPLEX_TABLE_STRUCTURE"]


def test_captions_and_header_columns(spark):
    pages = spark.createDataFrame([(1, "f.docx", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>")], "doc_id long, filename string, html string")
    meta = spark.createDataFrame([(1, "f.docx", "T", "en")], META)
    blocks = html_blocks(pages, False).withColumn("caption", F.lit("Sales & costs")).withColumn("header_col", F.lit(True))
    result = accessible.from_markup(meta, blocks, spark.createDataFrame([], NOT_DETECTED))
    page = result.html.first().html
    assert "<table><caption>Sales &amp; costs</caption><thead>" in page and '<tr><th scope="row">c</th><td>d</td></tr>' in page
    assert [r.location for r in result.fixes.filter("code = 'HEADER_ROW_AUTO_ADDED'").collect()] == ["Sales & costs"]


def fold(levels):
    out, seen, before = [], False, 0
    for level in levels:
        if level == 1 and seen:
            level = 2
        seen = seen or level == 1
        before = min(level, before + 1)
        out.append(before)
    return out


def test_closed_form_of_the_repair_equals_the_fold(spark):
    r = random.Random(7)
    cases = [[r.randint(1, 6) for _ in range(r.randint(1, 12))] for _ in range(300)]
    rows = [(d, i, level, "h") for d, c in enumerate(cases) for i, level in enumerate(c)]
    got = hd.repaired_levels(spark.createDataFrame(rows, "doc_id long, ord int, level int, text string")).orderBy("doc_id", "ord").collect()
    assert [g.level_final for g in got] == [x for c in cases for x in fold(c)]


def test_two_levels_without_a_promotion(spark):
    rows = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 1, "b")], "doc_id long, ord int, level int, text string")
    assert [r.level_final for r in hd.repaired_levels(rows).orderBy("ord").collect()] == [1, 1]


def box(*v):
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, v)))


def items(spark, boxes):
    return spark.createDataFrame([(1, 0, i, 612.0, box(*b)) for i, b in enumerate(boxes)], "doc_id long, page_no int, item_no int, width double, bbox struct<x0:double,y0:double,x1:double,y1:double>")


@pytest.mark.parametrize(
    ("boxes", "order", "uncertain"),
    [
        ([(72, 100, 200, 110), (320, 100, 450, 110), (72, 120, 200, 130), (320, 120, 450, 130), (72, 140, 200, 150), (320, 140, 450, 150)], [0, 2, 4, 1, 3, 5], False),
        ([(72, 100, 500, 110), (72, 120, 500, 130), (250, 140, 400, 150), (250, 160, 400, 170), (72, 180, 500, 190), (72, 300, 500, 310)], [0, 1, 2, 3, 4, 5], True),
        ([(72, 100, 200, 110), (250, 100, 400, 110), (430, 100, 500, 110), (72, 120, 200, 130)], [0, 1, 2, 3], True),
        ([(320, 100, 400, 110), (72, 100, 200, 110)], [1, 0], False),
    ],
)
def test_reading_order(spark, boxes, order, uncertain):
    got = ly.reading_order(items(spark, boxes)).orderBy("place").collect()
    assert [g.item_no for g in got] == order and {g.uncertain for g in got} == {uncertain}


def test_greedy_matches_equal_the_fold(spark):
    r = random.Random(3)
    spot = lambda: (x := r.randint(0, 60), y := r.randint(0, 60), x + r.randint(5, 30), y + r.randint(5, 30))
    probes = [(1, p, i, box(*spot())) for p in range(8) for i in range(12)]
    links = [(1, p, i, f"u{i}", box(*spot())) for p in range(8) for i in range(8)]

    def meets(a, b):
        w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
        area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
        return w > 0 and h > 0 and w * h >= 0.5 * min(area(a), area(b))

    want = set()
    for page in range(8):
        free = [x for x in links if x[1] == page]
        for _, _, i, b in (x for x in probes if x[1] == page):
            hit = next((x for x in free if meets(b, x[4])), None)
            if hit:
                free.remove(hit)
                want.add((page, i, hit[2]))
    schema = "doc_id long, page_no int, {}, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    got = lk.greedy_matches(spark.createDataFrame(probes, schema.format("probe_no int")), spark.createDataFrame(links, schema.format("link_no int, uri string")))
    assert {(g.page_no, g.probe_no, g.link_no) for g in got.collect()} == want


def test_docx(spark):
    png = b"\x89PNG"
    drawing = (
        '<w:p><w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:docPr descr="Picture1.jpg"/>'
        '<a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="r1"/></wp:inline></w:drawing></w:r></w:p>'
    )
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/i.png"/></Relationships>'
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('Region')}{cell('Count')}</w:tr><w:tr>{cell('North')}{cell('12')}</w:tr></w:tbl>"
    body = paragraph("Fixture", "H1") + paragraph("Deep", "H3") + paragraph("one", "LB") + paragraph("two", "LB2") + paragraph("three", "LB") + table + drawing
    good = docx_bytes(body, None, "fr-FR", {"word/_rels/document.xml.rels": rels, "word/media/i.png": png})
    raw = spark.createDataFrame([("a/good.docx", good), ("a/bad.docx", b"not a zip"), ("a/x.txt", b"")], "path string, content binary")
    found = dispatched(raw)
    assert found.filter("error IS NOT NULL").count() == 1
    docs = docx_documents(found).cache()
    assert {(r.filename, r.status) for r in docs.collect()} == {("good.docx", "ok"), ("bad.docx", "rejected")}
    ok = docs.filter("status = 'ok'")
    blocks = ok.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")
    images = ok.select("doc_id", F.explode("images").alias("i")).select("doc_id", "i.*")
    result = accessible.from_markup(ok.select("doc_id", "filename", "meta_title", "meta_lang"), blocks, spark.createDataFrame([], NOT_DETECTED), images)
    page = result.html.first().html
    assert '<html lang="fr-FR">' in page and "<ul><li>one<ul><li>two</li></ul></li><li>three</li></ul>" in page and "data:image/png;base64,iVBORw==" in page
    assert codes(result) == ["HEADING_SKIP_REPAIRED", "HEADER_ROW_AUTO_ADDED", "NO_HEADER_ROW_DETECTED", "MISSING_ALT"]


def test_layout_document(spark):
    """A page with headings, a list over blocks, a hyphenated word, a linked line, a table and a tiny picture."""
    lines = [("Big title", 24), ("Section", 16), ("This line has a hy-", 11), ("phenated word.", 11), ("• one", 11), ("• two", 11), ("See the plan here", 11)] + [("body text that is long enough", 11)] * 4
    blocks, y = [], 50.0
    spans = []
    for i, (t, size) in enumerate(lines):
        block, line = (2, i - 2) if i in (2, 3) else (i, 0)
        b = box(72, y, 72 + 5 * len(t), y + size)
        spans.append((1, 0, block, line, 0, t, float(size), 0, b))
        if line == 0:
            blocks.append((1, 0, block, b))
        else:
            blocks[-1] = (1, 0, block, {**blocks[-1][3], "y1": b["y1"], "x1": max(b["x1"], blocks[-1][3]["x1"])})
        y += 20
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    link = next(s[8] for s in spans if s[5].startswith("See"))
    make = spark.createDataFrame
    t = {
        "pages": make([(1, 0, 1, 612.0, 792.0)], "doc_id long, page_no int, page_count int, width double, height double"),
        "spans": make(spans, f"doc_id long, page_no int, block_no int, line_no int, span_no int, text string, size double, style_flags int, bbox {rect}"),
        "blocks_raw": make(blocks, f"doc_id long, page_no int, block_no int, bbox {rect}"),
        "links_raw": make([(1, 0, 0, "http://x", link), (1, 0, 1, "http://lost", box(500, 700, 520, 720))], f"doc_id long, page_no int, link_no int, uri string, bbox {rect}"),
        "tables_raw": make([(1, 0, 0, box(72, 400, 300, 450), [["a", "b"], ["c"]])], f"doc_id long, page_no int, table_no int, bbox {rect}, cells array<array<string>>"),
        "images_raw": make([(1, 0, 5, 0, box(72, 500, 82, 510), b"x", "png"), (1, 0, 6, 0, None, b"y", "png")], f"doc_id long, page_no int, xref int, placement_no int, bbox {rect}, data binary, ext string"),
        "doc_meta": make([(1, "a.pdf", "pdf", None, "en", False, 1)], "doc_id long, filename string, source_format string, meta_title string, meta_lang string, needs_pass boolean, page_count int"),
    }
    found = layout_documents.LayoutDocuments(t)
    kinds = [r.kind for r in found.blocks.orderBy("block_ord").collect()]
    assert kinds == ["heading", "heading", "paragraph", "list"] + ["paragraph"] * 5 + ["table", "image"]
    result = accessible.from_layout(found, make([], NOT_DETECTED))
    page = result.html.first().html
    assert "<title>Big title</title>" in page and "<p>This line has a hyphenated word.</p>" in page and "<ul><li>one</li><li>two</li></ul>" in page
    assert '<p><a href="http://x">See the plan here</a></p>' in page and 'alt=""' in page
    assert set(codes(result)) == {"LINK_UNASSOCIATED", "HEADINGS_INFERRED", "NO_HEADER_ROW_DETECTED", "COMPLEX_TABLE_STRUCTURE", "TABLE_EXTRACTION_UNCERTAIN", "DECORATIVE_ASSUMED"}


def test_sizes_come_from_all_pages_of_a_long_document(spark):
    """Of 60 pages, 25 spread ones were looked at before: page 1 isn't one of them, nor are 35 of those with body text."""
    sampled = {round(k * 59 / 24) for k in range(25)}
    assert 1 not in sampled
    texts = [(p, 20.0 if p == 1 else 11.0 if p in sampled else 14.0, "A heading" if p == 1 else "body text of a page") for p in range(60)]
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    place = box(72, 50, 200, 70)
    make = spark.createDataFrame
    t = {
        "pages": make([(1, p, 60, 612.0, 792.0) for p in range(60)], "doc_id long, page_no int, page_count int, width double, height double"),
        "spans": make([(1, p, 0, 0, 0, text, size, 0, place) for p, size, text in texts], f"doc_id long, page_no int, block_no int, line_no int, span_no int, text string, size double, style_flags int, bbox {rect}"),
        "blocks_raw": make([(1, p, 0, place) for p in range(60)], f"doc_id long, page_no int, block_no int, bbox {rect}"),
        "links_raw": make([], f"doc_id long, page_no int, link_no int, uri string, bbox {rect}"),
        "tables_raw": make([], f"doc_id long, page_no int, table_no int, bbox {rect}, cells array<array<string>>"),
        "images_raw": make([], f"doc_id long, page_no int, xref int, placement_no int, bbox {rect}, data binary, ext string"),
        "doc_meta": make([(1, "a.pdf", "pdf", None, "en", False, 60)], "doc_id long, filename string, source_format string, meta_title string, meta_lang string, needs_pass boolean, page_count int"),
    }
    found = layout_documents.LayoutDocuments(t)
    assert {r.size: r.chars for r in found.histogram.collect()} == {11.0: 25 * 19, 14.0: 34 * 19, 20.0: 9}
    assert found.body.first().body_size == 14.0
    assert [r.page_no for r in found.blocks.filter("kind = 'heading'").collect()] == [1]


def test_files_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([("a", "html", "<p>x</p>\n<p>y</p>"), ("b", "html", "<p>z</p>")], "stem string, artifact string, content string")
    write_files(rows, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out" / "artifact=html" / "stem=a").glob("part-*")) == "<p>x</p>\n<p>y</p>\n"


def test_upload_stream(spark, tmp_path):
    uploads = tmp_path / "uploads"
    uploads.mkdir()
    (uploads / "a.docx").write_bytes(docx_bytes(paragraph("Hi", "H1")))
    (uploads / "b.txt").write_bytes(b"x")

    def process(batch):
        return docx_documents(batch.filter("error IS NULL").select("doc_id", "filename", "suffix", "content")).select("doc_id", "status")

    for _ in range(2):  # the second run finds all done at the checkpoint
        stream = jobs.admitted(jobs.uploads(spark, str(uploads)))
        jobs.run(stream, process, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "out" / "jobs"))
    states = [(r.original_filename, r.state) for r in log.orderBy("original_filename", "at").collect()]
    assert states == [("a.docx", "queued"), ("a.docx", "processing"), ("a.docx", "done"), ("b.txt", "error")]
    assert {(r.original_filename, r.state) for r in jobs.latest(log).collect()} == {("a.docx", "done"), ("b.txt", "error")}
    assert spark.read.parquet(str(tmp_path / "out" / "results")).count() == 1


def test_admission(spark):
    rows = [("u/a.pdf", None, 0, b""), ("u/b.pdf", None, jobs.MAX_BYTES + 1, b"x"), ("u/c.pdf", None, 1, b"x"), ("u/d.md", None, 1, b"x")]
    got = jobs.admitted(spark.createDataFrame(rows, jobs.UPLOAD)).collect()
    assert [(r.filename, r.state) for r in got] == [("a.pdf", "error"), ("b.pdf", "error"), ("c.pdf", "queued"), ("d.md", "error")]


def test_job_metadata_drops_malformed_records(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"job_id": "a", "state": "done", "pct": 1.0}\n{"job_id": oops\n')
    assert [r.job_id for r in jobs.job_metadata(spark, str(tmp_path)).collect()] == ["a"]
    done = jobs.job_metadata(spark, str(tmp_path)).withColumn("downloads", F.array(F.lit("pdf")))
    assert '"downloads":["pdf"]' in jobs.status(done).first().status


def test_command_line(spark, tmp_path, capsys):
    from lucidoc.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(docx_bytes(paragraph("Hi", "H1"), "A title", "en"))
    (tmp_path / "in" / "b.docx").write_bytes(b"broken")
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF")
    assert main([str(tmp_path / "in"), "-o", str(tmp_path / "out")]) == 0
    told = capsys.readouterr().err
    assert "b.docx" in told and "c.pdf" in told
    page = "".join(p.read_text() for p in (tmp_path / "out" / "artifact=html" / "stem=a").glob("part-*"))
    assert "<title>A title</title>" in page and "<h1>Hi</h1>" in page
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.docx").write_bytes(b"broken")
    assert main([str(tmp_path / "bad"), "-o", str(tmp_path / "none")]) == 1 and not (tmp_path / "none").exists()
    assert main([str(tmp_path / "missing"), "-o", str(tmp_path / "none")]) == 1


def test_recognition_by_an_outside_program(spark, tmp_path):
    from lucidoc.sources.recognition import recognised_files

    script = tmp_path / "fake"
    script.write_text('#!/bin/sh\nfor a; do last=$a; done\nin=$(dirname "$last")/in.pdf\ncase $(cat "$in") in slow) exec sleep 30;; bad) echo broken >&2; exit 3;; esac\n(echo "$*" | cut -c1-6; cat "$in") > "$last"\n')
    script.chmod(0o755)
    found = spark.createDataFrame([(1, b"page"), (2, b"slow"), (3, b"bad")], "doc_id long, content binary")
    got = {r.doc_id: r for r in recognised_files(found, (str(script),), total_timeout=2).collect()}
    assert bytes(got[1].content) == b"-l eng\npage" and got[1].error is None
    assert got[2].content is None and "longer than 2 s" in got[2].error
    assert "broken" in got[3].error
    missing = recognised_files(found.limit(1), ("/no/such/program",)).first()
    assert "can't run" in missing.error


def test_layout_plans_stay_small(spark, tmp_path):
    """The driver holds a plan once for each of its stages; before, the report's last one had 50 exchanges."""
    t = catalogue.layout(spark, "/root/testdata/sf0.001", keep=True)
    found = layout_documents.LayoutDocuments(t)
    result = accessible.from_layout(found, spark.createDataFrame([], NOT_DETECTED))
    for df in (found.blocks, found.document_flags, found.block_flags, result.items):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 30


def test_what_a_layout_report_leaves_to_its_caller_is_small(spark):
    """Headings, flags and items are stored; before, the caller's plan of the items joined and numbered all flags and blocks, outside the settings."""
    found = layout_documents.LayoutDocuments(catalogue.layout(spark, "/root/testdata/sf0.001", keep=True))
    result = accessible.from_layout(found, spark.createDataFrame([], NOT_DETECTED))
    for df in (result.headings, result.flags, result.items):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan


def test_tables_of_documents_broadcast_nothing_by_its_size(spark, tmp_path, monkeypatch):
    plans = []

    def stored(df, folder, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(tables, "stored", stored)
    docs = spark.range(50).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(3))))
    tables.stored_within(docs.join(docs.groupBy("id", "page").count(), ["id", "page"]), str(tmp_path), "pages")
    tables.stored_within(docs.join(F.broadcast(spark.range(3)), "id"), str(tmp_path), "hinted")
    assert "Broadcast" not in plans[0] and "BroadcastHashJoin" in plans[1]


def test_tables_of_documents_keep_settings_and_drop_shuffles(spark, tmp_path):
    key = next(iter(tables.WITHIN))
    before = spark.conf.get(key)
    rows = spark.range(100).withColumn("page", F.col("id") % 7).repartition("id")
    other = spark.range(100).withColumn("page", F.col("id") % 7)
    out = tables.stored_within(rows.join(other, ["id", "page"]), str(tmp_path), "joined")
    assert out.count() == 100 and spark.conf.get(key) == before


def test_tables_of_documents_tell_listeners_little_of_their_plans(spark, tmp_path, monkeypatch):
    """Plans of tables are told again each time one of their stages ends; the largest was half a megabyte."""
    told = []
    monkeypatch.setattr(tables, "stored", lambda df, folder, name: told.append(len(df._jdf.queryExecution().executedPlan().toString())))
    rows = spark.range(10).select(*[F.sum(F.col("id") + i).over(Window.partitionBy("id")).alias(f"a_long_name_of_column_{i}") for i in range(400)])
    with monkeypatch.context() as m:
        m.setattr(tables, "WITHIN", {"spark.sql.debug.maxToStringFields": "10000", **tables.WITHIN})
        tables.stored_within(rows, str(tmp_path), "wide")
    assert told[0] <= 21_000


@pytest.mark.parametrize("text", ["• a", " \x1f• a ", "• ", "•\u2003\x1c", "•  \x1f x", "12) d", "\u00a01. \n c", "1. ", "1.\x1cx", "1. \x1cx", "", " ", "x • a", "a\n• b"])
def test_list_prefixes_are_those_of_the_stripped_text(spark, text):
    bare = F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    row = spark.createDataFrame([(text,)], "t string").select(tx.strip(F.col("t")) == bare, tx.is_bullet(F.col("t")) == bare.rlike(tx.BULLET), tx.is_numbered(F.col("t")) == bare.rlike(tx.NUMBERED)).first()
    assert all(row)


def test_entities_that_a_title_was_cut_in_stay(spark):
    cases = {"A &amp; B &amp": "A & B &amp", "&lt;i&gt; &copy": "<i> &copy", "&amp;lt; &eacute;&#39;&#x27; &nosuch;": "&lt; é'' &nosuch;", "&": "&", "": None}
    pages = spark.createDataFrame([(k, f"<title>{t}</title>") for k, t in enumerate(cases)], "doc_id long, html string")
    assert [r.meta_title for r in html_meta(pages).orderBy("doc_id").collect()] == list(cases.values())
