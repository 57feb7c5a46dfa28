"""Expressions on cases the driver tables lack."""

from pyspark.sql import functions as F

from lucidoc.functions import geometry, language
from lucidoc.functions import text as tx
from lucidoc.operators import headings as hd


def values(spark, f, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(f(F.col("x")) if schema == "x string" else f).collect()]


def test_strip_takes_unicode_blanks(spark):
    assert values(spark, tx.strip, [" a b \x1c", "\t\n", ""]) == ["a b", "", ""]


def test_list_items_need_a_blank_after_the_mark(spark):
    assert values(spark, tx.is_list_item, ["• a", "•", "1) a", "٣) a", "– a", "1234. a", "a. b"]) == [True, False, True, True, True, False, True]


def test_only_one_prefix_goes(spark):
    assert values(spark, tx.strip_list_prefix, ["• 1. a", "1. • a", " • a"]) == ["1. a", "• a", " • a"]


def test_half_points_round_half_to_even(spark):
    rows = spark.createDataFrame([(11.25,), (11.75,), (11.2,)], "x double")
    assert [r[0] for r in rows.select(tx.half_points(F.col("x"))).collect()] == [11.0, 12.0, 11.0]


def test_mime_types(spark):
    assert values(spark, tx.mime_of, ["jpg", "svg", None]) == ["image/jpeg", "image/svg", "image/png"]


def test_confidence_boundaries(spark):
    score = hd.confidence(F.lit(20.0), F.lit(10.0), F.lit(100), F.col("n"))
    rows = spark.createDataFrame([(120,), (121,), (240,)], "n int").select(score).collect()
    assert rows[0][0] == 1.0 and rows[1][0] < 1.0 and abs(rows[2][0] - 2 / 3) < 1e-9


def test_half_overlap_is_a_match(spark):
    rect = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])
    ask = lambda b: spark.range(1).select(geometry.covers_half(rect(0, 0, 10, 10), b)).first()[0]
    assert ask(rect(5, 0, 15, 10)) and not ask(rect(5.1, 0, 15.1, 10)) and not ask(rect(20, 0, 30, 10))


def test_plausible_languages(spark):
    ask = lambda code, family: spark.range(1).select(language.is_plausible(F.lit(code), F.lit(family).cast("string"))).first()[0]
    assert ask("en", None) and ask("ja", "cjk") and not ask("en", "cjk") and not ask("la", None)


def test_a_title_that_is_only_a_suffix_stays(spark):
    assert values(spark, tx.cleaned_title, ["Microsoft Word - .docx", "Report"]) == [".docx", None]
