"""python -m lucidoc INPUT -o OUT [--language-data PARQUET]: a file or folder of office documents in, artifacts out.

Exit code 1 if the input is missing or nothing could be processed; rejected files are listed on standard error.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import language_id, accessible
from .sinks import write_files
from .sources.docx import docx_documents, files
from .streaming.jobs import STAGES


def progress(stage: str, share: float) -> None:
    print(f"[{share * 100:5.1f}%] {stage}", file=sys.stderr)


def process(spark: SparkSession, source: str, target: str, language_data: str | None = None) -> int:
    """Number of documents written. The output folder is made only if there is one."""
    stages = dict(STAGES)
    progress("extracting", stages["extracting"])
    found = files(spark, source)
    docs = docx_documents(found).cache()
    pdf = F.lit("PDF layout extraction isn't installed")
    rejected = found.select("filename", F.when(F.col("suffix") == ".pdf", pdf).otherwise(F.col("error")).alias("error")).filter("error IS NOT NULL")
    for name, error in rejected.unionByName(docs.filter("status <> 'ok'").select("filename", "error")).toLocalIterator():
        print(f"{name}: {error}", file=sys.stderr)
    ok = docs.filter("status = 'ok'")
    n = ok.count()
    if not n:
        return 0
    progress("generating_html", stages["generating_html"])
    blocks = ok.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")
    images = ok.select("doc_id", F.explode("images").alias("i")).select("doc_id", "i.*")
    if language_data:
        texts = accessible.plain_texts(accessible.markup_blocks(blocks))
        detected = language_id.classify(texts, language_id.train(spark.read.parquet(language_data)))
    else:
        detected = spark.createDataFrame([], "doc_id long, code string, confidence double")
    result = accessible.from_markup(ok.select("doc_id", "filename", "meta_title", "meta_lang"), blocks, detected, images)
    progress("building_report", stages["building_report"])
    parts = [(result.html, "html", "html"), (result.report_json, "json", "report.json"), (result.report_html, "html", "report.html")]
    out = None
    for df, column, artifact in parts:
        part = df.select("doc_id", F.lit(artifact).alias("artifact"), F.col(column).alias("content"))
        out = part if out is None else out.unionByName(part)
    named = ok.select("doc_id", F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem"))
    write_files(out.join(named, "doc_id"), target)
    progress("done", stages["done"])
    return n


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lucidoc")
    parser.add_argument("input")
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("--language-data", help="Parquet of doc_id, text and lang to train language identification on")
    args = parser.parse_args(argv)
    if "://" not in args.input and not Path(args.input).exists():
        print(f"no such file: {args.input}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lucidoc").getOrCreate()
    n = process(spark, args.input, args.output, args.language_data)
    print(f"{n} documents written to {args.output}" if n else "nothing could be processed")
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
