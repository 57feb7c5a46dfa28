"""Where results go: a file for each document and artifact, or tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import sanitised_stem
from .sources.layout import pdf_renderer_available

#: Artifact, suffix and media type.
ARTIFACTS = [
    ("pdf", ".pdf", "application/pdf"),
    ("html", ".html", "text/html"),
    ("report.html", ".report.html", "text/html"),
    ("report.json", ".report.json", "application/json"),
]


def write_tables(html: DataFrame, json: DataFrame, report_html: DataFrame, folder: str) -> None:
    """Artifacts as Parquet tables of a row for each document."""
    html.write.mode("overwrite").parquet(f"{folder}/html")
    json.write.mode("overwrite").parquet(f"{folder}/report_json")
    report_html.write.mode("overwrite").parquet(f"{folder}/report_html")


def write_files(artifacts: DataFrame, folder: str) -> None:
    """Artifacts (stem, artifact, content) as files of their own: one partition for each artifact and a directory for each stem, in any store Spark writes to."""
    artifacts.select("stem", "artifact", F.col("content").alias("value")).write.mode("overwrite").partitionBy("artifact", "stem").option("lineSep", "\n").text(folder)


def artifact_table(spark) -> DataFrame:
    return spark.createDataFrame(ARTIFACTS, "artifact string, suffix string, media_type string")


def downloads(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """For requests (job_id, artifact): file name and media type, or the error; only listed artifacts of finished jobs are served."""
    table = F.broadcast(artifact_table(jobs.sparkSession))  # four rows
    out = requests.join(table, "artifact", "left").join(jobs, "job_id", "left")
    error = F.when(F.col("state").isNull(), "unknown job").when(F.col("suffix").isNull(), "unknown artifact").when(F.col("state") != "done", "not ready")
    name = F.concat(sanitised_stem(F.col("original_filename")), F.col("suffix"))
    return out.select("job_id", "artifact", F.when(error.isNull(), name).alias("filename"), F.when(error.isNull(), F.col("media_type")).alias("media_type"), error.alias("error"))


def render_pdf(html: DataFrame) -> DataFrame:
    """doc_id and the tagged PDF of each page; needs the renderer on the executors."""
    if not pdf_renderer_available():
        raise RuntimeError("the PDF renderer isn't installed")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from weasyprint import HTML

        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "pdf": [HTML(string=h).write_pdf(pdf_variant="pdf/ua-1") for h in batch["html"]]})

    return html.select("doc_id", "html").mapInPandas(render, "doc_id long, pdf binary")
