"""Jobs: uploads as a file stream, states as an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: The largest upload, stages with their share done, and states.
MAX_BYTES = 500 * 1024 * 1024
STAGES = [("extracting", 0.0), ("generating_html", 0.35), ("rendering_pdf", 0.6), ("building_report", 0.9), ("done", 1.0)]
STATES = ("queued", "processing", "done", "error")
UPLOAD = "path string, modificationTime timestamp, length long, content binary"
EXTRACTION_SHARE = 0.35


def uploads(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of files, `per_trigger` at a time: one is a queue with a single worker. Spark's file source passes empty files over."""
    return spark.readStream.schema(UPLOAD).format("binaryFile").option("maxFilesPerTrigger", per_trigger).load(folder)


def admitted(files: DataFrame) -> DataFrame:
    """Uploads with a job id, and the error of those that are empty, too large or of another format."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    error = verdict(F.col("length"), suffix)
    return files.select(
        F.xxhash64("path").alias("doc_id"),
        F.regexp_extract("path", r"([^/\\]*)$", 1).alias("filename"),
        suffix.alias("suffix"),
        "length",
        F.col("modificationTime").alias("created_at"),
        F.when(error.isNull(), F.col("content")).alias("content"),
        error.alias("error"),
        F.when(error.isNull(), "queued").otherwise("error").alias("state"),
    )


def verdict(length: Column, suffix: Column) -> Column:
    return (
        F.when(~suffix.isin(".docx", ".pdf"), F.concat(F.lit("Unsupported file type '"), suffix, F.lit("'; supported: .docx, .pdf")))
        .when(length == 0, "The upload is empty.")
        .when(length > MAX_BYTES, "The upload is too large.")
    )


def latest(log: DataFrame) -> DataFrame:
    """Each job's last row of the log (job_id, at, state, stage, pct, ...)."""
    rest = [c for c in log.columns if c not in ("job_id", "at")]
    return log.groupBy("job_id").agg(F.max(F.struct("at", *rest)).alias("x")).select("job_id", "x.*")


def stage_changes(log: DataFrame) -> DataFrame:
    """Log rows whose stage isn't that of the job's row before: what is worth storing."""
    order = Window.partitionBy("job_id").orderBy("at", "event_id")
    return log.withColumn("was", F.lag("stage").over(order)).filter(F.col("was").isNull() | (F.col("was") != F.col("stage")))


def rescaled(page: Column, page_count: Column) -> Column:
    """Share of the whole job done after a page: extraction is its first part."""
    return EXTRACTION_SHARE * page / page_count


def status(jobs: DataFrame) -> DataFrame:
    """job_id and its status as JSON; summary and downloads appear when it is done."""
    done = F.col("state") == "done"
    fields = [c for c in ("job_id", "state", "stage", "pct", "original_filename", "created_at", "error") if c in jobs.columns]
    extra = [F.when(done, F.col(c)).alias(c) for c in ("summary", "downloads") if c in jobs.columns]
    return jobs.select("job_id", F.to_json(F.struct(*fields, *extra)).alias("status"))


def run(stream: DataFrame, process, folder: str, checkpoint: str) -> StreamingQuery:
    """Process each micro-batch of admitted uploads with `process(batch)` -> results, appended with their log; a restart goes on from the checkpoint.

    The log has a row for each state a job enters: queued since the upload, processing, then done; or error alone. A batch that is
    run again repeats rows, and `latest` tells where each job stands.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        def log(jobs: DataFrame, at: Column, state: Column) -> DataFrame:
            return jobs.select(F.col("doc_id").alias("job_id"), at.alias("at"), state.alias("state"), F.col("filename").alias("original_filename"), "error")

        begun = F.explode(F.array(F.struct(F.col("created_at").alias("at"), F.lit("queued").alias("state")), F.struct(F.current_timestamp().alias("at"), F.lit("processing").alias("state"))))
        started = batch.filter("error IS NULL").drop("state", "content").withColumn("begun", begun)
        log(started, F.col("begun.at"), F.col("begun.state")).write.mode("append").parquet(f"{folder}/jobs")
        results = process(batch)
        results.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{folder}/results")
        ended = F.when(F.col("error").isNull(), "done").otherwise("error")
        log(batch, F.current_timestamp(), ended).write.mode("append").parquet(f"{folder}/jobs")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Job records stored as JSON; a malformed one is dropped."""
    schema = "job_id string, state string, stage string, pct double, original_filename string, created_at string, error string, summary map<string,int>, bad string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path).filter("bad IS NULL").drop("bad")


class Progress(StreamingQueryListener):
    """Prints a line for each micro-batch, as a command line shows a stage and its percentage."""

    def __init__(self, out=None):
        import sys

        self.out = out or sys.stderr

    def line(self, stage: str, share: float) -> str:
        return f"[{share * 100:5.1f}%] {stage}"

    def onQueryStarted(self, event) -> None:
        print(self.line(STAGES[0][0], 0.0), file=self.out)

    def onQueryProgress(self, event) -> None:
        print(f"batch {event.progress.batchId}: {event.progress.numInputRows} files", file=self.out)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        print(self.line(STAGES[-1][0], 1.0), file=self.out)
