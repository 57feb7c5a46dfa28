"""Text recognition of scanned files by an outside program, one file a time within a task."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

#: Seconds for a page and for a file.
PAGE_TIMEOUT, TOTAL_TIMEOUT = 180, 900


def options(page_timeout: int = PAGE_TIMEOUT) -> list[str]:
    """English; pages with text stay as they are; pages are turned upright; nothing is recompressed."""
    return ["-l", "eng", "--skip-text", "--rotate-pages", "--optimize", "0", "--tesseract-timeout", str(page_timeout)]


def recognised_files(found: DataFrame, command: tuple[str, ...] = ("ocrmypdf",), page_timeout: int = PAGE_TIMEOUT, total_timeout: int = TOTAL_TIMEOUT) -> DataFrame:
    """doc_id, content of the rewritten file, and error where the program failed or ran out of time (then content is null).

    A call that is out of time is stopped. Files are local to the task only while it works on one.
    """
    ship(found.sparkSession)

    def one(content: bytes) -> tuple[bytes | None, str | None]:
        with tempfile.TemporaryDirectory() as folder:
            source, target = Path(folder, "in.pdf"), Path(folder, "out.pdf")
            source.write_bytes(content)
            try:
                done = subprocess.run([*command, *options(page_timeout), str(source), str(target)], capture_output=True, timeout=total_timeout, check=False)
            except subprocess.TimeoutExpired:
                return None, f"text recognition took longer than {total_timeout} s"
            except OSError as e:
                return None, f"text recognition can't run: {e}"
            if done.returncode or not target.exists():
                return None, f"text recognition failed: {done.stderr.decode(errors='replace')[-200:].strip()}"
            return target.read_bytes(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *one(bytes(c or b""))) for d, c in zip(batch["doc_id"], batch["content"])]
            yield pd.DataFrame(rows, columns=["doc_id", "content", "error"])

    return found.select("doc_id", "content").mapInPandas(run, "doc_id long, content binary, error string")
