"""Workbooks that arrive in a folder: each is self-contained, so the stream needs neither state nor watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sheet import Options, sheet_markdown
from ..sources.workbook import from_files

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New ``.xlsx`` files of a folder as a stream."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.xlsx").option("maxFilesPerTrigger", files_per_batch).load(folder)


def convert_arriving(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, options: Options = Options(), once: bool = False) -> StreamingQuery:
    """Starts a query that gives the Markdown of each batch of new workbooks to ``sink(sheets, batch)``."""

    def batch(files: DataFrame, number: int) -> None:
        sink(sheet_markdown(from_files(files.sparkSession, files), options), number)

    writer = arriving(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
