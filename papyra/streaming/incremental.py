"""Files as they arrive: a stateless stream of micro-batches from folder to recognised pages, errors kept as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra.operators.inference import Recognizer, recognize


@dataclass(frozen=True)
class BatchOptions:
    """Files of a micro-batch, the most tasks that read at a time (none: as many as input splits), whether an error ends the query, whether files keep the order of their names."""

    window: int = 32
    degree: int | None = None
    continue_on_error: bool = True
    ordered: bool = False

    def __post_init__(self):
        if self.window < 1 or (self.degree is not None and self.degree < 1):
            raise ValueError("window and degree must be 1 or more")


def file_stream(spark: SparkSession, folder: str, pattern: str = "*", options: BatchOptions = BatchOptions()) -> DataFrame:
    """path, modificationTime, length, content of new files below a folder, so many in a micro-batch."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", options.window).load(folder)


def recognise_files(files: DataFrame, make: Callable[[], Recognizer], options: BatchOptions = BatchOptions()) -> DataFrame:
    """path, lines, error for files of a batch or a stream; a batch is sorted by path if `ordered`. Files stay where they were read: no bytes are shuffled."""
    slim = files.select("path", "content")
    if options.degree:
        slim = slim.coalesce(options.degree)
    out = recognize(slim, make, stop_at_error=not options.continue_on_error)
    if options.ordered and not files.isStreaming:
        out = out.orderBy("path")
    return out


def write_pages(pages: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends pages as Parquet; the checkpoint makes each file count once, also after a restart."""
    w = pages.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def progress(pages: DataFrame) -> DataFrame:
    """completed, failed and total of a batch."""
    failed = F.count_if(F.col("error").isNotNull())
    return pages.agg((F.count(F.lit(1)) - failed).alias("completed"), failed.alias("failed"), F.count(F.lit(1)).alias("total"))


def windowed_counts(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", time: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events per window and key with a watermark: an extension for event tables, batch or stream."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    g = events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Events per session and key: a session goes on while events are less than the gap apart; batch or stream."""
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n", "total")


def running_totals(events: DataFrame, key: str = "user_id", time: str = "ts", idle: str = "NoTimeout") -> DataFrame:
    """Keyed state over a stream: key, n, total, last after each micro-batch that has events of the key, over all events so far."""
    kind = dict(events.dtypes)[key]
    out = f"{key} {kind}, n long, total double, last timestamp"

    def fold(group, batches, state):
        n, total, last = state.get if state.exists else (0, 0.0, None)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
            newest = b[time].max().to_pydatetime()
            last = newest if last is None or newest > last else last
        state.update((n, total, last))
        yield pd.DataFrame({key: [group[0]], "n": [n], "total": [total], "last": [last]})

    slim = events.select(key, F.col(time).cast("timestamp").alias(time), F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull())
    return slim.groupBy(key).applyInPandasWithState(fold, out, "n long, total double, last timestamp", "update", idle)
