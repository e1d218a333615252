"""Watching a tree of files: a change log, debounced per file, applied to the stored graph.

The change log is append-only (path, op, ts, content); ops are add, change and unlink. A burst is a run of changes of
one file with gaps of at most the debounce time; its last change counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE = "300 milliseconds"


def bursts(log: DataFrame, gap: str = DEBOUNCE, tie: str | None = None) -> DataFrame:
    """Batch form: the last row of each burst, with ``events``, the rows in it. Ties in ts go by column ``tie``."""
    order = ["ts", tie] if tie else ["ts"]
    w = Window.partitionBy("path").orderBy(*order)
    near = F.col("ts") <= F.lag("ts").over(w) + F.expr(f"INTERVAL {gap}")
    rows = log.withColumn("_new", F.when(near, 0).otherwise(1))
    rows = rows.withColumn("_burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fields = [c for c in log.columns if c != "path"]
    last = rows.groupBy("path", "_burst").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_row"), F.count("*").alias("events"))
    return last.select("path", "_row.*", "events")


def latest(log: DataFrame, tie: str | None = None) -> DataFrame:
    """The last row of each file."""
    order = F.struct(*(["ts", tie] if tie else ["ts"]))
    fields = [c for c in log.columns if c != "path"]
    return log.groupBy("path").agg(F.max_by(F.struct(*fields), order).alias("_row")).select("path", "_row.*")


def debounced(log: DataFrame, gap: str = DEBOUNCE, late: str = "0 seconds") -> DataFrame:
    """Streaming form: path, op, content, ts and events of each burst once the watermark has passed its end.

    Events later than ``late`` behind the newest are dropped; the state holds the bursts that are still open.
    """
    session = F.session_window("ts", gap)
    best = F.max_by(F.struct("op", "content", "ts"), "ts").alias("_row")
    out = log.withWatermark("ts", late).groupBy(session, "path").agg(best, F.count("*").alias("events"))
    return out.select("path", "_row.op", "_row.content", "_row.ts", "events")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint: it stays the same over restarts, and a new checkpoint has another."""
    where = f"{checkpoint.rstrip('/')}/metadata"
    return json.loads("".join(r[0] for r in spark.read.text(where).collect()))["id"]


def run(log: DataFrame, apply: Callable[[DataFrame, tuple[str, int]], None], checkpoint: str, once: bool = True, gap: str = DEBOUNCE) -> StreamingQuery:
    """Hand each micro-batch's last state per file of a streaming change log to ``apply(changes, (stream, batch number))``.

    ``once`` processes what there is and stops, as a commit hook would; otherwise a batch is made every ``gap``, so the
    changes of a burst within it are one. Nothing waits for a later event and nothing is dropped for being late:
    applying decides by ts, and must be idempotent in the batch, as ``sync.Index.apply_changes`` is.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        apply(latest(batch), (stream_id(batch.sparkSession, checkpoint), batch_id))

    writer = log.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=gap)).start()
