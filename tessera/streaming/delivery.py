"""Delivery of micro-batches to one or more sinks, with a delivery log."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Writer = Callable[[DataFrame, int], None]


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """Delivery log rows (sink, batch_id, n, error)."""
    return spark.read.schema("sink string, batch_id bigint, n bigint, error string").parquet(
        f"{log}/*"
    )


def _delivered(spark: SparkSession, log: str, batch_id: int) -> set[str]:
    try:
        rows = spark.read.parquet(f"{log}/batch_{batch_id}").where("error is null")
        # At most one row per sink and attempt.
        return {r["sink"] for r in rows.select("sink").distinct().collect()}
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()  # nothing was delivered yet


def _note(spark: SparkSession, log: str, sink: str, batch_id: int, n: int, error: str | None) -> None:
    row = spark.createDataFrame(
        [(sink, batch_id, n, error)], "sink string, batch_id bigint, n bigint, error string"
    )
    row.coalesce(1).write.mode("append").parquet(f"{log}/batch_{batch_id}")


def fan_out(
    writers: Mapping[str, Writer], log: str, strict: bool = True, dead_letters: str | None = None
) -> Writer:
    """A ``foreachBatch`` function that gives one batch to every writer.

    Each writer gets the batch whatever happened to the others; errors come
    together at the end.  ``strict`` then fails the query, so the batch is tried
    again, and sinks that already took it are passed over.  Otherwise the failed
    batch goes to ``dead_letters`` and the stream goes on.
    """
    if not strict and not dead_letters:
        raise ValueError("containing failures needs a dead_letters folder")

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _delivered(spark, log, batch_id)
        batch.persist()
        failures: list[str] = []
        try:
            n = batch.count()
            for name, write in writers.items():
                if name in done:
                    continue
                try:
                    write(batch, batch_id)
                    _note(spark, log, name, batch_id, n, None)
                except Exception as exc:  # noqa: BLE001 - any sink error is contained here
                    text = f"{type(exc).__name__}: {exc}"
                    failures.append(f"{name}: {text}")
                    _note(spark, log, name, batch_id, n, text)
                    if not strict:
                        batch.withColumn("error", F.lit(text)).write.mode("overwrite").parquet(
                            f"{dead_letters}/sink={name}/batch_id={batch_id}"
                        )
        finally:
            batch.unpersist()
        if failures and strict:
            raise RuntimeError("; ".join(failures))

    return deliver


def contained(write: Writer, name: str, log: str, dead_letters: str) -> Writer:
    """A single sink whose failures do not stop the stream."""
    return fan_out({name: write}, log, strict=False, dead_letters=dead_letters)


class DeliveryListener(StreamingQueryListener):
    """Sums the observed ``delivery`` metrics of running queries."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("delivery")
        if row is not None:
            with self._lock:
                name = event.progress.name or str(event.progress.id)
                self.counts[name] = self.counts.get(name, 0) + row["events"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(events: DataFrame) -> DataFrame:
    return events.observe("delivery", F.count(F.lit(1)).alias("events"))
