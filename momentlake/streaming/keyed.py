"""Streams with mergeable state: the best row of each key so far, sliding windows with their late rows, metrics of every batch.

What a batch does grows with the batch (and the windows that are open), not with what came before: per key, Spark's
state store holds the best row only, and sinks append under the batch's number, so that a batch that runs twice
changes nothing.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def best_rows(rows: DataFrame, key: str, rank: list[str]) -> DataFrame:
    """The least row of each key by rank, then by its other columns; of a stream, those that change with each batch."""
    others = [c for c in rows.columns if c not in (key, *rank)]
    best = F.min(F.struct(*rank, *others)).alias("b")
    return rows.groupBy(key).agg(best).select(key, *(F.col(f"b.{c}").alias(c) for c in (*rank, *others))).select(*rows.columns)


def keep_best(stream: DataFrame, path: str, checkpoint: str, key: str, rank: list[str]) -> StreamingQuery:
    """Appends to path, under each batch's number, the keys whose best row the batch has changed, with that row.

    State is one row a key, in the session's state store (RocksDB where keys do not fit into executors' memory). The
    least row of a key is the same however the stream is cut into files and batches: stored_best() reads it.
    """

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = best_rows(stream, key, rank).writeStream.outputMode("update").foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_best(spark: SparkSession, path: str, schema: str, key: str, rank: list[str]) -> DataFrame:
    """What keep_best() has stored: the best row of each key."""
    return best_rows(spark.read.schema(schema).option("basePath", path).parquet(path).drop("batch"), key, rank)


_WINDOW = "window_start timestamp, window_end timestamp, event_type string, n long, total double"


class WindowStore:
    """Sliding windows of a stream of events (ts, event_type, value) under a watermark, and the rows that came too late.

    The watermark of a batch is the latest ts of the batches before it, less delay. An event is late for a window whose
    end the watermark has reached: it goes to the dead letters, with the window; other events are added to the open
    windows. After a batch, windows whose end its watermark has reached are closed, once and for all. A batch
    reads the windows that are open, not the closed ones. Windows, letters and open windows are folders by batch.
    """

    def __init__(self, spark: SparkSession, path: str, length: str = "30 seconds", step: str = "25 seconds", delay_ms: int = 60_000) -> None:
        self.spark, self.path, self.length, self.step, self.delay_ms = spark, path.rstrip("/"), length, step, delay_ms

    def _read(self, name: str, schema: str, batch: int | None = None) -> DataFrame:
        where = f"{self.path}/{name}" + ("" if batch is None else f"/batch={batch}")
        try:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(where)
            return rows if "batch" in schema else rows.drop("batch")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def closed(self) -> DataFrame:
        """window_start, window_end, event_type, n, total."""
        return self._read("closed", _WINDOW)

    def late(self) -> DataFrame:
        """window_start, window_end, ts, event_type, value: a row for each late event and window."""
        return self._read("late", "window_start timestamp, window_end timestamp, ts timestamp, event_type string, value double")

    def open(self, batch: int) -> DataFrame:
        return self._read("open", _WINDOW, batch)

    def _latest(self, before: int) -> int | None:
        """The latest ts, in ms, of the batches before one."""
        marks = self._read("marks", "batch long, latest long")
        return marks.filter(F.col("batch") < before).agg(F.max("latest")).first()[0]

    def add(self, batch: DataFrame, number: int) -> None:
        before = self._latest(number)
        latest = batch.agg(F.unix_millis(F.max("ts"))).first()[0]
        now = max((x for x in (before, latest) if x is not None), default=None)
        end = F.unix_millis("window_end")
        is_late = F.lit(False) if before is None else end <= before - self.delay_ms
        over = F.lit(False) if now is None else end <= now - self.delay_ms
        each = batch.filter("ts is not null").select(F.window("ts", self.length, self.step).alias("w"), "ts", "event_type", F.col("value").cast("double").alias("value"))
        each = each.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ts", "event_type", "value").withColumn("late", is_late)
        self._write("late", number, each.filter("late").drop("late"))
        keys = ["window_start", "window_end", "event_type"]
        fresh = each.filter("not late").groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
        both = self.open(number - 1).unionByName(fresh).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        state = both.withColumn("over", over)
        self._write("state", number, state)
        state = self._read("state", _WINDOW + ", over boolean", number)
        self._write("closed", number, state.filter("over").drop("over"))
        self._write("open", number, state.filter("not over").drop("over"))
        self._write("marks", number, self.spark.createDataFrame([(number, now)], "batch long, latest long").coalesce(1))

    def _write(self, name: str, number: int, rows: DataFrame) -> None:
        rows.drop("batch").write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")


def window_counts(events: DataFrame, store: WindowStore, checkpoint: str) -> StreamingQuery:
    """Adds a stream of events to the store's windows until all there is has been read."""
    return events.writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


METRIC = "query string, run string, batch long, rows long, millis long, late long"


class MetricsTable(StreamingQueryListener):
    """Appends the metrics of every batch of the session's streams to a table, some at a time.

    with MetricsTable(spark, path) as metrics: ...; metrics.of(query)
    """

    def __init__(self, spark: SparkSession, path: str, at_once: int = 50) -> None:
        self.spark, self.path, self.at_once = spark, path, at_once
        self.rows: list[tuple] = []
        self.ended: set[str] = set()
        self.lock = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = json.loads(event.progress.json)
        late = sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", []))
        with self.lock:
            self.rows.append((p["id"], p["runId"], p["batchId"], p["numInputRows"], p.get("batchDuration", 0), late))
            if len(self.rows) >= self.at_once:
                self._write()

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        with self.lock:
            self._write()
            self.ended.add(str(event.runId))
            self.lock.notify_all()

    def _write(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, METRIC).coalesce(1).write.mode("append").json(self.path)

    def of(self, query: StreamingQuery, seconds: float = 60) -> DataFrame:
        """query, run, batch, rows, millis, late: all batches of a query that has ended, over all its runs that were listened to."""
        with self.lock:
            if not self.lock.wait_for(lambda: str(query.runId) in self.ended, seconds):
                raise TimeoutError("the end of the query was not heard of")
        return self.spark.read.schema(METRIC).json(self.path).filter(F.col("query") == str(query.id))

    def __enter__(self) -> MetricsTable:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)
