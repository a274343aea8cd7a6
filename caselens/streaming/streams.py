"""Structured Streaming forms: ingest, dedupe, sessions, counters, alerts, file status.

All take a streaming DataFrame and return one; event time is TIMESTAMP in UTC.
Rows behind the watermark are dropped by the stateful operators and show up in
``numRowsDroppedByWatermark``; ``route_late`` keeps them, and ``repair_sessions``
and ``repair_counts`` bring results up to date with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from caselens.functions.when import micros
from caselens.operators.filters import anomalous
from caselens.session import materialize, scratch_path

WATERMARK = "1 hour"
TERMINAL = ["parsed", "failed"]


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """New files under a folder, each read exactly once."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def event_time(df: DataFrame, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def ingest(files: DataFrame, normalise: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Normalise each micro-batch with the batch functions and write it.

    A micro-batch owns its folder and overwrites it when it is retried, so a
    restart neither loses nor doubles a file.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        normalise(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _with_batch(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("batch", LongType())])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(df: DataFrame) -> DataFrame:
    """The stream, in a session whose state lies in RocksDB: state of processors must, and it may outgrow the memory."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


class FirstOfContent(StatefulProcessor):
    """Gives the first row of each key that it has never seen; of the rows of one micro-batch the least by the given columns."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, best = self.seen.exists(), None
        for pdf in rows:
            if not known and len(pdf):
                part = pdf if best is None else pd.concat([best, pdf])
                best = part.sort_values(self.order, kind="stable").head(1)
        if best is not None:
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


def dedupe(files: DataFrame, store: str, checkpoint: str, ts: str = "created_at") -> StreamingQuery:
    """Write the files whose content their case does not hold yet, under ``store``; a content once held is never taken again.

    What a case holds is keyed state of the query, so a micro-batch reads
    nothing of what earlier ones wrote. Of equal files in one micro-batch the
    earliest is kept. A micro-batch overwrites its own folder when retried.
    """
    key = ["case_id", "sha256"]
    order = [ts, *[c for c in files.columns if c not in (*key, ts)]]

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # copies that lie together do not travel
            yield pdf.sort_values(order, kind="stable").drop_duplicates(key)

    some = keyed(files).mapInPandas(least, files.schema)
    first = some.groupBy(*key).transformWithStateInPandas(FirstOfContent(order), files.schema, "append", "none")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return first.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Live sessions per case; one is emitted when the watermark has passed it.

    Rows of a case are merged to sessions in each task before they meet.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    out = event_time(events).groupBy("case_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("event_count"), F.max("ts").alias("end_ts"))
    return out.select("case_id", F.col("w.start").alias("start_ts"), "end_ts", "event_count")


def counters(events: DataFrame) -> DataFrame:
    """Live totals per case and evidence file."""
    return events.groupBy("case_id", "evidence_id").agg(
        F.count("*").alias("total"), F.count_if(anomalous(F.col("is_anomaly"), F.col("anomaly_score"))).alias("anomalies"),
        F.count_if(F.lower("severity").isin("critical", "high")).alias("critical"))


def brute_force(failures: DataFrame, threshold: int = 10, length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Windows in which one ip fails ``threshold`` times or more."""
    out = event_time(failures).groupBy("ip", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("failures"))
    return out.filter(F.col("failures") >= threshold).select(
        "ip", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "failures")


# ---- evidence status -----------------------------------------------------------

def latest_status(changes: DataFrame) -> DataFrame:
    """Batch form: state of each file after all its (evidence_id, status, at_us) changes.

    ``parsing`` starts a run and clears its end; parsed or failed end it.
    """
    start = F.max(F.when(F.col("status") == "parsing", F.col("at_us")))
    end = F.max(F.when(F.col("status").isin(TERMINAL), F.col("at_us")))
    out = changes.groupBy("evidence_id").agg(
        F.max(F.struct("at_us", "status"))["status"].alias("status"), start.alias("started_us"), end.alias("_end"))
    done = F.when(F.col("started_us").isNull() | (F.col("_end") >= F.col("started_us")), F.col("_end"))
    return out.withColumn("finished_us", done).select("evidence_id", "status", "started_us", "finished_us", _scan_ms().alias("scan_ms"))


def _scan_ms() -> Column:
    return F.floor((F.col("finished_us") - F.col("started_us")) / 1000).cast("bigint")


class FileStatus(StatefulProcessor):
    """Latest change, start and end of a file by their own times; a timer tells of files that do not end."""

    def __init__(self, stalled_ms: int):
        self.stalled_ms = stalled_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "at_us bigint, status string, started_us bigint, ended_us bigint")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def _row(self, key, known: tuple, status: str | None = None) -> pd.DataFrame:
        at, last, started, ended = known
        done = ended if started < 0 or ended >= started else -1
        return pd.DataFrame({"evidence_id": [key[0]], "status": [status or last], "started_us": [started], "finished_us": [done], "at_us": [at]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, status, started, ended = self.known.get() if self.known.exists() else (-1, "", -1, -1)
        for pdf in rows:
            seen = list(zip(pdf["at_us"].tolist(), pdf["status"].tolist()))
            at, status = max([(at, status), *seen])
            started = max([started, *(t for t, s in seen if s == "parsing")])
            ended = max([ended, *(t for t, s in seen if s in TERMINAL)])
        known = (at, status, started, ended)
        self.known.update(known)
        self._watch(started >= 0 and ended < started, timerValues)
        yield self._row(key, known)

    def _watch(self, runs: bool, timerValues) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if runs:
            at = timerValues.getCurrentProcessingTimeInMs() + self.stalled_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        if self.known.exists():
            yield self._row(key, self.known.get(), STALLED)

    def close(self) -> None:
        pass


STALLED = "stalled"


def status_stream(changes: DataFrame, stalled_after_ms: int | None = None) -> DataFrame:
    """Stream form: the state of each file that changed in a micro-batch.

    The state is the latest change, start and end by their own times, so late and
    repeated changes leave it as the batch form would have it: three maxima, held
    as the keyed state of an aggregate, so no file costs a call of Python. With
    ``stalled_after_ms`` a file that began and did not end within that time of
    its last change is told once more, with the status ``stalled``; such a query
    needs timers and a trigger by time, as it never runs out of micro-batches.
    """
    if stalled_after_ms is None:
        at = F.col("at_us")
        out = keyed(changes).groupBy("evidence_id").agg(
            F.max(F.struct("at_us", "status")).alias("_last"), F.max(F.when(F.col("status") == "parsing", at)).alias("started_us"),
            F.max(F.when(F.col("status").isin(TERMINAL), at)).alias("_end"))
        done = F.when(F.col("started_us").isNull() | (F.col("_end") >= F.col("started_us")), F.col("_end"))
        out = out.select("evidence_id", "_last.status", "started_us", done.alias("finished_us"), "_last.at_us")
    else:
        out = keyed(changes).groupBy("evidence_id").transformWithStateInPandas(
            FileStatus(stalled_after_ms), "evidence_id string, status string, started_us bigint, finished_us bigint, at_us bigint", "update", "processingTime")
        for c in ("started_us", "finished_us"):
            out = out.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
    return out.withColumn("scan_ms", _scan_ms())


# ---- late rows --------------------------------------------------------------------

def route_late(events: DataFrame, out: str, checkpoint: str, ts: str = "ts", delay: str = WATERMARK) -> StreamingQuery:
    """Write rows in time under ``out``/accepted and rows behind the watermark under ``out``/late; none is dropped.

    The watermark of a micro-batch is the latest time of all earlier ones less
    ``delay``; each keeps its latest time under ``out``/marks. Retried batches
    overwrite what they wrote.
    """
    spark = events.sparkSession
    schema = StructType([StructField("mark", events.schema[ts].dataType), StructField("batch", LongType())])
    spark.createDataFrame([], StructType(schema.fields[:1])).write.mode("append").parquet(f"{out}/marks/batch=-1")

    def write(rows: DataFrame, batch_id: int) -> None:
        s = rows.sparkSession
        mark = s.read.schema(schema).parquet(f"{out}/marks").filter(F.col("batch") < batch_id).agg(F.max("mark")).first()[0]
        late = F.lit(False) if mark is None else F.coalesce(F.col(ts) < F.lit(mark) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        rows = rows.persist()
        try:
            for name, part in (("late", rows.filter(late)), ("accepted", rows.filter(~late))):
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
            rows.agg(F.max(ts).alias("mark")).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _islands(spans: DataFrame, by: list[str], gap_us: int) -> DataFrame:
    """Spans (start_us, end_us, event_count) of a key merged where no more than the gap lies between them."""
    w = Window.partitionBy(*by).orderBy("start_us", "end_us")
    ahead = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(ahead.isNull() | (F.col("start_us") - ahead > gap_us), 1).otherwise(0)
    numbered = spans.withColumn("_new", new).withColumn("_no", F.sum("_new").over(w))
    return numbered.groupBy(*by, "_no").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("event_count").alias("event_count")).drop("_no")


def repair_sessions(stored: DataFrame, late: DataFrame, by: str = "case_id", ts: str = "ts", gap_minutes: int = 15) -> DataFrame:
    """The sessions (by, start_ts, end_ts, event_count) once late rows have come: only those that they touch are made anew.

    Late rows are first merged among themselves. A stored session within the gap
    of such a span is touched; touched ones and spans are merged again, all
    others stay as they are. No stored event is read: a session holds no gap, so
    its ends and its count say all. The result is that of all rows at once.
    """
    gap = gap_minutes * 60 * 1_000_000
    # rows are counted in bins of the gap first, so a hot case is no larger than its time span
    bins = late.filter(F.col(ts).isNotNull()).groupBy(by, F.floor(micros(F.col(ts)) / gap).alias("_bin")).agg(
        F.min(micros(F.col(ts))).alias("start_us"), F.max(micros(F.col(ts))).alias("end_us"), F.count("*").alias("event_count")).drop("_bin")
    spans = materialize(_islands(bins, [by], gap), "late-spans")
    held = stored.select(by, micros(F.col("start_ts")).alias("start_us"), micros(F.col("end_ts")).alias("end_us"), "event_count")
    day = 86_400_000_000  # spans and sessions meet by the days that they reach
    days = lambda a, b: F.explode(F.sequence(F.floor(a / day), F.floor(b / day)))
    near = spans.select(by, F.col("start_us").alias("lo"), F.col("end_us").alias("hi"), days(F.col("start_us") - gap, F.col("end_us") + gap).alias("_day"))
    met = held.withColumn("_day", days(F.col("start_us"), F.col("end_us"))).join(near, [by, "_day"]).filter(
        (F.col("start_us") <= F.col("hi") + gap) & (F.col("end_us") >= F.col("lo") - gap))
    touched = materialize(met.select(by, "start_us", "end_us", "event_count").distinct(), "touched")
    rest = held.join(touched.select(by, "start_us"), [by, "start_us"], "left_anti").select(by, "start_us", "end_us", "event_count")
    # a merged session can only reach what touches one of its spans: touched ones are all that is needed
    merged = _islands(spans.unionByName(touched), [by], gap)
    kind = stored.schema["start_ts"].dataType
    back = lambda c: F.timestamp_micros(c).cast(kind)
    return rest.unionByName(merged).select(by, back(F.col("start_us")).alias("start_ts"), back(F.col("end_us")).alias("end_ts"), "event_count")


def repair_counts(stored: DataFrame, late: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Stored counts by window and key with those of late rows added: touched windows are merged, the others stay."""
    some = materialize(late, "late-counts")
    touched = stored.join(some.select(*keys), keys, "left_semi").select(*keys, *counts)
    merged = touched.unionByName(some.select(*keys, *counts)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    return stored.join(some.select(*keys), keys, "left_anti").select(*keys, *counts).unionByName(merged)


def window_counts(failures: DataFrame, length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Batch form of the counts under ``brute_force``: (ip, start_ts, failures) of every window with a row."""
    out = failures.groupBy("ip", F.window(F.col("ts").cast("timestamp"), length, slide).alias("w")).agg(F.count("*").alias("failures"))
    return out.select("ip", F.col("w.start").alias("start_ts"), "failures")


def run_once(df: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over what is there now and return what it wrote, with the number of the micro-batch.

    In complete mode only the last micro-batch counts.
    """
    spark = df.sparkSession
    out, check = scratch_path(spark, name), scratch_path(spark, name + "-check")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch_id}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema if mode == "complete" else _with_batch(df)).parquet(out)
