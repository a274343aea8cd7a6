"""State over micro-batches with restarts, timers, and late rows."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caselens.operators import ordered as od
from caselens.streaming import streams as ss

T0 = dt.datetime(2024, 1, 1)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # files are taken in the order of their times


def test_dedupe_over_restarts_reads_nothing_held(spark, tmp_path):
    schema = "case_id string, sha256 string, created_at timestamp_ntz, name string"
    src, store, check = (str(tmp_path / x) for x in ("in", "held", "check"))
    day = lambda n: T0 + dt.timedelta(days=n)
    parts = [[("A", "x", day(9), "n1"), ("A", "y", day(9), "n2"), ("A", "y", day(8), "n3")], [("A", "x", day(1), "n4"), ("B", "x", day(1), "n5")], [("A", "y", day(0), "n6"), ("A", "z", day(0), "n7"), ("A", "z", day(0), "n7")]]
    want = {("A", "x", "n1"), ("A", "y", "n3"), ("B", "x", "n5"), ("A", "z", "n7")}
    from pyspark.sql.types import StructType
    for i, rows in enumerate(parts):
        put(spark, src, rows, schema)
        ss.dedupe(ss.file_stream(spark, src, StructType.fromDDL(schema), per_trigger=1), store, check).awaitTermination()  # a new query: state comes from the checkpoint
        if i == 0:  # what was written is gone: the state alone knows it
            kept = spark.read.parquet(store).drop("batch").collect()
            import shutil
            shutil.rmtree(store)
    got = {(r.case_id, r.sha256, r.name) for r in kept + spark.read.parquet(store).drop("batch").collect()}
    assert got == want


def test_stalled_files_are_told(spark, tmp_path):
    from pyspark.sql.types import StructType
    schema = "evidence_id string, status string, at_us long"
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    out = []

    def until(told):
        df = ss.status_stream(ss.file_stream(spark, src, StructType.fromDDL(schema), per_trigger=1), stalled_after_ms=500)
        q = df.writeStream.outputMode("update").foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", check).trigger(processingTime="300 milliseconds").start()
        end = time.monotonic() + 40
        while time.monotonic() < end and q.exception() is None and told not in [(r.evidence_id, r.status) for r in out]:
            time.sleep(0.2)
        q.stop()
        assert told in [(r.evidence_id, r.status) for r in out]

    put(spark, src, [("hangs", "parsing", 100), ("ends", "parsing", 100), ("ends", "parsed", 200)], schema)
    until(("hangs", "stalled"))
    assert ("ends", "stalled") not in [(r.evidence_id, r.status) for r in out]
    put(spark, src, [("hangs", "failed", 400)], schema)
    until(("hangs", "failed"))
    last = [r for r in out if r.evidence_id == "hangs"][-1]
    assert (last.started_us, last.finished_us) == (100, 400)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repaired_sessions_are_those_of_all_rows(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "a", "b"]), T0 + dt.timedelta(minutes=r.choice([1, 15, 16]) * r.randrange(200), seconds=r.randrange(3))) for _ in range(250)]
    df = spark.createDataFrame(rows, "case_id string, ts timestamp_ntz").withColumn("_r", F.monotonically_increasing_id())
    late = [df.filter(F.col("_r") % 7 == k) for k in (1, 4, 5)] + [df.filter("_r < 0")]
    now = od.sessions(df.filter(~(F.col("_r") % 7).isin(1, 4, 5)), ["case_id"]).select("case_id", "start_ts", "end_ts", "event_count")
    for part in late:
        now = ss.materialize(ss.repair_sessions(now, part), "now")
    key = lambda d: sorted((x.case_id, x.start_ts, x.end_ts, x.event_count) for x in d.collect())
    assert key(now) == key(od.sessions(df, ["case_id"]))


def test_late_rows_are_parted_and_none_is_lost(spark, tmp_path):
    from pyspark.sql.types import StructType
    schema = "case_id string, ts timestamp_ntz"
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    h = lambda n: T0 + dt.timedelta(hours=n)
    for rows in ([("a", h(5)), ("a", h(1))], [("a", h(4.5)), ("a", h(3.9)), ("a", None)], [("a", h(9))], [("a", h(4.5)), ("b", h(8.5))]):
        put(spark, src, rows, schema)
        ss.route_late(ss.file_stream(spark, src, StructType.fromDDL(schema), per_trigger=1), out, check).awaitTermination()
    got = {n: sorted((r.ts or T0).hour * 60 + (r.ts or T0).minute for r in spark.read.parquet(f"{out}/{n}").collect()) for n in ("accepted", "late")}
    assert got == {"accepted": [0, 60, 270, 300, 510, 540], "late": [234, 270]}


def test_repaired_counts(spark):
    stored = spark.createDataFrame([("x", 1, 5), ("y", 1, 2)], "ip string, w int, failures long")
    late = spark.createDataFrame([("x", 1, 1), ("z", 2, 4)], "ip string, w int, failures long")
    assert {tuple(r) for r in ss.repair_counts(stored, late, ["ip", "w"], ["failures"]).collect()} == {("x", 1, 6), ("y", 1, 2), ("z", 2, 4)}


def test_status_needs_no_python_call_per_file(spark, tmp_path):
    """Without timers the state of a file is an aggregate; it equals the batch form over several micro-batches, nulls and times before 1970 included."""
    schema = "evidence_id string, status string, at_us long"
    names = ["queued", "parsing", "parsed", "failed"]
    changes = spark.range(2000).select(
        F.when(F.col("id") % 97 > 0, F.concat(F.lit("f"), F.col("id") % 300)).alias("evidence_id"),
        F.when(F.col("id") % 89 > 0, F.get(F.array(*map(F.lit, names)), (F.xxhash64("id") % 4 + 4).cast("int") % 4)).alias("status"),
        F.when(F.col("id") % 83 > 0, F.xxhash64("id", F.lit(1)) % 1000).alias("at_us")).repartition(3)
    changes.write.parquet(str(tmp_path / "changes"))
    out = ss.status_stream(ss.file_stream(spark, str(tmp_path / "changes"), StructType.fromDDL(schema), per_trigger=1))
    assert "Pandas" not in out._jdf.queryExecution().analyzed().toString()
    last = {}
    for r in sorted(ss.run_once(out, "update").collect(), key=lambda r: r.batch):
        last[r.evidence_id] = (r.status, r.started_us, r.finished_us, r.scan_ms)
    want = {r.evidence_id: (r.status, r.started_us, r.finished_us, r.scan_ms) for r in ss.latest_status(spark.read.parquet(str(tmp_path / "changes"))).collect()}
    assert last == want and len(want) == 301
