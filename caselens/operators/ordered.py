"""Ordered operators that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.text import sha_json
from caselens.functions.when import micros, seconds_between
from caselens.session import materialize

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of every group.

    ``row_number() <= n`` makes Spark keep only n rows per group in every map
    task before the shuffle, so a hot group stays small.
    """
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        return ordered_index(df, by, order, rank).filter(F.col(rank) <= n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def ranked(df: DataFrame, by: list[str], order: list[Column], n: int | None = None, rank: str = "rank") -> DataFrame:
    """The first n rows of every group with their rank; all rows without n."""
    return ordered_index(df, by, order, rank) if n is None else top_n(df, by, order, n, rank)


def ordered_index(df: DataFrame, by: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """1-based position of each row in its group, for groups of any size.

    Rows are range-partitioned on group and order (a unique order column lets a
    hot group spread over many tasks), numbered per task, and the tasks' counts
    are summed: one small row per task and group.
    """
    keys = [F.col(c) for c in by]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = (
        df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
    )
    ids = materialize(ids, "index")
    stats = ids.groupBy("_part", *by).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return (
        ids.join(stats, ["_part", *by])
        .withColumn(name, F.col("_start") + F.col("_id") - F.col("_first") + 1)
        .drop("_id", "_part", "_first", "_start")
    )


def page(
    df: DataFrame, by: list[str], descending: bool = True, page_no: int = 1, limit: int = 50,
) -> DataFrame:
    """One page per group with rank, total and total_pages; limit is clamped to 10..500."""
    size = max(10, min(limit, 500))
    page_no = max(1, page_no)
    order = [F.desc("ts"), F.desc("event_id")] if descending else [F.asc("ts"), F.asc("event_id")]
    totals = df.groupBy(*by).agg(F.count("*").alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / size)
    )
    rows = top_n(df, by, order, page_no * size).filter(F.col("rank") > (page_no - 1) * size)
    return rows.join(totals, by)


def sessions(df: DataFrame, by: list[str], ts: str = "ts", gap_minutes: int = 15) -> DataFrame:
    """Split each group where the gap is strictly greater than ``gap_minutes``.

    Events are first reduced to bins as wide as the gap. A bin holds no inner
    gap, so only the bins (first, last, count) are ordered: their number depends
    on the time span and not on the number of events.
    """
    width = gap_minutes * 60 * 1_000_000
    bins = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*by, F.floor(micros(F.col(ts)) / width).alias("_bin"))
        .agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count("*").alias("_n"))
    )
    w = Window.partitionBy(*by).orderBy("_bin")
    gap = micros(F.col("_lo")) - micros(F.lag("_hi").over(w))
    marked = bins.withColumn("_new", F.when(gap > width, 1).otherwise(0))
    numbered = marked.withColumn("session_no", F.sum("_new").over(w) + 1)
    return numbered.groupBy(*by, "session_no").agg(
        F.min("_lo").alias("start_ts"), F.max("_hi").alias("end_ts"), F.sum("_n").alias("event_count")
    )


def span(df: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    ).withColumn("span_hours", F.round(seconds_between(F.col("first_ts"), F.col("last_ts")) / 3600, 2))


AUDIT_FIELDS = ["actor_id", "organization_id", "action", "entity_type", "entity_id", "metadata", "created_at"]


def audit_digest() -> Column:
    """Digest of an audit row's own fields; needs no other row."""
    return sha_json(**{c: F.col(c) for c in AUDIT_FIELDS})


def last_hash(audit: DataFrame) -> DataFrame:
    return audit.groupBy("organization_id").agg(
        F.max(F.struct("created_at", "audit_id", "self_hash"))["self_hash"].alias("last_hash")
    )


def milestones(events: DataFrame, n: int = 12) -> DataFrame:
    """Per case the n key events in time order.

    Flagged or high/critical events come first; a case with fewer than n of them
    is filled with events spaced evenly over its timeline.
    """
    key = F.coalesce("is_anomaly", F.lit(False)) | F.col("severity").isin("critical", "high")
    events = events.withColumn("_key", F.coalesce(key, F.lit(False)))
    order = [F.asc("ts"), F.asc("event_id")]
    counts = events.groupBy("case_id").agg(
        F.count("*").alias("_all"), F.count_if("_key").alias("_keys")
    )
    keys = top_n(events.filter("_key"), ["case_id"], order, n).drop("rank")
    short = counts.filter(F.col("_keys") < n).withColumn(
        "_step", F.greatest(F.lit(1), F.floor(F.col("_all") / (n - F.col("_keys"))))
    )
    pool = ordered_index(events.join(short, "case_id"), ["case_id"], order)
    fill = pool.filter(((F.col("pos") - 1) % F.col("_step") == 0) & ~F.col("_key"))
    fill = top_n(fill, ["case_id"], [F.asc("pos")], n).filter(F.col("rank") <= n - F.col("_keys"))
    both = keys.unionByName(fill.select(*keys.columns))
    return top_n(both.drop("_key"), ["case_id"], order, n)


def quantiles(df: DataFrame, by: list[str], value: str, q: Column) -> DataFrame:
    """Exact linear-interpolated quantile of each group.

    Equal values are counted first; the distinct values are range-partitioned
    and summed per task, so neither a hot group nor a hot value gathers in one.
    ``q`` may use ``n``, the group's row count.
    """
    keys = [F.col(c) for c in by]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.groupBy(*by, value).agg(F.count("*").alias("_w"))
    d = materialize(
        d.repartitionByRange(parts, *keys, F.col(value)).withColumn("_part", F.spark_partition_id()), "values")
    run = F.sum("_w").over(Window.partitionBy("_part", *by).orderBy(value))
    sums = d.groupBy(*by, "_part").agg(F.sum("_w").alias("_p"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_p").over(before), F.lit(0))).withColumn(
        "n", F.sum("_p").over(Window.partitionBy(*by)))
    at = (F.col("n") - 1) * q
    ranked = d.withColumn("_run", run).join(sums, [*by, "_part"]).withColumn("_cum", F.col("_start") + F.col("_run")).withColumn("_h", at)
    lo = F.min(F.when(F.col("_cum") > F.floor("_h"), F.col(value)))
    hi = F.min(F.when(F.col("_cum") > F.ceil("_h"), F.col(value)))
    return ranked.groupBy(*by).agg(lo.alias("_lo"), hi.alias("_hi"), F.any_value("_h").alias("_h"), F.any_value("n").alias("n")).select(
        *by, "n", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))).alias("quantile"))


def min_max(df: DataFrame, by: list[str], value: str, out: str, invert: bool = False) -> DataFrame:
    """Scale to 0..1 within each group; a constant group gives 0.

    The group ends are written first: with their true size known, the planner
    broadcasts them when they are small and leaves the rows unshuffled.
    """
    ends = materialize(df.groupBy(*by).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx")), "ends")
    scaled = (F.col(value) - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))
    score = F.when(F.col("_mx") > F.col("_mn"), (1 - scaled) if invert else scaled).otherwise(0.0)
    return df.join(ends, by).withColumn(out, score).drop("_mn", "_mx")
