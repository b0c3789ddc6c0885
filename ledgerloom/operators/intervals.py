"""Interval join: points meet the intervals that hold them by equal buckets, never by a nested loop.

Time is cut into buckets at several levels, each eight times as wide as the one before.  An interval goes
to the finest level at which it touches at most ``SPREAD`` buckets, and into each bucket it touches there; a point
goes into its bucket at each level that has intervals.  Equal (keys, level, bucket) then join, and the
exact bounds are compared after.  Buckets in which many points meet are few by count: at most
``HOT`` of them at a level hold 1/``HOT`` of the points or more.  That list is broadcast, their points are dealt over
salts, as many as their share asks for, and their intervals copied to each.

Without keys, points travel in blocks, up to ``BLOCK`` of one finest bucket that follow each other in time.  An interval meets a block
if it holds an instant between the block's first and last point, and then its points one by one.  A block's points
come out for each interval in the same order and without a break: pairs can grow with the square of the input, and written as
Parquet such rows are runs of one interval beside one repeated list, a small part of what they are in the points' order.  That needs
both columns' dictionaries, so a task gets the blocks of about ``TASK`` points.  With keys, buckets hold few points, which travel one by one.

Bounds are half open, [start, end).  An interval without a start or an end is open there; it goes to a level of
its own with one bucket.  Empty intervals and points without an instant or a key meet nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPREAD, GROWTH, LEVELS, HOT, LEAST, SALTS = 4, 8, 12, 1000, 10_000, 16
BLOCK, TASK = 256, 65_536


def _floor(value: str, size: str | int) -> Column:
    """Whole numbers divided and rounded down, so that buckets of different levels nest."""
    return F.expr(f"({value}) div {size} - if(({value}) % {size} < 0, 1, 0)")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None, width: int = 600, how: str = "inner") -> DataFrame:
    """Each point with each interval of equal ``keys`` that holds it; both tables' columns, of which only ``keys`` may be named alike.

    ``width`` is the finest bucket in seconds; ``how`` is 'inner' or 'left'.
    """
    keys = keys or []
    own = [c for c in intervals.columns if c not in keys]
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in (start, end)]
    bounded = intervals.where(f"`{start}` IS NULL OR `{end}` IS NULL OR `{start}` < `{end}`")
    held = bounded.select(*keys, F.struct(*own).alias("_held"), micros[0].alias("_from"), micros[1].alias("_to"))
    level = F.lit(-1)  # open intervals
    for i in reversed(range(LEVELS)):
        size = width * 1_000_000 * GROWTH**i
        level = F.when(_floor("_to - 1", size) - _floor("_from", size) < SPREAD, F.lit(i)).otherwise(level)
    held = held.withColumn("_level", level).withColumn("_size", F.expr(f"{width * 1_000_000} * cast(power({GROWTH}, greatest(_level, 0)) AS bigint)"))
    buckets = F.when(F.col("_level") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(_floor("_from", "_size"), _floor("_to - 1", "_size")))
    held = held.withColumn("_bucket", F.explode(buckets)).drop("_size")
    levels = sorted(r[0] for r in held.select("_level").distinct().collect()) or [0]  # at most LEVELS + 1
    finest = next((i for i in levels if i >= 0), -1)

    def at_levels(cells: DataFrame) -> DataFrame:
        """Rows of finest buckets in the buckets around them at each level."""
        found = cells.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels])))
        return found.withColumn("_bucket", F.when(F.col("_level") < 0, F.lit(0).cast("long")).otherwise(_floor("_bucket", f"cast(power({GROWTH}, greatest(_level - {finest}, 0)) AS bigint)")))

    asked = points.select(F.struct(*points.columns).alias("_point"), *keys, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"))
    met = asked.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ["_at", *keys]))
    met = met.withColumn("_bucket", F.lit(0).cast("long") if finest < 0 else _floor("_at", width * 1_000_000 * GROWTH**finest))
    cell = [*keys, "_level", "_bucket"]
    total = points.count()
    many = max(LEAST, total / HOT)
    counts = at_levels(met.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))).groupBy(*cell).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= many)
    # each point is in at most LEVELS + 1 cells, so these are at most HOT * (LEVELS + 1)
    hot = F.broadcast(counts.select(*cell, F.ceil(F.col("_n") / many).alias("_parts")))
    salts = F.least(F.coalesce("_parts", F.lit(1)), F.lit(SALTS))
    held = held.join(hot, cell, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_parts")
    if keys:
        met = at_levels(met).join(hot, cell, "left").withColumn("_salt", F.pmod(F.xxhash64("_at", F.monotonically_increasing_id()), salts)).drop("_parts")
        joined = met.join(held, [*cell, "_salt"]).where("(_from IS NULL OR _from <= _at) AND (_to IS NULL OR _at < _to)").select("_held", "_point")
    else:
        dealt = met.withColumn("_level", F.lit(finest)).join(hot, cell, "left").drop("_level")
        # numbered before they are dealt, so that a repeated task makes the same blocks
        dealt = dealt.withColumn("_number", F.monotonically_increasing_id()).withColumn("_part", F.pmod(F.xxhash64("_at", "_number"), F.coalesce("_parts", F.lit(1))))
        part = ["_bucket", "_part"]
        nth = F.row_number().over(Window.partitionBy(*part).orderBy("_at", "_number"))
        dealt = dealt.withColumn("_block", F.floor((nth - 1) / BLOCK))
        blocks = dealt.groupBy(*part, "_block").agg(F.collect_list(F.struct("_at", "_point")).alias("_rows"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
        # an array for each column: numbers lie in it without a row around each
        lists = {f"_list{i}": F.col("_rows")["_point"][c] for i, c in enumerate(points.columns)}
        blocks = blocks.select(*part, "_block", "_first", "_last", F.col("_rows")["_at"].alias("_times"), *[c.alias(name) for name, c in lists.items()])
        blocks = at_levels(blocks.withColumn("_hash", F.xxhash64("_bucket", "_part", "_block")).drop("_part", "_block"))
        blocks = blocks.join(hot, cell, "left").withColumn("_salt", F.pmod("_hash", salts)).drop("_parts", "_hash")
        tasks = math.ceil(total * len(levels) / TASK)
        if tasks > 1:  # else partitions may be put together
            blocks = blocks.repartition(max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *cell, "_salt")
        joined = blocks.join(held, [*cell, "_salt"]).where("(_from IS NULL OR _from <= _last) AND (_to IS NULL OR _first < _to)")
        joined = joined.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_times") - 1))).where("(_from IS NULL OR _from <= _times[_i]) AND (_to IS NULL OR _times[_i] < _to)")
        joined = joined.select("_held", F.struct(*[F.col(name)[F.col("_i")].alias(c) for name, c in zip(lists, points.columns)]).alias("_point"))
    found = joined.select("_point.*", *[F.col(f"_held.`{c}`").alias(c) for c in own])
    if how == "inner":
        return found
    # a point is found again by all of its columns
    one = joined.select("_point").distinct()
    rest = asked.join(one, asked["_point"].eqNullSafe(one["_point"]), "left_anti")
    empty = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in own]
    return found.unionByName(rest.select("_point.*", *empty))
