"""As-of join: each row of the left table gets the last row of the right one at or before its instant.

Both tables become one, ordered by time within a key, and the last right row is carried forward.  So that a
key with a large share of the rows is not one task, time is cut into ranges that every key
shares: rows are carried inside a (key, range), the last right row of each (key, range) is
carried over the ranges, which are few per key, and a row that finds nothing inside its range takes
what came before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: list[str] | None = None, strictly: bool = False, span: int = 30 * 86400, prefix: str = "last_") -> DataFrame:
    """``left`` with the columns of ``right`` besides ``keys`` as ``prefix`` + name, null where no earlier row is.

    Rows are compared by (``at``, ``order``...); the columns of ``order`` break ties and are in both tables.  With
    ``strictly`` a right row with equal values is not earlier.  Null keys are equal to each other; a left row
    with no instant gets nothing, a right one is never taken.  ``span`` is the width of a range in seconds.
    """
    order = [at, *(order or [])]
    own = [c for c in right.columns if c not in keys]
    carried = F.struct(*[F.col(c) for c in own])
    places = [*keys, *[F.col(c).alias(f"_{c}") for c in order]]
    row, kind = F.struct(*left.columns), right.select(carried.alias("x")).schema["x"].dataType
    side = 1 if strictly else 0  # at equal places right rows come last, or first
    rows = left.select(row.alias("_row"), *places, F.lit(None).cast(kind).alias("_right"), F.lit(1 - side).alias("_side"))
    held = right.where(F.col(at).isNotNull()).select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *places, carried.alias("_right"), F.lit(side).alias("_side"))
    both = rows.unionByName(held).withColumn("_range", F.floor(F.unix_seconds(F.col(f"_{at}").cast("timestamp")) / span))
    within = Window.partitionBy(*keys, "_range").orderBy(*[f"_{c}" for c in order], "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_found", F.last("_right", ignorenulls=True).over(within))
    # the carry over ranges: one row per key and range
    latest = F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct(*[f"_{c}" for c in order])))
    ends = both.groupBy(*keys, "_range").agg(latest.alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), F.last("_end", ignorenulls=True).over(before).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = inside.where("_row IS NOT NULL").join(ends, [F.col("_range").eqNullSafe(F.col("_r")), *same], "left")
    found = F.when(F.col(f"_{at}").isNotNull(), F.coalesce("_found", "_before"))
    return joined.withColumn("_got", found).select("_row.*", *[F.col(f"_got.`{c}`").alias(f"{prefix}{c}") for c in own])

