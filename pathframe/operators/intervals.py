"""Joins of numbers with the intervals that hold them, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathframe.operators.storage import cut

#: Exponents of the narrowest and widest intervals that have a level of their own; wider ones share one cell.
NARROWEST, WIDEST = -20, 62
#: An interval is up to 2 ** FINER buckets wide, so most numbers of its buckets lie in it.
FINER = 3
#: Numbers and intervals of a cell that are compared at a time, and pairs in a task, on average.
POINT_ROWS, INTERVAL_ROWS, TASK_PAIRS = 2048, 1 << 16, 1 << 26
MAX_TASKS = 10_000
#: Cells up to which their sizes are broadcast, at some 40 bytes each.
MAX_BROADCAST_CELLS = 100_000


def interval_join(left: DataFrame, right: DataFrame, cond: Column, low: Column, high: Column, point: Column, left_has_intervals: bool) -> DataFrame:
    """``left`` and ``right`` where ``cond`` holds, which says that ``point`` lies between ``low`` and ``high``.

    An interval has the level of the least power of two that is as wide, and
    is in the buckets of an eighth of that which it touches, ten at most.  A
    number is looked up once for each level that there is, and a pair meets in
    one cell, a bucket of a level.  Cells are counted; those of many pairs are
    dealt in blocks, so that tasks have as many pairs each however the numbers
    cluster.  Intervals that end before they begin hold nothing; nulls and
    not-a-numbers match nothing.
    """
    intervals, points = (left, right) if left_has_intervals else (right, left)
    width = F.greatest(high - low, F.lit(2.0**NARROWEST))
    level = F.least(F.ceil(F.log2(width)), F.lit(WIDEST + 1)).cast("int")
    bucket = lambda x, n: F.when(n > WIDEST, F.lit(0).cast("bigint")).otherwise(F.floor(x / F.pow(F.lit(2.0), n - FINER)))
    marked = intervals.where((low <= high) & ~F.isnan(low) & ~F.isnan(high)).withColumn("_level", level)
    # A row for each level, of which there are at most as many as exponents.
    levels = sorted(r[0] for r in marked.select("_level").distinct().collect())
    over = marked.withColumn("_bucket", F.explode(F.sequence(bucket(low, F.col("_level")), bucket(high, F.col("_level")))))
    there = points.where(point.isNotNull() & ~F.isnan(point)).withColumn("_at", F.explode(F.lit(levels).cast("array<int>")))
    there = there.withColumn("_in", bucket(point, F.col("_at")))
    same = (F.col("_level") == F.col("_at")) & (F.col("_bucket") == F.col("_in"))
    count = F.count("*").cast("double")
    sizes = over.groupBy("_level", "_bucket").agg(count.alias("_q")).join(there.groupBy("_at", "_in").agg(count.alias("_p")), same)
    sizes = cut(sizes.select(F.col("_level").alias("_l"), F.col("_bucket").alias("_b"), "_p", "_q"))
    cells, pairs = sizes.agg(F.count("*"), F.sum(F.col("_p") * F.col("_q"))).first()
    if (pairs or 0) > TASK_PAIRS:
        tasks = min(MAX_TASKS, max(int(pairs // TASK_PAIRS) + 1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        blocks = sizes.select("_l", "_b", F.ceil(F.col("_p") / POINT_ROWS).alias("_m"), F.ceil(F.col("_q") / INTERVAL_ROWS).alias("_n"))
        blocks = F.broadcast(blocks) if cells <= MAX_BROADCAST_CELLS else blocks
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        over = over.withColumn("_own", _spread(intervals)).join(blocks, (F.col("_level") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
        over = over.withColumn("_j", F.pmod("_own", "_n")).withColumn("_i", every("_m")).drop("_own", "_l", "_b", "_m", "_n")
        there = there.withColumn("_own", _spread(points)).join(blocks, (F.col("_at") == F.col("_l")) & (F.col("_in") == F.col("_b")))
        there = there.withColumn("_i2", F.pmod("_own", "_m")).withColumn("_j2", every("_n")).drop("_own", "_l", "_b", "_m", "_n")
        over, there = over.repartition(tasks, "_level", "_bucket", "_i", "_j"), there.repartition(tasks, "_at", "_in", "_i2", "_j2").hint("merge")
        same &= (F.col("_i") == F.col("_i2")) & (F.col("_j") == F.col("_j2"))
    # The join buffers the right side's rows of a key: the numbers, of which a block has few.
    joined = over.join(there, same & cond)
    return joined.select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)])


def _spread(df: DataFrame) -> Column:
    """A hash of a row, by which a cell's rows are dealt to blocks."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
