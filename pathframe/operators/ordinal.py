"""Global positions without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathframe.operators.storage import cut


def with_ordinal(df: DataFrame, name: str, order: list[Column] | None) -> DataFrame:
    """``df`` with 0-based positions in ``order``, or as the rows come.

    Rows are sorted by ranges and stored; a position is the row's place in
    its partition plus the sizes of those before, one number a partition.
    """
    rows = df.orderBy(*order) if order else df
    rows = cut(rows.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(name), 33)
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    if not offsets:
        return rows.withColumn(name, F.lit(None).cast("double"))
    before = df.sparkSession.createDataFrame(offsets, "_p bigint, _before bigint")
    place = F.col("_before") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, place.cast("double")).drop("_p", "_before")
