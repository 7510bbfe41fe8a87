"""Mixing sources to target weights by capped water-filling.

Targets are ``min(max_epochs * size, level * weight)`` with the one level at
which they add up to the wanted total.  The level is found by clamping:
sources over their cap leave, the rest share what is left by weight, until no
source is above its cap.  Each round is one aggregation over the sources.

A document is repeated ``whole`` times, ``whole`` being its source's full
epochs.  The rest of the target is a fractional epoch: documents in the order
of a seeded hash take one repetition more until the words run out, and the
last takes the part that is left, so a source misses its target by under a
word.  The order is cut through a histogram of the hash with ``BINS`` bins a
source; only the one bin in which a source's words run out is sorted, and that
bin is cut again in the same way while it is large, so no source is sorted as
a whole.  Nothing is collected but scalars.

Null text has size 0; a null source is a source of its own, last in order.
Repeated rows share the hash of their id and are ordered by text after it;
equal rows are alike, so it does not matter which is first.  Sources without
a word have target 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathframe.llm.common import cut

#: Bins of the seeded hash, for each cut through a source's order.
BINS = 4096
#: A bin with more rows than this is cut again, by the next bits of the hash.
BIN_ROWS = 50_000
#: Sources up to which the plan is broadcast, at under 100 bytes each.
MAX_BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Weights for ``sources(source)`` in code point order, null last, by turns.

    The rank is over distinct sources alone.  More of them than are broadcast
    are sorted by ranges, with the number of sources in the ranges before
    added, so no task has them all; the ranks are the same.
    """
    order = F.col("source").asc_nulls_last()
    turns = F.array(*[F.lit(float(w)) for w in cycle])
    weight = lambda rank: F.element_at(turns, (rank % len(cycle) + 1).cast("int")).alias("weight")
    if sources.count() <= MAX_BROADCAST_SOURCES:
        return sources.select("source", weight(F.row_number().over(Window.orderBy(order)) - 1))
    ranges = sources.select("source").repartitionByRange(order).sortWithinPartitions(order)
    # The row's place in its range is in the low 33 bits, the range above them.
    at = cut(ranges.select("source", F.monotonically_increasing_id().alias("at")))
    at = at.select("source", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    counts = at.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    # A row a range, of which there are no more than shuffle partitions.
    return at.join(F.broadcast(before), "range").select("source", weight(F.col("before") + F.col("place")))


def fill_targets(sources: DataFrame, max_epochs: float, total: float | None = None) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``.

    ``total`` is the wanted size of the mix, by default all of the input; it
    is cut to what the caps allow.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    size = sources.agg(F.sum("source_size"), F.sum(cap)).first()
    wanted = min(float(size[0] or 0) if total is None else float(total), float(size[1] or 0))
    level = 0.0
    while True:
        over = (cap <= F.lit(level) * F.col("weight")) if level else F.lit(False)
        r = sources.agg(F.sum(F.when(over, cap)).alias("kept"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if not r.w:
            break
        higher = (wanted - float(r.kept or 0.0)) / float(r.w)
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    max_epochs: float = 3.0,
    total: float | None = None,
    seed: int = 42,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row a document: id, source, ``size``, ``source_size``, ``target`` of its source, ``whole``, ``extra`` and ``taken``.

    ``taken = whole * size + extra`` words, ``extra`` at most ``size``.
    ``weights(source, weight)`` defaults to 1, 2, 3 by turns.  With ``carry``
    a struct ``row`` holds the document's own columns; they are not shuffled
    but for the rows of the bins that are cut.
    """
    own = [F.struct(*docs.columns).alias("row")] if carry else []
    wide = docs.select(
        *own,
        F.col(id).alias("id"),
        F.col(source).cast("string").alias("source"),
        words_of(F.col(text)).alias("size"),
        # With the text: rows that share an id, or have none, are apart.
        F.pmod(F.xxhash64(F.lit(seed), F.col(id), F.col(text)), F.lit(1 << 48)).alias("h"),
        F.xxhash64(F.col(text)).alias("tie"),
    ).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = cut(wide.drop("row"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = cyclic_weights(sizes.select("source")) if weights is None else weights.select(F.col("source").cast("string"), F.col("weight").cast("double"))
    weighed = sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).select("s.source", "source_size", "weight")
    plan = fill_targets(cut(weighed), max_epochs, total)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A hair below a full number of epochs is that number.
    plan = plan.withColumn("whole", F.floor(ratio + F.lit(1e-9)).cast("bigint"))
    left = F.round(F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("left", F.greatest(F.lit(0), left).cast("bigint"))
    plan = cut(plan.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source", "weight"))
    plan, depth = _cut_points(rows, plan)
    # A row a source: sent to every task while there are few, else joined by shuffle.
    few = plan.count() <= MAX_BROADCAST_SOURCES
    return _extra((wide if carry else rows).join(F.broadcast(plan) if few else plan, "key"), depth).select(
        *(["row"] if carry else []),
        F.col("id").alias(id),
        F.col("source"),
        "size",
        "source_size",
        "target",
        "whole",
        "extra",
        (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"),
    )


def _bin(level: int) -> Column:
    return F.shiftright("h", 36 - 12 * level) % BINS


def _cut_points(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, int]:
    """``plan`` with the bin in which a source's ``left`` words run out, level by level while such bins are large.

    ``cut_0`` is null where nothing is left over; ``rest`` is what the last
    bin's rows share.
    """
    plan = plan.withColumn("rest", F.col("left"))
    inside = rows.select("key", "size", "h")
    for level in range(4):
        here = inside.join(_sent(plan.select("key", "rest")), "key")
        sums = here.withColumn("bin", _bin(level)).groupBy("key", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("rest").alias("rest"))
        before = F.sum("words").over(Window.partitionBy("key").orderBy("bin")) - F.col("words")
        at = sums.withColumn("before", before).where("rest > 0 and before < rest and before + words >= rest")
        at = cut(at.select("key", F.col("bin").alias(f"cut_{level}"), (F.col("rest") - F.col("before")).alias("rest"), "n"))
        plan = cut(plan.drop("rest").join(at.drop("n"), "key", "left"))
        if level == 3 or (at.agg(F.max("n")).first()[0] or 0) <= BIN_ROWS:
            return plan, level + 1
        inside = inside.join(_sent(at.select("key", f"cut_{level}")), "key").where(_bin(level) == F.col(f"cut_{level}")).drop(f"cut_{level}")
    raise AssertionError


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_SOURCES else table


def _extra(full: DataFrame, depth: int) -> DataFrame:
    """Rows with ``extra``: the words left of a source go to its rows in the order of ``h``."""
    size, none = F.col("size"), F.lit(0).cast("bigint")
    extra: Column = F.lit(None).cast("bigint")
    for level in reversed(range(depth)):
        point = F.col(f"cut_{level}")
        extra = F.when(point.isNull() | (_bin(level) > point), none).when(_bin(level) < point, size).otherwise(extra)
    marked = full.withColumn("extra", extra)
    edge = marked.where("extra is null").repartition("key", "cut_0")
    order = Window.partitionBy("key").orderBy("h", "id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - taken)).cast("bigint"))
    return marked.where("extra is not null").unionByName(edge)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row a repetition.

    A document of which at least half is in the fractional epoch is repeated
    once more, else not; texts stay whole.  Options as for :func:`mix_sources`.
    """
    mix = mix_sources(docs, carry=True, **options)
    times = F.col("whole") + ((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size"))).cast("bigint")
    repeated = mix.withColumn("times", times).where("times > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
