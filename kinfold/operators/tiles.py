"""All pairs of a family in tiles, so that no task has a whole family.

The pairs of a family are a triangle.  A large family is cut into blocks of consecutive numbers, at quantiles of these; a
tile is two of its blocks.  A row goes to the tiles of its block, once as the later and
once as the earlier of a pair, and one join on (family, tile) forms the pairs, each in one tile
alone.  A tile has ``BLOCK`` rows a side, or more where a family has over ``BLOCK`` times ``MOST_BLOCKS`` of them.  Families of up to
``BLOCK`` rows are one tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.shared import bounded, write_counted, write_shared

#: Rows of a block, and blocks of a family at most.
BLOCK, MOST_BLOCKS = 2000, 256
#: Blocks of a family of vectors, as long as one has no more than these bytes: each vector is sent once a block.
FEW_BLOCKS, BLOCK_BYTES = 8, 16 << 20


def block_bounds(rows: DataFrame, family: str, idx: str, vector: str | None = None) -> tuple[DataFrame, int]:
    """(family, bounds) of families over a block, and their number: numbers at which a next block begins."""
    length = F.greatest(F.lit(1), F.max(F.coalesce(F.size(vector), F.lit(1)))) if vector else F.lit(None).cast("int")
    sizes, _, n = write_counted(rows.groupBy(family).agg(F.count("*").alias("n"), length.alias("length")).where(F.col("n") > BLOCK), "large")
    if not n:
        return sizes.select(family, F.lit(None).cast("array<double>").alias("bounds")), 0
    parts = [k / MOST_BLOCKS for k in range(1, MOST_BLOCKS)]
    cuts = rows.join(bounded(sizes, n), family).groupBy(family).agg(F.percentile_approx(F.col(idx).cast("double"), parts, 10_000).alias("q"), F.max("n").alias("n"), F.max("length").alias("length"))
    block = F.greatest(F.lit(BLOCK), F.least(F.ceil(F.col("n") / FEW_BLOCKS), F.floor(BLOCK_BYTES / (8 * F.col("length")))))
    step = F.greatest(F.lit(1), F.floor(MOST_BLOCKS * (block if vector else F.lit(BLOCK)) / F.col("n")).cast("int"))
    return cuts.select(family, F.array_distinct(F.filter("q", lambda x, i: (i + 1) % step == 0)).alias("bounds")), n


def pair_up(rows: DataFrame, family: str, idx: str, left: dict[str, str], right: dict[str, str], keep: Column | None = None) -> DataFrame:
    """Pairs with the later number on the left; ``left`` and ``right`` map columns of rows to their names in the pairs."""
    bounds, n = block_bounds(rows, family, idx)
    a, b = (rows.select(F.col(family).alias("pair family"), F.col(idx).alias(f"{side} idx"), *[F.col(c).alias(x) for c, x in names.items()]) for side, names in (("i", left), ("j", right)))
    key = ["pair family"]
    if n:
        bounds, _ = write_shared(bounds.withColumnRenamed(family, "pair family"), "bounds")
        last = F.coalesce(F.size("bounds"), F.lit(0))
        # Null bounds: the whole family is block 0.
        block = lambda side: F.coalesce(F.size(F.filter("bounds", lambda x: x <= F.col(f"{side} idx"))), F.lit(0))
        a = a.join(bounded(bounds, n * MOST_BLOCKS), key, "left").withColumn("hi", block("i")).drop("bounds").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("hi"))))
        b = b.join(bounded(bounds, n * MOST_BLOCKS), key, "left").withColumns({"lo": block("j"), "last": last}).drop("bounds").withColumn("hi", F.explode(F.sequence(F.col("lo"), F.col("last")))).drop("last")
        key += ["lo", "hi"]
    pairs = a.join(b, key).where(F.col("i idx") > F.col("j idx"))
    return pairs.drop("i idx", "j idx", "lo", "hi").withColumnRenamed("pair family", family)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """rows with their place from 0 within ``by`` in the order of columns without ties, by no task alone.

    Rows are dealt by ranges of (by, order) and written with their range; each range numbers its own rows, and
    the rows of a group in the ranges before are added: one sum a group and range.
    """
    ranged, _ = write_shared(rows.repartitionByRange(*by, *order).withColumn("the range", F.spark_partition_id()), "ranged")
    own = Window.partitionBy(*by, "the range").orderBy(*order)
    counts = ranged.groupBy(*by, "the range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("the range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "the range", before.alias("before"))
    joined = ranged.withColumn("place", F.row_number().over(own) - 1).join(offsets, [*by, "the range"])
    return joined.select(*rows.columns, (F.col("place") + F.col("before")).alias(name))
