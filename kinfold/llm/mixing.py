"""Mixing sources to target weights by hash-threshold histograms.

Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the
sum of all sizes; a target stops at ``most`` times its source's size and the excess is shared
again by weight.  A source whose target is q whole sizes and a rest takes each of
its documents q times, and once more those whose hash lies below the source's
threshold.  The threshold is found without sorting documents: a histogram of
sizes by the hash's top 12 bits gives the boundary bucket, and only that bucket's
rows go to the next histogram, on the next 12 bits, until all 60 bits are used.
The document at the boundary is taken if that brings the source nearer to its
target.

Texts are read once: ids, sources, sizes and hashes are written to the shared
folder and all passes read these.  Null texts have size 0, so nothing is taken of
them.  Rows with the same id have the same hash, so they are taken together; a
null id hashes as an empty one.  A null source is a source.  An empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import table
from kinfold.shared import write_shared

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and of each histogram.
BITS, STEP = 60, 12


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """sizes (source, source_size): with ``target``, by one pass over sources in the order in which they reach their caps.

    All sources are one window's rows: one row a source, streamed.
    """
    # Sources are numbered in one task; it holds a source's name and two numbers a row.
    named = sizes.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    order = Window.orderBy(F.lit(float(most)) * F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))).cast("double") / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = named.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.lit(float(most)) * F.col("source_size"))
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(every)
    return levels.withColumn("level", level).select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.lit(float(most)) * F.col("source_size")), F.lit(0.0)).alias("target"))


def hash60(key: str):
    """60 bits of an id, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|mix"))), 1, 15), 16, 10).cast("long")


def _thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, boundary, taken): documents with a smaller hash are taken, those at the boundary if ``taken``."""
    state = goals.select("source", F.lit(0).cast("long").alias("prefix"), "rest")
    for shift in range(BITS - STEP, -1, -STEP):
        known = state.select(F.col("source").alias("s"), "prefix", "rest")
        # The first histogram covers all rows, each later one the rows of the boundary buckets alone.
        inside = rows.withColumn("bucket", F.shiftright("h", shift))
        inside = inside.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", STEP) == F.col("prefix")))
        sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        state = over.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"), "size"), "bucket").alias("b"))
        state = write_shared(state.select("source", F.col("b.bucket").alias("prefix"), F.col("b.rest").alias("rest"), F.col("b.size").alias("size")), "threshold")[0]
    return state.select(F.col("source").alias("s"), F.col("prefix").alias("boundary"), (2 * F.col("rest") >= F.col("size")).alias("at"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 3) -> DataFrame:
    """(key, size, source_size, target, taken) for each row."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hash60(key).alias("h"))
    rows, _ = write_shared(rows, "sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals, _ = write_shared(goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    cuts = _thresholds(rows, goals)
    per = goals.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("boundary", F.lit(-1)).alias("boundary"), F.coalesce("at", F.lit(False)).alias("at"))
    out = rows.join(per, F.col("source").eqNullSafe(F.col("s")))
    more = (F.col("h") < F.col("boundary")) | ((F.col("h") == F.col("boundary")) & F.col("at"))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * (F.col("whole") + more.cast("long"))).alias("taken"))


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 3) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    times = mix(docs, key, text, source, most).where("taken > 0").select(F.col(key).alias("k"), (F.col("taken") / F.col("size")).cast("int").alias("times"))
    times = times.groupBy("k").agg(F.max("times").alias("times"))
    out = docs.join(times, F.col(key).eqNullSafe(F.col("k"))).withColumn("k", F.explode(F.sequence(F.lit(1), "times")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
f AS (SELECT level FROM l WHERE level * w <= 3.0::DOUBLE * source_size ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, coalesce(least((SELECT level FROM f) * w, 3.0::DOUBLE * source_size), 0) AS target FROM l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
r AS (SELECT *, target - whole * source_size AS rest FROM t),
c AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN upto <= rest OR (upto - same <= rest AND 2 * (rest - (upto - same)) >= same) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
""",
}
