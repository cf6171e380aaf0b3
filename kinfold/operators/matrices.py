"""Square matrices of families as long tables (family, i, j, value), and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symmetric(lower: DataFrame, members: DataFrame, family: str, idx: str) -> DataFrame:
    """The whole matrix of a lower triangle: mirrored, with a zero diagonal."""
    turned = lower.select(family, F.col("j").alias("i"), F.col("i").alias("j"), "value")
    diagonal = members.select(family, F.col(idx).alias("i"), F.col(idx).alias("j"), F.lit(0.0).alias("value"))
    return lower.select(family, "i", "j", "value").unionByName(turned).unionByName(diagonal)


def masked(matrix: DataFrame, rows: DataFrame | None, columns: DataFrame | None, family: str) -> DataFrame:
    """Cells whose row and column are among (family, idx) sets."""
    for side, ids in (("i", rows), ("j", columns)):
        if ids is not None:
            matrix = matrix.join(ids.select(family, F.col(ids.columns[1]).alias(side)), [family, side], "left_semi")
    return matrix


def floor_max(value: str) -> Column:
    """A maximum that starts from 0, which it is for no rows."""
    return F.greatest(F.lit(0.0), F.coalesce(F.max(value), F.lit(0.0)))


def open_min(value: str) -> Column:
    """A minimum that is infinite for no rows."""
    return F.coalesce(F.min(value), F.lit(float("inf")))


def mean(value: str) -> Column:
    """A mean that is NaN for no rows."""
    return F.coalesce(F.avg(value), F.lit(float("nan")))


def mean_of_row_maxima(matrix: DataFrame, family: str) -> DataFrame:
    """(family, value): the mean over rows of the rows' maxima, each at least 0."""
    return matrix.groupBy(family, "i").agg(floor_max("value").alias("m")).groupBy(family).agg(F.avg("m").alias("value"))


def to_text(matrix: DataFrame, names: DataFrame, family: str) -> DataFrame:
    """(family, line, text): a count line, then a name and its row with five decimals, tab separated.

    names: (family, i, name), i giving the order of rows and columns.
    """
    cells = matrix.groupBy(family, "i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("cells"))
    row = F.concat_ws("\t", F.transform("cells", lambda c: F.format_string("%.5f", c["value"])))
    body = names.join(cells, [family, "i"], "left").select(family, F.col("i").cast("long").alias("line"), F.concat_ws("\t", "name", row).alias("text"))
    head = names.groupBy(family).agg(F.count("*").alias("n"), F.min("i").alias("least")).select(family, (F.col("least") - 1).cast("long").alias("line"), F.col("n").cast("string").alias("text"))
    return head.unionByName(body)
