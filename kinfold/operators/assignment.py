"""Choices among candidates: guarded filters, lexicographic firsts, greedy links."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.shared import bounded, drop_shared, write_counted, write_shared

#: Links of a group that are held as an array.
SMALL_GROUP = 200


def guarded_filter(rows: DataFrame, by: list[str], passes: Column) -> DataFrame:
    """The rows of a group that pass; all of them where none does."""
    marked = rows.withColumn("some pass", F.bool_or(passes).over(Window.partitionBy(*by)))
    return marked.where(passes | ~F.col("some pass")).drop("some pass")


def first_by(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rank = 1").drop("rank")


def repeated(rows: DataFrame, by: list[str], kind: str, depth: DataFrame) -> DataFrame:
    """(by, kind, count, rank): kinds with more than one row, by count, then depth of (node, depth), both downwards.

    Depths are few and go along: a shuffle by kind, of which there are few as well, would make a few large tasks.
    """
    counted = rows.groupBy(*by, kind).agg(F.count("*").alias("count")).where("count > 1")
    depth, _, nodes = write_counted(depth.select(F.col("node").alias(kind), "depth"), "depths")
    placed = counted.join(bounded(depth, nodes), kind)
    w = Window.partitionBy(*by).orderBy(F.desc("count"), F.desc("depth"), kind)
    return placed.withColumn("rank", F.row_number().over(w)).select(*by, kind, "count", "rank")


def greedy_links(links: Iterable[tuple], order) -> list[tuple]:
    """Links (arm, kind, gene, ...) in order, each taken if its gene is free and its arm has none of that kind yet."""
    used, filled, out = set(), set(), []
    for link in sorted(links, key=order):
        arm, kind, gene = link[:3]
        if gene not in used and (arm, kind) not in filled:
            used.add(gene)
            filled.add((arm, kind))
            out.append(link)
    return out


def match_greedily(links: DataFrame, by: list[str], slot: list[str], item: str, order: list[Column]) -> DataFrame:
    """The links (by, slot, item) that ``greedy_links`` takes of each group.

    ``order`` says which link comes first; by, slot and item break its ties, so equal rows are one link.  Groups of up to
    ``SMALL_GROUP`` links are arrays, after one shuffle of the links; the others go by ``match_in_rounds``.
    """
    names = [f"o{k}" for k in range(len(order))]
    ranked = links.select(*by, F.struct(*[c.alias(n) for c, n in zip(order, names)], *slot, item).alias("rank"))
    large, _, n = write_counted(links.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > SMALL_GROUP).select(*by), "large")
    if not n:
        return _match_small(ranked, by, slot, item)
    same = lambda rows: [rows[c].eqNullSafe(large[c]) for c in by]
    rest = match_in_rounds(links.join(bounded(large, n), same(links), "left_semi"), by, slot, item, order)
    return _match_small(ranked.join(bounded(large, n), same(ranked), "left_anti"), by, slot, item).unionByName(rest)


def _match_small(ranked: DataFrame, by: list[str], slot: list[str], item: str) -> DataFrame:
    """The links taken of groups (by, rank) that fit in an array: in order of rank, each that meets none taken before."""
    groups = ranked.repartition(*by).groupBy(*by).agg(F.array_sort(F.collect_set("rank")).alias("links"))
    of = lambda x: F.struct(*[x[c].alias(c) for c in (*slot, item)])
    meets = lambda x, y: x[item].eqNullSafe(y[item]) | reduce(and_, [x[c].eqNullSafe(y[c]) for c in slot])
    none = F.array().cast(ranked.select(F.array(F.struct(*[F.col(f"rank.{c}") for c in (*slot, item)])).alias("x")).schema["x"].dataType)
    taken = F.aggregate("links", none, lambda held, x: F.when(F.exists(held, lambda y: meets(x, y)), held).otherwise(F.array_append(held, of(x))))
    return groups.select(*by, F.inline(taken))


def match_in_rounds(links: DataFrame, by: list[str], slot: list[str], item: str, order: list[Column]) -> DataFrame:
    """``match_greedily`` of groups of any size, in rounds over all groups at once.

    A link is taken if it is the first open one of its item and of its slot: whatever the sequential order takes before it
    conflicts with neither.  Then the links of taken items and slots close, and the next round begins,
    until none is open.  A round is two minima, summed before they move, a join of these and two
    anti joins; each round's links are written, so nothing of a group is ever gathered.  The
    number of rounds is the longest chain of links that each wait for another, a few for most orders.
    """
    spark = links.sparkSession
    names = [f"o{k}" for k in range(len(order))]
    rank = F.struct(*[c.alias(n) for c, n in zip(order, names)], *slot, item).alias("rank")
    open_, path, n = write_counted(links.select(*by, *slot, item, rank).distinct(), "open")
    taken = []
    while n:
        firsts = [open_.groupBy(*by, *keys).agg(F.min("rank").alias("rank")).select(*by, "rank") for keys in ([item], slot)]
        found, _ = write_shared(firsts[0].join(firsts[1], [*by, "rank"]).select(*by, *[F.col(f"rank.{c}").alias(c) for c in (*slot, item)]), "taken")
        taken.append(found)
        left = open_.join(found.select(*by, item), [*by, item], "left_anti").join(found.select(*by, *slot), [*by, *slot], "left_anti")
        open_, after, n = write_counted(left, "open")
        drop_shared(spark, path)
        path = after
    drop_shared(spark, path)
    out = taken[0] if taken else links.select(*by, *slot, item).limit(0)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out
