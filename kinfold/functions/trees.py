"""Relations of rooted trees held as (node, parent) rows.

Closures come from doubling; leaf sets and covers are joins and counts on the closure.  Common ancestors and losses
need none: nodes are numbered depth first, and a family's first, last and neighbouring
numbers say all.  Species trees are small beside gene tables; their number of nodes is checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinfold.shared import bounded, python_ready, write_counted, write_shared


class Clades:
    """A rooted tree in depth-first order, for questions about common ancestors in constant time each.

    Nodes are numbered in that order, so a subtree is a range of numbers.  The common ancestor of
    two nodes a < b is the least parent among the nodes after a up to b, which a table of minima over
    ranges of powers of two gives.  rows: (node, parent), the root's parent null.  Any depth will do.
    """

    def __init__(self, rows: list[tuple]):
        kids: dict = {}
        for node, parent, *_ in rows:
            kids.setdefault(parent, []).append(node)
        if len(kids.get(None, [])) != 1:
            raise ValueError("a tree has one root")
        self.nodes: list = []
        self.numbers: dict = {}
        parents, todo = [], [(kids[None][0], -1)]
        while todo:
            node, above = todo.pop()
            if node in self.numbers:
                raise ValueError(f"node {node} stands twice in the tree")
            self.numbers[node] = at = len(self.nodes)
            self.nodes.append(node)
            parents.append(above)
            todo += [(k, at) for k in reversed(kids.get(node, []))]
        n = len(self.nodes)
        self.parent = np.array(parents, np.int64)
        self.end = np.arange(1, n + 1)  # the number after a node's subtree
        leaf = np.ones(n, bool)
        leaf[self.parent[1:]] = False
        self.depth = np.zeros(n, np.int64)
        for i in range(1, n):
            self.depth[i] = self.depth[self.parent[i]] + 1
        for i in range(n - 1, 0, -1):
            self.end[self.parent[i]] = max(self.end[self.parent[i]], self.end[i])
        self.leaf = leaf
        self.leaves_before = np.concatenate(([0], np.cumsum(leaf)))
        self.span = self.leaves_before[self.end] - self.leaves_before[:n]
        self.least = [self.parent.copy()]
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def loss_weights(self, large_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(sums from the root to each node of its inner children less itself if inner, whether each is inner); see ``losses``."""
        inner = ~self.leaf & ((self.span > 1) if large_only else True)
        along = np.bincount(self.parent[1:][inner[1:]], minlength=len(inner)) - inner
        for i in range(1, len(along)):
            along[i] += along[self.parent[i]]
        return along, inner.astype(np.int64)

    def lineage(self, number: int) -> np.ndarray:
        """Numbers of the node and its ancestors, upwards."""
        out = []
        while number >= 0:
            out.append(number)
            number = self.parent[number]
        return np.array(out, np.int64)

    def number(self, nodes: np.ndarray) -> np.ndarray:
        return np.array([self.numbers[x] for x in nodes.tolist()], np.int64)

    def mrca(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of the common ancestors of all nodes from ``low`` to ``high`` (numbers, low <= high)."""
        size = np.maximum(high - low, 1)
        power = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(size), np.int64)
        for p in np.unique(power):
            at = power == p
            table, first = self.least[p], np.minimum(low[at] + 1, len(self.nodes) - (1 << int(p)))
            out[at] = np.minimum(table[first], table[np.maximum(high[at] - (1 << int(p)) + 1, 0)])
        return np.where(low == high, low, out)

    def span_of_range(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.span[self.mrca(low, high)]


#: Rows that a species tree may have to be numbered on the driver and sent along with tasks.
MOST_NODES = 1_000_000


def clades_of(tree: DataFrame) -> Clades:
    """The numbered tree, after a check of its number of rows."""
    rows = tree.select("node", "parent").limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError("the species tree has too many nodes")
    return Clades([(r["node"], r["parent"]) for r in rows])


def numbers(spark: SparkSession, clades: Clades) -> DataFrame:
    """(node, number, end, depth, span): a subtree is the numbers from its node's up to ``end``, span its leaves."""
    columns = [pa.array(clades.nodes), *(pa.array(x.astype(np.int64)) for x in (np.arange(len(clades.nodes)), clades.end, clades.depth, clades.span))]
    return spark.createDataFrame(pa.table(columns, names=["node", "number", "end", "depth", "span"]))


class SpeciesSets:
    """Growing sets of species with their losses: what one more species would add, for all sets at once in the tree's height."""

    def __init__(self, clades: Clades, sets: list[list[int]]):
        """sets: numbers of species."""
        self.clades, (self.along, self.inner) = clades, clades.loss_weights()
        self.covered = np.zeros((len(sets), len(clades.nodes)), bool)
        self.top = np.full(len(sets), -1, np.int64)
        self.sum = np.zeros(len(sets), np.int64)  # of the weights between the top and the species
        for k, numbers_ in enumerate(sets):
            for x in numbers_:
                self.add(k, x)

    def losses(self) -> np.ndarray:
        return np.where(self.top >= 0, self.sum + self.inner[self.top], 0)

    def _over(self, node: np.ndarray) -> np.ndarray:
        """Sums along the path to a node's parent."""
        return np.where(node > 0, self.along[self.clades.parent[node]], 0)

    def _after(self, species: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(top, sum) of sets with one more species."""
        way = self.clades.lineage(species)
        meets = self.covered[np.ix_(rows, way)]
        at = way[meets.argmax(axis=1)]  # the lowest node of the way that a set has below or at it
        top, total = self.top[rows], self.sum[rows]
        higher = at < top  # numbers of ancestors are smaller
        grown = np.where(higher, total + self._over(top) - self._over(at), total) + self.along[species] - self.along[at]
        empty = top < 0
        return np.where(empty, species, np.minimum(at, top)), np.where(empty, self.along[species] - self._over(np.full(len(rows), species)), grown)

    def more(self, species: int) -> np.ndarray:
        """The losses that each set would have more with the species."""
        top, total = self._after(species, np.arange(len(self.top)))
        return total + self.inner[top] - self.losses()

    def add(self, k: int, species: int) -> None:
        top, total = self._after(species, np.array([k]))
        self.top[k], self.sum[k] = top[0], total[0]
        self.covered[k, self.clades.lineage(species)] = True


def closure(tree: DataFrame) -> DataFrame:
    """(anc, node, dist) for every node and each of its ancestors, itself at 0.

    By doubling: the ancestors at distances under 2**(k+1) are those under 2**k and what lies 2**k above them.
    A round for each power of two up to the height; no limit of levels or rows.
    """
    found = tree.select(F.col("node").alias("anc"), "node", F.lit(0).alias("dist"))
    up, _, n = write_counted(tree.where("parent is not null").select("node", F.col("parent").alias("up")), "up")
    step = 1
    while n:
        above = found.join(up.select(F.col("node").alias("anc"), "up"), "anc").select(F.col("up").alias("anc"), "node", (F.col("dist") + step).alias("dist"))
        found = found.unionByName(above)
        if step > 4:
            found, _ = write_shared(found, "closure")
        further = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"))
        up, _, n = write_counted(further, "up")
        step *= 2
    return found


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes that are no parent."""
    return tree.select("node").join(tree.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")


def depths(closed: DataFrame) -> DataFrame:
    """(node, depth): the largest distance to an ancestor."""
    return closed.groupBy("node").agg(F.max("dist").alias("depth"))


def spans(tree: DataFrame, closed: DataFrame) -> DataFrame:
    """(node, leaf) for each leaf below or at a node."""
    return closed.join(leaves(tree), "node").select(F.col("anc").alias("node"), F.col("node").alias("leaf"))


def span_sizes(tree: DataFrame, closed: DataFrame) -> DataFrame:
    return spans(tree, closed).groupBy("node").agg(F.count("*").alias("span"))


def covers(members: DataFrame, closed: DataFrame, family: str = "family", species: str = "species") -> DataFrame:
    """(family, anc, cover): distinct species of each family at or below each node that has any."""
    distinct = members.select(family, F.col(species).alias("node")).distinct()
    return distinct.join(closed, "node").groupBy(family, "anc").agg(F.count("*").alias("cover"))


def _numbered(members: DataFrame, clades: Clades, family: str, species: str, how: str = "inner") -> DataFrame:
    """(family, number): the number of each member's species, repeats left in."""
    labels = bounded(numbers(members.sparkSession, clades).select(F.col("node").alias(species), "number"), len(clades.nodes))
    return members.select(family, species).join(labels, species, how).select(family, "number")


def mrcas(members: DataFrame, clades: Clades, family: str = "family", species: str = "species", whole: bool = False) -> DataFrame:
    """(family, mrca, span): the deepest node above all of a family's species, and its leaves.

    The first and the last number of a family say which: one minimum over the range between them.
    Species that the tree lacks are passed over; ``whole`` leaves out the families that have any.
    """
    python_ready(members.sparkSession, 10_000)
    kind = "long" if members.schema[species].dataType.simpleString() == "bigint" else members.schema[species].dataType.simpleString()
    sent = members.sparkSession.sparkContext.broadcast(clades)

    @F.pandas_udf(f"mrca {kind}, span long")
    def top(low: pd.Series, high: pd.Series) -> pd.DataFrame:
        c = sent.value
        at = c.mrca(low.to_numpy(), high.to_numpy())
        return pd.DataFrame({"mrca": [c.nodes[i] for i in at.tolist()], "span": c.span[at]})

    rows = _numbered(members, clades, family, species, "left" if whole else "inner").groupBy(family)
    ends = rows.agg(F.min("number").alias("low"), F.max("number").alias("high"), *[F.count_if(F.col("number").isNull()).alias("strange")] * whole)
    ends = ends.where("strange = 0") if whole else ends
    return ends.select(family, top("low", "high").alias("top")).select(family, "top.mrca", "top.span")


def holders(members: DataFrame, clades: Clades, closed: DataFrame, family: str = "family", species: str = "species") -> DataFrame:
    """(family, node): the nodes that have all of a family's species at or below them, which are the common ancestor and what is above it."""
    tops = mrcas(members, clades, family, species, whole=True)
    return tops.join(closed, tops["mrca"] == closed["node"]).select(family, F.col("anc").alias("node"))


def losses(members: DataFrame, clades: Clades, family: str = "family", species: str = "species", large_only: bool = False) -> DataFrame:
    """(family, losses): maximal inner nodes below each family's common ancestor that hold none of its species.

    A lone missing leaf costs nothing.  ``large_only`` leaves out nodes whose span is a single leaf.
    The nodes between the species and their ancestor lose their inner children that are not among them.  Such sums
    over the union of paths follow from sums along the paths from the root: in the order of their numbers
    each species adds what lies between it and the ancestor that it shares with the one before.
    Each family's numbers are one sorted array, so its rows stay where they are counted.
    """
    python_ready(members.sparkSession, 10_000)
    sent = members.sparkSession.sparkContext.broadcast((clades, *clades.loss_weights(large_only)))

    @F.arrow_udf("long")
    def lost(numbers: pa.Array) -> pa.Array:
        c, total, own = sent.value
        flat, many = numbers.flatten().to_numpy(zero_copy_only=False), numbers.value_lengths().to_numpy(zero_copy_only=False)
        if not len(many):
            return pa.array([], pa.int64())
        after = np.cumsum(many)
        first, low, high = after - many, flat[after - many], flat[after - 1]
        part, follows = total[flat], np.ones(len(flat), bool)
        follows[first] = False
        part[follows] -= total[c.mrca(flat[:-1][follows[1:]], flat[follows])]
        top = c.mrca(low, high)
        # What lies above the ancestor does not count, and itself it is no inner child of what does.
        return pa.array(np.add.reduceat(part, first) - np.where(top > 0, total[c.parent[top]], 0) + own[top])

    sets = _numbered(members, clades, family, species).groupBy(family).agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    return sets.select(family, lost("numbers").alias("losses"))


def nearest_kept(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, parent) of the rows (by, node, parent, gone) that are not gone; parents are the nearest ancestors that stay.

    By pointer jumping among the gone nodes: each looks past the gone node that it points to, twice as far a
    round, so rounds grow with the logarithm of the longest run of gone nodes.
    """
    jump, _, n = write_counted(rows.where("gone").select(*by, "node", F.col("parent").alias("to")), "jump")
    while n:
        ahead = jump.select(*by, F.col("node").alias("to"), F.col("to").alias("next"), F.lit(True).alias("again"))
        moved = jump.join(ahead, [*by, "to"], "left").select(*by, "node", F.when(F.col("again"), F.col("next")).otherwise(F.col("to")).alias("to"), F.coalesce("again", F.lit(False)).alias("again"))
        seen = Observation()
        moved, _ = write_shared(moved.observe(seen, F.count_if("again").alias("n")), "jump")
        jump, n = moved.drop("again"), seen.get["n"]
    past = jump.select(*by, F.col("node").alias("parent"), F.col("to"), F.lit(True).alias("past"))
    kept = rows.where(~F.col("gone")).select(*by, "node", "parent").join(past, [*by, "parent"], "left")
    return kept.select(*by, "node", F.when(F.col("past"), F.col("to")).otherwise(F.col("parent")).alias("parent"))


def reachable(tree: DataFrame, content: DataFrame, by: list[str]) -> DataFrame:
    """Rows of tree (by, node, parent) that have content (by, node) at or below them.

    One join a level, from the content upwards; each level's new nodes are written to
    the shared folder, so neither the rows nor the height have a limit.
    """
    ups = tree.where("parent is not null")
    seen, _ = write_shared(content.select(*by, "node").distinct(), "reached")
    level = seen
    while True:
        above = level.join(ups, [*by, "node"]).select(*by, F.col("parent").alias("node")).distinct()
        level, _ = write_shared(above.join(seen, [*by, "node"], "left_anti"), "reached")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return tree.join(seen, [*by, "node"], "left_semi")


def reachable_in_one(closed: DataFrame, content: DataFrame, by: list[str]) -> DataFrame:
    """(by, node): what ``reachable`` keeps where all groups have the same tree, of which ``closed`` is the closure; no copy of it is made for a group."""
    return content.select(*by, "node").distinct().join(closed, "node").select(*by, F.col("anc").alias("node")).distinct()


def polytomies(tree: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, node, children) of nodes with more than two children."""
    keys = by or []
    return tree.where("parent is not null").groupBy(*keys, F.col("parent").alias("node")).agg(F.count("*").alias("children")).where("children > 2")
