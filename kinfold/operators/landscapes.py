"""Gene neighbourhoods: windows, size classes, runs, tandems and pair scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import sequences
from kinfold.operators import tiles
from kinfold.shared import python_ready, write_shared

#: Neighbours on either side; landscapes of more symbols than this are core; most paths to enumerate.
HALF_WINDOW, CORE_SIZE, MOST_PATHS = 15, 20, 10_000
#: Paths of a batch's pairs that are followed side by side.
PATHS_AT_A_TIME = 200_000


def windows(genes: DataFrame, chromosome: list[str], order: list[str], symbol: str, half: int = HALF_WINDOW) -> DataFrame:
    """genes with ``landscape``: the symbols of a gene's neighbours and its own, in order."""
    w = Window.partitionBy(*chromosome).orderBy(*order).rowsBetween(-half, half)
    return genes.withColumn("landscape", F.collect_list(symbol).over(w))


def left_landscapes(genes: DataFrame, chromosome: list[str], order: list[str], symbol: str, half: int = HALF_WINDOW) -> DataFrame:
    w = Window.partitionBy(*chromosome).orderBy(*order).rowsBetween(-half, -1)
    return genes.withColumn("left", F.collect_list(symbol).over(w))


def classes(genes: DataFrame, family: str, size: Column, secondary: Column) -> DataFrame:
    """genes with ``kind``: core, extended or solo, null for what falls in none.

    Where a family has no landscape of more than 20, all its larger than 1 are core;
    tandem copies (``secondary``) are taken out after that test.
    """
    any_core = F.max(size > CORE_SIZE).over(Window.partitionBy(family))
    core = F.when(any_core, size > CORE_SIZE).otherwise(size > 1)
    kind = F.when(secondary, F.lit(None)).when(core, "core").when((size > 1) & (size <= CORE_SIZE), "extended").when(size == 1, "solo")
    return genes.withColumn("kind", kind)


def runs(rows: DataFrame, by: list[str], order: list[str], symbol: str, first: str) -> DataFrame:
    """(by, run, symbol, weight, first): runs of equal neighbours in order; ``first`` is kept of a run's first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.coalesce((F.lag(symbol).over(w) != F.col(symbol)).cast("int"), F.lit(1))
    numbered = rows.withColumn("new run", starts).withColumn("run", F.sum("new run").over(w))
    return numbered.groupBy(*by, "run").agg(F.first(symbol).alias(symbol), F.count("*").alias("weight"), F.min_by(first, F.struct(*order)).alias("first"))


def tandems(genes: DataFrame, family: str, place: list[str], gene: str, left_family: Column) -> DataFrame:
    """(family, first, rest): tandem arrays of more than one gene.

    Genes of a family are taken in order of place; one whose immediate left neighbour
    is of its own family joins the group before it in that order.
    """
    w = Window.partitionBy(family).orderBy(*place)
    joins = F.coalesce(left_family == F.col(family), F.lit(False)) & (F.row_number().over(w) > 1)
    grouped = genes.withColumn("opens", (~joins).cast("int")).withColumn("group", F.sum("opens").over(w))
    members = grouped.groupBy(family, "group").agg(F.array_sort(F.collect_list(F.struct(*place, gene))).alias("m"))
    return members.where(F.size("m") > 1).select(family, F.col("m")[0][gene].alias("first"), F.transform(F.slice("m", 2, F.size("m")), lambda x: x[gene]).alias("rest"))


def pairs(genes: DataFrame, family: str, idx: str, *columns: str) -> DataFrame:
    """All pairs of a family, the later gene first: columns with i_ and j_ before their names; in tiles."""
    names = (idx, *columns)
    return tiles.pair_up(genes, family, idx, {c: f"i_{c}" for c in names}, {c: f"j_{c}" for c in names})


def _runs(seq) -> tuple[list, list[int]]:
    """Symbols and lengths of runs; an empty sequence has none."""
    out, n = [], []
    for x in seq:
        if out and out[-1] == x:
            n[-1] += 1
        else:
            out.append(x)
            n.append(1)
    return out, n


def _lcs(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _best_paths(wa: list[list[int]], wb: list[list[int]], matches: list[list[list[int]]]) -> np.ndarray:
    """The best value of each pair's paths, all paths of all pairs side by side, a step for each run.

    matches: for each pair and run of its first landscape the places of its symbol among the second's runs.
    """
    n, longest = len(matches), max(len(m) for m in matches)
    size = np.array([len(m) for m in matches])
    pair = np.arange(n)
    paths = np.full((n, longest), -1, np.int16)
    for i in range(longest):
        here = [m[i] if i < len(m) else [] for m in matches]
        count = np.array([len(h) for h in here])
        start = np.cumsum(count) - count
        places = np.array([j for h in here for j in h], np.int16)
        times = np.maximum(count[pair], 1)
        row = np.repeat(np.arange(len(pair)), times)
        which = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        found = count[pair[row]] > 0
        j = np.full(len(row), -1, np.int16)
        j[found] = places[start[pair[row]][found] + which[found]]
        used = found & (paths[row, :i] == j[:, None]).any(axis=1)
        keep = ~used | (which == 0)  # a path whose first place is used goes on without one
        row, j = row[keep], np.where(used, -1, j)[keep]
        paths, pair = paths[row], pair[row]
        paths[:, i] = j
    a, b = np.zeros((n, longest), np.int64), np.zeros((n, max(map(len, wb))), np.int64)
    for k in range(n):
        a[k, : len(wa[k])], b[k, : len(wb[k])] = wa[k], wb[k]
    value = np.where(paths >= 0, np.minimum(a[pair], b[pair[:, None], np.maximum(paths, 0)]), 0).sum(axis=1).astype(np.float64)
    long = size[pair] > 2
    if longest > 1:
        towards = np.sign(np.maximum(paths[:, 1], 0) - np.maximum(paths[:, 0], 0))
        for i in range(1, longest):
            step = np.sign(paths[:, i] - paths[:, i - 1])
            turn = long & (paths[:, i] >= 0) & (paths[:, i - 1] >= 0) & (step != towards)
            value -= 0.5 * turn
            towards = np.where(turn, step, towards)
    best = np.full(n, -np.inf)
    np.maximum.at(best, pair, value)
    return best


def threaded_scores(first: list, second: list) -> np.ndarray:
    """For each pair of landscapes the best path that threads the first one's runs through the second's; not symmetric.

    With more than 10,000 paths, the subsequence score of both directions instead.
    Landscapes without a common symbol, or of which one is empty, score 0.
    """
    out = np.zeros(len(first), np.float32)
    held: list[tuple] = []
    paths = 0

    def settle() -> None:
        nonlocal paths
        if held:
            at, wa, wb, matches = zip(*held)
            best = _best_paths(wa, wb, matches)
            best = np.trunc(np.where(best >= 1, best - 1, best) * 2) / 2
            at = list(at)
            out[at] = best.astype(np.float32) / sizes[at]
            held.clear()
            paths = 0

    sizes = np.array([max(len(a), len(b), 1) for a, b in zip(first, second)], np.float32)
    for k, (a, b) in enumerate(zip(first, second)):
        (sa, wa), (sb, wb) = _runs(a), _runs(b)
        where: dict = {}
        for j, y in enumerate(sb):
            where.setdefault(y, []).append(j)
        matches = [where.get(x, []) for x in sa]
        if not any(matches):
            continue
        number = 1
        for m in matches:
            number *= max(1, len(m))
        if number > MOST_PATHS:
            best = max(_lcs(a, b), _lcs(a, b[::-1]))
            out[k] = np.float32(best - 1 if best >= 1 else best) / sizes[k]
            continue
        if paths + number > PATHS_AT_A_TIME:
            settle()
        held.append((k, wa, wb, matches))
        paths += number
    settle()
    return out


def threaded_score(a, b) -> float:
    return float(threaded_scores([a], [b])[0])


def _one_path(a_sym: Column, b_sym: Column) -> Column:
    """The places, from 1 or null, that runs of the first landscape take in a second without repeated symbols."""
    return F.transform(a_sym, lambda x, i: F.when(F.array_position(a_sym, x) == i + 1, F.nullif(F.array_position(b_sym, x), F.lit(0).cast("long"))).cast("int"))


def _path_score(path: Column, weights: Column, size: Column) -> Column:
    """The score of a single path in built-in functions."""
    turn = lambda s, k: s["last"].isNotNull() & k.isNotNull() & (F.signum(k - s["last"]) != s["towards"])
    place = lambda i: F.coalesce(F.get(path, i) - 1, F.lit(0))
    start = F.struct(F.signum(place(1) - place(0)).alias("towards"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("turns"))
    walk = lambda s, k: F.struct(F.when(turn(s, k), F.signum(k - s["last"])).otherwise(s["towards"]).alias("towards"), k.alias("last"), (s["turns"] + F.when(turn(s, k), 1).otherwise(0)).alias("turns"))
    turns = F.when(F.size(path) > 2, F.aggregate(path, start, walk, lambda s: s["turns"])).otherwise(0)
    value = F.aggregate(weights, F.lit(0), lambda s, w: s + w) - 0.5 * turns
    value = sequences.without_self(value)
    halves = F.when(value >= 0, F.floor(value * 2)).otherwise(F.ceil(value * 2)) / 2
    return F.when(F.exists(path, lambda j: j.isNotNull()), (halves.cast("float") / size.cast("float")).cast("float")).otherwise(F.lit(0.0).cast("float"))


def threaded_pairs(genes: DataFrame, family: str, idx: str, landscape: str) -> DataFrame:
    """(family, i_idx, j_idx, score): the threaded score of all pairs of a family, the later gene first.

    Where the first landscape has none of the symbols that the second one's runs have twice there is one path, which
    built-in functions follow; runs are taken once a gene.  The other pairs go through ``threaded_scores``,
    an Arrow batch at a time: on the tables under a quarter of them.
    """
    python_ready(genes.sparkSession, 10_000)
    runs = genes.select(family, idx, F.col(landscape).alias("seq"), sequences.run_lengths(F.col(landscape)).alias("runs"))
    runs = runs.select(family, idx, "seq", F.transform("runs", lambda r: r["sym"]).alias("sym"), F.transform("runs", lambda r: r["w"]).alias("w"))
    twice = F.filter("sym", lambda x, i: F.array_position("sym", x) != i + 1)
    runs = runs.withColumns({"twice": twice, "odd": F.exists("sym", lambda x: x.isNull()) | (F.size(twice) > 0)})
    runs, _ = write_shared(runs, "runs")  # both kinds of pairs read them on both sides
    paired = pairs(runs, family, idx, "seq", "sym", "w", "twice", "odd")
    branches = F.coalesce(F.arrays_overlap("i_sym", "j_twice"), F.lit(True)) | F.exists("j_sym", lambda x: x.isNull())
    keys = [family, f"i_{idx}", f"j_{idx}"]
    one = paired.where(~(F.col("j_odd") & branches))
    one = one.select(*keys, "i_w", "j_w", _one_path(F.col("i_sym"), F.col("j_sym")).alias("path"), F.greatest(F.size("i_seq"), F.size("j_seq")).alias("size"))
    one = one.withColumn("weights", F.zip_with("path", "i_w", lambda j, w: F.when(j.isNotNull(), F.least(w, F.get("j_w", j - 1))).otherwise(0)))
    one = one.select(*keys, _path_score(F.col("path"), F.col("weights"), F.col("size")).alias("score"))

    @F.pandas_udf("float")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(threaded_scores([list(p) for p in x], [list(p) for p in y]), dtype="float32")

    many = paired.where(F.col("j_odd") & branches).select(*keys, score("i_seq", "j_seq").alias("score"))
    return one.unionByName(many)


def lcs_of_pairs(genes: DataFrame, family: str, idx: str, landscape: str) -> DataFrame:
    """(family, i_idx, j_idx, score): the subsequence score of all pairs of a family, the later gene first; where symbols stand is found once a gene."""
    marked = genes.select(family, idx, landscape, sequences.match_masks(F.col(landscape)).alias("masks"))
    paired = tiles.pair_up(marked, family, idx, {idx: f"i_{idx}", landscape: "a"}, {idx: f"j_{idx}", landscape: "b", "masks": "masks"})
    found = paired.withColumn("found", sequences.matches(F.col("a"), F.col("masks"))).drop("masks")
    return found.select(family, f"i_{idx}", f"j_{idx}", sequences.lcs_score(F.col("a"), F.col("b"), F.col("found")).alias("score"))


def lcs_pairs(paired: DataFrame, a: str, b: str) -> DataFrame:
    return paired.withColumn("score", sequences.lcs_score(F.col(a), F.col(b)))
