"""Threshold clustering, quality of clusterings, peaks and the choice of a threshold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinfold.functions import trees
from kinfold.functions.sequences import round_half_up
from kinfold.shared import bounded, python_ready, tidy, write_counted, write_shared

#: Matrix values between these are tried as thresholds; the chosen one is lowered by this much.
BAND, LOWERED = (0.15, 0.7), 0.1
NEAR_REDUNDANCY, NEAR_COMPACTNESS = 1.1, 0.95
#: Tasks that share a family's thresholds at least, and bytes of labels in one of them.
CHUNKS, LABEL_BYTES = 8, 16 << 20
#: Rows of a scan between looks for thresholds that are settled.
SETTLED_EVERY = 32
#: Thresholds of a family, the highest, whose peaks say what others must reach.
FIRST = 1024


@dataclass
class Limits:
    """What a scan needs to leave thresholds out that are not near the least redundant peak whatever the rest of the rows.

    ``opened``: labels that a threshold's whole scan opens, one for each item without an edge to one before it; ``lone``: its items without an edge.
    Labels in use and those still to be opened are no fewer than the clusters at the end, as a label that is given up never returns.  A cluster holds
    each of the ``kinds`` species once, a lone item's just one; the redundancy is the ``size`` over the sum of that.
    """

    size: int
    kinds: int
    most: float
    opened: np.ndarray
    lone: np.ndarray

    @classmethod
    def of(cls, thresholds: np.ndarray, before: np.ndarray, all_: np.ndarray, kinds: int, most: float) -> Limits:
        """before, all_: the largest value of each item with the items before it, and with all; most: the redundancy that a threshold may have."""
        count = lambda x: np.searchsorted(np.sort(x), thresholds, side="left")
        return cls(len(before), kinds, most, count(before), count(all_))

    def beyond(self, which: np.ndarray, clusters: np.ndarray | None = None) -> np.ndarray:
        """Whether thresholds of so many clusters at most have a redundancy over ``most``, by more than it is rounded."""
        clusters = self.opened[which] if clusters is None else clusters
        lone = np.minimum(self.lone[which], clusters)
        return self.size > (self.most + 0.011) * np.minimum(self.size, lone + self.kinds * (clusters - lone))

    def some(self, which: np.ndarray) -> Limits:
        return Limits(self.size, self.kinds, self.most, self.opened[which], self.lone[which])


class LabelScan:
    """Labels of a family's items at several thresholds (ascending), by one scan of the rows of its matrix.

    The outcome depends on the rows' order, and need not be the connected components.  A row without a label opens
    one.  Along a row, an item at or over the threshold that is free or already has the
    row's label gets it; where it has another, earlier items with the row's label move to
    the other, which the row carries on with.

    So at a row's end everything that it took or moved has the last label met, ``end``; of another label that it met or
    began with, the items before the next label's place have it too.  That is done for all thresholds side by side.  Labels whose
    items the row meets without exception are moved by these; only others are looked for among all items.  With ``n`` items known, thresholds at which
    all have one label need no further rows and are dropped; so are, with ``limits``, those that cannot matter, which are no more in ``kept``.
    """

    def __init__(self, thresholds: np.ndarray, n: int = 0, limits: Limits | None = None):
        self.thresholds = np.asarray(thresholds)
        self.limits = limits
        self.kept = np.ones(len(self.thresholds), bool)
        self.known = n
        count, kind = len(self.thresholds), np.int16 if 0 < n < 1 << 15 else np.int32
        #: Thresholds that still change; a row such a threshold, a column an item: labels, and the items of each label.
        self.open = np.arange(count)
        self.held = np.full((count, max(1, n)), -1, kind)
        self.size = np.zeros((count, max(1, n)), kind)
        self.fresh = np.zeros(count, np.int32)
        self.n, self.rows = n, 0

    @property
    def labels(self) -> np.ndarray:
        """(thresholds, items)."""
        out = np.zeros((len(self.thresholds), self.n), np.int32)
        out[self.open] = self.held[:, : self.n]
        return out

    def _room(self, n: int) -> None:
        self.n = max(self.n, n)
        if n > (had := self.held.shape[1]):
            more = max(n, 2 * had) - had
            self.held = np.pad(self.held, ((0, 0), (0, more)), constant_values=-1)
            self.size = np.pad(self.size, ((0, 0), (0, more)))

    def _drop_settled(self) -> None:
        first = self.held[:, :1]
        on = ((self.held[:, : self.n] != first) | (first < 0)).any(axis=1)
        if self.limits is not None:
            top = int(self.fresh.max(initial=0))
            used = np.count_nonzero(self.size[:, :top], axis=1)
            out = self.limits.beyond(self.open, used + self.limits.opened[self.open] - self.fresh)
            self.kept[self.open[out]] = False
            on &= ~out
        if not on.all():
            self.open, self.fresh = self.open[on], self.fresh[on]
            self.held, self.size = self.held[on], self.size[on]

    def row(self, i: int, js: np.ndarray, values: np.ndarray) -> None:
        """Row i: items js in order and their values; those under every threshold may be left out."""
        self._room(max(i, int(js[-1]) if len(js) else 0) + 1)
        self.rows += 1
        if self.known and self.rows % SETTLED_EVERY == 0:
            self._drop_settled()
        if not len(self.open):
            return
        new = np.flatnonzero(self.held[:, i] < 0)
        self.held[new, i] = self.fresh[new]
        self.size[new, self.fresh[new]] = 1
        self.fresh[new] += 1
        if not len(js):
            return
        low = self.thresholds[self.open]
        m = int(np.searchsorted(low, values.max(), side="right"))
        js = js[at] if len(at := np.flatnonzero(values >= low[0])) < len(js) else js
        values = values[at]
        if not m:
            return
        seen = np.take(self.held[:m], js, axis=1)
        if (seen == self.held[:m, i, None]).all():
            return
        live, seen = (values >= low[:m, None]).T, seen.T
        named = live & (seen >= 0)
        now = self.held[:m, i].copy()
        end = now.copy()
        clash = np.flatnonzero((named & (seen != now)).any(axis=0))
        if len(clash):
            met, label = named[:, clash], seen[:, clash]
            last = len(js) - 1 - met[::-1].argmax(axis=0)
            end[clash] = label[last, np.arange(len(clash))]
            self._move(i, js, clash, met, label, now[clash], end[clash])
        k, t = np.nonzero(live & ~named)
        self.held[t, js[k]] = end[t]
        self.size[np.arange(m), end] += np.bincount(t, minlength=m).astype(self.size.dtype)

    def _move(self, i: int, js: np.ndarray, columns: np.ndarray, met: np.ndarray, label: np.ndarray, now: np.ndarray, end: np.ndarray) -> None:
        """Items of the labels that a row leaves, up to the place of the next one, get its last label."""
        after = np.minimum.accumulate(np.where(met, js[:, None], np.iinfo(np.int64).max)[::-1])[::-1]
        k, c = np.nonzero(met & (label != end))
        own = np.flatnonzero(now != end)
        item = np.concatenate((js[k], np.full(len(own), i)))
        which = np.concatenate((c, own))
        left = np.concatenate((label[k, c], now[own])).astype(np.int64)
        until = np.concatenate((after[np.minimum(k + 1, len(js) - 1), c], after[0, own]))
        key = which * self.held.shape[1] + left
        order = np.lexsort((until, key))
        item, which, left, until, key = (x[order] for x in (item, which, left, until, key))
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(starts[1:], len(key))
        until = until[ends - 1]  # the last place at which the label is left
        # A row never meets itself, so what it meets and itself are different items.
        whole = self.size[columns[which[starts]], left[starts]] == ends - starts
        group = np.repeat(np.arange(len(starts)), ends - starts)
        near = whole[group] & (item < until[group])
        self._rename(item[near], columns[which[near]], left[near], end[which[near]])
        far = np.flatnonzero(~whole)
        # One label of each threshold at a time.
        turn = np.arange(len(far)) - np.searchsorted(which[starts[far]], which[starts[far]])
        for r in range(int(turn.max(initial=-1)) + 1):
            some = far[turn == r]
            w, lab, stop = which[starts[some]], left[starts[some]], until[some]
            t, to, top = columns[w], end[w], int(stop.max())
            block = self.held[t, :top]
            lab = lab.astype(block.dtype)
            gone = block == lab[:, None]
            for x, y in zip(gone, stop.tolist()):
                x[y:] = False
            block += np.multiply(gone, (to - lab)[:, None], dtype=block.dtype)
            self.held[t, :top] = block
            count = np.array([np.count_nonzero(x) for x in gone], block.dtype)
            self.size[t, lab] -= count
            self.size[t, to] += count

    def _rename(self, items: np.ndarray, rows: np.ndarray, left: np.ndarray, to: np.ndarray) -> None:
        self.held[rows, items] = to
        np.subtract.at(self.size, (rows, left), 1)
        np.add.at(self.size, (rows, to), 1)

    def figures(self, kinds: np.ndarray, clades: trees.Clades) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each threshold that is kept the kinds of all clusters, the sum of their shares of the span of their common ancestor, and the clusters.

        kinds: the species' number of each item, as ``clades`` numbers them.
        """
        n, count = self.n, int(self.kept.sum())
        if not n * count:
            return np.zeros(count, np.int64), np.zeros(count), np.zeros(count, np.int64)
        labels = self.labels[self.kept].ravel()
        order = np.lexsort((np.tile(kinds, count), labels, np.repeat(np.arange(count), n)))
        t, label, kind = np.repeat(np.arange(count), n)[order], labels[order], np.tile(kinds, count)[order]
        begins = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(label, prepend=-2) != 0))
        new = np.ones(len(t), bool)
        new[1:] = (kind[1:] != kind[:-1])
        new[begins] = True
        size = np.add.reduceat(new.astype(np.int64), begins)
        last = np.append(begins[1:], len(t)) - 1
        share = size / clades.span_of_range(kind[begins], kind[last])
        of = t[begins]
        return np.bincount(of, size, count).astype(np.int64), np.bincount(of, share, count), np.bincount(of, minlength=count)


def _scan_dense(matrix: np.ndarray, thresholds: np.ndarray, limits: Limits | None = None) -> LabelScan:
    scan = LabelScan(thresholds, len(matrix), limits)
    for i, row in enumerate(matrix):
        if not len(scan.open):
            break
        js = np.flatnonzero(row >= thresholds[0])
        scan.row(i, js, row[js])
    return scan


def ordered_clusters(matrix: np.ndarray, threshold: float) -> list[list[int]]:
    """Clusters of a matrix in memory by ``LabelScan``."""
    found: dict[int, list[int]] = {}
    for i, x in enumerate(_scan_dense(matrix, np.array([threshold])).labels[0, : len(matrix)].tolist()):
        found.setdefault(x, []).append(i)
    return sorted(found.values())


def _both_ways(lower: DataFrame, *more: str) -> DataFrame:
    turned = lower.select("family", *more, F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return lower.select("family", *more, "i", "j", "value").unionByName(turned)


def _rows(batches, keys: int):
    """Runs of equal keys and row number of a sorted stream: (keys, i, record batches); only one run is held."""
    held, name = [], None
    for b in batches:
        columns = [b.column(k) for k in range(keys + 1)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            x = np.asarray(c.to_pylist(), object)
            change[1:] |= x[1:] != x[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for at, end in zip(edges, edges[1:]):
            if at == end:
                continue
            own = tuple(c[at].as_py() for c in columns)
            if held and own != name:
                yield name[:-1], name[-1], pa.Table.from_batches(held)
                held = []
            name = own
            held.append(b.slice(at, end - at))
    if held:
        yield name[:-1], name[-1], pa.Table.from_batches(held)


def clusters_of(members: DataFrame, lower: DataFrame, threshold: float, name: str = "gene") -> DataFrame:
    """(family, name, cluster): the first member of each member's ordered cluster.

    members: (family, idx, name), idx from 0 in the family; lower: (family, i, j, value), i > j.  Edges under the threshold go before
    anything moves.  The others are sorted by row within a family's partition and streamed into
    the label array, which is all that a task holds of a family, with its names.
    """
    python_ready(members.sparkSession, 10_000)
    kind = members.schema[name].dataType
    family = members.schema["family"].dataType
    edges = _both_ways(lower.where(F.col("value") >= threshold)).withColumn("name", F.lit(None).cast(kind))
    marks = members.select("family", F.col("idx").cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0.0).alias("value"), F.col(name).alias("name"))
    rows = edges.select("family", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"), "name").unionByName(marks)
    # By a hash of its own: Spark would leave out the shuffle by a column by which the union's sides are dealt already, and then merge their parts apart.
    sent = rows.repartition(F.xxhash64("family")).sortWithinPartitions("family", "i", "j")

    def run(batches):
        now, scan, names = None, None, []

        def out():
            labels = scan.labels[0, : scan.n]
            _, first, which = np.unique(labels, return_index=True, return_inverse=True)
            own = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(own), to_arrow_type(family)), own, own.take(pa.array(first[which]))], ["family", name, "cluster"])

        for key, i, block in _rows(batches, 1):
            if scan is not None and key != now:
                yield out()
                scan = None
            if scan is None:
                now, scan, names = key, LabelScan(np.array([threshold])), []
            block = block.combine_chunks().to_batches()[0]
            names.append(block.column("name").slice(0, 1))
            scan.row(i, block.column("j").to_numpy()[1:], block.column("value").to_numpy()[1:])
        if scan is not None:
            yield out()

    return sent.mapInArrow(tidy(run), f"family {family.simpleString()}, {name} {kind.simpleString()}, cluster {kind.simpleString()}")


def threshold_table(members: DataFrame, lower: DataFrame, tree: list[tuple], species: str = "species") -> DataFrame:
    """(family, threshold, redundancy, compactness): the ordered clusters at each value of the band.

    members: (family, idx, species); lower as in ``clusters_of``; tree: the species tree's (node, parent) rows, of a checked
    number.
    """
    sizes = members.groupBy("family").agg(F.count("*").alias("n"))
    tried = band_values(lower, "family").withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy("value")) - 1)
    return _scans(tried.join(sizes, "family"), members, lower, tree, species).drop("place")


def _scans(tried: DataFrame, members: DataFrame, lower: DataFrame, tree: list[tuple], species: str, least_chunks: int = CHUNKS) -> DataFrame:
    """(family, place, threshold, redundancy, compactness) of the thresholds tried, but for those that their ``Limits`` leave out.

    tried: (family, value, place, n) and, for limits, (kinds, most, opened, lone).  A family's thresholds are cut in order into at least
    ``least_chunks`` chunks, each a task of its own with ``LABEL_BYTES`` of labels at most; each streams the family's edges from its lowest threshold on
    once, in order.
    """
    spark = members.sparkSession
    python_ready(spark, 10_000)
    family = members.schema["family"].dataType
    limits = {"place": "long", "kinds": "long", "most": "double", "opened": "long", "lone": "long"}
    limit = F.struct(*[(F.col(c) if c in tried.columns else F.lit(None)).cast(t).alias(c) for c, t in limits.items()]).alias("limit")
    tried, _ = write_shared(tried.select("family", "value", "n", limit), "tried")
    counted = tried.groupBy("family").agg(F.count("*").alias("tried"), F.max("n").alias("most"))
    chunks = counted.select("family", "tried", F.greatest(F.lit(least_chunks), F.ceil(F.col("tried") * F.col("most") * 4 / LABEL_BYTES)).cast("int").alias("chunks"))
    chunks, _ = write_shared(chunks, "chunks")
    place = F.row_number().over(Window.partitionBy("family").orderBy("value")) - 1
    placed = tried.join(chunks, "family").withColumn("chunk", F.floor(place * F.col("chunks") / F.col("tried")).cast("int"))
    heads, _ = write_shared(placed.select("family", "chunk", "value", "n", "limit"), "heads")
    each, _, n = write_counted(heads.groupBy("family", "chunk").agg(F.min("value").alias("least")), "each")
    lows = bounded(each.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("least", "chunk"))).alias("lows")), n)
    none = F.lit(None).cast(heads.schema["limit"].dataType).alias("limit")
    marks = each.join(members.select("family", F.col("idx").cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0.0).alias("value"), F.col(species).cast("long").alias("kind")), "family")
    over = _both_ways(lower.where(F.col("value") > BAND[0])).join(lows, "family").select("*", F.explode(F.filter("lows", lambda x: x["least"] <= F.col("value"))["chunk"]).alias("chunk"))
    edges = over.select("family", "chunk", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value", F.lit(None).cast("long").alias("kind"), none)
    heads = heads.select("family", "chunk", F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), "value", F.col("n").alias("kind"), "limit")
    sent = heads.unionByName(marks.select(*edges.columns[:-1], none)).unionByName(edges).repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("family", "chunk")).sortWithinPartitions("family", "chunk", "i", "j", "value")

    def run(batches):
        clades = trees.Clades(tree)
        now, scan, kinds, places = None, None, [], None

        def out():
            numbers = clades.number(np.array(kinds))
            total, share, count = scan.figures(numbers, clades)
            columns = [pa.array([now[0]] * len(total), to_arrow_type(family)), pa.array(places[scan.kept]), pa.array(scan.thresholds[scan.kept]), pa.array(np.full(len(total), len(kinds))), pa.array(total), pa.array(share), pa.array(count.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["family", "place", "threshold", "size", "kinds", "share", "clusters"])

        for key, i, block in _rows(batches, 2):
            if key != now:
                if scan is not None:
                    yield out()
                now, scan, kinds = key, None, []
            block = block.combine_chunks().to_batches()[0]
            if i < 0:
                size, (places, counts, mosts, opened, lone) = block.column("kind")[0].as_py(), (block.column("limit").field(c) for c in limits)
                places = places.to_numpy()
                bound = None if mosts.null_count else Limits(size, counts[0].as_py(), mosts[0].as_py(), opened.to_numpy(), lone.to_numpy())
                scan = LabelScan(block.column("value").to_numpy(), size, bound)
            else:
                kinds.append(block.column("kind")[0].as_py())
                scan.row(i, block.column("j").to_numpy()[1:], block.column("value").to_numpy()[1:])
        if scan is not None:
            yield out()

    found = sent.mapInArrow(tidy(run), f"family {family.simpleString()}, place long, threshold double, size long, kinds long, share double, clusters long")
    return found.select("family", "place", "threshold", round_half_up(F.col("size") / F.col("kinds"), 2).alias("redundancy"), round_half_up(F.col("share") / F.col("clusters"), 2).alias("compactness"))


def _with_limits(members: DataFrame, lower: DataFrame, species: str) -> DataFrame:
    """(family, value, place, tried, n, kinds, opened, lone): the values of the band with what ``Limits`` needs of them."""
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct(species).alias("kinds"))
    edges = lower.where((F.col("value") > BAND[0]) & ~F.isnan("value"))
    ends = edges.select("family", F.col("i").alias("idx"), "value", F.col("value").alias("before")).unionByName(edges.select("family", F.col("j").alias("idx"), "value", F.lit(None).cast("double").alias("before")))
    ends, _ = write_shared(ends.groupBy("family", "idx").agg(F.max("value").alias("value"), F.max("before").alias("before")), "ends")
    values = band_values(lower, "family").select("family", "value", F.lit(0).alias("kind"))
    marks = values.unionByName(ends.select("family", "value", F.lit(1).alias("kind"))).unionByName(ends.where("before is not null").select("family", F.col("before").alias("value"), F.lit(2).alias("kind")))
    family = Window.partitionBy("family")
    upwards = family.orderBy(F.desc("value"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Items with an edge of a value or more; the others have none, or open a label.
    over = lambda kind: F.count_if(F.col("kind") == kind).over(upwards)
    counted = marks.withColumns({"linked": over(1), "met": over(2)}).where("kind = 0")
    placed = counted.withColumns({"place": F.row_number().over(family.orderBy("value")) - 1, "tried": F.count("*").over(family)})
    return placed.join(sizes, "family").select("family", "value", "place", "tried", "n", "kinds", (F.col("n") - F.col("met")).alias("opened"), (F.col("n") - F.col("linked")).alias("lone"))


def choose_thresholds(members: DataFrame, lower: DataFrame, tree: list[tuple], species: str = "species", sums: Callable | None = None) -> DataFrame:
    """(family, threshold) of each family as of ``threshold_table``.

    Of the peaks of compactness the first that is near the least redundant and the most compact; the mean of all values tried
    where there is no peak, the mean of the whole matrix where no value lies in the band.  ``sums`` gives (family, sum) of
    the matrices of some (family) rows, where ``lower`` does not have all values.

    The ``FIRST`` highest thresholds give a peak, and so a redundancy that counts.  Of the others those proven over it are left out, as they can
    neither be chosen nor change the least or the most of those that can; then what may be a peak has its neighbours counted too.  Without a
    peak nothing is left out.
    """
    tried, _ = write_shared(_with_limits(members, lower, species), "limits")
    plain = tried.select("family", "value", "place", "n")
    first = F.col("place") >= F.col("tried") - FIRST
    tables = [write_shared(_scans(tried.where(first).select(plain.columns), members, lower, tree, species), "first")[0]]

    def peaks_of(rows: DataFrame) -> DataFrame:
        return peaks(rows, ["family"], ["threshold"], "compactness", "place")

    least = peaks_of(tables[0]).groupBy("family").agg((NEAR_REDUNDANCY * F.min("redundancy")).alias("most"))
    later = tried.where(~first).join(least, "family", "left")
    lone = F.least("lone", "opened")
    out = F.col("n") > (F.col("most") + 0.011) * F.least("n", lone + F.col("kinds") * (F.col("opened") - lone))
    tables.append(write_shared(_scans(later.where(~F.coalesce(out, F.lit(False))), members, lower, tree, species), "later")[0])
    table = tables[0].unionByName(tables[1])
    least = peaks_of(table).groupBy("family").agg((NEAR_REDUNDANCY * F.min("redundancy")).alias("most"))
    at = Window.partitionBy("family").orderBy("place")
    side = lambda f, step: F.when(f("place").over(at) == F.col("place") + step, f("compactness").over(at))
    beside = table.withColumns({"before": side(F.lag, -1), "after": side(F.lead, 1)}).join(least, "family").where("redundancy <= most and not coalesce(before >= compactness, false) and not coalesce(compactness < after, false)")
    missing = beside.select("family", F.explode(F.array(F.when(F.col("before").isNull(), F.col("place") - 1), F.when(F.col("after").isNull(), F.col("place") + 1))).alias("place")).where("place is not null").distinct()
    missing, _, n = write_counted(plain.join(missing, ["family", "place"], "left_semi"), "missing")
    if n:
        tables.append(write_shared(_scans(missing, members, lower, tree, species, 1), "beside")[0])
        table = table.unionByName(tables[-1])
    best = near_best(peaks_of(table), ["family"], "redundancy", "compactness", ["threshold"])
    mean = tried.groupBy("family").agg(F.avg("value").alias("tried"))
    sizes = members.groupBy("family").agg(F.count("*").alias("n"))
    without = sizes.join(mean, "family", "left_anti")
    whole = sums(without.select("family")).select("family", "sum") if sums else lower.groupBy("family").agg(F.sum("value").alias("sum"))
    out = sizes.join(best.select("family", "threshold"), "family", "left").join(mean, "family", "left").join(whole, "family", "left")
    return out.select("family", F.coalesce("threshold", "tried", 2 * F.coalesce("sum", F.lit(0.0)) / (F.col("n") * F.col("n"))).alias("threshold"))


def band_values(matrix: DataFrame, family: str) -> DataFrame:
    """(family, value): the distinct values of a matrix inside the band."""
    return matrix.where((F.col("value") > BAND[0]) & (F.col("value") < BAND[1])).select(family, "value").distinct()


def redundancy(members: DataFrame, family: str, cluster: str, species: str) -> DataFrame:
    """(family, redundancy): members over species, both added up over clusters, to two decimals."""
    each = members.groupBy(family, cluster, species).agg(F.count("*").alias("size"))
    return each.groupBy(family).agg(round_half_up(F.sum("size") / F.count(species), 2).alias("redundancy"))


def compactness(members: DataFrame, clades: trees.Clades, family: str, cluster: str, species: str) -> DataFrame:
    """(family, compactness): mean over clusters of species over the span of their common ancestor, to two decimals."""
    keyed = members.select(F.struct(family, cluster).alias("family"), F.col(species).alias("species"))
    kinds = keyed.groupBy("family").agg(F.count_distinct("species").alias("kinds"))
    sized = trees.mrcas(keyed, clades).join(kinds, "family")
    return sized.select(F.col(f"family.{family}").alias(family), (F.col("kinds") / F.col("span")).alias("share")).groupBy(family).agg(round_half_up(F.avg("share"), 2).alias("compactness"))


def peaks(rows: DataFrame, by: list[str], order: list[str], value: str, place: str | None = None) -> DataFrame:
    """Rows whose value is over the one before and not under the one after; first and last never count, nor do those beside a gap in ``place``."""
    w = Window.partitionBy(*by).orderBy(*order)
    near = lambda c, step: F.when(c(place).over(w) == F.col(place) + step, c(value).over(w)) if place else c(value).over(w)
    both = rows.withColumn("value before", near(F.lag, -1)).withColumn("value after", near(F.lead, 1))
    return both.where((F.col("value before") < F.col(value)) & (F.col(value) >= F.col("value after"))).drop("value before", "value after")


def near_best(rows: DataFrame, by: list[str], low: str, high: str, order: list[str]) -> DataFrame:
    """Of each group, rows near the least ``low``; of these, those near the most ``high``; of these, the first."""
    w = Window.partitionBy(*by)
    near = rows.withColumn("least", F.min(low).over(w)).where(F.col(low) <= NEAR_REDUNDANCY * F.col("least"))
    near = near.withColumn("most", F.max(high).over(w)).where(F.col(high) >= NEAR_COMPACTNESS * F.col("most"))
    return near.withColumn("rank", F.row_number().over(w.orderBy(*order))).where("rank = 1").drop("least", "most", "rank")


def half_up_all(x: np.ndarray, digits: int = 2) -> np.ndarray:
    """Half away from zero, on float32 values; infinite ones stay."""
    y = np.asarray(x, np.float32) * np.float32(10**digits)
    return (np.sign(y) * np.floor(np.abs(y) + np.float32(0.5)) / np.float32(10**digits)).astype(np.float64)


def half_up(x: float, digits: int) -> float:
    return float(half_up_all(np.array([x]), digits)[0])


def choose_threshold(matrix: np.ndarray, species: list[int], clades: trees.Clades) -> float:
    """``choose_thresholds`` of one family's matrix in memory, where a task has it anyway."""
    n = len(matrix)
    tried, held = np.zeros(0, matrix.dtype), []
    before, all_ = np.full(n, -np.inf), np.full(n, -np.inf)
    for i, row in enumerate(matrix):
        others = np.arange(n) != i
        held.append(row[(row > BAND[0]) & (row < BAND[1]) & (others | (n == 1))])
        before[i] = np.fmax.reduce(row[:i], initial=-np.inf)
        all_[i] = np.fmax.reduce(row[others], initial=-np.inf)
        if i % 256 == 255 or i == n - 1:
            tried, held = np.unique(np.concatenate((tried, *held))), []
    if not len(tried):
        return float(matrix.mean()) if matrix.size else float("nan")
    numbers = clades.number(np.array(species))
    red, comp = np.full(len(tried), np.nan), np.full(len(tried), np.nan)

    def settle(places: np.ndarray, most: float) -> None:
        """Fill the places, but for those whose redundancy is over ``most``."""
        limits = Limits.of(tried[places], before, all_, len(set(species)), most) if most < np.inf else None
        if limits is not None:
            near = ~limits.beyond(np.arange(len(places)))
            places, limits = places[near], limits.some(near)
        for at in np.array_split(np.arange(len(places)), max(1, -(-len(places) * n * 4 // LABEL_BYTES))):
            some = places[at]
            if not len(some):
                continue
            scan = _scan_dense(matrix, tried[some], None if limits is None else limits.some(at))
            k = some[scan.kept]
            total, share, count = scan.figures(numbers, clades)
            red[k] = [half_up(n / x, 2) for x in total.tolist()]
            comp[k] = [half_up(x / c, 2) for x, c in zip(share.tolist(), count.tolist())]

    def found() -> np.ndarray:
        return 1 + np.flatnonzero((comp[:-2] < comp[1:-1]) & (comp[1:-1] >= comp[2:]))

    first = max(0, len(tried) - FIRST)
    settle(np.arange(first, len(tried)), np.inf)
    least = red[found()].min(initial=np.inf)
    settle(np.arange(first), NEAR_REDUNDANCY * least)
    # What may be a peak near the least one, but has a neighbour that was left out.
    least = min(least, red[found()].min(initial=np.inf))
    k = 1 + np.flatnonzero((red[1:-1] <= NEAR_REDUNDANCY * least) & ~(comp[:-2] >= comp[1:-1]) & ~(comp[1:-1] < comp[2:]))
    beside = np.unique(np.concatenate((k - 1, k + 1)))
    settle(beside[np.isnan(comp[beside])], np.inf)
    at = found()
    if not len(at):
        return float(tried.mean())
    at = at[red[at] <= NEAR_REDUNDANCY * red[at].min()]
    return float(tried[at[comp[at] >= NEAR_COMPACTNESS * comp[at].max()][0]])
