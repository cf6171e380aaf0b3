"""Pairs in tiles, numbers by ranges, streamed clusters, threshold sweeps and greedy rounds against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.trees import Clades
from kinfold.operators import assignment, clusters, tiles


@pytest.mark.parametrize("block", [2000, 7])
def test_tiles_hold_each_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK", block)
    r = random.Random(1)
    rows = [("large", i * r.choice([1, 3]) if i % 2 else -i, f"x{i}") for i in range(90)] + [("small", i, "y") for i in range(5)] + [("one", 1, "z"), (None, 1, "n"), (None, 2, "n")]
    rows = list({(f, i): (f, i, x) for f, i, x in rows}.values())
    df = spark.createDataFrame(rows, "family string, idx long, x string").withColumns({"lo": F.lit("clash"), "bounds": F.lit(1)})
    pairs = tiles.pair_up(df, "family", "idx", {"idx": "a", "x": "x"}, {"idx": "b"})
    got = sorted((p.family, p.a, p.b) for p in pairs.collect())
    assert got == sorted((f, i, j) for f, i, _ in rows for g, j, _ in rows if f is not None and f == g and i > j)
    assert pairs.columns == ["family", "a", "x", "b"]


def test_tiles_of_a_large_family_are_even(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 50)
    df = spark.range(1000).select(F.lit(1).alias("family"), F.col("id").alias("idx"))
    bounds, n = tiles.block_bounds(df, "family", "idx")
    cuts = [0, *bounds.first().bounds, 1000]
    assert n == 1 and len(cuts) - 1 >= 20 and max(b - a for a, b in zip(cuts, cuts[1:])) <= 100


def test_numbers_by_ranges(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.7 else f"f{r.randint(0, 9)}", x) for x in r.sample(range(10_000), 2000)]
    df = spark.createDataFrame(rows, "family string, x long").repartition(7)
    want = {}
    for f in {f for f, _ in rows}:
        want.update({(f, x): k for k, x in enumerate(sorted(x for g, x in rows if g == f))})
    assert {(p.family, p.x): p.idx for p in tiles.numbered(df, ["family"], ["x"]).collect()} == want
    assert sorted(p.idx for p in tiles.numbered(df, [], ["x"]).collect()) == list(range(2000))


def scan(matrix, threshold):
    """The row scan, item by item."""
    n, label, fresh = len(matrix), [-1] * len(matrix), 0
    for i in range(n):
        if label[i] < 0:
            label[i], fresh = fresh, fresh + 1
        now = label[i]
        for j in range(n):
            if matrix[i][j] < threshold:
                continue
            if label[j] in (-1, now):
                label[j] = now
            else:
                for k in range(j):
                    label[k] = label[j] if label[k] == now else label[k]
                now = label[j]
    return label


def family_cells(r, n, family):
    m = np.round(r.random((n, n)), 1 if n < 20 else 2)
    m = np.tril(m, -1) + np.tril(m, -1).T
    return m, [(family, i, j, float(m[i, j])) for i in range(n) for j in range(i)]


def test_streamed_clusters_equal_the_scan(spark):
    r = np.random.default_rng(4)
    members, cells, want = [], [], {}
    for f, n in enumerate([1, 2, 9, 40, 120]):
        m, lower = family_cells(r, n, f)
        members += [(f, i, f"g{f}.{i}") for i in range(n)]
        cells += lower
        label = scan(m, 0.6)
        want.update({f"g{f}.{i}": f"g{f}.{label.index(label[i])}" for i in range(n)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # rows span batches
    try:
        found = clusters.clusters_of(spark.createDataFrame(members, "family int, idx int, gene string"), spark.createDataFrame(cells, "family int, i int, j int, value double"), 0.6)
        assert {x.gene: x.cluster for x in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_a_family_of_many_genes_needs_only_its_labels():
    scan_ = clusters.LabelScan(np.array([0.5]))
    for i in range(50_000):
        near = np.array([j for j in (i - 1, i + 1) if 0 <= j < 50_000 and max(i, j) % 10])
        scan_.row(i, near, np.ones(len(near)))
    assert scan_.labels.nbytes <= 2 * 4 * 65_536 and scan_.n == 50_000
    assert len(np.unique(scan_.labels[0, :50_000])) == 5000


TREE = [(0, None), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2), (7, 2), (8, 7), (9, 7)]


def chosen(matrix, species, tree):
    """The choice by plain loops; clusters as sets."""
    parent = dict(tree)

    def line(x):
        return [x] + (line(parent[x]) if parent[x] is not None else [])

    tips = [x for x in parent if x not in parent.values()]

    def span(kinds):
        top = next(x for x in line(next(iter(kinds))) if all(x in line(k) for k in kinds))
        return sum(top in line(t) for t in tips)

    values = sorted({v for row in matrix for v in row if 0.15 < v < 0.7})
    if not values:
        return float(np.mean(matrix))
    table = []
    for t in values:
        label = scan(matrix, t)
        kinds = [{s for s, x in zip(species, label) if x == y} for y in set(label)]
        table.append((t, int(len(species) / sum(map(len, kinds)) * 100 + 0.5 + 1e-9) / 100, int(sum(len(k) / span(k) for k in kinds) / len(kinds) * 100 + 0.5 + 1e-9) / 100))
    peaks = [b for a, b, c in zip(table, table[1:], table[2:]) if a[2] < b[2] >= c[2]]
    if not peaks:
        return sum(values) / len(values)
    few = [p for p in peaks if p[1] <= 1.1 * min(x[1] for x in peaks)]
    return min(p[0] for p in few if p[2] >= 0.95 * max(x[2] for x in few))


def test_thresholds_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(clusters, "LABEL_BYTES", 200)
    r = np.random.default_rng(6)
    members, cells, want = [], [], {}
    for f, n in enumerate([1, 2, 6, 15, 25, 30]):
        m, lower = family_cells(r, n, f)
        if f == 2:
            m, lower = m * 0 + 0.9, [(a, b, c, 0.9) for a, b, c, _ in lower]
            np.fill_diagonal(m, 0)
        species = [int(x) for x in r.choice([3, 4, 5, 6, 8, 9], n)]
        members += [(f, i, s) for i, s in enumerate(species)]
        cells += lower
        want[f] = chosen(m.tolist(), species, TREE)
        if n > 2:  # in memory, in single precision
            assert clusters.choose_threshold(m.astype(np.float32), species, Clades(TREE)) == pytest.approx(want[f], abs=1e-6)
    lower = spark.createDataFrame(cells, "family int, i int, j int, value double")
    members = spark.createDataFrame(members, "family int, idx int, species int")
    got = {x.family: x.threshold for x in clusters.choose_thresholds(members, lower, TREE).collect()}
    assert got == pytest.approx(want)
    tasks = clusters.threshold_table(members, lower, TREE).groupBy("family").agg(F.count("*").alias("n")).collect()
    assert {x.family for x in tasks} == {3, 4, 5}


def test_common_ancestors_by_minima():
    r = random.Random(3)
    for _ in range(30):
        n = r.randint(1, 40)
        tree = [(100 + i, None if not i else 100 + r.randrange(max(0, i - r.choice([3, 40])), i)) for i in range(n)]
        parent, c = dict(tree), Clades(tree)
        line = lambda x: [x] + (line(parent[x]) if parent[x] is not None else [])
        for _ in range(20):
            some = np.array(r.choices(list(parent), k=r.randint(1, 5)))
            numbers = c.number(some)
            want = next(x for x in line(int(some[0])) if all(x in line(int(k)) for k in some))
            assert c.nodes[c.mrca(numbers.min(keepdims=True), numbers.max(keepdims=True))[0]] == want
    deep = Clades([(0, None)] + [x for i in range(1, 10_000) for x in ((2 * i - 1, 2 * i - 3 if i > 1 else 0), (2 * i, 2 * i - 3 if i > 1 else 0))])
    assert deep.depth.max() == 9999 and deep.span[0] == 10_000
    with pytest.raises(ValueError):
        Clades([(0, None), (1, None)])


def links_of(r, group, n, genes, kinds):
    return [(group, r.choice("abc"), r.randrange(kinds), r.randrange(genes), r.choice([1, 2, 3, 4])) for _ in range(n)]


def test_rounds_equal_the_sequential_order(spark):
    r = random.Random(5)
    rows = [x for g in range(40) for x in links_of(r, g, r.choice([1, 5, 60]), 12, 5)] + links_of(r, None, 5, 3, 3)
    want = set()
    for g in {x[0] for x in rows}:
        for arm, kind, gene, _, _ in assignment.greedy_links([(a, k, x, o, gg) for gg, a, k, x, o in rows if gg == g], lambda x: (-x[3], x[0], x[1], x[2])):
            want.add((g, arm, kind, gene))
    df = spark.createDataFrame(rows, "family int, arm string, kind int, gene int, weight int")
    got = [(x.family, x.arm, x.kind, x.gene) for x in assignment.match_greedily(df.where("family is not null"), ["family"], ["arm", "kind"], "gene", [-F.col("weight")]).collect()]
    assert len(got) == len(set(got)) and set(got) == {w for w in want if w[0] is not None}
    assert assignment.match_greedily(df.limit(0), ["family"], ["arm", "kind"], "gene", [F.col("weight")]).count() == 0


def test_one_group_of_a_million_links(spark):
    """Half of the links are one gene's; nothing is gathered by group."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.lit(1).alias("family"), (F.xxhash64("id") % 3).alias("arm"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000)).alias("kind"), F.when(F.col("id") % 2 == 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(20_000))).otherwise(-1).alias("gene"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)).alias("weight"))
    got = assignment.match_greedily(df, ["family"], ["arm", "kind"], "gene", [F.col("weight")]).collect()
    rows = [tuple(x) for x in df.distinct().collect()]
    want = assignment.greedy_links([(arm, kind, gene, w) for _, arm, kind, gene, w in rows], lambda x: (x[3], x[0], x[1], x[2]))
    assert {(x.arm, x.kind, x.gene) for x in got} == {w[:3] for w in want}


def test_small_groups_are_matched_without_rounds(spark, monkeypatch):
    r = random.Random(8)
    rows = [(g if g else None, r.choice("ab"), r.randrange(3), r.randrange(4), r.randrange(5)) for g in range(30) for _ in range(r.randint(1, 12))]
    links = spark.createDataFrame(rows, "g int, arm string, kind int, gene int, cost int")
    want = []
    for g in {x[0] for x in rows}:
        own = {(arm, kind, gene, cost) for h, arm, kind, gene, cost in rows if h == g}
        want += [(g, *x[:3]) for x in assignment.greedy_links(own, lambda x: (x[3], x[0], x[1], x[2]))]
    monkeypatch.setattr(assignment, "match_in_rounds", None)  # not called where all groups are small
    got = assignment.match_greedily(links, ["g"], ["arm", "kind"], "gene", [F.col("cost")])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_large_groups_go_by_rounds_beside_small_ones(spark, monkeypatch):
    monkeypatch.setattr(assignment, "SMALL_GROUP", 6)
    r = random.Random(9)
    rows = [(g, r.choice("ab"), r.randrange(3), r.randrange(4), r.randrange(5)) for g in range(30) for _ in range(r.randint(1, 12))]
    links = spark.createDataFrame(rows, "g int, arm string, kind int, gene int, cost int")
    want = []
    for g in range(30):
        own = {(arm, kind, gene, cost) for h, arm, kind, gene, cost in rows if h == g}
        want += [(g, *x[:3]) for x in assignment.greedy_links(own, lambda x: (x[3], x[0], x[1], x[2]))]
    got = assignment.match_greedily(links, ["g"], ["arm", "kind"], "gene", [F.col("cost")])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_settled_thresholds_leave_the_scan():
    r = np.random.default_rng(2)
    m = np.round(np.abs(r.normal(size=(120, 120))), 3)
    m = np.maximum(m, m.T)
    np.fill_diagonal(m, 0)
    scan = clusters._scan_dense(m, np.array([0.15, 0.3, 0.45, 4.0]))
    assert scan.open.tolist() == [3]  # the others have one label for all items
    assert [len(np.unique(x)) for x in scan.labels] == [1, 1, 1, 120]


def grown_cells(r, n, family):
    """Rounded cosines of vectors, as in the band most pairs lie low and few high."""
    x = r.normal(size=(n, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    m = np.tril(np.round(x @ x.T, 2), -1)
    m = m + m.T
    return m, [(family, i, j, float(m[i, j])) for i in range(n) for j in range(i)]


@pytest.mark.parametrize("first", [4, 15])
def test_thresholds_that_cannot_be_chosen_are_left_out(spark, monkeypatch, first):
    """Most of a family's thresholds are proven out; the choice is that of all of them."""
    monkeypatch.setattr(clusters, "FIRST", first, raising=False)
    monkeypatch.setattr(clusters, "SETTLED_EVERY", 4)
    r = np.random.default_rng(11)
    members, cells, want, left = [], [], {}, 0
    kept = []
    figures = clusters.LabelScan.figures
    monkeypatch.setattr(clusters.LabelScan, "figures", lambda self, *a: kept.append(int(getattr(self, "kept", np.ones(len(self.thresholds))).sum())) or figures(self, *a))
    for f, n in enumerate([20, 250, 300, 60]):
        m, lower = grown_cells(r, n, f) if f != 3 else family_cells(r, n, f)
        species = [int(x) for x in r.choice([3, 4, 5, 6, 8, 9], n)]
        members += [(f, i, s) for i, s in enumerate(species)]
        cells += lower
        want[f] = chosen(m.tolist(), species, TREE)
        left += len({v for row in m.tolist() for v in row if 0.15 < v < 0.7})
        assert clusters.choose_threshold(m.astype(np.float32), species, Clades(TREE)) == pytest.approx(want[f], abs=1e-6)
    assert sum(kept) < 0.8 * left
    cells = spark.createDataFrame(cells, "family int, i int, j int, value double")
    members = spark.createDataFrame(members, "family int, idx int, species int")
    got = {x.family: x.threshold for x in clusters.choose_thresholds(members, cells, TREE).collect()}
    assert got == pytest.approx(want)
