import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.errors import IncompleteTree
from kinfold.functions import newick, trees
from kinfold.operators import assembly, assignment, clusters, components, products
from kinfold.plans import family_trees

SHAPE = newick.parse("((A,B),((C,D),E));")[0]
SPECIES = assembly.Species(newick.rows(SHAPE))
IDS = {n.name: n.id for n in SHAPE}


def random_species(r, leaves):
    rows, nodes = [(1, None, "root")], [1]
    while sum(1 for n in nodes if not any(p == n for _, p, _ in rows)) < leaves:
        at = r.choice(nodes)
        for _ in range(2):
            n = len(rows) + 1
            rows.append((n, at, f"n{n}"))
            nodes.append(n)
    return assembly.Species(rows)


def test_worked_losses():
    of = lambda *names: SPECIES.losses({IDS[n] for n in names})
    assert (of("A", "E"), of("A", "C", "E"), of("A", "B")) == (1, 0, 0)


def test_losses_as_sets_equal_the_walk(spark):
    r = random.Random(3)
    s = random_species(r, 12)
    tips = sorted(s.span[s.root])
    families = {f: {r.choice(tips) for _ in range(r.randint(1, 5))} for f in range(40)}
    tree = spark.createDataFrame([(n, p) for n, p in s.parent.items()], "node int, parent int")
    members = spark.createDataFrame([(f, k) for f, ks in families.items() for k in ks], "family int, species int")
    clades = trees.clades_of(tree)
    tops = trees.mrcas(members, clades).collect()
    assert {t.family: t.mrca for t in tops} == {f: s.mrca(k) for f, k in families.items()}
    assert {t.family: t.span for t in tops} == {f: len(s.span[s.mrca(k)]) for f, k in families.items()}
    assert {t.family: t.losses for t in trees.losses(members, clades).collect()} == {f: s.losses(k) for f, k in families.items()}
    assert trees.losses(members.limit(0), clades).count() == 0


def brute_losses(parent, present, large_only):
    """Inner nodes without a species whose parent has one, below the common ancestor."""
    line = lambda x: [x] + (line(parent[x]) if parent[x] is not None else [])
    inner = {p for p in parent.values() if p is not None}
    cover = {x for p in present for x in line(p)}
    top = next(x for x in line(next(iter(present))) if all(x in line(p) for p in present))
    span = {x: sum(x in line(t) for t in parent if t not in inner) for x in parent}
    return sum(1 for x in inner if parent[x] in cover and x not in cover and top in line(x) and (not large_only or span[x] > 1))


@pytest.mark.parametrize("large_only", [False, True])
def test_losses_of_trees_with_chains_and_many_children(spark, large_only):
    r = random.Random(9)
    for _ in range(4):
        n = r.randint(2, 30)
        rows = [(i, None if not i else r.randrange(max(0, i - r.choice([2, 30])), i)) for i in range(n)]
        families = {f: {r.randrange(n) for _ in range(r.randint(1, 5))} for f in range(30)}
        members = spark.createDataFrame([(f, k) for f, ks in families.items() for k in ks], "family int, species int")
        clades = trees.clades_of(spark.createDataFrame(rows, "node int, parent int"))
        got = {x.family: x.losses for x in trees.losses(members, clades, large_only=large_only).collect()}
        assert got == {f: brute_losses(dict(rows), k, large_only) for f, k in families.items()}


def test_a_caterpillar_of_ten_thousand_leaves(spark):
    """Inner nodes 0, 2, 4, ... down to 19,996, each with a leaf beside the next; one of its depth 9,998 a million rows of closure couldn't hold."""
    n = 10_000
    rows = [(0, None)] + [x for k in range(1, n - 1) for x in ((2 * k - 1, 2 * k - 2), (2 * k, 2 * k - 2))] + [(2 * n - 3, 2 * n - 4), (2 * n - 2, 2 * n - 4)]
    clades = trees.clades_of(spark.createDataFrame(rows, "node int, parent int"))
    assert clades.span[0] == n
    members = spark.createDataFrame([("ends", 1), ("ends", 2 * n - 2), ("near", 19_001), ("near", 19_003), ("one", 7), ("top", 1), ("top", 3)], "family string, species int")
    assert {x.family: (x.mrca, x.span) for x in trees.mrcas(members, clades).collect()} == {"ends": (0, n), "near": (19_000, 500), "one": (7, 1), "top": (0, n)}
    assert {x.family: x.losses for x in trees.losses(members, clades).collect()} == {"ends": 0, "near": 1, "one": 0, "top": 1}


def test_closure_by_doubling(spark):
    """A chain of 300 nodes beside a bush."""
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000 + i, i) for i in range(0, 300, 50)]
    parent = dict(rows)
    want = set()
    for x in parent:
        at, dist = x, 0
        while at is not None:
            want.add((at, x, dist))
            at, dist = parent[at], dist + 1
    got = [(r.anc, r.node, r.dist) for r in trees.closure(spark.createDataFrame(rows, "node int, parent int")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_splices_of_a_thousand_levels(spark):
    """A chain in which only every 400th node stays, and a bush: parents are the nearest that stay, after ten rounds or so."""
    r = random.Random(8)
    rows = [("chain", i, i - 1 if i else None, i % 400 != 0) for i in range(1001)] + [("bush", i, r.randrange(i) if i else None, bool(i) and r.random() < 0.6) for i in range(200)]
    parent = {(f, n): p for f, n, p, _ in rows}
    gone = {(f, n) for f, n, _, g in rows if g}

    def up(f, n):
        p = parent[f, n]
        return up(f, p) if (f, p) in gone else p

    import sys

    sys.setrecursionlimit(5000)
    df = spark.createDataFrame(rows, "family string, node int, parent int, gone boolean")
    got = {(x.family, x.node): x.parent for x in trees.nearest_kept(df, ["family"]).collect()}
    assert got == {(f, n): up(f, n) if parent[f, n] is not None else None for f, n, _, g in rows if not g}
    assert {(x.node, x.parent) for x in trees.nearest_kept(df.where("family = 'chain'"), ["family"]).collect()} == {(0, None), (400, 0), (800, 400)}


def test_newick_round_trip_and_errors():
    text = "((a[&&NHX:S=x],'b c':1.5)d,(e,f));"
    tree = newick.parse(text)[0]
    assert newick.leaf_names(tree) == ["a", "b c", "e", "f"]
    assert newick.parse(newick.print_tree(tree))[0] == tree
    for bad in ("(a,b", "a,b;", "(a));"):
        with pytest.raises(ValueError):
            newick.parse(bad)
    assert len(newick.parse("(a,b);(c,d);")) == 2


def test_order_matters_to_ordered_clusters():
    m = np.zeros((5, 5))
    for i, j in ((0, 2), (0, 4), (1, 3), (2, 3)):
        m[i, j] = m[j, i] = 1
    assert clusters.ordered_clusters(m, 0.5) == [[0, 1, 2, 3], [4]]


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_ordered_clusters_never_join_what_no_path_joins(edges):
    m = np.zeros((13, 13))
    for i, j in edges:
        m[i, j] = m[j, i] = 1
    up = list(range(13))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, j in edges:
        up[find(i)] = find(j)
    for c in clusters.ordered_clusters(m, 0.5):
        assert len({find(x) for x in c}) == 1


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(600, 700)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_links_use_genes_and_kinds_once():
    links = [("a", 1, 10, 3), ("a", 1, 11, 2), ("b", 1, 10, 1), ("b", 1, 11, 5)]
    assert assignment.greedy_links(links, lambda x: x[3]) == [("b", 1, 10, 1), ("a", 1, 11, 2)]


def family(seed, n=30, species=None, tandem=None):
    r = np.random.default_rng(seed)
    s = species or random_species(random.Random(seed), 8)
    tips = sorted(s.span[s.root])
    x = r.normal(size=(n, 6)) + 2 * r.integers(0, 3, n)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    syn = np.clip(x @ x.T, 0, 1)
    np.fill_diagonal(syn, 0)
    div = 1 - x @ x.T
    np.fill_diagonal(div, 0)
    sizes = [31 if i % 7 else 12 for i in range(n)]
    if n > 3:
        sizes[3] = 1
    return assembly.Family([f"g{i}" for i in range(n)], [int(tips[i]) for i in r.integers(0, len(tips), n)], sizes, syn, div, s, tandem)


@pytest.mark.parametrize("seed", range(12))
def test_each_gene_is_in_the_tree_once(seed):
    f = family(seed, n=[1, 2, 5, 30, 60][seed % 5], tandem={4: [6, 8]} if seed % 5 > 2 else None)
    tree, root = assembly.build_family(f, stages=True)
    assert sorted(tree.genes(root)) == list(range(len(f.names)))
    text = assembly.to_newick(f, tree, root)
    assert sorted(n for n in newick.leaf_names(newick.parse(text)[0]) if n) == sorted(f.names)
    again = family(seed, n=len(f.names), tandem=f.tandem)
    assert assembly.to_newick(again, *assembly.build_family(again)) == text


def worked(shape, genes, synteny=(), sizes=None, tandem=None, divergence=1.0, threshold=0.5):
    """A family from a species tree's text, (gene, species) pairs and the synteny of pairs of genes."""
    tree = newick.parse(shape)[0]
    ids = {n.name: n.id for n in tree}
    names = [g for g, _ in genes]
    syn = np.zeros((len(names),) * 2)
    for a, b, x in synteny:
        syn[names.index(a), names.index(b)] = syn[names.index(b), names.index(a)] = x
    div = np.full(syn.shape, float(divergence))
    np.fill_diagonal(div, 0)
    numbers = {names.index(k): [names.index(x) for x in v] for k, v in (tandem or {}).items()}
    return assembly.Family(names, [ids[k] for _, k in genes], [(sizes or {}).get(g, 31) for g in names], syn, div, assembly.Species(newick.rows(tree)), numbers, threshold=threshold), ids


def shape_of(f, tree, root):
    """A tree as nested sorted tuples of gene names."""
    item = tree.items[root]
    parts = [f.names[g] for g in item.content] + [shape_of(f, tree, c) for c in item.children]
    return parts[0] if len(parts) == 1 else tuple(sorted(parts, key=str))


def pairs_of(names, x=0.9):
    return [(a, b, x) for i, a in enumerate(names) for b in names[:i]]


FOUR = "((A,B),(C,D));"


def test_one_gene_a_species_gives_the_species_tree():
    f, _ = worked(FOUR, [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], pairs_of("abcd"))
    assert shape_of(f, *assembly.build_family(f)) == (("a", "b"), ("c", "d"))


def test_lone_genes_go_beside_a_cluster_of_all_species():
    """The cluster covers the species root and stays beside the skeleton, whose leaf takes the lone gene."""
    f, _ = worked(FOUR, [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), ("x", "A")], pairs_of("abcd"), sizes={"x": 1})
    assert shape_of(f, *assembly.build_family(f)) == ((("a", "b"), ("c", "d")), "x")


def test_filling_counts_all_species_of_the_family():
    """Arms of A, B and C fill half of six species and lose C again; where the family has no more species they keep it."""
    shape = "((A,B),(C,D,E,F));"
    cluster = [("a0", "A"), ("a1", "A"), ("b0", "B"), ("b1", "B"), ("c0", "C"), ("c1", "C")]
    syn = pairs_of(["a0", "b0", "c0"]) + pairs_of(["a1", "b1", "c1"])
    for more, want in (([], [[["a0", "b0", "c0"], ["a1", "b1", "c1"]]]), ([("d", "D"), ("e", "E"), ("f", "F")], [[["a0", "b0"], ["a1", "b1"]], [["c0"], ["c1"]]])):
        f, _ = worked(shape, cluster + more, syn)
        families, own = assembly.create_duplications(f, list(range(6)))
        assert [[sorted(f.names[g] for g in arm.genes) for arm in arms] for arms in families] == want and own == []


def test_two_copies_in_each_species_are_one_duplication():
    genes = [(k.lower() + i, k) for i in "01" for k in "ABCD"]
    f, _ = worked(FOUR, genes, pairs_of([g for g, _ in genes if g[1] == "0"]) + pairs_of([g for g, _ in genes if g[1] == "1"]) + [("a0", "a1", 0.6)])
    assert shape_of(f, *assembly.build_family(f)) == ((("a0", "b0"), ("c0", "d0")), (("a1", "b1"), ("c1", "d1")))


def test_tandem_arrays_of_all_species_are_one_duplication():
    """Each species has an anchor and a copy: two whole species trees side by side, not one duplication a species."""
    genes = [(k.lower() + i, k) for i in "01" for k in "ABCD"]
    f, _ = worked(FOUR, genes, pairs_of([g for g, _ in genes if g[1] == "0"]), sizes={g: 1 for g, _ in genes if g[1] == "1"}, tandem={k + "0": [k + "1"] for k in "abcd"})
    assert shape_of(f, *assembly.build_family(f)) == ((("a0", "b0"), ("c0", "d0")), (("a1", "b1"), ("c1", "d1")))


def test_tandem_arrays_of_a_clade_are_its_duplication():
    """Copies in A and B only: the duplication is theirs; a third copy of A alone is A's own."""
    genes = [("a0", "A"), ("b0", "B"), ("c0", "C"), ("d0", "D"), ("a1", "A"), ("b1", "B"), ("a2", "A")]
    f, _ = worked(FOUR, genes, pairs_of([g for g, _ in genes if g[1] == "0"]), sizes={"a1": 1, "b1": 1, "a2": 1}, tandem={"a0": ["a1", "a2"], "b0": ["b1"]})
    # First a0 and b0 beside the clade, then a1 and b1, then a2 beside A's own place, which is left empty.
    assert shape_of(f, *assembly.build_family(f)) == (("c0", "d0"), (("a0", "b0"), (("a1", "b1"), "a2")))


def test_grafting_looks_at_the_context():
    """The species around a place count up to where another place of the same tag begins."""
    f, ids = worked(FOUR, [("a", "A"), ("b", "B"), ("c", "C"), ("x", "A")])
    t = assembly.Tree()
    root = t.add(f.species.root)
    left, right = t.add(f.species.parent[ids["A"]], (), root), t.add(f.species.parent[ids["C"]], (), root)
    place, other = t.add(ids["A"], [0], left), t.add(ids["B"], [1], left)
    t.add(ids["C"], [2], right)
    assert assembly.context_of(t, place, {place}) == root
    second = t.add(ids["A"], (), right)
    assert assembly.context_of(t, place, {place, second}) == left and assembly.context_of(t, second, {place, second}) == right
    holder = t.add(0)
    n = t.add(ids["A"], [3], holder)
    # Around the first place are a and b: no losses. Around the second is c: with x the clade of A and B is lost no more, one loss less.
    assert assembly.graft(f, t, n, root) and t.items[n].remarks == {"METHOD": "ELC"}
    assert t.genes(left) == [0, 1] and sorted(t.genes(right)) == [2, 3] and second not in t.items and other in t.items


def test_arms_take_the_nearest_target_unrounded():
    """Two places of the arm's tag with 0.151 and 0.154 synteny round alike; the larger wins."""
    f, ids = worked("(A,B);", [("a0", "A"), ("a1", "A"), ("a2", "A")], [("a2", "a0", 0.151), ("a2", "a1", 0.154)])
    t = assembly.Tree()
    node = t.add(f.species.root)
    first, second = t.add(ids["A"], [0], node), t.add(ids["A"], [1], node)
    assert assembly.nearest(f, t, [2], [first, second]) == second
    assert assembly.nearest(f, t, [2], [second, first]) == second


def test_rest_is_stacked_downwards():
    f, ids = worked(FOUR, [("a", "A"), ("b", "B"), ("c", "C"), ("m", "D")])
    t = assembly.Tree()
    root, main = t.add(0), t.add(f.species.root)
    tops = [t.add(ids[k], [i], root) for i, k in enumerate("ABC")]
    t.add(ids["D"], [3], main)
    assembly.stack_rest(f, t, root, main)
    assert not t.items[root].children and sorted(t.genes(main)) == [0, 1, 2, 3]
    holder = t.items[main].children[1]
    assert t.items[holder].children[0] == tops[2] and t.depth(tops[0]) > t.depth(tops[2]) and t.depth(tops[1]) > t.depth(tops[2])


def test_pruning_twice_changes_nothing():
    f = family(2)
    tree, root = assembly.build_family(f)
    assembly.prune(tree, root)
    once = assembly.to_newick(f, tree, root)
    assembly.prune(tree, root)
    assert assembly.to_newick(f, tree, root) == once


def test_incomplete_trees_raise():
    f = family(4)
    tree, root = assembly.build_family(f)
    holder = next(n for n in tree.subtree(root) if tree.items[n].content)
    tree.items[holder].content.pop()
    with pytest.raises(IncompleteTree):
        assembly.check_complete(f, tree, root)


def test_splice_and_reach(spark):
    tree = spark.createDataFrame([("f", 1, None), ("f", 2, 1), ("f", 3, 1), ("f", 4, 2)], "family string, node int, parent int")
    content = spark.createDataFrame([("f", 4)], "family string, node int")
    assert {r.node for r in trees.reachable(tree, content, ["family"]).collect()} == {1, 2, 4}
    wide = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 1)], "node int, parent int")
    assert [(r.node, r.children) for r in trees.polytomies(wide).collect()] == [(1, 3)]


def test_growing_sets_have_the_losses_of_the_walk():
    r = random.Random(12)
    for _ in range(60):
        species = random_species(r, r.choice([2, 5, 14]))
        tips = sorted(species.span[species.root])
        number = species.clades.numbers
        sets = [{r.choice(tips) for _ in range(r.choice([0, 1, 3]))} for _ in range(4)]
        grown = trees.SpeciesSets(species.clades, [[number[x] for x in k] for k in sets])
        for _ in range(12):
            assert grown.losses().tolist() == [species.losses(k) for k in sets]
            x, i = r.choice(tips), r.randrange(4)
            assert grown.more(number[x]).tolist() == [species.losses(k | {x}) - species.losses(k) for k in sets]
            grown.add(i, number[x])
            sets[i].add(x)


def plain_injection(f, clusters):
    """Each gene against each cluster, everything counted anew."""
    s, core, now = f.species, [list(c) for c in clusters], [list(c) for c in clusters]
    scaled = {g: f.synteny[g] * np.array([max(f.sizes[g], x) / f.sizes[g] for x in f.sizes], np.float32) for g in f.extended}
    for g in sorted(f.extended, key=lambda g: (-float(scaled[g][f.core].max(initial=0.0)), f.least_divergence([g], f.core), g)):
        rows = []
        for i, c in enumerate(now):
            rows.append((s.losses(f.kinds(c) | {f.of[g]}) - s.losses(f.kinds(c)), -clusters_half_up(scaled[g][core[i]].max(initial=0.0)), clusters_half_up(f.least_divergence([g], c)), i))
        if any(-x[1] >= 0.15 for x in rows):
            rows = [x for x in rows if x[0] < 6] or rows
            key = (lambda x: (x[1], x[0], x[2], x[3])) if f.sizes[g] > 3 else (lambda x: (x[0], x[1], x[2], x[3]))
        else:
            key = lambda x: (x[0], x[2], x[1], x[3])
        now[min(rows, key=key)[3]].append(g)
    return now


def clusters_half_up(x):
    return float(np.float32(np.floor(np.float32(x) * np.float32(100) + np.float32(0.5)) / np.float32(100)))


@pytest.mark.parametrize("seed", range(100))
def test_injection_equals_counting_anew(seed):
    r = random.Random(seed)
    f = family(seed, n=r.choice([8, 25, 40]))
    f.sizes = [r.choice([2, 3, 9, 30, 31]) for _ in f.sizes]
    f.core = [g for g, x in enumerate(f.sizes) if x > 20]
    f.extended = [g for g, x in enumerate(f.sizes) if 1 < x <= 20]
    parts = [[g for g in f.core if g % 3 == k] for k in range(3)]
    parts = [p for p in parts if p]
    if parts:
        assert assembly.inject_extended(f, parts) == plain_injection(f, parts)


def test_injection_takes_time_in_proportion_to_genes():
    import time

    took = []
    for n in (1500, 6000):
        f = family(1, n=10)
        r = np.random.default_rng(1)
        f.of, f.sizes = [f.of[i] for i in r.integers(0, 10, n)], [30] * 40 + [9] * (n - 40)
        f.core, f.extended = list(range(40)), list(range(40, n))
        f.synteny = f.divergence = np.broadcast_to(np.float32(0.1), (n, n))
        began = time.process_time()
        assembly.inject_extended(f, [[g for g in f.core if g % 8 == k] for k in range(8)])
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]  # 4 times the genes; rows of the matrices are read once each


def test_tracked_genes_leave_what_was_weighed():
    f = family(7, n=30)
    f.tracked = frozenset([4, 14, 21])
    tree, root = assembly.build_family(f)
    assert f.notes and {n for _, names, *_ in f.notes for n in names.split(",")} <= {"g4", "g14", "g21"}
    steps = {}
    for step, names, candidate, losses, synteny, divergence, chosen in f.notes:
        steps.setdefault((step, names), []).append(chosen)
    injected = [v for (step, _), v in steps.items() if step == "inject_extended"]
    assert all(sum(v) == 1 for v in injected)
    plain = family(7, n=30)
    assert assembly.to_newick(plain, *assembly.build_family(plain)) == assembly.to_newick(f, tree, root)
    assert not plain.notes


def test_trees_of_vectors_equal_those_of_their_cosines(spark):
    r = np.random.default_rng(5)
    rows = [(f, i, f"v{f}.{i}", 100 + int(r.integers(4)), 12 if i % 10 == 9 else 31, r.normal(size=4).tolist()) for f in range(3) for i in range(25)]
    rows[3] = (*rows[3][:5], None)
    rows[30] = (*rows[30][:5], [1.0, None, 0.5, 0.2])
    genes = spark.createDataFrame(rows, "family int, idx int, name string, species_id int, size int, vector array<double>")
    lower = products.pairs(genes, "family", "idx", "vector", 5)
    cells = lower.select("family", "i", "j", F.greatest("value", F.lit(0.0)).alias("synteny"), F.coalesce(1 - F.col("value"), F.lit(float("nan"))).alias("divergence"))
    species = [(1, None, "all"), (2, 1, "a"), (3, 1, "b"), *((100 + k, 2 + k // 2, f"s{k}") for k in range(4))]
    want = family_trees.build_trees(genes.drop("vector"), cells, species).select("family", "newick").collect()
    got = family_trees.build_trees(genes, None, species).select("family", "newick").collect()
    assert sorted(got) == sorted(want) and len(got) == 3


def random_family(seed, n):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    synteny = np.maximum(np.round(x @ x.T, 5), 0).astype(np.float32)
    np.fill_diagonal(synteny, 0)
    species = assembly.Species([(1, None, "R")] + [(2 + k, 1, f"r{k}") for k in range(3)] + [(10 + k, 2 + k % 3, f"n{k}") for k in range(9)])
    return assembly.Family([f"g{i}" for i in range(n)], [10 + int(k) for k in r.integers(0, 9, n)], [int(k) for k in r.choice([1, 12, 31], n, p=[0.1, 0.1, 0.8])], synteny, (1 - synteny).astype(np.float32), species, threshold=0.8)


@pytest.mark.parametrize("seed", range(4))
def test_kept_surroundings_equal_those_looked_up_anew(monkeypatch, seed):
    seen, graft = [], assembly.graft

    def checked(f, tree, n, main, places=None):
        done = graft(f, tree, n, main, *([places] if places else []))
        anew = {}
        for x in tree.subtree(main)[1:]:
            anew.setdefault(tree.items[x].tag, set()).add(x)
        assert {k: v for k, v in places.of_tag.items() if v} == anew
        for known in [x for v in anew.values() for x in v if seen or x in places.around]:
            context = assembly.context_of(tree, known, anew[tree.items[known].tag])
            now = places.look(known)
            genes = tree.genes(context)
            assert (now.context, sorted(now.near), now.here) == (context, sorted(set(genes) & set(f.core)), f.kinds(genes))
            assert places.genes(known) == len(tree.genes(known))
        seen.append(n)
        return done

    monkeypatch.setattr(assembly, "graft", checked)
    f = random_family(seed, 120)
    tree, root = assembly.build_family(f)
    assert len(seen) > 20
    assembly.check_complete(f, tree, root)


def test_grafts_do_not_walk_the_tree_for_each_place(monkeypatch):
    visited, subtree = [0], assembly.Tree.subtree

    def counted(self, n):
        out = subtree(self, n)
        visited[0] += len(out)
        return out

    monkeypatch.setattr(assembly.Tree, "subtree", counted)
    assembly.build_family(random_family(7, 600))
    assert visited[0] < 600 * 600


def test_trees_of_thousands_of_levels_have_a_text():
    f = random_family(1, 2)
    tree = assembly.Tree()
    root = at = tree.add(1)
    for _ in range(5000):
        at = tree.add(1, [0], at)
    tree.add(1, [1], root)
    text = assembly.to_newick(f, tree, root)
    assert text.startswith("((g0[") and text.count("(") == text.count(")") == 5002
    assert len(newick.parse(text)[0]) == 5001 + 1 + 5001
