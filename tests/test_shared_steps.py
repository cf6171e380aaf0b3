"""Steps that several queries share: rows dealt by their number, one tree for orders of one content, reach in one tree."""

import random
import re

import pytest

from kinfold import shared
from kinfold.functions import trees
from kinfold.operators import clusters
from kinfold.plans import catalog, family_trees, proxies


def test_orders_of_one_content_share_a_tree(spark, sf_dir, monkeypatch):
    built = []
    monkeypatch.setattr(family_trees, "build_trees", lambda genes, *a, **k: built.append(genes) or build(genes, *a, **k))
    rows = catalog.order_trees(spark, sf_dir).select("family").distinct().count()
    members = [(r.family, r.species) for r in proxies.order_species(spark, sf_dir).collect()]
    held = {}
    for family, species in members:
        held.setdefault(family, []).append(species)
    contents = {(tuple(sorted(set(s))), min((x for x in s if s.count(x) > 1), default=0)) for s in held.values()}
    assert rows == len(held) > len(contents)
    assert built[0].select("family").distinct().count() == len(contents)


build = family_trees.build_trees


def test_order_species_lies_in_as_many_parts_as_its_rows_ask_for(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(proxies, "ROWS_A_TASK", 100)
    lines = proxies.load(spark, sf_dir, "lineitem").count()
    members = proxies.order_species(spark, sf_dir)
    assert members.rdd.getNumPartitions() == -(-lines // 100)
    counted = members.groupBy("customer", "family").count()
    assert counted.rdd.getNumPartitions() == -(-lines // 100)  # no further shuffle


def test_reach_in_one_tree_equals_reach_in_copies(spark):
    r = random.Random(4)
    tree = [(0, None)] + [(n, r.randrange(n)) for n in range(1, 30)]
    content = [(f, r.randrange(30)) for f in range(12) for _ in range(r.randint(0, 4))]
    one = spark.createDataFrame(tree, "node int, parent int")
    content = spark.createDataFrame(content, "family int, node int")
    copies = content.select("family").distinct().crossJoin(one)
    want = {(x.family, x.node) for x in trees.reachable(copies, content, ["family"]).collect()}
    got = [(x.family, x.node) for x in trees.reachable_in_one(trees.closure(one), content, ["family"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_orders_of_the_same_species_share_a_splice(spark, sf_dir, monkeypatch):
    built = []
    monkeypatch.setattr(catalog, "_skeletons", lambda s, d, members: built.append(members) or skeletons(s, d, members))
    rows = catalog.splice_single_child(spark, sf_dir).select("family").distinct().count()
    held = {}
    for r in proxies.order_species(spark, sf_dir).collect():
        held.setdefault(r.family, set()).add(r.species)
    contents = {frozenset(s) for s in held.values()}
    assert rows == len(held) > len(contents)
    assert built[0].select("family").distinct().count() == len(contents)


skeletons = getattr(catalog, "_skeletons", None)


def test_order_species_keeps_its_parts_beside_many_suppliers(spark, sf_dir, monkeypatch):
    """A shuffle by supplier undid the dealing where suppliers are over what Spark sends along."""
    monkeypatch.setattr(proxies, "ROWS_A_TASK", 100)
    want = -(-proxies.load(spark, sf_dir, "lineitem").count() // 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert proxies.order_species(spark, sf_dir).rdd.getNumPartitions() == want
        monkeypatch.setattr(shared, "MAX_BROADCAST_IDS", 1)
        monkeypatch.setattr(proxies, "bounded", lambda df, rows: shared.bounded(df, rows, 1), raising=False)
        members = proxies.order_species(spark, sf_dir)
        assert members.rdd.getNumPartitions() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["loss_count_large", "duplicated_species", "subset_species"])
def test_what_is_found_by_order_stays_where_its_rows_lie(spark, sf_dir, monkeypatch, name):
    """A second shuffle had as many parts as the session asks for, whatever the rows, or as many as there are species."""
    monkeypatch.setattr(proxies, "ROWS_A_TASK", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == -(-proxies.load(spark, sf_dir, "lineitem").count() // 100)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ends_and_sums_need_no_distinct_rows_first(spark, sf_dir):
    plan = lambda name: catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    count = lambda text: len(re.findall(r"HashAggregate ?\(", text))
    assert count(plan("family_mrca")) == 2
    assert count(plan("redundancy")) == 4


def test_nodes_over_all_species(spark):
    r = random.Random(5)
    tree = [(0, None)] + [(n, r.randrange(n)) for n in range(1, 30)]
    up = dict(tree)
    members = [(f, r.randrange(30)) for f in range(40) for _ in range(r.randint(1, 4))] + [(50, 3), (50, 99), (51, 4), (51, None), (52, 99), (None, 5), (None, 5)]
    lineage = lambda n: {n} | (lineage(up[n]) if up[n] is not None else set())
    held = {}
    for f, n in members:
        held.setdefault(f, []).append(lineage(n) if n in up else set())
    want = sorted((-1 if f is None else f, n) for f, sets in held.items() for n in set.intersection(*sets))
    tree = spark.createDataFrame(tree, "node int, parent int")
    rows = trees.holders(spark.createDataFrame(members, "family int, species int"), trees.clades_of(tree), trees.closure(tree)).collect()
    assert sorted((-1 if x.family is None else x.family, x.node) for x in rows) == want


def test_redundancy_of_repeats_and_unknown_species(spark):
    rows = [(1, 10, 5), (1, 10, 5), (1, 10, 6), (1, 11, 5), (1, 11, None), (2, 12, 7), (None, 13, 7), (None, 13, 7)]
    found = clusters.redundancy(spark.createDataFrame(rows, "family int, cluster int, species int"), "family", "cluster", "species").collect()
    assert {x.family: x.redundancy for x in found} == {1: 1.67, 2: 1.0, None: 2.0}
