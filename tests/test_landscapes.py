import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import sequences
from kinfold.operators import landscapes

LETTERS = st.lists(st.integers(0, 4), max_size=9)

WORKED = [
    ("ABCDE", "ABCDE", 0.8), ("ABCDE", "EDCBA", 0.8), ("ABCDE", "ABXDE", 0.6), ("ABCDE", "BADCE", 0.5), ("AABCD", "ABCD", 0.6),
    ("ABCAB", "ABCAB", 0.8), ("AXBYC", "ABC", 0.4), ("A", "A", 0.0), ("ABX", "XBA", 0.66667), ("AB" * 8, "AB" * 8, 0.9375), ("ABC", "XYZ", 0.0),
]


@pytest.mark.parametrize("a,b,score", WORKED)
def test_threaded_score_of_worked_examples(a, b, score):
    assert round(landscapes.threaded_score(list(a), list(b)), 5) == score


def test_threaded_score_follows_the_first_landscape():
    a, b = [4, 4, 1, 2], [4, 0, 4, 0, 3, 2, 4, 1]
    assert landscapes.threaded_score(a, b) == 0.1875 and landscapes.threaded_score(b, a) == 0.25


@given(LETTERS)
def test_threaded_score_ignores_a_whole_reversal(a):
    assert landscapes.threaded_score(a, a) == landscapes.threaded_score(a, a[::-1])


@settings(deadline=None, max_examples=8)
@given(st.lists(st.tuples(LETTERS, LETTERS), min_size=1, max_size=20))
def test_subsequences_by_bits_and_by_rows_agree_with_brute_force(spark, pairs):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>").where("size(a) * size(b) > 0")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", sequences._lcs_bits(a, b).alias("x"), sequences._lcs_rows(a, b).alias("y"), sequences.lcs_length(a, b).alias("z")).collect():
        assert r.x == r.y == r.z == landscapes._lcs(r.a, r.b)


def test_long_sequences_and_nulls(spark):
    df = spark.createDataFrame([(list(range(70)), list(range(0, 140, 2))), (None, [1]), ([], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(sequences.lcs_length(F.col("a"), F.col("b"))).collect()] == [35, None, 0]


def test_run_lengths(spark):
    df = spark.createDataFrame([([1, 1, 2, 1],), ([],), ([5],)], "a array<int>")
    got = [[(x.sym, x.w) for x in r[0]] for r in df.select(sequences.run_lengths(F.col("a"))).collect()]
    assert got == [[(1, 2), (2, 1), (1, 1)], [], [(5, 1)]]
    assert landscapes._runs([1, 1, 2, 1]) == ([1, 2, 1], [2, 1, 1])


def test_families_without_core_fall_back(spark):
    df = spark.createDataFrame([("a", 25, False), ("a", 5, False), ("a", 1, False), ("a", 30, True), ("b", 5, False), ("b", 1, False)], "family string, size int, copy boolean")
    got = landscapes.classes(df, "family", F.col("size"), F.col("copy")).select("family", "size", "kind").collect()
    assert {(r.family, r.size): r.kind for r in got} == {("a", 25): "core", ("a", 5): "extended", ("a", 1): "solo", ("a", 30): None, ("b", 5): "core", ("b", 1): "solo"}


def test_tandems_join_the_group_before_them(spark):
    rows = [("f", "s", 1, "a", None), ("f", "s", 2, "b", "f"), ("f", "s", 9, "c", "g"), ("g", "s", 5, "d", None)]
    df = spark.createDataFrame(rows, "family string, species string, pos int, gene string, before string")
    got = landscapes.tandems(df, "family", ["species", "pos"], "gene", F.col("before")).collect()
    assert [(r.family, r["first"], r.rest) for r in got] == [("f", "a", ["b"])]


def plain_score(a, b):
    """Every path by itself, run by run."""
    (sa, wa), (sb, wb) = landscapes._runs(a), landscapes._runs(b)
    matches = [[j for j, y in enumerate(sb) if y == x] for x in sa]
    number = 1
    for m in matches:
        number *= max(1, len(m))
    size = max(len(a), len(b))
    if not any(matches):
        return 0.0
    if number > 10_000:
        best = max(landscapes._lcs(a, b), landscapes._lcs(a, b[::-1]))
        return np.float32(max(best - 1, 0)) / np.float32(size)

    def paths(i, path):
        if i == len(matches):
            yield path
            return
        m = matches[i]
        if not m:
            yield from paths(i + 1, [*path, None])
            return
        yield from paths(i + 1, [*path, None if m[0] in path else m[0]])
        for j in m[1:]:
            if j not in path:
                yield from paths(i + 1, [*path, j])

    best = -1e9
    for p in paths(0, []):
        value = sum(min(wa[i], wb[j]) for i, j in enumerate(p) if j is not None)
        if len(p) > 2:
            towards = np.sign((p[1] or 0) - (p[0] or 0))
            for j, k in zip(p, p[1:]):
                if j is not None and k is not None and np.sign(k - j) != towards:
                    towards = np.sign(k - j)
                    value -= 0.5
        best = max(best, value)
    best = best - 1 if best >= 1 else best
    return np.float32(np.trunc(best * 2) / 2) / np.float32(size)


def test_pairs_of_one_path_and_of_many_equal_plain_paths(spark, monkeypatch):
    monkeypatch.setattr(landscapes, "PATHS_AT_A_TIME", 40)
    r = random.Random(7)
    genes = [(f, i, [r.choice(range(k)) for _ in range(r.choice([0, 1, 2, 3, 6, 9]))]) for f, k in enumerate([2, 4, 8, 30]) for i in range(30)]
    genes.append((0, 30, [0, 1] * 8))
    genes.append((0, 31, [0, 1] * 8))
    df = spark.createDataFrame(genes, "family int, gene int, landscape array<int>")
    got = {(x.family, x.i_gene, x.j_gene): x.score for x in landscapes.threaded_pairs(df, "family", "gene", "landscape").collect()}
    of = {(f, i): x for f, i, x in genes}
    want = {(f, i, j): float(plain_score(of[f, i], of[f, j])) for f, i in of for g, j in of if f == g and i > j}
    assert got == want
    branches = sum(not {x for x in of[f, i]}.isdisjoint(x for x, n in Counter(landscapes._runs(of[f, j])[0]).items() if n > 1) for f, i, j in want)
    assert 0.1 * len(want) < branches < 0.8 * len(want)  # both ways are taken


def test_symbols_can_be_null(spark):
    df = spark.createDataFrame([(1, 1, ["a", None, "b"]), (1, 2, [None, "a", "b", None]), (1, 3, ["b", None])], "family int, gene int, landscape array<string>")
    got = {(x.i_gene, x.j_gene): x.score for x in landscapes.threaded_pairs(df, "family", "gene", "landscape").collect()}
    of = {1: ["a", None, "b"], 2: [None, "a", "b", None], 3: ["b", None]}
    assert got == {(i, j): float(plain_score(of[i], of[j])) for i, j in ((2, 1), (3, 1), (3, 2))}


def test_most_pairs_of_the_table_stay_out_of_python(spark, sf_dir):
    from kinfold.plans import proxies

    scored = landscapes.threaded_pairs(proxies.order_landscapes(spark, sf_dir), "family", "gene", "landscape")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    runs = proxies.order_landscapes(spark, sf_dir).withColumn("r", F.transform(sequences.run_lengths(F.col("landscape")), lambda x: x["sym"]))
    runs = runs.withColumn("twice", F.filter("r", lambda x, i: F.array_position("r", x) != i + 1)).select("family", "gene", "r", "twice")
    n, python = landscapes.pairs(runs, "family", "gene", "r", "twice").agg(F.count("*"), F.count_if(F.arrays_overlap("i_r", "j_twice"))).first()
    assert n > 5000 and python / n < 0.25


def test_places_of_symbols_are_found_once_a_gene(spark):
    r = random.Random(3)
    rows = [(g % 3, g, [r.choice(["a", "b", "c", None]) for _ in range(r.choice([0, 1, 4, 7, 65]))]) for g in range(24)]
    genes = spark.createDataFrame(rows, "family int, gene int, s array<string>")
    got = {(x.family, x.i_gene, x.j_gene): x.score for x in landscapes.lcs_of_pairs(genes, "family", "gene", "s").collect()}
    paired = landscapes.lcs_pairs(landscapes.pairs(genes, "family", "gene", "s"), "i_s", "j_s")
    assert got == {(x.family, x.i_gene, x.j_gene): x.score for x in paired.collect()} and len(got) == 3 * 28
