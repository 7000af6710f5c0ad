"""Small fixtures for the quirks of the operators."""

import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import session, storage
from tessera.functions.text import words, year_of
from tessera.operators import cf, encode, itemsets, lsh, metrics, stats
from tessera.plans import registry


def test_words_cut_at_unicode_space_and_signs(spark):
    df = spark.createDataFrame([("A,b\xa0C! (d)",), ("",), (None,)], "t string")
    assert [r.w for r in df.select(words("t").alias("w")).collect()] == [["a", "b", "c", "d"], [], []]
    assert spark.range(1).select(year_of(F.lit("1997-01-02"))).head()[0] == 1997


def test_category_average(spark):
    ratings = spark.createDataFrame([("x", 4.0), ("x", 2.0), ("y", 5.0)], "item string, stars double")
    items = spark.createDataFrame([("x", "a, b"), ("x", "a, b"), ("y", "a,,a"), ("z", None), ("w", "")], "item string, categories string")
    got = {r.category: r.avg_stars for r in stats.category_average(ratings, items, "item", "stars").collect()}
    assert got == {"a": 4.0, "b": 3.0, "": 5.0}


def _brute(baskets, threshold):
    sets = [set(b) for b in baskets]
    items, out = sorted(set().union(*sets)), {}
    for k in range(1, len(items) + 1):
        found = {c: n for c in combinations(items, k) if (n := sum(set(c) <= b for b in sets)) >= threshold}
        if not found:
            break
        out |= found
    return out


def test_itemsets_agree(spark):
    held = [["a", "b", "c", "a"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"], ["d"], ["100", "97"], ["97", "100", "a"]] * 3
    rows = spark.createDataFrame([(i, x) for i, b in enumerate(held) for x in b], "basket int, item string")
    want = _brute(held, 6)
    read = lambda df: {tuple(r["items"]): r.support for r in df.collect()}
    assert read(itemsets.frequent_itemsets(rows, 6)) == want
    assert read(itemsets.fp_growth(rows, 6)) == want
    for n in (1, 2):
        candidates, found = itemsets.son(rows, 6, n)
        assert read(found) == want
        assert set(want) <= {tuple(r["items"]) for r in candidates.collect()}


def test_a_level_of_itemsets_refers_to_tables_only(spark):
    rows = spark.createDataFrame([(i, x) for i in range(6) for x in "abcdef"], "basket int, item string")
    sizes = []
    for most in (2, 3, 4, 5, 6):
        found = itemsets.frequent_itemsets(rows, 6, most)
        assert found.count() == sum(1 for k in range(1, most + 1) for _ in combinations("abcdef", k))
        sizes.append(len(found._jdf.queryExecution().toString()))
    steps = [b - a for a, b in zip(sizes, sizes[1:], strict=False)]
    assert max(steps) < 1.2 * min(steps)


def test_parts_of_baskets_keep_all_frequent_sets(spark):
    """25 baskets of which the first 7 hold the only copies of a set, at a threshold cut 7 to 18."""
    held = [["x", "y"]] * 7 + [["x"]] * 9 + [["y"]] * 9
    rows = spark.createDataFrame([(i, v) for i, b in enumerate(held) for v in b], "basket int, item string")
    candidates, found = itemsets.son(rows, 7, 2)
    assert {tuple(r["items"]): r.support for r in found.collect()} == {("x",): 16, ("y",): 16, ("x", "y"): 7}
    assert ("x", "y") in {tuple(r["items"]) for r in candidates.collect()}
    small = itemsets.son_candidates(itemsets.baskets(rows), 7, 1, local=4)
    assert {("x",), ("y",), ("x", "y")} <= {tuple(r["items"]) for r in small.collect()}


def test_candidate_sets_hold_the_frequent_ones(spark):
    found = {r["items"] for r in registry.QUERIES["freq_itemsets_son"](spark, "/root/testdata/sf0.001").collect()}
    assert found <= {r["items"] for r in registry.QUERIES["son_candidate_sets"](spark, "/root/testdata/sf0.001").collect()}


def _sets(n=60, seed=8):
    rng = random.Random(seed)
    base = [set(rng.sample(range(400), rng.randint(5, 40))) for _ in range(n)]
    near = [b - {min(b)} | {500 + i} for i, b in enumerate(base[: n // 2])]
    return dict(enumerate(base + near))


def _similar(sets, t):
    return {(a, b): round(s, 9) for a, b in combinations(sorted(sets), 2) if (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= t}


@pytest.mark.parametrize("threshold", [0.05, 0.5, 0.6, 0.8, 1.0])
def test_exact_jaccard(spark, threshold):
    sets = _sets()
    sets[998] = sets[999] = {1, 2, 3}
    members = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id int, x long")
    got = {(r.a, r.b): round(r.sim, 9) for r in lsh.jaccard(members, threshold).collect()}
    assert got == _similar(sets, threshold)
    pairs = spark.createDataFrame([(0, 60), (1, 2), (998, 999)], "a int, b int")
    got = {(r.a, r.b): round(r.sim, 9) for r in lsh.jaccard(members, threshold, pairs).collect()}
    assert got == {k: v for k, v in _similar(sets, threshold).items() if k in {(0, 60), (1, 2), (998, 999)}}


def test_bands_find_similar_sets_and_few_others(spark):
    sets = _sets()
    members = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id int, x long")
    found = {(r.a, r.b) for r in lsh.candidates(lsh.signatures(members, lsh.hash_params(60), 2000), 20, 3).collect()}
    want = set(_similar(sets, 0.6))
    assert len(found & want) >= 0.95 * len(want) and len(found) < 0.2 * len(sets) * (len(sets) - 1) / 2
    library = {(r.a, r.b): round(r.sim, 9) for r in lsh.library_pairs(members, 0.6).collect()}
    assert set(library) <= want and len(library) >= 0.95 * len(want)


def test_latest_and_earliest_rating(spark):
    rows = [("u", "i", 1.0, 1), ("u", "i", 5.0, 2), ("u", "i", 3.0, 3), ("v", "i", 2.0, 9)]
    df = spark.createDataFrame(rows, "user string, item string, stars double, day int")
    assert {(r.user, r.stars) for r in cf.latest(df, "day").collect()} == {("u", 3.0), ("v", 2.0)}
    assert {(r.user, r.stars) for r in cf.earliest(df, "day").collect()} == {("u", 1.0), ("v", 2.0)}
    assert {(r.user, r.stars) for r in cf.latest(df).collect()} == {("u", 5.0), ("v", 2.0)}


def test_predictions_of_unknown_and_of_lone_ratings(spark):
    ratings = spark.createDataFrame([("a", "x", 4.0), ("a", "y", 2.0), ("b", "x", 5.0)], "user string, item string, stars double")
    test = spark.createDataFrame([("b", "y"), ("z", "x"), ("a", "q"), ("a", "x")], "user string, item string")
    items = spark.createDataFrame([], "a string, b string, sim double")
    assert {(r.user, r.item): r.stars for r in cf.item_predict(test, ratings, items).collect()} == {("b", "y"): 5.0, ("a", "x"): 3.0}
    users = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, sim double")
    got = {(r.user, r.item): r.stars for r in cf.user_predict(test, ratings, users).collect()}
    # b's only rating leaves a mean of 0 without it, and a's rating of y is 2 below a's mean of the rest.
    assert got == {("b", "y"): 3.0, ("a", "x"): 5.0}


def test_older_item_model(spark):
    ratings = [(u, i, float(s)) for i, col in (("a", (1, 2, 3, 5)), ("b", (5, 3, 2, 1)), ("c", (3, 3, 3, 3))) for u, s in enumerate(col)]
    df = spark.createDataFrame(ratings, "user int, item string, stars double")
    got = {(r.a, r.b): r.sim for r in cf.item_model_all_means(df).collect()}
    assert got[("a", "c")] == got[("b", "c")] == 0.0
    assert got[("a", "b")] == pytest.approx(float(np.corrcoef([1, 2, 3, 5], [5, 3, 2, 1])[0, 1]))


def test_averages_round_half_up_at_one_digit(spark):
    stars = [("a", 2.25), ("b", 0.35), ("c", 4.05), ("d", 3.65)]
    ratings = spark.createDataFrame(stars, "item string, stars double")
    items = spark.createDataFrame([(i, i) for i, _ in stars], "item string, categories string")
    got = {r.category: r.avg_stars for r in stats.category_average(ratings, items, "item", "stars").collect()}
    assert got == {"a": 2.3, "b": 0.4, "c": 4.1, "d": 3.7}


def test_session_settings_and_small_inputs(spark):
    session.configure(spark)
    assert {k: spark.conf.get(k) for k in session.SETTINGS} == session.SETTINGS
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert session.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(10**8)
    assert session.spread(large) is large


def test_tables_are_dropped(spark):
    table = storage.written(spark.range(9), "test", files=2)
    assert table.count() == 9 and len(table.inputFiles()) <= 2
    folder = table._tessera_path.removeprefix("file://")
    storage.dropped(table)
    assert not os.path.exists(folder)


def test_repeats_in_baskets(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "b"), (3, None)], "basket int, item string")
    got = {r.basket: (r.n_rows, r["items"], r.all_items) for r in itemsets.baskets(rows, repeats=True).collect()}
    assert got == {1: (3, ["a", "b"], ["a", "b", "b"]), 2: (1, ["b"], ["b"]), 3: (1, [], [])}
    assert {tuple(r) for r in itemsets.singletons(rows, 3).collect()} == {("b", 3, 2)}


def test_pearson_guards(spark):
    ratings = [(u, "a", float(s)) for u, s in enumerate((1, 2, 3, 5))] + [(u, "b", float(s)) for u, s in enumerate((2, 4, 6, 10))]
    ratings += [(u, "flat", 3.0) for u in range(4)] + [(u, "two", float(u)) for u in range(2)]
    df = spark.createDataFrame(ratings, "user int, item string, stars double")
    assert {(r.a, r.b): round(r.sim, 9) for r in cf.item_model(df).collect()} == {("a", "b"): 1.0}


def test_dense_index_and_nmi(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "a", "c", "a", None)], "v string")
    assert {r.v: r.idx for r in encode.dense_index(df, "v").collect()} == {"a": 0, "b": 1, "c": 2}
    one = spark.createDataFrame([(i, i % 3) for i in range(12)], "point_id int, label int")
    other = one.withColumn("label", (F.col("label") + 1) % 3)
    assert metrics.nmi(one, other).head().nmi == pytest.approx(1.0)
