"""Models on expanding windows, and what they rest on."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import aggregates, grids, learn, stats


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(6)
    data = []
    for k in range(400):
        x, noise = rnd.gauss(0, 1), rnd.gauss(0, 1)
        data.append(("a", k, x, noise, float(x + rnd.gauss(0, 0.3) > 0)))
    df = spark.createDataFrame(data + [("a", 400, None, 1.0, 1.0), ("a", 401, 1.0, 1.0, None)], "s string, t int, x double, noise double, y double")
    return grids.folds(df, ["s"], ["t"], 3).cache()


def test_folds_are_consecutive_and_of_one_size(rows):
    got = {r["fold"]: (r["lo"], r["hi"]) for r in rows.groupBy("fold").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert got == {0: (0, 99), 1: (100, 199), 2: (200, 299), 3: (300, 401)}


@pytest.mark.parametrize("kind", ["gbt", "logistic"])
def test_walk_forward_predicts_what_comes_after(rows, kind):
    p = learn.walk_forward(rows, ["x", "noise"], "y", "fold", 3, kind)
    assert {r["fold"] for r in p.select("fold").distinct().collect()} == {1, 2, 3} and p.where("x IS NULL OR y IS NULL").count() == 0
    auc = {r["fold"]: r["auc"] for r in stats.cliffs_delta(p, ["fold"], "p", "y").collect()}
    assert all(v > 0.9 for v in auc.values())


def test_a_fold_of_one_class_gets_no_prediction(rows):
    one = rows.withColumn("y", F.when(F.col("fold") == 0, 1.0).otherwise(F.col("y")))
    assert {r["fold"] for r in learn.walk_forward(one, ["x"], "y", "fold", 3, "logistic").select("fold").distinct().collect()} == {2, 3}
    assert learn.walk_forward(rows.limit(0), ["x"], "y", "fold", 3).count() == 0


def test_permuting_keeps_the_values_and_breaks_the_tie(rows):
    held = rows.na.drop()
    got = learn.permuted(held, "x", ["s", "t"]).select("t", "x").toPandas().sort_values("t")
    old = held.select("t", "x").toPandas().sort_values("t")
    assert sorted(got.x) == sorted(old.x) and abs(got.x.corr(old.x.reset_index(drop=True))) < 0.3
    assert (got.x.values != old.x.values).mean() > 0.9


def test_target_is_null_in_the_last_row(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, -1.0, 0.0, 2.0])], "s string, t int, x double")
    got = {r["t"]: r["target"] for r in learn.next_period_target(df, ["s"], "t", "x").collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0, 3: None}


def test_ranks_over_ranges(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot"] * 5 + ["b", None]), rnd.randrange(50), k) for k in range(2000)]
    df = spark.createDataFrame(data, "g string, x int, id int").repartition(6)
    got = {r["id"]: (r["_rank"], r["_n"]) for r in aggregates.distributed_rank(df, ["g"], [F.col("x"), F.col("id")]).collect()}
    for g in ("hot", "b", None):
        mine = sorted((x, k) for h, x, k in data if h == g)
        assert all(got[k] == (n + 1, len(mine)) for n, (_, k) in enumerate(mine))
    assert aggregates.distributed_rank(df.limit(0), ["g"], [F.col("x")]).collect() == []


def test_best_share_of_each_group(spark):
    df = spark.createDataFrame([("a", k) for k in range(1000)] + [("b", k) for k in range(5)], "g string, x int")
    got = [(r["g"], r["x"]) for r in aggregates.top_fraction(df, ["g"], [F.col("x").desc()], 0.05, 3).collect()]
    assert sorted(got) == [("a", k) for k in range(950, 1000)] + [("b", k) for k in (2, 3, 4)]
