"""Pairs by nearest time against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare
from tidemill.llm import nearest_time as nt


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p4_ranked"])
def test_against_sql(spark, name):
    n, m, extra, missing = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert n == m > 0 and not extra and not missing


def brute(left, right, tolerance):
    out = {}
    for e, t, i in set(left):
        if None in (e, t, i):
            continue
        near = [(abs(rt - t), rt, ri) for re, rt, ri in right if re == e and rt is not None and ri is not None and abs(rt - t) <= tolerance]
        if near:
            out[e, t, i] = min(near)[2]
    return sorted((k[2], v) for k, v in out.items())


@pytest.mark.parametrize("seed, part", [(1, None), (2, 60), (3, 97)])
def test_against_brute_force(spark, seed, part):
    rnd = random.Random(seed)
    entity = lambda: rnd.choice(["hot"] * 8 + ["a", "b", None])
    left = [(entity(), rnd.randrange(3000), k) for k in range(400)]
    right = [(entity(), rnd.randrange(3000), 10_000 + k) for k in range(300)] + [("hot", None, 1), ("hot", 5, None)]
    left += left[:30] + [("hot", None, 7), ("only left", 5, 900)]
    right += right[:20]
    kind = "e string, t long, i long"
    a, b = (nt.side(spark.createDataFrame(x, kind).repartition(5), [F.col("e")], F.col("t"), F.col("i")) for x in (left, right))
    got = sorted(tuple(r) for r in nt.nearest_in_time(a, b, 40, part).collect())
    assert got == brute(left, right, 40)


def test_ties_go_to_the_earlier_then_the_smaller_id(spark):
    kind = "e string, t long, i long"
    a = nt.side(spark.createDataFrame([("x", 100, 1), ("x", 200, 2)], kind), [F.col("e")], F.col("t"), F.col("i"))
    b = nt.side(spark.createDataFrame([("x", 110, 5), ("x", 90, 9), ("x", 90, 8), ("x", 200, 4), ("x", 200, 3)], kind), [F.col("e")], F.col("t"), F.col("i"))
    assert sorted(tuple(r) for r in nt.nearest_in_time(a, b, 10).collect()) == [(1, 8), (2, 3)]


def test_empty_sides(spark):
    kind = "e string, t long, i long"
    some, none = (nt.side(spark.createDataFrame(x, kind), [F.col("e")], F.col("t"), F.col("i")) for x in ([("x", 1, 1)], []))
    assert nt.nearest_in_time(some, none, 10).collect() == [] == nt.nearest_in_time(none, some, 10).collect()


def test_part_shorter_than_the_tolerance_is_refused(spark):
    some = nt.side(spark.createDataFrame([("x", 1, 1)], "e string, t long, i long"), [F.col("e")], F.col("t"), F.col("i"))
    with pytest.raises(ValueError):
        nt.nearest_in_time(some, some, 10, 5)
