"""The best of every group, by the light and by the heavy way."""

import random

import pytest

from tidemill.llm import top_groups as tg


def rows(seed=1):
    rnd = random.Random(seed)
    out = [("hot", 1, k, float(rnd.randrange(40))) for k in range(3000)]
    out += [(rnd.choice(["a", "b", "c", None]), rnd.choice([1, 2, None]), k, rnd.choice([float(rnd.randrange(5)), float("nan"), float("inf"), None])) for k in range(500)]
    return out


def brute(latest, n):
    groups = {}
    for (g, w, cfg), score in latest.items():
        if score is not None:
            groups.setdefault((g, w), []).append((-score, cfg))
    return sorted(((g, w, cfg, -s, k + 1) for (g, w), held in groups.items() for k, (s, cfg) in enumerate(sorted(held)[:n])), key=repr)


@pytest.mark.parametrize("heavy", [1, 50, 1000, 10**6])
def test_both_ways_agree_with_brute_force(spark, heavy):
    data = rows()
    versions = [(*x, 1) for x in data] + [(g, w, c, 99.0, 0) for g, w, c, _ in data[:50]] + [(*x, 1) for x in data[:80]]
    df = spark.createDataFrame(versions, "g string, w int, cfg long, score double, at int").repartition(7)
    latest = {}
    for g, w, c, s, at in versions:
        ok = s if s is not None and s == s and abs(s) != float("inf") else None
        if at == 1:
            old = latest.get((g, w, c))
            latest[g, w, c] = ok if old is None else max(old, ok) if ok is not None else old
    scored = tg.latest_score(df, ["g", "w"], "cfg", "score", "at")
    got = sorted((tuple(r) for r in tg.top_per_group(scored, ["g", "w"], "cfg", 5, heavy).collect()), key=repr)
    assert got == brute(latest, 5)


def test_more_heavy_groups_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(tg, "MAX_HEAVY", 2)
    df = spark.createDataFrame([(g, k, float(k % 7)) for g in range(6) for k in range(30 + g)], "g int, cfg long, score double")
    assert [r[0] for r in tg.heavy_groups(df, ["g"], 10)] == [5, 4]
    got = sorted(tuple(r) for r in tg.top_per_group(df, ["g"], "cfg", 3, 10).collect())
    assert got == [(g, c, 6.0, k + 1) for g in range(6) for k, c in enumerate((6, 13, 20))]


def test_no_group_is_joined_by_shuffle(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(100)], "g int, cfg long, score double")
    plan = tg.top_per_group(df, ["g"], "cfg", 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_version_without_score_takes_the_item_out(spark):
    df = spark.createDataFrame([("g", 1, 5.0, 1), ("g", 1, None, 2), ("g", 2, 1.0, None), ("g", 2, float("nan"), None)], "g string, cfg long, score double, at int")
    got = [tuple(r) for r in tg.top_per_group(tg.latest_score(df, ["g"], "cfg", "score", "at"), ["g"], "cfg", 5).collect()]
    assert got == [("g", 2, 1.0, 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "g string, cfg long, score double")
    assert tg.top_per_group(df, ["g"], "cfg", 5).collect() == []
