"""Exact quantiles, Clip-Cov and the running loss against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from weftline.operators import batch, groupstats, policy, tabular


def test_quantiles_against_numpy(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice([0.0, 7.5, rng.uniform(-5, 5)]), rng.choice([None, 1.0, rng.gauss(0, 1)]), None) for _ in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    shares = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    real = batch.before
    monkeypatch.setattr(tabular, "before", lambda *a: real(*a, rows_per_range=13))  # many ranges
    got = {r.name: r for r in tabular.quantiles(df, ["b", "a", "c"], shares).collect()}
    assert got.keys() == {"a", "b"}
    for i, name in enumerate("ab"):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[name].n == len(values) and got[name].q == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    assert tabular.quantiles(df.where("false"), ["a"], shares).count() == 0
    one = tabular.quantiles(df.limit(1).selectExpr("3.0 as a"), ["a"], shares).first()
    assert one.q == [3.0] * 6
    odd = tabular.quantiles(spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "a double"), ["a"], [0.0, 0.5, 1.0]).first()
    assert odd.q == [float("-inf"), 1.0, float("inf")]


def test_clip_cov_drops_a_random_subset_of_the_band(spark):
    rng = random.Random(2)
    rows = [(i // 20, i % 20, rng.gauss(-2, 1), 0.0, rng.gauss(0, 1), rng.random() < 0.9) for i in range(400)]
    rows = [(s, t, n, n + rng.uniform(-0.3, 0.3), a, m) for s, t, n, _, a, m in rows]
    df = spark.createDataFrame(rows, "s long, t long, n double, o double, a double, m boolean")
    valid = [r for r in rows if r[5]]
    mean = lambda k: sum(r[k] for r in valid) / len(valid)
    am, nm = mean(4), mean(2)
    for seed, ratio in ((0, 0.05), (1, 0.05), (0, 1e-6), (0, 1.0)):
        band, losses = [], {}
        for s, t, n, o, a, m in valid:
            ratio_ = math.exp(n - o)
            one, two = -a * ratio_, -a * min(max(ratio_, 0.9), 1.1)
            losses[s, t] = max(one, two)
            if two <= one and 0.2 < round((a - am) * (n - nm), 9) < 2:
                band.append((hashlib.md5(f"{seed}:{s}:{t}".encode()).hexdigest(), s, t))
        gone = {(s, t) for _, s, t in sorted(band)[: max(1, int(ratio * len(valid)))]}
        got = policy.clip_cov(df, ("s", "t"), "n", "o", "a", "m", ratio, 0.2, 2.0, 0.1, 0.1, seed).collect()
        assert len(got) == len(rows) and {(r.s, r.t) for r in got if r.dropped} == gone and len(band) > 20
        for r in got:
            assert r.loss is None if not r.m else r.loss == pytest.approx(0 if (r.s, r.t) in gone else losses[r.s, r.t])
    assert policy.clip_cov(df.where("not m"), ("s", "t"), "n", "o", "a", "m").where("dropped").count() == 0
    assert policy.clip_cov(df.where("false"), ("s", "t"), "n", "o", "a", "m").count() == 0


def test_bco_runs_over_batches(spark):
    rng = random.Random(3)
    rows = [(b, *(rng.gauss(-3, 1) for _ in range(4))) for b in (5, 1, 9, 3) for _ in range(7)] + [(3, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0), (11, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "b long, c double, j double, rc double, rj double")
    got = {(r.b, r.c): r for r in policy.bco_loss(df, "b", "c", "j", "rc", "rj", 0.3).collect()}
    mean, count = 0.0, 0
    for b in (1, 3, 5, 9):
        own = [r for r in rows if r[0] == b and r[1] is not None]
        rewards = [0.3 * (r[1] - r[3]) for r in own] + [0.3 * (r[2] - r[4]) for r in own]
        count += 1
        mean += (sum(rewards) / len(rewards) - mean) / count
        for r in own:
            want = math.log1p(math.exp(-(0.3 * (r[1] - r[3]) - mean))) + math.log1p(math.exp(0.3 * (r[2] - r[4]) - mean))
            assert got[b, r[1]].loss == pytest.approx(want) and got[b, r[1]].baseline == pytest.approx(mean)
    assert got[None, 1.0].loss is None and got[11, None].loss is None and got[3, None].loss is None


def test_entropy_and_direct_rewards(spark):
    rows = [([0.0, 0.0, 0.0],), ([1000.0, 0.0],), ([1.0],), ([],), (None,), ([1.0, None],), ([-2.0, 3.0, 0.5],)]
    got = [r.e for r in spark.createDataFrame(rows, "x array<double>").select(policy.entropy(F.col("x")).alias("e")).collect()]
    p = np.exp([-2.0, 3.0, 0.5]) / np.exp([-2.0, 3.0, 0.5]).sum()
    assert got[:3] == pytest.approx([math.log(3), 0.0, 0.0], abs=1e-12) and got[3:6] == [None] * 3 and got[6] == pytest.approx(-(p * np.log(p)).sum())
    df = spark.createDataFrame([(1, [1.0, 2.0], True), (2, [3.0, 4.0], False)], "i int, r array<double>, m boolean")
    assert [r.direct for r in groupstats.token_direct(df, "r", "m").orderBy("i").collect()] == [[1.0, 2.0], [0.0, 0.0]]
    one = spark.createDataFrame([(7, 1, 2.0, 5.0, True), (7, 1, 1.0, 0.0, False)], "u int, s int, r double, o double, m boolean")
    out = groupstats.token_direct_plus_group(one, "u", ("s",), "r", "m", "o", 2.0).orderBy("r").collect()
    assert [r.advantage for r in out] == pytest.approx([0.0, 2.0 + 2.0 * 5.0], rel=1e-5)
    plain = policy.corrected_loss(one, ("s",), "r", "o", "r", "m").orderBy("r").collect()
    assert [r.loss for r in plain] == [None, -4.0]
