"""Queries without SQL cover every row, prompt and round of their tables."""

import os

import numpy as np
import pytest

from weftline.operators import evaluation
from weftline.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_bootstrap_has_a_row_per_order(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_quantity").toPandas()
    got = {r.l_orderkey: r for r in QUERIES["bootstrap_best_worst"](spark, DATA).collect()}
    assert set(got) == set(lines.l_orderkey)
    for key, values in list(lines.groupby("l_orderkey").l_quantity)[:50]:
        v = np.sort(values.to_numpy(dtype=float))
        pick = v[np.random.default_rng(42).integers(0, len(v), size=(1000, 4))]
        want = (pick.max(axis=1).mean(), pick.max(axis=1).std(), pick.min(axis=1).mean(), pick.min(axis=1).std())
        assert (got[key].best_mean, got[key].best_std, got[key].worst_mean, got[key].worst_std) == pytest.approx(want, abs=1e-6)


def test_bootstrap_keeps_prompts_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None), (None, 3.0)], "uid long, v double")
    got = {None if r.uid is None or r.uid != r.uid else r.uid: r.best_mean for r in evaluation.bootstrap(df, "uid", "v", 4).collect()}
    assert set(got) == {1, 2, None}
    assert got[None] == 3.0


def test_expansion_covers_every_event(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type").toPandas()
    got = QUERIES["expand_with_mock"](spark, DATA).toPandas()
    assert sorted(got.event_id) == sorted(events.event_id)
    summary = {r.event_type: r.n for r in QUERIES["expansion_summary"](spark, DATA).collect()}
    assert summary == events.groupby("event_type").size().to_dict() | {"ALL": len(events)}


def test_feature_search_runs_all_rounds(spark):
    got = QUERIES["feature_search"](spark, DATA).orderBy("round").collect()
    assert [(r.round, r.feature) for r in got] == [(i, f"f{i}") for i in range(4)]
