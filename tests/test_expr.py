"""Reducers and calendar recipes against direct numpy/pandas computations
written from the stated semantics."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import expr as X
from quire.operators import monitor as M


def _slope_norm(y):
    y = np.asarray(y, dtype=float)
    if len(y) < 3 or abs(y.mean()) == 0:
        return 0.0
    return float(np.polyfit(np.arange(len(y)), y, 1)[0] / abs(y.mean()))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=0, max_value=12), min_size=1, max_size=8),
       st.lists(st.integers(min_value=1, max_value=5000), min_size=8, max_size=8))
def test_zero_filled_slope_matches_polyfit(spark, weeks, values):
    weeks = sorted(set(weeks))
    y = {w: values[i] for i, w in enumerate(weeks)}
    w0, w1 = weeks[0], weeks[-1]
    series = [y.get(w, 0) for w in range(w0, w1 + 1)]
    n = w1 - w0 + 1
    sy = sum(y.values())
    sxy = sum((w - w0) * v for w, v in y.items())
    got = spark.range(1).select(X.slope_normalized_zero_filled(F.lit(n), F.lit(sy), F.lit(sxy)).alias("s")).first().s
    assert abs(got - _slope_norm(series)) < 1e-9


def test_month_ends_match_pandas():
    for start, end in [(dt.date(2001, 2, 2), dt.date(2001, 8, 1)), (dt.date(2000, 1, 31), dt.date(2000, 7, 31)),
                       (dt.date(2024, 2, 29), dt.date(2024, 3, 30)), (dt.date(2023, 6, 5), dt.date(2023, 6, 20))]:
        expect = max(len(pd.date_range(start, end, freq="ME")), 1)
        assert X.month_ends_between(start, end) == expect


def test_hhi_cv_moments(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(1, 10_000, 50).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    r = df.agg(F.count("x").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2")).first()
    std = spark.range(1).select(X.sample_std_from_moments(F.lit(r.n), F.lit(r.s1), F.lit(r.s2)).alias("s")).first().s
    assert abs(std - v.std(ddof=1)) < 1e-6
    hhi = spark.range(1).select(X.hhi(F.lit(float((v * v).sum())), F.lit(float(v.sum()))).alias("h")).first().h
    assert abs(hhi - float(((v / v.sum()) ** 2).sum())) < 1e-12


def _psi_numpy(e, a, bins=10):
    edges = np.linspace(min(e.min(), a.min()), max(e.max(), a.max()), bins + 1)
    ep = np.clip(np.histogram(e, bins=edges)[0] / len(e), 1e-4, None)
    ap = np.clip(np.histogram(a, bins=edges)[0] / len(a), 1e-4, None)
    return round(float(np.sum((ap - ep) * np.log(ap / ep))), 4)


def test_psi_matches_numpy(spark):
    rng = np.random.default_rng(3)
    cases = [(rng.normal(0, 1, 400), rng.normal(0.3, 1.2, 300)),
             (np.array([0.0, 0.3, 0.6, 0.9, 1.0] * 20), np.array([0.3, 0.6, 0.6, 1.0] * 10)),  # edge values
             (np.ones(10), np.ones(7))]                                                      # constant
    for e, a in cases:
        le = spark.createDataFrame([("f", float(x)) for x in e], "feature string, value double")
        la = spark.createDataFrame([("f", float(x)) for x in a], "feature string, value double")
        got = M.psi_from_long(le, la).first().psi
        assert got == _psi_numpy(e, a)


def test_auc_brier_rank_form(spark):
    rng = np.random.default_rng(11)
    s = np.round(rng.random(300), 2)  # heavy ties
    y = (rng.random(300) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    r = M.auc_brier(df, "score", "label").first()
    pos, neg = s[y == 1], s[y == 0]
    pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert abs(r.auc - pairs / (len(pos) * len(neg))) < 1e-6
    assert abs(r.brier - float(((s - y) ** 2).mean())) < 1e-6
