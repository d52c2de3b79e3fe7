"""Fits against dense numerics, and comparison scores against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.models import compare, grid, special
from emberline.models import fit as m
from emberline.operators.encode import Formula


def sample(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    g = rng.integers(0, 12, n)
    u = rng.normal(scale=0.8, size=12)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + 0.7 * x + u[g])))).astype(float)
    return [(int(i), float(a), f"g{b}", float(c)) for i, (a, b, c) in enumerate(zip(x, g, y))]


def frame(spark, parts=4):
    return spark.createDataFrame(sample(), "i int, x double, g string, y double").repartition(parts)


def test_special_functions():
    for v in (0.3, 1.0, 4.5, 120.0):
        assert special.gammaln(v) == pytest.approx(math.lgamma(v), rel=1e-10, abs=1e-10)
        h = 1e-5 * max(v, 1)
        assert special.digamma(v) == pytest.approx((math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h), rel=1e-6, abs=1e-6)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-10)


def dense_mode(rows, sd, priors):
    """Newton on the joint mode of fixed and group effects for a given group sd."""
    y = np.array([r[3] for r in rows])
    names = sorted({r[2] for r in rows})
    z = np.array([[r[2] == k for k in names] for r in rows], dtype=float)
    x = np.column_stack([np.ones(len(rows)), [r[1] for r in rows]])
    a = np.column_stack([x, z])
    center = np.concatenate([x.mean(axis=0), np.zeros(len(names))])
    t = np.zeros(a.shape[1])
    for _ in range(200):
        at = center @ t
        w0 = 4 / (3 * priors.intercept**2 + at**2)
        pen = np.diag([0.0, 1 / priors.b**2] + [1 / sd**2] * len(names)) + w0 * np.outer(center, center)
        mu = 1 / (1 + np.exp(-(a @ t)))
        h = a.T @ (a * (mu * (1 - mu))[:, None]) + pen
        t = t + np.linalg.solve(h, a.T @ (y - mu) - pen @ t)
    return t[:2], dict(zip(names, t[2:]))


def test_logit_equals_dense_newton_and_partitions_do_not_matter(spark):
    formula = Formula("y", ["x"], groups=("g",))
    fits = [m.fit(frame(spark, parts), formula, "bernoulli", tol=1e-8) for parts in (1, 16)]
    assert np.allclose(fits[0].beta, fits[1].beta, atol=1e-6)
    f = fits[0]
    assert f.converged and f.gradient < 1e-6
    sd = math.sqrt(f.group_cov["g"][0, 0])
    beta, u = dense_mode(sample(), sd, m.Priors())
    assert np.allclose(f.beta, beta, atol=1e-4)
    got = {r["level"]: r["estimate"] for r in m.ranef(f, "g").collect()}
    assert all(abs(got[k] - v) < 1e-3 for k, v in u.items())
    assert {r["term"] for r in m.coef_table(f).collect()} == {"Intercept", "x"}


def test_gaussian_without_groups_is_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = 1.0 + 2.0 * x + rng.normal(scale=0.5, size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    f = m.fit(df, Formula("y", ["x"]), "gaussian", m.Priors(b=1e6, intercept=1e6, intercept_df=None))
    want = np.polyfit(x, y, 1)[::-1]
    assert np.allclose(f.beta, want, atol=1e-5)
    assert f.shape == pytest.approx(np.std(y - np.polyval(want[::-1], x)), rel=0.01)


def test_negbinomial_recovers_rate_and_shape(spark):
    rng = np.random.default_rng(5)
    n, phi = 4000, 2.0
    off = rng.uniform(0, 1, n)
    x = rng.normal(size=n)
    mu = np.exp(0.5 + 0.4 * x + off)
    y = rng.poisson(rng.gamma(phi, mu / phi))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, off, y)], "x double, o double, y int")
    f = m.fit(df, Formula("y", ["x"], offset="o"), "negbinomial")
    assert f.converged
    assert np.allclose(f.beta, [0.5, 0.4], atol=0.08) and f.shape == pytest.approx(phi, rel=0.15)


def test_binomial_trials_and_slopes_run(spark):
    df = frame(spark).withColumn("t", F.lit(3)).withColumn("hits", F.col("y") * 2)
    f = m.fit(df, Formula("hits", ["x"], groups=("g",), trials="t"), "binomial", scale_tol=0.01)
    assert f.gradient < 1e-4
    s = m.fit(df, Formula("x", ["y"], groups=("g",), slopes={"g": "y"}), "gaussian", max_cycles=6, strict=False)
    assert len(m.ranef(s, "g").collect()) == 24
    assert "cor(g)" in {r["name"] for r in m.scale_table(s).collect()}


def test_importance_loo_equals_direct_sums(spark):
    rng = np.random.default_rng(1)
    ll = -np.abs(rng.normal(size=(20, 400)))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(ll)], "obs int, loglik array<double>")
    got = {r["obs"]: r for r in compare.loo(df, smooth=False).collect()}
    for i, row in enumerate(ll):
        assert got[i]["elpd"] == pytest.approx(-np.log(np.exp(-row).mean()))
    smooth = {int(r["obs"]): r for r in compare.loo(df).collect()}
    assert all(abs(smooth[i]["elpd"] - got[i]["elpd"]) < 0.1 for i in smooth)


def test_pareto_shape_of_a_known_tail():
    rng = np.random.default_rng(2)
    k, scale = 0.4, 2.0
    tail = np.sort(scale / k * ((1 - rng.uniform(size=20000)) ** -k - 1))
    shape, s = (v[0] for v in compare.pareto_fit(tail[None]))
    assert shape == pytest.approx(k, abs=0.05) and s == pytest.approx(scale, rel=0.05)


def test_pointwise_and_predictive_check(spark):
    f = m.fit(frame(spark), Formula("y", ["x"], groups=("g",)), "bernoulli", keep=["i"], scale_tol=0.01)
    rows = m.pointwise(f, "i", 20).collect()
    assert len(rows) == 600 and len(rows[0]["loglik"]) == 20
    check = compare.ppc(f, "i", 4).collect()
    totals = {}
    for r in check:
        totals[r["draw"]] = totals.get(r["draw"], 0) + r["n"]
    assert totals == {d: 600 for d in range(5)}
    ones = {r["draw"]: r["n"] for r in check if r["value"] == 1.0}
    assert all(abs(ones[d] - ones[0]) < 100 for d in range(1, 5))
    draws = m.draws_table(f, 500)
    summary = {r["term"]: r for r in compare.posterior_summary(draws).collect()}
    assert summary["x"]["estimate"] == pytest.approx(f.beta[1], abs=0.05)


def test_compare_ranks_the_better_model(spark):
    base = spark.range(100).select(F.col("id").alias("obs"))
    a = base.withColumn("elpd", F.lit(-1.0) - F.col("obs") / 100)
    b = base.withColumn("elpd", F.lit(-2.0) - F.col("obs") / 50)
    got = {r["model"]: r for r in compare.loo_compare({"a": a, "b": b}).collect()}
    assert got["a"]["elpd_diff"] == 0 and got["a"]["se_diff"] == 0
    assert got["b"]["elpd_diff"] < 0 and got["b"]["se_diff"] > 0


def test_grid_names_and_reuse(spark, tmp_path):
    assert len(grid.MODELS) == 20
    assert grid.MODELS["pa_m7"].formula.terms[-3:] == ["days_since_fire_z*broad_taxon", "log_effort_pa_z", "log_effort2_pa_z"]
    spec = grid.ModelSpec("tiny", "t", Formula("y", ["x"], groups=("g",)), "bernoulli", m.Priors())
    out = str(tmp_path / "grid")
    first = grid.run_grid([spec], {"t": frame(spark)}, out, max_cycles=2, strict=False).count()
    again = grid.run_grid([spec], {"t": frame(spark)}, out, max_cycles=2, strict=False).count()
    assert first == again == 6


def test_smoothing_by_rows_is_smoothing_of_each_row():
    rng = np.random.default_rng(4)
    ll = rng.normal(size=(30, 200)) * rng.uniform(0.01, 3, size=(30, 1))
    ll[3] = 1.0
    whole, shapes = compare.smooth_log_weights(ll)
    for i in range(len(ll)):
        one, shape = compare.smooth_log_weights(ll[i])
        assert np.allclose(one[0], whole[i]) and (shape[0] == shapes[i] or np.isclose(shape[0], shapes[i]))
    assert np.allclose(np.exp(whole).sum(axis=1), 1) and shapes[3] == 0


def test_group_effects_are_drawn_with_their_spread(spark):
    f = m.fit(frame(spark), Formula("y", ["x"], groups=("g",)), "bernoulli", keep=["i"])
    se = {r["level"]: r["se"] for r in m.ranef(f, "g").collect()}
    rows = {r["obs"]: r for r in m.pointwise(f, "i", 400).collect()}
    betas = m.draw_betas(f, 400)
    level = {str(r[0]): (r[1], r[2]) for r in sample()}
    for obs in ("0", "17", "99"):
        x, g = level[obs]
        mu = np.array(rows[obs]["fitted"])
        spread = (np.log(mu / (1 - mu)) - betas @ [1, x]).std()
        assert spread == pytest.approx(se[g], rel=0.25)
    same = [o for o in level if level[o][1] == level["0"][1]][:2]
    parts = [np.array(rows[o]["fitted"]) for o in same]
    noise = [np.log(p / (1 - p)) - betas @ [1, level[o][0]] for p, o in zip(parts, same)]
    assert np.allclose(noise[0], noise[1])
