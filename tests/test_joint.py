"""Joint fits with crossed factors against dense numerics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.models import compare, grid, joint
from emberline.models import fit as m
from emberline.operators.encode import Formula

SIZES = {"a": 40, "b": 9, "c": 6}


def sample(family="bernoulli", n=900, seed=2):
    """Rows with three crossed factors, some complete only for a part of the columns."""
    rng = np.random.default_rng(seed)
    u = {g: rng.normal(0, s, SIZES[g]) for g, s in zip(SIZES, (0.7, 0.5, 0.4), strict=True)}
    rows = []
    for k in range(n):
        x, z = rng.normal(size=2).tolist()
        codes = {g: int(rng.integers(s) ** 2 // s) for g, s in SIZES.items()}
        eta = 0.2 + 0.6 * x - 0.3 * z + sum(u[g][c] for g, c in codes.items())
        if family == "bernoulli":
            y = float(rng.uniform() < 1 / (1 + np.exp(-eta)))
        elif family == "negbinomial":
            y = float(rng.poisson(rng.gamma(1.5, np.exp(eta) / 1.5)))
        else:
            y = float(eta + 0.5 * rng.normal())
        rows.append((k, y, x, z if k % 10 else None, *[f"{g}{c}" for g, c in codes.items()]))
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "i int, y double, x double, z double, a string, b string, c string").repartition(parts)


def dense(rows, terms, groups, family, priors, scales, shape, slope=None):
    """Newton on the joint mode with given scales: mode, inverse curvature, names of the columns, log marginal."""
    rows = [r for r in rows if None not in r]
    place = {"y": 1, "x": 2, "z": 3, "a": 4, "b": 5, "c": 6}
    y = np.array([r[1] for r in rows])
    x = np.column_stack([np.ones(len(rows)), *[[r[place[t]] for r in rows] for t in terms]])
    columns, names, prior = [x], [*["Intercept", *terms]], []
    for g in groups:
        levels = sorted({r[place[g]] for r in rows})
        hot = np.array([[r[place[g]] == v for v in levels] for r in rows], float)
        cov = np.atleast_2d(scales[g])
        parts = [hot] if len(cov) == 1 else [hot, hot * np.array([r[place[slope]] for r in rows])[:, None]]
        block = np.stack(parts, axis=2).reshape(len(rows), -1)
        columns.append(block)
        names += [(g, v, k) for v in levels for k in range(len(cov))]
        prior.append((len(levels), cov))
    a = np.column_stack(columns)
    p, n = x.shape[1], a.shape[1]
    base = np.zeros((n, n))
    base[range(1, p), range(1, p)] = 1 / priors.b**2
    at, fixed_log = p, 0.0
    for levels, cov in prior:
        q = len(cov)
        for k in range(levels):
            base[at + q * k : at + q * k + q, at + q * k : at + q * k + q] = np.linalg.inv(cov)
        at += levels * q
        fixed_log -= 0.5 * levels * np.linalg.slogdet(cov)[1]
    center = np.concatenate([x.mean(0), np.zeros(n - p)])
    t = np.zeros(n)
    t[0] = np.log(max(y.mean(), 0.1)) if family == "negbinomial" else 0.0
    from emberline.models import family as fam

    one = np.ones(len(y))
    for _ in range(100):
        mean = center @ t
        w0 = 1 / priors.intercept**2
        if priors.intercept_df is not None:
            w0 = 4 / (3 * priors.intercept**2 + mean**2)
        pen = base + w0 * np.outer(center, center)
        g, w = fam.score(family, y, a @ t, one, shape)
        h = a.T @ (a * w[:, None]) + pen
        t = t + np.linalg.solve(h, a.T @ g - pen @ t)
    log = fam.log_lik(family, y, a @ t, one, shape).sum() + fixed_log - 0.5 * (t @ base @ t) - 0.5 * np.linalg.slogdet(h)[1]
    log -= 0.5 * w0 * mean**2 if priors.intercept_df is None else 2 * np.log1p(mean**2 / (3 * priors.intercept**2))
    return t, np.linalg.inv(h), names, float(log)


SCALES = {"a": [[0.6]], "b": [[0.5]], "c": [[0.3]]}
COV = {g: np.square(s) for g, s in SCALES.items()}


@pytest.mark.parametrize("few", [0, 10_000])
@pytest.mark.parametrize("family", ["bernoulli", "negbinomial", "gaussian"])
def test_three_crossed_factors_equal_a_dense_fit(spark, monkeypatch, family, few):
    monkeypatch.setattr(joint, "FEW", few)
    monkeypatch.setattr(joint, "CHUNK", 7)
    rows, priors = sample(family), m.Priors()
    formula = Formula("y", ["x", "z"], groups=("a", "b", "c"))
    f = m.fit(frame(spark, rows), formula, family, priors, scales=COV, shape=0.8, tol=1e-9)
    mode, cov, names, log = dense(rows, ["x", "z"], ["a", "b", "c"], family, priors, COV, 0.8)
    assert (f.joint.layout.large == "a") == (few == 0) and f.converged
    assert np.allclose(f.beta, mode[:3], atol=1e-7) and np.allclose(f.cov, cov[:3, :3], atol=1e-9)
    assert f.joint.model.marginal == pytest.approx(log, abs=1e-6)
    for g in "abc":
        got = {r["level"]: (r["estimate"], r["se"]) for r in m.ranef(f, g).collect()}
        want = {v[1]: (mode[k], np.sqrt(cov[k, k])) for k, v in enumerate(names) if v[0] == g}
        assert got.keys() == want.keys() and all(np.allclose(got[v], want[v], atol=1e-7) for v in want)


def test_models_of_one_table_share_its_scans(spark, monkeypatch):
    monkeypatch.setattr(joint, "FEW", 0)
    scans = []
    one_pass = joint.one_pass
    monkeypatch.setattr(joint, "one_pass", lambda *a: scans.append(len(a[2])) or one_pass(*a))
    rows = sample()
    df = frame(spark, rows)
    groups = ("a", "b", "c")
    formulas = {"x": Formula("y", ["x"], groups=groups), "xz": Formula("y", ["x", "z"], groups=groups), "xxz": Formula("y", ["x", "x*z"], groups=groups)}
    fits = joint.fit_together(df, [joint.Task(k, f) for k, f in formulas.items()])
    shared = len(scans)
    assert scans[0] == 3 and scans == sorted(scans, reverse=True)
    for name, formula in formulas.items():
        alone = m.fit(df, formula)
        assert np.allclose(alone.beta, fits[name].beta, atol=1e-4) and fits[name].converged
        assert all(np.allclose(alone.group_cov[g], fits[name].group_cov[g], rtol=2e-3) for g in groups)
        assert fits[name].design.count() == sum(1 for r in rows if name == "x" or r[3] is not None)
    assert shared == max(f.steps for f in fits.values())
    # In turn, the steps go round the factors and reach the same mode.
    turn = m.fit_in_turn(df, formulas["xz"], "bernoulli", max_cycles=200)
    assert np.allclose(turn.beta, fits["xz"].beta, atol=0.02)


def test_correlated_slopes_equal_a_dense_fit(spark):
    rows, priors = sample("gaussian"), m.Priors(b=0.5, intercept=1.0, intercept_df=None)
    cov = {"b": np.array([[0.4, 0.1], [0.1, 0.2]]), "a": np.array([[0.3]])}
    formula = Formula("y", ["x", "z"], groups=("b", "a"), slopes={"b": "x"})
    f = m.fit(frame(spark, rows), formula, "gaussian", priors, scales=cov, shape=0.6, tol=1e-9)
    mode, dense_cov, names, log = dense(rows, ["x", "z"], ["b", "a"], "gaussian", priors, cov, 0.6, "x")
    assert np.allclose(f.beta, mode[:3], atol=1e-7) and np.allclose(f.cov, dense_cov[:3, :3], atol=1e-9)
    assert f.joint.model.marginal == pytest.approx(log, abs=1e-6)
    got = {(r["level"], r["coef"]): r["estimate"] for r in m.ranef(f, "b").collect()}
    assert all(got[v, ("Intercept", "x")[k]] == pytest.approx(mode[i], abs=1e-7) for i, (g, v, k) in ((i, n) for i, n in enumerate(names) if n[0] == "b"))
    rng = np.random.default_rng(0)
    tilt = {f"b{k}": v for k, v in enumerate(rng.normal(0, 0.6, SIZES["b"]).tolist())}
    tilted = [(r[0], r[1] + tilt[r[5]] * r[2], *r[2:]) for r in rows]
    free = m.fit(frame(spark, tilted), formula, "gaussian", priors)
    sd = np.sqrt(np.diag(free.group_cov["b"]))
    assert free.converged and abs(free.shape - 0.64) < 0.1 and abs(sd[1] - np.std(list(tilt.values()))) < 0.25


def test_joint_draws_have_the_dense_covariance(spark, monkeypatch):
    monkeypatch.setattr(joint, "FEW", 0)
    rows, priors, draws = sample("gaussian", n=300), m.Priors(), 4000
    formula = Formula("y", ["x", "z"], groups=("a", "b"))
    f = m.fit(frame(spark, rows), formula, "gaussian", priors, keep=["i"], scales=COV, shape=0.8, tol=1e-9)
    mode, cov, names, _ = dense(rows, ["x", "z"], ["a", "b"], "gaussian", priors, COV, 0.8)
    got = {int(r["obs"]): np.array(r["fitted"]) for r in m.pointwise(f, "i", draws).filter("cast(obs as int) < 40").collect()}
    full = {r[0]: r for r in rows if None not in r}
    z = {i: np.array([1.0, full[i][2], full[i][3], *[float(full[i][{"a": 4, "b": 5}[n[0]]] == n[1]) for n in names[3:]]]) for i in got}
    ids = sorted(got)
    want = np.array([[z[i] @ cov @ z[j] for j in ids] for i in ids])
    have = np.cov(np.array([got[i] for i in ids]))
    assert np.abs(have - want).max() < 0.12 * np.diag(want).max()
    assert np.allclose([got[i].mean() for i in ids], [z[i] @ mode for i in ids], atol=4 * np.sqrt(np.diag(want).max() / draws))


def test_intervals_of_scales_equal_quadrature(spark):
    rows, priors = sample("gaussian", n=200), m.Priors()
    formula = Formula("y", ["x", "z"], groups=("b",))
    f = m.fit(frame(spark, rows), formula, "gaussian", priors)
    got = {r["name"]: r for r in joint.scale_intervals(f).collect()}
    # Moments of the log scales on a grid, weighted by the dense marginal.
    s, g = np.log(f.shape), np.log(np.sqrt(f.group_cov["b"][0, 0]))
    grid_s, grid_g = s + np.linspace(-0.25, 0.25, 21), g + np.linspace(-1.6, 2.2, 39)
    log = np.array([[dense(rows, ["x", "z"], ["b"], "gaussian", priors, {"b": [[np.exp(2 * b)]]}, np.exp(a))[3] + a + b - np.exp(a) - np.exp(b) for b in grid_g] for a in grid_s])
    w = np.exp(log - log.max())
    w /= w.sum()
    for name, axis, values in (("sigma", 1, grid_s), ("sd(b:Intercept)", 0, grid_g)):
        share = w.sum(axis)
        mean = share @ values
        assert got[name]["log_se"] == pytest.approx(np.sqrt(share @ (values - mean) ** 2), rel=0.25)
        assert got[name]["lower"] < got[name]["value"] < got[name]["upper"]


def test_too_many_levels_go_round_the_factors(spark, monkeypatch):
    monkeypatch.setattr(joint, "FEW", 0)
    monkeypatch.setattr(joint, "DENSE", 5)
    f = m.fit(frame(spark, sample(n=300)), Formula("y", ["x"], groups=("a", "b")), strict=False, max_cycles=3)
    assert f.joint is None and len(f.effects) == 2
    with pytest.raises(joint.TooManyLevels):
        m.fit(frame(spark, sample(n=300)), Formula("y", ["x"], groups=("a", "b")), scales=COV)


def test_grid_is_scored_and_stored(spark, tmp_path):
    spec = lambda name, terms: grid.ModelSpec(name, "t", Formula("y", terms, groups=("a", "b")), "bernoulli", m.Priors())
    df = frame(spark, [r for r in sample() if r[3] is not None])
    fits = grid.fit_grid([spec("m1", ["x"]), spec("m2", ["x", "z"]), spec("m1_final", ["x"])], {"t": df}, keep=["i"])
    assert fits["m1"] is fits["m1_final"]
    scores = grid.grid_scores(fits, "i", str(tmp_path / "loo"), 100)
    ranked = {r["model"]: r for r in compare.loo_compare(scores).collect()}
    assert ranked["m1"]["elpd"] == ranked["m1_final"]["elpd"] and max(r["elpd_diff"] for r in ranked.values()) == 0
    assert scores["m1"].count() == df.count()


def test_a_hot_level_is_one_line_per_batch(spark, monkeypatch):
    monkeypatch.setattr(joint, "FEW", 0)
    rows = [(*r[:4], "a0" if k % 3 else r[4], *r[5:]) for k, r in enumerate(sample(n=600))]
    fits = [m.fit(frame(spark, rows, parts), Formula("y", ["x"], groups=("a", "b"))) for parts in (1, 7)]
    assert np.allclose(fits[0].beta, fits[1].beta, atol=1e-5)
    assert fits[0].design.select(F.max("level")).first()[0] is not None


def test_counts_are_replicated_by_bisection():
    from emberline.models import family as fam
    from emberline.models import special

    rng = np.random.default_rng(1)
    assert special.beta_share(2, 3, 0.4) == pytest.approx(0.5248) and special.beta_share(5, 1, 0.0) == 0 and special.beta_share(5, 1, 1.0) == 1
    for family, eta, trials in (("negbinomial", np.log([0.3, 5.0, 40.0]), np.ones(3)), ("binomial", np.array([-2.0, 0.0, 3.0]), np.array([1.0, 12.0, 60.0]))):
        for u in rng.uniform(size=60):
            got = compare._replicate(family, np.full(3, u), eta, trials, 1.7)
            for k in range(3):
                mass = np.exp(fam.log_lik(family, np.arange(4000.0 if family == "negbinomial" else trials[k] + 1), eta[k], trials[k], 1.7))
                assert got[k] == np.searchsorted(np.cumsum(mass), min(u, 1 - 1e-12))
    big = compare._replicate("negbinomial", rng.uniform(size=20_000), np.full(20_000, np.log(5000.0)), np.ones(20_000), 2.0)
    assert abs(big.mean() - 5000) < 150 and abs(big.std() - np.sqrt(5000 + 5000**2 / 2)) < 150


def test_explained_variance_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    f = 1e6 + rng.normal(size=(500, 7))
    y = f[:, 0] + rng.normal(size=500)
    rows = [(float(y[k]) if k % 9 else None, f[k].tolist() if k % 11 else None) for k in range(500)]
    got = compare.bayes_r2(spark.createDataFrame(rows, "y double, fitted array<double>").repartition(6)).first()
    some, both = np.array([r[1] for r in rows if r[1]]), [r for r in rows if r[1] and r[0] is not None]
    vf = some.var(0, ddof=1)
    vr = (np.array([r[0] for r in both])[:, None] - np.array([r[1] for r in both])).var(0, ddof=1)
    assert got["n_draws"] == 7 and got["estimate"] == pytest.approx((vf / (vf + vr)).mean(), rel=1e-9)


def test_predictive_check_of_a_gaussian_fit(spark):
    f = m.fit(frame(spark, sample("gaussian", n=300)), Formula("y", ["x"], groups=("b",)), "gaussian", keep=["i"])
    rows = compare.ppc(f, "i", 5).collect()
    totals = {d: sum(r["n"] for r in rows if r["draw"] == d) for d in range(6)}
    assert set(totals.values()) == {300} and len({r["value"] for r in rows if r["draw"] == 0}) > 20
    mean = lambda d: sum(r["value"] * r["n"] for r in rows if r["draw"] == d) / 300
    assert all(abs(mean(d) - mean(0)) < 0.5 for d in range(1, 6))


def noise(spark, n=8000, levels=60, seed=4):
    """Rows whose levels differ by little more than chance, on one numeric column."""
    rng = np.random.default_rng(seed)
    x, code = rng.integers(-24, 26, n) / 10, rng.integers(0, levels, n)
    both = rng.normal(0, 0.12, levels)
    y = 5.3 + both[code] * (1 + 0.4 * x) + 3 * rng.normal(size=n)
    rows = [(float(a), float(b), f"g{c}") for a, b, c in zip(y, x, code, strict=True)]
    return spark.createDataFrame(rows, "y double, x double, g string").repartition(4), y, x, code


@pytest.mark.parametrize("dense", [1024, 0])
def test_weak_correlated_scales_settle_at_the_mode_from_one_scan(spark, monkeypatch, dense):
    """Steps by fixed points crept towards a correlation of one and did not settle."""
    monkeypatch.setattr(joint, "DENSE", dense)
    scans = []
    one_pass, step = joint.one_pass, m._step
    monkeypatch.setattr(joint, "one_pass", lambda *a: scans.append(1) or one_pass(*a))
    monkeypatch.setattr(m, "_step", lambda *a: scans.append(1) or step(*a))
    df, y, x, code = noise(spark)
    f = m.fit(df, Formula("y", ["x"], groups=("g",), slopes={"g": "x"}), "gaussian", m.Priors(b=0.5, intercept=1.0, intercept_df=None))
    assert f.converged and (f.joint is None) == (dense == 0) and len(scans) == (dense > 0)
    design, z = np.column_stack([np.ones(len(y)), x]), np.zeros((len(y), 120))
    z[np.arange(len(y)), 2 * code], z[np.arange(len(y)), 2 * code + 1] = 1, x
    place = np.array([1.0, x.mean()])
    penalty = np.diag([0, 4.0]) + np.outer(place, place)

    def density(cov, sigma):
        """Log marginal with the coefficients at their mode, or summed over as well, and the log prior of the scales."""
        full = np.hstack([design, z])
        prior = np.zeros((122, 122))
        prior[:2, :2], prior[2:, 2:] = penalty, np.kron(np.eye(60), np.linalg.inv(cov))
        h = full.T @ full / sigma**2 + prior
        t = np.linalg.solve(h, full.T @ y / sigma**2)
        log = -len(y) * np.log(sigma) - 0.5 * ((y - full @ t) ** 2).sum() / sigma**2 - 0.5 * t @ prior @ t - 30 * np.linalg.slogdet(cov)[1]
        log -= 0.5 * np.linalg.slogdet(h if dense else h[2:, 2:])[1]
        return log - np.sqrt(np.diag(cov)).sum() - sigma, t

    cov, sigma = f.group_cov["g"], f.shape
    best, t = density(cov, sigma)
    assert np.allclose(f.beta, t[:2], atol=1e-6)
    got = {(r["level"], r["coef"]): r["estimate"] for r in m.ranef(f, "g").collect()}
    assert all(got[f"g{k}", c] == pytest.approx(t[2 + 2 * k + i], abs=1e-6) for k in range(60) for i, c in enumerate(("Intercept", "x")))
    root = np.linalg.cholesky(cov)
    for i, j in ((0, 0), (1, 0), (1, 1)):
        for way in (0.9, 1.1):
            other = root.copy()
            other[i, j] *= way
            assert density(other @ other.T + 1e-12 * np.eye(2), sigma)[0] < best or np.linalg.eigvalsh(other @ other.T)[0] < 1e-5
    assert max(density(cov, sigma * way)[0] for way in (0.999, 1.001)) < best


def test_scans_read_for_the_last_time_are_deleted(spark, monkeypatch):
    import os

    monkeypatch.setattr(joint, "FEW", 10)
    stored, keep = [], joint.materialize
    monkeypatch.setattr(joint, "materialize", lambda df, name="table": stored.append((name, keep(df, name))) or stored[-1][1])
    tasks = [joint.Task(str(terms), Formula("y", terms, groups=("a", "b"))) for terms in (["x"], ["x", "z"])]
    fits = joint.fit_together(frame(spark, sample()), tasks, ["i"])
    left = [name for name, df in stored if os.path.exists(df.stored_at.removeprefix("file:"))]
    assert [name for name, _ in stored].count("step") > 4
    assert left.count("step") <= 1 and left.count("step") + left.count("settled") <= 2
    assert "design" not in left
    # What is left serves effects and draws of both models.
    for f in fits.values():
        assert f.effects["a"].count() == f.design.select("g_a").distinct().count()
        assert compare.loo(m.pointwise(f, "i", 20)).count() == f.design.count()


def test_draws_of_levels_are_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(joint, "FEW", 10)
    f = joint.fit_together(frame(spark, sample()), [joint.Task("m", Formula("y", ["x"], groups=("a", "b")))])["m"]
    rows, _ = joint.predictor_rows(f.joint, 50, 1)
    assert "ub" not in rows.columns
    wide = max(len(r["vals"]) + len(r["cols"]) + len(r["weights"]) for r in rows.collect())
    assert wide < 50


def test_elimination_goes_through_what_levels_meet():
    """40,000 levels that meet two of 1,000 columns each: the same products as of whole matrices, at a small part of their work."""
    import time

    rng = np.random.default_rng(3)
    n, size, p = 40_000, 1_000, 3
    row, col = np.repeat(np.arange(n), 2), np.sort(rng.integers(0, size // 2, (n, 2)) + [0, size // 2], axis=1).ravel()
    weights, x, stiff = rng.uniform(0.1, 1, 2 * n), rng.normal(size=(n, p)), rng.uniform(1, 2, n)
    layout = joint.Layout(("x0", "x1", "x2"), (joint.Factor("b", tuple(map(str, range(size))), 0),), "a", n)
    model = joint.Model("m", Formula("y", []), "bernoulli", m.Priors(), np.arange(p), np.zeros(p), np.zeros(p), np.zeros(size), {}, 1.0, lam=0.5)
    main = np.column_stack([stiff - 0.5, rng.normal(size=n), x])
    kinds, names = np.full(3 * n, joint.LEVELS, np.int32), np.concatenate([np.arange(n), row])
    order = np.argsort(names, kind="stable")
    vals = [*main.tolist(), *weights[:, None].tolist()]
    lines = joint.pa.RecordBatch.from_arrays(
        [joint.pa.array(kinds), joint.pa.array([f"{k:06d}" for k in names[order]]), joint.pa.array(np.concatenate([np.full(n, -1), col]).astype(np.int32)[order]),
         joint.pa.array([vals[i] for i in order], joint.pa.list_(joint.pa.float64())), joint.pa.array([[0.0] if i < n else None for i in order], joint.pa.list_(joint.pa.float64())), joint.pa.nulls(3 * n, joint.pa.binary())],
        names=["kind", "level", "pos", "vals", "u", "data"],
    )
    begun = time.process_time()
    out = list(joint.gather_levels(layout, [model], 1)([lines]))
    assert time.process_time() - begun < 1.5
    sums = {(r["kind"], int(r["level"]), r["pos"]): np.frombuffer(r["data"]) for r in out[-1].to_pylist()}
    dense = np.zeros((n, p + size))
    dense[:, :p], dense[row, p + col] = x, weights
    for kind, power, v in ((joint.CROSS, 1, main[:, 1]), (joint.SQUARES, 2, main[:, 1] / stiff)):
        a, b, _ = joint._system(sums, kind, 0, p + size)
        assert np.allclose(a, dense.T @ (dense / stiff[:, None] ** power), atol=1e-9)
        assert np.allclose(b, (dense / stiff[:, None]).T @ v, atol=1e-9)
