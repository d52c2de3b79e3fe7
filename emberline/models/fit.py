"""Posterior mode and curvature of hierarchical regressions.

The fixed effects and one grouping factor are solved together, exactly, per
step; the other factors wait as an offset, and the steps go round the factors.
A step is one pass over the rows. Each Arrow batch is reduced to its cross
products and to one line per group level, Spark sums those by level, and the
group block is eliminated level by level, so the driver sees sums of size p by p
and group effects stay tables. A level with a third of all rows is one short line
per batch before the shuffle.

The result is a mode with a normal approximation around it. It is not a sampled
posterior: intervals of weakly identified scales will differ from sampling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import Z975
from ..operators.encode import Formula, design_matrix, term_columns
from ..session import discard, materialize
from . import family as fam
from .special import normal

LEVEL, GRAM, SCALARS, MOVED = 0, 1, 2, 3
#: Smallest scale of group effects and residuals, as a part of the response's own.
SMALLEST_SCALE = 1e-3
#: Places of the scales that may be tried for one cycle over the rows, where sums of one scan are enough to judge them.
POINTS = 10


@dataclass(frozen=True)
class Priors:
    """Normal slopes; Student t (3 df) or normal intercept at the predictor means;
    exponential(rate) group sd, shape and residual sd."""

    b: float = 1.5
    intercept: float = 2.5
    intercept_df: float | None = 3.0
    sd: float = 1.0
    shape: float = 1.0
    sigma: float = 1.0


@dataclass
class Fit:
    formula: Formula
    family: str
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    shape: float
    group_cov: dict[str, np.ndarray]
    effects: dict[str, DataFrame]
    design: DataFrame
    gradient: float
    steps: int
    converged: bool
    history: list[float] = field(default_factory=list)
    trace: dict[str, list[np.ndarray]] = field(default_factory=dict)
    stored: dict[str | None, str] = field(default_factory=dict)
    #: Of a fit with a joint curvature: what draws need.
    joint: object = None


def fit(
    df: DataFrame,
    formula: Formula,
    family: str = "bernoulli",
    priors: Priors | None = None,
    keep: Sequence[str] = (),
    max_cycles: int = 60,
    tol: float = 1e-6,
    scale_tol: float = 1e-4,
    strict: bool = True,
    scales: Mapping[str, np.ndarray] | None = None,
    shape: float | None = None,
) -> Fit:
    """Fit ``formula`` to ``df``. ``keep`` columns stay in the stored design.

    Stops when no coefficient moves by ``tol`` and no scale by a factor of more
    than 1 + ``scale_tol``. A fit that has not settled after ``max_cycles`` is an
    error, or with ``strict`` off a result whose ``converged`` is false. Given
    ``scales`` (the covariance of each group's effects) and ``shape`` are held.

    All effects move together (``joint``). Only where two factors have more
    levels than one system holds do the steps go round the factors, and the
    standard errors leave out the other factors' part. A gaussian model with one
    factor of that many levels is settled from one scan.
    """
    from . import joint

    task = joint.Task("model", formula, family, priors or Priors(), scales, shape)
    try:
        return joint.fit_together(df, [task], keep, max_cycles, tol, scale_tol, strict)["model"]
    except joint.TooManyLevels:
        if scales is not None:
            raise
        return fit_in_turn(df, formula, family, priors, keep, max_cycles, tol, scale_tol, strict)


def fit_in_turn(
    df: DataFrame, formula: Formula, family: str, priors: Priors | None = None, keep: Sequence[str] = (),
    max_cycles: int = 60, tol: float = 1e-6, scale_tol: float = 1e-4, strict: bool = True,
) -> Fit:
    """``fit`` with steps that go round the factors, each of which may have any number of levels."""
    fam.check_family(family)
    priors = priors or Priors()
    terms = [n for n, _ in term_columns(formula)]
    design = materialize(design_matrix(df, formula, keep), "design")
    p = len(terms)
    means = design.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(p)],
                       F.avg("y").alias("ybar"), F.stddev_samp("y").alias("ysd"),
                       F.avg("trials").alias("tbar")).first()
    if means["ybar"] is None:
        raise ValueError("the design has no complete rows")
    center = np.array([means[f"m{i}"] for i in range(p)])
    state = Fit(
        formula=formula, family=family, terms=terms, beta=np.zeros(p), cov=np.eye(p),
        shape=float(means["ysd"] or 1.0) if family == "gaussian" else 1.0,
        group_cov={g: np.eye(_width(formula, g)) for g in formula.groups},
        effects={}, design=design, gradient=np.inf, steps=0, converged=False,
    )
    state.beta[0] = _start(family, means)
    factors = list(formula.groups) or [None]
    if family == "gaussian" and len(formula.groups) == 1:
        state.history, state.converged = _by_levels(state, factors[0], priors, center, float(means["ysd"] or 1.0), max_cycles, tol, scale_tol)
        max_cycles = 0
    for _ in range(max_cycles):
        moves = [_step(state, g, priors, center) for g in factors]
        state.history.append(max(m for m, _ in moves))
        if all(m < tol and s < scale_tol for m, s in moves):
            state.converged = True
            break
    if strict and not state.converged:
        raise RuntimeError(f"{formula.response} did not settle in {len(state.history)} cycles; last move {state.history[-1]:.3g}")
    return state


def _start(family: str, means) -> float:
    if family in ("bernoulli", "binomial"):
        share = min(max(means["ybar"] / means["tbar"], 1e-3), 1 - 1e-3)
        return float(np.log(share / (1 - share)))
    if family == "gaussian":
        return float(means["ybar"])
    return float(np.log(max(means["ybar"], 1e-3)))


def _width(formula: Formula, group: str | None) -> int:
    if group is None:
        return 0
    return 2 if group in formula.slopes else 1


def _slope_index(formula: Formula, terms: list[str], group: str | None) -> int | None:
    if group is None or group not in formula.slopes:
        return None
    return terms.index(formula.slopes[group])


def with_effects(design: DataFrame, state: Fit) -> DataFrame:
    """Rows with ``re``, the sum of their group effects.

    Effects are one row per level, joined without a hint: adaptive execution
    broadcasts a small table after measuring it and splits a skewed join.
    """
    total = F.lit(0.0)
    levels, spreads = [], []
    for g, table in state.effects.items():
        effect = table.select(F.col("level").alias(f"g_{g}"), F.col("u").alias(f"u_{g}"), F.col("se").alias(f"se_{g}"))
        design = design.join(effect, f"g_{g}", "left")
        u = F.col(f"u_{g}")
        levels.append(F.xxhash64(F.lit(g), F.col(f"g_{g}")))
        spreads += [F.coalesce(F.col(f"se_{g}")[i], F.lit(0.0)) for i in range(_width(state.formula, g))]
        total = total + F.coalesce(u[0], F.lit(0.0))
        at = _slope_index(state.formula, state.terms, g)
        if at is not None:
            total = total + F.coalesce(u[1], F.lit(0.0)) * F.col("x")[at]
    # Keys and standard errors of the row's effects, for draws of them.
    listed = lambda cols, kind: F.array(*cols).cast(kind) if cols else F.array().cast(kind)
    return design.withColumns(
        {"re": total, "levels": listed(levels, "array<bigint>"), "spreads": listed(spreads, "array<double>")}
    )


def effect_slopes(state: Fit) -> list[int | None]:
    """For each group effect of a row the column of ``x`` it multiplies, None for an intercept."""
    out = []
    for g in state.effects:
        out += [None] if _width(state.formula, g) == 1 else [None, _slope_index(state.formula, state.terms, g)]
    return out


def effect_noise(batch: pa.RecordBatch, x: np.ndarray, slopes: list[int | None], draw: int, seed: int) -> np.ndarray:
    """What one draw of the group effects adds to their mode: normal with the effect's
    standard error, the same for all rows of a level, on every retry and in any batch."""
    out = np.zeros(len(x))
    if not slopes:
        return out
    get = lambda name: batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    spreads = get("spreads").reshape(len(x), -1)
    levels = get("levels").reshape(len(x), -1)
    group = -1
    for i, at in enumerate(slopes):
        group += at is None
        z = normal(levels[:, group] + (i << 20), draw, seed) * spreads[:, i]
        out += z if at is None else z * x[:, at]
    return out


def batch_arrays(batch: pa.RecordBatch, p: int):
    """y, x, linear offset and trials of a batch."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    x = get("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
    fixed = get("offset").to_numpy(zero_copy_only=False) + get("re").to_numpy(zero_copy_only=False)
    y = get("y").to_numpy(zero_copy_only=False)
    return y, x, fixed, get("trials").to_numpy(zero_copy_only=False)


def _step(state: Fit, group: str | None, priors: Priors, center: np.ndarray) -> tuple[float, float]:
    """One exact Newton step in the fixed effects and the effects of ``group``."""
    p, q = len(state.terms), _width(state.formula, group)
    at = _slope_index(state.formula, state.terms, group)
    beta, shape, family = state.beta.copy(), state.shape, state.family
    width = max(p + 1, q * q + q + q * p, 4)
    names = [f"c{i}" for i in range(width)]
    out_type = pa.schema(
        [("kind", pa.int32()), ("level", pa.string())] + [(n, pa.float64()) for n in names]
    )

    def pack(kind, levels, values) -> pa.RecordBatch:
        values = np.asarray(values, dtype=float)
        full = np.zeros((len(levels), width))
        full[:, : values.shape[1]] = values
        cols = [pa.array(np.full(len(levels), kind, dtype=np.int32)), pa.array(levels, pa.string())]
        return pa.RecordBatch.from_arrays(cols + [pa.array(full[:, i]) for i in range(width)], schema=out_type)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, x, fixed, trials = batch_arrays(batch, p)
            eta = x @ beta + fixed
            g, w = fam.score(family, y, eta, trials, shape)
            wx = x * w[:, None]
            yield pack(GRAM, [str(i) for i in range(p)], np.column_stack([x.T @ wx, x.T @ g]))
            s1, s2 = fam.shape_terms(family, y, eta, trials, shape)
            ll = fam.log_lik(family, y, eta, trials, shape).sum()
            yield pack(SCALARS, [""], [[len(y), ll, s1, s2]])
            if q:
                coded = batch.column(batch.schema.get_field_index("level")).dictionary_encode()
                code, n = coded.indices.to_numpy(), len(coded.dictionary)
                zs = np.ones((len(y), 1)) if at is None else np.column_stack([np.ones(len(y)), x[:, at]])
                parts = [zs[:, a] * zs[:, b] * w for a in range(q) for b in range(q)]
                parts += [zs[:, a] * g for a in range(q)]
                parts += [zs[:, a] * wx[:, j] for a in range(q) for j in range(p)]
                sums = np.column_stack([np.bincount(code, v, n) for v in parts])
                yield pack(LEVEL, coded.dictionary.to_pylist(), sums)

    rows = with_effects(state.design, state)
    level = F.col(f"g_{group}") if group else F.lit(None).cast("string")
    rows = rows.select("y", "x", "offset", "re", "trials", level.alias("level"))
    ddl = "kind int, level string, " + ", ".join(f"{n} double" for n in names)
    summed = rows.mapInArrow(reduce_rows, ddl).groupBy("kind", "level").agg(
        *[F.sum(n).alias(n) for n in names]
    )
    if group in state.effects:
        old = state.effects[group].select("level", F.lit(LEVEL).alias("kind"), "u")
        summed = summed.join(old, ["kind", "level"], "left")
    else:
        summed = summed.withColumn("u", F.lit(None).cast("array<double>"))
    summed = materialize(summed, "step")
    # The step before this one was read for the last time.
    if group in state.stored:
        discard(state.design.sparkSession, state.stored[group])
    state.stored[group] = summed.stored_at

    precision = np.linalg.inv(state.group_cov[group]) if q else np.zeros((0, 0))

    def blocks(batch: pa.RecordBatch):
        """Curvature, gradient, cross block and old effects of the level lines."""
        c = np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names])
        u = batch.column(batch.schema.get_field_index("u")).to_pylist()
        u = np.array([v if v is not None else [0.0] * q for v in u], dtype=float).reshape(-1, q)
        raw = c[:, : q * q].reshape(-1, q, q)
        grad = c[:, q * q : q * q + q] - u @ precision
        cross = c[:, q * q + q : q * q + q + q * p].reshape(-1, q, p)
        return raw, np.linalg.inv(raw + precision), grad, cross, u

    sums_width = max(p + 1, 2 * q * q + 2, 4)
    sum_names = [f"s{i}" for i in range(sums_width)]
    sum_type = pa.schema([("kind", pa.int32()), ("i", pa.int32())] + [(n, pa.float64()) for n in sum_names])

    def eliminate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(batch.schema.get_field_index("kind")).to_numpy()
            out = []
            for kind in (GRAM, SCALARS):
                part = batch.filter(pa.array(kinds == kind))
                for row in part.to_pylist():
                    out.append((kind, int(row["level"] or 0), [row[f"c{j}"] for j in range(min(width, sums_width))]))
            part = batch.filter(pa.array(kinds == LEVEL))
            if q and part.num_rows:
                raw, inv, grad, cross, u = blocks(part)
                hb = np.einsum("lab,lbp->lap", inv, cross)
                schur = np.einsum("laj,lak->jk", cross, hb)
                shift = np.einsum("laj,la->j", hb, grad)
                for j in range(p):
                    out.append((GRAM, j, [*(-schur[j]), -shift[j]]))
                fitted = float(np.einsum("lab,lba->", inv, raw))
                # The new effects are start - hb @ delta, so their squares follow
                # from these sums once delta is known.
                start = u + np.einsum("lab,lb->la", inv, grad)
                effects, spreads = np.einsum("la,lb->ab", start, start), inv.sum(axis=0)
                out.append((LEVEL, 0, [*effects.ravel(), *spreads.ravel(), len(u), fitted]))
                for a in range(q):
                    for b in range(q):
                        line = (a * q + b) * (p + 1)
                        out.append((MOVED, line, list(start[:, a] @ hb[:, b, :])))
                        square = hb[:, a, :].T @ hb[:, b, :]
                        out += [(MOVED, line + 1 + j, list(square[j])) for j in range(p)]
            if out:
                full = np.zeros((len(out), sums_width))
                for i, (_, _, values) in enumerate(out):
                    full[i, : len(values)] = values
                cols = [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(full[:, i]) for i in range(sums_width)], schema=sum_type)

    ddl = "kind int, i int, " + ", ".join(f"{n} double" for n in sum_names)
    # A number of rows that depends on p and q alone.
    reduced = summed.mapInArrow(eliminate, ddl).groupBy("kind", "i").agg(*[F.sum(n).alias(n) for n in sum_names]).collect()
    gram, rhs, scalars, second = np.zeros((p, p)), np.zeros(p), None, None
    moved = np.zeros((q * q * (p + 1), p))
    for row in reduced:
        v = np.array([row[n] for n in sum_names])
        if row["kind"] == GRAM:
            gram[row["i"]], rhs[row["i"]] = v[:p], v[p]
        elif row["kind"] == SCALARS:
            scalars = v
        elif row["kind"] == MOVED:
            moved[row["i"]] = v[:p]
        else:
            second = v

    # Priors: ridge on the slopes; the intercept's prior acts at the predictor means.
    penalty = np.diag([0.0] + [1.0 / priors.b**2] * (p - 1))
    direction = center.copy()
    direction[0] = 1.0
    at_mean = float(direction @ beta)
    weight = 1.0 / priors.intercept**2
    if priors.intercept_df is not None:
        nu = priors.intercept_df
        weight = (nu + 1) / (nu * priors.intercept**2 + at_mean**2)
    penalty = penalty + weight * np.outer(direction, direction)
    gram, rhs = gram + penalty, rhs - penalty @ beta
    delta = np.linalg.solve(gram, rhs)
    limit = 5.0 * max(1.0, shape if family == "gaussian" else 1.0)
    biggest = float(np.abs(delta).max())
    if biggest > limit:
        delta = delta * (limit / biggest)

    if q:
        for a in range(q):
            for b in range(q):
                lines = moved[(a * q + b) * (p + 1) : (a * q + b + 1) * (p + 1)]
                mirror = moved[(b * q + a) * (p + 1)]
                second[a * q + b] += delta @ lines[1:] @ delta - lines[0] @ delta - mirror @ delta

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                _, inv, grad, cross, u = blocks(batch)
                new = u + np.einsum("lab,lb->la", inv, grad - cross @ delta)
                spread = np.sqrt(np.einsum("laa->la", inv))
                level = batch.column(batch.schema.get_field_index("level"))
                yield pa.RecordBatch.from_arrays(
                    [level, pa.array(new.tolist(), pa.list_(pa.float64())), pa.array(spread.tolist(), pa.list_(pa.float64()))],
                    names=["level", "u", "se"],
                )

        state.effects[group] = summed.filter(F.col("kind") == LEVEL).mapInArrow(
            update, "level string, u array<double>, se array<double>"
        )

    change = float(np.abs(delta).max())
    scale_change = _update_scales(state, group, priors, q, scalars, second)
    state.beta = beta + delta
    state.cov = np.linalg.inv(gram)
    state.gradient = float(np.abs(rhs).max() / scalars[0])
    state.steps += 1
    return change, scale_change


def _by_levels(state: Fit, group: str, priors: Priors, center: np.ndarray, unit: float, max_cycles: int, tol: float, scale_tol: float) -> tuple[list[float], bool]:
    """The mode of a gaussian model with one factor from a single scan.

    Its cross products by level do not change from place to place, so they are stored, one line per
    level, and every place of the scales is judged by a pass over these lines.
    """
    p, q = len(state.terms), _width(state.formula, group)
    at, origin = _slope_index(state.formula, state.terms, group), state.beta.copy()
    width = p + 1

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            x = get("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            off = get("y").to_numpy(zero_copy_only=False) - get("offset").to_numpy(zero_copy_only=False) - x @ origin
            coded = get("level").dictionary_encode()
            code, n = coded.indices.to_numpy(), len(coded.dictionary)
            zs = [np.ones(len(x))] if at is None else [np.ones(len(x)), x[:, at]]
            columns = [*zs, off, *x.T]
            # Products of effects, residual and fixed columns, the lower half of each level's square.
            parts = [np.bincount(code, columns[a] * columns[b], n) for a in range(len(columns)) for b in range(a + 1)]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *[pa.array(v) for v in parts]], names=["level", *names])

    size = q + width
    names = [f"c{i}" for i in range(size * (size + 1) // 2)]
    rows = state.design.select("y", "x", "offset", F.col(f"g_{group}").alias("level"))
    lines = rows.mapInArrow(reduce_rows, "level string, " + ", ".join(f"{n} double" for n in names))
    lines = materialize(lines.groupBy("level").agg(*[F.sum(n).alias(n) for n in names]), "levels")
    total = lines.agg(*[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("levels")).first()
    levels, half = int(total["levels"]), np.tril_indices(size)

    def squares(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), size, size))
        out[:, half[0], half[1]] = values
        out[:, half[1], half[0]] = values
        return out

    whole = squares(np.array([[total[n] for n in names]]))[0][q:, q:]
    gram0, right0, rss0, count = whole[1:, 1:], whole[1:, 0], float(whole[0, 0]), float(total["c0"])

    def solved(batch: pa.RecordBatch, precision: np.ndarray, shape: float):
        """Own curvature, its inverse with the prior, and the products with residual and fixed columns, of each level."""
        own = squares(np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]))
        inv = np.linalg.inv(own[:, :q, :q] / shape**2 + precision)
        return own[:, :q, :q], inv, own[:, :q, q:] / shape**2

    def add(cov: np.ndarray, shape: float) -> dict[str, np.ndarray]:
        """Sums over the levels that a place of the scales needs."""
        precision = np.linalg.inv(cov)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(3 * width * width + (q * width) ** 2 + q * q + 2)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                own, inv, cross = solved(batch, precision, shape)
                moved = np.einsum("lab,lbj->laj", inv, cross)
                sums += np.concatenate([
                    np.einsum("laj,lak->jk", cross, moved).ravel(),
                    np.einsum("laj,lab,lbk->jk", moved, own, moved, optimize=True).ravel(),
                    np.einsum("laj,ab,lbk->jk", moved, precision, moved, optimize=True).ravel(),
                    np.einsum("laj,lbk->ajbk", moved, moved).ravel(),
                    inv.sum(0).ravel(),
                    [np.einsum("lab,lba->", inv, own), -np.linalg.slogdet(inv)[1].sum()],
                ])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["v"])

        # One short line per partition.
        parts = [r["v"] for r in lines.mapInArrow(run, "v array<double>").collect()]
        cut = np.cumsum([width * width] * 3 + [(q * width) ** 2, q * q])
        cross, own, prior, both, inverse, rest = np.split(np.sum(parts, axis=0), cut)
        square = lambda v: v.reshape(width, width)
        return {"cross": square(cross), "own": square(own), "prior": square(prior), "both": both.reshape(q, width, q, width), "inverse": inverse.reshape(q, q), "used": rest[0], "log": rest[1]}

    direction = center.copy()
    direction[0] = 1.0
    roots = Roots((group,), (q,), SMALLEST_SCALE)

    def height(place):
        _, covs, shape = roots.read(place)
        cov = covs[group]
        s = add(cov, shape)
        # An intercept with a t prior has a weight that goes with it.
        for _ in range(20):
            mean = float(direction @ state.beta)
            weight = 1.0 / priors.intercept**2
            if priors.intercept_df is not None:
                weight = (priors.intercept_df + 1) / (priors.intercept_df * priors.intercept**2 + mean**2)
            penalty = np.diag([0.0] + [1.0 / priors.b**2] * (p - 1)) + weight * np.outer(direction, direction)
            system = gram0 / shape**2 - s["cross"][1:, 1:] + penalty
            rhs = right0 / shape**2 - s["cross"][1:, 0] - penalty @ origin
            before, state.beta = state.beta, origin + np.linalg.solve(system, rhs)
            if priors.intercept_df is None or np.abs(state.beta - before).max() < 1e-3 * tol:
                break
        delta = state.beta - origin
        e = np.concatenate([[1.0], -delta])
        # Squared residuals: the effects of a level are its moved products times e.
        squared = rss0 - 2 * delta @ right0 + delta @ gram0 @ delta - 2 * shape**2 * e @ s["cross"] @ e + e @ s["own"] @ e
        mean = float(direction @ state.beta)
        log = -0.5 * float((state.beta[1:] ** 2).sum()) / priors.b**2
        if priors.intercept_df is None:
            log -= 0.5 * mean**2 / priors.intercept**2
        else:
            log -= 0.5 * (priors.intercept_df + 1) * np.log1p(mean**2 / (priors.intercept_df * priors.intercept**2))
        log -= count * (0.5 * np.log(2 * np.pi) + np.log(shape)) + 0.5 * squared / shape**2
        log -= 0.5 * float(e @ s["prior"] @ e) + 0.5 * levels * float(np.linalg.slogdet(cov)[1]) + 0.5 * s["log"]
        products = np.einsum("j,ajbk,k->ab", e, s["both"], e) + s["inverse"]
        prior, slope = roots.slope(place, {group: (levels, products)}, (squared + s["used"]) / shape**2 - count, priors)
        state.shape, state.group_cov[group], state.cov, state.steps = shape, cov, np.linalg.inv(system), state.steps + 1
        state.gradient = float(np.abs(rhs - system @ delta).max() / count)
        return log + prior, slope, state.beta.copy()

    history, done = climb(height, roots, roots.start(0.1 * unit, state.shape), POINTS * max_cycles, tol, scale_tol)
    precision, shape, e = np.linalg.inv(state.group_cov[group]), state.shape, np.concatenate([[1.0], origin - state.beta])

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, inv, cross = solved(batch, precision, shape)
            u, se = np.einsum("lab,lbj,j->la", inv, cross, e), np.sqrt(np.einsum("laa->la", inv))
            level = batch.column(batch.schema.get_field_index("level"))
            yield pa.RecordBatch.from_arrays([level, *[pa.array(v.tolist(), pa.list_(pa.float64())) for v in (u, se)]], names=["level", "u", "se"])

    state.effects[group] = lines.mapInArrow(effects, "level string, u array<double>, se array<double>")
    return history, done


def _scale_mode(n: float, squares: float, rate: float, floor: float = SMALLEST_SCALE) -> float:
    """Mode of a scale with n log-densities: root of rate s^3 + n s^2 = squares."""
    # In units of the size of the answer, so that the smallest scales keep their digits.
    unit = max(np.sqrt(squares / max(n, 1e-8)), 1e-300)
    roots = np.roots([rate * unit**3, n * unit**2, 0.0, -squares])
    real = roots[np.abs(roots.imag) < 1e-9].real
    return float(max(real.max() * unit, floor))


def _extrapolate(trace: list[np.ndarray], sd: np.ndarray, floor: float = SMALLEST_SCALE) -> np.ndarray:
    """Every third update jumps to the limit a geometric approach points at (Aitken)."""
    trace.append(np.log(sd))
    if len(trace) < 3:
        return sd
    a, b, c = trace[-3:]
    trace.clear()
    first, last = b - a, c - b
    ratio = np.divide(last, first, out=np.zeros_like(last), where=np.abs(first) > 1e-12)
    ratio = np.clip(ratio, -0.9, 0.98)
    jump = np.clip(last * ratio / (1 - ratio), -2.0, 2.0)
    return np.maximum(np.exp(c + jump), floor)


@dataclass(frozen=True)
class Roots:
    """Covariances of group effects and the residual scale as free numbers.

    A covariance is ``root @ root.T`` plus the smallest scale squared, so it is sound at
    any root, and a correlation of one or a scale of none is a place like any other.
    """

    groups: tuple[str, ...]
    widths: tuple[int, ...]
    floor: float

    def start(self, sd: float, sigma: float) -> np.ndarray:
        return np.concatenate([*[(sd * np.eye(w))[np.tril_indices(w)] for w in self.widths], [np.log(sigma)]])

    def read(self, at: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], float]:
        """Roots and covariances by group, and the residual scale."""
        roots, begin = {}, 0
        for g, w in zip(self.groups, self.widths, strict=True):
            roots[g] = np.zeros((w, w))
            n = w * (w + 1) // 2
            roots[g][np.tril_indices(w)] = at[begin : begin + n]
            begin += n
        return roots, {g: r @ r.T + self.floor**2 * np.eye(len(r)) for g, r in roots.items()}, float(np.exp(at[-1]))

    def slope(self, at: np.ndarray, moments: Mapping[str, tuple[float, np.ndarray]], sigma: float, priors: Priors) -> tuple[float, np.ndarray]:
        """Log prior of the scales, and the slope of the log density. ``moments`` are the levels of each
        group and the expected products of their effects, ``sigma`` the slope of the log likelihood in the log residual scale."""
        roots, covs, shape = self.read(at)
        out, prior = [], -priors.sigma * shape
        for g, w in zip(self.groups, self.widths, strict=True):
            levels, products = moments[g]
            precision, sd = np.linalg.inv(covs[g]), np.sqrt(np.diag(covs[g]))
            bend = 0.5 * (precision @ products @ precision - levels * precision) - np.diag(0.5 * priors.sd / sd)
            prior -= priors.sd * float(sd.sum())
            out.append((2 * bend @ roots[g])[np.tril_indices(w)])
        return prior, np.concatenate([*out, [sigma - priors.sigma * shape]])

    def seen(self, at: np.ndarray) -> np.ndarray:
        """Log scales and bent correlations."""
        _, covs, shape = self.read(at)
        out = [np.log([shape])]
        for c in covs.values():
            sd = np.sqrt(np.diag(c))
            out += [np.log(sd), np.arctanh(np.clip((c / np.outer(sd, sd))[np.triu_indices(len(c), 1)], -0.999, 0.999))]
        return np.concatenate(out)


def climb(height: Callable, roots: Roots, at: np.ndarray, most: int, tol: float, scale_tol: float) -> tuple[list[float], bool]:
    """To the mode of the scales by quasi-Newton steps (BFGS); the moves of the coefficients, and whether the last one settled.

    ``height`` gives log density, slope and coefficients at a point, and leaves the fit there.
    """
    value, slope, beta = height(at)
    bend, history, fresh = np.eye(len(at)) / max(1.0, np.abs(slope).max()), [np.inf], True
    while len(history) < most:
        way = bend @ slope
        # Roots grow or shrink by half of the largest at most, so that none jumps past zero to its mirror image.
        way *= min(1.0, 0.5 * np.abs(at[:-1]).max() / max(np.abs(way[:-1]).max(), 1e-300), 1.0 / max(abs(way[-1]), 1e-300))
        gain, part = float(slope @ way), 1.0
        while len(history) < most:
            new = at + part * way
            got, turned, moved = height(new)
            history.append(float(np.abs(moved - beta).max()))
            if got >= value + 1e-4 * part * gain - 1e-12 * abs(value):
                break
            part *= 0.3
        else:
            break
        change = float(np.abs(roots.seen(new) - roots.seen(at)).max())
        s, y = new - at, slope - turned
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            if fresh:
                bend, fresh = np.eye(len(at)) * (s @ y) / (y @ y), False
            keep = np.eye(len(at)) - np.outer(s, y) / (s @ y)
            bend = keep @ bend @ keep.T + np.outer(s, s) / (s @ y)
        at, value, slope, beta = new, got, turned, moved
        if history[-1] < tol and change < scale_tol and part == 1.0 and gain < 1e-6:
            return history, True
    return history, False


def _update_scales(state, group, priors, q, scalars, second) -> float:
    """Fixed-point updates with the effective number of parameters (MacKay 1992),
    which settle in fewer passes than expectation-maximisation."""
    n, _, s1, s2 = scalars[:4]
    change = 0.0
    if q:
        effects, spreads = second[: q * q].reshape(q, q), second[q * q : 2 * q * q].reshape(q, q)
        levels, old = second[2 * q * q], np.sqrt(np.diag(state.group_cov[group]))
        determined = np.maximum(levels - np.diag(spreads) / old**2, 1e-8)
        sd = np.array([_scale_mode(determined[a], effects[a, a], priors.sd) for a in range(q)])
        moments = effects + spreads
        raw_sd = np.sqrt(np.diag(moments))
        change = float(np.abs(np.log(sd / old)).max())
        sd = _extrapolate(state.trace.setdefault(group, []), sd)
        state.group_cov[group] = moments / np.outer(raw_sd, raw_sd) * np.outer(sd, sd)
    if state.family == "negbinomial":
        phi = state.shape
        slope = phi * (s1 - priors.shape)
        bend = phi**2 * s2 + slope
        move = -slope / bend if bend < 0 else np.sign(slope) * 0.5
        move = float(np.clip(move, -1.0, 1.0))
        state.shape = float(phi * np.exp(move))
        change = max(change, abs(move))
    elif state.family == "gaussian":
        new = _scale_mode(n - (second[2 * q * q + 1] if q else 0.0), s1, priors.sigma)
        change = max(change, abs(new - state.shape) / state.shape)
        state.shape = new
    return change


# Result tables ---------------------------------------------------------------


def coef_table(state: Fit) -> DataFrame:
    """Term, estimate, standard error and 95 % interval, one row per term."""
    se = np.sqrt(np.diag(state.cov))
    rows = [
        (t, float(b), float(s), float(b - Z975 * s), float(b + Z975 * s))
        for t, b, s in zip(state.terms, state.beta, se, strict=True)
    ]
    schema = "term string, estimate double, se double, lower double, upper double"
    return state.design.sparkSession.createDataFrame(rows, schema)


def scale_table(state: Fit) -> DataFrame:
    """Group standard deviations and correlations, shape or residual sd."""
    rows = []
    for g, cov in state.group_cov.items():
        names = ["Intercept"] + ([state.formula.slopes[g]] if len(cov) > 1 else [])
        sd = np.sqrt(np.diag(cov))
        rows += [(f"sd({g}:{n})", float(s)) for n, s in zip(names, sd, strict=True)]
        if len(cov) > 1:
            rows.append((f"cor({g})", float(cov[0, 1] / (sd[0] * sd[1]))))
    if state.family == "negbinomial":
        rows.append(("shape", state.shape))
    if state.family == "gaussian":
        rows.append(("sigma", state.shape))
    rows += [("gradient", state.gradient), ("steps", float(state.steps)), ("converged", float(state.converged))]
    return state.design.sparkSession.createDataFrame(rows, "name string, value double")


def ranef(state: Fit, factor: str) -> DataFrame:
    """Effects of every level of a factor with their standard errors."""
    if factor not in state.effects:
        raise ValueError(f"{factor!r} is not a grouping factor of this fit")
    names = ["Intercept"] + ([state.formula.slopes[factor]] if factor in state.formula.slopes else [])
    table = state.effects[factor]
    entries = [
        F.struct(F.lit(n).alias("coef"), F.col("u")[i].alias("estimate"), F.col("se")[i].alias("se"))
        for i, n in enumerate(names)
    ]
    return table.select(F.lit(factor).alias("factor"), "level", F.inline(F.array(*entries)))


def draw_betas(state: Fit, n: int, seed: int = 123) -> np.ndarray:
    """n draws of the fixed effects from the normal approximation."""
    if state.joint is not None:
        from .joint import draws_of

        return draws_of(state.joint, n, seed)[:, : len(state.beta)]
    rng = np.random.default_rng(seed)
    root = np.linalg.cholesky((state.cov + state.cov.T) / 2 + 1e-12 * np.eye(len(state.beta)))
    return state.beta + rng.standard_normal((n, len(state.beta))) @ root.T


def draws_table(state: Fit, n: int, seed: int = 123) -> DataFrame:
    """The draws in long form: (draw, term, value)."""
    betas = draw_betas(state, n, seed)
    rows = [(d + 1, t, float(v)) for d, b in enumerate(betas) for t, v in zip(state.terms, b, strict=True)]
    return state.design.sparkSession.createDataFrame(rows, "draw int, term string, value double")


def predictors(state: Fit, n_draws: int, seed: int, *columns) -> tuple[DataFrame, Callable[[pa.RecordBatch], np.ndarray]]:
    """Rows with ``columns``, y, offset and trials, and a function from their batches to the linear predictor of each draw.

    A joint fit draws all effects together. Otherwise each group effect is drawn
    from its own normal approximation.
    """
    if state.joint is not None:
        from .joint import predictor_rows

        return predictor_rows(state.joint, n_draws, seed, *columns)
    betas, p, slopes = draw_betas(state, n_draws, seed), len(state.terms), effect_slopes(state)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        _, x, fixed, _ = batch_arrays(batch, p)
        eta = x @ betas.T + fixed[:, None]
        for d in range(n_draws):
            eta[:, d] += effect_noise(batch, x, slopes, d + 1, seed)
        return eta

    rows = with_effects(state.design, state)
    return rows.select(*columns, "y", "x", "offset", "re", "trials", "levels", "spreads"), of


def pointwise(state: Fit, obs_id: str, n_draws: int = 200, seed: int = 123) -> DataFrame:
    """Per row: the id, log likelihood per draw, expected response per draw, and y.

    Draws stay in one array per row; rows are never multiplied by draws.
    """
    family, shape = state.family, state.shape
    rows, of = predictors(state, n_draws, seed, F.col(obs_id).cast("string").alias("obs"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            y, trials, eta = get("y").to_numpy(zero_copy_only=False), get("trials").to_numpy(zero_copy_only=False), of(batch)
            ll = fam.log_lik(family, y[:, None], eta, trials[:, None], shape)
            mu = fam.mean(family, eta, trials[:, None])
            as_list = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([get("obs"), as_list(ll), as_list(mu), pa.array(y)], names=["obs", "loglik", "fitted", "y"])

    return rows.mapInArrow(score, "obs string, loglik array<double>, fitted array<double>, y double")
