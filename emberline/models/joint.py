"""Hierarchical regressions with crossed factors, several of them on one table at a time.

All fixed effects and group effects of a model move together, by Newton steps on
their joint curvature. The factor with the most levels has a block of its own
for each level, so it is eliminated level by level where its rows' sums meet;
what is left is a system in the fixed effects and the levels of the other
factors, which are counted first and must be few (DENSE). Its inverse gives exact
standard errors, traces for the scales, and joint draws.

Models of one table share the scan: the design holds the union of their columns,
and each pass over it adds up the cross products of every model that has not
settled yet, so a list of models costs the passes of its slowest one. A level
with a third of all rows is one short line per batch before the shuffle.

The result is a mode with a normal approximation around it, not a sampled
posterior. Intervals of scales come from the curvature of the marginal
likelihood, by models with fixed scales in one more shared scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import Formula, term_columns
from ..operators.relational import complete_cases
from ..session import brief_shuffles, discard, materialize
from . import family as fam
from .fit import POINTS, SMALLEST_SCALE, Fit, Priors, Roots, _scale_mode, _start, climb
from .special import normal

#: Levels of all factors but the largest one that the driver holds as one system.
DENSE = 1024
#: Below so many levels in all, no factor is eliminated.
FEW = 256
#: Levels that are eliminated at once.
CHUNK = 512
#: Rows of a system in one line.
ROWS = 64
#: Levels in a partition, as long as the session's partitions allow.
PART = 4096

SUMS, LEVELS, CROSS, SQUARES = 0, 1, 2, 3
#: ``data`` holds numbers of a system as bytes, which cross to the workers as they are.
LINES = "kind int, level string, pos int, vals array<double>, u array<double>, data binary"
STEP = LINES + ", cols array<int>, weights array<double>"


@dataclass(frozen=True)
class Factor:
    """A grouping factor whose levels are columns of the system, from ``base`` on."""

    name: str
    levels: tuple[str, ...]
    base: int
    width: int = 1
    slope: int | None = None


@dataclass(frozen=True)
class Layout:
    """What all models of a scan share: columns of the union, factors, and the eliminated factor."""

    names: tuple[str, ...]
    factors: tuple[Factor, ...]
    large: str | None
    #: Levels of the eliminated factor.
    many: int = 0

    @property
    def size(self) -> int:
        return sum(f.width * len(f.levels) for f in self.factors)


@dataclass
class Model:
    """State of one model. ``columns`` are its places in the union."""

    name: str
    formula: Formula
    family: str
    priors: Priors
    columns: np.ndarray
    beta: np.ndarray
    center: np.ndarray
    effects: np.ndarray
    group_cov: dict[str, np.ndarray]
    shape: float
    fixed: bool = False
    cov: np.ndarray | None = None
    delta: np.ndarray | None = None
    gradient: float = np.inf
    marginal: float = -np.inf
    steps: int = 0
    converged: bool = False
    history: list[float] = field(default_factory=list)
    trace: dict[str, list[np.ndarray]] = field(default_factory=dict)
    step: DataFrame | None = None
    place: int = 0
    #: Precision of the eliminated factor's effects.
    lam: float = 0.0
    #: Size of the response's scale, of which floors of other scales are a part.
    unit: float = 1.0
    #: The models of the scan that this one settled in, as they were before the step, and its place among them.
    settled_in: tuple | None = None


def alone(m: Model) -> Model:
    """The state without what only the driver needs; fit for a task."""
    return replace(m, step=None, trace={}, history=[], settled_in=None, cov=None)


@dataclass(frozen=True)
class Joint:
    """What draws and standard errors of a settled model need."""

    layout: Layout
    model: Model
    rows: DataFrame


def design_of(df: DataFrame, formulas: Sequence[Formula], keep: Sequence[str] = ()) -> tuple[DataFrame, Layout]:
    """Stored rows with the union of the formulas' columns, NaN where a row lacks one.

    The formulas share response, offset, trials, groups and slopes. Rows that
    lack one of these are dropped; rows that lack a column, or hold a category
    outside its level list, are left out of the models that use it.
    """
    first = formulas[0]
    shared = lambda f: (f.response, f.offset, f.trials, tuple(f.groups), dict(f.slopes))
    if any(shared(f) != shared(first) for f in formulas):
        raise ValueError("models of one scan need one response, offset, trials, groups and slopes")
    known = {c: tuple(v) for f in formulas for c, v in f.levels.items()}
    if any(tuple(v) != known[c] for f in formulas for c, v in f.levels.items()):
        raise ValueError("models of one scan need one level list for a column")
    union = {name: column for f in formulas for name, column in term_columns(f)}
    rows = complete_cases(df, list(dict.fromkeys(c for c in (first.response, first.offset, first.trials, *first.groups) if c)))
    rows = rows.withColumns({f"kept_{c}": F.col(c) for c in keep})
    kept = [F.col(f"kept_{c}").alias(c) for c in keep]
    rows = rows.withColumns({c: F.when(F.col(c).isin(list(v)), F.col(c)) for c, v in known.items()})
    filled = [F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in union.values()]
    design = plain_rows = materialize(
        rows.select(
            *kept,
            F.col(first.response).cast("double").alias("y"),
            F.array(*filled).alias("x"),
            (F.col(first.offset) if first.offset else F.lit(0.0)).cast("double").alias("offset"),
            (F.col(first.trials) if first.trials else F.lit(1.0)).cast("double").alias("trials"),
            *[F.col(g).cast("string").alias(f"g_{g}") for g in first.groups],
        ),
        "design",
    )
    counts = design.agg(*[F.count_distinct(f"g_{g}").alias(g) for g in first.groups]).first() if first.groups else {}
    names, large = tuple(union), None
    width = {g: 2 if g in first.slopes else 1 for g in first.groups}
    plain = [g for g in first.groups if width[g] == 1]
    if plain and sum(width[g] * counts[g] for g in first.groups) > FEW:
        large = max(plain, key=lambda g: counts[g])
    if sum(width[g] * counts[g] for g in first.groups if g != large) > DENSE:
        raise TooManyLevels({g: counts[g] for g in first.groups})
    factors, base = [], 0
    for g in first.groups:
        if g == large:
            continue
        # Counted above: at most DENSE.
        levels = tuple(sorted(r[0] for r in design.select(f"g_{g}").distinct().collect()))
        factors.append(Factor(g, levels, base, width[g], names.index(first.slopes[g]) if width[g] == 2 else None))
        base += width[g] * len(levels)
        numbers = design.sparkSession.createDataFrame([(v, i) for i, v in enumerate(levels)], f"g_{g} string, c_{g} int")
        design = design.join(F.broadcast(numbers), f"g_{g}")
    codes = [F.col(f"c_{f.name}") for f in factors]
    design = design.withColumn("codes", F.array(*codes).cast("array<int>") if codes else F.array().cast("array<int>"))
    level = F.col(f"g_{large}") if large else F.lit(None).cast("string")
    design = design.withColumn("level", level).drop(*[f"c_{f.name}" for f in factors])
    coded = materialize(design.sortWithinPartitions("level") if large else design, "coded")
    discard(coded.sparkSession, plain_rows.stored_at)
    return coded, Layout(names, tuple(factors), large, counts[large] if large else 0)


class TooManyLevels(ValueError):
    """No factor but one may have more levels than the driver holds."""


# Batches ---------------------------------------------------------------------


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32) if matrix.size else np.zeros(len(matrix) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, float).ravel()))


def _places(layout: Layout, codes: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """For each column of a row's factor levels its place among them, and what multiplies it (None for 1)."""
    out = []
    for k, f in enumerate(layout.factors):
        for a in range(f.width):
            out.append((f.base + codes[:, k].astype(np.int64) * f.width + a, None if a == 0 else np.nan_to_num(x[:, f.slope])))
    return out


def _scaled(v: np.ndarray, z: np.ndarray | None) -> np.ndarray:
    return v if z is None else v * z


def _blocks(kind: int, model: int, matrix: np.ndarray, vector: np.ndarray, scalars: Sequence[float]) -> list[tuple]:
    """Lines with ROWS rows of the lower triangle each, their entries of the vector behind, and one line of scalars."""
    n = len(vector)
    out = [(kind, str(model), j, np.append(matrix[j : j + ROWS, : j + ROWS].ravel(), vector[j : j + ROWS])) for j in range(0, n, ROWS)]
    return [*out, (kind, str(model), -1, np.asarray(scalars, float))]


def _batch(rows: list[tuple], wide: bool = False) -> pa.RecordBatch:
    kind, level, pos, vals = (list(c) for c in zip(*rows, strict=True))
    none = pa.nulls(len(rows), pa.list_(pa.float64()))
    data = pa.array([np.ascontiguousarray(v, float).tobytes() for v in vals], pa.binary())
    cols = [pa.array(kind, pa.int32()), pa.array(level, pa.string()), pa.array(pos, pa.int32()), none, none, data]
    names = ["kind", "level", "pos", "vals", "u", "data"]
    if wide:
        cols += [pa.nulls(len(rows), pa.list_(pa.int32())), none]
        names += ["cols", "weights"]
    return pa.RecordBatch.from_arrays(cols, names)


# One pass --------------------------------------------------------------------


def reduce_rows(layout: Layout, models: Sequence[Model], every: int):
    """Rows to lines: cross products by model at the end of a task, and per batch the sums of each level of the large factor."""
    sizes = [len(m.columns) + layout.size for m in models]

    def run(batches):
        a = [np.zeros((n, n)) for n in sizes]
        b = [np.zeros(n) for n in sizes]
        scalars = np.zeros((len(models), 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            y, off, trials = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("y", "offset", "trials"))
            union = _matrix(_column(batch, "x"), len(layout.names))
            codes = _matrix(_column(batch, "codes"), len(layout.factors)) if layout.factors else np.zeros((len(y), 0), int)
            places = _places(layout, codes, union)
            coded = _column(batch, "level").dictionary_encode() if layout.large else None
            u = _matrix(_column(batch, "u"), every) if layout.large else None
            curves, slopes, xs = [], [], []
            for k, m in enumerate(models):
                x = union[:, m.columns]
                ok = np.isfinite(x).all(1)
                x = np.where(ok[:, None], x, 0.0)
                eta = x @ m.beta + off
                for at, z in places:
                    eta = eta + _scaled(m.effects[at], z)
                if u is not None:
                    eta = eta + u[:, m.place]
                g, w = fam.score(m.family, y, eta, trials, m.shape)
                g, w = np.where(ok, g, 0.0), np.where(ok, w, 0.0)
                s1, s2 = fam.shape_terms(m.family, y[ok], eta[ok], trials[ok], m.shape)
                scalars[k] += [ok.sum(), fam.log_lik(m.family, y[ok], eta[ok], trials[ok], m.shape).sum(), s1, s2]
                _cross(a[k], b[k], x, g, w, places)
                curves.append(w)
                slopes.append(g)
                xs.append(x)
            if coded is not None:
                yield from _level_lines(coded, xs, slopes, curves, places, u, layout)
        rows = [r for k in range(len(models)) for r in _blocks(SUMS, k, a[k], b[k], scalars[k])]
        yield _batch(rows)

    return run


def _cross(a: np.ndarray, b: np.ndarray, x: np.ndarray, g: np.ndarray, w: np.ndarray, places) -> None:
    """Adds the lower triangle of the weighted cross products, and the gradient."""
    p, n = x.shape[1], len(b)
    wx = x * w[:, None]
    a[:p, :p] += x.T @ wx
    b[:p] += x.T @ g
    for i, (at, z) in enumerate(places):
        b += np.bincount(p + at, _scaled(g, z), n)
        for c in range(p):
            a[:, c] += np.bincount(p + at, _scaled(wx[:, c], z), n)
        for other, z2 in places[: i + 1]:
            hi, lo = np.maximum(at, other), np.minimum(at, other)
            a.ravel()[:] += np.bincount((p + hi) * n + p + lo, _scaled(_scaled(w, z), z2), n * n)


def _level_lines(coded, xs, slopes, curves, places, u, layout: Layout):
    level, n = coded.indices.to_numpy(), len(coded.dictionary)
    main = []
    for x, g, w in zip(xs, slopes, curves, strict=True):
        main += [np.bincount(level, w, n), np.bincount(level, g, n), *[np.bincount(level, w * x[:, c], n) for c in range(x.shape[1])]]
    first = np.zeros(n, np.int64)
    first[level[::-1]] = np.arange(len(level))[::-1]
    out = [(coded.dictionary, np.full(n, -1), np.column_stack(main))]
    for at, z in places:
        pairs, inverse = np.unique(level * layout.size + at, return_inverse=True)
        sums = np.column_stack([np.bincount(inverse, _scaled(w, z), len(pairs)) for w in curves])
        out.append((coded.dictionary.take(pa.array(pairs // layout.size)), pairs % layout.size, sums))
    for k, (names, pos, vals) in enumerate(out):
        held = _lists(u[first]) if k == 0 else pa.nulls(len(names), pa.list_(pa.float64()))
        kind = pa.array(np.full(len(names), LEVELS, np.int32))
        none = pa.nulls(len(names), pa.binary())
        yield pa.RecordBatch.from_arrays([kind, names, pa.array(pos.astype(np.int32)), _lists(vals), held, none], ["kind", "level", "pos", "vals", "u", "data"])


def whole_levels(batches):
    """Lines of whole levels, a table at a time; a level over many batches is joined once."""
    held, open_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, codes = _column(batch, "kind").to_numpy(), _column(batch, "level").dictionary_encode().indices.to_numpy()
        key = lambda k: (int(kinds[k]), _column(batch, "level")[k].as_py())  # noqa: B023, E731
        if held and key(0) != open_key:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        before = np.flatnonzero((codes != codes[-1]) | (kinds != kinds[-1]))
        cut = int(before[-1]) + 1 if len(before) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
        open_key = key(len(codes) - 1)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def gather_levels(layout: Layout, models: Sequence[Model], every: int):
    """Lines to one record per level of the large factor, and what its elimination takes from the system."""
    ps = [len(m.columns) for m in models]
    width = sum(2 + p for p in ps)

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        cross = [np.zeros((p + layout.size, p + layout.size)) for p in ps]
        square = [np.zeros_like(c) for c in cross]
        right, moved = ([np.zeros(p + layout.size) for p in ps] for _ in range(2))
        scalars = np.zeros((len(models), 6))
        for lines in whole_levels(batches):
            kinds, pos = lines.column("kind").to_numpy(), lines.column("pos").to_numpy()
            for k in np.flatnonzero(kinds == SUMS):
                key = int(lines.column("level")[k].as_py()), int(pos[k])
                vals = np.frombuffer(lines.column("data")[k].as_py())
                sums[key] = sums[key] + vals if key in sums else vals.copy()
            own = lines.filter(pa.array(kinds == LEVELS)).combine_chunks()
            if not own.num_rows:
                continue
            own = own.to_batches()[0]
            coded = _column(own, "level").dictionary_encode()
            level, n, pos = coded.indices.to_numpy(), len(coded.dictionary), _column(own, "pos").to_numpy()
            at = np.flatnonzero(pos < 0)
            main, u = np.zeros((n, width)), np.zeros((n, every))
            np.add.at(main, level[at], _matrix(_column(own, "vals").take(pa.array(at)), width))
            u[level[at]] = _matrix(_column(own, "u").take(pa.array(at)), every)
            at = np.flatnonzero(pos >= 0)
            pairs, inverse = np.unique(level[at] * max(1, layout.size) + pos[at], return_inverse=True)
            weights = np.zeros((len(pairs), len(models)))
            if len(at):
                np.add.at(weights, inverse, _matrix(_column(own, "vals").take(pa.array(at)), len(models)))
            row, col = pairs // max(1, layout.size), pairs % max(1, layout.size)
            bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            met, begin = _within(row, bounds), 0
            for k, m in enumerate(models):
                h, g, x = main[:, begin], main[:, begin + 1], main[:, begin + 2 : begin + 2 + ps[k]]
                begin += 2 + ps[k]
                old = u[:, m.place]
                stiff, grad = h + m.lam, g - m.lam * old
                start = old + grad / stiff
                _eliminate(cross[k], square[k], x, x / stiff[:, None], weights[:, k], weights[:, k] / stiff[row], row, col, met)
                for out, v in ((right[k], grad / stiff), (moved[k], start / stiff)):
                    out[: ps[k]] += x.T @ v
                    out[ps[k] :] += np.bincount(col, weights[:, k] * v[row], layout.size)
                scalars[k] += [n, (1 / stiff).sum(), (start**2).sum(), np.log(stiff).sum(), (old**2).sum(), (h > 0).sum()]
            many = (bounds * len(models)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, LEVELS, np.int32)), coded.dictionary, pa.nulls(n, pa.int32()), _lists(main), _lists(u), pa.nulls(n, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(pa.array(many), pa.array(weights.ravel()))],
                ["kind", "level", "pos", "vals", "u", "data", "cols", "weights"],
            )
        rows = [(SUMS, str(k), j, v) for (k, j), v in sums.items()]
        if scalars[:, 0].any():
            for k in range(len(models)):
                rows += _blocks(CROSS, k, cross[k], right[k], scalars[k]) + _blocks(SQUARES, k, square[k], moved[k], [0.0])
        if rows:
            yield _batch(rows, wide=True)

    return run


def _within(row: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every two entries of one level, each with itself too, the earlier one first."""
    many = bounds[row + 1] - np.arange(len(row))
    left = np.repeat(np.arange(len(row)), many)
    return left, left + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)


def _eliminate(cross, square, x, share, weights, shares, row, col, met) -> None:
    """Adds the lower triangles of the levels' products; a level meets few of the other factors' levels, so only these are gone through."""
    p, n = x.shape[1], len(cross)
    cross[:p, :p] += x.T @ share
    square[:p, :p] += share.T @ share
    for c in range(p):
        cross[p:, c] += np.bincount(col, shares * x[row, c], n - p)
        square[p:, c] += np.bincount(col, shares * share[row, c], n - p)
    left, right = met
    if len(left):
        # Entries of a level are in the order of their columns.
        at = (p + col[right]) * n + p + col[left]
        cross.ravel()[:] += np.bincount(at, weights[left] * shares[right], n * n)
        square.ravel()[:] += np.bincount(at, shares[left] * shares[right], n * n)


def add_up(rows: DataFrame) -> dict[tuple[int, int, int], np.ndarray]:
    """Sums of ``vals`` by (kind, level, pos), which are as many as the systems have blocks."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = zip(*(_column(batch, c).to_pylist() for c in ("kind", "level", "pos")), strict=True)
            for k, key in enumerate(keys):
                vals = np.frombuffer(_column(batch, "data")[k].as_py())
                sums[key] = sums[key] + vals if key in sums else vals
        if sums:
            yield _batch([(*key, v) for key, v in sums.items()])

    parts = rows.select("kind", "level", "pos", "data").repartition("kind", "level", "pos").mapInArrow(run, LINES)
    table = parts.select("kind", "level", "pos", "data").toArrow().to_pydict()
    keys = zip(table["kind"], map(int, table["level"]), table["pos"], strict=True)
    return {key: np.frombuffer(v) for key, v in zip(keys, table["data"], strict=True)}


def _system(sums, kind: int, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symmetric matrix, vector and scalars of one model."""
    a, b = np.zeros((n, n)), np.zeros(n)
    for j in range(0, n, ROWS):
        if (line := sums.get((kind, k, j))) is not None:
            to = min(n, j + ROWS)
            a[j:to, :to] = line[: (to - j) * to].reshape(to - j, to)
            b[j:to] = line[(to - j) * to :]
    a = np.tril(a) + np.tril(a, -1).T
    return a, b, sums.get((kind, k, -1), np.zeros(6))


def move_levels(models: Sequence[Model], extra=None):
    """Records of the levels to (level, u) after the step, or to what ``extra`` makes of the only model."""
    ps = [len(m.columns) for m in models]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            main = _matrix(_column(batch, "vals"), sum(2 + p for p in ps))
            size = np.diff(_column(batch, "cols").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), size)
            col = _column(batch, "cols").flatten().to_numpy(zero_copy_only=False)
            weights = _matrix(_column(batch, "weights"), len(models)) if len(col) else np.zeros((0, len(models)))
            old = _column(batch, "u").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            new, begin, made = old.copy(), 0, []
            for k, m in enumerate(models):
                h, g, cx = main[:, begin], main[:, begin + 1], main[:, begin + 2 : begin + 2 + ps[k]]
                begin += 2 + ps[k]
                stiff = h + m.lam
                along = cx @ m.delta[: ps[k]] + np.bincount(row, weights[:, k] * m.delta[ps[k] + col], batch.num_rows)
                new[:, m.place] += (g - m.lam * old[:, m.place] - along) / stiff
                if extra is not None:
                    made.append((h, stiff, cx, row, col, weights[:, k], new[:, m.place]))
            if extra is None:
                yield pa.RecordBatch.from_arrays([_column(batch, "level"), _lists(new)], ["level", "u"])
            else:
                yield extra(batch, *made[0])

    return run


def one_pass(design: DataFrame, layout: Layout, models: Sequence[Model], every: int, effects: DataFrame | None) -> DataFrame:
    """The stored sums of one scan for ``models``."""
    columns = ["y", "x", "offset", "trials", "codes"]
    rows = design.select(*columns, "level")
    if layout.large:
        none = F.array(*[F.lit(0.0)] * every)
        rows = rows.join(effects, "level", "left").withColumn("u", F.coalesce("u", none)) if effects is not None else rows.withColumn("u", none)
    held = design.sparkSession.sparkContext.broadcast([alone(m) for m in models])
    lines = rows.mapInArrow(lambda batches: reduce_rows(layout, held.value, every)(batches), LINES)
    if not layout.large:
        return materialize(lines.withColumns({"cols": F.lit(None).cast("array<int>"), "weights": F.lit(None).cast("array<double>")}), "step")
    key = F.when(F.col("kind") == SUMS, F.concat_ws(":", "level", "pos")).otherwise(F.col("level"))
    parts = max(1, min(int(design.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-layout.many // PART)))
    met = lines.repartition(parts, F.col("kind"), key).sortWithinPartitions("kind", "level", "pos")
    return materialize(met.mapInArrow(lambda batches: gather_levels(layout, held.value, every)(batches), STEP), "step")


# The driver's part: systems of at most DENSE + columns -------------------------


def _penalty(m: Model, layout: Layout) -> tuple[np.ndarray, float]:
    """Prior precision at the current state, and the log prior of the fixed effects and the factors' effects."""
    p, n = len(m.beta), len(m.beta) + layout.size
    out = np.zeros((n, n))
    out[range(1, p), range(1, p)] = 1 / m.priors.b**2
    direction = m.center.copy()
    direction[0] = 1.0
    at = float(direction @ m.beta)
    log_prior = -0.5 * float((m.beta[1:] ** 2).sum()) / m.priors.b**2
    weight = 1 / m.priors.intercept**2
    if m.priors.intercept_df is None:
        log_prior -= 0.5 * weight * at**2
    else:
        nu = m.priors.intercept_df
        log_prior -= 0.5 * (nu + 1) * np.log1p(at**2 * weight / nu)
        weight = (nu + 1) / (nu * m.priors.intercept**2 + at**2)
    out[:p, :p] += weight * np.outer(direction, direction)
    for f in layout.factors:
        precision = np.linalg.inv(m.group_cov[f.name])
        for j in range(len(f.levels)):
            at = p + f.base + j * f.width
            out[at : at + f.width, at : at + f.width] = precision
        u = _effects(m, f)
        log_prior -= 0.5 * float(np.einsum("la,ab,lb->", u, precision, u)) + 0.5 * len(f.levels) * float(np.linalg.slogdet(m.group_cov[f.name])[1])
    return out, log_prior


def _effects(m: Model, f: Factor) -> np.ndarray:
    return m.effects[f.base : f.base + f.width * len(f.levels)].reshape(-1, f.width)


@dataclass(frozen=True)
class Moments:
    """Sums of a gaussian scan for a residual scale of one, and the state they are taken around."""

    a: np.ndarray
    b: np.ndarray
    rows: float
    squares: float
    state: np.ndarray

    @staticmethod
    def of(m: Model, layout: Layout, sums, k: int) -> Moments:
        a, b, (rows, _, squares, _) = _system(sums, SUMS, k, len(m.beta) + layout.size)
        return Moments(a * m.shape**2, b * m.shape**2, float(rows), float(squares), np.concatenate([m.beta, m.effects]))

    def at(self, m: Model) -> tuple[np.ndarray, np.ndarray, tuple]:
        """What a scan would add up at the state of ``m``."""
        d = np.concatenate([m.beta, m.effects]) - self.state
        along = self.a @ d
        squares = max(0.0, self.squares - 2 * float(d @ self.b) + float(d @ along))
        log_lik = -self.rows * (0.5 * np.log(2 * np.pi) + np.log(m.shape)) - 0.5 * squares / m.shape**2
        return self.a / m.shape**2, (self.b - along) / m.shape**2, (self.rows, log_lik, squares, 0.0)


def solve(m: Model, layout: Layout, sums, k: int, own: tuple | None = None) -> tuple[float, float]:
    """One Newton step of model ``k`` of a scan, or of its ``own`` system; the largest moves of coefficients and of log scales."""
    p, n = len(m.beta), len(m.beta) + layout.size
    a, b, (rows, log_lik, s1, s2) = own or _system(sums, SUMS, k, n)
    cross, right, (levels, inverse, starts, logs, old, _) = _system(sums, CROSS, k, n)
    square, moved, _ = _system(sums, SQUARES, k, n)
    penalty, log_prior = _penalty(m, layout)
    state = np.concatenate([m.beta, m.effects])
    system = a - cross + penalty
    rhs = b - right - penalty @ state
    m.cov = np.linalg.inv(system)
    m.cov = (m.cov + m.cov.T) / 2
    delta = m.cov @ rhs
    limit = 5.0 * max(1.0, m.shape if m.family == "gaussian" else 1.0)
    delta *= min(1.0, limit / max(np.abs(delta).max(), 1e-300))
    m.gradient = float(np.abs(rhs).max() / max(1.0, rows))
    log_det = float(np.linalg.slogdet(system)[1])
    m.marginal = float(log_lik) + log_prior - 0.5 * log_det
    if layout.large:
        m.marginal += 0.5 * levels * np.log(m.lam) - 0.5 * m.lam * old - 0.5 * logs
    m.delta = delta
    m.beta, m.effects = m.beta + delta[:p], m.effects + delta[p:]
    m.steps += 1
    return float(np.abs(delta[:p]).max()), 0.0 if m.fixed else _scales(m, layout, penalty, square, moved, levels, inverse, starts, rows, s1, s2)


def _scales(m: Model, layout: Layout, penalty, square, moved, levels, inverse, starts, rows, s1, s2) -> float:
    """Fixed-point updates with the effective number of parameters (MacKay 1992)."""
    p, change = len(m.beta), 0.0
    used = len(m.cov) - float((penalty * m.cov).sum())
    for f in layout.factors:
        u = _effects(m, f)
        spread = np.zeros((f.width, f.width))
        for j in range(len(f.levels)):
            at = p + f.base + j * f.width
            spread += m.cov[at : at + f.width, at : at + f.width]
        change = max(change, _scale(m, f.name, len(f.levels), u.T @ u, spread))
    if layout.large:
        spread = inverse + float((m.cov * square).sum())
        used += levels - m.lam * spread
        squares = starts - 2 * m.delta @ moved + m.delta @ square @ m.delta
        change = max(change, _scale(m, layout.large, levels, np.array([[squares]]), np.array([[spread]])))
        m.lam = 1 / float(m.group_cov[layout.large][0, 0])
    if m.family == "negbinomial":
        slope = m.shape * (s1 - m.priors.shape)
        bend = m.shape**2 * s2 + slope
        move = float(np.clip(-slope / bend if bend < 0 else np.sign(slope) * 0.5, -1.0, 1.0))
        m.shape *= float(np.exp(move))
        change = max(change, abs(move))
    elif m.family == "gaussian":
        new = _scale_mode(max(rows - used, 1e-8), s1, m.priors.sigma, SMALLEST_SCALE * m.unit)
        change, m.shape = max(change, abs(new - m.shape) / m.shape), new
    return change


def _scale(m: Model, name: str, levels: float, squares: np.ndarray, spread: np.ndarray) -> float:
    """New covariance of a factor's effects; the move of its log scales and of its correlation."""
    cov, floor = m.group_cov[name], SMALLEST_SCALE * m.unit
    old = np.sqrt(np.diag(cov))
    known = np.maximum(levels - np.diag(spread) / old**2, 1e-8)
    sd = np.array([_scale_mode(n, max(s, 0.0), m.priors.sd, floor) for n, s in zip(known, np.diag(squares), strict=True)])
    # Where the rows tell next to nothing of the effects, the ratio of successive scales is constant, and below one it ends at none.
    sd = np.where((known < 0.01 * levels) & (sd < old), floor, sd)
    moments = squares + spread
    root = np.sqrt(np.diag(moments))
    bent = lambda c: np.arctanh(np.clip(c[np.triu_indices(len(c), 1)], -0.999, 0.999))
    new, at = np.concatenate([np.log(sd), bent(moments / np.outer(root, root))]), np.concatenate([np.log(old), bent(cov / np.outer(old, old))])
    change = float(np.abs(new - at).max())
    new = _limit(m.trace.setdefault(name, []), new)
    sd = np.maximum(np.exp(new[: len(sd)]), floor)
    correlation = np.eye(len(sd))
    correlation[np.triu_indices(len(sd), 1)] = np.tanh(new[len(sd) :])
    m.group_cov[name] = (correlation + np.triu(correlation, 1).T) * np.outer(sd, sd)
    return change


def _limit(trace: list[np.ndarray], new: np.ndarray) -> np.ndarray:
    """Every third update jumps to the limit a geometric approach points at (Aitken)."""
    trace.append(new)
    if len(trace) < 3:
        return new
    first, last = trace[-2] - trace[-3], trace[-1] - trace[-2]
    trace.clear()
    ratio = np.clip(np.divide(last, first, out=np.zeros_like(last), where=np.abs(first) > 1e-12), -0.9, 0.98)
    return new + np.clip(last * ratio / (1 - ratio), -2.0, 2.0)


def settle(m: Model, layout: Layout, sums: Moments, most: int, tol: float, scale_tol: float) -> None:
    """The mode of the scales and of all effects of a gaussian model, from the sums of one scan."""
    roots = Roots(tuple(f.name for f in layout.factors), tuple(f.width for f in layout.factors), SMALLEST_SCALE * m.unit)
    held, m.fixed = m.fixed, True
    p = len(m.beta)

    def height(at):
        _, m.group_cov, m.shape = roots.read(at)
        # The density counts at the effects that a step sets out from, so one more step follows; an intercept with a t prior takes several.
        for _ in range(20):
            solve(m, layout, {}, 0, sums.at(m))
            if np.abs(m.delta).max() < 1e-3 * tol:
                break
        moments = {}
        for f in layout.factors:
            u, spread = _effects(m, f), np.zeros((f.width, f.width))
            for j in range(len(f.levels)):
                i = p + f.base + j * f.width
                spread += m.cov[i : i + f.width, i : i + f.width]
            moments[f.name] = len(f.levels), u.T @ u + spread
        _, _, (rows, _, squares, _) = sums.at(m)
        prior, slope = roots.slope(at, moments, (squares + float((m.cov * sums.a).sum())) / m.shape**2 - rows, m.priors)
        return m.marginal + prior, slope, m.beta.copy()

    history, m.converged = climb(height, roots, roots.start(0.1 * m.unit, m.shape), most, tol, scale_tol)
    m.history, m.fixed, m.steps = history, held, len(history)


# Fits ------------------------------------------------------------------------


def _moments(design: DataFrame, layout: Layout, columns: Sequence[np.ndarray]) -> dict:
    """Per model the rows, the means of its columns, and of y, y squared and trials, over its complete rows."""

    def run(batches):
        sums = [np.zeros(len(c) + 4) for c in columns]
        for batch in batches:
            y, trials = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("y", "trials"))
            union = _matrix(_column(batch, "x"), len(layout.names))
            for k, c in enumerate(columns):
                x = union[:, c]
                ok = np.isfinite(x).all(1)
                sums[k] += [ok.sum(), *x[ok].sum(0), y[ok].sum(), (y[ok] ** 2).sum(), trials[ok].sum()]
        yield _batch([(SUMS, str(k), 0, s) for k, s in enumerate(sums)])

    found = add_up(design.select("y", "trials", "x").mapInArrow(run, LINES))
    return {k: v for (_, k, _), v in found.items()}


@dataclass(frozen=True)
class Task:
    """A model to fit; with ``scales`` (group covariances) and ``shape`` given these stay as they are."""

    name: str
    formula: Formula
    family: str = "bernoulli"
    priors: Priors = Priors()
    scales: Mapping[str, np.ndarray] | None = None
    shape: float | None = None


def fit_together(
    df: DataFrame, tasks: Sequence[Task], keep: Sequence[str] = (), max_cycles: int = 60, tol: float = 1e-6,
    scale_tol: float = 1e-4, strict: bool = True, prepared: tuple[DataFrame, Layout] | None = None, start: Fit | None = None,
) -> dict[str, Fit]:
    """Fit all ``tasks`` to ``df`` in shared scans; by name.

    ``start`` is a fit of the same formula that all of them set out from.

    A model settles when no coefficient moves by ``tol`` and no scale by a factor
    of more than 1 + ``scale_tol``. One that has not after ``max_cycles`` scans is
    an error, or with ``strict`` off a result whose ``converged`` is false.
    """
    for t in tasks:
        fam.check_family(t.family)
    with brief_shuffles((df if prepared is None else prepared[0]).sparkSession):
        return _fit_together(df, tasks, keep, max_cycles, tol, scale_tol, strict, prepared, start)


def _fit_together(df, tasks, keep, max_cycles, tol, scale_tol, strict, prepared, start) -> dict[str, Fit]:
    design, layout = prepared or design_of(df, [t.formula for t in tasks], keep)
    columns = [np.array([layout.names.index(n) for n, _ in term_columns(t.formula)]) for t in tasks]
    means = _moments(design, layout, columns)
    models = []
    for k, t in enumerate(tasks):
        n, *x, y, yy, trials = means[k]
        if not n:
            raise ValueError(f"the design of {t.name} has no complete rows")
        sd = float(np.sqrt(max(0.0, yy - y * y / n) / max(1.0, n - 1)))
        beta = np.zeros(len(x))
        beta[0] = _start(t.family, {"ybar": y / n, "tbar": trials / n})
        wide = {f.name: np.eye(f.width) for f in layout.factors} | ({layout.large: np.eye(1)} if layout.large else {})
        cov = {g: np.atleast_2d(np.asarray(t.scales[g], float)) if t.scales else c for g, c in wide.items()}
        shape = t.shape if t.shape is not None else (sd or 1.0) if t.family == "gaussian" else 1.0
        m = Model(t.name, t.formula, t.family, t.priors, columns[k], beta, np.array(x) / n, np.zeros(layout.size), cov, float(shape), t.scales is not None, place=k, unit=(sd or 1.0) if t.family == "gaussian" else 1.0)
        if layout.large:
            m.lam = 1 / float(cov[layout.large][0, 0])
        if start:
            m.beta, m.effects = start.joint.model.beta.copy(), start.joint.model.effects.copy()
        models.append(m)
    open_models, effects, last = list(models), None, None
    if start and layout.large:
        effects = materialize(start.effects[layout.large].select("level", F.array_repeat(F.col("u")[0], len(models)).alias("u")), "start")
    # Least squares: the curvature is the same everywhere, so where the driver holds all effects one scan tells every later one.
    still = not layout.large and all(t.family == "gaussian" for t in tasks)
    moments = {}
    for _ in range(max_cycles):
        if not moments:
            step = one_pass(design, layout, open_models, len(models), effects)
            sums = add_up(step.filter(F.col("kind") != LEVELS))
            if still:
                moments = {m.place: Moments.of(m, layout, sums, k) for k, m in enumerate(open_models)}
        if moments and any(f.width > 1 for f in layout.factors) and not any(m.fixed for m in open_models):
            # Correlated scales lean on each other: the steps below creep towards a correlation near one.
            for m in open_models:
                m.step = step
                settle(m, layout, moments[m.place], POINTS * max_cycles, tol, scale_tol)
            open_models = [m for m in open_models if not m.converged]
            break
        # Levels move by what was solved for, at the precision of this scan.
        frozen = [alone(m) for m in open_models]
        moves = []
        for k, m in enumerate(open_models):
            moves.append(solve(m, layout, sums, k, moments[m.place].at(m) if moments else None))
            m.history.append(moves[-1][0])
            frozen[k].delta = m.delta
        if layout.large:
            effects = step.filter(F.col("kind") == LEVELS).mapInArrow(move_levels(frozen), "level string, u array<double>")
        settled = [k for k, (move, scale) in enumerate(moves) if move < tol and scale < scale_tol]
        for k, m in enumerate(open_models):
            m.step, m.converged = step, k in settled
            m.history[-1] = moves[k][0]
            m.settled_in = (frozen, k)
        # The scan before this one was read for the last time.
        if last is not None and not any(m.step is last for m in models):
            discard(design.sparkSession, last.stored_at)
        if layout.large and len(settled) < len(open_models):
            for m in (open_models[k] for k in settled):
                _keep_own(m)
        open_models = [m for k, m in enumerate(open_models) if k not in settled]
        last = step
        if not open_models:
            break
    if strict and open_models:
        raise RuntimeError(f"{[m.name for m in open_models]} did not settle in {max_cycles} scans; last moves {[m.history[-1] for m in open_models]}")
    return {m.name: _result(m, design, layout) for m in models}


def _result(m: Model, design: DataFrame, layout: Layout) -> Fit:
    terms = [layout.names[c] for c in m.columns]
    p, spark = len(terms), design.sparkSession
    own = F.array(*[F.col("x")[int(c)] for c in m.columns])
    # A row is in the model if it lacks none of the model's columns.
    rows = design.withColumn("x", own).filter(~F.exists("x", F.isnan))
    se, effects = np.sqrt(np.maximum(np.diag(m.cov), 0.0)), {}
    for f in layout.factors:
        u, s = _effects(m, f), se[p + f.base : p + f.base + f.width * len(f.levels)].reshape(-1, f.width)
        table = [(v, a.tolist(), b.tolist()) for v, a, b in zip(f.levels, u, s, strict=True)]
        effects[f.name] = spark.createDataFrame(table, "level string, u array<double>, se array<double>")
    joint = Joint(layout, m, rows)
    if layout.large:
        effects[layout.large] = _level_records(joint, _spread(m), "level string, u array<double>, se array<double>")
    return Fit(
        formula=m.formula, family=m.family, terms=terms, beta=m.beta, cov=m.cov[:p, :p], shape=m.shape,
        group_cov={g: m.group_cov[g] for g in m.formula.groups}, effects={g: effects[g] for g in m.formula.groups}, design=rows,
        gradient=m.gradient, steps=m.steps, converged=m.converged, history=m.history, joint=joint,
    )


def _own_records(m: Model) -> tuple[DataFrame, Model]:
    """The model's records of the levels it has rows of, from the scan that it settled in, and its state before that step."""
    frozen, at = m.settled_in
    # Only this model's sums are read; its place among those of the scan tells where they stand.
    ahead = sum(2 + len(f.columns) for f in frozen[:at])
    own = frozen[at]
    width, many = 2 + len(own.columns), len(frozen)
    records = m.step.filter(F.col("kind") == LEVELS).select(
        "level", F.slice("vals", ahead + 1, width).alias("vals"), F.array(F.col("u")[own.place]).alias("u"), "cols",
        F.filter("weights", lambda _, i: i % many == at).alias("weights"), F.xxhash64("level").alias("key"),
    )
    return records.filter(F.col("vals")[0] > 0), replace(own, place=0)


def _keep_own(m: Model) -> None:
    """Stores the records of a settled model, so that those of the other models of its scan can go."""
    records, own = _own_records(m)
    m.step = materialize(records.drop("key").withColumn("kind", F.lit(LEVELS)), "settled")
    m.settled_in = ([own], 0)


def _level_records(joint: Joint, extra, ddl: str) -> DataFrame:
    """Made from the records of the scan that the model settled in."""
    records, own = _own_records(joint.model)
    return records.mapInArrow(move_levels([own], extra), ddl)


def _spread(m: Model):
    """Effects with their joint standard errors."""
    cov, p = m.cov, len(m.beta)

    def extra(batch, h, stiff, cx, row, col, weights, new):
        var = 1 / stiff
        for lo in range(0, len(h), CHUNK):
            share = _share(lo, min(len(h), lo + CHUNK), stiff, cx, row, col, weights, p, len(cov))
            var[lo : lo + CHUNK] += np.einsum("ij,ij->i", share @ cov, share)
        return pa.RecordBatch.from_arrays([_column(batch, "level"), _lists(new[:, None]), _lists(np.sqrt(var)[:, None])], ["level", "u", "se"])

    return extra


def _share(lo, hi, stiff, cx, row, col, weights, p, size) -> np.ndarray:
    """How the effects of levels lo to hi give way to the system's columns."""
    out = np.zeros((hi - lo, size))
    out[:, :p] = cx[lo:hi]
    part = slice(*np.searchsorted(row, [lo, hi]))
    out[row[part] - lo, p + col[part]] = weights[part]
    return out / stiff[lo:hi, None]


def draws_of(joint: Joint, n: int, seed: int) -> np.ndarray:
    """n joint draws of the fixed effects and of the other factors' effects."""
    m = joint.model
    root = np.linalg.cholesky(m.cov + 1e-12 * np.trace(m.cov) / len(m.cov) * np.eye(len(m.cov)))
    return np.concatenate([m.beta, m.effects]) + np.random.default_rng(seed).standard_normal((n, len(m.cov))) @ root.T


def level_draws(joint: Joint, n: int, seed: int) -> tuple[DataFrame, object]:
    """Records of the large factor's levels, and a function from their batches to n draws of each effect given the draws of everything else.

    A record is a fraction of its draws, so these are made where they are read.
    """
    m, p, size = joint.model, len(joint.model.beta), len(joint.model.cov)
    shift = draws_of(joint, n, seed) - np.concatenate([m.beta, m.effects])

    def extra(batch, h, stiff, cx, row, col, weights, new):
        keys = _column(batch, "key").to_numpy()
        noise = np.column_stack([normal(keys, d + 1, seed) for d in range(n)])
        out = new[:, None] + noise / np.sqrt(stiff)[:, None]
        for lo in range(0, len(h), CHUNK):
            out[lo : lo + CHUNK] -= _share(lo, min(len(h), lo + CHUNK), stiff, cx, row, col, weights, p, size) @ shift.T
        return pa.RecordBatch.from_arrays([_column(batch, "level"), _lists(out)], ["level", "ub"])

    records, own = _own_records(joint.model)
    moved = move_levels([own], extra)
    return records, lambda batch: _matrix(_column(next(moved([batch])), "ub"), n)


def predictor_rows(joint: Joint, n: int, seed: int, *columns) -> tuple[DataFrame, object]:
    """Rows with ``columns``, and a function from their batches to the linear predictors of n joint draws."""
    layout, m = joint.layout, joint.model
    values, p = draws_of(joint, n, seed), len(m.beta)
    rows = joint.rows
    if layout.large:
        records, drawn = level_draws(joint, n, seed)
        of_level = records.columns
        rows = rows.select(*columns, "y", "x", "offset", "trials", "codes", "level").join(records, "level")
    else:
        rows = rows.select(*columns, "y", "x", "offset", "trials", "codes")
    slopes = [None if f.slope is None else int(np.flatnonzero(m.columns == f.slope)[0]) for f in layout.factors]

    def predictors(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(_column(batch, "x"), p)
        eta = x @ values[:, :p].T + _column(batch, "offset").to_numpy(zero_copy_only=False)[:, None]
        codes = _matrix(_column(batch, "codes"), len(layout.factors)) if layout.factors else None
        for k, f in enumerate(layout.factors):
            at = p + f.base + codes[:, k].astype(np.int64) * f.width
            eta += values[:, at].T
            if f.width == 2:
                eta += values[:, at + 1].T * x[:, slopes[k], None]
        if layout.large:
            # Rows come by level, so few are drawn twice.
            coded = _column(batch, "level").dictionary_encode().indices.to_numpy()
            _, first = np.unique(coded, return_index=True)
            eta += drawn(batch.select(of_level).take(pa.array(first)))[coded]
        return eta

    return rows, predictors


def scale_intervals(state: Fit, step: float = 0.1, level: float = 1.959964) -> DataFrame:
    """(name, value, lower, upper): scales with intervals from the curvature of the marginal likelihood.

    The log scales are moved by ``step``, each alone and each two together, and
    the models with these fixed scales are fitted in one shared scan. The
    interval is normal in the log scale. Correlations are held.
    """
    joint = state.joint
    if joint is None:
        raise ValueError("intervals of scales need a joint fit")
    m, spark = joint.model, state.design.sparkSession
    names = [(f"sd({g}:{t})", g, a) for g, c in state.group_cov.items() for a, t in enumerate(["Intercept", *([state.formula.slopes[g]] if len(c) > 1 else [])])]
    extra = {"negbinomial": "shape", "gaussian": "sigma"}.get(state.family)
    names += [(extra, None, 0)] if extra else []
    k = len(names)
    moves = {"0": np.zeros(k)}
    for i in range(k):
        for sign in (1, -1):
            moves[f"{i}:{sign}"] = step * sign * np.eye(k)[i]
        for j in range(i):
            moves[f"{i}:{j}"] = step * (np.eye(k)[i] + np.eye(k)[j])
    tasks = []
    for name, v in moves.items():
        cov = {g: c.copy() for g, c in state.group_cov.items()}
        shape = state.shape
        for (_, g, a), d in zip(names, v, strict=True):
            if g is None:
                shape *= float(np.exp(d))
            else:
                cov[g][a, :] *= np.exp(d)
                cov[g][:, a] *= np.exp(d)
        tasks.append(Task(name, state.formula, state.family, m.priors, cov, shape))
    layout = replace(joint.layout, names=tuple(state.terms), factors=tuple(
        replace(f, slope=None if f.slope is None else state.terms.index(joint.layout.names[f.slope])) for f in joint.layout.factors))
    fits = fit_together(None, tasks, tol=1e-5, prepared=(joint.rows, layout), start=state)
    rate = {"shape": m.priors.shape, "sigma": m.priors.sigma}

    def value(name):
        """Log density of the log scales: marginal likelihood, exponential prior, Jacobian."""
        f = fits[name].joint.model
        sizes = [f.shape if g is None else np.sqrt(f.group_cov[g][a, a]) for _, g, a in names]
        return f.marginal + sum(np.log(s) - rate.get(t, m.priors.sd) * s for (t, _, _), s in zip(names, sizes, strict=True))

    at = {name: value(name) for name in moves}
    bend = np.zeros((k, k))
    for i in range(k):
        bend[i, i] = (at[f"{i}:1"] - 2 * at["0"] + at[f"{i}:-1"]) / step**2
        for j in range(i):
            bend[i, j] = bend[j, i] = (at[f"{i}:{j}"] - at[f"{i}:1"] - at[f"{j}:1"] + at["0"]) / step**2
    with np.errstate(invalid="ignore"):
        se = np.sqrt(np.diag(np.linalg.inv(-bend)))
    here = [state.shape if g is None else float(np.sqrt(state.group_cov[g][a, a])) for _, g, a in names]
    out = [(t, v, float(s) if np.isfinite(s) else None, float(v * np.exp(-level * s)) if np.isfinite(s) else None, float(v * np.exp(level * s)) if np.isfinite(s) else None)
           for (t, _, _), v, s in zip(names, here, se, strict=True)]
    return spark.createDataFrame(out, "name string, value double, log_se double, lower double, upper double")
