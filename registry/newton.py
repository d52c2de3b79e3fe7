"""SQL for the mode of a hierarchical regression with given scales: Newton steps on the whole system."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Group:
    """A grouping factor: its column, the covariance of its effects, and the term of a random slope."""

    column: str
    cov: tuple[tuple[float, ...], ...]
    slope: str | None = None


def mode_sql(
    rows: str, terms: Sequence[str], groups: Sequence[Group], family: str, shape: float = 1.0, b: float = 1.5,
    intercept: float = 2.5, intercept_df: float | None = 3.0, steps: int = 9,
) -> str:
    """CTEs that end in ``fitted(j, term, factor, level, coef, estimate, se)``.

    ``rows`` selects i, y, off, trials, the numeric columns ``terms`` and the
    group columns. Every step builds the weighted cross products of all columns
    and solves them by elimination, one pivot a round.
    """
    p = len(terms) + 1
    score = {
        "bernoulli": "y - trials / (1 + exp(-eta)) as g, trials / (1 + exp(-eta)) * (1 - 1 / (1 + exp(-eta))) as w",
        "binomial": "y - trials / (1 + exp(-eta)) as g, trials / (1 + exp(-eta)) * (1 - 1 / (1 + exp(-eta))) as w",
        "negbinomial": f"(y - exp(eta)) / (1 + exp(eta) / {shape}) as g, exp(eta) / (1 + exp(eta) / {shape}) as w",
        "gaussian": f"(y - eta) / {shape**2!r} as g, {1 / shape**2!r} as w",
    }[family]
    start = {"negbinomial": "ln(sum(y) / sum(exp(off)))", "gaussian": "avg(y)"}.get(family, "ln(sum(y) / (sum(trials) - sum(y)))")
    out = [f"r as materialized ({rows})"]
    columns = [f"select i, {k} as j, cast({c} as double) as v from r" for k, c in enumerate(["1.0", *terms], 1)]
    names = [f"select {k} as j, '{t}' as term, null as factor, null as level, null as coef" for k, t in enumerate(["Intercept", *terms], 1)]
    penalty = [f"select {k} as j, {k} as l, cast({1 / b**2!r} as double) as v" for k in range(2, p + 1)]
    base = str(p)
    for f, g in enumerate(groups):
        q = len(g.cov)
        out.append(f"lev{f} as materialized (select level, row_number() over (order by level) as n from (select distinct cast({g.column} as varchar) as level from r))")
        precision = np.linalg.inv(np.array(g.cov))
        for a in range(q):
            at = f"({base}) + {q} * (n - 1) + {a + 1}"
            value = "1.0" if a == 0 else g.slope
            coef = "Intercept" if a == 0 else g.slope
            columns.append(f"select i, {at} as j, cast({value} as double) as v from r join lev{f} on cast({g.column} as varchar) = level")
            names.append(f"select {at} as j, null as term, '{g.column}' as factor, level, '{coef}' as coef from lev{f}")
            penalty += [f"select {at} as j, ({base}) + {q} * (n - 1) + {c + 1} as l, cast({float(precision[a, c])!r} as double) as v from lev{f}" for c in range(q)]
        base = f"{base} + {q} * (select count(*) from lev{f})"
    union = " union all "
    out += [
        f"z as materialized ({union.join(columns)})",
        f"names as materialized ({union.join(names)})",
        f"pen as materialized ({union.join(penalty)})",
        # The intercept's prior acts at the means of the columns.
        f"d as materialized (select j, case when j = 1 then 1.0 else avg(v) end as v from z where j <= {p} group by j)",
        "size as materialized (select max(j) as n from names)",
        f"b0 as materialized (select list_transform(range(1, n + 1), lambda x: case when x = 1 then start else 0.0 end)::double[] as b from size, (select {start} as start from r))",
    ]
    nu = intercept_df
    for k in range(steps):
        weight = f"{1 / intercept**2!r}" if nu is None else f"{nu + 1} / ({nu * intercept**2!r} + mid * mid)"
        last = k == steps - 1
        # The inverse is only read at the end.
        unit = "list_transform(range(1, n + 1), lambda x: case when x = j then 1.0 else 0.0 end)" if last else "[]::double[]"
        out += [
            f"at{k} as materialized (select mid, {weight} as w0 from (select sum(d.v * b[d.j]) as mid from d, b{k}))",
            f"s{k} as materialized (select i, {score} from (select z.i, any_value(y) as y, any_value(trials) as trials, any_value(off) + sum(z.v * b[z.j]) as eta from z join r on z.i = r.i, b{k} group by z.i))",
            f"""h{k} as materialized (select j, l, sum(v) as v from (
                select x.j, y.j as l, sum(w * x.v * y.v) as v from z x join z y on x.i = y.i join s{k} s on s.i = x.i group by 1, 2
                union all select j, l, v from pen union all select x.j, y.j, w0 * x.v * y.v from d x, d y, at{k}) group by 1, 2)""",
            f"""g{k} as materialized (select j, sum(v) as v from (
                select j, sum(g * v) as v from z join s{k} using (i) group by 1
                union all select j, -sum(v * b[l]) from pen, b{k} group by 1 union all select j, -w0 * mid * v from d, at{k}) group by 1)""",
            f"""a{k} as materialized (select 1 as p, list(row order by j) as a from (
                select q.j, list_concat(list_append(list(coalesce(h.v, 0.0) order by q.l), any_value(g.v)), any_value({unit.replace('j then', 'q.j then')})) as row
                from (select x.j, y.j as l from names x, names y) q cross join size left join h{k} h on h.j = q.j and h.l = q.l left join g{k} g on g.j = q.j group by q.j))""",
            f"""e{k} as (select p, a from a{k} union all select p + 1, list_transform(a, lambda row, i: case when i = p
                then list_transform(row, lambda x: x / row[p]) else list_transform(row, lambda x, c: x - row[p] / a[p][p] * a[p][c]) end)
                from e{k}, size where p <= n)""",
            f"x{k} as materialized (select a from e{k}, size where p = n + 1)",
            f"b{k + 1} as materialized (select list_transform(b, lambda v, i: v + a[i][n + 1]) as b from b{k}, x{k}, size)",
        ]
    out.append(f"fitted as (select names.*, b[j] as estimate, sqrt(a[j][n + 1 + j]) as se from names, b{steps}, x{steps - 1}, size)")
    return "with recursive " + ",\n".join(out)


def coefficients_sql(sql: str) -> str:
    """Fixed effects as ``coef_table`` gives them."""
    z = 1.959963984540054
    return f"""{sql} select term, round_even(estimate, 6) as estimate, round_even(se, 6) as se,
        round_even(estimate - {z} * se, 6) as lower, round_even(estimate + {z} * se, 6) as upper from fitted where term is not null"""


def effects_sql(sql: str, column: str) -> str:
    """Effects of one factor as ``ranef`` gives them."""
    return f"{sql} select factor, level, coef, round_even(estimate, 6) as estimate, round_even(se, 6) as se from fitted where factor = '{column}'"
