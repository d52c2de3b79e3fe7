"""Model fits and comparisons over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import numeric
from emberline.models import compare, grid, joint
from emberline.models import fit as models
from emberline.operators import survey
from emberline.operators.encode import Formula
from emberline.plans import linkage
from emberline.session import materialize, scratch_path
from emberline.sources.tables import save_fit

from .newton import Group, coefficients_sql, effects_sql, mode_sql
from .standins import table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df, *cols, n=6):
    return df.withColumns({c: numeric.round_even(c, n) for c in cols})


def logit(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id").withColumn("size", F.log1p("n_chars") - 6)
    formula = grid.resolve_levels(Formula("quality", ["lang", "size"], {"lang": ()}, ("source",)), docs)
    return models.fit(rows, formula, "bernoulli", keep=["doc_id"])


@query
def fit_logit(spark, sf):
    return models.coef_table(logit(spark, sf))


@query
def ranef(spark, sf):
    return models.ranef(logit(spark, sf), "source")


@query
def fit_negbin(spark, sf):
    customers = table(spark, sf, "customer")
    days = F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")) + 1
    counts = (
        table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n"), F.ln(days.cast("double")).alias("log_days"))
    )
    rows = counts.join(customers, "c_custkey")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    formula = Formula("n", ["c_mktsegment"], {"c_mktsegment": segments}, ("c_nationkey",), offset="log_days")
    return models.coef_table(models.fit(rows, formula, "negbinomial", keep=["c_custkey"]))


@query
def fit_binom(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    rows = (
        table(spark, sf, "lineitem").groupBy("l_partkey")
        .agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("shipped"))
        .join(parts, "l_partkey")
        .withColumn("size", F.col("p_size") / 10 - 2.5)
    )
    formula = Formula("returned", ["size"], {}, ("p_brand",), trials="shipped")
    return models.coef_table(models.fit(rows, formula, "binomial", models.Priors(b=1.0), keep=["l_partkey"]))


@query
def fit_gauss(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 10000).alias("price"), ((F.col("l_quantity") - 25) / 10).alias("quantity"), "l_suppkey"
    )
    formula = Formula("price", ["quantity"], {}, ("l_suppkey",), slopes={"l_suppkey": "quantity"})
    state = models.fit(rows, formula, "gaussian", models.Priors(b=0.5, intercept=1.0, intercept_df=None))
    tables = save_fit(
        {"coef": models.coef_table(state), "scales": models.scale_table(state)}, scratch_path(spark, "fit")
    )
    scales = tables["scales"].select(F.col("name").alias("term"), F.col("value").alias("estimate"))
    return tables["coef"].unionByName(scales, allowMissingColumns=True)


@query
def loo_psis(spark, sf):
    return compare.loo(models.pointwise(logit(spark, sf), "doc_id", 200))


@query
def ppc(spark, sf):
    return compare.ppc(logit(spark, sf), "doc_id", 10)


def model_data(spark, sf, kinds=("pa", "abundance")):
    """The four tables of the named models, or those of ``kinds``, with the columns that the models read."""
    from .queries import BURNT_INPUT, MODEL_CLEAN, MODEL_INPUT, responses

    clean = materialize(responses(spark, sf, MODEL_INPUT).select(*MODEL_CLEAN), "clean")
    model = survey.model_columns(clean)
    made, out = {"pa": survey.pa_table, "abundance": survey.abundance_table}, {}
    for kind in kinds:
        read = dict.fromkeys([*BURNT_INPUT, "no_fires_model", *survey.MODEL_KEYS, *survey.EFFORT_TERMS[kind]])
        rows, burnt = linkage.burnt_tables(made[kind](model).select(*read), kind)
        out |= {f"{kind}_all": rows, f"{kind}_burnt": materialize(burnt, "burnt")}
    return out


@query
def model_grid(spark, sf):
    """All 18 named models of the presence and abundance tables, at the default tolerances."""
    specs = [s for s in grid.MODELS.values() if s.table.startswith(("pa_", "abundance_"))]
    return grid.run_grid(specs, model_data(spark, sf), scratch_path(spark, "grid"))


@query
def grid_loo(spark, sf):
    """The burnt presence models fitted, scored by leaving rows out, stored, and ranked on the rows that all of them use."""
    names = ["pa_m2", "pa_m3", "pa_m4", "pa_m4_1", "pa_m5", "pa_m6", "pa_m7"]
    burnt = model_data(spark, sf, ["pa"])["pa_burnt"].filter(F.col("no_fires_model").isNotNull())
    # Stored, so the numbers stay.
    burnt = materialize(burnt.withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    fits = grid.fit_grid([grid.MODELS[n] for n in names], {"pa_burnt": burnt}, keep=["row_id"])
    return compare.loo_compare(grid.grid_scores(fits, "row_id", scratch_path(spark, "loo")))


@query
def scale_intervals(spark, sf):
    """Group and residual scales of ``fit_logit`` with intervals."""
    return joint.scale_intervals(logit(spark, sf))


# Fits with given scales, whose mode SQL can find too ----------------------------

EXACT = {"tol": 1e-9}


def crossed(spark, sf):
    """Quality by language and size, with crossed effects of source and of a hash of the id."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id").withColumns(
        {"size": F.log1p("n_chars") - 6, "slot": F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")), "de": (F.col("lang") == "de").cast("int"), "fr": (F.col("lang") == "fr").cast("int")}
    )
    formula = Formula("quality", ["de", "fr", "size"], groups=("source", "slot"))
    return models.fit(rows, formula, "bernoulli", scales={"source": [[0.49]], "slot": [[0.25]]}, **EXACT)


@query
def fit_logit_crossed(spark, sf):
    return _rounded(models.coef_table(crossed(spark, sf)), "estimate", "se", "lower", "upper")


@query
def ranef_crossed(spark, sf):
    return _rounded(models.ranef(crossed(spark, sf), "source"), "estimate", "se")


@query
def fit_negbin_given(spark, sf):
    """Orders of a customer, by segment and nation, over the days between the first and the last one."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.ln((F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")) + 1).cast("double")).alias("log_days")
    )
    rows = counts.join(table(spark, sf, "customer"), "c_custkey").withColumn("building", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    formula = Formula("n", ["building"], groups=("c_nationkey",), offset="log_days")
    return _rounded(models.coef_table(models.fit(rows, formula, "negbinomial", scales={"c_nationkey": [[0.09]]}, shape=2.0, **EXACT)), "estimate", "se", "lower", "upper")


@query
def fit_binom_given(spark, sf):
    """Returned lines of a part, by its size and brand."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    rows = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("shipped"))
    rows = rows.join(parts, "l_partkey").withColumn("size", F.col("p_size") / 10 - 2.5)
    formula = Formula("returned", ["size"], groups=("p_brand",), trials="shipped")
    return _rounded(models.coef_table(models.fit(rows, formula, "binomial", models.Priors(b=1.0), scales={"p_brand": [[0.04]]}, **EXACT)), "estimate", "se", "lower", "upper")


@query
def fit_gauss_given(spark, sf):
    """Price of a line by quantity, with a correlated intercept and slope of each return flag and an effect of each line number."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 10000).alias("price"), ((F.col("l_quantity") - 25) / 10).alias("quantity"), "l_returnflag", "l_linenumber"
    )
    formula = Formula("price", ["quantity"], groups=("l_returnflag", "l_linenumber"), slopes={"l_returnflag": "quantity"})
    priors = models.Priors(b=0.5, intercept=1.0, intercept_df=None)
    state = models.fit(rows, formula, "gaussian", priors, scales={"l_returnflag": [[0.2, 0.05], [0.05, 0.1]], "l_linenumber": [[0.1]]}, shape=0.9, **EXACT)
    return _rounded(models.coef_table(state), "estimate", "se", "lower", "upper")


def _draws(spark, sf, lo, n):
    """Observation id and log likelihoods at draws lo .. lo + n - 1."""
    part = F.slice("embedding", lo + 1, n)
    ll = F.transform(part, lambda v: -F.abs(v.cast("double")))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("obs"), ll.alias("loglik"), "label")


@query
def posterior_summary(spark, sf):
    df = table(spark, sf, "embeddings").select(F.col("label").alias("term"), F.explode("embedding").alias("v"))
    df = df.select("term", F.col("v").cast("double").alias("value"))
    return _rounded(compare.posterior_summary(df), "estimate", "est_error", "q2_5", "q97_5")


@query
def loo_is(spark, sf):
    return _rounded(compare.loo(_draws(spark, sf, 0, 64), smooth=False), "elpd", "p_loo")


@query
def loo_compare(spark, sf):
    scores = {
        "a": compare.loo(_draws(spark, sf, 0, 32), smooth=False),
        "b": compare.loo(_draws(spark, sf, 32, 32), smooth=False),
    }
    return _rounded(compare.loo_compare(scores), "elpd", "se", "elpd_diff", "se_diff")


@query
def bayes_r2(spark, sf):
    df = table(spark, sf, "embeddings").select(
        F.transform("embedding", lambda v: v.cast("double") * 10).alias("fitted"), F.col("label").alias("y")
    )
    return _rounded(compare.bayes_r2(df), "estimate", "est_error", "q2_5", "q97_5")


_LONG = """long as (select vec_id as obs, label, generate_subscripts(embedding, 1) as pos, unnest(embedding) as v from embeddings),
           ll as (select obs, pos, -abs(cast(v as double)) as v from long)"""


def _score(name: str, where: str) -> str:
    return f"""{name} as (select obs, -(ln(avg(exp(-v)))) as elpd, ln(avg(exp(v))) + ln(avg(exp(-v))) as p_loo from ll where {where} group by obs)"""


_CROSSED = mode_sql(
    """select d.doc_id as i, quality as y, 0.0 as off, 1.0 as trials, (lang = 'de')::int as de, (lang = 'fr')::int as fr, ln(1 + n_chars) - 6 as size, source, 's' || (d.doc_id % 7) as slot
       from labels l join documents d using (doc_id) where quality is not null and lang is not null and n_chars is not null and source is not null""",
    ["de", "fr", "size"], [Group("source", ((0.49,),)), Group("slot", ((0.25,),))], "bernoulli",
)

ORACLES = {
    "fit_logit_crossed": coefficients_sql(_CROSSED),
    "ranef_crossed": effects_sql(_CROSSED, "source"),
    "fit_negbin_given": coefficients_sql(mode_sql(
        """select c_custkey as i, n as y, ln(days) as off, 1.0 as trials, (c_mktsegment = 'BUILDING')::int as building, c_nationkey
           from (select o_custkey as c_custkey, count(*) as n, date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 as days from orders group by 1) join customer using (c_custkey)""",
        ["building"], [Group("c_nationkey", ((0.09,),))], "negbinomial", 2.0, steps=14,
    )),
    "fit_binom_given": coefficients_sql(mode_sql(
        """select l_partkey as i, count(*) filter (l_returnflag = 'R') as y, 0.0 as off, count(*) as trials, any_value(p_size) / 10 - 2.5 as size, any_value(p_brand) as p_brand
           from lineitem join part on l_partkey = p_partkey group by l_partkey""",
        ["size"], [Group("p_brand", ((0.04,),))], "binomial", b=1.0,
    )),
    "fit_gauss_given": coefficients_sql(mode_sql(
        """select row_number() over () as i, l_extendedprice / 10000 as y, 0.0 as off, 1.0 as trials, (l_quantity - 25) / 10 as quantity, l_returnflag, l_linenumber from lineitem""",
        ["quantity"], [Group("l_returnflag", ((0.2, 0.05), (0.05, 0.1)), "quantity"), Group("l_linenumber", ((0.1,),))], "gaussian", 0.9, 0.5, 1.0, None, 3,
    )),
    "posterior_summary": """
        with l as (select label as term, cast(unnest(embedding) as double) as v from embeddings)
        select term, count(*) as n_draws, round_even(avg(v), 6) as estimate, round_even(stddev_samp(v), 6) as est_error,
               round_even(quantile_cont(v, 0.025), 6) as q2_5, round_even(quantile_cont(v, 0.975), 6) as q97_5 from l group by 1""",
    "loo_is": f"with {_LONG}, {_score('s', 'true')} select obs, round_even(elpd, 6) as elpd, round_even(p_loo, 6) as p_loo from s",
    "loo_compare": f"""
        with {_LONG}, {_score('a', 'pos <= 32')}, {_score('b', 'pos > 32')},
        t as (select count(*) as n, sum(a.elpd) as sa, sum(b.elpd) as sb, stddev_samp(a.elpd) as da, stddev_samp(b.elpd) as db,
                     stddev_samp(a.elpd - b.elpd) as dd from a join b using (obs))
        select 'a' as model, round_even(sa, 6) as elpd, round_even(sqrt(n) * da, 6) as se, round_even(sa - greatest(sa, sb), 6) as elpd_diff,
               round_even(case when sa >= sb then 0 else sqrt(n) * dd end, 6) as se_diff from t
        union all select 'b', round_even(sb, 6), round_even(sqrt(n) * db, 6), round_even(sb - greatest(sa, sb), 6),
               round_even(case when sa >= sb then sqrt(n) * dd else 0 end, 6) from t""",
    "bayes_r2": """
        with long as (select label as y, generate_subscripts(embedding, 1) as draw, cast(unnest(embedding) as double) * 10 as f from embeddings),
        d as (select draw, var_samp(f) / (var_samp(f) + var_samp(y - f)) as v from long group by 1)
        select 'R2' as term, count(*) as n_draws, round_even(avg(v), 6) as estimate, round_even(stddev_samp(v), 6) as est_error,
               round_even(quantile_cont(v, 0.025), 6) as q2_5, round_even(quantile_cont(v, 0.975), 6) as q97_5 from d""",
}
