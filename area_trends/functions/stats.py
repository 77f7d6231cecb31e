"""Straight-line fit from aggregated moments, with standard error and p-value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_sided_t_tail(t: str, df: str) -> Column:
    """P(|T| > |t|) for whole-numbered degrees of freedom; both arguments name columns.

    Up to |t| = 5 one minus the finite trigonometric series of Abramowitz and Stegun
    26.7.3 and 26.7.4, of df / 2 terms. Beyond, where that difference would lose its
    digits, the tail itself: the incomplete beta function as a series of positive terms.
    """
    odd = f"({df} % 2 = 1)"
    theta = f"atan(abs({t}) / sqrt(CAST({df} AS DOUBLE)))"
    first = f"IF({odd}, cos({theta}), 1D)"
    ratio = f"IF({odd}, (2 * k - 2) / (2 * k - 1), (2 * k - 3) / (2 * k - 2))"
    term = f"IF(k = 1, {first}, acc.term * {ratio} * pow(cos({theta}), 2))"
    series = f"""aggregate(
        sequence(1, greatest(1, CAST({df} DIV 2 AS INT))),
        named_struct('total', 0D, 'term', 0D),
        (acc, k) -> named_struct('total', acc.total + {term}, 'term', {term}),
        acc -> acc.total)"""
    series = f"IF({df} >= 2, {series}, 0D)"
    inside = f"IF({odd}, ({theta} + sin({theta}) * {series}) * 2 / pi(), sin({theta}) * {series})"
    near = f"greatest(0D, least(1D, 1D - {inside}))"
    a, x = f"({df} / 2D)", f"({df} / ({df} + {t} * {t}))"
    # Gamma(a + 1/2) / (Gamma(a) sqrt(pi)), up from df = 1 or 2
    scale = f"""aggregate(
        sequence(1, greatest(1, CAST(({df} - 1) DIV 2 AS INT))), IF({odd}, 1 / pi(), 0.5D),
        (acc, k) -> acc * IF({df} <= 2, 1D, IF({odd}, 2D * k / (2 * k - 1), (2D * k + 1) / (2 * k))))"""
    terms = f"sequence(0, CAST(least(100000, 20 - 40 / ln({x})) AS INT))"
    rest = f"""aggregate(
        {terms}, named_struct('total', 0D, 'term', 1D),
        (acc, k) -> named_struct('total', acc.total + acc.term,
                                 'term', acc.term * ({a} + 0.5D + k) / ({a} + 1D + k) * {x}),
        acc -> acc.total)"""
    far = f"exp({a} * ln({x})) * abs({t}) / sqrt({df} + {t} * {t}) * {scale} / {a} * {rest}"
    return F.expr(f"IF(abs({t}) <= 5, {near}, {far})")


def fit_moments(x: Column, y: Column) -> list[Column]:
    """Aggregates from which `with_fit` derives a fit; all combine map-side."""
    return [
        F.count(F.lit(1)).alias("n_obs"),
        F.count(y).alias("_n_y"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.regr_syy(y, x).alias("_syy"),
        F.avg(x).alias("_x_mean"),
        F.avg(y).alias("_y_mean"),
        F.min(x).alias("_x_min"),
        F.max(x).alias("_x_max"),
    ]


def with_fit(moments: DataFrame) -> DataFrame:
    """Adds slope, intercept at the smallest x, standard error and p-value.

    A missing y anywhere in the group leaves all four null. Two rows fit exactly:
    their error is 0, and p is 0 unless the line is flat.
    """
    steps = {
        "_df": "n_obs - 2",
        "_fits": "_n_y = n_obs AND _sxx > 0",
        "slope": "IF(_n_y = n_obs, try_divide(_sxy, _sxx), NULL)",
        "_r": "IF(_syy = 0, 0D, greatest(-1D, least(1D, try_divide(_sxy, sqrt(_sxx * _syy)))))",
    }
    later = {
        "intercept": "_y_mean + slope * (_x_min - _x_mean)",
        "se": "CASE WHEN NOT _fits THEN NULL WHEN _df = 0 THEN 0D "
        "ELSE sqrt(try_divide((1 - _r * _r) * _syy, _sxx * _df)) END",
        "_t": "abs(_r) * sqrt(try_divide(CAST(_df AS DOUBLE), (1 - _r) * (1 + _r)))",
    }
    fitted = moments.withColumns({n: F.expr(e) for n, e in steps.items()})
    fitted = fitted.withColumns({n: F.expr(e) for n, e in later.items()})
    p = (
        F.when(F.expr("NOT _fits"), None)
        .when(F.expr("_syy = 0"), 1.0)
        .when(F.expr("_df = 0 OR abs(_r) = 1"), 0.0)
        .otherwise(two_sided_t_tail("_t", "_df"))
    )
    return fitted.withColumn("p_value", p)
