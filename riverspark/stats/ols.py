"""Ordinary least squares with factor by covariate interactions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.columns import as_list
from riverspark.session import cut_lineage
from riverspark.stats.distributions import t_p_value, t_quantile, t_two_sided

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class OlsModel:
    """Estimates with their covariance matrix."""

    terms: tuple[str, ...]
    estimates: np.ndarray
    covariance: np.ndarray
    dof: int
    sigma2: float
    n: int


def design(
    covariates: Sequence[str], factor: str | None = None, levels: Sequence[str] = ()
) -> dict[str, Column]:
    """Design columns: intercept, factor levels, covariates, interactions.

    ``levels`` lists the factor's levels; the first one is the reference.
    """
    dummies = {
        f"{factor}[{level}]": (F.col(factor) == level).cast("double") for level in levels[1:]
    }
    columns: dict[str, Column] = {INTERCEPT: F.lit(1.0)} | dummies
    columns |= {c: F.col(c) for c in covariates}
    for name, dummy in dummies.items():
        columns |= {f"{c}:{name}": dummy * F.col(c) for c in covariates}
    return columns


def _inputs(
    df: DataFrame, ys: Sequence[str], covariates: Sequence[str], factor: str | None, levels: Sequence[str]
) -> DataFrame:
    """``_response``, ``_y``, the factor and the covariates of complete rows, one row per response.

    Fails on a factor level that is not listed.
    """
    responses = F.array(*(F.struct(F.lit(y).alias("_response"), F.col(y).cast("double").alias("_y")) for y in ys))
    rows = df.select(
        *as_list(factor), *(F.col(c).cast("double").alias(c) for c in covariates), F.inline(responses)
    ).dropna()
    if factor:
        message = F.concat(F.lit(f"level of {factor} not listed: "), F.col(factor).cast("string"))
        known = F.when(F.col(factor).isin(*levels), True).otherwise(F.raise_error(message).cast("boolean"))
        rows = rows.filter(known)
    return rows


def _products(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Sums of products of all columns per response, as (_response, row, column, value)."""
    names = list(columns)
    wide = rows.select("_response", *(c.alias(f"_{i}") for i, c in enumerate(columns.values())))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = wide.groupBy("_response").agg(
        *(F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"s{i}_{j}") for i, j in pairs)
    )
    entries = [
        F.struct(
            F.lit(names[i]).alias("row"),
            F.lit(names[j]).alias("column"),
            F.col(f"s{i}_{j}").alias("value"),
        )
        for i, j in pairs
    ]
    return sums.select("_response", F.inline(F.array(*entries)))


def _merged(blocks: list[np.ndarray], width: int) -> np.ndarray:
    """Triangular factor of stacked blocks; no product of columns is formed, so no digits go with their squares."""
    return np.linalg.qr(np.vstack([np.zeros((0, width)), *blocks]), mode="r")


def triangles(rows: DataFrame, columns: dict[str, Column], fan_in: int = 32) -> dict[str, np.ndarray]:
    """Triangular factor of the matrix of all columns, per response.

    A task reduces its rows to one factor, and factors are merged in a tree of
    ``fan_in``; the driver sees one p by p factor per response.
    """
    width = len(columns)
    matrix = rows.select("_response", F.array(*(c.cast("double") for c in columns.values())).alias("_rows"))
    schema = "_response string, _rows array<double>"

    def entries(found: dict[str, np.ndarray]) -> pa.Table:
        flat = pa.array([r.ravel().tolist() for r in found.values()], pa.list_(pa.float64()))
        return pa.table({"_response": pa.array(list(found), pa.string()), "_rows": flat})

    def local(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            values = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for code, name in enumerate(names.dictionary.to_pylist()):
                mine = values[names.indices.to_numpy() == code]
                found[name] = _merged([*([found[name]] if name in found else []), mine], width)
        yield from entries(found).to_batches()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks = [np.reshape(v, (-1, width)) for v in table.column("_rows").to_pylist()]
        merged = entries({key[0].as_py(): _merged(blocks, width)})
        return merged.append_column("_part", pa.array([key[1].as_py()], pa.int32()))

    parts = cut_lineage(matrix.mapInArrow(local, schema).withColumn("_part", F.spark_partition_id()))
    while (parts.groupBy("_response").count().agg(F.max("count")).first()[0] or 0) > 1:
        numbered = parts.withColumn("_part", F.floor(F.col("_part") / fan_in).cast("int"))
        parts = cut_lineage(numbered.groupBy("_response", "_part").applyInArrow(merge, schema + ", _part int"))
    return {r["_response"]: np.reshape(r["_rows"], (-1, width)) for r in parts.collect()}


def normal_equations(
    df: DataFrame,
    y: str,
    covariates: Sequence[str],
    factor: str | None = None,
    levels: Sequence[str] = (),
) -> DataFrame:
    """All sums of products as (row, column, value), from one pass.

    The response appears as row and column ``y``.  Rows with a NULL are left out;
    a level that is not listed is an error.
    """
    rows = _inputs(df, [y], covariates, factor, levels)
    return _products(rows, design(covariates, factor, levels) | {"y": F.col("_y")}).drop("_response")


def ols_fits(
    df: DataFrame,
    ys: Sequence[str],
    covariates: Sequence[str],
    factor: str | None = None,
    levels: Sequence[str] = (),
) -> dict[str, OlsModel]:
    """One fit per response, all from the same two passes.

    The first pass takes the means of complete rows, the second a triangular factor
    of the centred columns, so that neither large means nor nearly collinear
    covariates cost digits.  The driver solves p by p systems and moves the
    intercepts back.  Terms without rows, and terms that others determine, are errors.
    """
    terms = list(design(covariates, factor, levels))
    position = {t: i for i, t in enumerate(terms)}
    p = len(terms)
    rows = _inputs(df, ys, covariates, factor, levels)
    means = rows.groupBy("_response").agg(
        F.count("*").alias("_n"),
        F.avg("_y").alias("_mean_y"),
        *(F.avg(c).alias(f"_mean_{i}") for i, c in enumerate(covariates)),
    )
    found = {r["_response"]: r for r in means.collect()}
    for y in ys:
        if y not in found:
            raise ValueError(f"no complete rows for {y}")

    def mean_of(name: str) -> Column:
        """The response's own mean as a constant: a join on so few responses would gather all rows of one."""
        return F.element_at(F.create_map(*(F.lit(x) for y in found for x in (y, found[y][name]))), F.col("_response"))

    centred = rows.withColumns({c: F.col(c) - mean_of(f"_mean_{i}") for i, c in enumerate(covariates)})
    factors = triangles(centred, design(covariates, factor, levels) | {"y": F.col("_y") - mean_of("_mean_y")})
    models = {}
    for y in ys:
        triangle, mean, n = factors[y], found[y], found[y]["_n"]
        length = np.sqrt((triangle[:, :p] ** 2).sum(axis=0))
        absent = [t for t, d in zip(terms, length) if d <= 0]
        if absent or n <= p:
            raise ValueError(f"{y}: {n} rows for {p} terms, none for {absent}")
        own = triangle[:p, :p]
        dependent = [t for t, d in zip(terms, np.abs(np.diag(own)) / length) if d < 1e-13]
        if dependent:
            raise ValueError(f"{y}: {dependent} follow from the terms before them")
        root = np.linalg.solve(own, np.eye(p))
        inverse = root @ root.T
        estimates = root @ triangle[:p, p]
        sigma2 = float((triangle[p:, p] ** 2).sum()) / (n - p)
        # Intercepts at zero instead of the means of the covariates.
        move = np.eye(p)
        for k, c in enumerate(covariates):
            move[0, position[c]] = -mean[f"_mean_{k}"]
            for name in (t for t in terms if factor and t.startswith(f"{factor}[")):
                move[position[name], position[f"{c}:{name}"]] = -mean[f"_mean_{k}"]
        estimates = move @ estimates
        estimates[0] += mean["_mean_y"]
        models[y] = OlsModel(tuple(terms), estimates, sigma2 * move @ inverse @ move.T, n - p, sigma2, n)
    return models


def ols_fit(
    df: DataFrame,
    y: str,
    covariates: Sequence[str],
    factor: str | None = None,
    levels: Sequence[str] = (),
) -> OlsModel:
    """Fit of one response; see :func:`ols_fits`."""
    return ols_fits(df, [y], covariates, factor, levels)[y]


def ols_table(spark: SparkSession, model: OlsModel, level: float = 0.95) -> DataFrame:
    """Estimate, standard error, t, p and confidence limits per term."""
    errors = np.sqrt(np.diag(model.covariance))
    t = model.estimates / errors
    p = t_two_sided(t, model.dof)
    half = t_quantile(0.5 + level / 2, model.dof) * errors
    rows = [
        tuple([term, *map(float, values)])
        for term, *values in zip(
            model.terms, model.estimates, errors, t, p, model.estimates - half, model.estimates + half
        )
    ]
    return spark.createDataFrame(
        rows, "term string, estimate double, se double, t double, p double, lower double, upper double"
    )


def ols_covariance(spark: SparkSession, model: OlsModel) -> DataFrame:
    """Covariance of the estimates in long form."""
    rows = [
        (a, b, float(model.covariance[i, j]))
        for i, a in enumerate(model.terms)
        for j, b in enumerate(model.terms)
    ]
    return spark.createDataFrame(rows, "row string, column string, value double")


def linear_combo_ci(
    model: OlsModel, first: str, second: str, level: float = 0.95
) -> tuple[float, float, float]:
    """Sum of two coefficients with its confidence limits."""
    i, j = model.terms.index(first), model.terms.index(second)
    estimate = model.estimates[i] + model.estimates[j]
    variance = model.covariance[i, i] + model.covariance[j, j] + 2 * model.covariance[i, j]
    half = float(t_quantile(0.5 + level / 2, model.dof)) * np.sqrt(variance)
    return float(estimate), float(estimate - half), float(estimate + half)


def group_slopes(
    spark: SparkSession,
    model: OlsModel,
    covariates: Sequence[str],
    factor: str,
    levels: Sequence[str],
    level: float = 0.95,
) -> DataFrame:
    """Slope of each covariate within each factor level, with limits."""
    half = float(t_quantile(0.5 + level / 2, model.dof))
    rows = []
    for c in covariates:
        i = model.terms.index(c)
        error = float(np.sqrt(model.covariance[i, i]))
        slope = float(model.estimates[i])
        rows.append((levels[0], c, slope, slope - half * error, slope + half * error))
        for name in levels[1:]:
            rows.append((name, c, *linear_combo_ci(model, c, f"{c}:{factor}[{name}]", level)))
    return spark.createDataFrame(
        rows, f"{factor} string, term string, estimate double, lower double, upper double"
    )


def ols_simple_by_group(df: DataFrame, y: str, x: str, by: str | Sequence[str]) -> DataFrame:
    """One-covariate fit per group with standard error, t and p."""
    fits = df.groupBy(*as_list(by)).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    residual = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    error = F.sqrt(F.try_divide(F.try_divide(residual, F.col("n") - 2), F.col("_sxx")))
    return (
        fits.withColumn("se", error)
        .withColumn("t", F.try_divide("slope", "se"))
        .withColumn("p", t_p_value("t", F.col("n") - 2))
        .drop("_sxx", "_syy", "_sxy")
    )
