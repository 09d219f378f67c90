"""Principal components of standardised columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PcaModel:
    """Centre, scale and loadings; columns of ``loadings`` are the components."""

    columns: tuple[str, ...]
    means: np.ndarray
    deviations: np.ndarray
    eigenvalues: np.ndarray
    loadings: np.ndarray
    n: int


def pca_fit(df: DataFrame, columns: Sequence[str]) -> PcaModel:
    """K2: one pass for means, deviations and correlations of complete rows.

    Only that one row of p(p+3)/2 numbers reaches the driver, where the p by p
    matrix is decomposed.  The largest loading of each component is positive.
    """
    names = list(columns)
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i)]
    row = (
        df.select(*(F.col(c).cast("double").alias(c) for c in names))
        .dropna()
        .agg(
            F.count(F.lit(1)),
            *(F.avg(c) for c in names),
            *(F.stddev_samp(c) for c in names),
            *(F.corr(names[i], names[j]) for i, j in pairs),
        )
        .first()
    )
    matrix = np.eye(p)
    for (i, j), r in zip(pairs, row[1 + 2 * p :]):
        matrix[i, j] = matrix[j, i] = r
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    strongest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[strongest, range(p)])
    return PcaModel(
        tuple(names),
        np.array(row[1 : 1 + p]),
        np.array(row[1 + p : 1 + 2 * p]),
        values,
        vectors,
        row[0],
    )


def pca_scores(model: PcaModel, df: DataFrame, k: int | None = None, prefix: str = "dim") -> DataFrame:
    """K3: add component scores as native expressions; rows with NULL inputs get NULL."""
    scores = {}
    for d in range(k or len(model.columns)):
        terms = [
            (F.col(c) - float(m)) * float(model.loadings[i, d] / s)
            for i, (c, m, s) in enumerate(zip(model.columns, model.means, model.deviations))
        ]
        scores[f"{prefix}{d + 1}"] = sum(terms[1:], terms[0])
    return df.withColumns(scores)


def _per_variable(spark: SparkSession, model: PcaModel, matrix: np.ndarray) -> DataFrame:
    names = [f"dim{d + 1}" for d in range(matrix.shape[1])]
    rows = [(c, *map(float, matrix[i])) for i, c in enumerate(model.columns)]
    return spark.createDataFrame(rows, "variable string, " + ", ".join(f"{n} double" for n in names))


def pca_contrib(spark: SparkSession, model: PcaModel) -> DataFrame:
    """K4: contribution of each variable to each component in per cent."""
    return _per_variable(spark, model, 100 * model.loadings**2)


def pca_coords(spark: SparkSession, model: PcaModel) -> DataFrame:
    """K4: correlation of each variable with each component."""
    return _per_variable(spark, model, model.loadings * np.sqrt(np.maximum(model.eigenvalues, 0)))


def pca_variance(spark: SparkSession, model: PcaModel) -> DataFrame:
    """K5: eigenvalue and share of variance per component."""
    share = model.eigenvalues / model.eigenvalues.sum()
    rows = [(d + 1, float(e), float(s)) for d, (e, s) in enumerate(zip(model.eigenvalues, share))]
    return spark.createDataFrame(rows, "component int, eigenvalue double, share double")
