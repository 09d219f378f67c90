"""Seasonal signal of log-normalised flow, by a Fourier fit on whole years.

With N days that hold Y whole years, the annual bin is Y and its harmonics are
2Y, 3Y, ...; on N days these are orthogonal, so each coefficient is one grouped
sum and the noise power follows from the total variance (Parseval).  No full
transform is needed except for the spectrum itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverspark.columns import as_list, join_groups
from riverspark.functions import row_count
from riverspark.operators.series import SEGMENT, fill_linear
from riverspark.session import cut_lineage

HARMONICS = 3
DAYS_PER_YEAR = 365.25


def prepare_flow(
    df: DataFrame, key: str | Iterable[str], date: str, value: str, max_na: int | None = None
) -> DataFrame:
    """Log-normalised daily series without gaps, with the whole years to fit on.

    Adds ``t`` (day index from 0), ``n_days`` and ``n_years`` of the whole years,
    and ``y`` = log10(value / mean of the key).  Values that are NULL or not
    positive count as missing and are filled on a straight line in ``y``.  Days
    behind the whole years (``t >= n_days``) stay; fits leave them out.  Keys with
    more than ``max_na`` missing days or less than one whole year are dropped.
    """
    keys = as_list(key)
    observed = df.filter(F.col(value) > 0).select(
        *keys, date, F.col(value).alias("_q"), F.log10(value).alias("_log")
    )
    totals = {
        "_start": (F.min(date), F.min),
        "_end": (F.max(date), F.max),
        "_n": (row_count(), F.sum),
        "_total": (F.sum("_q"), F.sum),
    }
    filled = (
        fill_linear(observed, keys, date, "_log", totals)
        .withColumn("_span", F.datediff("_end", "_start") + 1)
        .withColumn("n_years", F.floor(F.col("_span") / DAYS_PER_YEAR).cast("int"))
        .withColumn("n_days", F.floor(F.col("n_years") * DAYS_PER_YEAR).cast("int"))
        .withColumn("t", F.datediff(date, "_start"))
        .filter(F.col("n_days") > 0)
    )
    if max_na is not None:
        filled = filled.filter(F.col("_span") - F.col("_n") <= max_na)
    return filled.select(
        *keys,
        date,
        "t",
        "n_days",
        "n_years",
        (F.col("_log") - F.log10(F.col("_total") / F.col("_n"))).alias("y"),
        "observed",
        SEGMENT,
    )


def _angle(k: int):
    return F.lit(2.0 * math.pi * k) * F.col("n_years") * F.col("t") / F.col("n_days")


def fourier_terms(
    prepared: DataFrame,
    key: str | Iterable[str],
    harmonics: int = HARMONICS,
    per_segment: bool = False,
) -> DataFrame:
    """Coefficients ``a1, c1, a2, ...``, mean and population variance of ``y`` per key.

    ``per_segment`` repeats a key's row for each segment of its record, for joins
    that must not gather a whole key.
    """
    keys = as_list(key)
    # Days behind the whole years count in no sum.
    y = F.when(F.col("t") < F.col("n_days"), F.col("y"))
    waves = {
        f"{c}{k}": F.sum(y * wave(_angle(k)))
        for k in range(1, harmonics + 1)
        for c, wave in (("a", F.cos), ("c", F.sin))
    }
    if per_segment:
        whole = Window.partitionBy(*keys)
        parts = prepared.groupBy(*keys, SEGMENT).agg(
            F.max("n_days").alias("n_days"),
            F.sum(y).alias("mean_y"),
            *(e.alias(name) for name, e in waves.items()),
        )
        sums = parts.select(
            *keys,
            SEGMENT,
            "n_days",
            (F.sum("mean_y").over(whole) / F.col("n_days")).alias("mean_y"),
            *(F.sum(name).over(whole).alias(name) for name in waves),
        )
        kept = [*keys, SEGMENT, "mean_y"]
    else:
        sums = prepared.groupBy(*keys).agg(
            F.max("n_days").alias("n_days"),
            F.max("n_years").alias("n_years"),
            F.avg(y).alias("mean_y"),
            F.var_pop(y).alias("var_y"),
            *(e.alias(name) for name, e in waves.items()),
        )
        kept = [*keys, "n_days", "n_years", "mean_y", "var_y"]
    two_over_n = F.lit(2.0) / F.col("n_days")
    return sums.select(*kept, *((two_over_n * F.col(name)).alias(name) for name in waves))


def seasonal_signal(
    prepared: DataFrame, key: str | Iterable[str], date: str, harmonics: int = HARMONICS
) -> DataFrame:
    """Fitted seasonal value ``pred`` and anomaly ``resid`` per day.

    The fit is defined for every day; the anomaly is NULL on days that were filled.
    """
    keys = as_list(key)
    terms = fourier_terms(prepared, keys, harmonics, per_segment=True)
    fit = F.col("mean_y")
    for k in range(1, harmonics + 1):
        fit = fit + F.col(f"a{k}") * F.cos(_angle(k)) + F.col(f"c{k}") * F.sin(_angle(k))
    return (
        join_groups(prepared, terms, [*keys, SEGMENT])
        .withColumn("pred", fit)
        .select(
            *keys,
            date,
            F.year(date).alias("year"),
            F.dayofyear(date).alias("jday"),
            "y",
            "pred",
            F.when(F.col("observed"), F.col("y") - F.col("pred")).alias("resid"),
            "observed",
        )
    )


def spectral_metrics(
    prepared: DataFrame, key: str | Iterable[str], harmonics: int = HARMONICS
) -> DataFrame:
    """``rms_signal``, ``rms_noise`` and ``snr`` = 20 ln(signal / noise) per key."""
    terms = fourier_terms(prepared, key, harmonics)
    power = sum(
        ((F.col(f"a{k}") * F.col(f"a{k}") + F.col(f"c{k}") * F.col(f"c{k}")) / 2)
        for k in range(1, harmonics + 1)
    )
    noise_bins = F.floor((F.col("n_days") - 1) / 2) - harmonics
    return (
        terms.withColumn("_power", power)
        .withColumn("rms_signal", F.sqrt(F.col("_power") / harmonics))
        .withColumn(
            "rms_noise",
            F.sqrt(F.greatest(F.col("var_y") - F.col("_power"), F.lit(0.0)) / noise_bins),
        )
        .select(
            *as_list(key),
            "n_days",
            "n_years",
            "rms_signal",
            "rms_noise",
            (F.ln(F.try_divide("rms_signal", "rms_noise")) * 20).alias("snr"),
        )
    )


def spectrum(prepared: DataFrame, key: str, whole_days: int = 100_000) -> DataFrame:
    """Amplitude of every frequency bin per key.

    A group is one gap-free daily series, so it has at most one row per calendar
    day (366 per year) however many raw rows stood behind it.  A series of more than
    ``whole_days`` days is never held by one task: it is dealt out in columns, and
    transformed by columns and rows (``_columns``).
    """
    kind = prepared.schema[key].dataType.simpleString()
    rows = prepared.filter("t < n_days").select(F.col(key).alias("key"), "t", "n_days", "n_years", "y")
    across = F.pow(F.lit(2), F.ceil(F.ceil(F.log2(F.col("n_days") * 2 - 1)) / 2)).cast("int")
    rows = rows.withColumn("_across", F.when(F.col("n_days") > whole_days, across).otherwise(1))
    rows = rows.withColumn("_place", F.col("t") % F.col("_across"))
    same = ["key", "n_days", "n_years", "_across"]
    shape = f"key {kind}, n_days int, n_years int, _across int, _place int, _row int, re double, im double, bre double, bim double"
    first = cut_lineage(rows.groupBy(*same, "_place").applyInArrow(_columns, shape))
    short, long = first.filter("_across = 1"), first.filter("_across > 1")
    found = short.select("key", "n_days", "n_years", F.col("_row").alias("bin"), F.col("re").alias("size"))
    if not long.isEmpty():
        turned = [*same, F.col("_row").alias("_place"), F.col("_place").alias("_row"), "re", "im", "bre", "bim"]
        product = long.select(*turned).groupBy(*same, "_place").applyInArrow(_rows_multiplied, shape)
        last = product.select(*turned).groupBy(*same, "_place").applyInArrow(
            _columns_back, f"key {kind}, n_days int, n_years int, bin int, size double"
        )
        found = found.unionByName(last)
    n = F.col("n_days")
    scale = F.when(F.col("bin") * 2 == n, 1.0).otherwise(2.0) / n
    return found.select(
        F.col("key").alias(key), "bin", (F.col("bin") / F.col("n_years")).alias("per_year"), (F.col("size") * scale).alias("amplitude")
    )


def _chirp(t: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi t^2 / n), the angle reduced in whole numbers."""
    return np.exp(1j * np.pi * (t.astype(np.int64) ** 2 % (2 * n)) / n)


def _shape(key) -> tuple[int, int, int, int]:
    """Days, columns and rows of the padded table, and the column or row this group holds."""
    n, across, place = (key[i].as_py() for i in (1, 3, 4))
    padded = 1 << (2 * n - 2).bit_length()
    return n, across, padded // across, place


def _entries(key, place, row, *parts: np.ndarray) -> pa.Table:
    """A group's rows for the next shuffle; absent parts are zero."""
    size = len(row)
    table = {name: pa.repeat(key[i], size) for i, name in enumerate(("key", "n_days", "n_years", "_across"))}
    table |= {"_place": pa.array(np.full(size, place, np.int32)), "_row": pa.array(row.astype(np.int32))}
    values = [np.zeros(size)] * 4
    values[: 2 * len(parts)] = [x for part in parts for x in (part.real, part.imag)]
    return pa.table(table | dict(zip(("re", "im", "bre", "bim"), map(pa.array, values))))


def _columns(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A short series whole; else one column of a long one.

    For a long series of n days the transform is a convolution with a chirp, so any
    n will do: values times a chirp are padded to a power of two and laid out in
    rows of ``_across``.  Transforms of columns, a turn of each entry, and transforms
    of rows give the transform of the whole; the same for the chirp.
    """
    n, across, down, place = _shape(key)
    table = table.sort_by("t")
    t, y = table["t"].to_numpy(), table["y"].to_numpy()
    if across == 1:
        size = np.abs(np.fft.rfft(y)[1:])
        return _entries(key, place, np.arange(1, len(size) + 1), size)
    values = np.zeros(down, complex)
    values[t // across] = y * _chirp(t, n).conj()
    at = np.arange(down, dtype=np.int64) * across + place
    back = down * across - at
    chirp = np.where(at < n, _chirp(np.minimum(at, n), n), np.where(back < n, _chirp(np.minimum(back, n), n), 0))
    turn = np.exp(-2j * np.pi * np.arange(down) * place / (down * across))
    return _entries(key, place, np.arange(down), np.fft.fft(values) * turn, np.fft.fft(chirp) * turn)


def _in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.sort_by("_row")
    re, im, bre, bim = (table[c].to_numpy() for c in ("re", "im", "bre", "bim"))
    return re + 1j * im, bre + 1j * bim


def _rows_multiplied(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row of both transforms, their product, and the first half of the way back."""
    _, across, down, row = _shape(key)
    values, chirp = _in_order(table)
    product = np.fft.ifft(np.fft.fft(values) * np.fft.fft(chirp))
    turn = np.exp(2j * np.pi * np.arange(across) * row / (down * across))
    return _entries(key, row, np.arange(across), product * turn)


def _columns_back(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One column of the convolution: sizes of the bins in it, whose phases do not matter."""
    n, across, down, place = _shape(key)
    size = np.abs(np.fft.ifft(_in_order(table)[0]))
    bins = np.arange(down) * across + place
    kept = (bins >= 1) & (bins <= n // 2)
    same = {name: pa.repeat(key[i], int(kept.sum())) for i, name in enumerate(("key", "n_days", "n_years"))}
    return pa.table(same | {"bin": pa.array(bins[kept].astype(np.int32)), "size": pa.array(size[kept])})


def seasonal_flag(spectra: DataFrame, key: str, top: int = 5) -> DataFrame:
    """J6: "yes" when the annual or half-year bin is among the ``top`` strongest bins."""
    strongest = Window.partitionBy(key).orderBy(F.col("amplitude").desc(), "bin")
    return (
        spectra.withColumn("_rank", F.row_number().over(strongest))
        .filter(F.col("_rank") <= top)
        .groupBy(key)
        .agg(F.bool_or(F.col("per_year").isin(1.0, 2.0)).alias("_hit"))
        .select(key, F.when(F.col("_hit"), "yes").otherwise("no").alias("seasonal"))
    )


def seasonal_peak(signal: DataFrame, key: str | Iterable[str], digits: int = 9) -> DataFrame:
    """Day of the year of the highest fitted value; the earliest day wins ties.

    Values are compared after rounding, as equal phases of different years differ
    only by floating-point noise.
    """
    best = F.struct(F.round("pred", digits).alias("p"), (-F.col("jday")).alias("j"))
    return signal.groupBy(*as_list(key)).agg(F.max_by("jday", best).alias("peak"))
