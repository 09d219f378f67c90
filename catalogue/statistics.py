"""Queries on standardising, components, permutation tests, regression and contrasts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalogue import register
from catalogue.views import BRAND, brand_series, table
from riverspark.functions import split_composite
from riverspark.operators import clean, reshape
from riverspark.plans import statistics as plans
from riverspark.stats import moments, ols, paired, pca, permanova
from riverspark.stats.holm import holm

XS = [f"x{i}" for i in range(1, 7)]


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        *(F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(XS)),
    )


VECTORS = "vectors AS (SELECT vec_id, label, {} FROM embeddings)".format(
    ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS x{i}" for i in range(1, 7))
)


@register(
    "zscore",
    f"""WITH {VECTORS}
SELECT vec_id, label, {', '.join(f'round((x{i} - AVG(x{i}) OVER ()) / STDDEV_SAMP(x{i}) OVER (), 6) + 0.0 AS x{i}_z' for i in range(1, 7))}
FROM vectors""",
)
def zscore(spark, folder):
    scaled = moments.zscore(vectors(spark, folder), XS)
    return scaled.select("vec_id", "label", *(F.round(f"{x}_z", 6).alias(f"{x}_z") for x in XS))


@register(
    "zscore_by_group",
    """SELECT l_orderkey, l_linenumber, round((l_extendedprice - AVG(l_extendedprice) OVER w)
  / STDDEV_SAMP(l_extendedprice) OVER w, 6) + 0.0 AS price_z
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""",
)
def zscore_by_group(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("price")
    )
    scaled = moments.zscore(lines, ["price"], by="l_returnflag")
    return scaled.select("l_orderkey", "l_linenumber", F.round("price_z", 6).alias("price_z"))


@register(
    "correlations",
    "WITH {} {}".format(
        VECTORS,
        " UNION ALL ".join(
            f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) + 0.0 AS r FROM vectors"
            for a, b in combinations(XS, 2)
        ),
    ),
)
def correlations(spark, folder):
    found = moments.correlations(vectors(spark, folder), XS)
    return found.withColumn("r", F.round("r", 6))


@register("pca_scores")
def pca_scores(spark, folder):
    rows = vectors(spark, folder)
    return pca.pca_scores(pca.pca_fit(rows, XS), rows).select(
        "vec_id", "label", *(f"dim{i}" for i in range(1, 7))
    )


@register(
    "pca_score_norm",
    f"""WITH {VECTORS},
z AS (SELECT vec_id, {', '.join(f'(x{i} - AVG(x{i}) OVER ()) / STDDEV_SAMP(x{i}) OVER () AS z{i}' for i in range(1, 7))}
  FROM vectors)
SELECT vec_id, round({' + '.join(f'z{i} * z{i}' for i in range(1, 7))}, 6) AS norm2 FROM z""",
)
def pca_score_norm(spark, folder):
    """All components together keep each row's squared length."""
    rows = vectors(spark, folder)
    scores = pca.pca_scores(pca.pca_fit(rows, XS), rows)
    squares = sum(F.col(f"dim{i}") * F.col(f"dim{i}") for i in range(1, 7))
    return scores.select("vec_id", F.round(squares, 6).alias("norm2"))


@register("pca_contrib")
def pca_contrib(spark, folder):
    return pca.pca_contrib(spark, pca.pca_fit(vectors(spark, folder), XS))


@register("pca_coords")
def pca_coords(spark, folder):
    return pca.pca_coords(spark, pca.pca_fit(vectors(spark, folder), XS))


@register("pca_variance")
def pca_variance(spark, folder):
    return pca.pca_variance(spark, pca.pca_fit(vectors(spark, folder), XS))


@register(
    "pca_check",
    "SELECT CAST(component AS INT) AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length, "
    "100.0::DOUBLE AS contribution, TRUE AS descending, TRUE AS sign, 1.0::DOUBLE AS score_variance, "
    "0.0::DOUBLE AS score_mean FROM (SELECT UNNEST(range(1, 7)) AS component)",
)
def pca_check(spark, folder):
    """What defines components, measured on the returned tables and on correlations that SQL confirms.

    C v = lambda v, |v| = 1, contributions add up, order, sign rule, and scores of
    variance lambda around zero.
    """
    rows = vectors(spark, folder)
    model = pca.pca_fit(rows, XS)
    dims = [f"dim{i}" for i in range(1, 7)]

    def long(wide, value):
        stacked = reshape.to_long(wide, ["variable"], dims, "dim", value)
        return stacked.withColumn("component", F.substring("dim", 4, 1).cast("int")).drop("dim")

    half = moments.correlations(rows, XS)
    matrix = (
        half.union(half.select("var2", "var1", "r"))
        .union(spark.createDataFrame([(x, x, 1.0) for x in XS], "var1 string, var2 string, r double"))
        .select(F.col("var1").alias("variable"), F.col("var2").alias("other"), "r")
    )
    coords = long(pca.pca_coords(spark, model), "coord")
    product = (
        matrix.join(coords.withColumnRenamed("variable", "other"), "other")
        .groupBy("variable", "component")
        .agg(F.sum(F.col("r") * F.col("coord")).alias("image"))
    )
    variance = pca.pca_variance(spark, model).withColumn("next", F.col("component") + 1)
    later = variance.select(F.col("next").alias("component"), F.col("eigenvalue").alias("before"))
    scores = pca.pca_scores(model, rows).agg(
        *(F.var_samp(d).alias(f"v{d}") for d in dims), *(F.avg(d).alias(f"m{d}") for d in dims)
    )
    moments_ = scores.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(i).alias("component"), F.col(f"v{d}").alias("v"), F.col(f"m{d}").alias("m"))
                    for i, d in enumerate(dims, 1)
                )
            )
        )
    )
    joined = (
        coords.join(product, ["variable", "component"])
        .join(long(pca.pca_contrib(spark, model), "contrib"), ["variable", "component"])
        .join(variance.join(later, "component", "left"), "component")
    )
    return (
        joined.groupBy("component")
        .agg(
            F.round(F.max(F.abs(F.col("image") - F.col("eigenvalue") * F.col("coord"))), 6).alias("residual"),
            F.round(F.sum(F.col("coord") * F.col("coord")) / F.max("eigenvalue"), 6).alias("length"),
            F.round(F.sum("contrib"), 6).alias("contribution"),
            (F.coalesce(F.max("before"), F.lit(1e9)) >= F.max("eigenvalue")).alias("descending"),
            (F.max_by("coord", F.abs("coord")) > 0).alias("sign"),
            F.max("eigenvalue").alias("_e"),
        )
        .join(moments_, "component")
        .select(
            "component", "residual", "length", "contribution", "descending", "sign",
            F.round(F.col("v") / F.col("_e"), 6).alias("score_variance"),
            F.abs(F.round("m", 6)).alias("score_mean"),
        )
    )


RESPONSES = XS[:3]


def _between_sql(name: str, source: str, keys: str, xs=RESPONSES) -> str:
    """Sum of squares between levels per ``keys`` from centred level sums."""
    squares = " + ".join(f"s_{x} * s_{x}" for x in xs)
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"{name} AS (SELECT {by}SUM(({squares}) / k) AS ssb FROM {source} {group})"


def _level_sums_sql(name: str, source: str, keys: str, xs=RESPONSES) -> str:
    sums = ", ".join(f"SUM({x}) AS s_{x}" for x in xs)
    by = f"{keys}, " if keys else ""
    return f"{name} AS (SELECT {by}g, COUNT(*) AS k, {sums} FROM {source} GROUP BY {by}g)"


F_SQL = "(ssb / NULLIF(a - 1, 0)) / NULLIF((ss - ssb) / NULLIF(n - a, 0), 0)"
DF_SQL = """CAST(a - 1 AS INT) AS df_factor, CAST(n - a AS BIGINT) AS df_residual,
  CAST(n - 1 AS BIGINT) AS df_total"""
SS = " + ".join(f"VAR_POP({x})" for x in RESPONSES)
MEANS = ", ".join(f"AVG({x}) AS m_{x}" for x in RESPONSES)
CENTRED = ", ".join(f"{x} - m_{x} AS {x}" for x in RESPONSES)

def _one_family_sql(level: str) -> str:
    return f"""{VECTORS},
fam AS (SELECT COUNT(*) AS n, COUNT(DISTINCT {level}) AS a, COUNT(*) * ({SS}) AS ss, {MEANS} FROM vectors),
c AS (SELECT CAST(vec_id AS VARCHAR) AS id, {level} AS g, {CENTRED} FROM vectors, fam),
{_level_sums_sql('obs', 'c', '')}, {_between_sql('obs_b', 'obs', '')},
f0 AS (SELECT {F_SQL} AS f_stat, {DF_SQL} FROM obs_b, fam)"""


ONE_FAMILY = _one_family_sql("label")


@register("permanova_f", f"WITH {ONE_FAMILY} SELECT df_factor, df_residual, df_total, round(f_stat, 6) AS f_stat FROM f0")
def permanova_f(spark, folder):
    found = permanova.permanova_f(vectors(spark, folder), "label", RESPONSES)
    return found.withColumn("f_stat", F.round("f_stat", 6))


N_PERM = 199


def _permanova_sql(level: str) -> str:
    return f"""WITH {_one_family_sql(level)},
bounds AS (SELECT g, SUM(k) OVER (ORDER BY g) - k AS lo, SUM(k) OVER (ORDER BY g) AS hi FROM obs),
perms AS (SELECT UNNEST(range(1, {N_PERM + 1})) AS perm),
dealt AS (SELECT perm, {', '.join(RESPONSES)}, row_number() OVER (PARTITION BY perm
  ORDER BY md5('0:' || CAST(perm AS VARCHAR) || ':' || id), id) AS place FROM c, perms),
named AS (SELECT d.*, b.g FROM dealt d JOIN bounds b ON place > lo AND place <= hi),
{_level_sums_sql('drawn', 'named', 'perm')}, {_between_sql('drawn_b', 'drawn', 'perm')},
fs AS (SELECT perm, {F_SQL} AS f FROM drawn_b, fam)
SELECT df_factor, df_residual, df_total, round(f_stat, 6) AS f_stat,
  (1 + (SELECT COUNT(*) FROM fs WHERE f >= f_stat - 1.5e-8)) / CAST({N_PERM + 1} AS DOUBLE) AS p_value,
  CAST({N_PERM} AS INT) AS n_perm FROM f0"""


PERMANOVA_P = _permanova_sql("label")


@register("permanova_p", PERMANOVA_P)
def permanova_p(spark, folder):
    found = permanova.permanova(
        vectors(spark, folder), "vec_id", "label", RESPONSES, n_perm=N_PERM, draw="md5"
    )
    return found.withColumn("f_stat", F.round("f_stat", 6))


@register("permanova_p_bucketed", PERMANOVA_P)
def permanova_p_bucketed(spark, folder):
    """Same result by the path for large groups, with buckets small enough to test it."""
    found = permanova.permanova(
        vectors(spark, folder), "vec_id", "label", RESPONSES, n_perm=N_PERM, whole_rows=16, draw="md5"
    )
    return found.withColumn("f_stat", F.round("f_stat", 6))


PAIR_PERM = 99
PAIRWISE = f"""{VECTORS},
levels AS (SELECT DISTINCT label FROM vectors),
members AS (SELECT a.label AS var1, b.label AS var2, v.vec_id, v.label, {', '.join(RESPONSES)}
  FROM levels a JOIN levels b ON a.label < b.label JOIN vectors v ON v.label IN (a.label, b.label)),
fam AS (SELECT var1, var2, COUNT(*) AS n, COUNT(DISTINCT label) AS a, COUNT(*) * ({SS}) AS ss, {MEANS}
  FROM members GROUP BY 1, 2),
c AS (SELECT var1, var2, CAST(vec_id AS VARCHAR) AS id, label AS g, {CENTRED}
  FROM members JOIN fam USING (var1, var2)),
{_level_sums_sql('obs', 'c', 'var1, var2')}, {_between_sql('obs_b', 'obs', 'var1, var2')},
f0 AS (SELECT var1, var2, {F_SQL} AS f_stat, {DF_SQL} FROM obs_b JOIN fam USING (var1, var2)),
bounds AS (SELECT var1, var2, g, SUM(k) OVER w - k AS lo, SUM(k) OVER w AS hi FROM obs
  WINDOW w AS (PARTITION BY var1, var2 ORDER BY g)),
perms AS (SELECT UNNEST(range(1, {PAIR_PERM + 1})) AS perm),
dealt AS (SELECT var1, var2, perm, {', '.join(RESPONSES)}, row_number() OVER (PARTITION BY var1, var2, perm
  ORDER BY md5('0:' || CAST(perm AS VARCHAR) || ':' || id), id) AS place FROM c, perms),
named AS (SELECT d.*, b.g FROM dealt d JOIN bounds b
  ON b.var1 = d.var1 AND b.var2 = d.var2 AND place > lo AND place <= hi),
{_level_sums_sql('drawn', 'named', 'var1, var2, perm')}, {_between_sql('drawn_b', 'drawn', 'var1, var2, perm')},
fs AS (SELECT var1, var2, perm, {F_SQL} AS f FROM drawn_b JOIN fam USING (var1, var2)),
tests AS (SELECT f0.var1, f0.var2, df_factor, df_residual, df_total, f_stat,
    (1 + COUNT(CASE WHEN f >= f_stat - 1.5e-8 THEN 1 END)) / CAST({PAIR_PERM + 1} AS DOUBLE) AS p_value,
    CAST({PAIR_PERM} AS INT) AS n_perm
  FROM f0 JOIN fs ON fs.var1 = f0.var1 AND fs.var2 = f0.var2 GROUP BY ALL)"""
HOLM = """SELECT *, least(1.0, MAX(step) OVER (ORDER BY p_value, k)) AS p_adjusted
  FROM (SELECT *, (COUNT(*) OVER () - k + 1) * p_value AS step FROM
    (SELECT *, row_number() OVER (ORDER BY p_value) AS k FROM {source}))"""


@register(
    "permanova_pairwise",
    f"""WITH {PAIRWISE}, adjusted AS ({HOLM.format(source='tests')})
SELECT var1, var2, df_factor, df_residual, df_total, round(f_stat, 6) AS f_stat, p_value, n_perm,
  round(p_adjusted, 9) AS p_adjusted FROM adjusted""",
)
def permanova_pairwise(spark, folder):
    found = permanova.pairwise_permanova(
        vectors(spark, folder), "vec_id", "label", RESPONSES, n_perm=PAIR_PERM, draw="md5"
    )
    return found.withColumns({"f_stat": F.round("f_stat", 6), "p_adjusted": F.round("p_adjusted", 9)})


@register(
    "holm",
    f"""WITH s AS (SELECT l_suppkey, SUM(l_discount) / COUNT(*) AS p_value FROM lineitem GROUP BY 1),
t AS (SELECT l_suppkey, round(p_value * p_value, 9) AS p_value FROM s),
adjusted AS ({HOLM.format(source='t')})
SELECT l_suppkey, p_value, round(p_adjusted, 9) AS p_adjusted FROM adjusted""",
)
def holm_query(spark, folder):
    p = F.sum("l_discount") / F.count(F.lit(1))
    tests = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey")
        .agg(p.alias("_m"))
        .select("l_suppkey", F.round(F.col("_m") * F.col("_m"), 9).alias("p_value"))
    )
    return holm(tests, "p_value").withColumn("p_adjusted", F.round("p_adjusted", 9))


PERIODS = {"historical": (1995, 1997), "recent": (1999, 2001)}
MEASURES = ["level", "spread", "top"]


def station_periods(spark, folder):
    """Three log-flow measures per station and period; class = first digit of the brand."""
    days = clean.assign_period(
        brand_series(spark, folder).withColumn("year", F.year("date")), "year", PERIODS
    ).withColumn("logq", F.log10("discharge"))
    return days.groupBy("station", "period").agg(
        F.max(F.regexp_extract("station", r"#(\d)", 1)).alias("class"),
        F.avg("logq").alias("level"),
        F.stddev_samp("logq").alias("spread"),
        F.max("logq").alias("top"),
    )


STATION_PERIODS = f"""{BRAND},
logs AS (SELECT station, log10(discharge) AS logq, CASE WHEN year(date) BETWEEN 1995 AND 1997 THEN 'historical'
  WHEN year(date) BETWEEN 1999 AND 2001 THEN 'recent' END AS period FROM s_brand),
station_periods AS (SELECT station, period, regexp_extract(station, '#(\\d)', 1) AS class,
  AVG(logq) AS level, STDDEV_SAMP(logq) AS spread, MAX(logq) AS top
  FROM logs WHERE period IS NOT NULL GROUP BY ALL)"""

M_SS = " + ".join(f"VAR_POP({x})" for x in MEASURES)
M_MEANS = ", ".join(f"AVG({x}) AS m_{x}" for x in MEASURES)
M_CENTRED = ", ".join(f"{x} - m_{x} AS {x}" for x in MEASURES)


def _strata_sql(source: str, by: str) -> str:
    """CTEs that end in ``tested``: permutation within stations, few pairs enumerated."""
    return f"""fam AS (SELECT {by}, COUNT(*) AS n, COUNT(DISTINCT period) AS a, COUNT(*) * ({M_SS}) AS ss, {M_MEANS},
  COUNT(DISTINCT station) AS strata FROM {source} GROUP BY {by}),
c AS (SELECT {by}, station, station || '|' || period AS id, period AS g, strata, {M_CENTRED}
  FROM {source} JOIN fam USING ({by})),
{_level_sums_sql('obs', 'c', by, MEASURES)}, {_between_sql('obs_b', 'obs', by, MEASURES)},
f0 AS (SELECT {by}, strata, {F_SQL} AS f_stat, {DF_SQL} FROM obs_b JOIN fam USING ({by})),
perms AS (SELECT UNNEST(range(0, {N_PERM + 1})) AS perm),
num AS (SELECT {by}, station, row_number() OVER (PARTITION BY {by} ORDER BY station) - 1 AS i
  FROM (SELECT DISTINCT {by}, station FROM c)),
exact_named AS (SELECT {by}, perm, {', '.join(MEASURES)},
    CASE WHEN (perm >> i) & 1 = 1 THEN CASE g WHEN 'recent' THEN 'historical' ELSE 'recent' END ELSE g END AS g
  FROM c JOIN num USING ({by}, station) JOIN perms ON perm < pow(2, strata) WHERE strata <= 7),
drawn_place AS (SELECT {by}, station, perm, {', '.join(MEASURES)},
    row_number() OVER (PARTITION BY {by}, station, perm ORDER BY md5('0:' || CAST(perm AS VARCHAR) || ':' || id), id) AS place
  FROM c JOIN perms ON perm > 0 WHERE strata > 7),
drawn_named AS (SELECT {by}, perm, {', '.join(MEASURES)}, CASE place WHEN 1 THEN 'historical' ELSE 'recent' END AS g
  FROM drawn_place),
named AS (SELECT * FROM exact_named WHERE perm > 0 UNION ALL SELECT * FROM drawn_named),
{_level_sums_sql('per', 'named', f'{by}, perm', MEASURES)}, {_between_sql('per_b', 'per', f'{by}, perm', MEASURES)},
fs AS (SELECT {by}, perm, {F_SQL} AS f FROM per_b JOIN fam USING ({by})),
counts AS (SELECT {by}, COUNT(CASE WHEN f >= f_stat - 1.5e-8 THEN 1 END) AS hits, COUNT(*) AS m
  FROM f0 JOIN fs USING ({by}) GROUP BY {by}),
tested AS (SELECT {by}, df_factor, df_residual, df_total, f_stat,
  CASE WHEN f_stat IS NOT NULL THEN (1 + hits) / CAST(m + 1 AS DOUBLE) END AS p_value,
  CAST(m AS INT) AS n_perm
FROM f0 JOIN counts USING ({by}))"""


@register(
    "permanova_strata",
    f"""WITH {STATION_PERIODS}, {_strata_sql('station_periods', 'class')}
SELECT class, df_factor, df_residual, df_total, round(f_stat, 6) AS f_stat, p_value, n_perm FROM tested""",
)
def permanova_strata(spark, folder):
    found = permanova.permanova_strata(
        station_periods(spark, folder), "period", MEASURES, "station", by="class", n_perm=N_PERM, draw="md5"
    )
    return found.withColumn("f_stat", F.round("f_stat", 6))


T_P = """CASE WHEN df % 2 = 0 THEN 1 - sin(th) * list_sum(list_transform(range(0, CAST(df // 2 AS BIGINT)),
    lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(th), 2 * j)))
  ELSE 1 - 2 / pi() * (th + sin(th) * COALESCE(list_sum(list_transform(range(0, CAST((df - 1) // 2 AS BIGINT)),
    lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(th), 2 * j + 1))), 0)) END"""


#: Upper tail of F: sums of beta terms, onto the tail of t where df1 is odd (th from sqrt(df1 * f)).
F_P = f"""CASE WHEN df1 % 2 = 0 THEN pow(x, a) * list_sum(list_transform(range(0, CAST(df1 // 2 AS BIGINT)),
    lambda j: pow(1 - x, j) * exp(lgamma(a + j) - lgamma(a) - lgamma(j + 1))))
  ELSE {T_P} + COALESCE(list_sum(list_transform(range(0, CAST((df1 - 1) // 2 AS BIGINT)),
    lambda j: exp(a * ln(x) + (j + 0.5) * ln(1 - x) + lgamma(a + j + 0.5) - lgamma(a) - lgamma(j + 1.5)))), 0) END"""


COVARIATES = ["l_quantity", "l_discount", "l_tax"]
FLAGS = ["A", "N", "R"]


def _design_sql() -> dict[str, str]:
    columns = {"(Intercept)": "1.0"}
    dummies = {
        f"l_returnflag[{f}]": f"(CASE WHEN l_returnflag = '{f}' THEN 1.0 ELSE 0.0 END)"
        for f in FLAGS[1:]
    }
    columns |= dummies
    columns |= {c: c for c in COVARIATES}
    columns |= {f"{c}:{name}": f"({d} * {c})" for name, d in dummies.items() for c in COVARIATES}
    return columns | {"y": "l_extendedprice"}


def _gram_sql() -> str:
    names = list(_design_sql().items())
    parts = [
        f"SELECT '{names[i][0]}' AS row, '{names[j][0]}' AS \"column\", "
        f"CAST(SUM({names[i][1]} * {names[j][1]}) AS DOUBLE) AS v FROM lineitem"
        for i in range(len(names))
        for j in range(i + 1)
    ]
    return f"""WITH sums AS ({' UNION ALL '.join(parts)})
SELECT row, "column", CAST(CASE WHEN v = 0 THEN 0 ELSE floor(log10(v)) END AS INT) AS exponent,
  CASE WHEN v = 0 THEN 0.0 ELSE round(v / pow(10, floor(log10(v))), 8) END::DOUBLE AS mantissa FROM sums"""


@register("ols_gram", _gram_sql())
def ols_gram(spark, folder):
    sums = ols.normal_equations(
        table(spark, folder, "lineitem"), "l_extendedprice", COVARIATES, "l_returnflag", FLAGS
    )
    v = F.col("value")
    exponent = F.when(v == 0, 0).otherwise(F.floor(F.log10(v))).cast("int")
    return sums.withColumn("exponent", exponent).select(
        "row",
        "column",
        "exponent",
        F.when(v == 0, 0.0)
        .otherwise(F.round(v / F.pow(F.lit(10.0), F.col("exponent")), 8))
        .alias("mantissa"),
    )


@register(
    "ols_simple_by_group",
    """SELECT l_returnflag, l_linestatus, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity)
    * regr_sxy(l_extendedprice, l_quantity)) / (COUNT(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 4) AS se
FROM lineitem GROUP BY 1, 2""",
)
def ols_simple_by_group(spark, folder):
    fits = ols.ols_simple_by_group(
        table(spark, folder, "lineitem"),
        "l_extendedprice",
        "l_quantity",
        ["l_returnflag", "l_linestatus"],
    )
    return fits.select(
        "l_returnflag", "l_linestatus", "n", *(F.round(c, 4).alias(c) for c in ("slope", "intercept", "se"))
    )


INTERACTION = """g AS (SELECT l_linestatus AS f, COUNT(*) AS n, AVG(l_quantity) AS mx,
  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b,
  regr_intercept(l_extendedprice, l_quantity) AS a,
  regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity)
    * regr_sxy(l_extendedprice, l_quantity) AS rss
  FROM lineitem GROUP BY 1),
s AS (SELECT SUM(rss) / (SUM(n) - 4) AS s2, SUM(n) - 4 AS dof FROM g),
v AS (SELECT f, a, b, s2 * (1.0 / n + mx * mx / sxx) AS va, s2 / sxx AS vb, dof FROM g, s),
w AS (SELECT o.a AS oa, o.b AS ob, o.va AS ova, o.vb AS ovb, r.a AS ra, r.b AS rb, r.va AS rva,
  r.vb AS rvb, r.dof, 1.959963984540054 AS z FROM v o, v r WHERE o.f = 'O' AND r.f = 'F'),
tq AS (SELECT *, z + (z**3 + z) / (4.0 * dof) + (5 * z**5 + 16 * z**3 + 3 * z) / (96.0 * dof * dof) AS q FROM w)"""


@register(
    "ols_table",
    f"""WITH {INTERACTION},
t AS (
  SELECT '(Intercept)' AS term, ra AS estimate, sqrt(rva) AS se, q, dof AS df FROM tq
  UNION ALL SELECT 'l_linestatus[O]', oa - ra, sqrt(ova + rva), q, dof FROM tq
  UNION ALL SELECT 'l_quantity', rb, sqrt(rvb), q, dof FROM tq
  UNION ALL SELECT 'l_quantity:l_linestatus[O]', ob - rb, sqrt(ovb + rvb), q, dof FROM tq)
SELECT term, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate / se, 4) AS t,
  round({T_P}, 6) + 0.0 AS p,
  round(estimate - q * se, 3) AS lower, round(estimate + q * se, 3) AS upper
FROM (SELECT *, atan(abs(estimate / se) / sqrt(df)) AS th FROM t)""",
)
def ols_table(spark, folder):
    lines = table(spark, folder, "lineitem")
    model = ols.ols_fit(lines, "l_extendedprice", ["l_quantity"], "l_linestatus", ["F", "O"])
    return ols.ols_table(spark, model).select(
        "term",
        *(F.round(c, 4).alias(c) for c in ("estimate", "se", "t")),
        (F.round("p", 6) + 0.0).alias("p"),
        *(F.round(c, 3).alias(c) for c in ("lower", "upper")),
    )


@register(
    "ols_group_slopes",
    f"""WITH {INTERACTION},
t AS (SELECT 'F' AS l_linestatus, rb AS estimate, sqrt(rvb) AS se, q FROM tq
  UNION ALL SELECT 'O', ob, sqrt(ovb), q FROM tq)
SELECT l_linestatus, 'l_quantity' AS term, round(estimate, 4) AS estimate,
  round(estimate - q * se, 3) AS lower, round(estimate + q * se, 3) AS upper FROM t""",
)
def ols_group_slopes(spark, folder):
    lines = table(spark, folder, "lineitem")
    model = ols.ols_fit(lines, "l_extendedprice", ["l_quantity"], "l_linestatus", ["F", "O"])
    slopes = ols.group_slopes(spark, model, ["l_quantity"], "l_linestatus", ["F", "O"])
    return slopes.select(
        "l_linestatus",
        "term",
        F.round("estimate", 4).alias("estimate"),
        *(F.round(c, 3).alias(c) for c in ("lower", "upper")),
    )


COVARIANCES = {
    ("(Intercept)", "(Intercept)"): "fa",
    ("(Intercept)", "l_linestatus[O]"): "-fa",
    ("(Intercept)", "l_quantity"): "fab",
    ("(Intercept)", "l_quantity:l_linestatus[O]"): "-fab",
    ("l_linestatus[O]", "l_linestatus[O]"): "fa + oa",
    ("l_linestatus[O]", "l_quantity"): "-fab",
    ("l_linestatus[O]", "l_quantity:l_linestatus[O]"): "fab + oab",
    ("l_quantity", "l_quantity"): "fb",
    ("l_quantity", "l_quantity:l_linestatus[O]"): "-fb",
    ("l_quantity:l_linestatus[O]", "l_quantity:l_linestatus[O]"): "fb + ob",
}


@register(
    "ols_covariance",
    f"""WITH {INTERACTION},
c AS (SELECT MAX(CASE WHEN f = 'F' THEN va END) AS fa, MAX(CASE WHEN f = 'F' THEN vb END) AS fb,
  MAX(CASE WHEN f = 'O' THEN va END) AS oa, MAX(CASE WHEN f = 'O' THEN vb END) AS ob,
  MAX(CASE WHEN f = 'F' THEN cab END) AS fab, MAX(CASE WHEN f = 'O' THEN cab END) AS oab
  FROM (SELECT g.f, va, vb, -mx * vb AS cab FROM v JOIN g ON g.f = v.f))
"""
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS row, '{b}' AS "column", round({value}, 6) + 0.0 AS value FROM c"""
        for (first, second), value in COVARIANCES.items()
        for a, b in dict.fromkeys([(first, second), (second, first)])
    ),
)
def ols_covariance(spark, folder):
    lines = table(spark, folder, "lineitem")
    model = ols.ols_fit(lines, "l_extendedprice", ["l_quantity"], "l_linestatus", ["F", "O"])
    return ols.ols_covariance(spark, model).withColumn("value", F.round("value", 6) + 0.0)


@register("ols_interactions_full")
def ols_interactions_full(spark, folder):
    model = ols.ols_fit(
        table(spark, folder, "lineitem"), "l_extendedprice", COVARIATES, "l_returnflag", FLAGS
    )
    return ols.ols_table(spark, model)


def wide_periods(spark, folder):
    return (
        station_periods(spark, folder)
        .groupBy("station", "class")
        .agg(
            *(
                F.max(F.when(F.col("period") == p, F.col(m))).alias(f"{m}_{p}")
                for m in MEASURES
                for p in PERIODS
            )
        )
    )


def differences(spark, folder):
    wide = wide_periods(spark, folder)
    long = reshape.to_long(
        wide, ["station", "class"], [f"{m}_{p}" for m in MEASURES for p in PERIODS], "name", "value"
    )
    named = long.select(
        "station",
        "class",
        split_composite("name", 1).alias("variable"),
        split_composite("name", 2).alias("period"),
        "value",
    )
    return reshape.period_difference(
        named, ["station", "class"], "variable", "period", "value", "recent", "historical"
    )


DIFFERENCES = f"""{STATION_PERIODS},
long AS ({' UNION ALL '.join(f"SELECT station, class, period, '{m}' AS variable, {m} AS value FROM station_periods" for m in MEASURES)}),
differences AS (SELECT station, class, variable, MAX(CASE WHEN period = 'recent' THEN value END) AS recent,
  MAX(CASE WHEN period = 'historical' THEN value END) AS historical
  FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) = 2)"""


@register(
    "period_difference",
    f"""WITH {DIFFERENCES}
SELECT station, class, variable, round(recent, 6) AS recent, round(historical, 6) AS historical,
  round(recent - historical, 6) + 0.0 AS diff,
  round((recent - historical) / historical * 100, 6) + 0.0 AS diff_percent FROM differences""",
)
def period_difference(spark, folder):
    names = ("recent", "historical", "diff", "diff_percent")
    return differences(spark, folder).withColumns({c: F.round(c, 6) for c in names})


@register(
    "paired_only",
    f"""WITH {STATION_PERIODS},
flat AS (SELECT station, period, CASE WHEN top > 5.3 THEN top END AS top FROM station_periods)
SELECT f.station, f.period, round(f.top, 6) AS top FROM flat f WHERE f.top IS NOT NULL AND
  (SELECT COUNT(top) FROM flat g WHERE g.station = f.station) = 2""",
)
def paired_only(spark, folder):
    flat = station_periods(spark, folder).select(
        "station",
        "period",
        F.lit("top").alias("variable"),
        F.when(F.col("top") > 5.3, F.col("top")).alias("top"),
    )
    kept = reshape.paired_only(flat, ["station"], "variable", "period", "top")
    return kept.select("station", "period", F.round("top", 6).alias("top"))


PAIRED = f"""WITH {DIFFERENCES},
grp AS (SELECT variable, class, COUNT(*) AS n, AVG(recent - historical) AS estimate,
  COALESCE(VAR_SAMP(recent - historical), 0) AS v FROM differences GROUP BY 1, 2),
pool AS (SELECT *, SUM(n - 1) OVER w AS df, SUM((n - 1) * v) OVER w / SUM(n - 1) OVER w AS s2
  FROM grp WINDOW w AS (PARTITION BY variable)),
t AS (SELECT *, sqrt(s2 / n) AS se, estimate / sqrt(s2 / n) AS t,
  atan(abs(estimate / sqrt(s2 / n)) / sqrt(df)) AS th FROM pool)
SELECT variable, class, CAST(n AS BIGINT) AS n, CAST(df AS BIGINT) AS df, round(estimate, 6) + 0.0 AS estimate,
  round(se, 6) AS se, round(t, 6) + 0.0 AS t, round({T_P}, 6) AS p FROM t"""


@register("period_contrasts", PAIRED)
def period_contrasts(spark, folder):
    columns = {m: (f"{m}_recent", f"{m}_historical") for m in MEASURES}
    contrasts, _ = plans.period_contrasts(
        wide_periods(spark, folder), ["station"], "class", columns
    )
    return contrasts.select(
        "variable", "class", "n", "df", *(F.round(c, 6).alias(c) for c in ("estimate", "se", "t", "p"))
    )


@register("paired_contrast", PAIRED)
def paired_contrast(spark, folder):
    found = paired.paired_contrast(differences(spark, folder), "class", by="variable")
    return found.select(
        "variable", "class", "n", "df", *(F.round(c, 6).alias(c) for c in ("estimate", "se", "t", "p"))
    )


# The quantile that leaves one twentieth outside, by halving an interval.
LIMITS = PAIRED.replace("WITH ", "WITH RECURSIVE ", 1).split("SELECT variable, class, CAST(n")[0] + f""",
b AS (SELECT DISTINCT df, 0.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi, 0 AS i FROM pool
  UNION ALL SELECT df, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, i + 1
  FROM (SELECT *, {T_P} AS p FROM (SELECT *, (lo + hi) / 2 AS mid, atan((lo + hi) / 2 / sqrt(df)) AS th FROM b WHERE i < 60)))
SELECT variable, class, round(estimate, 6) + 0.0 AS estimate, round(estimate - hi * se, 5) + 0.0 AS lower,
  round(estimate + hi * se, 5) + 0.0 AS upper FROM t JOIN b ON b.df = t.df AND i = 60"""


@register("paired_contrast_limits", LIMITS)
def paired_contrast_limits(spark, folder):
    found = paired.paired_contrast(differences(spark, folder), "class", by="variable")
    digits = {"estimate": 6, "lower": 5, "upper": 5}
    return found.select(
        "variable", "class", *((F.round(c, d) + 0.0).alias(c) for c, d in digits.items())
    )


@register(
    "paired_anova",
    f"""WITH {DIFFERENCES},
dm AS (SELECT variable, class, recent - historical AS d, (recent + historical) / 2 AS m FROM differences),
grp AS (SELECT variable, class, COUNT(*) AS n, AVG(d) AS da, AVG(m) AS ma,
  COUNT(*) * VAR_POP(d) AS dw, COUNT(*) * VAR_POP(m) AS mw FROM dm GROUP BY 1, 2),
tot AS (SELECT variable, SUM(n) AS n, COUNT(*) AS g, SUM(dw) AS dw, SUM(mw) AS mw,
  SUM(n * da * da) - SUM(n * da) ** 2 / SUM(n) AS db, SUM(n * ma * ma) - SUM(n * ma) ** 2 / SUM(n) AS mb,
  SUM(n * da) ** 2 / SUM(n) AS d0 FROM grp GROUP BY 1)
SELECT variable, term, CAST(df1 AS BIGINT) AS df1, CAST(df AS BIGINT) AS df2, round(f, 6) AS f_stat,
  round({F_P}, 6) + 0.0 AS p FROM (SELECT *, n - g AS df, (n - g) / 2.0 AS a, (n - g) / (n - g + df1 * f) AS x,
  atan(sqrt(df1 * f / (n - g))) AS th FROM (
  SELECT variable, n, g, 'group' AS term, g - 1 AS df1, (mb / (g - 1)) / (mw / (n - g)) AS f FROM tot
  UNION ALL SELECT variable, n, g, 'period', 1, d0 / (dw / (n - g)) FROM tot
  UNION ALL SELECT variable, n, g, 'group:period', g - 1, (db / (g - 1)) / (dw / (n - g)) FROM tot))""",
)
def paired_anova(spark, folder):
    found = paired.paired_anova(differences(spark, folder), "class", by="variable")
    return found.withColumns({"f_stat": F.round("f_stat", 6), "p": F.round("p", 6) + 0.0})


@register(
    "grouped_means",
    """SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INT) AS year,
  round(AVG(o_totalprice), 7) AS price FROM orders
GROUP BY GROUPING SETS ((o_orderstatus, year(o_orderdate)), (o_orderpriority, year(o_orderdate)))""",
)
def grouped_means(spark, folder):
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    means = reshape.grouped_means(
        orders,
        [["o_orderstatus", "year"], ["o_orderpriority", "year"]],
        {"o_totalprice": "price"},
    )
    return means.select(
        "o_orderstatus", "o_orderpriority", "year", F.round("price", 7).alias("price")
    )


@register("component_scores")
def component_scores(spark, folder):
    scores, _ = plans.component_scores(vectors(spark, folder), XS)
    return scores.select("vec_id", "label", "dim1", "dim2", "dim3")


FACTORS = {"label": "label", "third": "vec_id % 3", "sign": "CASE WHEN x3 > 0.01 THEN 'high' WHEN x3 < -0.01 THEN 'low' END"}


KNOWN = VECTORS.replace("vectors AS", "every AS", 1) + ", vectors AS (SELECT * FROM every WHERE ({}) IS NOT NULL)"


@register(
    "factor_tests",
    " UNION ALL ".join(
        f"SELECT '{name}' AS factor, * FROM ({_permanova_sql(level).replace(VECTORS, KNOWN.format(level))})"
        for name, level in FACTORS.items()
    ),
)
def factor_tests(spark, folder):
    rows = vectors(spark, folder).withColumns({n: F.expr(e) for n, e in FACTORS.items() if n != "label"})
    found = plans.factor_tests(rows, "vec_id", list(FACTORS), RESPONSES, N_PERM, "md5")
    return found.withColumn("f_stat", F.round("f_stat", 6))


@register(
    "period_tests",
    f"""WITH {STATION_PERIODS},
members AS (SELECT 'all' AS family, 'all' AS member, * FROM station_periods
  UNION ALL SELECT 'class', class, * FROM station_periods WHERE class IN
    (SELECT class FROM station_periods GROUP BY 1 HAVING COUNT(DISTINCT station) >= 2)),
small AS (SELECT class FROM station_periods GROUP BY 1 HAVING COUNT(DISTINCT station) < 2),
{_strata_sql('members', 'family, member')}
SELECT family, member, df_factor, df_residual, df_total, round(f_stat, 6) AS f_stat, p_value, n_perm,
  CASE WHEN family <> 'all' THEN round(MAX(step) OVER (PARTITION BY family ORDER BY p_value, k), 9) END AS p_adjusted
FROM (SELECT *, least(1.0, (COUNT(*) OVER (PARTITION BY family) - k + 1) * p_value) AS step FROM
  (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value) AS k FROM tested))
UNION ALL SELECT 'class', class, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM small""",
)
def period_tests(spark, folder):
    found = plans.period_tests(
        station_periods(spark, folder), "station", "period", MEASURES, ["class"], N_PERM, draw="md5"
    )
    return found.withColumns(
        {"f_stat": F.round("f_stat", 6), "p_adjusted": F.round("p_adjusted", 9)}
    )


def _effects_sql(y: str) -> str:
    """Slopes of one response on standardised quantity per line status, pooled variance."""
    return f"""(WITH z AS (SELECT l_linestatus AS f, {y} AS y,
    (l_quantity - AVG(l_quantity) OVER ()) / STDDEV_SAMP(l_quantity) OVER () AS x FROM lineitem),
g AS (SELECT f, COUNT(*) AS n, AVG(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b,
    regr_intercept(y, x) AS a, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss FROM z GROUP BY 1),
s AS (SELECT SUM(rss) / (SUM(n) - 4) AS s2, SUM(n) - 4 AS df, 1.959963984540054 AS z FROM g),
q AS (SELECT *, z + (z**3 + z) / (4.0 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96.0 * df * df) AS q FROM s)
SELECT '{y}' AS response, f, mx, a, b, n, sxx, s2, df, q FROM g, q)"""


EFFECTS = " UNION ALL ".join(f"SELECT * FROM {_effects_sql(y)}" for y in ("l_extendedprice", "l_tax"))


@register(
    "climate_effect_of_one",
    f"""SELECT response, f AS l_linestatus, 'l_quantity_z' AS term, round(b, 4) + 0.0 AS estimate,
  round(b - q * sqrt(s2 / sxx), 3) + 0.0 AS lower, round(b + q * sqrt(s2 / sxx), 3) + 0.0 AS upper FROM ({EFFECTS})""",
)
def climate_effect_of_one(spark, folder):
    lines = moments.zscore(table(spark, folder, "lineitem"), ["l_quantity"])
    found = plans.climate_effects(
        lines, ["l_extendedprice", "l_tax"], ["l_quantity_z"], "l_linestatus", ["F", "O"]
    )
    return found.withColumns(
        {"estimate": F.round("estimate", 4) + 0.0}
        | {c: F.round(c, 3) + 0.0 for c in ("lower", "upper")}
    )


def _effects_of_three_sql(y: str) -> str:
    """Slopes of one response on three standardised covariates per line status, pooled variance, by cofactors."""
    z = ", ".join(f"({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER () AS z{i}" for i, c in enumerate(COVARIATES, 1))
    pairs = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
    products = ", ".join(f"COUNT(*) * COVAR_POP(z{i}, z{j}) AS a{i}{j}" for i, j in pairs)
    sums = ", ".join(f"COUNT(*) * COVAR_POP(z{i}, y) AS b{i}" for i in (1, 2, 3))
    return f"""(WITH z AS (SELECT l_linestatus, {y} AS y, {z} FROM lineitem),
g AS (SELECT l_linestatus, COUNT(*) AS n, {products}, {sums}, COUNT(*) * VAR_POP(y) AS yy FROM z GROUP BY 1),
c AS (SELECT *, a22 * a33 - a23 * a23 AS c11, a11 * a33 - a13 * a13 AS c22, a11 * a22 - a12 * a12 AS c33,
  a13 * a23 - a12 * a33 AS c12, a12 * a23 - a13 * a22 AS c13, a12 * a13 - a11 * a23 AS c23 FROM g),
d AS (SELECT *, a11 * c11 + a12 * c12 + a13 * c13 AS det FROM c),
s AS (SELECT *, (c11 * b1 + c12 * b2 + c13 * b3) / det AS s1, (c12 * b1 + c22 * b2 + c23 * b3) / det AS s2,
  (c13 * b1 + c23 * b2 + c33 * b3) / det AS s3 FROM d),
r AS (SELECT *, SUM(yy - s1 * b1 - s2 * b2 - s3 * b3) OVER () / (SUM(n) OVER () - 8) AS v, SUM(n) OVER () - 8 AS df,
  1.959963984540054 AS k FROM s),
q AS (SELECT *, k + (k**3 + k) / (4.0 * df) + (5 * k**5 + 16 * k**3 + 3 * k) / (96.0 * df * df) AS q FROM r)
{" UNION ALL ".join(f"SELECT '{y}' AS response, l_linestatus, '{c}_z' AS term, s{i} AS b, q * sqrt(v * c{i}{i} / det) AS half FROM q"
                     for i, c in enumerate(COVARIATES, 1))})"""


@register(
    "climate_effects",
    f"""SELECT response, l_linestatus, term, round(b, 4) + 0.0 AS estimate, round(b - half, 3) + 0.0 AS lower,
  round(b + half, 3) + 0.0 AS upper
FROM ({" UNION ALL ".join(f"SELECT * FROM {_effects_of_three_sql(y)}" for y in ("l_extendedprice", "l_linenumber"))})""",
)
def climate_effects(spark, folder):
    lines = moments.zscore(table(spark, folder, "lineitem"), COVARIATES)
    found = plans.climate_effects(
        lines, ["l_extendedprice", "l_linenumber"], [f"{c}_z" for c in COVARIATES], "l_linestatus", ["F", "O"]
    )
    return found.withColumns(
        {"estimate": F.round("estimate", 4) + 0.0}
        | {c: F.round(c, 3) + 0.0 for c in ("lower", "upper")}
    )


@register(
    "regression_table",
    f"""WITH g AS ({EFFECTS}),
w AS (SELECT response, df, MAX(CASE WHEN f = 'F' THEN a END) AS ra, MAX(CASE WHEN f = 'F' THEN b END) AS rb,
  MAX(CASE WHEN f = 'O' THEN a END) AS oa, MAX(CASE WHEN f = 'O' THEN b END) AS ob,
  MAX(CASE WHEN f = 'F' THEN s2 * (1.0 / n + mx * mx / sxx) END) AS rva, MAX(CASE WHEN f = 'F' THEN s2 / sxx END) AS rvb,
  MAX(CASE WHEN f = 'O' THEN s2 * (1.0 / n + mx * mx / sxx) END) AS ova, MAX(CASE WHEN f = 'O' THEN s2 / sxx END) AS ovb
  FROM g GROUP BY 1, 2),
t AS (SELECT response, df, '(Intercept)' AS term, 'main' AS kind, ra AS estimate, sqrt(rva) AS se FROM w
  UNION ALL SELECT response, df, 'l_linestatus[O]', 'main', oa - ra, sqrt(ova + rva) FROM w
  UNION ALL SELECT response, df, 'l_quantity_z', 'main', rb, sqrt(rvb) FROM w
  UNION ALL SELECT response, df, 'l_quantity_z:l_linestatus[O]', 'interaction', ob - rb, sqrt(ovb + rvb) FROM w)
SELECT response, term, kind, round(estimate, 4) + 0.0 AS estimate, round(se, 5) AS se, round(estimate / se, 4) + 0.0 AS t,
  round({T_P}, 6) + 0.0 AS p FROM (SELECT *, atan(abs(estimate / se) / sqrt(df)) AS th FROM t)""",
)
def regression_table(spark, folder):
    lines = moments.zscore(table(spark, folder, "lineitem"), ["l_quantity"])
    found = plans.regression_table(
        lines, ["l_extendedprice", "l_tax"], ["l_quantity_z"], "l_linestatus", ["F", "O"]
    )
    return found.select(
        "response", "term", "kind", (F.round("estimate", 4) + 0.0).alias("estimate"), F.round("se", 5).alias("se"),
        (F.round("t", 4) + 0.0).alias("t"), (F.round("p", 6) + 0.0).alias("p"),
    )


@register(
    "correlation_table",
    f"""WITH {VECTORS},
c AS ({" UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, COUNT(*) AS n, corr({a}, {b}) AS r FROM vectors"
        for a, b in combinations(XS[:4], 2)
    )}),
u AS (SELECT *, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t, 0.5 * ln((1 + r) / (1 - r)) AS fz,
  1.959963984540054 / sqrt(n - 3) AS half FROM c),
v AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM u),
w AS (SELECT *, {T_P} AS p FROM v),
k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, COUNT(*) OVER () AS m FROM w)
SELECT var1, var2, n, round(r, 6) + 0.0 AS r, round((exp(2 * (fz - half)) - 1) / (exp(2 * (fz - half)) + 1), 6) + 0.0 AS lower,
  round((exp(2 * (fz + half)) - 1) / (exp(2 * (fz + half)) + 1), 6) + 0.0 AS upper, round(t, 5) + 0.0 AS t, round(p, 6) AS p,
  round(MAX(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p), 6) AS p_adjusted FROM k""",
)
def correlation_table(spark, folder):
    found = moments.correlation_table(vectors(spark, folder), XS[:4])
    digits = {"t": 5}
    return found.select(
        "var1", "var2", "n",
        *((F.round(c, digits.get(c, 6)) + 0.0).alias(c) for c in ("r", "lower", "upper", "t", "p", "p_adjusted")),
    )
