import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverspark.operators import clean, reshape, summaries
from riverspark.plans import statistics as plans
from riverspark.stats import moments, ols, paired, pca
from riverspark.stats.distributions import f_upper, incomplete_beta, t_quantile, t_two_sided
from riverspark.stats.attach import per_group
from riverspark.stats.holm import holm
from riverspark.stats.permanova import (
    _centred,
    _families,
    pairwise_permanova,
    permanova,
    permanova_f,
    permanova_strata,
)
from riverspark.stats.permuting import permuted_sums

# Published p-values of two test families and their adjustments.
ECOREGION_P = [0.018, 0.158, 0.17, 0.002]
PERIOD_P = [0.588, 0.054, 0.625]


def holm_by_hand(p):
    order = np.argsort(p)
    out, top = [0.0] * len(p), 0.0
    for k, i in enumerate(order):
        top = max(top, (len(p) - k) * p[i])
        out[i] = min(1.0, top)
    return out


def test_t_and_f_probabilities():
    assert t_quantile(0.975, 67) == pytest.approx(1.996008354025297, abs=1e-9)
    assert t_quantile(0.975, 1e9) == pytest.approx(1.959963984540054, abs=1e-6)
    assert t_two_sided(12.1194193645067, 67) == pytest.approx(1.50953119553828e-18, rel=1e-6)
    assert t_two_sided(-1.15026142932581, 67) == pytest.approx(0.254125253312593, rel=1e-9)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    # With two numerator degrees of freedom the tail has a closed form.
    assert f_upper(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5, rel=1e-12)
    assert f_upper(4.0, 1, 9) == pytest.approx(t_two_sided(2.0, 9), rel=1e-12)
    assert incomplete_beta(2, 3, [0.0, 1.0]).tolist() == [0.0, 1.0]


def test_holm_per_family_ignores_missing_tests(spark):
    rows = [("e", i, p) for i, p in enumerate(ECOREGION_P)] + [("p", i, p) for i, p in enumerate(PERIOD_P)]
    rows.append(("p", 9, None))
    df = spark.createDataFrame(rows, "family string, i int, p double")
    got = {(r.family, r.i): r.p_adjusted for r in holm(df, "p", "family").collect()}
    assert [got["e", i] for i in range(4)] == pytest.approx(holm_by_hand(ECOREGION_P))
    assert [got["p", i] for i in range(3)] == pytest.approx(holm_by_hand(PERIOD_P))
    assert got["p", 9] is None


def f_by_hand(x, labels):
    """Pseudo-F from the squared distances themselves."""
    n, levels = len(x), sorted(set(labels))
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    total = d2.sum() / (2 * n)
    within = sum(
        d2[np.ix_(idx, idx)].sum() / (2 * len(idx))
        for idx in (np.flatnonzero(np.array(labels) == g) for g in levels)
    )
    return ((total - within) / (len(levels) - 1)) / (within / (n - len(levels)))


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(5)
    labels = ["a"] * 14 + ["b"] * 9 + ["c"] * 11
    x = rng.normal(size=(34, 2)) + np.array([[1.0 if g == "b" else 0.0, 50.0] for g in labels])
    rows = [(i, g, float(v[0]), float(v[1])) for i, (g, v) in enumerate(zip(labels, x))]
    return spark.createDataFrame(rows, "id int, g string, x double, y double"), labels, x


def test_pseudo_f_equals_distances(groups):
    df, labels, x = groups
    row = permanova_f(df, "g", ["x", "y"]).first()
    assert row.f_stat == pytest.approx(f_by_hand(x, labels), rel=1e-9)
    assert (row.df_factor, row.df_residual, row.df_total) == (2, 31, 33)
    shuffled = permanova_f(df.orderBy(F.rand(3)), "g", ["x", "y"]).first()
    assert shuffled.f_stat == pytest.approx(row.f_stat, rel=1e-9)


def test_large_and_small_group_paths_agree(groups):
    df, labels, x = groups
    for draw in ("xxhash64", "md5"):
        whole = permanova(df, "id", "g", ["x", "y"], n_perm=60, draw=draw).first()
        keyed = df.withColumn("one", F.lit("one"))
        for size in (1, 40):
            cut = permanova(keyed, "id", "g", ["x", "y"], by="one", n_perm=60, draw=draw, whole_rows=size)
            again = cut.drop("one").first().asDict()
            assert again == whole.asDict() | {"f_stat": pytest.approx(whole.f_stat, rel=1e-12)}
    assert whole.n_perm == 60
    reached = 1
    for perm in range(1, 61):
        order = sorted(range(34), key=lambda i: hashlib.md5(f"0:{perm}:{i}".encode()).hexdigest())
        dealt = [""] * 34
        for i, level in zip(order, sorted(labels)):
            dealt[i] = level
        reached += f_by_hand(x, dealt) >= f_by_hand(x, labels) - 1e-8
    assert whole.p_value == pytest.approx(reached / 61)
    other = permanova(df, "id", "g", ["x", "y"], n_perm=60, seed="1").first()
    assert other.f_stat == pytest.approx(whole.f_stat)


def test_rows_are_not_dealt_to_their_family(spark):
    """Joined by family, all rows of a factor were one task's: few families are broadcast, behind checkpoints too."""
    rng = np.random.default_rng(8)
    rows = [(f"f{i % 3}", str(i), f"g{i % 5}", float(rng.normal()), float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "f string, id string, g string, x double, y double").repartition(8)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for whole_rows in (1, 4096):
            df = df.withColumnRenamed("g", "_level").withColumnRenamed("id", "_id")
            families = per_group(_families(df, ["f"], ["x", "y"]), ["f"])
            centred = _centred(df, families, ["f"], ["x", "y"])
            sums = permuted_sums(
                centred, ["f"], ["x", "y"], strata=False, n_perm=9, seed="0", draw="md5", whole_rows=whole_rows
            )
            for part in (centred, sums):
                plan = part._jdf.queryExecution().executedPlan().toString()
                assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
            found.append({(r.f, r._perm, r._level): (r._n_level, r.x, r.y) for r in sums.collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(found[0]) == 3 * 9 * 5 and found[0].keys() == found[1].keys()
    for key, values in found[0].items():
        assert found[1][key] == pytest.approx(values, abs=1e-9)


def test_pairs_of_groups_with_adjustment(groups):
    df, labels, x = groups
    got = {(r.var1, r.var2): r for r in pairwise_permanova(df, "id", "g", ["x", "y"], n_perm=50).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), r in got.items():
        idx = [i for i, g in enumerate(labels) if g in (a, b)]
        assert r.f_stat == pytest.approx(f_by_hand(x[idx], [labels[i] for i in idx]), rel=1e-9)
    p = [r.p_value for r in got.values()]
    assert [r.p_adjusted for r in got.values()] == pytest.approx(holm_by_hand(p))


def test_few_pairs_are_enumerated(spark):
    rng = np.random.default_rng(6)
    rows, xs = [], []
    for river in range(5):
        for period, shift in (("old", 0.0), ("new", 0.4)):
            v = rng.normal(size=2) * 0.3 + river + shift
            xs.append(v)
            rows.append((f"r{river}", period, "few", float(v[0]), float(v[1])))
    rows += [(f"m{i}", p, "many", float(rng.normal()), 0.0) for i in range(8) for p in ("old", "new")]
    rows.append(("alone", "old", "odd", 1.0, 1.0))
    df = spark.createDataFrame(rows, "river string, period string, cls string, x double, y double")
    got = {r.cls: r for r in permanova_strata(df, "period", ["x", "y"], "river", by="cls", n_perm=99).collect()}
    x = np.array(xs)
    observed = f_by_hand(x, ["old", "new"] * 5)
    count = 0
    for flips in itertools.product((0, 1), repeat=5):
        labels = [g for f in flips for g in (("new", "old") if f else ("old", "new"))]
        count += f_by_hand(x, labels) >= observed - 1e-8
    assert got["few"].f_stat == pytest.approx(observed, rel=1e-9)
    assert got["few"].p_value == pytest.approx(count / 32) and got["few"].n_perm == 31
    assert got["many"].n_perm == 99
    assert got["odd"].f_stat is None and got["odd"].p_value is None


def test_components_follow_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) * [1, 10, 100, 1000] + 5
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    model = pca.pca_fit(df, cols)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values = np.linalg.eigvalsh(np.corrcoef(z.T))[::-1]
    np.testing.assert_allclose(model.eigenvalues, values, atol=1e-9)
    scores = pca.pca_scores(model, df).select(*(f"dim{i}" for i in range(1, 5))).toPandas().to_numpy()
    np.testing.assert_allclose(np.cov(scores.T), np.diag(values), atol=1e-8)
    contrib = pca.pca_contrib(spark, model).drop("variable").toPandas().to_numpy()
    np.testing.assert_allclose(contrib.sum(0), 100)
    np.testing.assert_allclose(contrib.sum(1), 100)
    coords = pca.pca_coords(spark, model).drop("variable").toPandas().to_numpy()
    np.testing.assert_allclose((coords**2).sum(0), values, atol=1e-9)
    assert sum(r.share for r in pca.pca_variance(spark, model).collect()) == pytest.approx(1)
    strongest = np.abs(model.loadings).argmax(0)
    assert (model.loadings[strongest, range(4)] > 0).all()


def test_zscores_and_correlations(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 3.0, None), ("b", 5.0, 1.0), ("b", 5.0, 4.0)], "g string, x double, y double"
    )
    z = moments.zscore(df, ["x"]).toPandas()
    assert z.x_z.mean() == pytest.approx(0) and z.x_z.std() == pytest.approx(1)
    by = moments.zscore(df, ["x"], by="g").toPandas()
    assert by[by.g == "b"].x_z.isna().all()
    r = moments.correlations(df, ["x", "y"]).first()
    assert r.r == pytest.approx(np.corrcoef([1, 5, 5], [2, 1, 4])[0, 1])


def test_regression_follows_numpy(spark):
    rng = np.random.default_rng(8)
    n = 120
    g = rng.choice(["glacial", "non-glacial"], n)
    x, w = rng.normal(size=n), rng.normal(size=n) * 50
    d = (g == "non-glacial").astype(float)
    y = 1 + 2 * x - 0.1 * w + d * (3 - x) + rng.normal(size=n)
    rows = [(str(a), float(b), float(c), float(e)) for a, b, c, e in zip(g, x, w, y)]
    df = spark.createDataFrame([*rows, ("glacial", None, 1.0, 1.0)], "g string, x double, w double, y double")
    levels = ["glacial", "non-glacial"]
    model = ols.ols_fit(df, "y", ["x", "w"], "g", levels)
    design = np.column_stack([np.ones(n), d, x, w, d * x, d * w])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    cov = rss[0] / (n - 6) * np.linalg.inv(design.T @ design)
    assert model.terms == (
        "(Intercept)", "g[non-glacial]", "x", "w", "x:g[non-glacial]", "w:g[non-glacial]"
    )
    np.testing.assert_allclose(model.estimates, beta, rtol=1e-8)
    np.testing.assert_allclose(model.covariance, cov, rtol=1e-7)
    assert (model.n, model.dof) == (n, n - 6)
    table = ols.ols_table(spark, model).toPandas()
    half = t_quantile(0.975, n - 6) * np.sqrt(np.diag(cov))
    np.testing.assert_allclose(table.upper - table.estimate, half, rtol=1e-7)
    np.testing.assert_allclose(table.p, t_two_sided(beta / np.sqrt(np.diag(cov)), n - 6), rtol=1e-5)
    slope, low, high = ols.linear_combo_ci(model, "x", "x:g[non-glacial]")
    error = np.sqrt(cov[2, 2] + cov[4, 4] + 2 * cov[2, 4])
    assert slope == pytest.approx(beta[2] + beta[4])
    assert high - low == pytest.approx(2 * t_quantile(0.975, n - 6) * error)
    slopes = ols.group_slopes(spark, model, ["x", "w"], "g", levels)
    assert slopes.count() == 4
    assert ols.ols_covariance(spark, model).count() == 36
    simple = {r.g: r for r in ols.ols_simple_by_group(df, "y", "x", "g").collect()}
    part = g == "glacial"
    fit = np.polyfit(x[part], y[part], 1)
    assert simple["glacial"].slope == pytest.approx(fit[0])
    assert simple["glacial"].n == part.sum() and 0 <= simple["glacial"].p <= 1


def test_paired_contrasts_and_anova(spark):
    rng = np.random.default_rng(9)
    sizes = {"mwcf": 5, "nf": 7, "tundra": 2, "solo": 1}
    rows = []
    for g, n in sizes.items():
        for i in range(n):
            base = rng.normal() * 5
            rows.append((f"{g}{i}", g, "rain", float(base + 1 + rng.normal()), float(base)))
    df = spark.createDataFrame(rows, "id string, g string, variable string, recent double, historical double")
    with_diff = df.withColumn("diff", F.col("recent") - F.col("historical"))
    out = {r.g: r for r in paired.paired_contrast(with_diff, "g", by="variable").collect()}
    d = {g: np.array([r[3] - r[4] for r in rows if r[1] == g]) for g in sizes}
    pooled = sum(((v - v.mean()) ** 2).sum() for v in d.values()) / (15 - 4)
    for g, v in d.items():
        se = np.sqrt(pooled / len(v))
        assert out[g].estimate == pytest.approx(v.mean()) and out[g].se == pytest.approx(se)
        assert out[g].df == 11 and out[g].p == pytest.approx(t_two_sided(v.mean() / se, 11))
        assert out[g].upper == pytest.approx(v.mean() + t_quantile(0.975, 11) * se)
    tests = {r.term: r for r in paired.paired_anova(df, "g", by="variable").collect()}
    everything = np.concatenate(list(d.values()))
    between = sum(len(v) * (v.mean() - everything.mean()) ** 2 for v in d.values())
    assert tests["period"].f_stat == pytest.approx(15 * everything.mean() ** 2 / pooled)
    assert tests["group:period"].f_stat == pytest.approx(between / 3 / pooled)
    assert (tests["group"].df1, tests["group"].df2) == (3, 11)
    assert tests["period"].p == pytest.approx(f_upper(tests["period"].f_stat, 1, 11))


def test_null_groups_are_kept(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert moments.zscore(df, ["v"], by="g").count() == 4
    assert clean.min_group_size(df, "g", 1).count() == 4
    assert {(r.g, r.quantiles[0]) for r in summaries.exact_quantiles(df, "g", "v", [0.5]).collect()} == {("a", 2.0), (None, 7.0)}
    assert summaries.box_summary(df, "g", "v").count() == 2
    pairs = spark.createDataFrame([(None, "x", "p", 1.0), (None, "x", "q", 2.0)], "i string, m string, p string, v double")
    assert reshape.paired_only(pairs, ["i"], "m", "p", "v").count() == 2


def test_duplicate_cells_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "a", None), (2, "a", 3.0)], "i int, n string, v double")
    wide = reshape.to_wide(df.filter("i = 2"), ["i"], "n", "v", ["a", "b"]).collect()
    assert [tuple(r) for r in wide] == [(2, 3.0, None)]
    with pytest.raises(Exception, match="more than one value"):
        reshape.to_wide(df, ["i"], "n", "v", ["a"]).collect()


def test_regression_is_stable_under_shifts(spark):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=300), np.where(rng.random(300) < 0.4, "u", "v")
    y = 2 * x + (g == "v") * (1 - x) + rng.normal(size=300)
    rows = [(float(a), float(b), float(b + 1e8), float(a + 1e6), str(c)) for a, b, c in zip(x, y, g)]
    df = spark.createDataFrame(rows, "x double, y double, far double, xfar double, g string")
    fits = ols.ols_fits(df, ["y", "far"], ["x"], "g", ["u", "v"])
    same = ols.ols_fit(df, "y", ["xfar"], "g", ["u", "v"])
    near, far = (np.sqrt(np.diag(fits[c].covariance)) for c in ("y", "far"))
    np.testing.assert_allclose(near, far, rtol=1e-6)
    np.testing.assert_allclose(fits["y"].estimates[1:], fits["far"].estimates[1:], atol=1e-6)
    assert same.sigma2 == pytest.approx(fits["y"].sigma2, rel=1e-6)
    with pytest.raises(Exception, match="not listed"):
        ols.ols_fit(df, "y", ["x"], "g", ["u"])
    with pytest.raises(ValueError):
        ols.ols_fit(df, "y", ["x"], "g", ["u", "v", "w"])
    table = {(r.response, r.term): r for r in plans.regression_table(df, ["y", "far"], ["x"], "g", ["u", "v"]).collect()}
    assert table["y", "x:g[v]"].kind == "interaction" and table["far", "x"].kind == "main"


def test_regression_joins_no_rows_to_the_means(spark, monkeypatch):
    """Rows of one response must not meet in one task, as they do where its mean is joined to them."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2))
    rows = [(float(a), float(b), float(a - b), None if i % 7 == 0 else float(a + 3), "uv"[i % 2]) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, w double, y double, z double, g string").repartition(6)
    seen, inner = [], ols.triangles

    def watched(centred, columns, *more):
        seen.append(centred._jdf.queryExecution().toString())
        return inner(centred, columns, *more)

    monkeypatch.setattr(ols, "triangles", watched)
    fits = ols.ols_fits(df, ["y", "z"], ["x", "w"], "g", ["u", "v"])
    assert len(seen) == 1 and "Join" not in seen[0]
    assert (fits["y"].n, fits["z"].n) == (400, 342)
    np.testing.assert_allclose(fits["y"].estimates, [0, 0, 1, -1, 0, 0], atol=1e-12)
    np.testing.assert_allclose(fits["z"].estimates, [3, 0, 1, 0, 0, 0], atol=1e-12)
    with pytest.raises(ValueError, match="no complete rows for q"):
        ols.ols_fits(df.withColumn("q", F.lit(None).cast("double")), ["y", "q"], ["x"])


def test_levels_of_one_subject_stay_without_a_test(spark):
    rows = [(f"s{i}", p, float(i + (p == "new") * 3 + i % 3), "big" if i else "small") for i in range(6) for p in ("old", "new")]
    df = spark.createDataFrame(rows, "s string, p string, v double, c string")
    found = {(r.family, r.member): r for r in plans.period_tests(df, "s", "p", ["v"], ["c"], n_perm=19).collect()}
    assert found["c", "small"].p_value is None and found["c", "small"].f_stat is None
    assert found["c", "big"].p_value is not None and found["all", "all"].p_value is not None


def test_large_degrees_of_freedom(spark):
    assert float(t_two_sided(1.96, 1e12)) == pytest.approx(0.0499957902964, rel=1e-9)
    assert float(t_quantile(0.975, 1e12)) == pytest.approx(1.959963984540054, rel=1e-9)
    table = moments.correlation_table(spark.range(50).selectExpr("id", "id * id AS sq", "pmod(id * 7, 11) AS m"), ["id", "sq", "m"])
    rows = {(r.var1, r.var2): r for r in table.collect()}
    assert rows["id", "sq"].lower < rows["id", "sq"].r < rows["id", "sq"].upper and rows["id", "sq"].p < 1e-9


def test_nearly_collinear_covariates_keep_their_digits(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=900)
    near = x + 1e-6 * rng.normal(size=900)
    y = 2.0 + 3.0 * x - 1.5 * near + 0.1 * rng.normal(size=900)
    rows = [tuple(map(float, r)) for r in zip(x, near, y)]
    df = spark.createDataFrame(rows, "x double, near double, y double").repartition(9)
    model = ols.ols_fit(df, "y", ["x", "near"])
    design = np.column_stack([np.ones(900), x, near])
    expected = np.linalg.lstsq(design, y, rcond=None)[0]
    assert model.estimates == pytest.approx(expected, rel=1e-8)
    residual = y - design @ expected
    assert model.sigma2 == pytest.approx(residual @ residual / 897, rel=1e-10)
    # Products of columns would have lost them.
    gram = design.T @ design
    assert np.abs(np.linalg.solve(gram, design.T @ y) / expected - 1).max() > 1e-8


@pytest.mark.parametrize("fan_in", [2, 3, 32])
def test_triangles_merge_in_a_tree(spark, fan_in):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(200, 3))
    rows = [(("a", "b")[i % 5 == 0], *map(float, v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "_response string, p double, q double, r double").repartition(11)
    found = ols.triangles(df, {c: F.col(c) for c in "pqr"}, fan_in)
    for name, own in (("a", values[np.arange(200) % 5 != 0]), ("b", values[::5])):
        assert found[name].T @ found[name] == pytest.approx(own.T @ own, rel=1e-10)


def test_dependent_terms_are_an_error(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float(i * i)) for i in range(20)], "x double, z double, y double")
    with pytest.raises(ValueError, match="follow from"):
        ols.ols_fit(df, "y", ["x", "z"])
