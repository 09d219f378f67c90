import datetime as dt

import numpy as np
import pytest

from riverspark.operators import events, spectral
from riverspark.plans.flow import flow_regime

N = 1461


@pytest.fixture(scope="module")
def flow(spark):
    rng = np.random.default_rng(3)
    t = np.arange(N + 40)
    rows = []
    truth = {}
    for station, noise in (("calm", 0.02), ("wild", 0.4)):
        y = 0.5 * np.cos(2 * np.pi * t / 365.25 - 1) + 0.2 * np.sin(4 * np.pi * t / 365.25)
        y = y + noise * rng.normal(size=len(t))
        q = 10**y
        rows += [(station, dt.date(2001, 1, 1) + dt.timedelta(days=int(i)), float(v)) for i, v in zip(t, q)]
        truth[station] = np.log10(q / q.mean())[:N]
    df = spark.createDataFrame(rows, "s string, date date, q double")
    return df, spectral.prepare_flow(df, "s", "date", "q").cache(), truth


def test_days_behind_the_whole_years_stay(flow):
    _, ready, truth = flow
    out = ready.filter("s = 'calm'").orderBy("t").toPandas()
    assert len(out) == N + 40 and set(out.n_years) == {4} and list(out.t) == list(range(N + 40))
    assert set(out.n_days) == {N}
    np.testing.assert_allclose(out.y[:N], truth["calm"], atol=1e-12)


def test_metrics_follow_a_full_transform(flow):
    _, ready, truth = flow
    for r in spectral.spectral_metrics(ready, "s").collect():
        power = 2 * np.abs(np.fft.rfft(truth[r.s]) / N) ** 2
        bins = [4, 8, 12]
        signal = power[bins].sum()
        noise = truth[r.s].var() - signal
        assert r.rms_signal == pytest.approx(np.sqrt(signal / 3), rel=1e-9)
        assert r.rms_noise == pytest.approx(np.sqrt(noise / ((N - 1) // 2 - 3)), rel=1e-9)
        assert r.snr == pytest.approx(20 * np.log(r.rms_signal / r.rms_noise), rel=1e-12)


def test_signal_plus_anomaly_is_the_series(flow):
    _, ready, truth = flow
    out = spectral.seasonal_signal(ready, "s", "date").filter("s = 'wild'").orderBy("date").toPandas()
    np.testing.assert_allclose(out.pred + out.resid, out.y, atol=1e-12)
    spectrum = np.fft.rfft(truth["wild"])
    keep = np.zeros_like(spectrum)
    keep[[0, 4, 8, 12]] = spectrum[[0, 4, 8, 12]]
    np.testing.assert_allclose(out.pred[:N], np.fft.irfft(keep, N), atol=1e-9)
    np.testing.assert_allclose(out.pred[N:], np.fft.irfft(keep, N)[:40], atol=1e-9)


def test_no_anomaly_on_days_never_observed(spark):
    """A gap of 400 days: no event in it, no season maximum, and the calendar still whole."""
    rng = np.random.default_rng(8)
    first, days = dt.date(2000, 1, 1), 1600
    gap = range(700, 1100)
    rows = [
        ("a", first + dt.timedelta(days=i), float(10 ** (np.cos(i / 58) + 0.3 * rng.normal())))
        for i in range(days)
        if i not in gap
    ]
    df = spark.createDataFrame(rows, "s string, date date, q double")
    signal = spectral.seasonal_signal(spectral.prepare_flow(df, "s", "date", "q"), "s", "date")
    out = signal.orderBy("date").toPandas()
    assert len(out) == days and out.resid.isna().sum() == len(gap) and out.pred.notna().all()
    lost = {first + dt.timedelta(days=i) for i in gap}
    for event in events.independent_events(signal, "s", "date", "resid").collect():
        span = {event.start + dt.timedelta(days=i) for i in range(event.duration)}
        assert not span & lost and event.end == max(span)
    found = events.high_anomaly(signal, spectral.seasonal_peak(signal, "s"), "s", "date").collect()
    assert found and not {r.date for r in found} & lost


def test_null_key_is_a_series(flow):
    df, _, _ = flow
    both = df.filter("s = 'calm'").unionByName(df.filter("s = 'calm'").selectExpr("CAST(NULL AS STRING) AS s", "date", "q"))
    rows = {r.s: r for r in flow_regime(both, "s", "date", "q").collect()}
    assert set(rows) == {"calm", None} and rows[None].snr == pytest.approx(rows["calm"].snr)
    assert rows[None].n_floods == rows["calm"].n_floods


def test_strict_regime_refuses_repeated_days_and_null_keys(flow):
    df, _, _ = flow
    calm = df.filter("s = 'calm'")
    assert flow_regime(calm, "s", "date", "q", strict=True).count() == 1
    with pytest.raises(ValueError, match="5 repeated days, 0 rows"):
        flow_regime(calm.union(calm.orderBy("date").limit(5)), "s", "date", "q", strict=True)
    with pytest.raises(ValueError, match="0 repeated days, [1-9]"):
        flow_regime(calm.selectExpr("CAST(NULL AS STRING) AS s", "date", "q"), "s", "date", "q", strict=True)
    with pytest.raises(ValueError, match="reuse"):
        flow_regime(calm, "s", "date", "q", reuse=False, strict=True)


def test_spectrum_and_flag(flow):
    _, ready, truth = flow
    spectra = spectral.spectrum(ready, "s").cache()
    out = spectra.filter("s = 'wild'").orderBy("bin").toPandas()
    np.testing.assert_allclose(out.amplitude, 2 * np.abs(np.fft.rfft(truth["wild"]))[1:] / N, atol=1e-12)
    assert {r.seasonal for r in spectral.seasonal_flag(spectra, "s").collect()} == {"yes"}
    noise = spectra.filter("per_year NOT IN (1.0, 2.0)")
    assert {r.seasonal for r in spectral.seasonal_flag(noise, "s").collect()} == {"no"}


@pytest.mark.parametrize("sizes", [(731, 1096, 2557, 4096), (367, 5000)])
def test_spectrum_of_series_split_over_tasks(spark, sizes):
    rng = np.random.default_rng(17)
    series = {f"s{n}": rng.normal(size=n) for n in sizes}
    rows = [(s, t, len(y), len(y) // 365, float(v)) for s, y in series.items() for t, v in enumerate([*y, 9.0])]
    ready = spark.createDataFrame(rows, "s string, t int, n_days int, n_years int, y double")
    whole = spectral.spectrum(ready, "s").orderBy("s", "bin").toPandas()
    split = spectral.spectrum(ready, "s", whole_days=1000).orderBy("s", "bin").toPandas()
    assert (whole[["s", "bin", "per_year"]] == split[["s", "bin", "per_year"]]).all(axis=None)
    np.testing.assert_allclose(split.amplitude, whole.amplitude, atol=1e-12)
    for s, y in series.items():
        size = np.abs(np.fft.rfft(y)[1:]) * 2 / len(y)
        size[-1] /= 2 if len(y) % 2 == 0 else 1
        np.testing.assert_allclose(split.amplitude[split.s == s], size, atol=1e-12)


def test_missing_and_dry_days_are_filled_or_refused(spark, flow):
    df, _, _ = flow
    holed = df.selectExpr("s", "date", "CASE WHEN day(date) = 3 THEN 0 WHEN day(date) = 5 THEN NULL ELSE q END AS q")
    ready = spectral.prepare_flow(holed, "s", "date", "q")
    assert ready.count() == 2 * (N + 40)
    assert ready.filter("NOT observed AND t < n_days").count() == 2 * 2 * 48
    assert spectral.prepare_flow(holed, "s", "date", "q", max_na=10).isEmpty()


def test_peak_anomaly_and_metrics(flow):
    df, ready, _ = flow
    signal = spectral.seasonal_signal(ready, "s", "date")
    frame = signal.toPandas()
    peak = spectral.seasonal_peak(signal, "s")
    peaks = {r.s: r.peak for r in peak.collect()}
    for s, part in frame.groupby("s"):
        best = part.pred.round(9).max()
        assert peaks[s] == part.jday[part.pred.round(9) == best].min()
    found = events.high_anomaly(signal, peak, "s", "date")
    for r in found.collect():
        season = frame[(frame.s == r.s) & (frame.year == r.year) & frame.jday.between(60, 304)]
        assert r.resid == season.resid.max() and r.timing == r.jday - peaks[r.s]
    assert found.count() == 8  # the 40 days of the fifth year are no season
    assert events.high_anomaly(signal, peak, "s", "date", min_days=245).isEmpty()
    whole = {r.s: r for r in flow_regime(df, "s", "date", "q").collect()}
    floods = events.independent_events(signal, "s", "date", "resid").toPandas()
    calm = floods[floods.s == "calm"]
    assert whole["calm"].n_floods == len(calm)
    assert whole["calm"].sigma_hf == pytest.approx(np.sqrt((calm.extreme**2).mean()))
    assert whole["calm"].event_duration == pytest.approx(calm.groupby("year").duration.mean().mean())


def test_two_reference_days_are_an_error(spark):
    df = spark.createDataFrame([("a", 1.0, 3, 10), ("a", 2.0, 5, 11)], "s string, resid double, timing int, peak int")
    with pytest.raises(Exception, match="reference day"):
        events.summarise_anomaly(df, "s").collect()
