import numpy as np
import pytest

from pulsegrid.operators.spikes import VITALS, find_spikes, fit_ar, flag_measurements, judge_series


def series(n=400, seed=0, sd=1.5, level=80.0):
    return np.round(level + np.random.default_rng(seed).normal(0, sd, n), 1)


def test_spikes_are_found_and_levels_kept():
    v = series()
    v[50] += 40
    v[100:103] -= 30
    v[200:] += 25  # a lasting change
    v[300:312] += np.linspace(0, 20, 12)  # a slow episode
    assert np.flatnonzero(find_spikes(v, VITALS["HR"].floor)).tolist() == [50, 100, 101, 102]


def test_restless_stretches_are_genuine():
    """Of 700 readings in ten restless stretches hardly any looks like an excursion (one at a stretch's end may)."""
    found = 0
    for seed in range(1, 11):
        v = series(seed=seed)
        v[150:220] = 80 + np.random.default_rng(seed + 1).normal(0, 9, 70)
        found += find_spikes(v, VITALS["HR"].floor).sum()
    assert found <= 7


def test_limits_and_stuck_runs():
    v = series(60, seed=3)
    v[10], v[20] = 0.0, 999.0
    v[30:39] = 77.7
    v[45:53] = 71.1
    flags = judge_series(v, VITALS["HR"])
    assert np.flatnonzero(flags == "limit").tolist() == [10, 20]
    assert np.flatnonzero(flags == "stuck").tolist() == list(range(30, 39))
    assert not (flags == "spike").any()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_short_series(n):
    assert len(judge_series(np.arange(n, dtype=float) + 70, VITALS["HR"])) == n


def test_autoregression():
    rng, x = np.random.default_rng(5), [0.0]
    for _ in range(3000):
        x.append(0.6 * x[-1] + rng.normal())
    x = np.array(x)
    x[::97] += 30
    assert abs(fit_ar(x, 1)[0] - 0.6) < 0.1


def frame(spark, v, times=None):
    rows = [(i, 1, float(t), float(x)) for i, (t, x) in enumerate(zip(times if times is not None else np.arange(len(v)) * 60.0, v))]
    return rows, spark.createDataFrame(rows, "id long, s long, t double, HR double")


def test_chunks_do_not_matter(spark):
    v = series(3000, seed=7)
    v[[500, 1023, 1024, 2047]] += 50
    v[1018:1030] = 66.6
    v[1500:1509] = 88.8
    _, df = frame(spark, v)
    one = {"HR": VITALS["HR"]}
    got = [sorted(map(tuple, flag_measurements(df, "id", "s", "t", one, chunk=c, bucket_seconds=b).collect())) for c, b in ((4096, 21600.0), (512, 900.0))]
    assert got[0] == got[1]
    assert {(500, "HR", "spike"), (2047, "HR", "spike"), (1029, "HR", "stuck"), (1508, "HR", "stuck")} <= set(got[0])


def test_copies_nulls_and_clashes(spark):
    v = series(40, seed=8)
    v[20] += 60
    rows, _ = frame(spark, v)
    rows += [(100, 1, 1200.0, float(v[20])), (101, 1, None, 9999.0), (102, None, 5.0, 9999.0), (103, 1, 30.0, None), (104, 1, 31.0, float("nan"))]
    df = spark.createDataFrame([(*r, "c", "f") for r in rows], "id long, s long, t double, HR double, channel string, flag string")
    got = sorted(map(tuple, flag_measurements(df, "id", "s", "t", {"HR": VITALS["HR"]}).collect()))
    assert got == [(20, "HR", "spike"), (100, "HR", "spike")]
    assert flag_measurements(df.limit(0), "id", "s", "t", {"HR": VITALS["HR"]}).count() == 0


def test_rounds_go_on_until_nothing_new_is_found():
    r = np.random.default_rng(100)
    n = int(r.integers(40, 200))
    v = 80 + np.cumsum(r.normal(0, 0.3, n)) + r.normal(0, 1, n)
    at = r.choice(n, n // 4, replace=False)
    v[at] += r.choice([-1, 1], n // 4) * 10 * np.exp(r.uniform(0, 3, n // 4))
    assert find_spikes(v, VITALS["HR"].floor).sum() == 29  # 27 after six rounds


def test_long_series_are_judged_as_a_whole(spark):
    """A noisy, autocorrelated series with changing spread: in chunks of any length it gets the flags of the whole one."""
    rng, n = np.random.default_rng(11), 6000
    r = np.zeros(n)
    for i in range(1, n):
        r[i] = 0.5 * r[i - 1] + rng.normal(0, 1.0 + (i // 700) % 3)
    v = np.round(90 + r + 6 * np.sin(np.arange(n) / 400), 1)
    at = rng.choice(np.arange(10, n - 10), 150, replace=False)
    v[at] += rng.choice([-1, 1], 150) * rng.uniform(8, 40, 150)
    rows, df = frame(spark, v)
    df = df.unionByName(spark.createDataFrame([(7000 + i, 2, float(i), 80.0 + i % 3 + 60.0 * (i == 20)) for i in range(40)], df.schema))
    one = {"HR": VITALS["HR"]}
    got = [sorted(map(tuple, flag_measurements(df, "id", "s", "t", one, chunk=c).collect())) for c in (600, 1000, 10_000)]
    alone = [(int(i), "HR", f) for i, f in enumerate(judge_series(v, VITALS["HR"])) if f]
    assert got[2] == [*alone, (7020, "HR", "spike")] and len(alone) > 100
    assert got[0] == got[2] and got[1] == got[2]


def test_short_series_get_an_autoregression():
    from pulsegrid.operators.spikes import Innovations, solve

    rng, x = np.random.default_rng(2), [0.0]
    for _ in range(59):
        x.append(0.8 * x[-1] + rng.normal(0, 2))
    s = Innovations(np.array(x) + 80)
    coef, spread = solve(s.moments())
    assert coef.any() and spread > 0
    whole, half = s.moments(), s.moments(np.arange(60) < 30) + s.moments(np.arange(60) >= 30)
    assert np.allclose(whole, half)
