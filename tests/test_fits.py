import math

import numpy as np
import pytest

from scarp.functions import fits, special

RNG = np.random.default_rng(1)


def test_special_functions():
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329) and special.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert special.beta_cdf(0.3, 2, 3) == pytest.approx(0.3483) and special.beta_cdf(0.5, 0.5, 0.5) == pytest.approx(0.5)
    assert special.t_two_sided(0.5, 10) == pytest.approx(0.141113, abs=1e-6)


def test_curves_are_recovered():
    x = np.linspace(0, 1, 21)
    got = fits.fit_sigmoid(x, fits.sigmoid(x, 0.05, 0.6, 12.0, 0.4), max_x=1.0)
    assert [got[k] for k in ("c", "a", "k", "x0")] == pytest.approx([0.05, 0.6, 12.0, 0.4], rel=1e-3)
    n = np.array([1, 2, 5, 10, 50, 100.0])
    got = fits.fit_power_law(n, 0.02 * n**0.8)
    assert (got["a"], got["s"]) == pytest.approx((0.02, 0.8)) and got["r_squared"] == pytest.approx(1)
    assert fits.gini(1.0) == 0 and fits.gini(-1.0) is None
    c = np.linspace(0.05, 5, 60)
    got = fits.fit_kww(c, fits.kww(c, 2.0, 0.7, 1.3), 1000)
    assert (got["a"], got["k"], got["b"]) == pytest.approx((2.0, 0.7, 1.3), rel=1e-4) and not got["b_at_bound"]
    theory = fits.kww_theory(2.0, 0.7, 1.3)
    assert fits.kww(theory["r95"], 2.0, 0.7, 1.3) == pytest.approx(0.05)
    got = fits.fit_generalized_gaussian(c, fits.generalized_gaussian(c, 1.0, 2.0, 0.8, 1.7), 2.0, 1.0)
    assert got["u"] == pytest.approx(2.0, rel=1e-3) and got["b"] == pytest.approx(1.7, rel=1e-3)


def test_too_little_data():
    assert fits.fit_sigmoid([1, 2], [1, 2])["c"] is None and not fits.fit_power_law([1], [1])["success"]
    assert fits.fit_kww([1.0], [1.0], 5) == {"a": 0.0, "k": 0.0, "b": 1.0, "b_at_bound": False, "r_squared": 0.0, "n_values_used": 5}


def stats_of(x):
    u, p = np.clip(x, 1e-8, 1 - 1e-8), np.maximum(x, 1e-12)
    return {
        "n": len(x), "mean": x.mean(), "var": x.var(), "lo": x.min(), "hi": x.max(), "beta_mean": u.mean(), "beta_var": u.var(), "beta_log": np.log(u).mean(),
        "beta_log1m": np.log(1 - u).mean(), "pos_mean": p.mean(), "pos_log": np.log(p).mean(), "pos_log_var": np.log(p).var(),
    }


@pytest.mark.parametrize("name, sample", [("beta", RNG.beta(2, 5, 20000)), ("gaussian", RNG.normal(0.5, 0.05, 20000)), ("uniform", RNG.random(20000)), ("lognormal", np.exp(RNG.normal(-2, 0.4, 20000)))])
def test_the_race_finds_the_sampled_model(name, sample):
    rows = {r["distribution"]: r for r in fits.bic_race(stats_of(sample))}
    best = next(r for r in rows.values() if r["best"])
    if name in ("uniform", "gaussian", "lognormal"):
        assert best["distribution"] == name or rows[name]["bic"] - best["bic"] < 15
    else:
        assert best["distribution"] == name and (best["param1"], best["param2"]) == pytest.approx((2, 5), rel=0.05)


def test_likelihoods_equal_densities():
    x = RNG.beta(2, 5, 500)
    for r in fits.bic_race(stats_of(x)):
        direct = sum(math.log(fits.density_of(r["distribution"], r["param1"], r["param2"], float(v))) for v in x)
        assert r["log_likelihood"] == pytest.approx(direct, rel=1e-6)


def test_mixture_weibull_exponential():
    x = np.concatenate([RNG.normal(5, 0.3, 3000), RNG.uniform(2, 9, 1000)])
    got = fits.mixture_fit(x)
    assert got["p"] == pytest.approx(0.75, abs=0.04) and got["mu"] == pytest.approx(5, abs=0.05)
    assert fits.mixture_quantile(0.5, got) == pytest.approx(np.median(x), abs=0.05)
    values = 2.0 * RNG.weibull(1.5, 20000)
    w = fits.weibull_fit(np.log(values))
    assert (w["shape"], w["scale"]) == pytest.approx((1.5, 2.0), rel=0.03)
    direct = np.log(w["shape"] / w["scale"] * (values / w["scale"]) ** (w["shape"] - 1)) - (values / w["scale"]) ** w["shape"]
    assert w["log_likelihood"] == pytest.approx(direct.sum())
    twice = fits.weibull_fit(np.log(values[:50]), np.full(50, 2.0))
    assert twice["shape"] == pytest.approx(fits.weibull_fit(np.log(np.repeat(values[:50], 2)))["shape"])


def test_dip_tells_one_mode_from_two():
    one, two = RNG.normal(0, 1, 400), np.concatenate([RNG.normal(-4, 0.5, 200), RNG.normal(4, 0.5, 200)])
    assert fits.dip(two) > 3 * fits.dip(one)
    assert fits.dip_test(one, 40)["p_value"] > 0.05 > fits.dip_test(two, 40)["p_value"]


def brute_dip(values):
    """The least d, by trying every mode at a sample point: hulls by definition, over all pairs of points."""
    x = sorted(set(values))
    n = len(values)
    tops = [sum(v <= c for v in values) / n for c in x]
    feet = [sum(v < c for v in values) / n for c in x]

    def below(m):  # at each point before the mode, the lowest chord of feet over it
        worst = 0.0
        for i in range(m):
            chord = feet[i]
            for a in range(i + 1):
                for b in range(i, m + 1):
                    if x[b] > x[a]:
                        chord = min(chord, feet[a] + (feet[b] - feet[a]) * (x[i] - x[a]) / (x[b] - x[a]))
            worst = max(worst, tops[i] - chord)
        return worst / 2

    def above(m):
        worst = 0.0
        for i in range(m + 1, len(x)):
            chord = tops[i]
            for a in range(m, i + 1):
                for b in range(i, len(x)):
                    if x[b] > x[a]:
                        chord = max(chord, tops[a] + (tops[b] - tops[a]) * (x[i] - x[a]) / (x[b] - x[a]))
            worst = max(worst, chord - feet[i])
        return worst / 2

    return max(1 / (2 * n), min(max(below(m), above(m)) for m in range(len(x))))


def test_dip_equals_values_derived_by_hand():
    assert fits.dip(np.linspace(0, 1, 101)) == pytest.approx(1 / 202)
    assert fits.dip(np.concatenate((np.linspace(0, 0.01, 50), np.linspace(0.99, 1, 50)))) == pytest.approx(49 / 198)
    assert fits.dip([0, 0, 0, 1, 1, 1]) == 0.25 and fits.dip([2, 2, 2, 2]) == 1 / 8 and fits.dip([]) == 0


def test_dip_equals_brute_force():
    rng = np.random.default_rng(8)
    for n in range(2, 22):
        values = rng.integers(0, 12, n).tolist() if n % 2 else rng.random(n).tolist()
        assert fits.dip(values) == pytest.approx(brute_dip(values), abs=1e-12)
