"""Models fitted on the driver to reduced data: sufficient statistics, histograms and short curves."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from .special import beta_cdf, digamma, solve_bounded, trigamma

KWW_B_MAX, KWW_B_MIN = 10.0, 1e-6


def information(log_likelihood: float, parameters: int, n: int) -> tuple[float, float]:
    """(AIC, BIC)"""
    return 2 * parameters - 2 * log_likelihood, parameters * math.log(n) - 2 * log_likelihood


def r_squared(observed: np.ndarray, fitted: np.ndarray) -> float:
    total = float(((observed - observed.mean()) ** 2).sum())
    return 1 - float(((observed - fitted) ** 2).sum()) / total if total > 0 else 0.0


def sigmoid(x, c, a, k, x0):
    return c + a / (1 + np.exp(np.clip(k * (x - x0), -700, 700)))


def fit_sigmoid(x, y, decreasing: bool = True, max_x: float | None = None) -> dict:
    """c, a, k, x0 of c + a / (1 + exp(k (x - x0))), c and a not negative; None where it cannot be fitted."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    fine = np.isfinite(y)
    names = ("c", "a", "k", "x0")
    if len(x) < 4 or fine.sum() < 4:
        return dict.fromkeys(names)
    top = float(max_x if max_x is not None else np.max(x))
    start = [np.nanmin(y), np.nanmax(y) - np.nanmin(y), 1.0 if decreasing else -1.0, np.mean(x)]
    slope = (0.0, np.inf) if decreasing else (-np.inf, 0.0)
    found = solve_bounded(sigmoid, x[fine], y[fine], start, [0, 0, slope[0], np.min(x)], [np.inf, np.inf, slope[1], top])
    return dict.fromkeys(names) if found is None else dict(zip(names, map(float, found), strict=True))


def power_law(n, a, s):
    return a * np.power(np.maximum(n, 1e-9), s)


def fit_power_law(percent, share) -> dict:
    """a, s of share = a * percent^s with r_squared and n_points; success tells whether there was enough."""
    points = np.array([(p, q) for p, q in zip(np.asarray(percent, float), np.asarray(share, float), strict=True) if p > 0 and np.isfinite(p) and np.isfinite(q)]).reshape(-1, 2)
    x, y = points.T
    found = solve_bounded(power_law, x, y, _straight_line(np.log(x), y), [1e-30, -20], [1e30, 30]) if len(x) > 1 else None
    if found is None:
        return {"success": False, "a": None, "s": None, "r_squared": None, "n_points": len(x)}
    varies = len(y) * float(y.var()) > 1e-15
    return {"success": True, "a": float(found[0]), "s": float(found[1]), "r_squared": r_squared(y, power_law(x, *found)) if varies else 0.0, "n_points": len(x)}


def _straight_line(log_x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, s) of the line through the logs of the points above 0, where two of them differ; else a flat guess."""
    above = y > 1e-15
    u, v = log_x[above], np.log(y[above])
    if len(u) < 2 or np.ptp(u) == 0:
        return 1e-4, 1.0
    s = float(((u - u.mean()) * (v - v.mean())).sum() / ((u - u.mean()) ** 2).sum())
    return math.exp(float(v.mean()) - s * float(u.mean())), s


def gini(s: float | None) -> float | None:
    """Gini coefficient of a power law with exponent s."""
    return None if s is None or not math.isfinite(s) or abs(s + 1) < 1e-12 else (s - 1) / (s + 1)


def kww(x, a, k, b):
    return a * np.exp(-k * np.power(np.maximum(x, 0), b))


def fit_kww(centers, density, n_values: int, b_max: float = KWW_B_MAX) -> dict:
    """a, k, b of a stretched exponential through a density histogram; zeros if there is too little."""
    centers, density = np.asarray(centers, float), np.asarray(density, float)
    empty = {"a": 0.0, "k": 0.0, "b": 1.0, "b_at_bound": False, "r_squared": 0.0, "n_values_used": int(n_values)}
    if n_values < 10 or len(centers) < 5:
        return empty
    found = solve_bounded(kww, centers, density, [density.max(), 1.0, 0.5], [0, 0, KWW_B_MIN], [np.inf, np.inf, b_max])
    if found is None:
        return empty
    a, k, b = map(float, found)
    at_bound = b >= b_max * (1 - 1e-6) or b <= KWW_B_MIN * (1 + 1e-6)
    return {"a": a, "k": k, "b": b, "b_at_bound": bool(at_bound), "r_squared": r_squared(density, kww(centers, a, k, b)), "n_values_used": int(n_values)}


def kww_theory(a: float, k: float, b: float) -> dict:
    """r95, where the density has fallen to 0.05, and the mean of the decay."""
    if k <= 0 or b <= 0:
        return {"r95": None, "expected": None}
    r95 = (-math.log(0.05 / a) / k) ** (1 / b) if a > 0.05 else None
    try:
        expected = math.gamma(1 + 1 / b) / k ** (1 / b)
    except OverflowError:
        expected = None
    return {"r95": r95, "expected": expected}


def generalized_gaussian(x, a, u, s, b):
    return a * np.exp(-np.power(np.abs(x - u) / s, b))


def fit_generalized_gaussian(centers, density, mean: float, std: float) -> dict:
    centers, density = np.asarray(centers, float), np.asarray(density, float)
    found = solve_bounded(generalized_gaussian, centers, density, [density.max(), mean, std, 2.0], [0, -np.inf, 1e-12, 0.1], [np.inf, np.inf, np.inf, 20.0])
    if found is None:
        return dict.fromkeys(("a", "u", "s", "b", "r_squared"))
    return dict(zip(("a", "u", "s", "b"), map(float, found), strict=True)) | {"r_squared": r_squared(density, generalized_gaussian(centers, *found))}


def normal_fit(n: int, mean: float, variance: float) -> dict:
    """Maximum likelihood from count, mean and population variance."""
    ll = -0.5 * n * (math.log(2 * math.pi * variance) + 1)
    aic, bic = information(ll, 2, n)
    return {"mu": mean, "sigma": math.sqrt(variance), "log_likelihood": ll, "aic": aic, "bic": bic, "n_values": n}


def beta_fit(mean: float, variance: float, mean_log: float, mean_log1m: float) -> tuple[float, float]:
    """(a, b) of a beta distribution by Newton's method on the two likelihood equations."""
    common = mean * (1 - mean) / variance - 1 if variance > 0 else 1.0
    a, b = max(mean * common, 1e-3), max((1 - mean) * common, 1e-3)
    for _ in range(200):
        s = digamma(a + b)
        fa, fb = mean_log - digamma(a) + s, mean_log1m - digamma(b) + s
        t = trigamma(a + b)
        ha, hb = t - trigamma(a), t - trigamma(b)
        det = ha * hb - t * t
        da, db = (hb * fa - t * fb) / det, (ha * fb - t * fa) / det
        step = 1.0
        while a - step * da <= 0 or b - step * db <= 0:
            step /= 2
        a, b = a - step * da, b - step * db
        if abs(da) < 1e-12 * a and abs(db) < 1e-12 * b:
            break
    return a, b


def gamma_fit(mean: float, mean_log: float) -> tuple[float, float]:
    """(shape, scale)"""
    gap = math.log(mean) - mean_log
    if gap <= 0:
        return 1.0, mean
    k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(100):
        step = (math.log(k) - digamma(k) - gap) / (1 / k - trigamma(k))
        k = k - step if k - step > 0 else k / 2
        if abs(step) < 1e-13 * k:
            break
    return k, mean / k


def bic_race(s: dict) -> list[dict]:
    """The five two-parameter models in fixed order, from sufficient statistics.

    s: n, mean, var, lo, hi; beta_mean, beta_var, beta_log, beta_log1m (clipped to the open unit
    interval); pos_mean, pos_log, pos_log_var (floored above zero).
    """
    n, out = s["n"], []

    def add(name, parameters, ll):
        fine = ll is not None and math.isfinite(ll)
        out.append({"distribution": name, "param1": parameters[0], "param2": parameters[1], "log_likelihood": ll if fine else None, "bic": information(ll, 2, n)[1] if fine else None})

    var = s["var"]
    add("gaussian", (s["mean"], math.sqrt(var)), -0.5 * n * (math.log(2 * math.pi * var) + 1) if var > 0 else None)
    a, b = beta_fit(s["beta_mean"], s["beta_var"], s["beta_log"], s["beta_log1m"])
    log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    add("beta", (a, b), n * ((a - 1) * s["beta_log"] + (b - 1) * s["beta_log1m"] - log_b))
    k, scale = gamma_fit(s["pos_mean"], s["pos_log"])
    add("gamma", (k, scale), n * ((k - 1) * s["pos_log"] - s["pos_mean"] / scale - k * math.log(scale) - math.lgamma(k)))
    v = s["pos_log_var"]
    add("lognormal", (s["pos_log"], math.sqrt(v)), -n * s["pos_log"] - 0.5 * n * (math.log(2 * math.pi * v) + 1) if v > 0 else None)
    span = s["hi"] - s["lo"]
    add("uniform", (s["lo"], s["hi"]), -n * math.log(span) if span > 0 else None)
    ranked = [r for r in out if r["bic"] is not None]
    best = min(ranked, key=lambda r: r["bic"])["distribution"] if ranked else None
    return [r | {"best": r["distribution"] == best} for r in out]


def density_of(name: str, p: float, q: float, x: float) -> float:
    """A fitted model's density at x, as plot tables need it."""
    if name == "gaussian":
        return NormalDist(p, q).pdf(x)
    if name == "uniform":
        return 1 / (q - p) if p <= x <= q else 0.0
    if name == "beta":
        if not 0 < x < 1:
            return 0.0
        return math.exp((p - 1) * math.log(x) + (q - 1) * math.log1p(-x) - math.lgamma(p) - math.lgamma(q) + math.lgamma(p + q))
    if x <= 0:
        return 0.0
    if name == "gamma":
        return math.exp((p - 1) * math.log(x) - x / q - p * math.log(q) - math.lgamma(p))
    if name == "lognormal":
        return math.exp(-((math.log(x) - p) ** 2) / (2 * q * q)) / (x * q * math.sqrt(2 * math.pi))
    raise ValueError(f"unknown distribution {name!r}")


def beta_distance(a: float, b: float, lo: float, hi: float, n: int, counts: np.ndarray, edges: np.ndarray) -> dict:
    """Moments of a beta fit on both axes, and how well it meets a histogram of the distances."""
    m, f = a / (a + b), a + b
    variance = m * (1 - m) / (f + 1)
    span = hi - lo
    mean_d, std_d = lo + m * span, math.sqrt(variance) * span
    u = np.clip((edges - lo) / span, 0, 1)
    cdf = np.array([beta_cdf(float(x), a, b) for x in u])
    return {
        "a": a, "b": b, "m": m, "f": f, "variance": variance, "std": math.sqrt(variance), "cv": math.sqrt(variance) / m if m > 1e-15 else None,
        "mean_distance": mean_d, "variance_distance": variance * span * span, "std_distance": std_d, "cv_distance": std_d / mean_d if mean_d > 1e-15 else None,
        "r_squared": r_squared(counts.astype(float), n * np.diff(cdf)), "scale_lo": lo, "scale_hi": hi, "n_values_used": n,
    }


def mixture_fit(values: np.ndarray, counts: np.ndarray | None = None, lo: float | None = None, hi: float | None = None, rounds: int = 500) -> dict:
    """p * Normal(mu, sigma) + (1 - p) * Uniform(min, max) by expectation-maximization.

    values may be the means of fine bins with `counts` in each, and lo, hi the ends of the values themselves.
    """
    x = np.asarray(values, float)
    w = np.ones(len(x)) if counts is None else np.asarray(counts, float)
    x, w = x[np.isfinite(x)], w[np.isfinite(x)]
    n = float(w.sum())
    if n < 2:
        raise ValueError("a mixture needs two values at least")
    lo, hi, mu = (x.min() if lo is None else lo), (x.max() if hi is None else hi), float((w * x).sum() / n)
    sigma, p = max(math.sqrt(float((w * (x - mu) ** 2).sum() / n)), 1e-12), 0.7
    flat = 1 / (hi - lo) if hi > lo else 1.0
    last = -np.inf
    for _ in range(rounds):
        bell = p * np.exp(-((x - mu) ** 2) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))
        total = np.maximum(bell + (1 - p) * flat, 1e-300)
        ll = float((w * np.log(total)).sum())
        if ll - last < 1e-10 * abs(ll):
            break
        last = ll
        share = w * bell / total
        weight = share.sum()
        p, mu = float(weight / n), float((share * x).sum() / weight)
        sigma = max(math.sqrt(float((share * (x - mu) ** 2).sum() / weight)), 1e-9)
    aic, bic = information(ll, 5, n)
    return {"p": p, "mu": mu, "sigma": sigma, "a": float(lo), "b": float(hi), "n_values": int(n), "log_likelihood": ll, "aic": aic, "bic": bic}


def mixture_quantile(q: float, f: dict) -> float:
    """By bisection of the mixture's distribution function."""
    bell = NormalDist(f["mu"], f["sigma"])
    low, high = min(f["a"], f["mu"] - 10 * f["sigma"]), max(f["b"], f["mu"] + 10 * f["sigma"])
    for _ in range(80):
        x = (low + high) / 2
        flat = min(max((x - f["a"]) / (f["b"] - f["a"]), 0.0), 1.0) if f["b"] > f["a"] else float(x >= f["a"])
        if f["p"] * bell.cdf(x) + (1 - f["p"]) * flat < q:
            low = x
        else:
            high = x
    return (low + high) / 2


def exponential_fit(n: int, mean: float) -> dict:
    ll = -n * (math.log(mean) + 1)
    aic, bic = information(ll, 1, n)
    return {"scale": mean, "log_likelihood": ll, "aic": aic, "bic": bic}


def weibull_fit(logs: np.ndarray, counts: np.ndarray | None = None, rounds: int = 200) -> dict:
    """Shape and scale with location 0, by Newton's method on the shape, from logs of the values (or bins' mean logs with counts)."""
    logs = np.asarray(logs, float)
    c = np.ones(len(logs)) if counts is None else np.asarray(counts, float)
    n, mean, k = float(c.sum()), float((c * logs).sum() / c.sum()), 1.0
    centred = logs - mean  # scale the values to a geometric mean of 1, so that no power overflows
    for _ in range(rounds):
        w = c * np.exp(k * centred)
        s0, s1, s2 = w.sum(), (w * centred).sum(), (w * centred * centred).sum()
        step = (s1 / s0 - 1 / k) / ((s2 * s0 - s1 * s1) / (s0 * s0) + 1 / (k * k))
        k = k - step if k - step > 0 else k / 2
        if abs(step) < 1e-12 * k:
            break
    power = float((c * np.exp(k * centred)).sum())
    log_scale = mean + math.log(power / n) / k
    ll = n * (math.log(k) - k * log_scale) + (k - 1) * n * mean - power * math.exp(k * (mean - log_scale))
    aic, bic = information(ll, 2, n)
    return {"shape": float(k), "scale": math.exp(log_scale), "log_likelihood": float(ll), "aic": aic, "bic": bic}


def dip(values: np.ndarray) -> float:
    """Hartigan's dip: the least distance between a sample's distribution and any unimodal one.

    With its mode at a sample point, a unimodal distribution is convex before and concave after it. Below
    the mode the nearest convex function is half-way between the sample's steps and the greatest convex minorant of their
    feet; above it, likewise with the least concave majorant of their tops. The first distance grows with the
    mode and the second falls, so the least larger one is found by bisection.
    """
    x, counts = np.unique(np.asarray(values, float), return_counts=True)
    n = int(counts.sum())
    if not n:
        return 0.0
    tops = np.cumsum(counts) / n
    feet = tops - counts / n

    def before(m: int) -> float:
        return _off(x[: m + 1], feet[: m + 1], tops[: m + 1])

    def after(m: int) -> float:
        return _off(-x[m:][::-1], 1 - tops[m:][::-1], 1 - feet[m:][::-1])

    low, high = 0, len(x) - 1
    while low < high:
        mid = (low + high) // 2
        if before(mid) >= after(mid):
            high = mid
        else:
            low = mid + 1
    near = [max(before(m), after(m)) for m in (low - 1, low) if m >= 0]
    return max(min(near), 1 / (2 * n))


def _off(x: np.ndarray, feet: np.ndarray, tops: np.ndarray) -> float:
    """Half the largest gap between the greatest convex minorant of (x, feet) and the tops before the last point."""
    if len(x) < 2:
        return 0.0
    hull: list[int] = []
    xs, ys = x.tolist(), feet.tolist()
    for i in range(len(xs)):
        while len(hull) > 1 and (xs[hull[-1]] - xs[hull[-2]]) * (ys[i] - ys[hull[-2]]) <= (ys[hull[-1]] - ys[hull[-2]]) * (xs[i] - xs[hull[-2]]):
            hull.pop()
        hull.append(i)
    return float((tops - np.interp(x, x[hull], feet[hull]))[:-1].max()) / 2


#: Size of the uniform samples behind the dip's p value.
DIP_SAMPLE = 2000


def dip_test(values: np.ndarray, trials: int = 200, seed: int = 42) -> dict:
    """The dip and its p value against seeded uniform samples.

    The dip of n uniform values falls with the square root of n, so samples of at most DIP_SAMPLE
    values are drawn and their dips scaled to n.
    """
    found = dip(values)
    rng = np.random.default_rng(seed)
    n = min(len(values), DIP_SAMPLE)
    scale = math.sqrt(len(values) / n) if n else 1.0
    null = [dip(rng.random(n)) / scale for _ in range(trials)]
    return {"dip": found, "p_value": float(np.mean([d >= found for d in null])), "n_values": len(values)}
