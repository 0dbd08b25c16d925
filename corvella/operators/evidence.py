"""Meta-analysis as aggregates keyed by ``meta_id``: any number of analyses in one job.

Ratio measures are pooled on the log scale. Outputs keep the scales apart: ``estimate``, ``ci_lower``,
``ci_upper`` on the pooling scale, ``value`` and its limits on the natural scale, transformed once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.functions.stats import chi2_p, normal_p, normal_quantile, t_p
from corvella.plans.storage import materialise

Z95 = 1.96
RATIOS = ("OR", "RR", "HR")


def continuous(arms: DataFrame, smd: str = "hedges") -> DataFrame:
    """Mean and standardised differences from m1, sd1, n1, m2, sd2, n2."""
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(((n1 - 1) * F.col("sd1") ** 2 + (n2 - 1) * F.col("sd2") ** 2) / (n1 + n2 - 2))
    diff = F.col("m1") - F.col("m2")
    d = diff / (F.col("sd2") if smd == "glass" else pooled)
    j = 1 - 3 / (4 * (n1 + n2) - 9) if smd == "hedges" else F.lit(1.0)
    var_d = (n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2))
    return arms.select(
        "*", diff.alias("md"), (F.col("sd1") ** 2 / n1 + F.col("sd2") ** 2 / n2).alias("md_variance"), (d * j).alias("smd"), (var_d * j * j).alias("smd_variance"),
        (d * j - Z95 * F.sqrt(var_d) * j).alias("smd_lower"), (d * j + Z95 * F.sqrt(var_d) * j).alias("smd_upper"),
    )


def dichotomous(cells: DataFrame, measure: str = "OR") -> DataFrame:
    """y and v of each 2x2 table (a of n1, c of n2) on the pooling scale (E2); half a count is added where a cell is 0."""
    a0, c0 = F.col("a").cast("double"), F.col("c").cast("double")
    b0, d0 = F.col("n1") - a0, F.col("n2") - c0
    if measure == "RD":
        p, q = a0 / F.col("n1"), c0 / F.col("n2")
        return cells.withColumn("y", p - q).withColumn("v", p * (1 - p) / F.col("n1") + q * (1 - q) / F.col("n2"))
    add = F.when(F.least(a0, b0, c0, d0) == 0, 0.5).otherwise(0.0)
    a, b, c, d = a0 + add, b0 + add, c0 + add, d0 + add
    if measure == "OR":
        return cells.withColumn("y", F.ln(a * d / (b * c))).withColumn("v", 1 / a + 1 / b + 1 / c + 1 / d)
    return cells.withColumn("y", F.ln((a / (a + b)) / (c / (c + d)))).withColumn("v", 1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))


def from_interval(rows: DataFrame, log_scale: bool = True) -> DataFrame:
    """y, se, v from value, ci_lower, ci_upper (E3): the interval is 2 * 1.96 standard errors wide."""
    f = F.ln if log_scale else (lambda c: F.col(c) if isinstance(c, str) else c)
    se = (f(F.col("ci_upper")) - f(F.col("ci_lower"))) / (2 * Z95)
    return rows.withColumn("y", f(F.col("value"))).withColumn("se", se).withColumn("v", se * se)


def relative_risk_reduction(rr: Column) -> Column:
    return 1 - rr


def number_needed_to_treat(value: Column, baseline: Column, measure: str) -> Column:
    """1 / |risk difference| at a baseline risk."""
    risk = {"RR": value * baseline, "OR": value * baseline / (1 - baseline + value * baseline), "RD": baseline + value}[measure]
    return F.when(risk != baseline, 1 / F.abs(baseline - risk))


def interval(y: Column, se: Column, level: float = 0.95) -> tuple[Column, Column]:
    z = normal_quantile(0.5 + level / 2)
    return y - z * se, y + z * se


def _sums(effects: DataFrame, keys: list[str]) -> DataFrame:
    w = 1 / F.col("v")
    return effects.filter("v > 0 AND y IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * F.col("y")).alias("swy"), F.sum(w * F.col("y") ** 2).alias("swyy"), F.sum(w * w).alias("sww"))


def _heterogeneity(s: DataFrame) -> DataFrame:
    q = F.greatest(F.col("swyy") - F.col("swy") ** 2 / F.col("sw"), F.lit(0.0))
    s = s.withColumn("q", q).withColumn("df", F.col("k") - 1)
    c = F.col("sw") - F.col("sww") / F.col("sw")
    tau2 = F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / c)).otherwise(0.0)
    return s.withColumn("tau2", tau2).withColumn("i2", F.when((F.col("q") > 0) & (F.col("k") > 1), F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q") * 100)).otherwise(0.0)).withColumn("h2", F.when(F.col("df") > 0, F.col("q") / F.col("df")).otherwise(1.0))


def _result(x: DataFrame, keys: list[str], estimate: Column, variance: Column, ratio: bool, *more: str) -> DataFrame:
    se = F.sqrt(variance)
    lo, hi = estimate - Z95 * se, estimate + Z95 * se
    nat = F.exp if ratio else (lambda c: c)
    return x.select(*keys, "k", estimate.alias("estimate"), se.alias("se"), nat(estimate).alias("value"), nat(lo).alias("ci_lower"), nat(hi).alias("ci_upper"), *more)


def pool_fixed(effects: DataFrame, keys: list[str], ratio: bool = False) -> DataFrame:
    """Inverse-variance pooling with Q, I2 and H2 (E5): one aggregate."""
    x = _heterogeneity(_sums(effects, keys))
    return _result(x, keys, F.col("swy") / F.col("sw"), 1 / F.col("sw"), ratio, "q", "df", "i2", "h2")


def pool_random(effects: DataFrame, keys: list[str], ratio: bool = False) -> DataFrame:
    """DerSimonian-Laird (E6): sums, then sums with the between-study variance added."""
    t = _heterogeneity(_sums(effects, keys)).select(*keys, "tau2", "q", "df", "i2")
    again = effects.filter("v > 0 AND y IS NOT NULL").join(t, keys)
    w = 1 / (F.col("v") + F.col("tau2"))
    s = again.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"), *[F.first(c).alias(c) for c in ("tau2", "q", "df", "i2")])
    return _result(s, keys, F.col("wy") / F.col("w"), 1 / F.col("w"), ratio, "tau2", "q", "df", "i2")


def with_p(pooled: DataFrame) -> DataFrame:
    """p of the estimate and of heterogeneity."""
    return pooled.withColumn("p", normal_p(F.col("estimate") / F.col("se"))).withColumn("q_p", chi2_p(F.col("q"), F.col("df").cast("double")))


def mantel_haenszel(cells: DataFrame, keys: list[str], measure: str = "OR") -> DataFrame:
    """Mantel-Haenszel OR with the Robins-Breslow-Greenland variance, or RR."""
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    b, d, n = F.col("n1") - a, F.col("n2") - c, (F.col("n1") + F.col("n2")).cast("double")
    if measure == "OR":
        r, s, p, q = a * d / n, b * c / n, (a + d) / n, (b + c) / n
        g = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("mid"), F.sum(q * s).alias("qs"))
        var = F.col("pr") / (2 * F.col("r") ** 2) + F.col("mid") / (2 * F.col("r") * F.col("s")) + F.col("qs") / (2 * F.col("s") ** 2)
    else:
        n1, n2 = F.col("n1"), F.col("n2")
        g = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(a * n2 / n).alias("r"), F.sum(c * n1 / n).alias("s"), F.sum((n1 * n2 * (a + c) - a * c * n) / (n * n)).alias("num"))
        var = F.col("num") / (F.col("r") * F.col("s"))
    return _result(g, keys, F.ln(F.col("r") / F.col("s")), var, True)


def peto(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Peto's one-step odds ratio."""
    n, m = (F.col("n1") + F.col("n2")).cast("double"), (F.col("a") + F.col("c")).cast("double")
    oe = F.col("a") - F.col("n1") * m / n
    v = F.col("n1") * F.col("n2") * m * (n - m) / (n * n * (n - 1))
    g = cells.filter("n1 + n2 > 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(oe).alias("oe"), F.sum(v).alias("v"))
    return _result(g, keys, F.col("oe") / F.col("v"), 1 / F.col("v"), True)


def _tau2_root(y: np.ndarray, v: np.ndarray, method: str) -> float:
    def score(t: float) -> float:
        w = 1 / (v + t)
        mu = (w * y).sum() / w.sum()
        if method == "paule_mandel":
            return (w * (y - mu) ** 2).sum() - (len(y) - 1)
        s = (w * w * (y - mu) ** 2).sum() - w.sum()
        return s + (w * w).sum() / w.sum() if method == "reml" else s

    lo, hi = 0.0, max(10 * float(np.var(y, ddof=1)) if len(y) > 1 else 0.0, 10.0)
    if len(y) < 2 or score(0.0) <= 0:
        return 0.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if score(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def pool_iterative(effects: DataFrame, keys: list[str], method: str = "reml", ratio: bool = False) -> DataFrame:
    """REML, ML or Paule-Mandel (E9): the root of the score equation for the between-study variance, per analysis."""
    schema = ", ".join([*(f"{k} {effects.schema[k].dataType.simpleString()}" for k in keys), "k long, tau2 double, w double, wy double"])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        y, v = f["y"].to_numpy(float), f["v"].to_numpy(float)
        t = _tau2_root(y, v, method)
        w = 1 / (v + t)
        return pd.DataFrame([{**{k: f[k].iloc[0] for k in keys}, "k": len(y), "tau2": t, "w": w.sum(), "wy": (w * y).sum()}])

    x = effects.filter("v > 0 AND y IS NOT NULL").select(*keys, "y", "v").groupBy(*keys).applyInPandas(run, schema)
    return _result(x, keys, F.col("wy") / F.col("w"), 1 / F.col("w"), ratio, "tau2")


def empirical_bayes(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Paule-Mandel pooling with each study shrunk towards it."""
    p = pool_iterative(effects, keys, "paule_mandel").select(*keys, F.col("estimate").alias("mu"), "tau2")
    share = F.when(F.col("tau2") > 0, F.col("tau2") / (F.col("tau2") + F.col("v"))).otherwise(0.0)
    return effects.join(p, keys).withColumn("shrunk", share * F.col("y") + (1 - share) * F.col("mu"))


def subgroup_test(effects: DataFrame, key: str, group: str) -> DataFrame:
    """Q between groups (E11): total Q over all studies less the groups' own, at least 0, with p."""
    total = _heterogeneity(_sums(effects, [key])).select(key, F.col("q").alias("q_total"))
    within = _heterogeneity(_sums(effects.filter(F.col(group).isNotNull()), [key, group])).groupBy(key).agg(F.sum("q").alias("q_within"), F.count(F.lit(1)).alias("groups"))
    x = total.join(within, key).withColumn("q_between", F.greatest(F.lit(0.0), F.col("q_total") - F.col("q_within"))).withColumn("df", F.col("groups") - 1)
    return x.withColumn("p", chi2_p(F.col("q_between"), F.col("df").cast("double")))


def leave_one_out(effects: DataFrame, key: str, study: str) -> DataFrame:
    """Fixed-effect estimate without each study, analyses of three or more (E12): totals less the study's own term."""
    w = Window.partitionBy(key)
    x = effects.filter("v > 0").withColumn("w", 1 / F.col("v")).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("sw", F.sum("w").over(w)).withColumn("swy", F.sum(F.col("w") * F.col("y")).over(w)).filter("n >= 3")
    left = F.col("sw") - F.col("w")
    return x.select(key, study, ((F.col("swy") - F.col("w") * F.col("y")) / left).alias("estimate"), F.sqrt(1 / left).alias("se"))


def cumulative(effects: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Fixed-effect estimate over the first 2, 3, ... studies."""
    o = Window.partitionBy(key).orderBy(*order)
    w = o.rowsBetween(Window.unboundedPreceding, 0)
    x = effects.filter("v > 0").withColumn("k", F.row_number().over(o)).withColumn("sw", F.sum(1 / F.col("v")).over(w)).withColumn("swy", F.sum(F.col("y") / F.col("v")).over(w))
    return x.filter("k >= 2").select(key, "k", "study_id", (F.col("swy") / F.col("sw")).alias("estimate"), F.sqrt(1 / F.col("sw")).alias("se"))


def influence(effects: DataFrame, key: str, study: str) -> DataFrame:
    """Change of the estimate when a study is left out, in standard errors, and squared over the mean variance."""
    full = pool_fixed(effects, [key]).select(key, F.col("estimate").alias("full"))
    loo = leave_one_out(effects, key, study).join(full, key)
    mean_v = effects.groupBy(key).agg(F.avg("v").alias("mean_v"))
    d = F.col("full") - F.col("estimate")
    return loo.join(mean_v, key).select(key, study, (d / F.col("se")).alias("dffits"), (d * d / F.col("mean_v")).alias("cook"))


def _ols(x: DataFrame, keys: list[str], px: Column, py: Column, w: Column | None = None) -> DataFrame:
    """Intercept, slope and their t values of (weighted) least squares, from sums alone."""
    w = F.lit(1.0) if w is None else w
    g = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("s"), F.sum(w * px).alias("sx"), F.sum(w * py).alias("sy"), F.sum(w * px * px).alias("sxx"), F.sum(w * px * py).alias("sxy"), F.sum(w * py * py).alias("syy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") ** 2
    g = g.withColumn("slope", (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("s"))
    rss = F.greatest(F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    g = g.withColumn("s2", rss / (F.col("n") - 2)).withColumn("t", F.col("intercept") / F.sqrt(F.col("s2") * F.col("sxx") / det)).withColumn("t_slope", F.col("slope") / F.sqrt(F.col("s2") * F.col("s") / det))
    return g.filter("n >= 3")


def egger(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Regression of y / se on 1 / se: t of the intercept."""
    e = effects.filter("v > 0").withColumn("se", F.sqrt("v"))
    return _ols(e, keys, 1 / F.col("se"), F.col("y") / F.col("se")).select(*keys, "n", "intercept", "slope", "t").withColumn("p", t_p(F.col("t"), (F.col("n") - 2).cast("double")))


def harbord(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Regression of (O - E) / sqrt(V) on sqrt(V)."""
    n, m = (F.col("n1") + F.col("n2")).cast("double"), (F.col("a") + F.col("c")).cast("double")
    x = cells.withColumn("rv", F.sqrt(F.col("n1") * F.col("n2") * m * (n - m) / (n * n * (n - 1)))).withColumn("z", F.col("a") - F.col("n1") * m / n).filter("rv > 0")
    return _ols(x, keys, F.col("rv"), F.col("z") / F.col("rv")).select(*keys, "n", "intercept", "slope", "t").withColumn("p", t_p(F.col("t"), (F.col("n") - 2).cast("double")))


def peters(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted regression of the log odds ratio on 1 / N (E16): t of the intercept, and of the slope as published."""
    a, c = F.col("a") + 0.5, F.col("c") + 0.5
    b, d, n = F.col("n1") - F.col("a") + 0.5, F.col("n2") - F.col("c") + 0.5, (F.col("n1") + F.col("n2")).cast("double")
    x = cells.withColumn("y", F.ln(a * d / (b * c))).withColumn("wt", 1 / (1 / (a + c) + 1 / (b + d))).withColumn("inv", 1 / n)
    return _ols(x, keys, F.col("inv"), F.col("y"), F.col("wt")).select(*keys, "n", "intercept", "t", "slope", "t_slope")


def begg(effects: DataFrame, key: str, study: str) -> DataFrame:
    """Kendall's tau-b of effect and variance."""
    e = effects.select(key, study, "y", "v")
    x, y = e.alias("x"), e.alias("y")
    p = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col(f"x.{study}") < F.col(f"y.{study}")))
    dy, dv = F.signum(F.col("x.y") - F.col("y.y")), F.signum(F.col("x.v") - F.col("y.v"))
    g = p.groupBy(F.col(f"x.{key}").alias(key)).agg(F.sum(dy * dv).alias("s"), F.count_if(dy != 0).alias("ny"), F.count_if(dv != 0).alias("nv"))
    return g.select(key, F.when((F.col("ny") > 0) & (F.col("nv") > 0), F.col("s") / F.sqrt(F.col("ny").cast("double") * F.col("nv"))).otherwise(0.0).alias("tau"))


def trim_and_fill(effects: DataFrame, key: str) -> DataFrame:
    """Studies without a mirror image are trimmed from the heavier side, most extreme first, and mirrored."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "v"], kind="stable")
        y, v = f["y"].to_numpy(float), f["v"].to_numpy(float)
        keep = np.ones(len(y), bool)
        for _ in range(max(len(y) - 3, 0)):  # a round trims one study, and three stay
            w = keep / v
            mu = (w * y).sum() / w.sum()
            dev = np.where(keep, y - mu, 0.0)
            if abs((w * dev * np.abs(dev)).sum()) <= Z95 * math.sqrt((w * dev**2).sum() / max(keep.sum() - 1, 1)) * np.abs(dev).mean():
                break
            side = np.sign((w * dev * np.abs(dev)).sum())
            keep[int(np.argmax(side * dev))] = False
        w = keep / v
        mu = (w * y).sum() / w.sum()
        filled_y, filled_v = np.append(y, 2 * mu - y[~keep]), np.append(v, v[~keep])
        w = 1 / filled_v
        return pd.DataFrame([{key: f[key].iloc[0], "studies": len(y), "filled": int((~keep).sum()), "estimate": (w * filled_y).sum() / w.sum(), "se": w.sum() ** -0.5}])

    return effects.filter("v > 0").select(key, "y", "v").groupBy(key).applyInPandas(run, f"{key} {effects.schema[key].dataType.simpleString()}, studies long, filled long, estimate double, se double")


def fail_safe_n(effects: DataFrame, keys: list[str], alpha: float = 0.05, target: float = 0.1) -> DataFrame:
    """Rosenthal's and Orwin's fail-safe numbers."""
    za = normal_quantile(1 - alpha / 2)
    g = effects.filter("v > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(F.abs(F.col("y")) / F.sqrt("v")).alias("z"), F.abs(F.sum(F.col("y") / F.col("v")) / F.sum(1 / F.col("v"))).alias("pooled"))
    return g.select(*keys, "k", F.greatest(F.lit(0.0), F.pow(F.col("z") / za, F.lit(2)) - F.col("k")).alias("rosenthal"), F.greatest(F.lit(0.0), F.col("k") * (F.col("pooled") - target) / target).alias("orwin"))


def _pair_sums(contrasts: DataFrame, network: str) -> DataFrame:
    """Sums per pair of treatments: a network's group holds one row for each."""
    v = F.col("se") ** 2
    return contrasts.filter("se > 0").groupBy(network, "treatment_a", "treatment_b").agg(
        F.sum(1 / v).alias("w"), F.sum(F.col("effect_size") / v).alias("wy"), F.sum(F.col("effect_size") ** 2 / v).alias("wyy"), F.sum(F.ln(2 * math.pi * v)).alias("logs"), F.count(F.lit(1)).alias("k"),
    )


def _consistent(f: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(treatments, effects against the first, their covariance, residual sum of squares) by weighted least squares."""
    names = sorted(set(f["treatment_a"]) | set(f["treatment_b"]))
    at = {t: i - 1 for i, t in enumerate(names)}
    n = len(names) - 1
    m, b = np.zeros((n, n)), np.zeros(n)
    for x, y, w, wy in zip(f["treatment_a"], f["treatment_b"], f["w"], f["wy"], strict=True):
        c = np.zeros(n)
        if at[x] >= 0:
            c[at[x]] -= 1
        if at[y] >= 0:
            c[at[y]] += 1
        m += w * np.outer(c, c)
        b += wy * c
    cov = np.linalg.pinv(m)
    return names, cov @ b, cov, max(float(f["wyy"].sum() - b @ cov @ b), 0.0)


def _rank_shares(mean: np.ndarray, cov: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Share of draws in which each treatment (row) has each rank (column), 1 being the largest effect."""
    n = len(mean)
    got = np.column_stack([np.zeros(draws), np.random.default_rng(seed).multivariate_normal(mean, cov, draws, method="eigh")]) if n else np.zeros((draws, 1))
    rank = (-got).argsort(axis=1).argsort(axis=1)
    return np.stack([np.bincount(rank[:, i], minlength=n + 1) for i in range(n + 1)]) / draws


def network_meta(contrasts: DataFrame, network: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Consistency model per network (E20): effects against the first treatment by weighted least squares, and SUCRA.

    contrasts: network, treatment_a, treatment_b, effect_size (b over a), se.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names, mean, cov, _ = _consistent(f)
        share = _rank_shares(mean, cov, draws, seed)
        sucra = share[:, :-1].cumsum(axis=1).sum(axis=1) / max(len(names) - 1, 1) if len(names) > 1 else np.ones(1)
        return pd.DataFrame({network: f[network].iloc[0], "treatment": names, "effect": np.append(0.0, mean), "se": np.append(0.0, np.sqrt(np.diag(cov))), "sucra": sucra})

    return _pair_sums(contrasts, network).groupBy(network).applyInPandas(run, f"{network} string, treatment string, effect double, se double, sucra double")


def rank_probabilities(contrasts: DataFrame, network: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(network, treatment, rank, probability) under the consistency model (E20), from ``draws`` draws; rank 1 has the largest effect."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names, mean, cov, _ = _consistent(f)
        share = _rank_shares(mean, cov, draws, seed)
        n = len(names)
        return pd.DataFrame({network: f[network].iloc[0], "treatment": np.repeat(names, n), "rank": np.tile(np.arange(1, n + 1), n), "probability": share.ravel()})

    return _pair_sums(contrasts, network).groupBy(network).applyInPandas(run, f"{network} string, treatment string, rank int, probability double")


def league_table(contrasts: DataFrame, network: str, confidence: float = 0.95) -> DataFrame:
    """(network, treatment, against, effect, lower, upper): pooled effects of all ordered pairs under the consistency model."""
    z = normal_quantile(0.5 + confidence / 2)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names, mean, cov, _ = _consistent(f)
        effect, full = np.append(0.0, mean), np.zeros((len(names), len(names)))
        full[1:, 1:] = cov
        i, j = np.nonzero(~np.eye(len(names), dtype=bool))
        diff, se = effect[i] - effect[j], np.sqrt(np.maximum(full[i, i] + full[j, j] - 2 * full[i, j], 0))
        return pd.DataFrame({network: f[network].iloc[0], "treatment": np.array(names)[i], "against": np.array(names)[j], "effect": diff, "lower": diff - z * se, "upper": diff + z * se})

    return _pair_sums(contrasts, network).groupBy(network).applyInPandas(run, f"{network} string, treatment string, against string, effect double, lower double, upper double")


def network_fit(contrasts: DataFrame, network: str) -> DataFrame:
    """(network, treatments, comparisons, rss, aic, bic) of the consistency model (E20), on the normal likelihood with the given standard errors."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names, mean, _, rss = _consistent(f)
        n, loglik = int(f["k"].sum()), -0.5 * (rss + f["logs"].sum())
        return pd.DataFrame([{network: f[network].iloc[0], "treatments": len(names), "comparisons": n, "rss": rss, "aic": 2 * len(mean) - 2 * loglik, "bic": math.log(max(n, 1)) * len(mean) - 2 * loglik}])

    return _pair_sums(contrasts, network).groupBy(network).applyInPandas(run, f"{network} string, treatments int, comparisons long, rss double, aic double, bic double")


def _direct(contrasts: DataFrame, network: str) -> DataFrame:
    """(network, a, b, y, v, k) with a < b: the studies of each pair, pooled by inverse variance."""
    flip = F.col("treatment_a") > F.col("treatment_b")
    one = contrasts.filter("se > 0").select(network, F.least("treatment_a", "treatment_b").alias("a"), F.greatest("treatment_a", "treatment_b").alias("b"), F.when(flip, -F.col("effect_size")).otherwise(F.col("effect_size")).alias("y"), (F.col("se") ** 2).alias("v"))
    return one.groupBy(network, "a", "b").agg((F.sum(F.col("y") / F.col("v")) / F.sum(1 / F.col("v"))).alias("y"), (1 / F.sum(1 / F.col("v"))).alias("v"), F.count(F.lit(1)).alias("k"))


def loop_tests(contrasts: DataFrame, network: str) -> DataFrame:
    """(network, a, b, c, comparison, z) of each triangle of compared treatments a < b < c.

    The comparison with most studies (of equal ones the first by name) is set against the way round by the third treatment. All triangles
    count, as a basis of cycles is not unique.
    """
    d = materialise(_direct(contrasts, network), "direct-pairs")
    side = lambda p, x, y: d.select(network, F.col("a").alias(x), F.col("b").alias(y), F.struct("k", "y", "v").alias(p))
    t = side("p", "a", "b").join(side("q", "b", "c"), [network, "b"]).join(side("r", "a", "c"), [network, "a", "c"])
    ab, ac = (F.col("p.k") >= F.col("q.k")) & (F.col("p.k") >= F.col("r.k")), F.col("r.k") >= F.col("q.k")
    split = F.when(ab, F.concat_ws(" vs ", "b", "a")).when(ac, F.concat_ws(" vs ", "c", "a")).otherwise(F.concat_ws(" vs ", "c", "b"))
    gap = F.col("p.y") + F.col("q.y") - F.col("r.y")
    # direct less indirect is this gap or, where ac is split, its negative
    z = gap * F.when(~ab & ac, -1).otherwise(1) / F.sqrt(F.col("p.v") + F.col("q.v") + F.col("r.v"))
    return t.select(network, "a", "b", "c", split.alias("comparison"), z.alias("z"))


def loop_inconsistency(contrasts: DataFrame, network: str) -> DataFrame:
    """(network, q, loops, p): the sum of squared z over the loops, on as many degrees of freedom (E21); networks without a loop have q 0 and p 1."""
    g = loop_tests(contrasts, network).groupBy(network).agg(F.sum(F.col("z") * F.col("z")).alias("q"), F.count(F.lit(1)).alias("loops"))
    x = contrasts.select(network).distinct().join(g, network, "left").na.fill(0.0, ["q"]).na.fill(0, ["loops"])
    return x.withColumn("p", F.when(F.col("loops") > 0, chi2_p(F.col("q"), F.greatest(F.col("loops"), F.lit(1)).cast("double"))).otherwise(1.0))


def verdicts(tests: DataFrame) -> DataFrame:
    """``tests`` with the two-sided p of their z and what it says about inconsistency: none from 0.10, some from 0.05, else evidence of it."""
    x = tests.withColumn("p", normal_p(F.col("z")))
    return x.withColumn("verdict", F.when(F.col("p") >= 0.10, "no evidence of inconsistency").when(F.col("p") >= 0.05, "some evidence of inconsistency").otherwise("evidence of inconsistency"))


def node_splitting(contrasts: DataFrame, network: str) -> DataFrame:
    """Direct and one-step indirect estimate of each pair, and their z."""
    d = _direct(contrasts, network).drop("k")
    both = d.union(d.select(network, F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("y")).alias("y"), "v"))
    x, z = both.select(network, F.col("a").alias("a"), F.col("b").alias("c"), F.col("y").alias("y1"), F.col("v").alias("v1")), both.select(F.col(network).alias("n2"), F.col("a").alias("c2"), F.col("b").alias("b"), F.col("y").alias("y2"), F.col("v").alias("v2"))
    step = x.join(z, (x[network] == z.n2) & (x.c == z.c2)).filter("a < b").groupBy(network, "a", "b").agg((F.sum((F.col("y1") + F.col("y2")) / (F.col("v1") + F.col("v2"))) / F.sum(1 / (F.col("v1") + F.col("v2")))).alias("indirect"), (1 / F.sum(1 / (F.col("v1") + F.col("v2")))).alias("indirect_v"))
    out = d.join(step, [network, "a", "b"])
    return out.select(network, "a", "b", F.col("y").alias("direct"), "indirect", ((F.col("y") - F.col("indirect")) / F.sqrt(F.col("v") + F.col("indirect_v"))).alias("z"))


def radial(effects: DataFrame) -> DataFrame:
    """Galbraith coordinates."""
    return effects.filter("v > 0").withColumn("precision", 1 / F.sqrt("v")).withColumn("z", F.col("y") / F.sqrt("v"))
