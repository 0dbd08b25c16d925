"""Queries E1-E23. p-values have no SQL; they are tested against table values."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import evidence as E
from corvella.plans.q_aggregates import rounded
from corvella.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
OR = "WITH b AS (SELECT *, n1 - a AS b, n2 - c AS d, n1 + n2 AS n FROM effects), e AS (SELECT *, ln(a * d / (b * c)) AS y, 1 / a + 1 / b + 1 / c + 1 / d AS v FROM b), s AS (SELECT meta_id, count(*) AS k, sum(1 / v) AS sw, sum(y / v) AS swy, sum(y * y / v) AS swyy, sum(1 / (v * v)) AS sww FROM e GROUP BY 1), h AS (SELECT *, greatest(swyy - swy * swy / sw, 0) AS q, k - 1 AS df FROM s), t AS (SELECT *, greatest(0, (q - df) / (sw - sww / sw)) AS tau2, greatest(0, (q - df) / q * 100) AS i2 FROM h) "
KEY = ["meta_id"]


def effects(v):
    return E.dichotomous(v.effects, "OR")


@R.add("e1_continuous", "effects", """WITH p AS (SELECT *, m1 - m2 AS md, (m1 - m2) / sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)) AS d, 1 - 3 / (4 * (n1 + n2) - 9) AS j FROM effects), q AS (SELECT *, (n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2)) AS vd FROM p)
 SELECT meta_id, study_id, round(md, 6) AS md, round(sd1 * sd1 / n1 + sd2 * sd2 / n2, 6) AS md_variance, round(d * j, 6) AS smd, round(vd * j * j, 6) AS smd_variance, round(d * j - 1.96 * sqrt(vd) * j, 6) AS smd_lower, round(d * j + 1.96 * sqrt(vd) * j, 6) AS smd_upper FROM q""")
def e1(v):
    return rounded(E.continuous(v.effects).select("meta_id", "study_id", "md", "md_variance", "smd", "smd_variance", "smd_lower", "smd_upper"))


for _m, _y, _v in (("OR", "ln(a * d / (b * c))", "1 / a + 1 / b + 1 / c + 1 / d"), ("RR", "ln((a / n1) / (c / n2))", "1 / a - 1 / n1 + 1 / c - 1 / n2"), ("RD", "a / n1 - c / n2", "(a / n1) * (1 - a / n1) / n1 + (c / n2) * (1 - c / n2) / n2")):
    R.add(f"e2_{_m.lower()}", "effects", f"SELECT meta_id, study_id, round({_y}, 6) AS y, round({_v}, 6) AS v FROM (SELECT *, n1 - a AS b, n2 - c AS d FROM effects)")(lambda v, m=_m: rounded(E.dichotomous(v.effects, m).select("meta_id", "study_id", "y", "v")))


@R.add("e3_from_interval", "effects", OR + "SELECT meta_id, study_id, round(y, 5) AS y, round(sqrt(v), 5) AS se FROM e")
def e3(v):
    e = effects(v).withColumn("value", F.exp("y")).withColumn("ci_lower", F.exp(F.col("y") - 1.96 * F.sqrt("v"))).withColumn("ci_upper", F.exp(F.col("y") + 1.96 * F.sqrt("v")))
    return rounded(E.from_interval(e.drop("y", "v")).select("meta_id", "study_id", "y", "se"), 5)


@R.add("e4_conversions", "effects", OR + "SELECT meta_id, study_id, round(exp(y), 6) AS value, round(1 - (a / n1) / (c / n2), 6) AS rrr, round(1 / abs(0.3 - exp(y) * 0.3 / (1 - 0.3 + exp(y) * 0.3)), 3) AS nnt, round(exp(y - 1.6448536269514722 * sqrt(v)), 6) AS lower_90, round(exp(y + 1.6448536269514722 * sqrt(v)), 6) AS upper_90 FROM e")
def e4(v):
    e = effects(v)
    lo, hi = E.interval(F.col("y"), F.sqrt("v"), 0.9)
    rr = (F.col("a") / F.col("n1")) / (F.col("c") / F.col("n2"))
    x = e.select("meta_id", "study_id", F.exp("y").alias("value"), E.relative_risk_reduction(rr).alias("rrr"), F.round(E.number_needed_to_treat(F.exp("y"), F.lit(0.3), "OR"), 3).alias("nnt"), F.exp(lo).alias("lower_90"), F.exp(hi).alias("upper_90"))
    return rounded(x)


@R.add("e5_pool_fixed", "effects", OR + "SELECT meta_id, k, round(swy / sw, 6) AS estimate, round(sqrt(1 / sw), 6) AS se, round(exp(swy / sw), 6) AS value, round(exp(swy / sw - 1.96 * sqrt(1 / sw)), 6) AS ci_lower, round(exp(swy / sw + 1.96 * sqrt(1 / sw)), 6) AS ci_upper, round(q, 6) AS q, df, round(i2, 6) AS i2, round(q / df, 6) AS h2 FROM t")
def e5(v):
    return rounded(E.pool_fixed(effects(v), KEY, True))


@R.add("e6_pool_random", "effects", OR + ", r AS (SELECT meta_id, any_value(k) AS k, sum(1 / (v + tau2)) AS w, sum(y / (v + tau2)) AS wy, any_value(tau2) AS tau2, any_value(q) AS q, any_value(df) AS df, any_value(i2) AS i2 FROM e JOIN t USING (meta_id) GROUP BY 1) SELECT meta_id, k, round(wy / w, 6) AS estimate, round(sqrt(1 / w), 6) AS se, round(exp(wy / w), 6) AS value, round(exp(wy / w - 1.96 * sqrt(1 / w)), 6) AS ci_lower, round(exp(wy / w + 1.96 * sqrt(1 / w)), 6) AS ci_upper, round(tau2, 6) AS tau2, round(q, 6) AS q, df, round(i2, 6) AS i2 FROM r")
def e6(v):
    return rounded(E.pool_random(effects(v), KEY, True))


R.add("e6_pool_random_p")(lambda v: rounded(E.with_p(E.pool_random(effects(v), KEY, True))))


@R.add("e7_mantel_haenszel_or", "effects", OR + ", g AS (SELECT meta_id, count(*) AS k, sum(a * d / n) AS r, sum(b * c / n) AS s, sum((a + d) / n * (a * d / n)) AS pr, sum((a + d) / n * (b * c / n) + (b + c) / n * (a * d / n)) AS mid, sum((b + c) / n * (b * c / n)) AS qs FROM e GROUP BY 1), z AS (SELECT *, ln(r / s) AS est, sqrt(pr / (2 * r * r) + mid / (2 * r * s) + qs / (2 * s * s)) AS se FROM g) SELECT meta_id, k, round(est, 6) AS estimate, round(se, 6) AS se, round(exp(est), 6) AS value, round(exp(est - 1.96 * se), 6) AS ci_lower, round(exp(est + 1.96 * se), 6) AS ci_upper FROM z")
def e7(v):
    return rounded(E.mantel_haenszel(v.effects, KEY, "OR"))


@R.add("e7_mantel_haenszel_rr", "effects", OR + ", g AS (SELECT meta_id, count(*) AS k, sum(a * n2 / n) AS r, sum(c * n1 / n) AS s, sum((n1 * n2 * (a + c) - a * c * n) / (n * n)) AS num FROM e GROUP BY 1), z AS (SELECT *, ln(r / s) AS est, sqrt(num / (r * s)) AS se FROM g) SELECT meta_id, k, round(est, 6) AS estimate, round(se, 6) AS se, round(exp(est), 6) AS value, round(exp(est - 1.96 * se), 6) AS ci_lower, round(exp(est + 1.96 * se), 6) AS ci_upper FROM z")
def e7r(v):
    return rounded(E.mantel_haenszel(v.effects, KEY, "RR"))


@R.add("e8_peto", "effects", OR + ", g AS (SELECT meta_id, count(*) AS k, sum(a - n1 * (a + c) / n) AS oe, sum(n1::DOUBLE * n2 * (a + c) * (n - a - c) / (n::DOUBLE * n * (n - 1))) AS v FROM e GROUP BY 1), z AS (SELECT *, oe / v AS est, sqrt(1 / v) AS se FROM g) SELECT meta_id, k, round(est, 6) AS estimate, round(se, 6) AS se, round(exp(est), 6) AS value, round(exp(est - 1.96 * se), 6) AS ci_lower, round(exp(est + 1.96 * se), 6) AS ci_upper FROM z")
def e8(v):
    return rounded(E.peto(v.effects, KEY))


for _m in ("reml", "ml", "paule_mandel"):
    R.add(f"e9_pool_{_m}")(lambda v, m=_m: rounded(E.pool_iterative(effects(v), KEY, m, True)))
R.add("e10_empirical_bayes")(lambda v: rounded(E.empirical_bayes(effects(v), KEY).select("meta_id", "study_id", "mu", "tau2", "shrunk")))
R.add("e11_subgroup_test")(lambda v: rounded(E.subgroup_test(effects(v).withColumn("grp", F.substring("study_id", 7, 1)), "meta_id", "grp")))


@R.add("e11_subgroup_q", "effects", OR + ", g AS (SELECT meta_id, substr(study_id, 7, 1) AS grp, sum(y * y / v) - sum(y / v) * sum(y / v) / sum(1 / v) AS q FROM e GROUP BY ALL), w AS (SELECT meta_id, sum(greatest(q, 0)) AS q_within, count(*) AS groups FROM g GROUP BY 1) SELECT meta_id, round(q, 6) AS q_total, round(q_within, 6) AS q_within, groups, round(greatest(0, q - q_within), 6) AS q_between, groups - 1 AS df FROM t JOIN w USING (meta_id)")
def e11q(v):
    return rounded(E.subgroup_test(effects(v).withColumn("grp", F.substring("study_id", 7, 1)), "meta_id", "grp").drop("p"))


LOO = OR + ", l AS (SELECT x.meta_id, x.study_id, sum(y.y / y.v) / sum(1 / y.v) AS est, sqrt(1 / sum(1 / y.v)) AS se FROM e x JOIN e y ON x.meta_id = y.meta_id AND x.study_id <> y.study_id GROUP BY ALL) "


@R.add("e12_leave_one_out", "effects", LOO + "SELECT meta_id, study_id, round(est, 6) AS estimate, round(se, 6) AS se FROM l")
def e12(v):
    return rounded(E.leave_one_out(effects(v), "meta_id", "study_id"))


@R.add("e13_cumulative", "effects", OR + ", c AS (SELECT meta_id, study_id, row_number() OVER w::INT AS k, sum(1 / v) OVER w AS sw, sum(y / v) OVER w AS swy FROM e WINDOW w AS (PARTITION BY meta_id ORDER BY v, study_id ROWS UNBOUNDED PRECEDING)) SELECT meta_id, k, study_id, round(swy / sw, 6) AS estimate, round(sqrt(1 / sw), 6) AS se FROM c WHERE k >= 2")
def e13(v):
    return rounded(E.cumulative(effects(v), "meta_id", [F.col("v"), F.col("study_id")]))


@R.add("e14_influence", "effects", LOO + ", m AS (SELECT meta_id, avg(v) AS mv FROM e GROUP BY 1) SELECT meta_id, study_id, round((swy / sw - est) / se, 6) AS dffits, round((swy / sw - est) * (swy / sw - est) / mv, 6) AS cook FROM l JOIN t USING (meta_id) JOIN m USING (meta_id)")
def e14(v):
    return rounded(E.influence(effects(v), "meta_id", "study_id"))


@R.add("e15_egger_regression", "effects", OR + "SELECT meta_id, count(*) AS n, round(regr_intercept(y / sqrt(v), 1 / sqrt(v)), 5) AS intercept, round(regr_slope(y / sqrt(v), 1 / sqrt(v)), 5) AS slope FROM e GROUP BY 1")
def e15(v):
    return rounded(E.egger(effects(v), KEY).select("meta_id", "n", "intercept", "slope"), 5)


R.add("e15_egger")(lambda v: rounded(E.egger(effects(v), KEY)))
R.add("e15_harbord")(lambda v: rounded(E.harbord(v.effects, KEY)))
@R.add("e16_peters", "effects", "WITH x AS (SELECT meta_id, ln((a + .5) * (n2 - c + .5) / ((n1 - a + .5) * (c + .5)))::DOUBLE AS y, 1 / (1 / (a + c + 1.0::DOUBLE) + 1 / (n1 - a + n2 - c + 1.0::DOUBLE)) AS w, 1 / (n1 + n2)::DOUBLE AS z FROM effects), s AS (SELECT meta_id, count(*) AS n, sum(w) AS s, sum(w * z) / sum(w) AS mz, sum(w * y) / sum(w) AS my FROM x GROUP BY 1), d AS (SELECT meta_id, n, any_value(s) AS s, any_value(mz) AS mz, any_value(my) AS my, sum(w * (z - mz) * (z - mz)) AS szz, sum(w * (z - mz) * (y - my)) AS szy, sum(w * (y - my) * (y - my)) AS syy FROM x JOIN s USING (meta_id) GROUP BY meta_id, n), r AS (SELECT *, szy / szz AS slope, greatest(syy - szy * szy / szz, 0) / (n - 2) AS s2 FROM d WHERE n >= 3) SELECT meta_id, n, round(my - slope * mz, 3) AS intercept, round((my - slope * mz) / sqrt(s2 * (1 / s + mz * mz / szz)), 3) AS t, round(slope, 3) AS slope, round(slope / sqrt(s2 / szz), 3) AS t_slope FROM r")
def e16(v):
    return rounded(E.peters(v.effects, KEY), 3)


@R.add("e17_begg", "effects", OR + "SELECT x.meta_id, round(sum(sign(x.y - y.y) * sign(x.v - y.v)) / sqrt(count(*) FILTER (x.y <> y.y) * count(*) FILTER (x.v <> y.v)), 6) AS tau FROM e x JOIN e y ON x.meta_id = y.meta_id AND x.study_id < y.study_id GROUP BY 1")
def e17(v):
    return rounded(E.begg(effects(v), "meta_id", "study_id"))


R.add("e18_trim_and_fill")(lambda v: rounded(E.trim_and_fill(effects(v), "meta_id")))


@R.add("e19_fail_safe_n", "effects", OR + "SELECT meta_id, count(*) AS k, round(greatest(0, pow(sum(abs(y) / sqrt(v)) / 1.959963984540054, 2) - count(*)), 4) AS rosenthal, round(greatest(0, count(*) * (abs(sum(y / v) / sum(1 / v)) - 0.1) / 0.1), 4) AS orwin FROM e GROUP BY 1")
def e19(v):
    return rounded(E.fail_safe_n(effects(v), KEY), 4)


def contrasts(v):
    """Differences of mean discount between return flags, one study per brand, one network per type."""
    p = v.table("part").select("p_partkey", F.col("p_type").alias("network"), F.col("p_brand").alias("study_id"))
    arm = v.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("network", "study_id", "l_returnflag").agg(F.avg("l_discount").alias("m"), (F.var_samp("l_discount") / F.count(F.lit(1))).alias("v"))
    x, y = arm.alias("x"), arm.alias("y")
    return x.join(y, (F.col("x.network") == F.col("y.network")) & (F.col("x.study_id") == F.col("y.study_id")) & (F.col("x.l_returnflag") < F.col("y.l_returnflag"))).select(
        "x.network", "x.study_id", F.col("x.l_returnflag").alias("treatment_a"), F.col("y.l_returnflag").alias("treatment_b"), (F.col("y.m") - F.col("x.m")).alias("effect_size"), F.sqrt(F.col("x.v") + F.col("y.v")).alias("se")
    )


R.add("e20_network_meta")(lambda v: rounded(E.network_meta(contrasts(v), "network"), 4))
CONTRAST = "WITH m AS (SELECT p_type AS network, p_brand AS study_id, l_returnflag AS f, avg(l_discount) AS m, var_samp(l_discount) / count(*) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), c AS (SELECT x.network, x.f AS a, y.f AS b, sum((y.m - x.m) / (x.v + y.v)) / sum(1 / (x.v + y.v)) AS y, 1 / sum(1 / (x.v + y.v)) AS v FROM m x JOIN m y ON x.network = y.network AND x.study_id = y.study_id AND x.f < y.f GROUP BY ALL), s AS (SELECT * FROM c UNION ALL SELECT network, b, a, -y, v FROM c), i AS (SELECT p.network, p.a, q.b, sum((p.y + q.y) / (p.v + q.v)) / sum(1 / (p.v + q.v)) AS indirect, 1 / sum(1 / (p.v + q.v)) AS iv FROM s p JOIN s q ON p.network = q.network AND p.b = q.a WHERE p.a < q.b GROUP BY ALL) "


@R.add("e21_node_splitting", "", CONTRAST + "SELECT c.network, c.a, c.b, round(c.y, 6) AS direct, round(indirect, 6) AS indirect, round((c.y - indirect) / sqrt(c.v + iv), 6) AS z FROM c JOIN i ON c.network = i.network AND c.a = i.a AND c.b = i.b")
def e21(v):
    return rounded(E.node_splitting(contrasts(v), "network"))


# Effects of N and R against A by the normal equations of three treatments, with their variances and covariance.
SOLVED = CONTRAST + ", wt AS (SELECT network, coalesce(sum(1 / v) FILTER (a = 'A' AND b = 'N'), 0) AS w1, coalesce(sum(y / v) FILTER (a = 'A' AND b = 'N'), 0) AS b1, coalesce(sum(1 / v) FILTER (a = 'A' AND b = 'R'), 0) AS w2, coalesce(sum(y / v) FILTER (a = 'A' AND b = 'R'), 0) AS b2, coalesce(sum(1 / v) FILTER (a = 'N' AND b = 'R'), 0) AS w3, coalesce(sum(y / v) FILTER (a = 'N' AND b = 'R'), 0) AS b3 FROM c GROUP BY 1), eq AS (SELECT network, w1 + w3 AS p, -w3 AS q, w2 + w3 AS r, b1 - b3 AS g, b2 + b3 AS h FROM wt), sol AS (SELECT network, (r * g - q * h) / (p * r - q * q) AS n, (p * h - q * g) / (p * r - q * q) AS m, r / (p * r - q * q) AS vn, p / (p * r - q * q) AS vm, -q / (p * r - q * q) AS vnm FROM eq), zz AS (SELECT network, 'N' AS treatment, 'A' AS against, n AS e, vn AS v FROM sol UNION ALL SELECT network, 'R', 'A', m, vm FROM sol UNION ALL SELECT network, 'N', 'R', n - m, vn + vm - 2 * vnm FROM sol) "


@R.add("e20_league_table", "", SOLVED + ", xx AS (SELECT * FROM zz UNION ALL SELECT network, against, treatment, -e, v FROM zz) SELECT network, treatment, against, round(e, 6) AS effect, round(e - 1.959963984540054 * sqrt(v), 6) AS lower, round(e + 1.959963984540054 * sqrt(v), 6) AS upper FROM xx")
def e20l(v):
    return rounded(E.league_table(contrasts(v), "network"))


R.add("e20_rank_probabilities")(lambda v: rounded(E.rank_probabilities(contrasts(v), "network"), 4))


@R.add("e20_fit", "", SOLVED + ", kk AS (SELECT x.network, count(*) AS n, sum(pow(y.m - x.m, 2) / (x.v + y.v)) AS yy, sum(ln(2 * pi() * (x.v + y.v))) AS logs FROM m x JOIN m y ON x.network = y.network AND x.study_id = y.study_id AND x.f < y.f WHERE x.v + y.v > 0 GROUP BY 1), rr AS (SELECT network, kk.n AS comparisons, greatest(yy - sol.n * g - sol.m * h, 0) AS rss, logs FROM kk JOIN eq USING (network) JOIN sol USING (network)) SELECT network, 3 AS treatments, comparisons, round(rss, 4) AS rss, round(4 + rss + logs, 4) AS aic, round(2 * ln(comparisons) + rss + logs, 4) AS bic FROM rr")
def e20f(v):
    return rounded(E.network_fit(contrasts(v), "network"), 4)


LOOP = CONTRAST + ", l AS (SELECT p.network, pow(p.y + q.y - r.y, 2) / (p.v + q.v + r.v) AS z2 FROM c p JOIN c q ON q.network = p.network AND q.a = p.b JOIN c r ON r.network = p.network AND r.a = p.a AND r.b = q.b) "


@R.add("e21_loop_inconsistency", "", LOOP + "SELECT network, round(coalesce(sum(z2), 0), 6) AS q, count(z2) AS loops FROM (SELECT DISTINCT network FROM m) LEFT JOIN l USING (network) GROUP BY 1")
def e21l(v):
    return rounded(E.loop_inconsistency(contrasts(v), "network")).drop("p")


@R.add("e21_verdicts", "", CONTRAST + ", z AS (SELECT c.network, c.a, c.b, abs(c.y - indirect) / sqrt(c.v + iv) AS z FROM c JOIN i ON c.network = i.network AND c.a = i.a AND c.b = i.b) SELECT network, a, b, CASE WHEN z <= 1.6448536269514722 THEN 'no evidence of inconsistency' WHEN z <= 1.959963984540054 THEN 'some evidence of inconsistency' ELSE 'evidence of inconsistency' END AS verdict FROM z")
def e21v(v):
    return E.verdicts(E.node_splitting(contrasts(v), "network")).select("network", "a", "b", "verdict")


@R.add("e22_effects_from_forms", "effects", "SELECT meta_id, study_id, 'OR' AS type, round(ln(a * (n2 - c) / ((n1 - a) * c)), 6) AS y FROM effects UNION ALL SELECT meta_id, study_id, 'MD', round(m1 - m2, 6) FROM effects")
def e22(v):
    one = E.dichotomous(v.effects, "OR").select("meta_id", "study_id", F.lit("OR").alias("type"), "y")
    return rounded(one.union(E.continuous(v.effects).select("meta_id", "study_id", F.lit("MD"), "md")))


@R.add("e23_radial", "effects", OR + "SELECT meta_id, study_id, round(1 / sqrt(v), 6) AS precision, round(y / sqrt(v), 6) AS z FROM e")
def e23(v):
    return rounded(E.radial(effects(v)).select("meta_id", "study_id", "precision", "z"))
