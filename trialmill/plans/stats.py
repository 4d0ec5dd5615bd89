"""Queries on tests: trials and signals of the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..operators import clusters, labels, signals, stats as ops
from .standins import query, signal, trials

PERMS = 1000
_EP = "(SELECT channel, epoch, avg(CASE WHEN t > 7 THEN value END) - avg(CASE WHEN t <= 7 THEN value END) AS diff, avg(value) AS value FROM {sg} GROUP BY 1, 2)"
_P = f"(SELECT unnest(range(0, {PERMS + 1})) AS perm)"
_MD = "CASE WHEN perm = 0 OR CAST('0x' || substr(md5(concat_ws(':', '', perm, {k})), 1, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END"


def epochs(s: SparkSession, d: str) -> DataFrame:
    late, early = F.avg(F.when(F.col("t") > 7, F.col("value"))), F.avg(F.when(F.col("t") <= 7, F.col("value")))
    return signal(s, d).groupBy("channel", "epoch").agg((late - early).alias("diff"), F.avg("value").alias("value"))


@query("u1_paired_t", f"SELECT channel, r(avg(diff)) AS mean, r(stddev_samp(diff)) AS sd, count(diff) AS n, r(avg(diff) / nullif(stddev_samp(diff) / sqrt(count(diff)), 0)) AS t, count(diff) - 1 AS df FROM {_EP} GROUP BY 1")
def u1(s: SparkSession, d: str) -> DataFrame:
    return ops.one_sample_t(epochs(s, d), ["channel"], F.col("diff"))


@query("u1_paired_t_p_values")
def u1p(s: SparkSession, d: str) -> DataFrame:
    return u1_rows(s, d).withColumn("p", dist.t_p_value("t", "df"))


def u1_rows(s: SparkSession, d: str) -> DataFrame:
    return ops.one_sample_t(epochs(s, d), ["channel"], F.col("diff"))


@query("u2_two_sample_t", f"SELECT channel, r((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 0)) AS t, n1 + n2 - 2 AS df FROM (SELECT channel, avg(value) FILTER (WHERE epoch % 2 = 0) AS m1, avg(value) FILTER (WHERE epoch % 2 <> 0) AS m2, var_samp(value) FILTER (WHERE epoch % 2 = 0) AS v1, var_samp(value) FILTER (WHERE epoch % 2 <> 0) AS v2, count(value) FILTER (WHERE epoch % 2 = 0) AS n1, count(value) FILTER (WHERE epoch % 2 <> 0) AS n2 FROM {_EP} GROUP BY 1)")
def u2(s: SparkSession, d: str) -> DataFrame:
    return ops.two_sample_t(epochs(s, d), ["channel"], "value", F.col("epoch") % 2 == 0)


_RK = "rank() OVER (PARTITION BY channel ORDER BY {v}) + (count(*) OVER (PARTITION BY channel, {v}) - 1) / 2"


@query("u3_signed_rank", f"SELECT channel, r(w) AS w, n, r((w - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24), 0)) AS z FROM (SELECT channel, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS w, count(*) AS n FROM (SELECT *, {_RK.replace('{v}', 'a')} AS rk FROM (SELECT *, abs(diff) AS a FROM {_EP} WHERE diff <> 0)) GROUP BY 1)")
def u3(s: SparkSession, d: str) -> DataFrame:
    return ops.signed_rank(epochs(s, d), ["channel"], F.col("diff"))


@query("u4_rank_sum", f"SELECT channel, r(w) AS w, n1, n2, r((w - n1 * (n1 + n2 + 1) / 2) / nullif(sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 0)) AS z FROM (SELECT channel, sum(CASE WHEN epoch % 2 = 0 THEN rk END) AS w, count(*) FILTER (WHERE epoch % 2 = 0) AS n1, count(*) FILTER (WHERE epoch % 2 <> 0) AS n2 FROM (SELECT *, {_RK.replace('{v}', 'value')} AS rk FROM {_EP}) GROUP BY 1)")
def u4(s: SparkSession, d: str) -> DataFrame:
    return ops.rank_sum(epochs(s, d), ["channel"], "value", F.col("epoch") % 2 == 0)


@query("u5_sign_flip_test", f"SELECT channel, r(max(t) FILTER (WHERE perm = 0)) AS t, r(avg(CASE WHEN abs(t) >= o - 1e-9 THEN 1.0 ELSE 0 END)) AS p FROM (SELECT *, max(CASE WHEN perm = 0 THEN abs(t) END) OVER (PARTITION BY channel) AS o FROM (SELECT channel, perm, avg(x) / nullif(stddev_samp(x) / sqrt(count(x)), 0) AS t FROM (SELECT channel, perm, diff * {_MD.replace('{k}', 'epoch')} AS x FROM {_EP}, {_P}) GROUP BY 1, 2)) GROUP BY 1")
def u5(s: SparkSession, d: str) -> DataFrame:
    return ops.sign_flip_test(epochs(s, d), ["channel"], "epoch", "diff", PERMS)


_SHUF = f"(SELECT a.channel, a.perm, a.value, b.label FROM (SELECT *, row_number() OVER (PARTITION BY perm, channel ORDER BY epoch) AS i FROM {_EP}, {_P}) a JOIN (SELECT perm, channel, epoch % 4 AS label, row_number() OVER (PARTITION BY perm, channel ORDER BY CASE WHEN perm = 0 THEN lpad(CAST(epoch AS VARCHAR), 20, '0') ELSE md5(concat_ws(':', perm, epoch)) END) AS i FROM {_EP}, {_P}) b USING (perm, channel, i))"
_DPR = "(SELECT channel, perm, label, (m - (sm - m) / (k - 1)) / nullif(sqrt((v + (sv - v) / (k - 1)) / 2), 0) AS d FROM (SELECT *, count(*) OVER w AS k, sum(m) OVER w AS sm, sum(v) OVER w AS sv FROM (SELECT channel, perm, label, avg(value) AS m, var_pop(value) AS v FROM {x} GROUP BY ALL) WINDOW w AS (PARTITION BY channel, perm)))"


@query("d26_category_d_prime", f"SELECT channel, label, r(d) AS d FROM {_DPR.replace('{x}', f'(SELECT channel, 0 AS perm, epoch % 4 AS label, value FROM {_EP})')}")
def d26(s: SparkSession, d: str) -> DataFrame:
    return ops.category_d_prime(epochs(s, d).withColumn("label", F.col("epoch") % 4), ["channel"], "label", "value")


@query("u6_label_shuffle_null", f"SELECT channel, label, r(max(d) FILTER (WHERE perm = 0)) AS observed, r(avg(CASE WHEN d >= o - 1e-9 THEN 1.0 ELSE 0 END)) AS p FROM (SELECT *, max(CASE WHEN perm = 0 THEN d END) OVER (PARTITION BY channel, label) AS o FROM {_DPR.replace('{x}', _SHUF)}) GROUP BY 1, 2")
def u6(s: SparkSession, d: str) -> DataFrame:
    return labels.d_prime_test(labelled(s, d), ["channel"], "epoch", "label", "value", PERMS)


def labelled(s: SparkSession, d: str) -> DataFrame:
    return epochs(s, d).withColumn("label", F.col("epoch") % 4)


@query("u7_histogram_p_two_sided", f"SELECT channel, r(max(m) FILTER (WHERE perm = 0)) AS observed, r(avg(CASE WHEN abs(m) >= o - 1e-9 THEN 1.0 ELSE 0 END)) AS p FROM (SELECT *, max(CASE WHEN perm = 0 THEN abs(m) END) OVER (PARTITION BY channel) AS o FROM (SELECT channel, perm, avg(diff * {_MD.replace('{k}', 'epoch')}) AS m FROM {_EP}, {_P} GROUP BY 1, 2)) GROUP BY 1")
def u7(s: SparkSession, d: str) -> DataFrame:
    sums = clusters.permuted_sums(epochs(s, d), ["channel"], "epoch", "diff", clusters.signs(PERMS), PERMS + 1)
    means = sums.select("channel", F.transform("s", lambda x: F.coalesce(F.try_divide(x, F.col("n")), F.lit(float("nan")))).alias("m"))
    return clusters.array_p(means, ["channel"], "m")


_TT = f"(SELECT channel, t, perm, coalesce(avg(x) / nullif(stddev_samp(x) / sqrt(count(x)), 0), 0) AS value FROM (SELECT channel, t, perm, (value - 50) * {_MD.replace('{k}', 'epoch')} AS x FROM {{sg}}, {_P}) GROUP BY 1, 2, 3)"
_CL = f"(SELECT channel, perm, run, min(t) AS lo, max(t) AS hi, sum(value) AS mass FROM (SELECT *, sum(n) OVER (PARTITION BY channel, perm ORDER BY t) AS run FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY channel, perm ORDER BY t) THEN 0 ELSE 1 END AS n FROM (SELECT *, value > 0.5 AS f FROM {_TT}))) WHERE f GROUP BY ALL)"


@query("u8_cluster_test", f"SELECT channel, lo, hi, r(mass) AS mass, r(avg(CASE WHEN top >= mass - 1e-9 THEN 1.0 ELSE 0 END)) AS p FROM (SELECT * FROM {_CL} WHERE perm = 0) a JOIN (SELECT channel, perm AS q, coalesce(max(mass), 0) AS top FROM (SELECT DISTINCT channel, perm FROM {_TT}) LEFT JOIN {_CL} USING (channel, perm) GROUP BY 1, 2) b USING (channel) GROUP BY channel, lo, hi, mass")
def u8(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d).select("channel", "epoch", F.col("t").alias("at"), (F.col("value") - 50).alias("x"))
    return clusters.one_sample_clusters(rows, ["channel"], ["at"], "epoch", "x", PERMS, 0.5, tail=1).select("channel", "lo", "hi", "mass", "p")


@query("u8_grid_clusters")
def u8_grid(s: SparkSession, d: str) -> DataFrame:
    cells = signal(s, d).groupBy("channel", (F.col("epoch") % 20).alias("row"), "t").agg(F.avg("value").alias("value"))
    found = ops.grid_clusters(cells, ["channel"], "row", "t", "value", 75)
    return found.groupBy("channel", "label").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("mass"))


@query("u10_u11_bayes_factors")
def u10(s: SparkSession, d: str) -> DataFrame:
    return u1_rows(s, d).withColumn("bf10", dist.bayes_factor_t("t", "n", "df")).withColumn("bf01", 1 / F.col("bf10"))


@query("u12_binomial_bayes_factors")
def u12(s: SparkSession, d: str) -> DataFrame:
    g = trials(s, d).groupBy("priority", "flag").agg(F.count_if(F.col("quantity") > 25).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumns({"bf10": dist.beta_binomial_bf("k", "n"), "p": dist.binomial_p("k", "n")})


@query("u13_group_bayes_factor_over_windows")
def u13(s: SparkSession, d: str) -> DataFrame:
    cells = ops.one_sample_t(signal(s, d).where("t between 8 and 20").withColumn("x", F.col("value") - 50).withColumnRenamed("t", "at"), ["channel", "at"], F.col("x"))
    return cells.withColumn("bf", dist.bayes_factor_t("t", "n", "df")).groupBy("channel").agg(F.avg(1 / F.col("bf")).alias("mean_bf01"))


_KT = "(SELECT channel, t, avg(value) AS x, avg(value) FILTER (WHERE epoch % 2 = 0) AS y FROM {sg} GROUP BY 1, 2)"


@query("u14_kendall_tau", f"SELECT channel, r(sum(sx * sy) / nullif(sqrt(sum(sx * sx) * sum(sy * sy)), 0)) AS tau FROM (SELECT a.channel, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM {_KT} a JOIN {_KT} b ON a.channel = b.channel AND a.t < b.t) GROUP BY 1")
def u14(s: SparkSession, d: str) -> DataFrame:
    return ops.kendall_tau(curves(s, d), ["channel"], "t", "x", "y")


def curves(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).groupBy("channel", "t").agg(F.avg("value").alias("x"), F.avg(F.when(F.col("epoch") % 2 == 0, F.col("value"))).alias("y"))


@query("u14_kendall_bayes_factor")
def u14b(s: SparkSession, d: str) -> DataFrame:
    return ops.kendall_tau(curves(s, d), ["channel"], "t", "x", "y").withColumn("n", F.lit(28.0)).withColumn("bf10", dist.kendall_bayes_factor("tau", "n"))


@query("u15_correlations", f"SELECT channel, r(xy) AS pearson, r((xy - xz * yz) / nullif(sqrt((1 - xz * xz) * (1 - yz * yz)), 0)) AS partial, r((xy - xz * yz) / nullif(sqrt(1 - yz * yz), 0)) AS semi_partial FROM (SELECT channel, corr(x, y) AS xy, corr(x, t) AS xz, corr(y, t) AS yz FROM {_KT} GROUP BY 1)")
def u15(s: SparkSession, d: str) -> DataFrame:
    return ops.partial_correlation(curves(s, d), ["channel"], "x", "y", "t")


#: Ranks among the times that have both means, to 9 digits: what differs by rounding alone is a tie.
_PAIRED = f"(SELECT channel, t, CASE WHEN both_ THEN round(x, 9) END AS x, CASE WHEN both_ THEN round(y, 9) END AS y, both_ FROM (SELECT *, x IS NOT NULL AND y IS NOT NULL AS both_ FROM {_KT}))"
_SR = "CASE WHEN both_ THEN rank() OVER (PARTITION BY channel, both_ ORDER BY {v}) + (count(*) OVER (PARTITION BY channel, both_, {v}) - 1) / 2 END"


@query("u15_spearman", f"SELECT channel, r(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0)) AS rho FROM (SELECT channel, {_SR.replace('{v}', 'x')} AS rx, {_SR.replace('{v}', 'y')} AS ry FROM {_PAIRED}) GROUP BY 1")
def u15b(s: SparkSession, d: str) -> DataFrame:
    return ops.spearman(curves(s, d), ["channel"], "x", "y")


@query("u16_theory_difference_shuffles", f"SELECT channel, r(max(z) FILTER (WHERE perm = 0)) AS observed, r(avg(CASE WHEN z >= o - 1e-9 THEN 1.0 ELSE 0 END)) AS p FROM (SELECT *, max(CASE WHEN perm = 0 THEN z END) OVER (PARTITION BY channel) AS o FROM (SELECT channel, perm, corr(value, CASE WHEN label < 2 THEN 1.0 ELSE 0 END) - corr(value, CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0 END) AS z FROM {_SHUF} GROUP BY 1, 2)) GROUP BY 1")
def u16(s: SparkSession, d: str) -> DataFrame:
    return labels.theory_shuffle_tests(labelled(s, d), ["channel"], "epoch", "label", "value", PREDICTED, PERMS).select("channel", "observed", "p")


_TH = f"(SELECT channel, perm, corr(value, CASE WHEN label < 2 THEN 1.0 ELSE 0 END) AS a, corr(value, CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0 END) AS b FROM {_SHUF} GROUP BY 1, 2)"
_REACH = "avg(CASE WHEN {x} >= {o} - 1e-9 THEN 1.0 ELSE 0 END)"


_TESTS = f"(SELECT channel, {_REACH.format(x='a', o='oa')} AS p_first, {_REACH.format(x='b', o='ob')} AS p_second, oa - ob AS observed, {_REACH.format(x='a - b', o='(oa - ob)')} AS p FROM (SELECT *, max(CASE WHEN perm = 0 THEN a END) OVER (PARTITION BY channel) AS oa, max(CASE WHEN perm = 0 THEN b END) OVER (PARTITION BY channel) AS ob FROM {_TH}) GROUP BY channel, oa, ob)"
#: What two theories predict for a label.
PREDICTED = {0: (1.0, 1.0), 1: (1.0, 0.0), 2: (0.0, 1.0), 3: (0.0, 0.0)}


@query("u16_gated_theory_test", f"SELECT channel, r(p_first) AS p_first, r(p_second) AS p_second, r(observed) AS observed, r(p) AS p FROM {_TESTS} WHERE least(p_first, p_second) <= 0.05")
def u16_gated(s: SparkSession, d: str) -> DataFrame:
    tests = labels.theory_shuffle_tests(labelled(s, d), ["channel"], "epoch", "label", "value", PREDICTED, PERMS)
    return tests.where(F.least("p_first", "p_second") <= 0.05)


_PV = "(SELECT channel, t, 1 / (1 + abs(avg(value - 50))) AS p FROM {sg} GROUP BY 1, 2)"


@query("u17_false_discovery", f"SELECT channel, t, r(p) AS p, r(least(min(q) OVER (PARTITION BY channel ORDER BY p DESC, t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)) AS p_fdr, r(least(p * n, 1)) AS p_bonferroni FROM (SELECT *, p * count(*) OVER (PARTITION BY channel) / row_number() OVER (PARTITION BY channel ORDER BY p, t) AS q, count(*) OVER (PARTITION BY channel) AS n FROM {_PV})")
def u17(s: SparkSession, d: str) -> DataFrame:
    p = signal(s, d).groupBy("channel", "t").agg((1 / (1 + F.abs(F.avg(F.col("value") - 50)))).alias("p"))
    return ops.false_discovery(p, ["channel"], "p", ["t"])


@query("e18_e19_latency", f"SELECT channel, min(lo) AS onset FROM (SELECT channel, run, min(t) AS lo, count(*) AS size FROM (SELECT *, sum(n) OVER (PARTITION BY channel ORDER BY t) AS run FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY channel ORDER BY t) THEN 0 ELSE 1 END AS n FROM (SELECT channel, t, avg(value - 50) / nullif(stddev_samp(value - 50) / sqrt(count(*)), 0) > 0.3 AS f FROM {{sg}} GROUP BY 1, 2))) WHERE f GROUP BY ALL) WHERE size >= 2 GROUP BY 1")
def e18(s: SparkSession, d: str) -> DataFrame:
    g = signal(s, d).groupBy("channel", "t").agg(F.avg(F.col("value") - 50).alias("m"), F.stddev_samp(F.col("value") - 50).alias("sd"), F.count(F.lit(1)).alias("n"))
    over = F.try_divide("m", F.col("sd") / F.sqrt("n")) > 0.3
    return signals.sustained(g, ["channel"], over, 2).select("channel", "onset")


@query("u18_corrected_t", f"SELECT channel, r(avg(diff) / nullif(sqrt(var_samp(diff) * (1 / count(diff) + 0.25)), 0)) AS t, count(diff) - 1 AS df FROM {_EP} GROUP BY 1")
def u18(s: SparkSession, d: str) -> DataFrame:
    return ops.corrected_t(epochs(s, d), ["channel"], "diff", 0.25)


@query("u19_evoked_regressed_out", "SELECT channel, epoch, t, r(value - coalesce(sum(value * e) OVER w / nullif(sum(e * e) OVER w, 0), 0) * e) AS residual FROM (SELECT *, avg(value) OVER (PARTITION BY channel, t) AS e FROM {sg}) WINDOW w AS (PARTITION BY channel, epoch)")
def u19(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d).withColumn("e", F.avg("value").over(Window.partitionBy("channel", "t")))
    return ops.without_regressor(rows, ["channel", "epoch"], "value", F.col("e")).select("channel", "epoch", "t", "residual")


@query("u20_groups_regressed_out", "SELECT channel, epoch, t, r(value - CASE WHEN epoch % 2 = 0 THEN avg(CASE WHEN epoch % 2 = 0 THEN value END) OVER (PARTITION BY channel) ELSE 0 END) AS residual FROM {sg}")
def u20(s: SparkSession, d: str) -> DataFrame:
    member = F.when(F.col("epoch") % 2 == 0, 1.0).otherwise(0.0)
    return ops.without_regressor(signal(s, d), ["channel"], "value", member).select("channel", "epoch", "t", "residual")


@query("u28_random_intercept_models")
def u28(s: SparkSession, d: str) -> DataFrame:
    rows = trials(s, d).withColumns({"late": (F.col("status") == "F").cast("double"), "size": F.col("quantity") / 50})
    return ops.random_intercept_models(rows, ["flag"], "subject", "value", ["late", "size"])


@query("u29_pairwise_contrasts", "SELECT a.flag AS first, b.flag AS second, r(avg(a.m - b.m)) AS difference, r(avg(a.m - b.m) / nullif(stddev_samp(a.m - b.m) / sqrt(count(*)), 0)) AS t, count(*) - 1 AS df FROM (SELECT subject, flag, avg(value) AS m FROM {tr} GROUP BY 1, 2) a JOIN (SELECT subject, flag, avg(value) AS m FROM {tr} GROUP BY 1, 2) b ON a.subject = b.subject AND a.flag < b.flag GROUP BY 1, 2")
def u29(s: SparkSession, d: str) -> DataFrame:
    m = trials(s, d).groupBy("subject", "flag").agg(F.avg("value").alias("m"))
    pairs = m.select("subject", F.col("flag").alias("first"), F.col("m").alias("m1")).join(m.select("subject", F.col("flag").alias("second"), F.col("m").alias("m2")), "subject").where("first < second")
    return ops.one_sample_t(pairs, ["first", "second"], F.col("m1") - F.col("m2")).select("first", "second", F.col("mean").alias("difference"), "t", "df")


@query("u33_active_channels", f"SELECT channel FROM (SELECT channel, (w - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24), 0) AS z FROM (SELECT channel, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS w, count(*) AS n FROM (SELECT *, {_RK.replace('{v}', 'a')} AS rk FROM (SELECT *, abs(diff) AS a FROM {_EP} WHERE diff <> 0)) GROUP BY 1)) WHERE z > 0.5")
def u33(s: SparkSession, d: str) -> DataFrame:
    return ops.signed_rank(epochs(s, d), ["channel"], F.col("diff")).where("z > 0.5").select("channel")
