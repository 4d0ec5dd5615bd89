"""Queries on Bayes factors, p values by quadrature, nested models and tables joined from many results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..operators import decoding, labels, results as tables, stats as ops, trials as log
from .decoding import _CELLS, times_by_times
from .maps import channels as places_of
from .results import matrices
from .similarity import _RES, results
from .standins import events, query, signal, table, trials
from .stats import _EP, _KT, _TESTS, PERMS, PREDICTED, curves, labelled, u1_rows


def _nodes(count: int) -> str:
    """Nodes and weights of a quadrature over 0 to 1, as a list in SQL."""
    x, w = np.polynomial.legendre.leggauss(count)
    return "[" + ", ".join(f"{{'u': CAST({(a + 1) / 2!r} AS DOUBLE), 'w': CAST({b / 2!r} AS DOUBLE)}}" for a, b in zip(x.tolist(), w.tolist())) + "]"


def _p_sql(t: str, df: str) -> str:
    """Two-sided p of a t: the integral of the cosine's power df - 1 up to atan(|t| / sqrt(df))."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    return f"(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {angle} * list_sum(list_transform({_nodes(40)}, lambda z: z.w * pow(cos({angle} * z.u), {df} - 1))))"


def _bf_sql(t: str, n: str, df: str) -> str:
    """BF10 of a t with a Cauchy prior, over 200 nodes."""
    g, scale = "(z.u / (1 - z.u))", f"(1 + {n} * z.u / (1 - z.u))"
    ratio = f"exp(-0.5 * ln({scale}) - ({df} + 1) / 2 * (ln(1 + {t} * {t} / ({scale} * {df})) - ln(1 + {t} * {t} / {df})))"
    prior = f"sqrt(0.5) / sqrt(2 * pi()) * pow({g}, -1.5) * exp(-0.25 / {g}) / pow(1 - z.u, 2)"
    return f"list_sum(list_transform({_nodes(200)}, lambda z: z.w * {ratio} * {prior}))"


ALPHA = 0.05
_POINT_T = "(SELECT channel, t, avg(value - 30) / nullif(stddev_samp(value - 30) / sqrt(count(*)), 0) AS tt, CAST(count(*) - 1 AS DOUBLE) AS df FROM {sg} GROUP BY 1, 2)"
_POINT_P = f"SELECT channel, t, tt, CASE WHEN df > 0 THEN {_p_sql('tt', 'df')} END AS p FROM {_POINT_T}"
_POINT_Q = "SELECT *, least(min(q) OVER (PARTITION BY channel ORDER BY p DESC, t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS p_fdr FROM (SELECT *, p * count(p) OVER (PARTITION BY channel) / row_number() OVER (PARTITION BY channel ORDER BY p NULLS LAST, t) AS q FROM points)"


def _first_sql(flag: str) -> str:
    return f"(SELECT channel, min(lo) AS onset FROM (SELECT channel, run, min(t) AS lo, count(*) AS size FROM (SELECT *, sum(fresh) OVER (PARTITION BY channel ORDER BY t) AS run FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY channel ORDER BY t) THEN 0 ELSE 1 END AS fresh FROM (SELECT channel, t, coalesce({flag}, false) AS f FROM judged))) WHERE f GROUP BY ALL) WHERE size >= 2 GROUP BY 1)"


def judged(s: SparkSession, d: str) -> DataFrame:
    """(channel, t, tt, p, p_fdr): a one-sample t of each point, corrected within its channel."""
    rows = signal(s, d).withColumnRenamed("t", "at")
    points = ops.one_sample_t(rows, ["channel", "at"], F.col("value") - 30).withColumn("p", dist.t_p_value("t", "df"))
    points = points.select("channel", F.col("at").alias("t"), F.col("t").alias("tt"), "p")
    return ops.false_discovery(points, ["channel"], "p", ["t"])


@query("e18_e19_latency_by_p", f"WITH points AS MATERIALIZED ({_POINT_P}), judged AS MATERIALIZED ({_POINT_Q}) SELECT channel, a.onset, b.onset AS onset_fdr FROM {_first_sql(f'p < {ALPHA} AND tt > 0')} a LEFT JOIN {_first_sql(f'p_fdr < {ALPHA} AND tt > 0')} b USING (channel)")
def e18(s: SparkSession, d: str) -> DataFrame:
    """The first two points in a row that are above the baseline at p < alpha, and those that stay so when corrected."""
    return ops.sustained_significant(judged(s, d), ["channel"], "t", F.col("tt") > 0, ALPHA, 2)


@query("u1_one_sample_p", f"SELECT channel, t, r(tt) AS tt, r(p) AS p FROM ({_POINT_P})")
def u1_p(s: SparkSession, d: str) -> DataFrame:
    return judged(s, d).select("channel", "t", "tt", "p")


@query("u10_bayes_factor", f"SELECT channel, r({_bf_sql('t', 'n', '(n - 1)')}) AS bf10 FROM (SELECT channel, avg(diff) / nullif(stddev_samp(diff) / sqrt(count(diff)), 0) AS t, CAST(count(diff) AS DOUBLE) AS n FROM {_EP} GROUP BY 1)")
def u10(s: SparkSession, d: str) -> DataFrame:
    return u1_rows(s, d).select("channel", dist.bayes_factor_t("t", "n", "df").alias("bf10"))


@query("u10_one_sided_and_interval_null")
def u10_sides(s: SparkSession, d: str) -> DataFrame:
    bf = lambda lo, hi: dist.bayes_factor_between("t", "n", "df", lo, hi)
    return u1_rows(s, d).select("channel", bf(0.0, float("inf")).alias("bf_greater"), bf(float("-inf"), 0.0).alias("bf_less"), dist.interval_null_bf01("t", "n", "df", 0.1).alias("bf01_interval"))


#: Subjects of the maps; a voxel that lacks one has no Bayes factor.
SUBJECTS, EVIDENCE = 12, 3.0
_VOXELS = "(SELECT l_linestatus AS map, CAST(l_orderkey % 12 AS INT) AS subject, CAST(l_partkey AS BIGINT) AS voxel, avg(l_quantity) - 25 AS value FROM lineitem GROUP BY 1, 2, 3)"


@query("u11_bayes_map", f"SELECT map, voxel, n, r(bf01) AS bf01, CASE WHEN bf01 > {EVIDENCE} THEN r(bf01) END AS over FROM (SELECT map, voxel, n, CASE WHEN n = {SUBJECTS} THEN 1 / {_bf_sql('t', 'CAST(n AS DOUBLE)', '(CAST(n AS DOUBLE) - 1)')} END AS bf01 FROM (SELECT map, voxel, count(value) AS n, avg(value) / nullif(stddev_samp(value) / sqrt(count(value)), 0) AS t FROM {_VOXELS} GROUP BY 1, 2))")
def u11(s: SparkSession, d: str) -> DataFrame:
    values = table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("map"), (F.col("l_orderkey") % SUBJECTS).cast("int").alias("subject"), F.col("l_partkey").cast("long").alias("voxel")).agg((F.avg("l_quantity") - 25).alias("value"))
    return ops.bayes_map(values, ["map", "voxel"], "value", SUBJECTS, EVIDENCE)


_LB = lambda a, b: f"(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
_NULLS = "(SELECT channel, t, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) AS accuracy FROM {sg} GROUP BY 1, 2)"
_HITS = "(SELECT channel, count(*) FILTER (WHERE value > 40) AS k, count(*) AS n FROM " + _EP + " GROUP BY 1)"
_NULL_BF = f"(SELECT channel, k, n, p, 1000 + trunc(hits) AS a, 1000 + draws * n - trunc(hits) AS b FROM (SELECT h.channel, h.k, h.n, count(*) AS draws, sum(accuracy * n) + 1e-9 AS hits, avg(CASE WHEN accuracy >= k / n - 1e-9 THEN 1.0 ELSE 0 END) AS p FROM {_HITS} h JOIN {_NULLS} u ON u.channel = h.channel GROUP BY 1, 2, 3))"


@query("u12_empirical_null", f"SELECT channel, k, n, r(exp({_LB('k + 1.0', 'n - k + 1.0')} - ({_LB('a + k', 'b + n - k')} - {_LB('a', 'b')}))) AS bf10, r(p) AS p FROM (SELECT channel, k, n, p, a * c AS a, b * c AS b FROM (SELECT *, least(1.0, 5000 / greatest(a, b)) AS c FROM {_NULL_BF}))")
def u12_empirical(s: SparkSession, d: str) -> DataFrame:
    """Epochs above a bound as successes; the shares at single times as accuracies of a null."""
    hits = table_of_hits(s, d)
    nulls = signal(s, d).groupBy("channel", "t").agg(F.avg((F.col("value") > 40).cast("double")).alias("accuracy"))
    return ops.empirical_null_test(hits, nulls, ["channel"], "k", "n", "accuracy")


def table_of_hits(s: SparkSession, d: str) -> DataFrame:
    means = signal(s, d).groupBy("channel", "epoch").agg(F.avg("value").alias("value"))
    return means.groupBy("channel").agg(F.count_if(F.col("value") > 40).alias("k"), F.count(F.lit(1)).alias("n"))


@query("u14_kendall_with_n", f"SELECT channel, r(sum(sx * sy) / nullif(sqrt(sum(sx * sx) * sum(sy * sy)), 0)) AS tau, any_value(n) AS n FROM (SELECT a.channel, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy, a.n FROM (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM {_KT} WHERE x IS NOT NULL AND y IS NOT NULL) a JOIN {_KT} b ON a.channel = b.channel AND a.t < b.t WHERE b.x IS NOT NULL AND b.y IS NOT NULL) GROUP BY 1")
def u14(s: SparkSession, d: str) -> DataFrame:
    return ops.kendall_by_runs(curves(s, d), ["channel"], "x", "y").where("n > 1")


MODELS = {"null": [], "late": ["late"], "size": ["size"], "both": ["late", "size"]}


def model_rows(s: SparkSession, d: str) -> DataFrame:
    return trials(s, d).withColumns({"late": (F.col("status") == "F").cast("double"), "size": F.col("quantity") / 50})


@query("u28_nested_models")
def u28(s: SparkSession, d: str) -> DataFrame:
    return ops.compared_models(model_rows(s, d), ["flag"], "subject", "value", MODELS)


@query("u28_likelihood_ratios")
def u28_ratios(s: SparkSession, d: str) -> DataFrame:
    models = ops.compared_models(model_rows(s, d), ["flag"], "subject", "value", MODELS)
    return ops.likelihood_ratios(models, ["flag"], [("null", "late"), ("null", "size"), ("late", "both"), ("size", "both")])


@query("u29_model_contrasts")
def u29(s: SparkSession, d: str) -> DataFrame:
    cells = {"early small": {"late": 0, "size": 0.2}, "early large": {"late": 0, "size": 0.8}, "late small": {"late": 1, "size": 0.2}, "late large": {"late": 1, "size": 0.8}}
    return ops.model_contrasts(model_rows(s, d), ["flag"], "subject", "value", ["late", "size"], cells)


#: Spans of times of three theories: each on with itself, and the third's two spans with each other as well.
THEORIES = [("early", [(2, 8, 2, 8)]), ("late", [(9, 12, 9, 12)]), ("again", [(2, 8, 2, 8), (9, 12, 9, 12), (2, 8, 9, 12), (9, 12, 2, 8)])]
_INSIDE = "CASE theory " + " ".join(f"WHEN '{name}' THEN CASE WHEN " + " OR ".join(f"(x BETWEEN {a} AND {b} AND y BETWEEN {c} AND {e})" for a, b, c, e in blocks) + " THEN 1 ELSE 0 END" for name, blocks in THEORIES) + " END"


@query("u35_theory_rank_correlation", f"WITH cells AS MATERIALIZED (SELECT channel, x, y, round(v, 6) AS v FROM {_CELLS}), rows AS MATERIALIZED (SELECT theory, channel, x * 100 + y AS i, v, {_INSIDE} AS p FROM cells, (SELECT unnest({[t for t, _ in THEORIES]!r}) AS theory)), taus AS (SELECT a.theory, a.channel, sum(sign(a.v - b.v) * sign(a.p - b.p)) / nullif(sqrt(CAST(sum(abs(sign(a.v - b.v))) AS DOUBLE) * sum(abs(sign(a.p - b.p)))), 0) AS tau FROM rows a JOIN rows b ON a.theory = b.theory AND a.channel = b.channel AND a.i < b.i GROUP BY 1, 2) SELECT theory, r(avg(tau)) AS mean, r(stddev_samp(tau)) AS sd, count(tau) AS n, r(avg(tau) / nullif(stddev_samp(tau) / sqrt(count(tau)), 0)) AS t, count(tau) - 1 AS df FROM taus GROUP BY 1")
def u35(s: SparkSession, d: str) -> DataFrame:
    cells = matrices(s, d).withColumn("v", F.round("v", 6))
    spans = F.array(*[F.struct(F.lit(name).alias("theory"), F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abce", block)]) for block in blocks]).alias("blocks")) for name, blocks in THEORIES])
    grid = times_by_times(s, d).select("x", "y", F.explode(spans).alias("s"))
    inside = F.exists("s.blocks", lambda z: F.col("x").between(z["a"], z["b"]) & F.col("y").between(z["c"], z["e"]))
    return decoding.theory_rank_correlation(cells, grid.select("s.theory", "x", "y", inside.cast("double").alias("predicted")), "channel")


@query("u20_groups_out_of_distances", f"SELECT channel, x, y, r(v - CASE WHEN x % 2 = y % 2 THEN avg(CASE WHEN x % 2 = y % 2 THEN v END) OVER (PARTITION BY channel) ELSE 0 END) AS residual FROM {_CELLS}")
def u20(s: SparkSession, d: str) -> DataFrame:
    """Distances without what pairs of one group (times of one parity) share."""
    same = F.when(F.col("x") % 2 == F.col("y") % 2, 1.0).otherwise(0.0)
    return ops.without_regressor(matrices(s, d), ["channel"], "v", same).select("channel", "x", "y", "residual")


_TRIGGERS = "(SELECT id, t * 1.00001 + 3 AS trigger FROM {ev} WHERE kind <> 'purchase')"


@query("c16_responses_in_trigger_time", f"SELECT id, kind, r(CASE WHEN kind <> 'purchase' THEN trigger ELSE last_value(trigger IGNORE NULLS) OVER w + (t - last_value(CASE WHEN trigger IS NOT NULL THEN t END IGNORE NULLS) OVER w) END) AS at FROM {{ev}} LEFT JOIN {_TRIGGERS} USING (id) WINDOW w AS (PARTITION BY subject ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", digits=3)
def c16(s: SparkSession, d: str) -> DataFrame:
    """The log with responses, and a table of triggers without them, on a clock of their own."""
    e = events(s, d)
    triggers = e.where("kind <> 'purchase'").select("id", (F.col("t") * 1.00001 + 3).alias("trigger"))
    return log.with_responses(e, triggers, ["subject"], "id", ["t", "id"], "t", "trigger", F.col("kind") == "purchase").select("id", "kind", F.col("trigger").alias("at"))


_SOURCES = {"responsive": f"(SELECT channel, effect, reject FROM {_RES} WHERE cond = 0)", "selective": f"(SELECT channel, effect, reject FROM {_RES} WHERE cond = 1 AND sd > 20)", "latency": "(SELECT channel, min(t) AS onset FROM {sg} WHERE value > 60 GROUP BY 1)", "test": f"(SELECT channel, avg(diff) AS mean, count(diff) AS n FROM {_EP} GROUP BY 1)", "place": "(SELECT CAST(s_suppkey AS BIGINT) AS channel, s_nationkey AS area FROM supplier)"}
_WIDE = "SELECT coalesce(responsive.channel, selective.channel, latency.channel, test.channel, place.channel) AS channel, r(responsive.effect) AS responsive_effect, responsive.reject AS responsive_reject, r(selective.effect) AS selective_effect, selective.reject AS selective_reject, latency.onset AS latency_onset, r(test.mean) AS test_mean, test.n AS test_n, place.area AS place_area, concat_ws('+', CASE WHEN responsive.channel IS NOT NULL THEN 'responsive' END, CASE WHEN selective.channel IS NOT NULL THEN 'selective' END, CASE WHEN latency.channel IS NOT NULL THEN 'latency' END, CASE WHEN test.channel IS NOT NULL THEN 'test' END, CASE WHEN place.channel IS NOT NULL THEN 'place' END) AS sources"


@query("c27_joined_results", f"{_WIDE} FROM {_SOURCES['responsive']} responsive FULL JOIN {_SOURCES['selective']} selective ON selective.channel = responsive.channel FULL JOIN {_SOURCES['latency']} latency ON latency.channel = coalesce(responsive.channel, selective.channel) FULL JOIN {_SOURCES['test']} test ON test.channel = coalesce(responsive.channel, selective.channel, latency.channel) FULL JOIN {_SOURCES['place']} place ON place.channel = coalesce(responsive.channel, selective.channel, latency.channel, test.channel)")
def c27(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d)
    return tables.wide_table({
        "responsive": r.where("cond = 0").select("channel", "effect", "reject"), "selective": r.where("cond = 1 and sd > 20").select("channel", "effect", "reject"),
        "latency": signal(s, d).where("value > 60").groupBy("channel").agg(F.min("t").alias("onset")), "test": u1_rows(s, d).select("channel", "mean", "n"),
        "place": table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("channel"), F.col("s_nationkey").alias("area")),
    }, ["channel"])


_BEST = f"(SELECT channel, cond, sd FROM (SELECT *, rank() OVER (PARTITION BY channel ORDER BY sd) AS i FROM {_RES} WHERE sd IS NOT NULL) WHERE i = 1)"
_ANOVA = f"(SELECT channel, cond, effect, effect / nullif(sd, 0) AS f, reject FROM {_RES})"


@query("c23_best_models_with_anova", f"SELECT b.channel, b.cond, r(sd) AS sd, r(a.effect) AS effect, r(f) AS f, reject FROM {_BEST} b LEFT JOIN {_ANOVA} a ON a.channel = b.channel AND a.cond = b.cond")
def c23(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d)
    anova = r.select("channel", "cond", "effect", F.try_divide("effect", "sd").alias("f"), "reject")
    return tables.best_with(r.where("sd is not null").select("channel", "cond", "sd"), anova, ["channel"], "cond", "sd")


_TOP = f"(SELECT channel, max(cond) FILTER (WHERE i = 1) AS best, max(cond) FILTER (WHERE j = 1) AS model, max(effect) FILTER (WHERE cond = 0) AS effect FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(effect, 9) DESC, cond) AS i, row_number() OVER (PARTITION BY channel ORDER BY round(sd, 9) NULLS LAST, cond) AS j FROM {_RES}) GROUP BY 1)"
_CHANNELS = f"(SELECT n_name AS fine, r_name AS coarse, CAST(s_suppkey % 7 AS VARCHAR) AS subject, best, model, effect, onset FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN {_TOP} t ON t.channel = s_suppkey LEFT JOIN {_SOURCES['latency']} l ON l.channel = s_suppkey)"
_COUNTED = "count(*) AS n, count(*) FILTER (WHERE effect > 2) AS n_activated, count(*) FILTER (WHERE effect < -2) AS n_deactivated, " + ", ".join(f"count(*) FILTER (WHERE {c} = {k}) AS n_{name}_{k}" for name, c in (("selective", "best"), ("model", "model")) for k in range(4))


@query("d51_label_summary", "SELECT atlas, label, " + _COUNTED + f", r(avg(onset)) AS mean_onset, r(stddev_pop(onset)) AS sd_onset FROM (SELECT 'fine' AS atlas, fine AS label, * FROM {_CHANNELS} UNION ALL SELECT 'coarse', coarse, * FROM {_CHANNELS} UNION ALL SELECT 'subject', subject, * FROM {_CHANNELS}) GROUP BY 1, 2")
def d51(s: SparkSession, d: str) -> DataFrame:
    """Labels of two atlases and subjects: channels activated, deactivated, selective for a condition and best told by a model, and onsets."""
    r = results(s, d)
    top = r.groupBy("channel").agg(
        F.max_by("cond", F.struct(F.round("effect", 9), -F.col("cond"))).alias("best"), F.min_by("cond", F.struct(F.col("sd").isNull(), F.round("sd", 9), "cond")).alias("model"), F.max(F.when(F.col("cond") == 0, F.col("effect"))).alias("effect")
    )
    onset = signal(s, d).where("value > 60").groupBy("channel").agg(F.min("t").alias("onset"))
    places = places_of(s, d).select("channel", F.col("labels")[0].alias("fine"), F.col("labels")[1].alias("coarse"), (F.col("channel") % 7).alias("subject"))
    flags = {"activated": F.col("effect") > 2, "deactivated": F.col("effect") < -2} | {f"{name}_{k}": F.col(c) == k for name, c in (("selective", "best"), ("model", "model")) for k in range(4)}
    return tables.label_summary(places.join(top, "channel", "left").join(onset, "channel", "left"), ["fine", "coarse", "subject"], flags, ["onset"])


@query("d34_validated_theories", f"SELECT channel, roi, r(p_first) AS p_first, r(p_second) AS p_second, r(observed) AS observed, r(p) AS p, coalesce(CASE WHEN roi = 'region of the first' THEN observed > 0 ELSE observed < 0 END AND p < 0.05, false) AS validated FROM (SELECT channel, CASE channel % 3 WHEN 0 THEN 'region of the first' WHEN 1 THEN 'region of the second' ELSE 'another' END AS roi, p_first, p_second, observed, p FROM {_TESTS}) WHERE roi <> 'another'")
def d34(s: SparkSession, d: str) -> DataFrame:
    tests = labels.theory_shuffle_tests(labelled(s, d), ["channel"], "epoch", "label", "value", PREDICTED, PERMS)
    roi = F.when(F.col("channel") % 3 == 0, "region of the first").when(F.col("channel") % 3 == 1, "region of the second").otherwise("another")
    return tables.validated(tests.withColumn("roi", roi), "roi", {"first": 1, "second": -1}, "observed", "p")
