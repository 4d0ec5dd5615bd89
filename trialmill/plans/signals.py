"""Queries on signals: line items stand in, 20 channels, 100 epochs, 28 samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import channels, signals as ops
from .standins import features, query, signal, table

KEY = ["channel", "epoch"]
WINDOWS = [("early", 1, 7), ("middle", 8, 20), ("late", 15, 28)]
_W = "(VALUES ('early', 1, 7), ('middle', 8, 20), ('late', 15, 28)) v(name, lo, hi)"
_SUM = "SELECT channel, epoch{x}, avg(value) AS mean, max(value) - min(value) AS ptp, max(value) AS max, min(value) AS min, coalesce(sum((value + n) / 2), 0) AS auc FROM (SELECT *, lead(value) OVER (PARTITION BY channel, epoch{x} ORDER BY t) AS n FROM {src}) GROUP BY ALL"
_SUMMARY = _SUM.replace("{x}", "").replace("{src}", "{sg}")
_R = "r(mean) AS mean, r(ptp) AS ptp, r(max) AS max, r(min) AS min, r(auc) AS auc"
_CH = "(SELECT DISTINCT channel FROM {sg})"


def windows(s: SparkSession) -> DataFrame:
    return s.createDataFrame(WINDOWS, "name string, lo int, hi int")


@query("d21_epoch_summary", f"SELECT channel, epoch, {_R} FROM ({_SUMMARY})")
def d21(s: SparkSession, d: str) -> DataFrame:
    return ops.epoch_summary(signal(s, d), KEY)


@query("d22_window_summary", f"SELECT channel, epoch, name, {_R} FROM ({_SUM.replace('{x}', ', name').replace('{src}', f'(SELECT * FROM {{sg}} JOIN {_W} ON t BETWEEN lo AND hi)')})")
def d22(s: SparkSession, d: str) -> DataFrame:
    return ops.epoch_summary(ops.in_windows(signal(s, d), windows(s)), [*KEY, "name"])


@query("d23_window_differences", "SELECT channel, epoch, i, r(b.value - a.value) AS difference FROM (SELECT *, row_number() OVER (PARTITION BY channel, epoch ORDER BY t) AS i FROM {sg} WHERE t <= 14) a JOIN (SELECT *, row_number() OVER (PARTITION BY channel, epoch ORDER BY t) AS i FROM {sg} WHERE t > 14) b USING (channel, epoch, i)")
def d23(s: SparkSession, d: str) -> DataFrame:
    return ops.window_differences(signal(s, d), KEY, F.col("t") <= 14, F.col("t") > 14)


@query("d24_binned", "SELECT channel, epoch, bin, r(avg(value)) AS value FROM (SELECT *, (row_number() OVER (PARTITION BY channel, epoch ORDER BY t) - 1) // 3 AS bin FROM {sg}) GROUP BY ALL HAVING count(*) = 3")
def d24(s: SparkSession, d: str) -> DataFrame:
    return ops.binned(signal(s, d), KEY, 3)


@query("d25_evoked", "SELECT channel, t, r(avg(value)) AS value, count(*) AS n FROM {sg} GROUP BY ALL")
def d25(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).groupBy("channel", "t").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query("d27_average_reference", "SELECT channel, epoch, t, r(CASE WHEN channel < 10 THEN value - avg(CASE WHEN channel IN (1, 3, 5) THEN value END) OVER (PARTITION BY epoch, t) ELSE value END) AS value FROM {sg}")
def d27(s: SparkSession, d: str) -> DataFrame:
    return ops.average_reference(signal(s, d), ["epoch", "t"], F.col("channel").isin(1, 3, 5), F.col("channel") < 10)


@query("d28_divided_by_average", "SELECT channel, epoch, t, r(value / avg(value) OVER (PARTITION BY channel, epoch % 2 = 0)) AS value FROM {sg}")
def d28(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("channel", F.col("epoch") % 2 == 0)
    return signal(s, d).select(*KEY, "t", (F.col("value") / F.avg("value").over(w)).alias("value"))


@query("d29_global_field_power", "SELECT epoch, t, r(p - avg(CASE WHEN t <= 7 THEN p END) OVER (PARTITION BY epoch)) AS gfp FROM (SELECT epoch, t, sum(value * value) AS p FROM {sg} GROUP BY ALL)")
def d29(s: SparkSession, d: str) -> DataFrame:
    power = signal(s, d).groupBy("epoch", "t").agg(F.sum(F.col("value") * F.col("value")).alias("value"))
    return ops.baseline_scaled(power, ["epoch"], F.col("t") <= 7, "mean").select("epoch", "t", F.col("scaled").alias("gfp"))


@query("d30_roi_averages", "SELECT roi, t, r(avg(m)) AS value FROM (SELECT channel % 4 AS roi, channel, t, avg(value) AS m FROM {sg} WHERE channel IN (SELECT channel FROM {sg} GROUP BY 1 HAVING avg(value) > 50) GROUP BY ALL) GROUP BY ALL")
def d30(s: SparkSession, d: str) -> DataFrame:
    x = signal(s, d)
    responsive = x.groupBy("channel").agg(F.avg("value").alias("m")).where("m > 50")
    return ops.roi_averages(x, F.col("channel") % 4, responsive)


_MODES = {
    "mean": "value - m", "ratio": "value / m", "logratio": "log10(value / m)", "percent": "(value - m) / m", "zscore": "(value - m) / nullif(s, 0)", "zlogratio": "log10(value / m) / nullif(sl, 0)",
}
_BASE = "(SELECT *, stddev_pop(CASE WHEN t <= 7 THEN log10(value / m) END) OVER (PARTITION BY channel, epoch) AS sl FROM (SELECT *, avg(CASE WHEN t <= 7 THEN value END) OVER (PARTITION BY channel, epoch) AS m, stddev_pop(CASE WHEN t <= 7 THEN value END) OVER (PARTITION BY channel, epoch) AS s FROM {sg}))"
for _mode, _text in _MODES.items():
    query(f"e1_baseline_{_mode}", f"SELECT channel, epoch, t, r({_text}) AS scaled FROM {_BASE}")(lambda s, d, m=_mode: ops.baseline_scaled(signal(s, d), KEY, F.col("t") <= 7, m).select(*KEY, "t", "scaled"))


@query("e2_baseline_across_trials", "SELECT channel, epoch, t, r(value / avg(CASE WHEN t <= 7 THEN value END) OVER (PARTITION BY channel)) AS scaled FROM {sg}")
def e2(s: SparkSession, d: str) -> DataFrame:
    return ops.baseline_scaled(signal(s, d), ["channel"], F.col("t") <= 7, "ratio").select(*KEY, "t", "scaled")


@query("c18_neighbour_map", f"SELECT c.channel, a.channel AS ref1, b.channel AS ref2 FROM {_CH} c LEFT JOIN {_CH} a ON a.channel = c.channel - 1 AND a.channel // 5 = c.channel // 5 LEFT JOIN {_CH} b ON b.channel = c.channel + 1 AND b.channel // 5 = c.channel // 5")
def c18(s: SparkSession, d: str) -> DataFrame:
    return refs(s, d)


def refs(s: SparkSession, d: str) -> DataFrame:
    names = signal(s, d).select("channel").distinct()
    return ops.neighbours(names, F.floor(F.col("channel") / 5), F.col("channel"))


_REFS = f"(SELECT c.channel, CASE WHEN a.channel NOT IN (1, 2, 6) THEN a.channel END AS ref1, CASE WHEN b.channel NOT IN (1, 2, 6) THEN b.channel END AS ref2 FROM {_CH} c LEFT JOIN {_CH} a ON a.channel = c.channel - 1 AND a.channel // 5 = c.channel // 5 LEFT JOIN {_CH} b ON b.channel = c.channel + 1 AND b.channel // 5 = c.channel // 5)"


@query("c19_references_without_bad", f"SELECT *, ref1 IS NOT NULL OR ref2 IS NOT NULL AS ok FROM {_REFS}")
def c19(s: SparkSession, d: str) -> DataFrame:
    return ops.without_bad(refs(s, d), s.createDataFrame([(1,), (2,), (6,)], "channel int"))


@query("c20_laplacian", f"SELECT x.channel, x.epoch, x.t, r(x.value - CASE WHEN a.value IS NULL THEN b.value WHEN b.value IS NULL THEN a.value ELSE (a.value + b.value) / 2 END) AS value FROM {{sg}} x JOIN {_REFS} m USING (channel) LEFT JOIN {{sg}} a ON a.channel = m.ref1 AND a.epoch = x.epoch AND a.t = x.t LEFT JOIN {{sg}} b ON b.channel = m.ref2 AND b.epoch = x.epoch AND b.t = x.t")
def c20(s: SparkSession, d: str) -> DataFrame:
    good = ops.without_bad(refs(s, d), s.createDataFrame([(1,), (2,), (6,)], "channel int")).drop("ok")
    return ops.laplacian(signal(s, d), good, ["epoch", "t"])


@query("e13_moving_mean", "SELECT channel, epoch, t, r(m) AS smooth FROM (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS n FROM {sg} WINDOW w AS (PARTITION BY channel, epoch ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE n = 5")
def e13(s: SparkSession, d: str) -> DataFrame:
    return ops.moving_mean(signal(s, d), KEY, 2, 2).select(*KEY, "t", "smooth")


@query("e13_smoother_at_edges", "SELECT channel, epoch, t, r(avg(value) OVER (PARTITION BY channel, epoch ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS smooth FROM {sg}")
def e13b(s: SparkSession, d: str) -> DataFrame:
    return ops.moving_mean(signal(s, d), KEY, 2, 2, whole=False).select(*KEY, "t", "smooth")


_RA = "list_transform([{}], lambda x: round(x + 1.2345e-08, 4) + 0.0)"


@query("e14_lagged_features", "SELECT channel, epoch, t, " + _RA.format("value, lag(value) OVER w, lag(value, 2) OVER w") + " AS stacked FROM {sg} WINDOW w AS (PARTITION BY channel, epoch ORDER BY t)")
def e14(s: SparkSession, d: str) -> DataFrame:
    x = ops.lagged(signal(s, d), KEY, 3)
    return x.select(*KEY, "t", F.transform("stacked", lambda v: F.round(v + 1.2345e-08, 4) + F.lit(0.0)).alias("stacked"))


@query("e15_sub_windows", "SELECT channel, epoch, t, " + _RA.format("value, b, c") + " AS part FROM (SELECT *, lead(value) OVER w AS b, lead(value, 2) OVER w AS c, row_number() OVER w - 1 AS i FROM {sg} WINDOW w AS (PARTITION BY channel, epoch ORDER BY t)) WHERE c IS NOT NULL AND i % 3 = 0")
def e15(s: SparkSession, d: str) -> DataFrame:
    x = ops.sub_windows(signal(s, d), KEY, 3, overlapping=False)
    return x.select(*KEY, "t", F.transform("part", lambda v: F.round(v + 1.2345e-08, 4) + F.lit(0.0)).alias("part"))


@query("e16_fir_filter", "SELECT channel, epoch, t, r(0.5 * value + 0.3 * coalesce(lag(value) OVER w, 0) + 0.2 * coalesce(lag(value, 2) OVER w, 0)) AS filtered FROM {sg} WINDOW w AS (PARTITION BY channel, epoch ORDER BY t)")
def e16(s: SparkSession, d: str) -> DataFrame:
    return ops.fir(signal(s, d), KEY, [0.5, 0.3, 0.2]).select(*KEY, "t", "filtered")


_ISL = "SELECT channel, epoch, run, min(t) AS lo, max(t) AS hi, count(*) AS size FROM (SELECT *, sum(n) OVER (PARTITION BY channel, epoch ORDER BY t) AS run FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY channel, epoch ORDER BY t) THEN 0 ELSE 1 END AS n FROM (SELECT *, value > 50 AS f FROM {sg}))) WHERE f GROUP BY ALL"


@query("e17_sustained_activation", f"SELECT channel, epoch, min(lo) AS onset, arg_min(hi, lo) AS offset, arg_min(size, lo) AS length FROM ({_ISL}) WHERE size >= 4 GROUP BY ALL")
def e17(s: SparkSession, d: str) -> DataFrame:
    return ops.sustained(signal(s, d), KEY, F.col("value") > 50, 4)


@query("e20_tracked_duration", "SELECT channel, epoch, r(threshold) AS threshold, coalesce(min(CASE WHEN value < threshold THEN t END), min(t)) AS drop, count(CASE WHEN value < threshold THEN 1 END) = 0 AS never_dropped FROM (SELECT *, (avg(CASE WHEN t <= 7 THEN value END) OVER w + avg(CASE WHEN t > 7 THEN value END) OVER w) / 2 AS threshold FROM {sg} WINDOW w AS (PARTITION BY channel, epoch)) WHERE t > 7 GROUP BY channel, epoch, threshold")
def e20(s: SparkSession, d: str) -> DataFrame:
    return ops.tracked_duration(signal(s, d), KEY, F.col("t") <= 7, F.col("t") > 7)


@query("e22_highest_against_others", "SELECT channel, r(max(m)) AS highest, r(avg(CASE WHEN i > 1 THEN m END)) AS others, arg_min(cond, i) AS best FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY m DESC, cond) AS i FROM (SELECT channel, epoch % 4 AS cond, avg(value) AS m FROM {sg} GROUP BY ALL)) GROUP BY 1")
def e22(s: SparkSession, d: str) -> DataFrame:
    m = signal(s, d).groupBy("channel", (F.col("epoch") % 4).alias("cond")).agg(F.avg("value").alias("m"))
    m = m.withColumn("i", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("m"), "cond")))
    return m.groupBy("channel").agg(F.max("m").alias("highest"), F.avg(F.when(F.col("i") > 1, F.col("m"))).alias("others"), F.min_by("cond", "i").alias("best"))


@query("e23_outliers", "SELECT channel, epoch, t, r(d / nullif(median(d) OVER (PARTITION BY channel), 0)) AS score, coalesce(d / nullif(median(d) OVER (PARTITION BY channel), 0) > 2, false) AS outlier FROM (SELECT *, abs(value - median(value) OVER (PARTITION BY channel)) AS d FROM {sg})")
def e23(s: SparkSession, d: str) -> DataFrame:
    return ops.by_deviation(signal(s, d), ["channel"], "value", 2).select(*KEY, "t", "score", "outlier")


@query("e24_rejected_epochs", f"SELECT epoch, r(share) AS share, share > 0.1 AS rejected FROM (SELECT epoch, avg(CASE WHEN abs(z) > 1.5 THEN 1.0 ELSE 0 END) AS share FROM (SELECT epoch, (ptp - avg(ptp) OVER w) / nullif(stddev_pop(ptp) OVER w, 0) AS z FROM ({_SUMMARY}) WINDOW w AS (PARTITION BY channel)) GROUP BY 1)")
def e24(s: SparkSession, d: str) -> DataFrame:
    return ops.rejected_epochs(ops.epoch_summary(signal(s, d), KEY), "ptp", 1.5, 0.1)


@query("e25_bad_segments", "SELECT channel, epoch, r(range / 1) AS range, r(steep) AS steep, r(dr / nullif(median(dr) OVER (PARTITION BY epoch), 0)) AS range_score, coalesce(dr / nullif(median(dr) OVER (PARTITION BY epoch), 0) > 5, false) AS range_bad, r(ds / nullif(median(ds) OVER (PARTITION BY epoch), 0)) AS steep_score, coalesce(ds / nullif(median(ds) OVER (PARTITION BY epoch), 0) > 5, false) AS steep_bad FROM (SELECT *, abs(range - median(range) OVER (PARTITION BY epoch)) AS dr, abs(steep - median(steep) OVER (PARTITION BY epoch)) AS ds FROM (SELECT channel, epoch, max(value) - min(value) AS range, max(s) AS steep FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY channel, epoch ORDER BY t)) AS s FROM {sg}) GROUP BY ALL))")
def e25(s: SparkSession, d: str) -> DataFrame:
    return ops.segment_scores(signal(s, d), ["epoch"], "channel").select(*KEY, "range", "steep", "range_score", "range_bad", "steep_score", "steep_bad")


@query("e25_log_power_slope", "SELECT channel, r(regr_slope(ln(value), ln(t))) AS slope, r(avg(ln(value))) AS level FROM {sg} GROUP BY 1")
def e25b(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).groupBy("channel").agg(F.regr_slope(F.ln("value"), F.ln("t")).alias("slope"), F.avg(F.ln("value")).alias("level"))


@query("e26_spikes")
def e26(s: SparkSession, d: str) -> DataFrame:
    x = signal(s, d).withColumn("at", F.col("epoch") * 28 + F.col("t")).select("channel", F.col("at").alias("t"), "value")
    return ops.spikes(x, ["channel"], 50, 10, 0.9, 3)


@query("e28_differences_of_bins", "SELECT channel, epoch, bin, r(v - lag(v) OVER (PARTITION BY channel, epoch ORDER BY bin)) AS difference FROM (SELECT channel, epoch, bin, avg(value) AS v FROM (SELECT *, (row_number() OVER (PARTITION BY channel, epoch ORDER BY t) - 1) // 3 AS bin FROM {sg}) GROUP BY ALL HAVING count(*) = 3)")
def e28(s: SparkSession, d: str) -> DataFrame:
    x = ops.binned(signal(s, d), KEY, 3)
    return x.select(*KEY, "bin", (F.col("value") - F.lag("value").over(Window.partitionBy(*KEY).orderBy("bin"))).alias("difference"))


@query("a15_load_signal", "SELECT channel, epoch, t, r(value - avg(CASE WHEN t <= 7 THEN value END) OVER (PARTITION BY channel, epoch)) AS value FROM {sg} WHERE epoch % 2 = 0 AND t <= 20 AND channel IN (SELECT channel FROM {sg} GROUP BY 1 HAVING avg(value) > 50)")
def a15(s: SparkSession, d: str) -> DataFrame:
    x = signal(s, d)
    responsive = x.groupBy("channel").agg(F.avg("value").alias("m")).where("m > 50")
    x = x.where("epoch % 2 = 0 and t <= 20").join(responsive, "channel", "left_semi")
    return ops.baseline_scaled(x, KEY, F.col("t") <= 7, "mean").select(*KEY, "t", F.col("scaled").alias("value"))


@query("b28_cut_time_span", "SELECT channel, epoch, row_number() OVER (PARTITION BY channel, epoch ORDER BY t) AS i, r(value) AS value FROM {sg} WHERE NOT (epoch % 3 = 0 AND t BETWEEN 8 AND 14) AND NOT (epoch % 3 = 1 AND t BETWEEN 15 AND 16)")
def b28(s: SparkSession, d: str) -> DataFrame:
    cuts = {0: [(8, 14)], 1: [(15, 16)]}
    return ops.without_spans(signal(s, d), KEY, F.col("epoch") % 3, cuts).select(*KEY, "i", "value")


@query("b33_noise_to_minimum", "SELECT channel, epoch, t, r(CASE WHEN t BETWEEN 3 AND 5 OR t BETWEEN 20 AND 21 THEN min(value) OVER (PARTITION BY channel) ELSE value END) AS value FROM {sg}")
def b33(s: SparkSession, d: str) -> DataFrame:
    return ops.filled_with_minimum(signal(s, d), ["channel"], [(3, 5), (20, 21)]).select(*KEY, "t", "value")


@query("b27_rotated_vectors", "SELECT vec_id AS id, r(x[6]) AS first, r(x[5]) AS last FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)")
def b27(s: SparkSession, d: str) -> DataFrame:
    x = features(s, d).withColumn("y", channels.rotated("x", 5))
    return x.select("id", F.element_at("y", 1).alias("first"), F.element_at("y", -1).alias("last"))


@query("b27_rotated_elements", "SELECT id, CAST((i + 58) % 64 AS INT) AS i, r(v) AS value FROM (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64)")
def b27_all(s: SparkSession, d: str) -> DataFrame:
    return features(s, d).where(F.size("x") == 64).select("id", F.posexplode(channels.rotated("x", 5)).alias("i", "value"))


@query("d48_time_bins_of_vectors", "SELECT id, label, bin, r(avg(v)) AS value FROM (SELECT vec_id AS id, label, (i - 1) // 22 AS bin, v FROM (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)) GROUP BY ALL")
def d48(s: SparkSession, d: str) -> DataFrame:
    x = features(s, d).select("id", "label", F.posexplode("x").alias("i", "v"))
    return x.groupBy("id", "label", F.floor(F.col("i") / 22).alias("bin")).agg(F.avg("v").alias("value"))


@query("d50_vector_time_course", "SELECT label, i, r(avg(v)) AS mean, r(stddev_samp(v)) AS sd FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def d50(s: SparkSession, d: str) -> DataFrame:
    x = features(s, d).select("label", F.posexplode("x").alias("i", "v"))
    return x.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


@query("b26_zscore_against_null", "SELECT channel, r((v - m) / nullif(s, 0)) AS z FROM (SELECT channel, avg(CASE WHEN t > 7 THEN value END) AS v, avg(CASE WHEN t <= 7 THEN value END) AS m, stddev_pop(CASE WHEN t <= 7 THEN value END) AS s FROM {sg} GROUP BY 1)")
def b26(s: SparkSession, d: str) -> DataFrame:
    base = F.when(F.col("t") <= 7, F.col("value"))
    x = signal(s, d).groupBy("channel").agg(F.avg(F.when(F.col("t") > 7, F.col("value"))).alias("v"), F.avg(base).alias("m"), F.stddev_pop(base).alias("s"))
    return x.select("channel", F.try_divide(F.col("v") - F.col("m"), "s").alias("z"))


@query("e8_rising_edges", "SELECT channel, epoch, t FROM (SELECT *, t - lag(t) OVER (PARTITION BY channel, epoch ORDER BY t) AS gap FROM (SELECT *, lag(value) OVER (PARTITION BY channel, epoch ORDER BY t) AS before FROM {sg}) WHERE value > 60 AND before <= 60) WHERE gap IS NULL OR gap >= 4")
def e8(s: SparkSession, d: str) -> DataFrame:
    return ops.rising_edges(signal(s, d), KEY, 60, 4)
