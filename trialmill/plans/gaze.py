"""Queries on gaze: events stand in for samples (x = value, y = k, by subject), errors for blinks of two hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import gaze as ops, intervals, trials as trial_ops
from .standins import events, query

HOUR = 3600.0
_B = "(SELECT subject, t AS lo, t + 7200 AS hi, id AS bid FROM {ev} WHERE kind = 'error')"
_S = "(SELECT subject, t AS lo, t + 3600 AS hi, id AS sid, k FROM {ev} WHERE kind = 'click')"


def blinks(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("kind = 'error'").select("subject", F.col("t").alias("lo"), (F.col("t") + 2 * HOUR).alias("hi"), F.col("id").alias("bid"))


def moves(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("kind = 'click'").select("subject", F.col("t").alias("lo"), (F.col("t") + HOUR).alias("hi"), F.col("id").alias("sid"), "k")


def samples(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", "subject", "t", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), "kind")


@query("b14_degrees_pixels", "SELECT id, round(tan(radians(value / 20) / 2) * 2 * 70 / 0.03) AS px, r(degrees(atan(value * 0.03 / 140)) * 2) AS deg FROM {ev}")
def b14(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", ops.degrees_to_pixels(F.col("value") / 20, 70, 0.03).alias("px"), ops.pixels_to_degrees(F.col("value"), 70, 0.03).alias("deg"))


@query("b15_distance_to_centre", "SELECT id, r(value - 100) AS dx, r(k - 50) AS dy, r(sqrt((value - 100) * (value - 100) + (k - 50.0) * (k - 50))) AS px, r(sqrt((value - 100) * (value - 100) + (k - 50.0) * (k - 50)) * 0.03) AS deg, sqrt((value - 100) * (value - 100) + (k - 50.0) * (k - 50)) * 0.03 <= 2 AS inside FROM {ev}")
def b15(s: SparkSession, d: str) -> DataFrame:
    return ops.distance_from(samples(s, d), 100, 50, 0.03, 2).select("id", "dx", "dy", "px", "deg", "inside")


@query("b17_pupil_outside_blinks", f"SELECT e.id, CASE WHEN NOT EXISTS (SELECT 1 FROM {_B} b WHERE b.subject = e.subject AND e.t BETWEEN b.lo - 200 AND b.hi + 200) THEN value END AS pupil FROM {{ev}} e")
def b17(s: SparkSession, d: str) -> DataFrame:
    rows = ops.in_spans(events(s, d), ops.padded(blinks(s, d), 200, 200), ["subject"], "t", 2 * HOUR, "pad")
    return rows.select("id", F.when(~F.col("pad"), F.col("value")).alias("pupil"))


@query("b23_wide_to_long", "SELECT subject, 'lo' AS name, r(min(value)) AS x FROM {ev} GROUP BY 1 UNION ALL SELECT subject, 'hi', r(max(value)) FROM {ev} GROUP BY 1")
def b23(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy("subject").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).unpivot("subject", ["lo", "hi"], "name", "x")


@query("c5_samples_in_intervals", f"SELECT e.id, b.bid FROM {{ev}} e JOIN {_B} b ON b.subject = e.subject AND e.t BETWEEN b.lo AND b.hi")
def c5(s: SparkSession, d: str) -> DataFrame:
    return intervals.range_join(events(s, d), blinks(s, d), ["subject"], "t", "lo", "hi", 2 * HOUR).select("id", "bid")


@query("c6_onset_sample", "SELECT a.subject, a.k, coalesce(b.value, c.value) AS value, coalesce(b.value, c.value) IS NULL AS no_data FROM (SELECT DISTINCT subject, k FROM {ev}) a LEFT JOIN (SELECT subject, k, max(value) AS value FROM {ev} WHERE kind = 'view' GROUP BY 1, 2) b ON a.subject = b.subject AND a.k = b.k LEFT JOIN (SELECT subject, k, max(value) AS value FROM {ev} WHERE kind = 'view' GROUP BY 1, 2) c ON a.subject = c.subject AND a.k // 2 = c.k")
def c6(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    seen = e.where("kind = 'view'").groupBy("subject", "k").agg(F.max("value").alias("value"))
    full, half = seen.withColumnRenamed("value", "full"), seen.select("subject", F.col("k").cast("long").alias("half_k"), F.col("value").alias("half"))
    rows = e.select("subject", "k").distinct().withColumn("half_k", F.floor(F.col("k") / 2)).join(full, ["subject", "k"], "left").join(half, ["subject", "half_k"], "left")
    value = F.coalesce("full", "half")
    return rows.select("subject", "k", value.alias("value"), value.isNull().alias("no_data"))


@query("c7_trial_cutouts", f"SELECT b.bid, e.id, r(e.t - b.lo) AS since FROM {{ev}} e JOIN {_B} b ON b.subject = e.subject AND e.t BETWEEN b.lo - 1800 AND b.hi - 1800", digits=3)
def c7(s: SparkSession, d: str) -> DataFrame:
    cut = blinks(s, d).withColumns({"at": F.col("lo"), "lo": F.col("lo") - 1800, "hi": F.col("hi") - 1800})
    return intervals.range_join(events(s, d), cut, ["subject"], "t", "lo", "hi", 2 * HOUR).select("bid", "id", (F.col("t") - F.col("at")).alias("since"))


@query("c8_padded_marks", f"SELECT e.id, EXISTS (SELECT 1 FROM {_B} b WHERE b.subject = e.subject AND e.t BETWEEN b.lo - 200 AND b.hi + 200) AS pad FROM {{ev}} e")
def c8(s: SparkSession, d: str) -> DataFrame:
    return ops.in_spans(events(s, d), ops.padded(blinks(s, d), 200, 200), ["subject"], "t", 2 * HOUR, "pad").select("id", "pad")


@query("c9_saccades_outside_blinks", f"SELECT sid, row_number() OVER (PARTITION BY subject ORDER BY lo, hi) AS number FROM {_S} a WHERE NOT EXISTS (SELECT 1 FROM {_B} b WHERE b.subject = a.subject AND a.lo <= b.hi + 200 AND a.hi >= b.lo - 200)")
def c9(s: SparkSession, d: str) -> DataFrame:
    return ops.valid_events(moves(s, d), ops.padded(blinks(s, d), 200, 200), ["subject"], 2 * HOUR).select("sid", "number")


@query("c10_fixations_outside_blinks", f"SELECT sid FROM {_S} a WHERE NOT EXISTS (SELECT 1 FROM {_B} b WHERE b.subject = a.subject AND a.lo <= b.hi AND a.hi >= b.lo)")
def c10(s: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_join(moves(s, d), blinks(s, d), ["subject"], 2 * HOUR, "left_anti").select("sid")


@query("c11_false_saccades", f"SELECT sid, EXISTS (SELECT 1 FROM {_B} b WHERE b.subject = a.subject AND b.lo >= a.lo AND b.lo <= a.hi) AS holds_blink FROM {_S} a")
def c11(s: SparkSession, d: str) -> DataFrame:
    m = moves(s, d)
    starts = blinks(s, d).select("subject", F.col("lo").alias("t"))
    held = intervals.range_join(starts, m, ["subject"], "t", "lo", "hi", HOUR).select("sid").distinct().withColumn("holds_blink", F.lit(True))
    return m.join(held, "sid", "left").select("sid", F.coalesce("holds_blink", F.lit(False)).alias("holds_blink"))


@query("c12_attribute_on_samples", f"SELECT e.id, max(a.k) AS amplitude FROM {{ev}} e JOIN {_S} a ON a.subject = e.subject AND e.t BETWEEN a.lo AND a.hi GROUP BY e.id")
def c12(s: SparkSession, d: str) -> DataFrame:
    spans = moves(s, d).withColumnRenamed("k", "amp")
    return intervals.range_join(events(s, d), spans, ["subject"], "t", "lo", "hi", HOUR).groupBy("id").agg(F.max("amp").alias("amplitude"))


_DAY = "CAST(floor(t / 86400) AS BIGINT)"


@query("d7_window_statistics", f"SELECT subject, {_DAY} AS win, r(avg(value)) AS mean, r(quantile_cont(value, 0.5)) AS median FROM {{ev}} GROUP BY 1, 2")
def d7(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy("subject", F.floor(F.col("t") / 86400).alias("win")).agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))


@query("d8_event_windows", f"SELECT subject, k, win, n AS samples FROM (SELECT *, row_number() OVER (PARTITION BY subject, k ORDER BY n DESC, win) AS i FROM (SELECT subject, k, {_DAY} % 5 AS win, count(*) AS n FROM {{ev}} GROUP BY 1, 2, 3)) WHERE i = 1")
def d8(s: SparkSession, d: str) -> DataFrame:
    points = events(s, d).withColumn("win", F.floor(F.col("t") / 86400) % 5)
    return ops.main_window(points, ["subject", "k"], "win")


@query("d9_baseline_corrected", f"SELECT id, r(value - avg(CASE WHEN kind = 'view' THEN value END) OVER (PARTITION BY subject, {_DAY})) AS corrected FROM {{ev}}")
def d9(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).withColumn("day", F.floor(F.col("t") / 86400))
    return ops.baseline_corrected(rows, ["subject", "day"], "value", F.col("kind") == "view").select("id", "corrected")


@query("d10_gaze_density", "SELECT kind, cx, b.cy AS cy, coalesce(n, 0) AS n, r(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY kind)) AS share FROM (SELECT DISTINCT kind FROM {ev}) CROSS JOIN (SELECT unnest(range(0, 10)) AS cx) CROSS JOIN (SELECT unnest(range(0, 10)) AS cy) b LEFT JOIN (SELECT kind, CAST(floor(value / 50) AS BIGINT) AS cx, CAST(floor(k / 10.0) AS BIGINT) AS cy, count(*) AS n FROM {ev} GROUP BY 1, 2, 3) c USING (kind, cx, cy)")
def d10(s: SparkSession, d: str) -> DataFrame:
    return ops.density(samples(s, d), ["kind"], 50, 10, 10, 10)


@query("d11_distance_histogram", "SELECT kind, bin, coalesce(n, 0) AS n, r(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY kind), 0)) AS share FROM (SELECT DISTINCT kind FROM {ev}) CROSS JOIN (SELECT unnest(range(1, 13)) AS bin) LEFT JOIN (SELECT kind, CAST(floor((value - 100 + 60) / 10) + 1 AS BIGINT) AS bin, count(*) AS n FROM {ev} WHERE value - 100 >= -60 AND value - 100 < 60 GROUP BY 1, 2) USING (kind, bin)")
def d11(s: SparkSession, d: str) -> DataFrame:
    return ops.histogram(events(s, d).where("value - 100 < 60"), ["kind"], F.col("value") - 100, -60, 60, 12)


@query("d12_direction_histogram", "SELECT bin, coalesce(n, 0) AS n, r(coalesce(n, 0) / sum(coalesce(n, 0)) OVER ()) AS share FROM (SELECT unnest(range(1, 9)) AS bin) LEFT JOIN (SELECT CAST(floor((degrees(atan2(-(k - 50.0), value - 100)) + 180) / 45) + 1 AS BIGINT) AS bin, count(*) AS n FROM {ev} GROUP BY 1) USING (bin)")
def d12(s: SparkSession, d: str) -> DataFrame:
    angle = F.degrees(F.atan2(-(F.col("y") - 50), F.col("x") - 100))
    rows = samples(s, d).withColumns({"all": F.lit(1), "angle": angle}).where("angle < 180")
    return ops.histogram(rows, ["all"], F.col("angle"), -180, 180, 8).drop("all")


@query("d11_histogram_closed_at_the_end", "SELECT kind, bin, coalesce(n, 0) AS n, r(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY kind), 0)) AS share FROM (SELECT DISTINCT kind FROM {ev}) CROSS JOIN (SELECT unnest(range(1, 13)) AS bin) LEFT JOIN (SELECT kind, CAST(CASE WHEN v = 60 THEN 12 ELSE floor((v + 60) / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM (SELECT kind, floor(value) - 100 AS v FROM {ev}) WHERE v BETWEEN -60 AND 60 GROUP BY 1, 2) USING (kind, bin)")
def d11_edge(s: SparkSession, d: str) -> DataFrame:
    """Whole distances, of which some lie on the last bin's end: that bin holds them."""
    return ops.histogram(events(s, d), ["kind"], F.floor("value") - 100, -60, 60, 12)


@query("d12_directions_closed_at_the_end", "SELECT bin, coalesce(n, 0) AS n, r(coalesce(n, 0) / sum(coalesce(n, 0)) OVER ()) AS share FROM (SELECT unnest(range(1, 9)) AS bin) LEFT JOIN (SELECT CAST(CASE WHEN a = 180 THEN 8 ELSE floor((a + 180) / 45) + 1 END AS BIGINT) AS bin, count(*) AS n FROM (SELECT degrees(atan2(50.0 - k, value - 100)) AS a FROM {ev}) GROUP BY 1) USING (bin)")
def d12_edge(s: SparkSession, d: str) -> DataFrame:
    """All directions; those to the left are at 180 degrees, the last bin's end."""
    rows = samples(s, d).withColumns({"all": F.lit(1), "angle": F.degrees(F.atan2(F.lit(50.0) - F.col("y"), F.col("x") - 100))})
    return ops.histogram(rows, ["all"], F.col("angle"), -180, 180, 8).drop("all")


@query("d13_time_course", f"SELECT kind, win, r(avg(m)) AS mean, r(stddev_samp(m) / sqrt(count(m))) AS se, count(m) AS subjects FROM (SELECT subject, kind, {_DAY} % 5 AS win, avg(value) AS m FROM {{ev}} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def d13(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).withColumn("win", F.floor(F.col("t") / 86400) % 5)
    return trial_ops.two_level_means(rows, "subject", ["kind", "win"], F.col("value"))


@query("d14_shares_in_time", f"SELECT k, {_DAY} % 5 AS win, r(avg(CASE WHEN kind = 'error' THEN 1.0 ELSE 0 END)) AS share FROM {{ev}} GROUP BY 1, 2 HAVING count(DISTINCT subject) > 1")
def d14(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).groupBy("k", (F.floor(F.col("t") / 86400) % 5).alias("win")).agg(F.avg((F.col("kind") == "error").cast("int")).alias("share"), F.count_distinct("subject").alias("subjects"))
    return rows.where("subjects > 1").drop("subjects")


@query("d17_pupil_normed", f"SELECT subject, {_DAY} AS win, r(avg(p)) AS mean, r(quantile_cont(p, 0.5)) AS median FROM (SELECT *, value / avg(value) OVER (PARTITION BY subject) AS p FROM {{ev}}) GROUP BY 1, 2")
def d17(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).withColumn("p", F.col("value") / F.avg("value").over(Window.partitionBy("subject")))
    return rows.groupBy("subject", F.floor(F.col("t") / 86400).alias("win")).agg(F.avg("p").alias("mean"), F.percentile("p", F.lit(0.5)).alias("median"))


@query("d18_trial_counts", "SELECT modality, r(avg(clicks)) AS clicks, r(stddev_samp(clicks)) AS clicks_sd, r(avg(errors)) AS errors, r(avg(pupil)) AS pupil FROM (SELECT subject % 3 AS modality, subject, k, count(*) FILTER (WHERE kind = 'click') AS clicks, count(*) FILTER (WHERE kind = 'error') AS errors, avg(value) AS pupil FROM {ev} GROUP BY 1, 2, 3) GROUP BY GROUPING SETS ((), (modality))")
def d18(s: SparkSession, d: str) -> DataFrame:
    per = events(s, d).groupBy((F.col("subject") % 3).alias("modality"), "subject", "k").agg(F.count_if(F.col("kind") == "click").alias("clicks"), F.count_if(F.col("kind") == "error").alias("errors"), F.avg("value").alias("pupil"))
    return per.groupingSets([[], [F.col("modality")]], F.col("modality")).agg(F.avg("clicks").alias("clicks"), F.stddev_samp("clicks").alias("clicks_sd"), F.avg("errors").alias("errors"), F.avg("pupil").alias("pupil"))


@query("d19_gaze_accuracy", f"SELECT subject, r(avg(CASE WHEN m < 95 THEN 1.0 ELSE 0 END)) AS accuracy, r(avg(m)) AS mean FROM (SELECT subject, {_DAY} AS win, avg(value) AS m FROM {{ev}} GROUP BY 1, 2) GROUP BY 1")
def d19(s: SparkSession, d: str) -> DataFrame:
    win = events(s, d).groupBy("subject", F.floor(F.col("t") / 86400).alias("win")).agg(F.avg("value").alias("m"))
    return win.groupBy("subject").agg(F.avg((F.col("m") < 95).cast("int")).alias("accuracy"), F.avg("m").alias("mean"))


@query("d20_least_extent", "SELECT min(w) AS width, min(h) AS height FROM (SELECT subject, max(value) AS w, max(k) AS h FROM {ev} GROUP BY 1)")
def d20(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy("subject").agg(F.max("value").alias("w"), F.max("k").alias("h")).agg(F.min("w").alias("width"), F.min("h").alias("height"))


_RUNS = "SELECT subject, run, min(t) AS lo, max(t) AS hi, count(*) AS size FROM (SELECT *, sum(n) OVER (PARTITION BY subject ORDER BY t, id) AS run FROM (SELECT *, CASE WHEN f IS NOT DISTINCT FROM lag(f) OVER (PARTITION BY subject ORDER BY t, id) THEN 0 ELSE 1 END AS n FROM (SELECT *, %s AS f FROM {ev}))) WHERE f GROUP BY 1, 2"


@query("e9_blink_runs", f"SELECT subject, CAST(run AS BIGINT) AS run, r(lo) AS lo, r(hi) AS hi, size FROM ({_RUNS % 'value < 60'})", digits=3)
def e9(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).withColumn("pupil", F.when(F.col("value") < 60, 0.0).otherwise(F.col("value")))
    return ops.blink_runs(rows, ["subject"], ["t", "id"], "pupil", "t")


_SM = "SELECT *, avg(p) OVER (PARTITION BY subject ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM (SELECT *, CASE WHEN value < 60 THEN 0 ELSE value END AS p FROM {ev})"
_FR = f"SELECT *, coalesce(lead(s) OVER w < s, false) AS falls, coalesce(lag(s) OVER w < s, false) AS rises, CASE WHEN (p = 0) IS NOT DISTINCT FROM (lag(p) OVER w = 0) THEN 0 ELSE 1 END AS n FROM ({_SM}) WINDOW w AS (PARTITION BY subject ORDER BY t, id)"
_EX = f"SELECT *, max(CASE WHEN NOT falls THEN t END) OVER (PARTITION BY subject ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f, min(CASE WHEN NOT rises THEN t END) OVER (PARTITION BY subject ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS o, sum(n) OVER (PARTITION BY subject ORDER BY t, id) AS run FROM ({_FR})"
_SP = f"SELECT subject, run, coalesce(arg_min_null(f, t), min(t)) AS lo, coalesce(arg_max_null(o, t), max(t)) AS hi FROM ({_EX}) WHERE p = 0 GROUP BY 1, 2"


@query("e10_extended_blinks", f"SELECT subject, CAST(part AS BIGINT) AS part, r(min(lo)) AS lo, r(max(hi)) AS hi, count(*) AS parts FROM (SELECT *, sum(n) OVER (PARTITION BY subject ORDER BY lo, hi) AS part FROM (SELECT *, CASE WHEN lo - max(hi) OVER (PARTITION BY subject ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 100 THEN 0 ELSE 1 END AS n FROM ({_SP}))) GROUP BY 1, 2", digits=3)
def e10(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).withColumn("pupil", F.when(F.col("value") < 60, 0.0).otherwise(F.col("value")))
    return ops.extended_blinks(rows, ["subject"], ["t", "id"], "pupil", "t", 100)


_V = "(lead({c}, 2) OVER w + lead({c}) OVER w - lag({c}) OVER w - lag({c}, 2) OVER w) / 6"
_VEL = "SELECT *, " + _V.replace("{c}", "value") + " AS vx, " + _V.replace("{c}", "CAST(k AS DOUBLE)") + " AS vy FROM {ev} WINDOW w AS (PARTITION BY subject ORDER BY t, id)"
_FAST = f"SELECT v.*, (vx / sx) ** 2 + (vy / sy) ** 2 > 1 AS fast FROM ({_VEL}) v JOIN (SELECT subject, 1.5 * sqrt(median(vx * vx) - median(vx) ** 2) AS sx, 1.5 * sqrt(median(vy * vy) - median(vy) ** 2) AS sy FROM ({_VEL}) GROUP BY 1) USING (subject)"


@query("e11_b16_saccades", f"SELECT subject, CAST(run AS BIGINT) AS run, r(lo) AS lo, r(hi) AS hi, size, r(dx) AS dx, r(dy) AS dy, r(width) AS width, r(height) AS height, r(degrees(atan2(0.0 - dy, dx))) AS direction, r(sqrt(width ** 2 + height ** 2)) AS amplitude FROM (SELECT subject, run, min(t) AS lo, max(t) AS hi, count(*) AS size, arg_max(value, t) - arg_min(value, t) AS dx, CAST(arg_max(k, t) - arg_min(k, t) AS DOUBLE) AS dy, max(value) - min(value) AS width, CAST(max(k) - min(k) AS DOUBLE) AS height FROM (SELECT *, sum(n) OVER (PARTITION BY subject ORDER BY t, id) AS run FROM (SELECT *, CASE WHEN fast = lag(fast) OVER (PARTITION BY subject ORDER BY t, id) THEN 0 ELSE 1 END AS n FROM ({_FAST}))) WHERE fast GROUP BY 1, 2) WHERE size >= 2", digits=3)
def e11(s: SparkSession, d: str) -> DataFrame:
    return ops.saccades(samples(s, d), ["subject"], ["t", "id"], "t", 1.5, 2)


@query("e12_missing_runs", f"SELECT subject, CAST(run AS BIGINT) AS run, r(lo) AS lo, r(hi) AS hi, size FROM ({_RUNS % 'value < 80'}) WHERE hi - lo > 10000", digits=3)
def e12(s: SparkSession, d: str) -> DataFrame:
    return ops.missing_runs(events(s, d), ["subject"], ["t", "id"], F.when(F.col("value") >= 80, F.col("value")), "t", 10000)


@query("e27_event_counters", f"SELECT bid, row_number() OVER (PARTITION BY subject ORDER BY lo, hi) AS number FROM {_B}")
def e27(s: SparkSession, d: str) -> DataFrame:
    return blinks(s, d).select("bid", F.row_number().over(Window.partitionBy("subject").orderBy("lo", "hi")).cast("long").alias("number"))
