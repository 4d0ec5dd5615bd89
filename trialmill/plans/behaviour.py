"""Queries on behaviour: trials, response labels, quality and descriptive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf, norm_cdf_sql, norm_ppf, norm_ppf_sql
from ..operators import intervals, trials as ops
from .standins import events, query, table, trials

# the stand-in rule: even codes are targets; clicks and purchases are responses
_LABEL = "CASE WHEN k % 2 = 0 AND kind IN ('click', 'purchase') THEN 'TruePositive' WHEN k % 2 = 0 THEN 'FalseNegative' WHEN kind IN ('click', 'purchase') THEN 'FalsePositive' ELSE 'TrueNegative' END"


def labelled(s: SparkSession, d: str) -> DataFrame:
    label = ops.response_label(F.col("k") % 2 == 0, F.col("kind").isin("click", "purchase"))
    return events(s, d).withColumns({"label": label, "relevant": F.col("k") < 50, "rt": F.col("value") / 100})


_QUALITY = f"""SELECT subject, count(*) FILTER (WHERE label = 'TruePositive') AS hits, count(*) FILTER (WHERE label IN ('TruePositive', 'FalseNegative')) AS targets,
 count(*) FILTER (WHERE label = 'FalsePositive') AS fas, count(*) FILTER (WHERE label IN ('FalsePositive', 'TrueNegative')) AS lures,
 count(*) FILTER (WHERE label = 'FalsePositive' AND k < 50) AS fas_relevant, count(*) FILTER (WHERE label = 'FalsePositive' AND k >= 50) AS fas_irrelevant,
 count(*) FILTER (WHERE label = 'TruePositive') / nullif(count(*) FILTER (WHERE label IN ('TruePositive', 'FalseNegative')), 0) AS hit_rate,
 count(*) FILTER (WHERE label = 'FalsePositive') / nullif(count(*) FILTER (WHERE label IN ('FalsePositive', 'TrueNegative')), 0) AS fa_rate,
 avg(CASE WHEN label = 'TruePositive' THEN value / 100 END) AS hit_rt FROM (SELECT *, {_LABEL} AS label FROM {{ev}}) GROUP BY subject"""


@query("d1_subject_quality", f"SELECT * REPLACE (r(hit_rate) AS hit_rate, r(fa_rate) AS fa_rate, r(hit_rt) AS hit_rt) FROM ({_QUALITY})")
def d1(s: SparkSession, d: str) -> DataFrame:
    return ops.subject_quality(labelled(s, d))


@query("b7_validity", f"SELECT subject, r(hit_rate) AS hit_rate, r(fa_rate) AS fa_rate, hit_rate >= m AS hits_ok, fa_rate <= x AS fas_ok, hit_rate >= m AND fa_rate <= x AS valid FROM (SELECT *, CASE WHEN subject % 2 = 0 THEN 0.38 ELSE 0.42 END AS m, CASE WHEN subject % 2 = 0 THEN 0.42 ELSE 0.4 END AS x FROM ({_QUALITY}))")
def b7(s: SparkSession, d: str) -> DataFrame:
    bounds = s.createDataFrame([(0, 0.38, 0.42), (1, 0.42, 0.4)], "modality int, min_hits double, max_fas double")
    q = ops.subject_quality(labelled(s, d)).withColumn("modality", (F.col("subject") % 2).cast("int"))
    return ops.validity(q, bounds, "modality").select("subject", "hit_rate", "fa_rate", "hits_ok", "fas_ok", "valid")


@query("b8_valid_or_kept_modality", f"SELECT subject FROM ({_QUALITY}) WHERE (hit_rate >= 0.4 AND fa_rate <= 0.4) OR subject % 5 = 0")
def b8(s: SparkSession, d: str) -> DataFrame:
    q = ops.subject_quality(labelled(s, d))
    return q.where("(hit_rate >= 0.4 and fa_rate <= 0.4) or subject % 5 = 0").select("subject")


_CODE = "CAST(1000 * (1 + k % 4) + 100 * (1 + k % 3) + k % 20 + 1 AS INT)"


@query("b1_parse_code", f"SELECT id, CASE substr(c, 1, 1) WHEN '1' THEN 'face' WHEN '2' THEN 'object' WHEN '3' THEN 'letter' ELSE 'falseFont' END AS stim_type, CASE substr(c, 2, 1) WHEN '1' THEN 'center' WHEN '2' THEN 'left' ELSE 'right' END AS orientation, substr(c, 3, 2) AS stim_id FROM (SELECT id, CAST({_CODE} AS VARCHAR) AS c FROM {{ev}})")
def b1(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", *ops.parse_code(F.expr(_CODE)))


@query("b2_task_relevance", "SELECT id, CASE WHEN k % 4 = 3 THEN kind = 'error' ELSE (k % 4 = 0 AND kind IN ('click', 'view')) OR (k % 4 = 1 AND kind = 'purchase') OR (k % 4 = 2 AND kind = 'signup') END AS relevant FROM {ev}")
def b2(s: SparkSession, d: str) -> DataFrame:
    blocks = {"click": "face & x", "view": "Faces", "purchase": "object", "signup": "letter", "error": "false font"}
    kinds = F.element_at(F.array(*map(F.lit, ops.TYPES.values())), (F.col("k") % 4 + 1).cast("int"))
    return events(s, d).select("id", ops.task_relevance(kinds, ops.lookup(blocks, F.col("kind"))).alias("relevant"))


@query("b3_round_duration", "SELECT id, round(value, 1) AS planned FROM {ev}")
def b3(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", F.round("value", 1).alias("planned"))


@query("b4_block_repair", "SELECT id, CASE WHEN kind = 'error' THEN k + 7 WHEN kind = 'view' THEN k + 28 ELSE k END AS block FROM {ev}")
def b4(s: SparkSession, d: str) -> DataFrame:
    fix = s.createDataFrame([("error", 7), ("view", 28)], "kind string, plus int")
    return events(s, d).join(F.broadcast(fix), "kind", "left").select("id", (F.col("k") + F.coalesce("plus", F.lit(0))).alias("block"))


@query("b5_response_label", f"SELECT id, {_LABEL} AS label FROM {{ev}}")
def b5(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).select("id", "label")


@query("b6_reaction_time", "SELECT id, r(t - before) AS rt FROM (SELECT id, kind, t, max(t) FILTER (WHERE kind = 'view') OVER (PARTITION BY subject ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {ev}) WHERE kind = 'click'", digits=3)
def b6(s: SparkSession, d: str) -> DataFrame:
    rows = intervals.last_value(events(s, d), ["subject"], ["t", "id"], F.when(F.col("kind") == "view", F.col("t")), "onset", own=False)
    return rows.where("kind = 'click'").select("id", (F.col("t") - F.col("onset")).alias("rt"))


@query("b9_exceptional_rt", "SELECT id, value / 100 AS rt FROM {ev} WHERE value / 100 < 0.25 OR value / 100 > 2.5")
def b9(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).where("rt < 0.25 or rt > 2.5").select("id", "rt")


@query("b19_block_of_miniblock", "SELECT id, CAST(floor((k - 1) / 4) + 1 AS BIGINT) AS block FROM {ev}")
def b19(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", (F.floor((F.col("k") - 1) / 4) + 1).alias("block"))


@query("b20_trigger_codes", "SELECT id, CASE WHEN k < 20 THEN 'face' WHEN k < 60 THEN 'object' WHEN k < 90 THEN 'response' END AS meaning FROM {ev}")
def b20(s: SparkSession, d: str) -> DataFrame:
    ranges = s.createDataFrame([(0, 19, "face"), (20, 59, "object"), (60, 89, "response")], "low int, high int, meaning string")
    return events(s, d).join(F.broadcast(ranges), F.col("k").between(F.col("low"), F.col("high")), "left").select("id", "meaning")


@query("b21_visibility", "SELECT id, kind IN ('click', 'error') AS probed, CASE WHEN k % 3 = 0 AND kind = 'click' THEN 'seen' WHEN k % 3 = 0 THEN 'unseen' WHEN kind = 'error' THEN 'falseSeen' ELSE 'none' END AS visibility FROM {ev}")
def b21(s: SparkSession, d: str) -> DataFrame:
    seen = F.when((F.col("k") % 3 == 0) & (F.col("kind") == "click"), "seen").when(F.col("k") % 3 == 0, "unseen").when(F.col("kind") == "error", "falseSeen").otherwise("none")
    return events(s, d).select("id", F.col("kind").isin("click", "error").alias("probed"), seen.alias("visibility"))


@query("b22_subjects_with_data", "SELECT id FROM {ev} WHERE subject IN (SELECT subject FROM {ev} WHERE kind = 'purchase' AND value > 50) AND subject NOT IN (SELECT subject FROM {ev} WHERE kind = 'error' AND value > 300)")
def b22(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    good, bad = e.where("kind = 'purchase' and value > 50").select("subject"), e.where("kind = 'error' and value > 300").select("subject")
    return e.join(good, "subject", "left_semi").join(bad, "subject", "left_anti").select("id")


@query("b24_bayes_factor_from_bic", "SELECT id, r(exp((value / 100 - k / 50.0) / 2)) AS bf10 FROM {ev}")
def b24(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", F.exp((F.col("value") / 100 - F.col("k") / 50) / 2).alias("bf10"))


@query("b25_p_and_z", f"SELECT id, r({norm_ppf_sql('p')}) AS z, r({norm_cdf_sql('y')}) AS p FROM (SELECT id, (k + 0.5) / 101 AS p, value / 100 - 1 AS y FROM {{ev}})")
def b25(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select("id", ((F.col("k") + 0.5) / 101).alias("p"), (F.col("value") / 100 - 1).alias("y"))
    return e.select("id", norm_ppf("p").alias("z"), norm_cdf("y").alias("p"))


@query("b31_lab_of_subject", "SELECT DISTINCT subject, CASE substr(CAST(subject AS VARCHAR), 1, 1) WHEN '1' THEN 'SA' WHEN '2' THEN 'SB' ELSE 'SC' END AS lab FROM {ev}")
def b31(s: SparkSession, d: str) -> DataFrame:
    lab = F.coalesce(ops.lookup({"1": "SA", "2": "SB"}, F.col("subject").cast("string").substr(1, 1)), F.lit("SC"))
    return events(s, d).select("subject", lab.alias("lab")).distinct()


@query("b35_stimulus_name", "SELECT id, CASE k % 4 WHEN 0 THEN 'face' WHEN 1 THEN 'object' WHEN 2 THEN 'letter' ELSE 'falseFont' END || '_' || lpad(CAST(k AS VARCHAR), 2, '0') AS name FROM {ev}")
def b35(s: SparkSession, d: str) -> DataFrame:
    kind = ops.lookup(dict(zip("0123", ops.TYPES.values())), (F.col("k") % 4).cast("string"))
    return events(s, d).select("id", F.concat_ws("_", kind, F.lpad(F.col("k").cast("string"), 2, "0")).alias("name"))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("c1_trial_rows", "SELECT subject, k, " + ", ".join(f"r(min(t) FILTER (WHERE kind = '{x}')) AS \"{x}\"" for x in _KINDS) + " FROM {ev} GROUP BY subject, k", digits=3)
def c1(s: SparkSession, d: str) -> DataFrame:
    return ops.trial_rows(events(s, d), ["subject", "k"], _KINDS)


_AB = "SELECT subject, k, max(value) AS value, min(kind) AS kind FROM {ev} WHERE %s GROUP BY subject, k"


@query("c2_compare_tables", f"SELECT subject, k, coalesce(a.value, b.value) AS value, a.value IS NOT DISTINCT FROM b.value AS value_same, coalesce(a.kind, b.kind) AS kind, a.kind IS NOT DISTINCT FROM b.kind AS kind_same FROM ({_AB % 'value < 150'}) a FULL OUTER JOIN ({_AB % 'value > 20'}) b USING (subject, k)")
def c2(s: SparkSession, d: str) -> DataFrame:
    one = lambda where: events(s, d).where(where).groupBy("subject", "k").agg(F.max("value").alias("value"), F.min("kind").alias("kind"))
    return ops.compare_tables(one("value < 150"), one("value > 20"), ["subject", "k"], ["value", "kind"])


@query("c3_missing_triggers", "SELECT DISTINCT subject, k FROM {ev} WHERE kind = 'view' AND (subject, k) NOT IN (SELECT subject, k FROM {ev} WHERE kind = 'click')")
def c3(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return ops.missing_triggers(e.where("kind = 'view'"), e.where("kind = 'click'"), ["subject", "k"])


@query("c4_copy_trial_times", "SELECT a.id, r(b.t) AS onset FROM {ev} a LEFT JOIN (SELECT subject, k, min(t) AS t FROM {ev} WHERE kind = 'view' GROUP BY 1, 2) b USING (subject, k)", digits=3)
def c4(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    onset = e.where("kind = 'view'").groupBy("subject", "k").agg(F.min("t").alias("onset"))
    return e.join(onset, ["subject", "k"], "left").select("id", "onset")


@query("c13_duration_to_next", "SELECT id, r(nxt - t) AS duration FROM (SELECT id, t, min(CASE WHEN kind IN ('view', 'signup') THEN t END) OVER (PARTITION BY subject ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {ev})", digits=3)
def c13(s: SparkSession, d: str) -> DataFrame:
    rows = intervals.next_value(events(s, d), ["subject"], ["t", "id"], F.when(F.col("kind").isin("view", "signup"), F.col("t")), "nxt")
    return rows.select("id", (F.col("nxt") - F.col("t")).alias("duration"))


@query("c14_response_by_event", "SELECT subject, k, CASE WHEN k % 2 = 0 AND click > 0 THEN 'hit' WHEN k % 2 = 0 THEN 'miss' WHEN click > 0 THEN 'falseAlarm' ELSE 'correctRejection' END AS response FROM (SELECT subject, k, count(*) FILTER (WHERE kind = 'click') AS click FROM {ev} GROUP BY 1, 2)")
def c14(s: SparkSession, d: str) -> DataFrame:
    return ops.response_by_event(events(s, d), ["subject", "k"], F.col("k") % 2 == 0, F.col("kind") == "click")


@query("c15_align_triggers", "SELECT subject, n, r(a.gap - b.gap) AS gap_difference FROM (SELECT subject, row_number() OVER w AS n, t - lag(t) OVER w AS gap FROM {ev} WHERE kind = 'view' WINDOW w AS (PARTITION BY subject ORDER BY t, id)) a FULL OUTER JOIN (SELECT subject, row_number() OVER w AS n, t - lag(t) OVER w AS gap FROM {ev} WHERE kind = 'click' WINDOW w AS (PARTITION BY subject ORDER BY t, id)) b USING (subject, n)", digits=3)
def c15(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return ops.align_in_order(e.where("kind = 'view'"), e.where("kind = 'click'"), ["subject"], ["t", "id"], "t").select("subject", "n", "gap_difference")


@query("c16_reinsert_responses", "SELECT id, r(coalesce(trig, t)) AS at FROM (SELECT id, kind, t, lag(t) OVER (PARTITION BY subject ORDER BY t, id) + (t - lag(t) OVER (PARTITION BY subject ORDER BY t, id)) AS trig FROM {ev}) WHERE kind = 'purchase'", digits=3)
def c16(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("t", "id")
    rows = events(s, d).withColumn("before", F.lag("t").over(w)).withColumn("delay", F.col("t") - F.col("before"))
    return rows.where("kind = 'purchase'").select("id", F.coalesce(F.col("before") + F.col("delay"), "t").alias("at"))


@query("c29_replay_rows", "SELECT id, kind, k, coalesce(evaluation, 'TrueNegative') AS evaluation FROM (SELECT id, kind, k, CASE WHEN k % 3 = 0 THEN 'TruePositive' END AS evaluation FROM {ev} WHERE kind <> 'signup' UNION ALL SELECT -id - 1, 'filler', NULL, NULL FROM {ev} WHERE kind = 'signup')")
def c29(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    replay = e.where("kind <> 'signup'").select("id", "kind", "k", F.when(F.col("k") % 3 == 0, "TruePositive").alias("evaluation"))
    filler = e.where("kind = 'signup'").select((-F.col("id") - 1).alias("id"), F.lit("filler").alias("kind"))
    return replay.unionByName(filler, allowMissingColumns=True).fillna("TrueNegative", ["evaluation"])


_DP = f"""SELECT subject, kind, hits, targets, fas, lures, r({norm_ppf_sql('h')} - {norm_ppf_sql('f')}) AS d_prime FROM (
 SELECT *, (hits + 0.5) / (targets + 1) AS h, (fas + 0.5) / (lures + 1) AS f FROM (
 SELECT subject, kind, coalesce(hits, 0) AS hits, coalesce(targets, 0) AS targets, coalesce(fas, 0) AS fas, coalesce(lures, 0) AS lures FROM (SELECT DISTINCT subject FROM {{ev}}) CROSS JOIN (SELECT DISTINCT kind FROM {{ev}})
 LEFT JOIN (SELECT subject, kind, count(*) FILTER (WHERE k % 2 = 0 AND value > 60) AS hits, count(*) FILTER (WHERE k % 2 = 0) AS targets, count(*) FILTER (WHERE k % 2 = 1 AND value > 60) AS fas, count(*) FILTER (WHERE k % 2 = 1) AS lures FROM {{ev}} GROUP BY 1, 2) USING (subject, kind)))"""


@query("d2_d_prime", _DP)
def d2(s: SparkSession, d: str) -> DataFrame:
    return ops.d_prime(events(s, d), ["subject", "kind"], F.col("k") % 2 == 0, F.col("value") > 60)


@query("d3_false_alarm_trials", f"SELECT id, subject, kind, value / 100 AS rt FROM (SELECT *, {_LABEL} AS label FROM {{ev}}) WHERE label = 'FalsePositive'")
def d3(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).where("label = 'FalsePositive'").select("id", "subject", "kind", "rt")


_SETS = "((flag), (status), (priority), (flag, status), (flag, priority), (status, priority), (flag, status, priority))"


@query("d4_stats_by_combination", f"SELECT flag, status, priority, r(avg(value)) AS mean, r(stddev_samp(value)) AS sd, count(value) AS n, CAST(grouping_id(flag, status, priority) AS BIGINT) AS level FROM {{tr}} GROUP BY GROUPING SETS {_SETS}")
def d4(s: SparkSession, d: str) -> DataFrame:
    return ops.stats_by_combination(trials(s, d), "value", ["flag", "status", "priority"])


@query("d5_stats_by_combination_per_subject", "SELECT subject, flag, status, r(avg(value)) AS mean, r(stddev_samp(value)) AS sd, count(value) AS n, CAST(grouping_id(subject, flag, status) AS BIGINT) AS level FROM {tr} GROUP BY GROUPING SETS ((subject, flag), (subject, status), (subject, flag, status))")
def d5(s: SparkSession, d: str) -> DataFrame:
    return ops.stats_by_combination(trials(s, d), "value", ["flag", "status"], ["subject"])


@query("d6_hit_rt_summary", f"SELECT kind, count(*) AS n, r(avg(value / 100)) AS mean FROM (SELECT *, {_LABEL} AS label FROM {{ev}}) WHERE label = 'TruePositive' GROUP BY kind")
def d6(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).where("label = 'TruePositive'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("rt").alias("mean"))


_CI = "SELECT * FROM (SELECT flag, status, value - avg(value) OVER (PARTITION BY subject) + avg(value) OVER () AS y FROM {tr})"


@query("d15_within_subject_ci", f"SELECT flag, status, r(avg(y)) AS mean, r(1.96 * stddev_samp(y) / sqrt(count(*))) AS ci, r(stddev_samp(y) / sqrt(count(*)) * sqrt((SELECT count(*) FROM (SELECT DISTINCT flag, status FROM {{tr}})) / ((SELECT count(*) FROM (SELECT DISTINCT flag, status FROM {{tr}})) - 1))) AS morey, count(*) AS n FROM ({_CI}) GROUP BY flag, status")
def d15(s: SparkSession, d: str) -> DataFrame:
    return ops.within_subject_ci(trials(s, d), "subject", ["flag", "status"], "value")


@query("d16_between_subject_se", "SELECT flag, r(avg(m)) AS mean, r(stddev_samp(m) / sqrt(count(m))) AS se, count(m) AS subjects FROM (SELECT subject, flag, avg(value) AS m FROM {tr} GROUP BY 1, 2) GROUP BY flag")
def d16(s: SparkSession, d: str) -> DataFrame:
    return ops.two_level_means(trials(s, d), "subject", ["flag"], F.col("value"))


@query("d47_false_alarm_counts", f"SELECT subject, kind, count(*) AS n, count(*) FILTER (WHERE label = 'FalsePositive') AS fas FROM (SELECT *, {_LABEL} AS label FROM {{ev}}) GROUP BY 1, 2")
def d47(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).groupBy("subject", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "FalsePositive").alias("fas"))


@query("d49_event_counts", "SELECT subject, " + ", ".join(f"count(*) FILTER (WHERE kind = '{x}') AS {x}" for x in _KINDS) + " FROM {ev} GROUP BY subject")
def d49(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy("subject").pivot("kind", list(_KINDS)).count().fillna(0)


@query("e3_keep_last", "SELECT l_orderkey AS trial, l_linenumber AS line, max(l_extendedprice) AS value, count(*) > 1 AS repeated FROM lineitem GROUP BY 1, 2")
def e3(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("value"))
    li = li.withColumn("repeated", F.count(F.lit(1)).over(Window.partitionBy("trial", "line")) > 1)
    return ops.keep_last(li, ["trial", "line"], [F.desc("value")])


@query("e4_forward_fill", "SELECT id, last_value(CASE WHEN kind = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS target FROM {ev}")
def e4(s: SparkSession, d: str) -> DataFrame:
    return intervals.last_value(events(s, d), ["subject"], ["t", "id"], F.when(F.col("kind") == "signup", F.col("value")), "target").select("id", "target")


@query("e5_trials_of_stream", "SELECT subject, trial, r(min(CASE WHEN kind = 'view' THEN t END)) AS onset, r(min(CASE WHEN kind = 'click' THEN t END)) AS response, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS trial FROM {ev}) WHERE trial > 0 GROUP BY 1, 2", digits=3)
def e5(s: SparkSession, d: str) -> DataFrame:
    rows = ops.trials_of_stream(events(s, d), F.col("kind") == "view").where("trial > 0")
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("t")))
    return rows.groupBy("subject", "trial").agg(at("view").alias("onset"), at("click").alias("response"), F.count(F.lit(1)).alias("n"))


@query("e6_event_durations", "SELECT id, r(CASE WHEN d > 7200 THEN 3600 ELSE d END) AS duration, coalesce(stim, 'none') || '/' || kind AS name FROM (SELECT id, kind, lead(t) OVER w - t AS d, last_value(CASE WHEN kind = 'view' THEN 'v' || k END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stim FROM {ev} WINDOW w AS (PARTITION BY subject ORDER BY t, id))", digits=3)
def e6(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("t", "id")
    rows = intervals.last_value(events(s, d), ["subject"], ["t", "id"], F.when(F.col("kind") == "view", F.concat(F.lit("v"), "k")), "stim")
    gap = F.lead("t").over(w) - F.col("t")
    return rows.select("id", F.when(gap > 7200, 3600).otherwise(gap).alias("duration"), F.concat_ws("/", F.coalesce("stim", F.lit("none")), "kind").alias("name"))


@query("e7_duration_errors", "SELECT kind, count(*) AS n, r(avg(CASE WHEN abs(d - value * 60) > 3600 THEN 1 ELSE 0 END)) AS share FROM (SELECT kind, value, lead(t) OVER (PARTITION BY subject ORDER BY t, id) - t AS d FROM {ev}) WHERE d IS NOT NULL GROUP BY kind")
def e7(s: SparkSession, d: str) -> DataFrame:
    return ops.duration_errors(events(s, d), ["subject"], ["t", "id"], "t", F.col("value") * 60, 3600, ["kind"])


@query("e21_time_in_trial", "SELECT id, r(t - onset) AS since FROM (SELECT e.id, e.t, o.onset FROM {ev} e JOIN (SELECT subject, k, min(t) AS onset FROM {ev} WHERE kind = 'view' GROUP BY 1, 2) o USING (subject, k)) WHERE t >= onset AND t - onset <= 86400 * 7", digits=3)
def e21(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    onsets = e.where("kind = 'view'").select("subject", "k", F.col("t").alias("onset"))
    return ops.time_in_trial(e, onsets, ["subject", "k"], "t", "onset", 86400 * 7).select("id", "since")


@query("e29_trigger_bursts", "SELECT id, size, CASE size WHEN 4 THEN 'block start' WHEN 3 THEN 'experiment' WHEN 2 THEN 'block end' ELSE 'single' END AS class FROM (SELECT id, count(*) OVER (PARTITION BY subject, burst) AS size FROM (SELECT id, subject, sum(n) OVER (PARTITION BY subject ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY subject ORDER BY t, id) <= 5000 THEN 0 ELSE 1 END AS n FROM {ev})))")
def e29(s: SparkSession, d: str) -> DataFrame:
    return ops.trigger_bursts(events(s, d), ["subject"], ["t", "id"], "t", 5000, {4: "block start", 3: "experiment", 2: "block end"}).select("id", "size", "class")


@query("f9_custom_order", "SELECT id, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS place, row_number() OVER (PARTITION BY subject ORDER BY CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END, t, id) AS n FROM {ev}")
def f9(s: SparkSession, d: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ("view", "click", "purchase"))), F.col("kind")).cast("int")
    return events(s, d).select("id", place.alias("place"), F.row_number().over(Window.partitionBy("subject").orderBy(place, "t", "id")).cast("long").alias("n"))


@query("g1_append_results", "SELECT 'click' AS block, subject, count(*) AS n FROM {ev} WHERE kind = 'click' GROUP BY subject UNION ALL SELECT 'view', subject, count(*) FROM {ev} WHERE kind = 'view' GROUP BY subject")
def g1(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("kind in ('click', 'view')").groupBy(F.col("kind").alias("block"), "subject").agg(F.count(F.lit(1)).alias("n"))


@query("a9_last_restart", "SELECT id FROM (SELECT id, t, max(CASE WHEN kind = 'signup' THEN t END) OVER (PARTITION BY subject) AS start FROM {ev}) WHERE start IS NULL OR t >= start")
def a9(s: SparkSession, d: str) -> DataFrame:
    return ops.last_restart(events(s, d), "subject", F.col("kind") == "signup", "t").select("id")


@query("a3_missing_runs", "SELECT subject, run FROM (SELECT DISTINCT subject FROM {ev}) CROSS JOIN (SELECT unnest(range(0, 100, 10)) AS run) WHERE (subject, run) NOT IN (SELECT subject, k FROM {ev})")
def a3(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    expected = e.select("subject").distinct().crossJoin(F.broadcast(s.range(0, 100, 10).toDF("run")))
    return expected.join(e.select("subject", F.col("k").cast("long").alias("run")), ["subject", "run"], "left_anti")


@query("a13_end_of_run_event", "SELECT subject, id, kind, r(t) AS onset, 0.0 AS duration FROM {ev} UNION ALL SELECT subject, NULL, 'endOfRun', r(max(t)), 30.0 FROM {ev} GROUP BY subject", digits=3)
def a13(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select("subject", "id", "kind", F.col("t").alias("onset"), F.lit(0.0).alias("duration"))
    end = e.groupBy("subject").agg(F.max("onset").alias("onset")).select("subject", F.lit(None).cast("long").alias("id"), F.lit("endOfRun").alias("kind"), "onset", F.lit(30.0).alias("duration"))
    return e.unionByName(end)


@query("a11_a12_regressor_rows", "SELECT CASE WHEN k < 50 THEN 'relevant' ELSE 'irrelevant' END || '_' || kind AS event_type, r(t) AS onset, value AS duration, 1 AS weight FROM {ev}", digits=3)
def a12(s: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("_", F.when(F.col("k") < 50, "relevant").otherwise("irrelevant"), "kind")
    return events(s, d).select(key.alias("event_type"), F.col("t").alias("onset"), F.col("value").alias("duration"), F.lit(1).alias("weight"))


@query("a16_confounds", "SELECT subject, id, value FROM (SELECT subject, id, value, row_number() OVER (PARTITION BY subject ORDER BY t, id) AS n FROM {ev}) WHERE n > 3")
def a16(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("subject").orderBy("t", "id"))
    return events(s, d).withColumn("n", n).where("n > 3").select("subject", "id", "value")
