"""Queries on trials by features: embeddings with labels stand in, runs by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks, classifiers, similarity as ops
from .standins import events, features, query, signal, table

_PAIR = "(SELECT a.run, a.id AS a, b.id AS b, a.label = b.label AS same, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM {ft} a JOIN {ft} b ON a.run = b.run AND a.id < b.id)"


def pairs(s: SparkSession, d: str) -> DataFrame:
    return blocks.pair_table(features(s, d), ["run"])


@query("c25_trial_pairs", f"SELECT run, a, b, same, r(distance) AS distance FROM {_PAIR}")
def c25(s: SparkSession, d: str) -> DataFrame:
    return pairs(s, d)


@query("u21_within_between_score", f"SELECT run, r(avg(distance) FILTER (WHERE same)) AS within, r(avg(distance) FILTER (WHERE NOT same)) AS between, r(avg(distance) FILTER (WHERE NOT same) - avg(distance) FILTER (WHERE same)) AS score FROM {_PAIR} GROUP BY 1")
def u21(s: SparkSession, d: str) -> DataFrame:
    return blocks.similarity_scores(blocks.label_distances(features(s, d), ["run"]), ["run"]).select("run", "within", "between", "score")


@query("u22_split_half_distances", "SELECT run, half, r(avg(distance)) AS distance FROM (SELECT a.run, h AS half, sqrt(list_sum(list_transform(list_zip(a.x[32 * h + 1:32 * h + 32], b.x[32 * h + 1:32 * h + 32]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM {ft} a JOIN {ft} b ON a.run = b.run AND a.id < b.id, (SELECT unnest([0, 1]) AS h)) GROUP BY 1, 2")
def u22(s: SparkSession, d: str) -> DataFrame:
    sums = blocks.label_distances(features(s, d), ["run"], times=2, crossed=False)
    return sums.select("run", F.col("t1").alias("half"), ((F.col("s_within") + F.col("s_between")) / (F.col("n_within") + F.col("n_between"))).alias("distance"))


#: Times that an embedding's components stand for, eight channels each, and balanced draws.
TIMES, DRAWS = 8, 20
_PLACED = "(SELECT *, (row_number() OVER (PARTITION BY run, label ORDER BY md5('0:' || id), id) - 1) % 2 AS half FROM {ft})"
_UNITS = f"(SELECT run, id, label, half, t, list_transform(v, lambda z: (z - list_avg(v)) / sqrt(list_sum(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))))) AS u FROM (SELECT run, id, label, half, t, x[8 * t + 1:8 * t + 8] AS v FROM {_PLACED}, (SELECT unnest(range({TIMES})) AS t)))"
_HALVES = f"pairs AS MATERIALIZED (SELECT a.run, a.id AS a, b.id AS b, a.label = b.label AS same, CAST(a.t AS INT) AS t1, CAST(b.t AS INT) AS t2, 1 - atanh(list_inner_product(a.u, b.u)) AS z FROM units a JOIN units b ON a.run = b.run WHERE a.half = 0 AND b.half = 1)"
_ODDS = "odds AS (SELECT run, least(1, n_out / nullif(n_in, 0)) AS p_in, least(1, n_in / nullif(n_out, 0)) AS p_out FROM (SELECT run, count(*) FILTER (WHERE same) AS n_in, count(*) FILTER (WHERE NOT same) AS n_out FROM pairs WHERE t1 = 0 AND t2 = 0 GROUP BY 1))"
_MIX = "(least(a, b) % 2147483647 * 1103515245 % 2147483647 + greatest(a, b) % 2147483647 * 377001613 % 2147483647 + draw * 668265263 % 2147483647) % 2147483647"
_DRAWN = f"draws AS (SELECT run, t1, t2, draw, avg(z) FILTER (WHERE NOT same AND u < p_out) - avg(z) FILTER (WHERE same AND u < p_in) AS score FROM (SELECT *, (h * h % 2147483647 + h * 48271 % 2147483647) % 2147483647 / 2147483647 AS u FROM (SELECT *, {_MIX} AS h FROM pairs, (SELECT unnest(range(1, {DRAWS + 1})) AS draw))) JOIN odds USING (run) GROUP BY ALL)"


@query("u21_c25_first_against_second_by_time", f"WITH units AS MATERIALIZED {_UNITS}, {_HALVES}, {_ODDS}, {_DRAWN} SELECT run, t1, t2, r(avg(z) FILTER (WHERE same)) AS within, r(avg(z) FILTER (WHERE NOT same)) AS between, r(avg(z) FILTER (WHERE NOT same) - avg(z) FILTER (WHERE same)) AS score, r(any_value(q.score)) AS balanced FROM pairs JOIN (SELECT run, t1, t2, avg(score) AS score FROM draws GROUP BY ALL) q USING (run, t1, t2) GROUP BY 1, 2, 3")
def u21_halves(s: SparkSession, d: str) -> DataFrame:
    items = classifiers.stratified_folds(features(s, d), ["run"], 2)
    sums = blocks.label_distances(items.where("fold = 0"), ["run"], items.where("fold = 1"), metric="correlation", times=TIMES, fisher=True, draws=DRAWS)
    return blocks.similarity_scores(sums, ["run"])


@query("u23_nearest_neighbours", "WITH near AS (SELECT a.id, a.label, a.run, b.id AS near, b.label AS guess, round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS distance FROM {ft} a JOIN {ft} b ON a.run <> b.run), votes AS (SELECT id, label, run, guess, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, near) AS i FROM near) WHERE i <= 5 GROUP BY ALL) SELECT run, r(avg(CASE WHEN guess = label THEN 1.0 ELSE 0 END)) AS accuracy, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, guess) AS i FROM votes) WHERE i = 1 GROUP BY 1")
def u23_neighbours(s: SparkSession, d: str) -> DataFrame:
    return classifiers.accuracy(blocks.nearest_labels(features(s, d), [], "run"), ["run"])


_LONG = "(SELECT id, label, run, unnest(x) AS v, generate_subscripts(x, 1) AS f FROM {ft})"
_CEN = f"(SELECT l.label AS guess, r.run, f, (sum(v) - coalesce(sum(v) FILTER (WHERE l.run = r.run), 0)) / (count(*) - count(*) FILTER (WHERE l.run = r.run)) AS c FROM {_LONG} l CROSS JOIN (SELECT DISTINCT run FROM {{ft}}) r GROUP BY ALL HAVING count(*) > count(*) FILTER (WHERE l.run = r.run))"


@query("u23_centroid_accuracy", f"SELECT run, r(avg(CASE WHEN guess = label THEN 1.0 ELSE 0 END)) AS accuracy, count(*) AS n FROM (SELECT id, label, run, guess, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), guess) AS i FROM (SELECT l.id, l.label, l.run, guess, sum((v - c) ** 2) AS d FROM {_LONG} l JOIN {_CEN} c ON c.run = l.run AND c.f = l.f GROUP BY ALL)) WHERE i = 1 GROUP BY 1")
def u23(s: SparkSession, d: str) -> DataFrame:
    return ops.centroid_accuracy(features(s, d), "run")


@query("d40_pseudo_trials", "SELECT kind, pseudo, r(avg(value)) AS value, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY md5('5:' || id), id) - 1) // 10 AS pseudo FROM {ev}) GROUP BY 1, 2")
def d40(s: SparkSession, d: str) -> DataFrame:
    return ops.pseudo_trials(events(s, d), ["kind"], "id", 10, "value", 5)


@query("d41_label_covariance", f"SELECT label, i, j, r(covar_samp(x, y)) AS cov FROM (SELECT a.label, a.f AS i, b.f AS j, a.v AS x, b.v AS y FROM {_LONG} a JOIN {_LONG} b USING (id) WHERE a.f <= b.f) GROUP BY ALL")
def d41(s: SparkSession, d: str) -> DataFrame:
    one = features(s, d).select("label", "x", F.posexplode("x").alias("i", "p"))
    both = one.select("label", (F.col("i") + 1).cast("long").alias("i"), "p", F.posexplode("x").alias("j", "q")).withColumn("j", (F.col("j") + 1).cast("long"))
    return both.where("i <= j").groupBy("label", "i", "j").agg(F.covar_samp("p", "q").alias("cov"))


@query("d42_reliability_curve", "SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, r(avg(p)) AS predicted, r(avg(quality)) AS observed, count(*) AS n FROM (SELECT quality, least(n_chars / 5000, 1) AS p FROM labels JOIN documents USING (doc_id)) GROUP BY 1")
def d42(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return ops.reliability_curve(rows, F.least(F.col("n_chars") / 5000, F.lit(1.0)), "quality", 10)


#: Channels of a probe; pairs are formed within one, as all pairs of channels would grow with the square of the suppliers.
PROBE = 10
_PH = f"(SELECT channel, channel // {PROBE} AS probe, epoch, t, value * 0.06 AS phase FROM {{sg}})"


@query("d43_phase_consistency", f"SELECT x, y, t, r((c * c + s * s - n) / nullif(n * (n - 1), 0)) AS ppc FROM (SELECT a.channel AS x, b.channel AS y, a.t, sum(cos(a.phase - b.phase)) AS c, sum(sin(a.phase - b.phase)) AS s, count(*) AS n FROM {_PH} a JOIN {_PH} b ON a.probe = b.probe AND a.epoch = b.epoch AND a.t = b.t AND a.channel < b.channel GROUP BY ALL)")
def d43(s: SparkSession, d: str) -> DataFrame:
    p = signal(s, d).select((F.floor(F.col("channel") / PROBE)).alias("probe"), "channel", "epoch", "t", (F.col("value") * 0.06).alias("phase"))
    a, b = p.select("probe", "epoch", "t", F.col("channel").alias("x"), F.col("phase").alias("p")), p.select("probe", "epoch", "t", F.col("channel").alias("y"), F.col("phase").alias("q"))
    return ops.phase_consistency(a.join(b, ["probe", "epoch", "t"]).where("x < y"), ["x", "y", "t"], "epoch", F.col("p") - F.col("q"))


@query("d44_sliding_correlation", "SELECT w, r(avg(c)) AS mean FROM (SELECT a.channel, a.epoch, w, corr(a.value, b.value) AS c, count(*) AS n FROM {sg} a JOIN {sg} b ON a.epoch = b.epoch AND a.t = b.t AND a.channel + 1 = b.channel, (SELECT unnest(range(0, 5)) AS w) WHERE a.t BETWEEN 5 * w + 1 AND 5 * w + 8 GROUP BY 1, 2, 3) WHERE n >= 4 GROUP BY 1")
def d44(s: SparkSession, d: str) -> DataFrame:
    x = signal(s, d)
    both = x.select("channel", "epoch", "t", F.col("value").alias("p")).join(x.select((F.col("channel") - 1).alias("channel"), "epoch", "t", F.col("value").alias("q")), ["channel", "epoch", "t"])
    wins = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda w: (F.col("t") >= 5 * w + 1) & (F.col("t") <= 5 * w + 8))
    c = both.select("channel", "epoch", "p", "q", F.explode(wins).alias("w")).groupBy("channel", "epoch", "w").agg(F.corr("p", "q").alias("c"), F.count(F.lit(1)).alias("n"))
    return c.where("n >= 4").groupBy("w").agg(F.avg("c").alias("mean"))


@query("d45_box_mean", "SELECT channel, r(avg(value)) AS value FROM {sg} WHERE t BETWEEN 8 AND 14 AND epoch BETWEEN 10 AND 40 GROUP BY 1")
def d45(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).where("t between 8 and 14 and epoch between 10 and 40").groupBy("channel").agg(F.avg("value").alias("value"))


_CENTRED = "(SELECT run, id, list_transform(x, lambda z: z - list_avg(x)) AS u FROM {ft})"


@query("b32_fisher_z", f"SELECT run, a, b, r(1 - atanh(least(greatest(p / sqrt(q * s), -1), 1))) AS z FROM (SELECT a.run, a.id AS a, b.id AS b, list_inner_product(a.u, b.u) AS p, list_inner_product(a.u, a.u) AS q, list_inner_product(b.u, b.u) AS s FROM {_CENTRED} a JOIN {_CENTRED} b ON a.run = b.run AND a.id < b.id)")
def b32(s: SparkSession, d: str) -> DataFrame:
    return blocks.pair_table(features(s, d), ["run"], metric="correlation").select("run", "a", "b", blocks.fisher_z(F.col("distance")).alias("z"))


@query("b29_prediction_matrix", "SELECT x, y, CASE WHEN (x BETWEEN 2 AND 8 AND y BETWEEN 2 AND 8) OR (x BETWEEN 12 AND 16 AND y BETWEEN 12 AND 16) THEN 1 ELSE 0 END AS predicted FROM (SELECT DISTINCT t AS x FROM {sg}) CROSS JOIN (SELECT DISTINCT t AS y FROM {sg})")
def b29(s: SparkSession, d: str) -> DataFrame:
    t = signal(s, d).select("t").distinct()
    spans = s.createDataFrame([(2, 8), (12, 16)], "lo int, hi int")
    grid = t.select(F.col("t").alias("x")).crossJoin(F.broadcast(t.select(F.col("t").alias("y"))))
    hit = grid.join(F.broadcast(spans), F.col("x").between(F.col("lo"), F.col("hi")) & F.col("y").between(F.col("lo"), F.col("hi")), "left_semi").withColumn("predicted", F.lit(1))
    return grid.join(hit, ["x", "y"], "left").fillna(0, ["predicted"])


# --- result tables ---

_RES = "(SELECT channel, epoch % 4 AS cond, avg(value) - 50 AS effect, stddev_samp(value) AS sd, avg(value) > 52 AS reject FROM {sg} GROUP BY 1, 2)"


def results(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).groupBy("channel", (F.col("epoch") % 4).alias("cond")).agg((F.avg("value") - 50).alias("effect"), F.stddev_samp("value").alias("sd"), (F.avg("value") > 52).alias("reject"))


@query("d31_significance_summary", f"SELECT cond, count(*) AS channels, count(*) FILTER (WHERE reject) AS significant, r(100.0 * count(*) FILTER (WHERE reject) / count(*)) AS percent FROM {_RES} GROUP BY 1")
def d31(s: SparkSession, d: str) -> DataFrame:
    n = F.count_if("reject")
    return results(s, d).groupBy("cond").agg(F.count(F.lit(1)).alias("channels"), n.alias("significant"), (100 * n / F.count(F.lit(1))).alias("percent"))


@query("d32_selective_in_both_tasks", f"SELECT a.channel, r(a.effect) AS first, r(b.effect) AS second FROM {_RES} a JOIN {_RES} b ON a.channel = b.channel WHERE a.cond = 0 AND b.cond = 1 AND a.effect > 0 AND b.effect > 0")
def d32(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d).where("effect > 0")
    return r.where("cond = 0").select("channel", F.col("effect").alias("first")).join(r.where("cond = 1").select("channel", F.col("effect").alias("second")), "channel")


@query("d33_best_model", f"SELECT channel, cond FROM (SELECT *, rank() OVER (PARTITION BY channel ORDER BY sd) AS i FROM {_RES} WHERE effect > -5) WHERE i = 1")
def d33(s: SparkSession, d: str) -> DataFrame:
    return results(s, d).where("effect > -5").withColumn("i", F.rank().over(Window.partitionBy("channel").orderBy("sd"))).where("i = 1").select("channel", "cond")


@query("d35_quality_flags", "SELECT priority, flag, r(m) AS m, m > avg(m) OVER () + 1.0 * stddev_samp(m) OVER () AS flagged FROM (SELECT priority, flag, avg(value) AS m FROM {tr} GROUP BY 1, 2)")
def d35(s: SparkSession, d: str) -> DataFrame:
    from .standins import trials

    m = trials(s, d).groupBy("priority", "flag").agg(F.avg("value").alias("m"))
    lim = m.agg(F.avg("m").alias("a"), F.stddev_samp("m").alias("b"))
    return m.crossJoin(F.broadcast(lim)).select("priority", "flag", "m", (F.col("m") > F.col("a") + F.col("b")).alias("flagged"))


@query("d52_one_row_per_channel", f"SELECT channel, CASE count(*) FILTER (WHERE reject) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS verdict, r(avg(effect) FILTER (WHERE reject)) AS effect FROM {_RES} GROUP BY 1")
def d52(s: SparkSession, d: str) -> DataFrame:
    n = F.count_if("reject")
    return results(s, d).groupBy("channel").agg(F.when(n == 0, "none").when(n == 1, "one").otherwise("several").alias("verdict"), F.avg(F.when(F.col("reject"), F.col("effect"))).alias("effect"))


@query("d53_group_curves", "SELECT t, r(avg(m)) AS mean, r(1.96 * stddev_samp(m) / sqrt(count(m))) AS ci FROM (SELECT channel, t, avg(value) AS m FROM {sg} GROUP BY 1, 2) GROUP BY 1")
def d53(s: SparkSession, d: str) -> DataFrame:
    m = signal(s, d).groupBy("channel", "t").agg(F.avg("value").alias("m"))
    return m.groupBy("t").agg(F.avg("m").alias("mean"), (1.96 * F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("ci"))


@query("c17_significant_in_all", f"SELECT channel FROM {_RES} WHERE cond = 0 AND effect > 0 INTERSECT SELECT channel FROM {_RES} WHERE cond = 1 AND effect > 0 INTERSECT SELECT channel FROM {_RES} WHERE cond = 2 AND effect > -1")
def c17(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d)
    return r.where("cond = 0 and effect > 0").select("channel").join(r.where("cond = 1 and effect > 0"), "channel", "left_semi").join(r.where("cond = 2 and effect > -1"), "channel", "left_semi")


@query("c24_model_bayes_factors", f"SELECT a.channel, a.cond AS h1, b.cond AS h0, r(exp((b.sd - a.sd) / 2)) AS bf10 FROM {_RES} a JOIN {_RES} b ON a.channel = b.channel AND a.cond <> b.cond")
def c24(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d)
    a, b = r.select("channel", F.col("cond").alias("h1"), F.col("sd").alias("s1")), r.select("channel", F.col("cond").alias("h0"), F.col("sd").alias("s0"))
    return a.join(b, "channel").where("h1 <> h0").select("channel", "h1", "h0", F.exp((F.col("s0") - F.col("s1")) / 2).alias("bf10"))


@query("c27_wide_result_table", "SELECT channel, " + ", ".join(f"r(max(CASE WHEN cond = {k} THEN effect END)) AS effect_{k}" for k in range(4)) + f" FROM {_RES} GROUP BY 1")
def c27(s: SparkSession, d: str) -> DataFrame:
    wide = results(s, d).groupBy("channel").pivot("cond", [0, 1, 2, 3]).agg(F.first("effect"))
    return wide.withColumnsRenamed({str(k): f"effect_{k}" for k in range(4)})


@query("c28_activation_same_sign", f"SELECT channel, CASE WHEN min(sign(effect)) = 1 THEN 'activation' WHEN max(sign(effect)) = -1 THEN 'deactivation' ELSE 'mixed' END AS kind FROM {_RES} GROUP BY 1")
def c28(s: SparkSession, d: str) -> DataFrame:
    sign = F.signum("effect")
    return results(s, d).groupBy("channel").agg(F.when(F.min(sign) == 1, "activation").when(F.max(sign) == -1, "deactivation").otherwise("mixed").alias("kind"))
