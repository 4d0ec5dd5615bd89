"""Queries on result tables and composed analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks, signals, stats
from .maps import channels
from .similarity import _CEN, _LONG, _RES, results
from .standins import events, features, query, signal, table, trials


@query("b10_theory_predictors", "SELECT subject, trial, line, CASE WHEN flag = 'A' AND status = 'F' THEN 1 WHEN flag = 'N' AND status = 'O' THEN 2 WHEN flag = 'R' THEN 3 END AS predictor, count(*) AS n FROM {tr} GROUP BY ALL")
def b10(s: SparkSession, d: str) -> DataFrame:
    mapping = s.createDataFrame([(["A", "F"], 1), (["N", "O"], 2), (["R"], 3)], "wanted array<string>, predictor int")
    rows = trials(s, d).withColumn("have", F.array("flag", "status"))
    rows = rows.join(F.broadcast(mapping), F.forall("wanted", lambda k: F.array_contains("have", k)), "left")
    return rows.groupBy("subject", "trial", "line", "predictor").agg(F.count(F.lit(1)).alias("n"))


_RDM = "(SELECT a.channel, a.t AS x, b.t AS y, avg(abs(a.value - b.value)) AS v FROM {sg} a JOIN {sg} b ON a.channel = b.channel AND a.epoch = b.epoch GROUP BY ALL)"


def matrices(s: SparkSession, d: str) -> DataFrame:
    return signals.difference_matrices(signal(s, d), ["channel"], "epoch", "t", "value")


@query("b30_sub_sampled_matrix", f"SELECT channel, dense_rank() OVER (PARTITION BY channel ORDER BY x) AS x, dense_rank() OVER (PARTITION BY channel ORDER BY y) AS y, r(v) AS v FROM {_RDM} WHERE (x BETWEEN 2 AND 5 OR x BETWEEN 9 AND 12) AND (y BETWEEN 2 AND 5 OR y BETWEEN 9 AND 12)")
def b30(s: SparkSession, d: str) -> DataFrame:
    """Times outside the spans have no cell in the sub-matrix: they are left out before it is formed."""
    spans = s.createDataFrame([(2, 5), (9, 12)], "lo int, hi int")
    kept = signal(s, d).join(F.broadcast(spans), F.col("t").between(F.col("lo"), F.col("hi")), "left_semi")
    m = signals.difference_matrices(kept, ["channel"], "epoch", "t", "value")
    rank = lambda c: F.dense_rank().over(Window.partitionBy("channel").orderBy(c)).cast("long")
    return m.select("channel", rank("x").alias("x"), rank("y").alias("y"), "v")


@query("c23_models_with_anova", f"SELECT cond, count(*) AS n, r(min(effect)) AS least, r(max(sd)) AS most FROM (SELECT * FROM {_RES} WHERE reject) JOIN (SELECT channel FROM {_RES} GROUP BY 1 HAVING max(effect) > 3) USING (channel) GROUP BY 1")
def c23(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d)
    strong = r.groupBy("channel").agg(F.max("effect").alias("top")).where("top > 3").select("channel")
    return r.where("reject").join(strong, "channel").groupBy("cond").agg(F.count(F.lit(1)).alias("n"), F.min("effect").alias("least"), F.max("sd").alias("most"))


@query("d34_validated_summary", f"SELECT channel, max(CASE WHEN cond = 0 AND reject THEN 1 ELSE 0 END) AS first, max(CASE WHEN cond = 1 AND reject THEN 1 ELSE 0 END) AS second, max(CASE WHEN cond = 0 AND reject THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN cond = 1 AND reject THEN 1 ELSE 0 END) = 1 AS validated FROM {_RES} GROUP BY 1")
def d34(s: SparkSession, d: str) -> DataFrame:
    on = lambda k: F.max(F.when((F.col("cond") == k) & F.col("reject"), 1).otherwise(0))
    return results(s, d).groupBy("channel").agg(on(0).alias("first"), on(1).alias("second")).withColumn("validated", (F.col("first") == 1) & (F.col("second") == 1))


@query("d36_run_sanity_codes", "SELECT subject, array_to_string(list_filter([CASE WHEN n < 60 THEN 'few' END, CASE WHEN clicks = 0 THEN 'no_response' END, CASE WHEN top > 400 THEN 'range' END], lambda v: v IS NOT NULL), ',') AS codes FROM (SELECT subject, count(*) AS n, count(*) FILTER (WHERE kind = 'click') AS clicks, max(value) AS top FROM {ev} GROUP BY 1)")
def d36(s: SparkSession, d: str) -> DataFrame:
    g = events(s, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "click").alias("clicks"), F.max("value").alias("top"))
    codes = F.array_compact(F.array(F.when(F.col("n") < 60, "few"), F.when(F.col("clicks") == 0, "no_response"), F.when(F.col("top") > 400, "range")))
    return g.select("subject", F.array_join(codes, ",").alias("codes"))


@query("d46_roi_decoding_table", f"SELECT roi, r(avg(accuracy)) AS accuracy, r(avg(accuracy - 0.1) / nullif(stddev_samp(accuracy - 0.1) / sqrt(count(*)), 0)) AS t FROM (SELECT label % 2 AS roi, run, avg(CASE WHEN guess = label THEN 1.0 ELSE 0 END) AS accuracy FROM (SELECT id, label, run, guess, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), guess) AS i FROM (SELECT l.id, l.label, l.run, guess, sum((v - c) ** 2) AS d FROM {_LONG} l JOIN {_CEN} c ON c.run = l.run AND c.f = l.f GROUP BY ALL)) WHERE i = 1 GROUP BY 1, 2) GROUP BY 1")
def d46(s: SparkSession, d: str) -> DataFrame:
    from ..operators.similarity import centroid_guesses

    per = centroid_guesses(features(s, d), "run").groupBy((F.col("label") % 2).alias("roi"), "run").agg(F.avg((F.col("guess") == F.col("label")).cast("int")).alias("accuracy"))
    t = stats.one_sample_t(per.withColumn("x", F.col("accuracy") - 0.1), ["roi"], F.col("x"))
    return t.select("roi", (F.col("mean") + 0.1).alias("accuracy"), "t")


_CHN = "(SELECT s_suppkey AS channel, n_name, r_name, s_acctbal AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("d51_counts_per_atlas_label", f"SELECT atlas, label, count(*) AS channels, count(*) FILTER (WHERE x > 0) AS activated, r(avg(x)) AS mean, r(stddev_pop(x)) AS sd FROM (SELECT 'fine' AS atlas, n_name AS label, x FROM {_CHN} UNION ALL SELECT 'coarse', r_name, x FROM {_CHN}) GROUP BY 1, 2")
def d51(s: SparkSession, d: str) -> DataFrame:
    c = channels(s, d).select("x", F.col("labels")[0].alias("fine"), F.col("labels")[1].alias("coarse")).unpivot("x", ["fine", "coarse"], "atlas", "label")
    return c.groupBy("atlas", "label").agg(F.count(F.lit(1)).alias("channels"), F.count_if(F.col("x") > 0).alias("activated"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


@query("d54_seed_connectivity", f"SELECT x AS seed, r(avg(v)) AS mean FROM {_RDM} WHERE x <> y AND x IN (SELECT t FROM {{sg}} GROUP BY t HAVING avg(value) > 50) GROUP BY 1")
def d54(s: SparkSession, d: str) -> DataFrame:
    seeds = signal(s, d).groupBy("t").agg(F.avg("value").alias("m")).where("m > 50").select(F.col("t").alias("x"))
    return matrices(s, d).where("x <> y").join(F.broadcast(seeds), "x").groupBy(F.col("x").alias("seed")).agg(F.avg("v").alias("mean"))


@query("d55_z_against_repeats", f"SELECT x, y, r(CASE WHEN sd > 1e-9 THEN (o - m) / sd END) AS z FROM (SELECT x, y, max(v) FILTER (WHERE channel = 0) AS o, avg(v) FILTER (WHERE channel > 0) AS m, stddev_pop(v) FILTER (WHERE channel > 0) AS sd FROM {_RDM} GROUP BY 1, 2)")
def d55(s: SparkSession, d: str) -> DataFrame:
    """Null where the repeats have no spread beyond rounding, as on the diagonal."""
    null = F.when(F.col("channel") > 0, F.col("v"))
    g = matrices(s, d).groupBy("x", "y").agg(F.max(F.when(F.col("channel") == 0, F.col("v"))).alias("o"), F.avg(null).alias("m"), F.stddev_pop(null).alias("sd"))
    return g.select("x", "y", F.when(F.col("sd") > 1e-9, (F.col("o") - F.col("m")) / F.col("sd")).alias("z"))


@query("u26_selected_trials", "SELECT subject, trial, line, flag || '_' || status AS label, CAST(trial % 8 AS INT) AS run, count(*) AS n FROM {tr} WHERE flag IN ('A', 'R') AND quantity > 40 GROUP BY ALL")
def u26(s: SparkSession, d: str) -> DataFrame:
    rows = trials(s, d).where("flag in ('A', 'R') and quantity > 40")
    return rows.groupBy("subject", "trial", "line", F.concat_ws("_", "flag", "status").alias("label"), (F.col("trial") % 8).cast("int").alias("run")).agg(F.count(F.lit(1)).alias("n"))


@query("u31_random_subsets", "SELECT rep, r(avg(CASE WHEN NOT same THEN distance END) - avg(CASE WHEN same THEN distance END)) AS score FROM (SELECT rep, p.same, p.distance FROM (SELECT a.run, a.id AS a, b.id AS b, a.label = b.label AS same, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM {ft} a JOIN {ft} b ON a.run = b.run AND a.id < b.id) p, (SELECT unnest([1, 2, 3]) AS rep) WHERE substr(md5(concat_ws(':', rep, a)), 1, 1) < '8' AND substr(md5(concat_ws(':', rep, b)), 1, 1) < '8') GROUP BY 1")
def u31(s: SparkSession, d: str) -> DataFrame:
    """Items are drawn before they are paired: a pair is in a subset when both its items are."""
    items = features(s, d).withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    sums = blocks.label_distances(items.where(F.substring(F.md5(F.concat_ws(":", "rep", "id")), 1, 1) < "8"), ["rep", "run"])
    mean = lambda kind: F.try_divide(F.sum(f"s_{kind}"), F.sum(f"n_{kind}"))
    return sums.where("n_within + n_between > 0").groupBy("rep").agg((mean("between") - mean("within")).alias("score"))


@query("a17_group_table", "SELECT s_nationkey AS nation, count(*) AS n, r(avg(s_acctbal)) AS mean FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, count(*), r(avg(c_acctbal)) FROM customer GROUP BY 1")
def a17(s: SparkSession, d: str) -> DataFrame:
    one = lambda name, p: table(s, d, name).groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.avg(f"{p}_acctbal").alias("mean"))
    return one("supplier", "s").unionByName(one("customer", "c"))
