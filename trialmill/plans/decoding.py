"""Queries on decoding problems: embeddings with labels stand in for items, runs for folds and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decoding as ops
from ..operators import clusters, isotonic, labels, stats
from .results import matrices
from .standins import features, query, signal, table

#: Perms of the maps, and of decoding.
PERMS, DECODING_PERMS = 50, 200

_LONG = "(SELECT id, label, run, unnest(x) AS v, generate_subscripts(x, 1) AS f FROM {ft})"


def _folds_sql(long: str, key: str) -> str:
    """Accuracy by key and run of nearest centroids with the run left out, over rows (key, id, label, run, f, v)."""
    centres = f"(SELECT l.{key}, l.label AS guess, q.run, l.f, (sum(v) - coalesce(sum(v) FILTER (WHERE l.run = q.run), 0)) / (count(*) - count(*) FILTER (WHERE l.run = q.run)) AS c FROM {long} l JOIN (SELECT DISTINCT {key}, run FROM {long}) q ON l.{key} = q.{key} GROUP BY ALL HAVING count(*) > count(*) FILTER (WHERE l.run = q.run))"
    far = f"(SELECT l.{key}, l.id, l.label, l.run, c.guess, sum((v - c) ** 2) AS d FROM {long} l JOIN {centres} c ON c.{key} = l.{key} AND c.run = l.run AND c.f = l.f GROUP BY ALL)"
    best = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, id ORDER BY round(d, 9), guess) AS i FROM {far}) WHERE i = 1)"
    return f"(SELECT {key}, run, avg(CASE WHEN guess = label THEN 1.0 ELSE 0 END) AS accuracy, count(*) AS n FROM {best} GROUP BY 1, 2)"


def long(s: SparkSession, d: str) -> DataFrame:
    return features(s, d).select("id", "label", "run", F.posexplode("x").alias("f", "v"))


@query("u24_train_test_generalisation", f"SELECT train, test, r(avg(CASE WHEN guess = label THEN 1.0 ELSE 0 END)) AS accuracy, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY train, id ORDER BY round(d, 9), guess) AS i FROM (SELECT c.train, l.run AS test, l.id, l.label, c.guess, sum((v - c) ** 2) AS d FROM {_LONG} l JOIN (SELECT run AS train, label AS guess, f, avg(v) AS c FROM {_LONG} GROUP BY 1, 2, 3) c ON c.f = l.f AND c.train <> l.run GROUP BY ALL)) WHERE i = 1 GROUP BY 1, 2")
def u24(s: SparkSession, d: str) -> DataFrame:
    return ops.generalisation(long(s, d), [], "run")


_SETS = f"(SELECT 'both' AS part, * FROM {_LONG} UNION ALL SELECT CASE WHEN f <= 32 THEN 'first' ELSE 'second' END, * FROM {_LONG})"


@query("u25_combined_features", f"SELECT part, r(avg(gain)) AS gain, r(avg(gain) / nullif(sqrt(var_samp(gain) * (1 / count(gain) + 1 / 7)), 0)) AS t, count(gain) - 1 AS df FROM (SELECT a.part, b.accuracy - a.accuracy AS gain FROM {_folds_sql(_SETS, 'part')} a JOIN {_folds_sql(_SETS, 'part')} b ON a.run = b.run AND b.part = 'both' AND a.part <> 'both') GROUP BY 1")
def u25(s: SparkSession, d: str) -> DataFrame:
    rows = long(s, d)
    each = rows.withColumn("part", F.when(F.col("f") < 32, "first").otherwise("second"))
    folds = ops.cross_validated(rows.withColumn("part", F.lit("both")).unionByName(each), ["part"], "run")
    both = folds.where("part = 'both'").select("run", F.col("accuracy").alias("whole"))
    gain = folds.where("part <> 'both'").join(both, "run").withColumn("gain", F.col("whole") - F.col("accuracy"))
    return stats.corrected_t(gain, ["part"], "gain", 1 / 7).join(gain.groupBy("part").agg(F.avg("gain").alias("gain")), "part")


_ORDER = "lpad(CAST(id AS VARCHAR), 20, '0')"
_SHUFFLED = f"(SELECT a.perm, a.id, b.label FROM (SELECT perm, run, id, row_number() OVER (PARTITION BY perm, run ORDER BY {_ORDER}) AS i FROM {{ft}}, (SELECT unnest(range({DECODING_PERMS + 1})) AS perm)) a JOIN (SELECT perm, run, label, row_number() OVER (PARTITION BY perm, run ORDER BY CASE WHEN perm = 0 THEN {_ORDER} ELSE md5(perm || ':' || id) END) AS i FROM {{ft}}, (SELECT unnest(range({DECODING_PERMS + 1})) AS perm)) b USING (perm, run, i))"
_PERMUTED = f"(SELECT p.perm, l.id, p.label, l.run, l.v, l.f FROM {_LONG} l JOIN {_SHUFFLED} p USING (id))"


@query("u30_permuted_decoding", f"SELECT r(max(accuracy) FILTER (WHERE perm = 0)) AS observed, r(avg(CASE WHEN accuracy >= o - 1e-9 THEN 1.0 ELSE 0 END)) AS p FROM (SELECT *, max(CASE WHEN perm = 0 THEN accuracy END) OVER () AS o FROM (SELECT perm, sum(accuracy * n) / sum(n) AS accuracy FROM {_folds_sql(_PERMUTED, 'perm')} GROUP BY 1))")
def u30(s: SparkSession, d: str) -> DataFrame:
    return clusters.array_p(labels.permuted_centroids(features(s, d), ["run"], "run", DECODING_PERMS), [], "accuracy", 1)


def curves(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).groupBy("channel", (F.col("epoch") % 10).alias("subject"), "t").agg(F.avg("value").alias("value"))


_SUBJECTS = "(SELECT channel, epoch % 10 AS subject, t, avg(value) - 50 AS v FROM {sg} GROUP BY 1, 2, 3)"
_SIGN = "CASE WHEN perm = 0 OR ('0x' || substr(md5(':' || perm || ':' || subject), 1, 1))::INT % 2 = 0 THEN 1 ELSE -1 END"
#: Perms of the group tests, and the t that 5 % of values leave outside on both sides at nine degrees of freedom.
GROUP_PERMS, LIMIT = 1000, clusters.t_quantile(0.975, 9)
_SCORES = f"(SELECT channel, t, perm, coalesce(avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0), 0) AS value FROM (SELECT *, v * {_SIGN} AS x FROM {_SUBJECTS}, (SELECT unnest(range({GROUP_PERMS + 1})) AS perm)) GROUP BY 1, 2, 3)"


def _clusters_sql(scores: str, limit: float) -> str:
    """Stretches of either sign over scores (channel, t, perm, value), with the share of perms whose greatest mass reaches theirs."""
    sides = f"(SELECT *, CASE WHEN value > {limit!r} THEN 1 WHEN value < -{limit!r} THEN -1 ELSE 0 END AS side FROM scores)"
    runs = f"(SELECT *, sum(fresh) OVER (PARTITION BY channel, perm ORDER BY t) AS run FROM (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY channel, perm ORDER BY t) THEN 0 ELSE 1 END AS fresh FROM {sides}))"
    found = f"found AS MATERIALIZED (SELECT channel, perm, run, min(t) AS lo, max(t) AS hi, sum(value) AS mass FROM {runs} WHERE side <> 0 GROUP BY 1, 2, 3)"
    tops = "tops AS (SELECT channel, perm, coalesce(max(abs(mass)), 0) AS top FROM (SELECT DISTINCT channel, perm FROM scores) LEFT JOIN found USING (channel, perm) GROUP BY 1, 2)"
    return f"WITH scores AS MATERIALIZED {scores}, {found}, {tops} SELECT channel, lo, hi, r(mass) AS mass, r(avg(CASE WHEN top >= abs(mass) - 1e-9 THEN 1.0 ELSE 0 END)) AS p FROM (SELECT * FROM found WHERE perm = 0) JOIN (SELECT channel, top FROM tops) USING (channel) GROUP BY channel, lo, hi, mass"


@query("u32_group_cluster_test", _clusters_sql(_SCORES, LIMIT))
def u32(s: SparkSession, d: str) -> DataFrame:
    rows = curves(s, d).withColumn("value", F.col("value") - 50)
    return clusters.one_sample_clusters(rows, ["channel"], ["t"], "subject", "value", GROUP_PERMS, subjects=10).select("channel", "lo", "hi", "mass", "p")


_FIRST = f"(SELECT perm, subject, CASE WHEN perm = 0 THEN subject < 5 ELSE row_number() OVER (PARTITION BY perm ORDER BY md5(perm || ':' || subject), CAST(subject AS VARCHAR)) <= 5 END AS one FROM (SELECT unnest(range({GROUP_PERMS + 1})) AS perm), (SELECT DISTINCT epoch % 10 AS subject FROM {{sg}}))"
_WHOLE = "(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY channel, t) AS n FROM curves) WHERE n = 10)"
_TWO = f"(SELECT channel, t, perm, coalesce((m1 - m2) / nullif(sqrt((v1 * 4 + v2 * 4) / 8 * 0.4), 0), 0) AS value FROM (SELECT channel, t, perm, avg(v) FILTER (WHERE one) AS m1, avg(v) FILTER (WHERE NOT one) AS m2, var_samp(v) FILTER (WHERE one) AS v1, var_samp(v) FILTER (WHERE NOT one) AS v2 FROM {_WHOLE} JOIN sides USING (subject) GROUP BY 1, 2, 3))"


@query("u32_two_group_cluster_test", _clusters_sql(_TWO, clusters.t_quantile(0.975, 8)).replace("WITH scores", f"WITH curves AS MATERIALIZED {_SUBJECTS}, sides AS MATERIALIZED {_FIRST}, scores", 1))
def u32_two(s: SparkSession, d: str) -> DataFrame:
    rows = curves(s, d).withColumns({"value": F.col("value") - 50, "side": F.when(F.col("subject") < 5, "one").otherwise("two")})
    return clusters.two_sample_clusters(rows, ["channel"], ["t"], "subject", "side", "value", GROUP_PERMS, "one").select("channel", "lo", "hi", "mass", "p")


@query("u8_u32_grid_cluster_test")
def u32_grid(s: SparkSession, d: str) -> DataFrame:
    cells = signal(s, d).groupBy("channel", (F.col("epoch") % 10).alias("subject"), (F.floor(F.col("epoch") / 10)).cast("int").alias("row"), "t").agg((F.avg("value") - 50).alias("v"))
    return clusters.one_sample_clusters(cells, ["channel"], ["row", "t"], "subject", "v", GROUP_PERMS, 1.5, tail=1, step_down=0.05)


_CELLS = "(SELECT a.channel, a.t AS x, b.t AS y, avg(abs(a.value - b.value)) AS v FROM {sg} a JOIN {sg} b ON a.channel = b.channel AND a.epoch = b.epoch GROUP BY ALL)"
_THEORIES = "(SELECT * FROM (VALUES ('early', 2, 8), ('late', 9, 12)) AS w(theory, lo, hi))"


def times_by_times(s: SparkSession, d: str) -> DataFrame:
    """(x, y): all pairs of times, without a look at the matrices."""
    t = signal(s, d).select("t").distinct()
    return t.select(F.col("t").alias("x")).crossJoin(F.broadcast(t.select(F.col("t").alias("y"))))


@query("u35_theory_correlation", f"SELECT theory, r(avg(rho)) AS mean, r(stddev_samp(rho)) AS sd, count(rho) AS n, r(avg(rho) / nullif(stddev_samp(rho) / sqrt(count(rho)), 0)) AS t, count(rho) - 1 AS df FROM (SELECT theory, channel, corr(v, CASE WHEN x BETWEEN lo AND hi AND y BETWEEN lo AND hi THEN 1.0 ELSE 0 END) AS rho FROM {_CELLS} CROSS JOIN {_THEORIES} GROUP BY 1, 2) GROUP BY 1")
def u35(s: SparkSession, d: str) -> DataFrame:
    spans = F.explode(F.array(*[F.struct(F.lit(name).alias("theory"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, lo, hi in (("early", 2, 8), ("late", 9, 12))])).alias("w")
    cells = matrices(s, d)
    inside = F.col("x").between(F.col("w.lo"), F.col("w.hi")) & F.col("y").between(F.col("w.lo"), F.col("w.hi"))
    predicted = times_by_times(s, d).select("x", "y", spans).select("w.theory", "x", "y", inside.cast("double").alias("predicted"))
    return ops.theory_correlation(cells, predicted, "channel")


_LAWS = f"(SELECT guess, run, f, s / n AS c, greatest(q / n - (s / n) * (s / n), 0) + 1e-9 AS var FROM (SELECT l.label AS guess, q.run, l.f, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM {_LONG} l JOIN (SELECT DISTINCT run FROM {{ft}}) q ON l.run <> q.run GROUP BY ALL))"
_SHARES = "(SELECT l.label AS guess, q.run, ln(count(*)) AS prior FROM {ft} l JOIN (SELECT DISTINCT run FROM {ft}) q ON l.run <> q.run GROUP BY ALL)"


@query("u23_naive_bayes", f"SELECT run, r(avg(CASE WHEN guess = label THEN 1.0 ELSE 0 END)) AS accuracy, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d - 2 * prior, 6), guess) AS i FROM (SELECT l.id, l.label, l.run, guess, sum(ln(var) + (v - c) ** 2 / var) AS d FROM {_LONG} l JOIN {_LAWS} USING (run, f) GROUP BY ALL) JOIN {_SHARES} USING (run, guess)) WHERE i = 1 GROUP BY 1")
def u23_bayes(s: SparkSession, d: str) -> DataFrame:
    return ops.naive_bayes(long(s, d), [], "run")


ROUNDS = 12
_SCORED = "SELECT CAST(doc_id % 8 AS INT) AS fold, ln(n_chars + 1) AS x, quality AS y, count(*) AS k FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY 1, 2, 3"
_START = "SELECT fold, sum(k) AS n, sum(k * y) AS n1, sum(k * x) / sum(k) AS m, sqrt(greatest(sum(k * x * x) / sum(k) - (sum(k * x) / sum(k)) ** 2, 0)) AS sd, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM rows GROUP BY 1"
_NEWTON = "SELECT fold, n, n1, m, sd, a - (h00 * g1 - h01 * g0) / (h11 * h00 - h01 * h01) AS a, b - (h11 * g0 - h01 * g1) / (h11 * h00 - h01 * h01) AS b FROM (SELECT fold, n, n1, m, sd, a, b, sum(g * u) AS g1, sum(g) AS g0, sum(w * u * u) + 1e-12 AS h11, sum(w * u) AS h01, sum(w) + 1e-12 AS h00 FROM (SELECT *, k * (goal - p) AS g, k * p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(a * u + b)) AS p FROM (SELECT *, coalesce((x - m) / nullif(sd, 0), 0) AS u, CASE WHEN y = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n - n1 + 2) END AS goal FROM rows JOIN fit{k} USING (fold)))) GROUP BY ALL)"
_FITS = f"WITH rows AS ({_SCORED}), fit0 AS ({_START}), " + ", ".join(f"fit{k + 1} AS MATERIALIZED ({_NEWTON.replace('{k}', str(k))})" for k in range(ROUNDS)) + f", fits AS (SELECT fold, n, coalesce(a / nullif(sd, 0), 0) AS a, b - coalesce(a / nullif(sd, 0), 0) * m AS b FROM fit{ROUNDS})"


@query("u27_calibration_by_fold", f"{_FITS} SELECT fold, r(a) AS a, r(b) AS b, CAST(n AS BIGINT) AS n, r(brier) AS brier FROM fits JOIN (SELECT fold, sum(k * (p - y) ** 2) / sum(k) AS brier FROM (SELECT w.fold, w.x, w.y, w.k, avg(1 / (1 + exp(c.a * w.x + c.b))) AS p FROM rows w CROSS JOIN fits c GROUP BY 1, 2, 3, 4) GROUP BY 1) USING (fold)")
def u27(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("doc_id") % 8).cast("int").alias("fold"), F.log(F.col("n_chars") + 1).alias("score"), "quality")
    fits = ops.sigmoid_calibration(rows, "fold", "score", "quality", ROUNDS)
    judged = ops.calibrated(rows.where("score IS NOT NULL AND quality IS NOT NULL"), fits, "score")
    return fits.join(judged.groupBy("fold").agg(F.avg((F.col("probability") - F.col("quality")) ** 2).alias("brier")), "fold")


_POINTS = "points AS MATERIALIZED (SELECT CAST(doc_id % 8 AS INT) AS fold, floor(ln(n_chars + 1) * 10) / 10 AS x, count(*) AS n, sum(quality) AS h FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY 1, 2)"
_SPANS = "spans AS (SELECT a.fold, a.x AS lo, b.x AS hi, sum(p.h) / sum(p.n) AS mean FROM points a JOIN points b ON a.fold = b.fold AND a.x <= b.x JOIN points p ON p.fold = a.fold AND p.x BETWEEN a.x AND b.x GROUP BY ALL)"


@query("u27_isotonic_calibration", f"WITH {_POINTS}, {_SPANS} SELECT fold, min(x) AS lo, max(x) AS hi, CAST(sum(n) AS BIGINT) AS n, r(any_value(fit)) AS value FROM (SELECT q.fold, q.x, q.n, round(max(least_mean), 9) AS fit FROM points q JOIN (SELECT s.fold, s.lo, e.x AS upto, min(s.mean) AS least_mean FROM spans s JOIN points e ON e.fold = s.fold AND s.lo <= e.x AND s.hi >= e.x GROUP BY ALL) m ON m.fold = q.fold AND m.upto = q.x GROUP BY ALL) GROUP BY fold, fit")
def u27_isotonic(s: SparkSession, d: str) -> DataFrame:
    score = F.floor(F.log(F.col("n_chars") + 1) * 10) / 10
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("doc_id") % 8).cast("int").alias("fold"), score.alias("score"), "quality")
    return isotonic.isotonic_fits(rows, "fold", "score", "quality")


_TRIAL = f"(SELECT id, label, (f - 1) // 8 AS channel, (f - 1) % 8 AS t, v FROM {_LONG})"
_COVS = f"SELECT a.label, a.id, CAST(a.channel AS INT) AS i, CAST(b.channel AS INT) AS j, covar_samp(a.v, b.v) AS cov FROM {_TRIAL} a JOIN {_TRIAL} b ON a.id = b.id AND a.t = b.t AND a.channel <= b.channel GROUP BY ALL"
_FAR = "SELECT c.label, c.id, round(sqrt(sum(CASE WHEN i = j THEN 1 ELSE 2 END * (c.cov - m.cov) ** 2)), 9) AS d FROM covs c JOIN (SELECT label, i, j, avg(cov) AS cov FROM covs GROUP BY 1, 2, 3) m USING (label, i, j) GROUP BY 1, 2"
_LEFT = "SELECT c.label, i, j, avg(cov) AS cov, count(*) AS kept FROM covs c JOIN (SELECT label, id, coalesce((d - avg(d) OVER w) / nullif(stddev_pop(d) OVER w, 0), 0) AS z FROM far WINDOW w AS (PARTITION BY label)) USING (label, id) WHERE z < 3 GROUP BY 1, 2, 3"


@query("d41_cleaned_covariance", f"WITH covs AS MATERIALIZED ({_COVS}), far AS MATERIALIZED ({_FAR}), kept AS ({_LEFT}) SELECT label, i, j, r(0.99 * cov + CASE WHEN i = j THEN 0.01 * e ELSE 0 END) AS cov, kept.kept FROM kept JOIN (SELECT label, avg(cov) AS e FROM kept WHERE i = j GROUP BY 1) USING (label)")
def d41(s: SparkSession, d: str) -> DataFrame:
    cells = long(s, d).select("id", "label", F.floor(F.col("f") / 8).cast("int").alias("channel"), (F.col("f") % 8).alias("t"), "v")
    return ops.cleaned_covariance(ops.trial_covariances(cells, ["label"], "id", "channel", "t", "v"), ["label"], "id")


_BRAIN = "SELECT l_linestatus AS map, CAST(l_orderkey % 12 AS INT) AS subject, CAST(l_partkey AS BIGINT) AS voxel, avg(l_quantity) - 25 AS value FROM lineitem GROUP BY 1, 2, 3"
_FLIPPED = f"SELECT map, perm, voxel, round(avg(x) / nullif(stddev_samp(x) / sqrt(count(x)), 0), 9) AS t FROM (SELECT map, perm, voxel, value * {_SIGN} AS x FROM brain, (SELECT unnest(range({PERMS + 1})) AS perm)) GROUP BY 1, 2, 3"


@query("u9_map_cluster_size", f"WITH RECURSIVE brain AS ({_BRAIN}), scores AS MATERIALIZED ({_FLIPPED}), lit AS MATERIALIZED (SELECT map, perm, voxel FROM scores WHERE t > 1.8), steps AS (SELECT unnest([1, -1, 10, -10, 100, -100]) AS step), links AS MATERIALIZED (SELECT a.map, a.perm, a.voxel, b.voxel AS near FROM lit a CROSS JOIN steps JOIN lit b ON b.map = a.map AND b.perm = a.perm AND b.voxel = a.voxel + step WHERE abs(step) = 100 OR (abs(step) = 10 AND a.voxel // 100 = b.voxel // 100) OR (abs(step) = 1 AND a.voxel // 10 = b.voxel // 10)), reach(map, perm, voxel, seen) AS (SELECT map, perm, voxel, voxel FROM lit UNION SELECT r.map, r.perm, r.voxel, l.near FROM reach r JOIN links l ON l.map = r.map AND l.perm = r.perm AND l.voxel = r.seen), named AS MATERIALIZED (SELECT map, perm, voxel, min(seen) AS label FROM reach GROUP BY 1, 2, 3), sizes AS MATERIALIZED (SELECT map, perm, label, count(*) AS size FROM named GROUP BY 1, 2, 3), tops AS MATERIALIZED (SELECT map, perm, tt, coalesce(ts, 0) AS ts FROM (SELECT map, perm, max(t) AS tt FROM scores GROUP BY 1, 2) LEFT JOIN (SELECT map, perm, max(size) AS ts FROM sizes GROUP BY 1, 2) USING (map, perm)), seen AS (SELECT s.map, s.voxel, s.t, n.label, z.size FROM scores s LEFT JOIN named n ON n.map = s.map AND n.perm = 0 AND n.voxel = s.voxel LEFT JOIN sizes z ON z.map = n.map AND z.perm = 0 AND z.label = n.label WHERE s.perm = 0) SELECT map, voxel, r(t) AS t, label, size, r(CASE WHEN t IS NOT NULL THEN count(*) FILTER (WHERE tt >= t) / count(*) END) AS p, r(CASE WHEN size IS NOT NULL THEN count(*) FILTER (WHERE ts >= size) / count(*) END) AS p_size FROM seen JOIN tops USING (map) GROUP BY map, voxel, t, label, size")
def u9(s: SparkSession, d: str) -> DataFrame:
    values = table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("map"), (F.col("l_orderkey") % 12).cast("int").alias("subject"), F.col("l_partkey").cast("long").alias("voxel")).agg((F.avg("l_quantity") - 25).alias("value"))
    return stats.cluster_size_test(values, ["map"], "subject", "voxel", "value", neighbours(s, d), 1.8, PERMS)


def neighbours(s: SparkSession, d: str) -> DataFrame:
    """(voxel, to): items as cells of a grid of 10 by 10 by as many as there are, each with up to six neighbours."""
    v = F.col("p_partkey").cast("long")
    cell = lambda side, within: F.when(F.floor((v + side) / within) == F.floor(v / within), v + side)
    return table(s, d, "part").select(v.alias("voxel"), F.explode(F.array(cell(1, 10), cell(-1, 10), cell(10, 100), cell(-10, 100), v + 100, v - 100)).alias("to")).where("to IS NOT NULL")
