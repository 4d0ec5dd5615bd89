"""Queries on maps: items stand in for voxels, return flags for maps, types and brands for regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import channels as tagged
from ..operators import maps as ops
from .standins import events, features, query, regions, table, trials, voxels

_WIDE = "SELECT voxel, max(CASE WHEN map = 'A' THEN value END) AS a, max(CASE WHEN map = 'N' THEN value END) AS n, max(CASE WHEN map = 'R' THEN value END) AS r FROM {vx} GROUP BY 1"
_RULES = {"task": "a > 0 AND n > 0 AND r > 0", "no_task": "a > 2 AND n BETWEEN -2 AND 2", "content": "(a > 0) <> (n > 0)", "directional": "a > 0 AND r > 0 AND a > r"}


@query("d37_conjunctions", "SELECT voxel, " + ", ".join(f"coalesce({v}, false) AS {k}" for k, v in _RULES.items()) + f" FROM ({_WIDE})")
def d37(s: SparkSession, d: str) -> DataFrame:
    a, n, r = F.col("A"), F.col("N"), F.col("R")
    rules = {"task": (a > 0) & (n > 0) & (r > 0), "no_task": (a > 2) & n.between(-2, 2), "content": (a > 0) != (n > 0), "directional": (a > 0) & (r > 0) & (a > r)}
    return ops.conjunction(voxels(s, d), ["A", "N", "R"], rules)


@query("d38_merged_maps", "SELECT voxel, CAST(min(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS INT) AS all_maps, CAST(max(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS INT) AS any_map, CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS total FROM {vx} GROUP BY 1")
def d38(s: SparkSession, d: str) -> DataFrame:
    return ops.merged(voxels(s, d).withColumn("value", (F.col("value") > 0).cast("int")))


@query("d39_sum_of_maps", "SELECT voxel, r(sum(value)) AS total FROM {vx} GROUP BY 1")
def d39(s: SparkSession, d: str) -> DataFrame:
    return ops.merged(voxels(s, d)).select("voxel", "total")


@query("c22_region_counts", "SELECT roi, count(*) AS size, count(o) AS n, r(count(o) / count(*)) AS fraction, r(100.0 * count(o) / count(*)) AS percent FROM {rg} LEFT JOIN (SELECT DISTINCT voxel, 1 AS o FROM {vx} WHERE value > 2) USING (voxel) GROUP BY 1")
def c22(s: SparkSession, d: str) -> DataFrame:
    return ops.region_counts(regions(s, d), voxels(s, d).where("value > 2"))


_TB = "SELECT {k}, voxel, r(value) AS value, place, side FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY value DESC, voxel) AS place, 'top' AS side FROM {src} WHERE value <> 0) WHERE place <= {a} UNION ALL SELECT {k}, voxel, r(value), place, side FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY value, voxel) AS place, 'bottom' AS side FROM {src} WHERE value <> 0) WHERE place <= {b}"
_RV = "(SELECT roi, map, voxel, value FROM {rg} JOIN {vx} USING (voxel))"


def region_voxels(s: SparkSession, d: str) -> DataFrame:
    return regions(s, d).join(voxels(s, d), "voxel")


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("place", F.col("place").cast("long"))


@query("f1_decoding_roi", _TB.replace("{k}", "roi, map").replace("{src}", _RV).replace("{a}", "15").replace("{b}", "15"))
def f1(s: SparkSession, d: str) -> DataFrame:
    return _long(ops.top_and_bottom(region_voxels(s, d), ["roi", "map"], 15, 15))


@query("f2_leave_one_run_out_roi", _TB.replace("{k}", "roi, run").replace("{src}", "(SELECT roi, run, voxel, avg(value) AS value FROM (SELECT roi, voxel, map, value FROM {rg} JOIN {vx} USING (voxel)) JOIN (VALUES ('A'), ('N'), ('R')) v(run) ON run <> map GROUP BY ALL)").replace("{a}", "20").replace("{b}", "0"))
def f2(s: SparkSession, d: str) -> DataFrame:
    runs = s.createDataFrame([("A",), ("N",), ("R",)], "run string")
    rest = region_voxels(s, d).join(F.broadcast(runs), F.col("run") != F.col("map")).groupBy("roi", "run", "voxel").agg(F.avg("value").alias("value"))
    return _long(ops.top_and_bottom(rest, ["roi", "run"], 20, 0))


@query("f3_seeds_in_mask", _TB.replace("{k}", "roi").replace("{src}", "(SELECT roi, voxel, value FROM {rg} JOIN {vx} USING (voxel) WHERE map = 'N' AND voxel IN (SELECT voxel FROM {vx} WHERE map = 'A' AND abs(value) > 1))").replace("{a}", "10").replace("{b}", "10"))
def f3(s: SparkSession, d: str) -> DataFrame:
    mask = voxels(s, d).where("map = 'A' and abs(value) > 1")
    return _long(ops.top_and_bottom(region_voxels(s, d).where("map = 'N'").join(mask, "voxel", "left_semi").drop("map"), ["roi"], 10, 10))


@query("f4_roi_reports", f"SELECT roi, map, count(*) FILTER (WHERE value = 0) AS zeros, count(*) < 60 AS short FROM {_RV} GROUP BY ALL")
def f4(s: SparkSession, d: str) -> DataFrame:
    return region_voxels(s, d).groupBy("roi", "map").agg(F.count_if(F.col("value") == 0).alias("zeros"), (F.count(F.lit(1)) < 60).alias("short"))


_FV = "(SELECT vec_id AS id, label, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS feature FROM embeddings)"
_F = f"SELECT feature, ((B - S * S / N) / (k - 1)) / ((Q - B) / (N - k)) AS f FROM (SELECT feature, sum(n) AS N, count(*) AS k, sum(s) AS S, sum(q) AS Q, sum(s * s / n) AS B FROM (SELECT feature, label, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM {_FV} GROUP BY ALL) GROUP BY 1)"


@query("f5_best_features", f"SELECT feature, r(f) AS f, place FROM (SELECT *, row_number() OVER (ORDER BY f DESC, feature) AS place FROM ({_F.replace(' N', ' cnt').replace('/ N', '/ cnt').replace('(N - k)', '(cnt - k)').replace('AS S', 'AS tot').replace('S * S', 'tot * tot')})) WHERE place <= 20")
def f5(s: SparkSession, d: str) -> DataFrame:
    values = features(s, d).select("label", F.posexplode("x").alias("feature", "v"))
    f = ops.anova_f(values, "feature", "label", "v")
    return f.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f"), "feature")).cast("long")).where("place <= 20")


_EQ = "(SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('7:' || id), id) AS rank FROM {ev})"


@query("f6_equal_label_counts", f"SELECT id, kind, rank FROM {_EQ} WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {{ev}} GROUP BY kind))")
def f6(s: SparkSession, d: str) -> DataFrame:
    return ops.equal_label_counts(events(s, d), "kind", "id", 7).select("id", "kind", "rank")


@query("f7_super_subject", "SELECT k, rank, n, r(m) AS m FROM (SELECT k, rank, count(*) AS n, avg(value) AS m FROM (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY md5('3:' || id), id) AS rank FROM (SELECT *, subject % 4 AS g FROM {ev}) WHERE k IN (SELECT k FROM {ev} GROUP BY k HAVING count(DISTINCT subject % 4) = 4)) JOIN (SELECT k, min(n) AS least FROM (SELECT k, subject % 4 AS g, count(*) AS n FROM {ev} GROUP BY ALL) GROUP BY 1) USING (k) WHERE rank <= least GROUP BY ALL)")
def f7(s: SparkSession, d: str) -> DataFrame:
    rows = ops.super_subject(events(s, d).withColumn("g", F.col("subject") % 4), "g", "k", "id", 3)
    return rows.groupBy("k", "rank").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))


@query("f8_enough_repeats", "SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY subject, k) AS n FROM {ev}) WHERE n >= 2")
def f8(s: SparkSession, d: str) -> DataFrame:
    return ops.enough_repeats(events(s, d), ["subject", "k"], 2).select("id")


@query("g2_labels_in_every_subject", "SELECT k FROM {ev} GROUP BY k HAVING count(DISTINCT subject % 10) = 10")
def g2(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy("k").agg(F.count_distinct(F.col("subject") % 10).alias("n")).where("n = 10").select("k")


@query("g3_c_without_a_or_b", "SELECT voxel FROM {vx} WHERE map = 'R' AND value > 0 EXCEPT SELECT voxel FROM {vx} WHERE map IN ('A', 'N') AND value > 1")
def g3(s: SparkSession, d: str) -> DataFrame:
    v = voxels(s, d)
    return v.where("map = 'R' and value > 0").select("voxel").join(v.where("map in ('A', 'N') and value > 1"), "voxel", "left_anti")


@query("g4_phase_codes", "SELECT voxel, CASE WHEN a IS NULL THEN 2 WHEN b IS NULL THEN 1 ELSE 3 END AS code FROM (SELECT DISTINCT voxel, 1 AS a FROM {vx} WHERE map = 'A' AND value > 0) FULL OUTER JOIN (SELECT DISTINCT voxel, 1 AS b FROM {vx} WHERE map = 'N' AND value > 0) USING (voxel)")
def g4(s: SparkSession, d: str) -> DataFrame:
    v = voxels(s, d).where("value > 0")
    return ops.phase_codes(v.where("map = 'A'"), v.where("map = 'N'"))


@query("g5_overlapping_regions", "SELECT roi, voxel, count(*) OVER (PARTITION BY voxel) AS regions, row_number() OVER (PARTITION BY voxel ORDER BY size, roi) = 1 AS owner FROM (SELECT *, count(*) OVER (PARTITION BY roi) AS size FROM {rg})")
def g5(s: SparkSession, d: str) -> DataFrame:
    return ops.overlapping(regions(s, d)).drop("size")


@query("g6_combined_regions", "SELECT DISTINCT CASE WHEN roi IN ('ECONOMY', 'SMALL') THEN 'posterior' ELSE 'anterior' END AS theory, voxel FROM {rg}")
def g6(s: SparkSession, d: str) -> DataFrame:
    theory = F.when(F.col("roi").isin("ECONOMY", "SMALL"), "posterior").otherwise("anterior")
    return regions(s, d).select(theory.alias("theory"), "voxel").distinct()


@query("g7_three_set_overlap", f"SELECT coalesce(a > 0, false) AS in_a, coalesce(n > 0, false) AS in_n, coalesce(r > 0, false) AS in_r, count(*) AS voxels FROM ({_WIDE}) GROUP BY ALL")
def g7(s: SparkSession, d: str) -> DataFrame:
    flags = ops.conjunction(voxels(s, d), ["A", "N", "R"], {f"in_{x.lower()}": F.col(x) > 0 for x in "ANR"})
    return flags.groupBy("in_a", "in_n", "in_r").agg(F.count(F.lit(1)).alias("voxels"))


# channels: suppliers with nation and region as atlas labels

_CH = "(SELECT s_suppkey AS channel, n_name || '/' || r_name AS label, [n_name, r_name] AS labels, s_acctbal AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def channels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("s_suppkey").alias("channel"), F.concat_ws("/", "n_name", "r_name").alias("label"), F.array("n_name", "r_name").alias("labels"), F.col("s_acctbal").alias("x"))


@query("b11_event_columns", f"SELECT channel, split_part(label, '/', 1) AS nation, split_part(label, '/', 2) AS region FROM {_CH}")
def b11(s: SparkSession, d: str) -> DataFrame:
    return tagged.event_columns(channels(s, d), "label", ["nation", "region"]).select("channel", "nation", "region")


@query("b12_tags", f"SELECT channel, array_to_string(list_filter(labels, lambda v: v <> 'ASIA'), '/') AS removed, CASE WHEN list_contains(labels, 'bad') THEN label ELSE label || '/bad' END AS added FROM {_CH}")
def b12(s: SparkSession, d: str) -> DataFrame:
    return channels(s, d).select("channel", tagged.without_tag("label", "ASIA").alias("removed"), tagged.with_tag("label", "bad").alias("added"))


@query("b13_channels_without_tags", f"SELECT channel FROM {_CH} WHERE NOT list_has_any(labels, ['ASIA', 'AFRICA'])")
def b13(s: SparkSession, d: str) -> DataFrame:
    return tagged.without_tagged(channels(s, d), "labels", ["ASIA", "AFRICA"]).select("channel")


@query("b18_channels_in_roi", f"SELECT channel FROM {_CH} WHERE list_has_any(labels, ['EUROPE', 'CHINA'])")
def b18(s: SparkSession, d: str) -> DataFrame:
    return tagged.in_regions(channels(s, d), "labels", ["EUROPE", "CHINA"]).select("channel")


@query("b34_clean_atlas_labels", "SELECT channel, coalesce(list_filter(string_split(regexp_replace(raw, '(ctx_lh_|ctx_rh_)', '', 'g'), '/'), lambda v: v NOT IN ('Unknown', 'White-Matter'))[1], string_split(regexp_replace(raw, '(ctx_lh_|ctx_rh_)', '', 'g'), '/')[1]) AS roi FROM (SELECT s_suppkey AS channel, CASE s_suppkey % 3 WHEN 0 THEN 'Unknown/ctx_lh_' || n_name WHEN 1 THEN 'ctx_rh_' || n_name || '/Unknown' ELSE 'Unknown/White-Matter' END AS raw FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def b34(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Unknown/ctx_lh_"), "n_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("ctx_rh_"), "n_name", F.lit("/Unknown"))).otherwise("Unknown/White-Matter")
    parts = F.split(F.regexp_replace(raw, "(ctx_lh_|ctx_rh_)", ""), "/")
    kept = F.filter(parts, lambda v: ~v.isin("Unknown", "White-Matter"))
    return c.select(F.col("s_suppkey").alias("channel"), F.coalesce(F.try_element_at(kept, F.lit(1)), F.element_at(parts, 1)).alias("roi"))


@query("c21_coordinates", f"SELECT channel, r(mean) AS mean, x FROM (SELECT l_suppkey AS channel, avg(l_extendedprice / 1000) AS mean FROM lineitem GROUP BY 1) JOIN {_CH} USING (channel)")
def c21(s: SparkSession, d: str) -> DataFrame:
    means = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("channel")).agg(F.avg(F.col("l_extendedprice") / 1000).alias("mean"))
    return means.join(channels(s, d).select("channel", "x"), "channel")


@query("c26_annotations", f"SELECT channel, label || coalesce('/' || a, '') AS label FROM {_CH} LEFT JOIN (SELECT l_suppkey AS channel, string_agg(DISTINCT l_returnflag, '/' ORDER BY l_returnflag) AS a FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09 GROUP BY 1) USING (channel)")
def c26(s: SparkSession, d: str) -> DataFrame:
    notes = table(s, d, "lineitem").where("l_quantity > 49 and l_discount > 0.09").groupBy(F.col("l_suppkey").alias("channel")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("notes"))
    rows = channels(s, d).join(notes, "channel", "left")
    return rows.select("channel", F.array_join(F.array_union(F.split("label", "/"), F.coalesce("notes", F.array().cast("array<string>"))), "/").alias("label"))


@query("a6_flagged_subjects", "SELECT DISTINCT 'sub-' || subject AS participant FROM {tr} WHERE flag = 'R' AND quantity = 50")
def a6(s: SparkSession, d: str) -> DataFrame:
    return trials(s, d).where("flag = 'R' and quantity = 50").select(F.concat(F.lit("sub-"), "subject").alias("participant")).distinct()
