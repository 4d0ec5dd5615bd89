"""How the driver's tables stand in for experiment tables, as DataFrames and as DuckDB subqueries of the same rows.

events    event log, gaze samples, triggers: one row per event of a subject (user), with seconds t and code k
lineitem  trials with conditions, and signals (channel, epoch, t, value)
part      voxel maps and region membership;  embeddings  trials with features and labels
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import register

ROUND = 4
SHIFT = 1.2345e-08


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def seconds(column: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))") / 1e6


def events(s: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k")
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("kind"), seconds("ts").alias("t"), F.col("value"), k)


def trials(s: SparkSession, d: str) -> DataFrame:
    """One row per line item with its order: conditions flag, status, priority; value in thousands."""
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("subject"), F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("l_extendedprice") / 1000).alias("value"), F.col("l_quantity").alias("quantity"),
    )


def signal(s: SparkSession, d: str) -> DataFrame:
    """(channel, epoch, t, value): a channel for each supplier, so that channels grow with the table and cells hold 1.6 line items on average at every size; those of a cell are averaged."""
    li = table(s, d, "lineitem")
    keys = [F.col("l_suppkey").cast("long").alias("channel"), (F.col("l_orderkey") % 20).cast("int").alias("epoch"), (F.col("l_linenumber") + 7 * (F.col("l_partkey") % 4)).cast("int").alias("t")]
    return li.groupBy(*keys).agg(F.avg(F.col("l_extendedprice") / 1000).alias("value"))


def voxels(s: SparkSession, d: str) -> DataFrame:
    """(map, voxel, value): a map for each flag, the mean quantity of each item less 25."""
    li = table(s, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("map"), F.col("l_partkey").alias("voxel")).agg((F.avg("l_quantity") - 25).alias("value"))


def regions(s: SparkSession, d: str) -> DataFrame:
    """(roi, voxel): membership by part type, and by brand."""
    p = table(s, d, "part")
    return p.select(F.col("p_type").alias("roi"), F.col("p_partkey").alias("voxel")).unionByName(p.select(F.col("p_brand").alias("roi"), F.col("p_partkey").alias("voxel")))


def features(s: SparkSession, d: str) -> DataFrame:
    """(id, label, run, x): every embedding with its label and one of eight runs."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 8).cast("int").alias("run"), F.col("embedding").cast("array<double>").alias("x"))


SQL = {
    "ev": "(SELECT event_id AS id, user_id AS subject, event_type AS kind, epoch_us(ts) / 1e6 AS t, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)",
    "tr": "(SELECT o_custkey AS subject, l_orderkey AS trial, l_linenumber AS line, l_partkey AS item, l_returnflag AS flag, l_linestatus AS status, o_orderpriority AS priority, l_extendedprice / 1000 AS value, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "sg": "(SELECT CAST(l_suppkey AS BIGINT) AS channel, CAST(l_orderkey % 20 AS INT) AS epoch, CAST(l_linenumber + 7 * (l_partkey % 4) AS INT) AS t, avg(l_extendedprice / 1000) AS value FROM lineitem GROUP BY 1, 2, 3)",
    "vx": "(SELECT l_returnflag AS map, l_partkey AS voxel, avg(l_quantity) - 25 AS value FROM lineitem GROUP BY 1, 2)",
    "rg": "(SELECT p_type AS roi, p_partkey AS voxel FROM part UNION ALL SELECT p_brand, p_partkey FROM part)",
    "ft": "(SELECT vec_id AS id, label, CAST(vec_id % 8 AS INT) AS run, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
}


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """Doubles to a few digits, as sums of doubles depend on their order; SHIFT moves exact halves, minus zero becomes zero."""
    return df.select(*[(F.round(F.col(c) + F.lit(SHIFT), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = ROUND) -> Callable:
    """Register a callable (spark, dir) -> DataFrame; {ev}, {tr}, ... in sql stand for the subqueries, r(x) for rounding."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        text = sql
        if text is not None:
            for k, v in SQL.items():
                text = text.replace("{" + k + "}", v)
            text = _round_calls(text, digits)
        register(name, lambda s, d: rounded(f(s, d), digits), text)
        return f

    return wrap


def _round_calls(text: str, digits: int) -> str:
    """Write r(expression) out as round(expression, digits) + 0.0."""
    out, at = [], 0
    while (k := text.find("r(", at)) >= 0:
        if k and (text[k - 1].isalnum() or text[k - 1] == "_"):
            out.append(text[at : k + 2])
            at = k + 2
            continue
        depth, end = 1, k + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = _round_calls(text[k + 2 : end - 1], digits)
        out.append(f"{text[at:k]}(round(CAST({inner} AS DOUBLE) + {SHIFT!r}, {digits}) + 0.0)")
        at = end
    return "".join(out) + text[at:]
