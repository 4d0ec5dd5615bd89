"""Readers of experiment files: run logs, tracker text, sample tables, metrics; and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUBJECT = "^[A-Z]{2}[0-9]{3}$"
FILE = "_metadata.file_name"


def run_logs(spark: SparkSession, path: str, schema: str, time: str = "time") -> DataFrame:
    """Event rows of a folder of CSV logs named ..._run_<n>[_RESTARTED|_ABORTED].csv, one file for each subject and run.

    Of regular, restarted and aborted files of a run, that with the latest event is kept; empty files never count. Two
    regular files of one run are an error. Adds file, subject, run and kind.
    """
    rows = spark.read.schema(schema).csv(path, header=True, pathGlobFilter="*.csv", recursiveFileLookup=True).withColumn("file", F.col(FILE))
    name = F.upper("file")
    kind = F.when(name.contains("RESTART"), "restarted").when(name.contains("ABORT"), "aborted").otherwise("regular")
    rows = rows.withColumns({"subject": F.regexp_extract("file", "([A-Z]{2}[0-9]{3})", 1), "run": F.regexp_extract(F.lower("file"), "run_?([0-9]+)", 1).cast("int"), "kind": kind})
    files = rows.groupBy("subject", "run", "file", "kind").agg(F.max(time).alias("latest"))
    w = Window.partitionBy("subject", "run")
    files = files.withColumn("regular", F.count_if(F.col("kind") == "regular").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("latest"), "file")))
    checked = files.where("n = 1").withColumn("ok", F.assert_true(F.col("regular") <= 1, F.concat(F.lit("two regular files of run "), F.col("run").cast("string")))).where("ok is null")
    return rows.join(checked.select("subject", "run", "file"), ["subject", "run", "file"], "left_semi")


def is_subject(column: str) -> F.Column:
    """Two capitals and three digits."""
    return F.col(column).rlike(SUBJECT)


def find_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, folder, length) of all files below path that fit a glob, for ordering by name; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("folder"), "length")


TRACKER = {
    "message": (r"^MSG\s+([0-9]+)\s+(.*)$", ["time long", "text string"]),
    "fixation": (r"^EFIX\s+([LR])\s+([0-9]+)\s+([0-9]+)\s+([0-9]+)\s+([0-9.]+)\s+([0-9.]+)", ["eye string", "lo long", "hi long", "duration long", "x double", "y double"]),
    "saccade": (r"^ESACC\s+([LR])\s+([0-9]+)\s+([0-9]+)\s+([0-9]+)", ["eye string", "lo long", "hi long", "duration long"]),
    "blink": (r"^EBLINK\s+([LR])\s+([0-9]+)\s+([0-9]+)\s+([0-9]+)", ["eye string", "lo long", "hi long", "duration long"]),
    "sample": (r"^([0-9]+)\s+([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)", ["t long", "x double", "y double", "pupil double"]),
}


def tracker_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a tracker's text log by kind of line. Later files are shifted by the last sample time of those before.

    A missing value (a dot) is null. The shift is one small row for each file.
    """
    lines = spark.read.text(path).withColumn("file", F.col(FILE))
    pattern, _ = TRACKER["sample"]
    ends = lines.where(F.col("value").rlike(pattern)).groupBy("file").agg(F.max(F.regexp_extract("value", "^([0-9]+)", 1).cast("long")).alias("last"))
    before = F.coalesce(F.sum("last").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(ends.select("file", before.alias("shift")), "file", "left")
    out = {}
    for kind, (pattern, columns) in TRACKER.items():
        rows = lines.where(F.col("value").rlike(pattern))
        fields = []
        for k, column in enumerate(columns, 1):
            name, kind_of = column.split()
            text = F.regexp_extract("value", pattern, k)
            field = text if kind_of == "string" else F.expr(f"try_cast(nullif(regexp_extract(value, r'{pattern}', {k}), '.') as {kind_of})")
            fields.append((field + F.coalesce("shift", F.lit(0)) if name in ("time", "t", "lo", "hi") else field).alias(name))
        out[kind] = rows.select("file", *fields)
    return out


def sample_table(spark: SparkSession, path: str, schema: str, names: dict[str, str]) -> DataFrame:
    """A CSV of samples with its columns renamed; union with other trackers by name, missing columns null."""
    return spark.read.schema(schema).csv(path, header=True).withColumnsRenamed(names)


def run_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON file a run, with subject, session and run out of its name."""
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col(FILE))
    part = lambda key: F.regexp_extract("file", f"{key}-([A-Za-z0-9]+)", 1).alias(key)
    return rows.select(part("sub"), part("ses"), part("run"), *[c for c in rows.columns if c != "file"])


def sequences(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Semicolon-separated sequences without malformed lines and repeats."""
    return spark.read.schema(schema).csv(path, sep=";", mode="DROPMALFORMED").dropDuplicates()


def flagged_participants(spark: SparkSession, path: str, flag: str) -> DataFrame:
    """Participants of a TSV whose flag is true, without the prefix of their id."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.where(F.lower(flag).isin("1", "true", "yes")).select(F.regexp_replace("participant_id", "^sub-", "").alias("subject"))


def subject_results(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Per-subject result files as one table, the subject from the file name."""
    return spark.read.schema(schema).csv(list(paths), header=True).withColumn("subject", F.regexp_extract(F.col(FILE), "([A-Z]{2}[0-9]{3})", 1))


def save_new(df: DataFrame, path: str) -> None:
    """Write CSV; an existing result is an error."""
    df.write.mode("errorifexists").csv(path, header=True)


def save_regressors(df: DataFrame, path: str, key: str = "event_type") -> None:
    """Onset, duration and weight of each event type in a folder of its own, without a header."""
    df.select(key, "onset", "duration", "weight").write.mode("overwrite").partitionBy(key).csv(path, sep="\t")


def cached(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Parquet by keys at path: read if it is complete there, written first if not."""
    spark = df.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        df.write.mode("overwrite").partitionBy(*keys).parquet(path)
    return spark.read.parquet(path)
