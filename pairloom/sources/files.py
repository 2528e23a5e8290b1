"""Readers and writers of pair files, predictions, reports and logs. Line numbers are made once, at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NAME = r"([^/]*)_(train|val|test)\.txt$"


#: What str.strip() takes away, without the Unicode spaces beyond ASCII.
_SPACE = r"[ \t-\r\x1c-\x1f]"


def strip(line) -> Column:
    return F.regexp_replace(line, f"^{_SPACE}+|{_SPACE}+$", "")


def lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """file, line_no, line (without white space at its end) of text files of any size; empty lines count but don't come.

    Files are read in parts. A line's number is its place in its part and the lines of the parts before, which are
    counted in a scan of their own: no task needs a whole file.
    """
    rows = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    parts = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = rows.join(starts, ["file", "_block"]).where(F.regexp_replace("value", "\r$", "") != "")
    return numbered.select("file", (F.col("_id") + F.col("_shift")).cast("int").alias("line_no"), F.regexp_replace("value", f"{_SPACE}+$", "").alias("line"))


def domain_scan(spark: SparkSession, path: str) -> DataFrame:
    """domain, split, pair_idx, left, right, label of <domain>_{train,val,test}.txt; a domain without all three is an error."""
    rows = lines(spark, path).withColumn("domain", F.regexp_extract("file", _NAME, 1)).withColumn("split", F.regexp_extract("file", _NAME, 2))
    rows = rows.where(F.col("domain") != "")
    known = rows.groupBy("domain").agg(F.count_distinct("split").alias("n"))
    checked = rows.join(known, "domain").where(F.when(F.col("n") == 3, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("files missing for "), F.col("domain"))).cast("boolean")))
    return strict_pairs(checked).select("domain", "split", F.col("line_no").cast("long").alias("pair_idx"), "left", "right", "label")


def lenient_pairs(rows: DataFrame, limit: int = 0) -> DataFrame:
    """Rows with at least three fields; the label is the last one. limit > 0: the first lines of each file only."""
    p = F.split("line", "\t")
    out = rows.where(F.size(p) >= 3).withColumn("left", p[0]).withColumn("right", p[1]).withColumn("label", F.element_at(p, -1).cast("int"))
    return out.where(F.col("line_no") < limit).drop("line") if limit > 0 else out.drop("line")


def strict_pairs(rows: DataFrame, size: int | None = None) -> DataFrame:
    """Rows of exactly three fields; another number is an error."""
    p = F.split(strip("line"), "\t", -1)
    fine = F.when(F.size(p) == 3, p).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("line"))).cast("array<string>"))
    out = rows.withColumn("_p", fine).withColumn("left", F.col("_p")[0]).withColumn("right", F.col("_p")[1]).withColumn("label", F.col("_p")[2].cast("int")).drop("_p", "line")
    return out.where(F.col("line_no") < size) if size is not None else out


def singletons(rows: DataFrame, size: int | None = None) -> DataFrame:
    """One record a line, label 0."""
    out = rows.select("file", "line_no", strip("line").alias("text"), F.lit(0).alias("label"))
    return out.where(F.col("line_no") < size) if size is not None else out


def test_files(spark: SparkSession, path: str) -> DataFrame:
    """The sorted test files; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*_test.txt").load(path)
    return found.select(F.col("path").alias("file")).orderBy("file")


def write_pair_json(pairs: DataFrame, path: str) -> None:
    """A [left, right] array a line."""
    pairs.select(F.to_json(F.array("left", "right")).alias("value")).write.mode("overwrite").text(path)


def read_pair_json(spark: SparkSession, path: str) -> DataFrame:
    """left, right from [left, right] lines; a side that is an object is serialised in its key order."""
    sides = F.from_json("value", "array<string>")
    rows = spark.read.text(path).select(sides.alias("s"))

    def text(side):
        keys = F.json_object_keys(side)
        shown = F.transform(keys, lambda k: F.concat(F.lit("COL "), k, F.lit(" VAL "), F.coalesce(F.element_at(F.from_json(side, "map<string,string>"), k), F.lit("")), F.lit(" ")))
        return F.when(side.startswith("{") & keys.isNotNull(), F.array_join(shown, "")).otherwise(side)

    return rows.select(text(F.col("s")[0]).alias("left"), text(F.col("s")[1]).alias("right"))


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select("left", "right", "match", "match_confidence").write.mode("overwrite").json(path)


def write_budgeted(rows: DataFrame, path: str) -> None:
    """Replaces the whole data set, a folder per domain and split."""
    rows.write.mode("overwrite").partitionBy("domain", "split").parquet(path)


def write_pair_text(rows: DataFrame, path: str) -> None:
    """Tab-separated lines, a folder per domain and split."""
    line = F.concat_ws("\t", "left", "right", F.col("label").cast("string"))
    rows.select("domain", "split", line.alias("value")).write.mode("overwrite").partitionBy("domain", "split").text(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_runtime(spark: SparkSession, run_tag: str, seconds: float, path: str) -> None:
    """A line "run_tag seconds" of the log of run times."""
    line = F.format_string("%s %f", F.lit(run_tag), F.lit(float(seconds)))
    spark.range(1).select(line.alias("value")).coalesce(1).write.mode("append").text(path)


def append_best(rows: DataFrame, path: str) -> None:
    """task, budget, best_method."""
    rows.select("task", "budget", "best_method").write.mode("append").csv(path)


def read_catalog(spark: SparkSession, path: str) -> dict[str, dict]:
    """The tasks and domains of a JSON list by name: a small file of settings."""
    rows = spark.read.option("multiLine", True).json(path).collect()
    return {r["name"]: r.asDict(recursive=True) for r in rows}


def parse_budget_log(rows: DataFrame) -> DataFrame:
    """file, budget, domain, metric, value from file, line_no, line: a budget header holds for the lines after it, file by file."""
    head = F.regexp_extract("line", r"^STARTING BUDGET: (\d+)", 1)
    budget = F.last(F.when(head != "", head.cast("int")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    pattern = r"^(\S+) (F1|Precision|Recall): ([0-9.eE+-]+|nan)$"
    found = rows.withColumn("budget", budget).where(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    return found.select("file", "budget", part(1).alias("domain"), part(2).alias("metric"), part(3).cast("double").alias("value"))


def parse_zero_shot_log(rows: DataFrame) -> DataFrame:
    """domain, metric, value from lines like <domain>_test.txt F1: x."""
    t = F.split("line", " ")
    name = F.regexp_extract(t[1], r"^(F1|Precision|Recall)", 1)
    kept = rows.where((F.size(t) >= 3) & (name != "") & t[0].endswith("_test.txt"))
    return kept.select(F.expr("substring(split(line, ' ')[0], 1, length(split(line, ' ')[0]) - 9)").alias("domain"), name.alias("metric"), t[2].cast("double").alias("value"))


def report(means: DataFrame, spread: bool = True) -> DataFrame:
    """One line a budget, domain and metric, sorted; nan where a value is missing. Values are rounded to 9 digits first, so the order of a sum doesn't show."""
    means = means.withColumns({c: F.round(c, 9) for c in ("mean", "std") if c in means.columns})
    shown = F.when(F.col("mean").isNull(), "nan").otherwise(F.format_string("%.4f", F.col("mean")))
    line = F.concat_ws(" ", "domain", F.concat("metric", F.lit(":")), shown)
    line = F.concat(line, F.when(F.col("std").isNotNull(), F.format_string(" ± %.4f", F.col("std"))).otherwise("")) if spread else line
    return means.orderBy("budget", "domain", "metric").select("budget", line.alias("line"))
