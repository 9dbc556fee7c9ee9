"""The persistent set of ids that were fetched before."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.sources.postings import read_manifest

SEEN_SCHEMA = "id string"


def import_seen(spark: SparkSession, path: str) -> DataFrame:
    """Ids of JSON files that hold an array of texts.

    Malformed content is an error and not an empty set.  Each file is one row of one task and so
    limited to 2 GB; ``import_seen_lines`` takes any size.
    """
    ids = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(ids).alias("id")).distinct()


def import_seen_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ids of text files with one id per line, which many tasks read at once."""
    lines = spark.read.text(path).select(F.trim("value").alias("id"))
    return lines.where(F.col("id") != "").distinct()


def _found(spark: SparkSession, schema: str, path: str, **options: str) -> DataFrame | None:
    """The Parquet files of a path or pattern; none if there are none."""
    try:
        return spark.read.options(**options).schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_folder(path: str, out_path: str, run_id: str) -> str:
    """Where the ids of a run are, by the output that commits it."""
    return f"{path}/out_path={quote(out_path, safe='')}/run_id={run_id}"


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """The seen table; before the first run it is empty.

    It holds the ids that were imported or appended to the folder, and those of complete runs.  The
    ids of a run count once the manifest of its output is there, so a run that broke off leaves
    nothing behind that would hide its postings from the next one.
    """
    whole = _found(spark, SEEN_SCHEMA, f"{path}/*.parquet")
    runs = _found(spark, f"{SEEN_SCHEMA}, out_path string, run_id string", f"{path}/out_path=*", basePath=path)
    if whole is None and runs is None:
        single = _found(spark, SEEN_SCHEMA, path)
        return spark.createDataFrame([], SEEN_SCHEMA) if single is None else single
    if runs is None:
        return whole
    outputs = [row.out_path for row in runs.select("out_path").distinct().collect()]  # a few folders
    complete = [
        read_manifest(spark, out).select(F.lit(out).alias("out_path"), "run_id")
        for out in outputs
        if _has_manifest(spark, out)
    ]
    if not complete:
        return whole if whole is not None else spark.createDataFrame([], SEEN_SCHEMA)
    ids = runs.join(reduce(DataFrame.union, complete).distinct(), ["out_path", "run_id"], "left_semi").select("id")
    return ids if whole is None else whole.union(ids)


def _has_manifest(spark: SparkSession, out_path: str) -> bool:
    try:
        read_manifest(spark, out_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def new_ids(raw: DataFrame, seen: DataFrame) -> DataFrame:
    ids = raw.select(F.col("id").cast("string").alias("id")).where(F.col("id").isNotNull())
    return ids.distinct().join(seen.select("id"), "id", "left_anti")


def write_seen(raw: DataFrame, seen: DataFrame, path: str) -> None:
    """Append the ids of all fetched rows, kept or not, that the table does not hold yet.

    Appending writes new ids only; the table is never rewritten.  Run it after the output is
    committed: a run that fails in between repeats its postings instead of losing them.
    """
    new_ids(raw, seen).write.mode("append").parquet(path)


def write_run_ids(raw: DataFrame, seen: DataFrame, path: str, out_path: str, run_id: str) -> None:
    """Write the new ids of a run, to be committed by the manifest of its output.

    Written again under the same ``run_id`` they replace those of the run.
    """
    new_ids(raw, seen).write.mode("overwrite").parquet(run_folder(path, out_path, run_id))


def compact_seen(spark: SparkSession, path: str, into: str, files: int) -> None:
    """Write the seen table, each id once, into a new folder of ``files`` files, sorted by id.

    Point the next runs to that folder.  The old one isn't touched, so a run that reads it meanwhile,
    or a compaction that broke off, does no harm.
    """
    ids = read_seen(spark, path).distinct().repartition(files, "id").sortWithinPartitions("id")
    ids.write.mode("overwrite").parquet(into)
