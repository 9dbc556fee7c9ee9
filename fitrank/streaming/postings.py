"""Incremental runs over a folder of posting files.

All queries use the ``availableNow`` trigger by default, so one start handles what has arrived
and ends, like a scheduled run; the checkpoint carries the state to the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fitrank.config import FilterRules
from fitrank.operators.filters import filter_chain
from fitrank.operators.ranking import dedup_reposts, unique_ids
from fitrank.operators.scoring import keyword_match
from fitrank.schemas import POSTING
from fitrank.sources.seen import SEEN_SCHEMA

RUN_ONCE = {"availableNow": True}
Batch = Callable[[DataFrame, int], None]


def read_posting_stream(
    spark: SparkSession, path: str, form: str = "parquet", schema=POSTING, **options
) -> DataFrame:
    """New posting files of a folder; ``maxFilesPerTrigger`` and the like go in as options."""
    return spark.readStream.schema(schema).format(form).options(**options).load(path)


def new_by_id(stream: DataFrame) -> DataFrame:
    """Each id once over all runs; rows without an id are all new.

    Exact, as ids are never forgotten; the state grows with the number of ids and belongs into
    the RocksDB state store.
    """
    named = stream.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    return named.union(stream.where(F.col("id").isNull()))


def new_by_id_bounded(stream: DataFrame, horizon: str) -> DataFrame:
    """Each id once within a horizon of posting times, which bounds the state.

    Rows that arrive later than the horizon leave the stream; ``bounded_batches`` keeps them aside.
    """
    return stream.withWatermark("date_posted", horizon).dropDuplicatesWithinWatermark(["id"])


def write_stream(
    out: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    form: str = "parquet",
    trigger: dict | None = None,
    partition_by: tuple[str, ...] = (),
) -> StreamingQuery:
    """Append-only file sink with a checkpoint in a folder all executors can reach."""
    writer = out.writeStream.outputMode(mode).format(form).option("checkpointLocation", checkpoint)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    return writer.trigger(**(trigger or RUN_ONCE)).start(path)


def stream_key(checkpoint: str) -> str:
    """A name for the outputs of the stream with this checkpoint, the same after a restart."""
    return hashlib.md5(checkpoint.encode("utf-8"), usedforsecurity=False).hexdigest()[:16]


def own_folder(path: str, key: str, batch_id: int) -> str:
    """Where one batch of one stream writes.  A batch that runs again overwrites its own folder and
    no other, whatever other streams have written."""
    return f"{path}/stream={key}/batch_id={batch_id}"


def of_other_batches(spark: SparkSession, path: str, schema: str, key: str, batch_id: int) -> DataFrame:
    """What all streams have written to a path, without the given batch; empty at first."""
    full = f"{schema}, stream string, batch_id bigint"
    try:
        written = spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return written.where((F.col("stream") != key) | (F.col("batch_id") != batch_id))


def start_batches(
    stream: DataFrame, handle: Batch, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or RUN_ONCE)).start()


def bounded_batches(out_path: str, late_path: str, hours: int, key: str) -> Batch:
    """Batch function: each id once within a horizon, and late rows aside.

    A row is late whose posting time lies more than ``hours`` before the latest one of earlier
    batches; it goes to ``late_path``, so no row is lost.  Of the earlier output only rows within the
    horizon are read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = ["id", "date_posted"]
        schema = batch.select(*columns)._jdf.schema().toDDL()
        earlier = of_other_batches(spark, out_path, schema, key, batch_id)
        latest = earlier.agg(F.max("date_posted")).first()[0]
        since = F.lit(latest) - F.make_interval(hours=F.lit(hours))
        late = F.coalesce(F.col("date_posted") < since, F.lit(False)) if latest else F.lit(False)
        batch.where(late).write.mode("overwrite").parquet(own_folder(late_path, key, batch_id))
        recent = earlier.where(F.col("date_posted") >= since) if latest else earlier
        fresh = batch.where(~late).join(recent.select("id"), "id", "left_anti")
        unique_ids(fresh.select(batch.columns), ("date_posted",)).write.mode("overwrite").parquet(
            own_folder(out_path, key, batch_id)
        )

    return handle


def count_batches(out_path: str, hours: int, key: str) -> Batch:
    """Batch function: partial counts of the batch by company and window of the posting time."""
    seconds = hours * 3600

    def handle(batch: DataFrame, batch_id: int) -> None:
        start = F.timestamp_seconds(F.floor(F.unix_seconds("date_posted") / seconds) * seconds)
        counts = batch.groupBy(start.alias("window_start"), "company").agg(
            F.count(F.lit(1)).alias("n")
        )
        counts.write.mode("overwrite").parquet(own_folder(out_path, key, batch_id))

    return handle


def ingest_counts(
    stream: DataFrame,
    out_path: str,
    checkpoint: str,
    hours: int = 24,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Count the postings per company and tumbling window; ``read_counts`` gives the sums.

    Every batch leaves its own partial counts, so each posting is counted, however late it comes,
    there is no state to bound, and a batch that runs again replaces what it wrote.
    """
    handle = count_batches(out_path, hours, stream_key(checkpoint))
    return start_batches(stream, handle, checkpoint, trigger)


def read_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """Postings per company and window so far; a missing posting time is a window of its own."""
    parts = spark.read.schema("window_start timestamp, company string, n bigint").parquet(out_path)
    return parts.groupBy("window_start", "company").agg(F.sum("n").alias("n"))


def scored_batches(
    profile: DataFrame,
    rules: FilterRules,
    out_path: str,
    seen_path: str,
    key: str = "stream",
    known: DataFrame | None = None,
) -> Batch:
    """Batch function: filter, drop seen ids and reposts, score, then record all ids.

    Output and ids go to a folder per stream and batch which is overwritten, so a batch that runs
    again after a failure leaves the same result; the ids come last.  Seen are the ids of ``known``,
    such as the table of the batch job, and of all batches of all streams but this very one; a new
    checkpoint over old folders continues them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = of_other_batches(spark, seen_path, SEEN_SCHEMA, key, batch_id).select("id")
        if known is not None:
            earlier = earlier.union(known.select("id"))
        kept = unique_ids(filter_chain(batch, rules, earlier), ("date_posted",))
        scored = keyword_match(dedup_reposts(kept, ("id",)), profile)
        scored.write.mode("overwrite").parquet(own_folder(out_path, key, batch_id))
        ids = batch.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
        ids.join(earlier, "id", "left_anti").write.mode("overwrite").parquet(
            own_folder(seen_path, key, batch_id)
        )

    return handle


def filter_score_stream(
    stream: DataFrame,
    profile: DataFrame,
    rules: FilterRules,
    out_path: str,
    seen_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    known: DataFrame | None = None,
) -> StreamingQuery:
    handle = scored_batches(profile, rules, out_path, seen_path, stream_key(checkpoint), known)
    return start_batches(stream, handle, checkpoint, trigger)


def bounded_stream(
    stream: DataFrame,
    out_path: str,
    late_path: str,
    hours: int,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    handle = bounded_batches(out_path, late_path, hours, stream_key(checkpoint))
    return start_batches(stream, handle, checkpoint, trigger)
