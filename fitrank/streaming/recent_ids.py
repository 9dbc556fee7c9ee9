"""Each id once within a horizon of posting times, with the ids in the state store and late rows kept.

The state holds one time for each id that was let through within the horizon.  A timer per id forgets
it, so the state does not grow with the runs, and nothing that was written before is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from fitrank.streaming.postings import write_stream

NEW, LATE = "new", "late"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNNAMED_GROUPS = 1024
KEY, SALT, TIME, CLOCK = "_id_key", "_id_salt", "_posted_us", "_posted_clock"
OUTPUT = "output"


class FirstWithinHorizon(StatefulProcessor):
    """Rows of one id: the earliest that is neither late nor repeated is new, late ones are passed on."""

    def __init__(self, columns: list[str], horizon_ms: int) -> None:
        self.columns = columns
        self.horizon_ms = horizon_ms
        self.out = Row(*columns, OUTPUT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # posted: time of the row that was let through; dated: false if it had none.
        self.held = handle.getValueState("held", "posted bigint, dated boolean")

    def labelled(self, row: Row, output: str) -> Row:
        return self.out(*[row[c] for c in self.columns], output)

    def hold(self, posted_ms: int, dated: bool) -> None:
        self.held.update((posted_ms, dated))
        self.handle.registerTimer(posted_ms + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        since = timerValues.getCurrentWatermarkInMs()
        named = key[0] is not None
        known = named and self.held.exists() and self.held.get()[0] >= since
        best = None
        for row in rows:
            posted = row[TIME]
            if posted is not None and posted < since * 1000:
                yield self.labelled(row, LATE)
            elif not named:
                yield self.labelled(row, NEW)
            elif not known:
                order = (posted is None, posted or 0, repr(tuple(row)))
                if best is None or order < best[0]:
                    best = (order, row)
        if best is not None:
            posted = best[1][TIME]
            dated = posted is not None
            self.hold(posted // 1000 if dated else since + self.horizon_ms, dated)
            yield self.labelled(best[1], NEW)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        since = timerValues.getCurrentWatermarkInMs()
        if self.held.exists():
            posted, dated = self.held.get()
            if posted < since:
                if dated or posted > self.horizon_ms:
                    self.held.clear()
                else:  # came without a time before any posting time was known
                    self.hold(since + self.horizon_ms, False)
        return iter(())

    def close(self) -> None:
        pass


def first_within_horizon(stream: DataFrame, hours: int) -> DataFrame:
    """All rows that are new or late, with the column ``output`` that says which.

    A row is late if its posting time lies more than ``hours`` before the latest one of earlier batches.
    Of the other rows of an id the earliest is new, unless the id was let through before with a time
    that still lies within the horizon; rows that tie are ordered by their columns.  Rows without an id
    are each new or late, and are spread over many groups.  A row without a posting time is never late;
    its id is held for a horizon from the latest time known.  Rows of one id in one batch are read as
    a stream by one task, which holds one of them.

    The clock column does not reach the stateful operator, which would drop late rows by itself.
    """
    columns = stream.columns
    taken = {KEY, SALT, TIME, CLOCK, OUTPUT} & set(columns)
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)} first")
    posted = F.col("date_posted").cast("timestamp")
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64(*columns), F.lit(UNNAMED_GROUPS)))
    timed = stream.withColumn(CLOCK, posted).withWatermark(CLOCK, f"{hours} hours")
    keyed = timed.select(
        *columns,
        F.col("id").cast("string").alias(KEY),
        F.coalesce(salt, F.lit(-1)).alias(SALT),
        F.unix_micros(posted).alias(TIME),
    )
    schema = StructType([*stream.schema.fields, StructField(OUTPUT, StringType())])
    return keyed.groupBy(KEY, SALT).transformWithState(
        FirstWithinHorizon(columns, hours * 3_600_000), schema, "Append", "EventTime"
    )


def recent_stream(
    stream: DataFrame, path: str, checkpoint: str, hours: int, trigger: dict | None = None
) -> StreamingQuery:
    """Write new and late rows into the folders ``output=new`` and ``output=late`` of ``path``.

    The file sink and the state commit together by batch.  The operator needs the RocksDB state store,
    so the query runs with it whatever the session says.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = first_within_horizon(stream, hours)
        return write_stream(out, path, checkpoint, trigger=trigger, partition_by=(OUTPUT,))
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def read_output(spark: SparkSession, path: str, schema: StructType, output: str = NEW) -> DataFrame:
    """What the stream let through, or the late rows; only that folder is opened."""
    full = StructType([*schema.fields, StructField(OUTPUT, StringType())])
    return spark.read.schema(full).parquet(path).where(F.col(OUTPUT) == output).drop(OUTPUT)
