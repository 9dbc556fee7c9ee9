r"""Large JSON files that hold one list of objects, read by many tasks.

Spark reads a list file in one task, since a place inside it does not tell whether it lies in a text
or how deep it is nested.  Here the file is read as lines that end at ``}``, which Spark splits into
blocks like any text.  Each piece is read twice over, as if it began outside and inside of a text; what
it would add to the state is summed up within its block, and the sums of the blocks, one row each, give
the state in which every block really begins.  With it the ends of the records are known, and the
pieces of a record meet by its number, also across blocks.

Escapes never straddle pieces, as ``\}`` is none.  Pieces are written to the shared folder once.  A file
that isn't a whole list of objects, or an object that doesn't fit the types, is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitrank.session import new_scratch

STARTS = (0, 1)  # outside and inside of a text
FULL_END = r"\A\s*(\[\s*)?\]\s*\z"


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def pieces_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Each piece with the number of quotes, and for either start how it changes the depth."""
    lines = spark.read.option("lineSep", "}").text(path)
    pieces = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", r"(?s)\\.", "").alias("plain"),
    ).withColumn("quotes", _count(F.col("plain"), '"'))
    for start in STARTS:
        text = F.concat(F.lit('"' * start), F.col("plain"))
        opens = _count(F.regexp_replace(text, '"[^"]*("|$)', ""), "{")
        closes = ((F.col("quotes") + start) % 2 == 0).cast("int")
        pieces = pieces.withColumns({f"opens{start}": opens, f"closes{start}": closes})
    return pieces.drop("plain")


def _chosen(start: Column, name: str) -> Column:
    """The value of a column pair for a start that is 0 or 1."""
    return F.when(start == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))


def _within_blocks(pieces: DataFrame) -> DataFrame:
    """For either start of the block: how each piece closes, and the depth after it."""
    by_block = Window.partitionBy("file", "block").orderBy("at")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    rows = pieces.withColumn("inner", inner)
    for start in STARTS:
        own = (F.col("inner") + start) % 2
        rows = rows.withColumns(
            {f"open{start}": _chosen(own, "opens"), f"close{start}": _chosen(own, "closes")}
        )
    deeper = {
        f"depth{start}": F.sum(F.col(f"open{start}") - F.col(f"close{start}")).over(
            by_block.rowsBetween(Window.unboundedPreceding, 0)
        )
        for start in STARTS
    }
    columns = ["file", "block", "at", "value", "quotes"]
    pairs = [f"{name}{start}" for name in ("open", "close", "depth") for start in STARTS]
    return rows.withColumns(deeper).select(*columns, *pairs)


def _sum_before(column: Column) -> Column:
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def read_json_list(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The objects of list files as rows; the order of the list isn't kept."""
    scratch = new_scratch(spark, "pieces")
    _within_blocks(pieces_of(spark, path)).write.parquet(scratch)
    pieces = spark.read.parquet(scratch)
    block = ["file", "block"]

    blocks = pieces.groupBy(*block).agg(
        F.sum("quotes").alias("quotes"),
        *[F.max_by(f"depth{s}", "at").alias(f"depth{s}") for s in STARTS],
        F.max_by(F.col("value").rlike(FULL_END), "at").alias("complete"),
    )
    is_last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    broken = F.raise_error(F.concat(F.lit("not a whole JSON list: "), "file")).cast("bigint")
    starts = (
        blocks.withColumn("start", _sum_before(F.col("quotes")) % 2)
        .withColumn("start", F.when(is_last & ~F.col("complete"), broken).otherwise(F.col("start")))
        .withColumn("start_depth", _sum_before(_chosen(F.col("start"), "depth")))
        .select(*block, "start", "start_depth")
    )
    depth = F.col("start_depth") + _chosen(F.col("start"), "depth")
    state = pieces.join(starts, block).withColumns(
        {
            "opens": _chosen(F.col("start"), "open"),
            "ends": ((depth == 0) & (_chosen(F.col("start"), "close") == 1)).cast("int"),
        }
    )
    numbered = state.groupBy(*block).agg(F.sum("ends").alias("ends"))
    numbered = numbered.select(*block, _sum_before(F.col("ends")).alias("records_before"))

    own = Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("ends").over(own), F.lit(0))
    records = (
        state.select(*block, "at", "value", "opens", before.alias("before"))
        .join(numbered, block)
        .groupBy("file", (F.col("records_before") + F.col("before")).alias("record"))
        .agg(
            F.sum("opens").alias("opens"),
            F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("pieces"),
        )
        .where(F.col("opens") > 0)
    )
    text = F.concat(F.array_join(F.col("pieces.value"), "}"), F.lit("}"))
    text = F.regexp_replace(text, r"\A[\s,\[]+", "")
    return records.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
