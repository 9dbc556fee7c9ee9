"""Widening of the time window without a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitrank.config import Lookback
from fitrank.operators.ranking import first_per_key


def with_pass(
    postings: DataFrame, as_of: Column, lookback: Lookback, start: Column | None = None
) -> DataFrame:
    """Add ``pass_no``, the first widening at which a posting falls into the window.

    ``start`` is the width of the first window where it differs from row to row.

    Postings beyond the last allowed widening drop out.
    """
    age_us = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(
        F.col("date_posted").cast("timestamp")
    )
    age = age_us / F.lit(3_600_000_000.0)
    first = F.lit(lookback.start) if start is None else start
    pass_no = F.greatest(F.lit(0), F.ceil((age - first) / lookback.step)).cast("int")
    last = 0 if lookback.minimum <= 0 else lookback.last_pass
    return postings.withColumn("pass_no", pass_no).where(F.col("pass_no") <= last)


def chosen_pass(firsts: DataFrame, lookback: Lookback) -> DataFrame:
    """One row ``chosen``: the first pass with enough distinct postings, else the last one.

    ``firsts`` holds one row per posting with its earliest pass.  The running total goes over one
    row per pass, a number set by the arguments and not by the data.
    """
    per_pass = firsts.groupBy("pass_no").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("pass_no"))
    enough = F.when(F.col("total") >= lookback.minimum, F.col("pass_no"))
    last = 0 if lookback.minimum <= 0 else lookback.last_pass
    return per_pass.withColumn("total", running).agg(
        F.coalesce(F.min(enough), F.lit(last)).alias("chosen")
    )


def within_chosen(
    passes: DataFrame,
    lookback: Lookback,
    order_by: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Distinct postings up to the chosen pass, of rows that carry ``pass_no``.

    The earliest row of a posting does not depend on the pass that is chosen.  So reposts are
    removed first, once, and the choice and the result are read off that one shuffle.  Adds
    ``hours_old``, the width of the window that was used in the end.
    """
    order = ("pass_no", *order_by)
    firsts = first_per_key(passes, order)
    kept = firsts.withColumn("_chosen", chosen_pass(firsts, lookback).scalar()).where(
        F.col("pass_no") <= F.col("_chosen")
    )
    own = "start_hours" in passes.columns  # each search has its own first window
    start = F.col("start_hours") if own else F.lit(lookback.start)
    hours = start + F.col("_chosen") * F.lit(lookback.step)
    return kept.withColumn("hours_old", hours).drop("_chosen", "start_hours")


def adaptive_lookback(
    filtered: DataFrame,
    as_of: Column,
    lookback: Lookback,
    order_by: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Distinct postings of the smallest window that yields ``lookback.minimum`` of them.

    Input rows are those that passed all filters.
    """
    return within_chosen(with_pass(filtered, as_of, lookback), lookback, order_by)
