"""One ingest run: searches over the pool, caps, filters, widening, repost removal, state."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitrank.config import FilterRules, Lookback, Search
from fitrank.operators.filters import filter_funnel, filter_seen, row_predicates
from fitrank.operators.lookback import chosen_pass, with_pass, within_chosen
from fitrank.operators.ranking import first_per_key, join_searches, topn_per_search
from fitrank.functions.text import norm_key
from fitrank.session import new_scratch
from fitrank.sources.postings import write_postings
from fitrank.sources.seen import write_run_ids

TEXT_KEY = "_text_key"


def fetch(
    pool: DataFrame,
    searches: Sequence[Search],
    rules: FilterRules,
    as_of: Column,
    lookback: Lookback,
) -> DataFrame:
    """What the searches return, as narrow rows: the newest matches of each search.

    Every search starts at its own window (``hours_old``) and widens by the steps of ``lookback``; it
    is tested by its own rules if it has some.  The texts are tested at the scan and only the outcome
    ``passes`` moves on, with a hash that finds the text again.  The cap per search comes before the
    filters, as a search returns its newest matches whatever is done with them.  A cap on the widest
    window also holds the capped results of every narrower one.
    """
    steps = lookback.last_pass if lookback.minimum > 0 else 0
    widest = [s.at_hours(s.hours_old + steps * lookback.step) for s in searches]
    hits = join_searches(pool, widest, as_of)

    def tests(own: FilterRules) -> Column:
        return reduce(Column.__and__, row_predicates(own).values(), F.lit(True))

    passes = tests(rules)
    for s in searches:
        if s.rules:
            passes = F.when(F.col("search_no") == s.search_no, tests(s.rules)).otherwise(passes)
    narrow = hits.withColumn("passes", passes)
    if "description" in pool.columns:
        narrow = narrow.withColumn(TEXT_KEY, F.xxhash64("description")).drop("description")
    largest = max(s.results_per_source for s in searches)
    starts = F.create_map(*[F.lit(x) for s in searches for x in (s.search_no, s.hours_old)])
    capped = topn_per_search(narrow, largest=largest)
    own = capped.withColumn("start_hours", F.element_at(starts, F.col("search_no")))
    return with_pass(own, as_of, lookback, F.col("start_hours"))


def fresh_rows(fetched: DataFrame, seen: DataFrame, rules: FilterRules) -> DataFrame:
    """Rows that pass all tests; whether seen ids count is a matter of the common rules."""
    passed = fetched.where("passes").drop("passes")
    return passed if "seen" in rules.disabled else filter_seen(passed, seen)


def with_text(kept: DataFrame, pool: DataFrame) -> DataFrame:
    """Join the description to the survivors.

    A row is found again by its id, which may be missing or repeated, and the hash of its text.  Both
    are in the pool, so the join is an inner one and Spark may send the few survivors to the pool
    instead of moving its texts.  Survivors are unique by title and company; equal rows of the pool
    that both answer to one are made one again.
    """
    if "description" not in pool.columns:
        return kept
    texts = pool.select(
        F.col("id").alias("_id"), F.xxhash64("description").alias("_text"), "description"
    )
    same = kept["id"].eqNullSafe(texts["_id"]) & (kept[TEXT_KEY] == texts["_text"])
    keys = {"_title": norm_key(F.col("title")), "_company": norm_key(F.col("company"))}
    joined = kept.join(texts, same).withColumns(keys).dropDuplicates(list(keys))
    return joined.drop("_id", "_text", TEXT_KEY, *keys)


def new_postings(
    pool: DataFrame,
    searches: Sequence[Search],
    rules: FilterRules,
    seen: DataFrame,
    as_of: Column,
    lookback: Lookback | None = None,
) -> DataFrame:
    """Postings that are new, pass all filters and are no repost, over all searches."""
    lookback = lookback or Lookback(start=searches[0].hours_old)
    fetched = fetch(pool, searches, rules, as_of, lookback)
    kept = within_chosen(fresh_rows(fetched, seen, rules), lookback, ("search_no", "id"))
    return with_text(kept, pool)


def ingest_funnel(
    pool: DataFrame,
    searches: Sequence[Search],
    rules: FilterRules,
    seen: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Rows before and after each filter for what the searches return; nothing is written.

    With ``new_postings`` and ``preview`` this is the dry run of ``run_ingest`` in its first window.
    Rules of single searches are not counted.
    """
    hits = join_searches(pool, searches, as_of)
    largest = max(s.results_per_source for s in searches)
    capped = topn_per_search(hits, largest=largest)
    return filter_funnel(capped, rules, seen)


def run_ingest(
    pool: DataFrame,
    searches: Sequence[Search],
    rules: FilterRules,
    seen: DataFrame,
    as_of: Column,
    out_path: str,
    seen_path: str,
    lookback: Lookback | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Write new postings, the ids of everything fetched, and the manifest that commits both.

    A run that breaks off before its manifest has written nothing that ``read_run`` or ``read_seen``
    would take.  Run again, under the same ``run_id`` or another, it loses no posting and repeats none;
    under the same one it replaces what it left.  ``seen`` is to come from ``read_seen``.

    The narrow fetched rows are written to the shared folder once, as both the output and the
    state derive from them.
    """
    spark = pool.sparkSession
    run = run_id or uuid.uuid4().hex
    lookback = lookback or Lookback(start=searches[0].hours_old)
    scratch = new_scratch(spark, "fetched")
    fetch(pool, searches, rules, as_of, lookback).write.parquet(scratch)
    fetched = spark.read.parquet(scratch)

    fresh = fresh_rows(fetched, seen, rules)
    kept = within_chosen(fresh, lookback, ("search_no", "id"))
    firsts = first_per_key(fresh, ("pass_no", "search_no", "id"))
    chosen = chosen_pass(firsts, lookback).scalar()

    def write_ids() -> None:
        write_run_ids(fetched.where(F.col("pass_no") <= chosen), seen, seen_path, out_path, run)

    return write_postings(
        with_text(kept, pool), out_path, searches, run_id=run, before_commit=write_ids
    )
