"""Ingest predicates, their composition and the row funnel.

Every predicate but ``filter_seen`` is a column over one row, so a chain of them is one filter at
the scan.  They are written as columns first and as DataFrame operators second.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitrank.config import FilterRules
from fitrank.functions.text import contains_any, norm_key


def not_blocked_company(names: Sequence[str]) -> Column:
    return ~norm_key(F.col("company")).isin([n.strip().lower() for n in names])


def remote_matches(is_remote: bool) -> Column:
    """An unknown flag passes."""
    return F.col("is_remote").isNull() | (F.col("is_remote") == F.lit(is_remote))


def posted_since(as_of: Column, hours: int | Column) -> Column:
    span = F.make_dt_interval(hours=F.lit(hours).cast("int") if isinstance(hours, int) else hours)
    return F.col("date_posted") >= as_of - span


def row_predicates(rules: FilterRules) -> dict[str, Column]:
    """The active one-row predicates by filter name, in funnel order."""
    location = norm_key(F.col("location"))
    description = F.col("description")
    found = {}
    if rules.company_blocklist:
        found["company_blocklist"] = not_blocked_company(rules.company_blocklist)
    if rules.title_blocklist:
        found["title_blocklist"] = ~contains_any(F.col("title"), rules.title_blocklist)
    if rules.title_allowlist:
        found["title_allowlist"] = contains_any(F.col("title"), rules.title_allowlist)
    if rules.required_locations:
        found["location"] = contains_any(location, rules.required_locations, strip=True)
    if rules.excluded_locations:
        found["location_exclusion"] = ~contains_any(location, rules.excluded_locations, strip=True)
    if rules.is_remote is not None:
        found["remote"] = remote_matches(rules.is_remote)
    if rules.description_blocklist:
        found["description_blocklist"] = ~contains_any(description, rules.description_blocklist)
    if rules.description_allowlist:
        found["description_allowlist"] = contains_any(description, rules.description_allowlist)
    return {name: test for name, test in found.items() if name not in rules.disabled}


def filter_seen(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings whose id is not in the seen table.

    Both sides may be large, so no side is broadcast by hand: the size-based choice and the
    splitting of skewed partitions are left to adaptive execution.
    """
    ids = seen.select(F.col("id").cast("string").alias("_seen_id"))
    return postings.join(ids, F.col("id").cast("string") == F.col("_seen_id"), "left_anti")


def filter_company_blocklist(postings: DataFrame, blocked: Sequence[str] | DataFrame) -> DataFrame:
    """Exact match on the normalised company; long lists come as a table with ``keyword``."""
    if isinstance(blocked, DataFrame):
        keys = blocked.select(norm_key(F.col("keyword")).alias("_blocked")).distinct()
        return postings.join(keys, norm_key(F.col("company")) == F.col("_blocked"), "left_anti")
    return postings.where(not_blocked_company(blocked)) if blocked else postings


def _by_rules(postings: DataFrame, **lists) -> DataFrame:
    tests = list(row_predicates(FilterRules(**lists)).values())
    return postings.where(reduce(Column.__and__, tests)) if tests else postings


def filter_title_blocklist(postings: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return _by_rules(postings, title_blocklist=tuple(keywords))


def filter_title_allowlist(postings: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return _by_rules(postings, title_allowlist=tuple(keywords))


def filter_location_required(postings: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return _by_rules(postings, required_locations=tuple(keywords))


def filter_location_excluded(postings: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return _by_rules(postings, excluded_locations=tuple(keywords))


def filter_remote(postings: DataFrame, is_remote: bool) -> DataFrame:
    return _by_rules(postings, is_remote=is_remote)


def filter_description_blocklist(postings: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return _by_rules(postings, description_blocklist=tuple(keywords))


def filter_description_allowlist(postings: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return _by_rules(postings, description_allowlist=tuple(keywords))


def filter_window(postings: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Postings of the last ``hours`` hours before ``as_of`` (a literal or scalar subquery)."""
    return postings.where(posted_since(as_of, hours))


def filter_job_type(postings: DataFrame, job_type: str) -> DataFrame:
    return postings.where(F.col("job_type") == job_type) if job_type else postings


def filter_chain(postings: DataFrame, rules: FilterRules, seen: DataFrame | None = None) -> DataFrame:
    """All active predicates as one filter at the scan, then the anti join against seen ids.

    The order of a conjunction does not matter to the result, so the cheap row tests run before
    the shuffle that the join may need.
    """
    tests = list(row_predicates(rules).values())
    kept = postings.where(reduce(Column.__and__, tests)) if tests else postings
    if seen is not None and "seen" not in rules.disabled:
        kept = filter_seen(kept, seen)
    return kept


# Longest keyword list of a table, in entries, that is sent to every task; longer ones are joined.
WORDS_LIMIT = 10_000
# Lists by name: the column they test and whether a hit lets a posting pass.
TABLE_LISTS = {
    "title_blocklist": ("title", False),
    "title_allowlist": ("title", True),
    "required_locations": ("location", True),
    "excluded_locations": ("location", False),
    "description_blocklist": ("description", False),
    "description_allowlist": ("description", True),
}


def held_in(text: Column, words: Column) -> Column:
    """Whether a text holds at least one word of an array."""
    return F.exists(words, lambda word: text.contains(word))


def filter_by_tables(postings: DataFrame, lists: DataFrame) -> DataFrame:
    """The keyword filters with their lists as a table (``list_name``, ``keyword``).

    The words of a list of up to ``WORDS_LIMIT`` entries are one array that a subquery gives to the
    scan; a longer list is joined by ``keyword_join``, with the same result.  Lists have any length.
    An empty list lets all pass; empty keywords, and lists for a column that the postings don't have,
    are left out.  The company list is matched exactly by a join.
    """
    from fitrank.operators.keyword_join import filter_by_keyword_table  # it uses this module

    keyword = F.lower(F.trim("keyword"))
    names = lists.where(keyword != "").groupBy("list_name").count().where(F.col("count") > WORDS_LIMIT)
    long = {row.list_name for row in names.where(F.col("list_name").isin([*TABLE_LISTS])).collect()}
    for name, (column, passes) in TABLE_LISTS.items():
        if column not in postings.columns:
            continue
        own = lists.where((F.col("list_name") == name) & (keyword != ""))
        if name in long:
            postings = filter_by_keyword_table(postings, own, column, passes)
            continue
        word = keyword if column == "location" else F.lower("keyword")
        words = F.collect_set(word)
        text = norm_key(F.col(column)) if column == "location" else F.coalesce(F.lower(column), F.lit(""))
        # A subquery may not stand inside an array function, so it becomes a column first.
        given = postings.withColumn("_words", own.agg(words.alias("words")).scalar())
        hit = held_in(text, F.col("_words"))
        keep = (F.size("_words") == 0) | hit if passes else ~hit
        postings = given.where(keep).drop("_words")
    return filter_company_blocklist(postings, lists.where(F.col("list_name") == "company_blocklist"))


def filter_funnel(postings: DataFrame, rules: FilterRules, seen: DataFrame) -> DataFrame:
    """Rows before and after each filter and the final repost removal, in one pass.

    Row tests become booleans at the scan, so no text is shuffled.  Rows are first added up per
    repost key, which is also what tells how many distinct keys survive.
    """
    tests = row_predicates(rules)
    flags = postings.select(
        F.col("id").cast("string").alias("id"),
        norm_key(F.col("title")).alias("_title"),
        norm_key(F.col("company")).alias("_company"),
        *[test.alias(name) for name, test in tests.items()],
    )
    names = list(tests)
    if "seen" not in rules.disabled:
        ids = seen.select(F.col("id").cast("string").alias("id")).distinct()
        marked = ids.withColumn("_hit", F.lit(True))
        flags = flags.join(marked, "id", "left").withColumn("seen", F.col("_hit").isNull())
        names = ["seen", *names]

    passed = F.lit(True)
    sums = [F.count(F.lit(1)).alias("n0")]
    for i, name in enumerate(names, 1):
        passed = passed & F.col(name)
        sums.append(F.count_if(passed).alias(f"n{i}"))
    last = f"n{len(names)}"
    totals = (
        flags.groupBy("_title", "_company")
        .agg(*sums)
        .agg(
            *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(names) + 1)],
            F.count_if(F.col(last) > 0).alias("kept"),
        )
    )
    steps = [
        F.struct(
            F.lit(i).alias("step_no"),
            F.lit(name).alias("filter_name"),
            F.col(f"n{i - 1}").alias("rows_before"),
            F.col(f"n{i}").alias("rows_after"),
        )
        for i, name in enumerate(names, 1)
    ]
    steps.append(
        F.struct(
            F.lit(len(names) + 1).alias("step_no"),
            F.lit("reposts").alias("filter_name"),
            F.col(last).alias("rows_before"),
            F.col("kept").alias("rows_after"),
        )
    )
    return totals.select(F.inline(F.array(*steps)))
