"""First-per-key, top-n-per-key, ordering, unions and the application of searches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitrank.config import Search
from fitrank.functions.text import contains_any, norm_key
from fitrank.operators.filters import posted_since, remote_matches


# Long texts: they take part in the order of equal rows by a hash, and move only if they are selected.
WIDE = ("description",)


def unused(base: str, columns: Sequence[str]) -> str:
    """A column name that is not among the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while base in taken:
        base += "_"
    return base


def first_rows(
    df: DataFrame, keys: Sequence[Column], order_by: Sequence[str], wide: Sequence[str] = WIDE
) -> DataFrame:
    """The first row per key, in ``order_by`` and then in the other columns, texts by their hash last.

    Each task sends at most one row per key into the shuffle, so a key that holds most rows costs no more
    than any other.  The texts are aggregates of their own beside the narrow row: a plan that does not
    select them neither sorts nor shuffles them.  Rows that are equal in all columns are one.
    """
    texts = [c for c in df.columns if c in wide and c not in order_by]
    rest = [c for c in df.columns if c not in texts and c not in order_by]
    last = unused("_text_hash", df.columns)
    hashes = [F.xxhash64(*[F.struct(F.col(c)) for c in texts]).alias(last)] if texts else []
    row = F.struct(*order_by, *rest, *hashes)
    named = [k.alias(unused(f"_key_{i}", df.columns)) for i, k in enumerate(keys)]
    first = df.groupBy(*named).agg(
        F.min(row).alias("_first"), *[F.min_by(c, row).alias(f"_wide_{i}") for i, c in enumerate(texts)]
    )
    found = {c: F.col(f"_wide_{i}").alias(c) for i, c in enumerate(texts)}
    return first.select(*[found.get(c, F.col("_first")[c].alias(c)) for c in df.columns])


def unique_ids(postings: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per id, for pools that hold copies; rows without an id are all kept.

    Of the rows of an id the first in ``order_by`` stays; rows that are equal there are ordered by
    their other columns, so the choice does not depend on the run.
    """
    named = postings.where(F.col("id").isNotNull())
    unnamed = postings.where(F.col("id").isNull())
    return first_rows(named, [F.col("id")], order_by).union(unnamed)


def first_per_key(postings: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """First row per normalised (title, company), whole.

    Rows that are equal in ``order_by``, as with repeated or missing ids, are ordered by their other
    columns; no row is joined back.
    """
    return first_rows(postings, [norm_key(F.col("title")), norm_key(F.col("company"))], order_by)


def dedup_reposts(postings: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """First posting per normalised (title, company) in the order given."""
    return first_per_key(postings, order_by).select(postings.columns)


FAN_IN = 256


def topn_per_search(
    hits: DataFrame,
    n: int | str = "results_per_source",
    largest: int | None = None,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """At most ``n`` newest postings per search; ``n`` may name a column of the search.

    ``largest`` is the greatest value of that column.  Being a constant, it lets Spark cut each
    task's rows to it before the shuffle; a constant ``n`` does so by itself.

    Three stages rank within (search, input partition), (search, ``fan_in`` partitions) and the
    search.  A search that matches a third of all rows is spread over the input partitions, and no
    task merges the best rows of more than ``fan_in`` groups, up to ``fan_in`` squared partitions,
    whatever ``n`` and the number of shuffle partitions are.  Rows of equal date and id, as with missing
    or repeated ids, are ordered by a hash of the row, so the cut does not depend on the run; leave texts that are not
    needed out, as the hash reads them.
    """
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    constant = n if isinstance(n, int) else largest
    order = [F.col("date_posted").desc_nulls_last(), F.col("id"), F.xxhash64(*hits.columns)]

    def best(df: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = df.withColumn("_rank", rank)
        if constant is not None:
            ranked = ranked.where(F.col("_rank") <= constant)
        return ranked.where(F.col("_rank") <= limit).drop("_rank")

    spread = hits.withColumn("_group", F.spark_partition_id())
    few = best(spread, "search_no", "_group")
    fewer = best(few.withColumn("_group", F.floor(F.col("_group") / fan_in)), "search_no", "_group")
    return best(fewer.drop("_group"), "search_no")


def rank_by_score(df: DataFrame, score: str = "final_score", key: str = "id") -> DataFrame:
    """Best first, missing scores last, ties by key."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(key))


def topk_report(df: DataFrame, k: int, score: str = "final_score", key: str = "id") -> DataFrame:
    """The k best rows; runs as a per-task top-k and one merge."""
    return rank_by_score(df, score, key).limit(k)


def preview(df: DataFrame, key: str = "id", rows: int = 5) -> DataFrame:
    """First rows of a run that is not saved."""
    return df.orderBy(key).limit(rows)


def union_searches(parts: Sequence[DataFrame]) -> DataFrame:
    """Results of several searches by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_seen(seen: DataFrame, raw: DataFrame) -> DataFrame:
    """Seen ids and all ids fetched in this run."""
    ids = raw.select(F.col("id").cast("string").alias("id")).where(F.col("id").isNotNull())
    return seen.select(F.col("id").cast("string").alias("id")).union(ids).distinct()


def blocklist_union(shared: DataFrame, own: DataFrame) -> DataFrame:
    """Shared and own keyword tables; own entries add to the shared ones and never replace them."""
    return shared.select("list_name", "keyword").union(own.select("list_name", "keyword")).distinct()


def search_condition(search: Search, as_of: Column) -> Column:
    """Whether a posting answers a search; location, job type and term apply if given."""
    tests = [remote_matches(search.is_remote), posted_since(as_of, search.hours_old)]
    if search.search_term:
        tests.append(contains_any(F.col("title"), [search.search_term]))
    if search.location:
        tests.append(contains_any(F.col("location"), [search.location], strip=True))
    if search.job_type:
        tests.append(F.col("job_type") == search.job_type)
    return reduce(Column.__and__, tests)


def join_searches(postings: DataFrame, searches: Sequence[Search], as_of: Column) -> DataFrame:
    """Every (posting, search) pair that matches.

    The searches are a short list given by the caller, so they are part of the plan and not a
    table: each posting carries the array of searches it answers, which is then exploded.  The
    whole operator is one narrow stage without join or shuffle, and rows that answer no search
    leave before the explode.
    """
    matched = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(search_condition(s, as_of), F.lit(False)),
                    F.struct(
                        F.lit(s.search_no).alias("search_no"),
                        F.lit(s.search_term).alias("search_term"),
                        F.lit(s.results_per_source).alias("results_per_source"),
                    ),
                )
                for s in searches
            ]
        )
    )
    return postings.select("*", F.inline(matched))
