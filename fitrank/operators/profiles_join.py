"""The best postings for each of many profiles by TF-IDF cosine, without scoring all pairs.

Vectors are sparse, of length one, and have no negative weight.  For a profile each term has an upper
bound: its weight there times the largest weight in any posting.  The bounds of a profile's weakest
terms, added up, show what a posting without any other term can reach.  If that is below the k-th best
score, such postings need not be looked at, so postings are met through the other, essential terms only.

1. The rarest terms of a profile, while together in at most ``SEED`` times k postings, give partial
   scores.  The k-th best of them is a threshold: full scores are no lower.
2. Postings meet profiles by an equi-join on essential terms.  Pairs whose partial score and the bound
   of all other terms stay below the threshold leave.
3. The other terms of the remaining pairs are added, and the best k of each profile stay.  A pair meets
   the terms of its profile, which are few, and not all terms of its posting.

A term that is in most postings has a small weight everywhere and so is hardly ever essential; where it
is, adaptive skew handling splits its rows.  The texts are split into terms once; their counts, the
document frequencies and the vectors are written to the shared folder, as several steps read them.  Of the
vectors only the terms that some profile has are kept; their length is that of all terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitrank.functions.fixed_values import ENGLISH_STOP_WORDS
from fitrank.operators.tfidf import term_frequencies
from fitrank.session import new_scratch

SEED = 100
DIGITS = 9  # scores are compared at so many digits
SLACK = 10.0**-DIGITS


def unit_vectors(counts: DataFrame, key: str, frequencies: DataFrame, n_docs: Column) -> DataFrame:
    """``key, term, weight`` with tf * (ln((1 + N) / (1 + df)) + 1), each key of length one.

    Other columns of ``frequencies`` come along.
    """
    known = counts.join(frequencies, "term", "left").withColumn("n", n_docs)
    idf = F.ln((1.0 + F.col("n")) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    more = [c for c in frequencies.columns if c not in ("term", "df")]
    raw = known.select(key, "term", (F.col("tf") * idf).alias("raw"), *more)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / length).alias("weight"), *more)


def best_of(scores: DataFrame, k: int, profile_key: str, key: str) -> DataFrame:
    order = Window.partitionBy(profile_key).orderBy(F.desc(F.round("score", DIGITS)), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_postings(
    postings: DataFrame,
    profiles: DataFrame,
    k: int,
    text: str = "description",
    key: str = "id",
    profile_text: str = "text",
    profile_key: str = "profile_id",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    frequencies: DataFrame | None = None,
    n_docs: Column | None = None,
) -> DataFrame:
    """``profile_key, rank, key, score`` of the k postings most like each profile.

    The corpus is that of the postings, so the scores of a profile do not depend on the other profiles;
    kept ``frequencies`` and ``n_docs`` may be given instead.  Scores are compared at nine digits and
    ties ordered by key.  Postings that share no term with a profile are none of its results.  Keys are
    unique; rows without a key, and texts that are null or without terms, are left out.
    """
    spark = postings.sparkSession

    def kept(rows: DataFrame, label: str) -> DataFrame:
        path = new_scratch(spark, label)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    counts = kept(term_frequencies(postings, text, key, stop_words), "term-counts")
    if frequencies is None:
        frequencies = kept(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
        n_docs = postings.agg(F.count(F.lit(1))).scalar()
    frequencies = frequencies.select("term", "df")
    asked = term_frequencies(profiles.where(F.col(profile_key).isNotNull()), profile_text, profile_key, stop_words)
    asked = kept(asked, "profile-counts")
    in_profiles = asked.select("term").distinct().withColumn("asked", F.lit(True))
    marked = frequencies.join(in_profiles, "term", "full")
    named = counts.where(F.col(key).isNotNull())
    vectors = kept(unit_vectors(named, key, marked, n_docs).where("asked").drop("asked"), "vectors")

    wanted = unit_vectors(asked, profile_key, frequencies, n_docs).withColumnRenamed("weight", "wanted")
    held = vectors.groupBy("term").agg(F.max("weight").alias("most"), F.count("*").alias("df"))
    by_profile = Window.partitionBy(profile_key)
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    bound = F.col("wanted") * F.col("most")
    terms = wanted.join(held, "term").select(
        profile_key,
        "term",
        "wanted",
        F.sum("df").over(by_profile.orderBy("df", "term").rowsBetween(*up_to_here)).alias("postings"),
        F.sum(bound).over(by_profile.orderBy(bound, "term").rowsBetween(*up_to_here)).alias("reach"),
    )
    terms = kept(terms, "profile-terms")

    def met(some: DataFrame) -> DataFrame:
        """Scores of the pairs that share one of the given terms, by these terms."""
        part = F.sum(F.col("wanted") * F.col("weight")).alias("score")
        return vectors.join(some, "term").groupBy(profile_key, key).agg(part)

    seeds = terms.where(F.col("postings") <= SEED * k).select(profile_key, "term", "wanted")
    full = best_of(met(seeds), k, profile_key, key).groupBy(profile_key).agg(
        F.min("score").alias("threshold"), F.count("*").alias("found")
    )
    thresholds = full.where(F.col("found") == k).select(profile_key, (F.col("threshold") - 2 * SLACK).alias("threshold"))
    judged = terms.join(thresholds, profile_key, "left").select(
        profile_key,
        "term",
        "wanted",
        "reach",
        F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
    )
    judged = kept(judged.withColumn("essential", F.col("reach") >= F.col("threshold")), "thresholds")
    essential, other = judged.where("essential"), judged.where(~F.col("essential"))

    limits = judged.groupBy(profile_key).agg(
        F.max("threshold").alias("threshold"), F.coalesce(F.max(F.when(~F.col("essential"), F.col("reach"))), F.lit(0.0)).alias("rest")
    )
    pairs = met(essential.select(profile_key, "term", "wanted")).join(limits, profile_key)
    reached = pairs.where(F.col("score") + F.col("rest") >= F.col("threshold"))
    pairs = kept(reached.select(profile_key, key, "score"), "pairs")
    more = (
        pairs.select(profile_key, key)
        .join(other.select(profile_key, "term", "wanted"), profile_key)
        .join(vectors, [key, "term"])
        .select(profile_key, key, (F.col("wanted") * F.col("weight")).alias("score"))
    )
    scores = pairs.union(more).groupBy(profile_key, key).agg(F.sum("score").alias("score"))
    return best_of(scores, k, profile_key, key).select(profile_key, "rank", key, "score")
