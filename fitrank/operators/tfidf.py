"""Corpus statistics and the TF-IDF cosine of every posting with the profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitrank.functions.fixed_values import ENGLISH_STOP_WORDS
from fitrank.functions.text import is_scored_term, term_counts

BITS = 64  # of a long


def term_frequencies(
    docs: DataFrame,
    text: str = "description",
    key: str = "id",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """(key, term, tf) per document; counted inside the row, so nothing is shuffled."""
    pairs = docs.select(key, F.inline(term_counts(F.col(text))))
    return pairs.where(is_scored_term(F.col("term"), stop_words))


def document_frequencies(
    docs: DataFrame,
    profile: DataFrame | None = None,
    text: str = "description",
    key: str = "id",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """(term, df) over the corpus.  Partial counts leave each task, one row per term."""
    texts = docs.select(F.col(text).alias("text"))
    if profile is not None:
        texts = texts.union(profile.select("text"))
    pairs = texts.select(F.inline(term_counts(F.col("text"))))
    return (
        pairs.where(is_scored_term(F.col("term"), stop_words))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def _salt_count(docs: DataFrame) -> int:
    """Parts into which the rows of one term are split.

    A term found in every document has one of about a hundred pairs of each document, so a
    fraction of the shuffle partitions brings its parts down to the size of an average partition.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, partitions // 64)


def tfidf_scores(
    docs: DataFrame,
    profile: DataFrame,
    text: str = "description",
    key: str = "id",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    frequencies: DataFrame | None = None,
    n_docs: Column | None = None,
) -> DataFrame:
    """(key, score) for every document; the profile counts as a document of the corpus.

    weight = tf * (ln((1 + N) / (1 + df)) + 1), score = cosine of the weight vectors.

    The pairs of a document and a term are shuffled once by (term, salt) and once, as numbers
    only, by document.  The salt splits the rows of frequent terms.  Document frequencies come
    from the same shuffled pairs: counts per (term, salt), then a sum over the few salts of a
    term, which also notes in a bit set under which salts the term occurs.  The empty term, which every document carries, keeps documents without any other.
    ``key`` must be unique; documents without a key count in the corpus and get no score.  The
    profile is marked by a flag.

    Scores depend on the corpus.  To score new documents like earlier ones, pass the kept table
    of ``document_frequencies`` and the size ``n_docs`` of its corpus, the profile included;
    terms that the table does not hold are left out.
    """
    # The profile has no key and a salt of its own, by which it differs from documents without a key.
    parts = _salt_count(docs)
    # Never null, also for Spark, or a join by it would add a null test to one of the branches.
    salt = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(parts)).cast("int")
    salt = F.coalesce(salt, F.lit(0))
    corpus = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), salt.alias("salt")).union(
        profile.select(F.lit(None).cast(docs.schema[key].dataType), "text", F.lit(parts))
    )
    is_profile = F.col("doc").isNull() & (F.col("salt") == parts)
    unnamed = F.col("doc").isNull() & (F.col("salt") != parts)
    term = F.col("term")
    pairs = (
        corpus.select("doc", "salt", F.inline(term_counts(F.col("text"))))
        .where(term.isNotNull() & ((term == "") | is_scored_term(term, stop_words)))
        .repartition("term", "salt")
    )

    # Every branch reads all columns of the pairs and filters none of them, so that Spark runs
    # their shuffle once and reuses it.
    counts = pairs.groupBy("term", "salt").agg(
        F.count("tf").alias("df_part"),
        F.sum(F.when(is_profile, F.col("tf"))).alias("profile_part"),
    )
    # A bit for each salt, in as many longs as the parts and the salt of the profile take.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("salt") % BITS)
    words = [
        F.bit_or(F.when(F.floor(F.col("salt") / BITS) == word, bit)).alias(f"salts{word}")
        for word in range(parts // BITS + 1)
    ]
    terms = counts.groupBy("term").agg(
        F.sum("df_part").alias("df"),
        F.sum("profile_part").alias("profile_tf"),
        *words,
    )
    if frequencies is not None:
        terms = terms.drop("df").join(frequencies.select("term", "df"), "term", "left")
    # One row per salt under which a term occurs, as many as the counts had.
    bits = F.array(*[F.coalesce(F.col(f"salts{word}"), F.lit(0)) for word in range(len(words))])
    salts = F.filter(
        F.sequence(F.lit(0), F.lit(parts)),
        lambda i: F.getbit(F.get(bits, F.floor(i / BITS).cast("int")), i % BITS) == 1,
    )
    salted_terms = terms.select("term", F.explode(salts).alias("salt"), "df", "profile_tf")

    # idf = L + g with L = ln(1 + N) and g = 1 - ln(1 + df), so a sum of x * idf^2 is
    # L^2 * sum(x) + 2 * L * sum(x * g) + sum(x * g^2).  N is thus not needed before the last
    # step, where it is the number of documents that come out of this very aggregation.
    g = F.lit(1.0) - F.ln(F.lit(1.0) + F.coalesce(F.col("df"), F.lit(0)))
    counts_in = (F.col("term") != "") & F.col("df").isNotNull()
    tf = F.when(counts_in & ~unnamed, F.col("tf").cast("double")).otherwise(F.lit(0.0))
    wanted = F.coalesce(F.col("profile_tf"), F.lit(0)).cast("double")
    sums = (
        pairs.join(salted_terms.hint("shuffle_hash"), ["term", "salt"])
        .select(
            "doc",
            (F.col("term") == "").cast("int").alias("one"),
            (tf * tf).alias("x"),
            (tf * wanted).alias("y"),
            g.alias("g"),
        )
        .groupBy("doc")
        .agg(
            *[
                F.sum(F.col(v) * power).alias(f"{v}{i}")
                for v in ("x", "y")
                for i, power in enumerate((F.lit(1.0), F.col("g"), F.col("g") * F.col("g")))
            ],
            F.count("doc").alias("n"),
            F.sum("one").alias("rows"),
        )
    )

    def total(v: str, log_n: Column) -> Column:
        return log_n * log_n * F.col(f"{v}0") + F.lit(2.0) * log_n * F.col(f"{v}1") + F.col(f"{v}2")

    # The profile's own row: there x and y are the same.  Reading both, like the rows below do,
    # lets Spark reuse the shuffle by document.
    log_n = F.ln(F.lit(1.0) + F.col("n_docs"))
    corpus_size = F.sum("rows") if n_docs is None else F.max(n_docs)
    figures = [c for c in sums.columns if c not in ("doc", "n", "rows")]
    stats = (
        sums.agg(
            corpus_size.alias("n_docs"),
            *[F.max(F.when(F.col("n") == 0, F.col(c))).alias(c) for c in figures],
        )
        .select(
            F.struct(
                log_n.alias("log_n"),
                F.sqrt((total("x", log_n) + total("y", log_n)) / 2).alias("profile_length"),
            )
        )
        .scalar()
    )
    # As one column the subquery is planned once and not once per use.
    finished = sums.where(F.col("n") > 0).withColumn("stats", stats)
    log_n = F.col("stats.log_n")
    length = F.sqrt(total("x", log_n)) * F.col("stats.profile_length")
    score = F.try_divide(total("y", log_n), length)
    # Rows without a key are gone.  Said to Spark in this way, a later join
    # by key does not push a null test into one of the branches and so undo the shared shuffle.
    doc = F.coalesce(F.col("doc"), F.lit("0").cast(docs.schema[key].dataType))
    return finished.select(doc.alias(key), F.coalesce(score, F.lit(0.0)).alias("score"))


def tfidf_cosine(
    postings: DataFrame,
    profile: DataFrame,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    column: str = "tfidf_cosine_score",
    frequencies: DataFrame | None = None,
    n_docs: Column | None = None,
) -> DataFrame:
    """Add the TF-IDF cosine with the profile; the join by id moves one number per posting."""
    scores = tfidf_scores(
        postings, profile, stop_words=stop_words, frequencies=frequencies, n_docs=n_docs
    )
    return postings.join(scores.withColumnRenamed("score", column), "id", "left")
