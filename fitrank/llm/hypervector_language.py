"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, derived from its code point.  A run of three letters is
bound into one vector by permuting (rotating) the first letter's vector by two places, the second's
by one, and multiplying all three.  A text is the sum of its n-gram vectors; a language prototype is
the sum over its training texts.  A text gets the language with the largest cosine.

Runs of anything but letters count as one blank, at the ends of a text too.  All sums are of whole
numbers and so don't depend on the order or partitioning of the rows.

Whether a text is in one of the languages at all is told by its cosine where the text has enough
n-grams for that, see ``least_scores``, and by its letters where it is shorter.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text
if there is nothing to learn from; ties go to the language that sorts first; rows without a label
teach nothing; null ids stay null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from fitrank.llm.batches import as_batch, columns_apart, hash_place, hash_share, narrow, text_slices
from fitrank.llm.scratch import settle, small_batches

DIMENSIONS = 1024
UNKNOWN = "und"
# Rejection.  N-grams count as the squared sum over the sum of squares of their counts, so a text
# that repeats one word a thousand times counts as that word.
SHORT = 24  # n-grams below which the letters tell more than the cosine
NOISE = 2.7  # standard deviations of the cosine of unrelated vectors, 1 / sqrt(dimensions)
LOW_SCORE = 0.01  # quantile of the cosines of the labelled texts with about as many n-grams
LOW_PART = 0.5  # the part of that quantile that a text must reach
LEAST_LABELLED = 30  # labelled texts for a quantile
OWN_LETTER = 1e-4  # part of the letters of a language that a letter of its alphabet is
OWN_SHARE = 0.5  # share of letters of known alphabets in a short text
GRAM_BLOCK = 4096  # n-gram vectors held at a time
SLICE = 1 << 20


class Profiles(NamedTuple):
    """Languages, sorted, their prototypes, one row each, and the letters of their alphabets."""

    languages: list[str]
    prototypes: np.ndarray
    letters: np.ndarray


def letter_table() -> bytes:
    """One bit for each code point: is it a letter?"""
    return np.packbits([chr(c).isalpha() for c in range(0x110000)]).tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64)
    seeds = (letters.astype(np.uint64)[:, None] << np.uint64(20)) + words
    bits = np.unpackbits(mixed(mixed(seeds + np.uint64(1))).view(np.uint8), axis=1)
    return bits[:, :dimensions].astype(np.int8) * np.int8(2) - np.int8(1)


def gram_counts(texts: list[str], is_letter: np.ndarray):
    """Owner, letters (three columns of indexes into the last result) and count of the n-grams of
    each text, sorted by n-gram, and the code points of those letters."""
    lowered = [text.lower() for text in texts]
    joined = "".join(f"\n{text}\n" for text in lowered)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owners = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in lowered])
    letters = is_letter[points]
    kept = letters.copy()
    kept[0] = True
    kept[1:] |= letters[:-1] | (owners[1:] != owners[:-1])
    points, owners, letters = points[kept], owners[kept], letters[kept]
    present = np.bincount(points[letters]).nonzero()[0].astype(np.uint32)
    number = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    number[present] = np.arange(1, len(present) + 1)
    symbols = np.where(letters, number[np.where(letters, points, 0)], 0)
    base = len(present) + 1
    whole = owners[:-2] == owners[2:]
    grams = ((symbols[:-2] * base + symbols[1:-1]) * base + symbols[2:])[whole]
    order_key = grams * len(texts) + owners[:-2][whole]
    keys, counts = np.unique(order_key, return_counts=True)
    grams, owner = keys // max(len(texts), 1), keys % max(len(texts), 1)
    columns = np.stack([grams // (base * base), grams // base % base, grams % base])
    return owner, grams, columns, counts, np.concatenate([np.zeros(1, np.uint32), present])


def bundles(texts: list[str], is_letter: np.ndarray, dimensions: int) -> np.ndarray:
    """The hypervector of each text; all zero for a text without letters."""
    return bundled(len(texts), gram_counts(texts, is_letter), dimensions)


def bundled(n_texts: int, counted, dimensions: int) -> np.ndarray:
    """The hypervectors of texts from their ``gram_counts``."""
    total = np.zeros((n_texts, dimensions), np.float32)
    owner, grams, columns, counts, points = counted
    if len(points) == 1:
        return total
    base = letter_vectors(points, dimensions)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    nth = np.cumsum(np.diff(grams, prepend=-1) != 0) - 1
    for start in range(0, len(first), GRAM_BLOCK):
        a, b, c = columns[:, first[start : start + GRAM_BLOCK]]
        vectors = (twice[a] * once[b] * base[c]).astype(np.float32)
        low = first[start]
        high = first[start + GRAM_BLOCK] if start + GRAM_BLOCK < len(first) else len(grams)
        order = low + np.argsort(owner[low:high], kind="stable")
        own, rows, weight = owner[order], nth[order] - start, counts[order].astype(np.float32)
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        for at, end in zip(cuts, [*cuts[1:], len(own)], strict=True):
            total[own[at]] += weight[at:end] @ vectors[rows[at:end]]
    return total


def evidence(counted, n_texts: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of n-grams that each text counts as, and its share of letters in ``own``."""
    owner, _, columns, counts, points = counted
    total = np.bincount(owner, counts, n_texts)
    squares = np.bincount(owner, counts.astype(np.float64) ** 2, n_texts)
    letters = np.bincount(owner, counts * (columns[1] > 0), n_texts)
    known = np.bincount(owner, counts * (np.isin(points, own) & (points > 0))[columns[1]], n_texts)
    return total**2 / np.maximum(squares, 1), known / np.maximum(letters, 1)


def held_in_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """A sample of about ``rows`` rows of each language, chosen by a hash of the id.

    The counts by language cover all rows; the texts of rows outside the sample are not read on.
    """
    counted = labelled.groupBy("lang").count().collect()  # one row for each language
    share = F.lit(0)
    for lang, count in ((r["lang"], r["count"]) for r in counted):
        share = F.when(F.col("lang") == lang, hash_share(rows, count)).otherwise(share)
    return labelled.filter(hash_place("language") < share)


def in_groups(counted, groups: np.ndarray, n_groups: int):
    """``gram_counts`` of texts as those of the groups that they belong to."""
    owner, grams, columns, counts, points = counted
    keys, first, place = np.unique(grams * n_groups + groups[owner], return_index=True, return_inverse=True)
    return keys % n_groups, grams[first], columns[:, first], np.bincount(place, counts, len(keys)), points


def learn(
    docs: DataFrame, use: Column, rows: int | None = None, dimensions: int = DIMENSIONS
) -> Profiles:
    """Prototypes from the text and lang of all rows where ``use`` holds and lang isn't null.

    A prototype is a sum over n-grams, so they are counted by language, and bundled once for each
    language in a slice.  A caller may ask for a sample of about ``rows`` rows of each language.
    """
    labelled = docs.filter(use & docs["lang"].isNotNull()).select("doc_id", "text", "lang")
    if rows is not None:
        labelled = held_in_sample(labelled, rows)
    table = letter_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = np.unpackbits(np.frombuffer(table, np.uint8)).astype(bool)
        sums: dict[str, np.ndarray] = {}
        letters: dict[str, Counter[int]] = {}
        for part, texts in text_slices(batches, "text", SLICE):
            languages, index = np.unique(
                np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True
            )
            counted = in_groups(gram_counts(texts, is_letter), index, len(languages))
            owner, _, columns, counts, points = counted
            vectors = bundled(len(languages), counted, dimensions).astype(np.float64)
            for i, lang in enumerate(languages.tolist()):
                sums[lang] = sums.get(lang, 0) + vectors[i]
                # Every letter is in the middle of one n-gram.
                here = (owner == i) & (columns[1] > 0)
                times = np.bincount(columns[1][here], counts[here], len(points))
                letters.setdefault(lang, Counter()).update(
                    {int(points[j]): float(times[j]) for j in times.nonzero()[0]}
                )
        for lang, vector in sums.items():
            # Letters have negative places.
            places = [*range(dimensions), *(-1 - point for point in letters[lang])]
            yield as_batch(
                {
                    "lang": pa.array([lang] * len(places)),
                    "place": pa.array(places, pa.int32()),
                    "value": pa.array([*vector, *letters[lang].values()], pa.float64()),
                }
            )

    summed = (
        labelled.select("lang", "text")
        .mapInArrow(run, "lang string, place int, value double")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
    )
    with small_batches(docs.sparkSession):
        summed = summed.toPandas()  # one row for each language and dimension or letter
    counts = summed[summed["place"] < 0]
    share = counts["value"] / counts.groupby("lang")["value"].transform("sum")
    own = np.unique(-1 - counts["place"][share >= OWN_LETTER].to_numpy(np.int64))
    wide = summed[summed["place"] >= 0].pivot(index="lang", columns="place", values="value").sort_index()
    wide = wide[(wide != 0).any(axis=1)]
    return Profiles(list(wide.index), wide.to_numpy(np.float64), own)


def identify(
    docs: DataFrame, profiles: Profiles, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``, the cosine with that language, 0 at least."""
    kind = docs.schema[id_column].dataType.simpleString()
    return narrow(docs, id_column, text_column).mapInArrow(
        predictor(profiles, ["doc_id"], ("lang_pred", "score")),
        f"doc_id {kind}, lang_pred string, score double",
    )


def least_scores(score: Column, grams: Column, labelled: DataFrame, dimensions: int) -> list[float]:
    """The cosine that a text with 2^i to 2^(i+1) n-grams must reach, for each i.

    Half of a low quantile of the cosines of all labelled texts of that size, or what the next smaller
    size has where too few have it; above the noise of the vectors in any case.
    """
    size = F.floor(F.log2(grams)).cast("int")
    found = (
        labelled.filter(grams > 0)
        .groupBy(size.alias("size"))
        .agg(F.count("*").alias("n"), F.percentile_approx(score, LOW_SCORE, 10_000).alias("low"))
        .collect()  # one row for each power of two
    )
    low = {r["size"]: r["low"] * LOW_PART for r in found if r["n"] >= LEAST_LABELLED}
    least = [NOISE / dimensions**0.5]
    for size in range(64):
        least.append(max(least[0], low.get(size, least[-1])))
    return least[1:]


@columns_apart("doc_id", "text", "lang")
def accepted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The documents in a known language, with all their columns.

    Rejected are texts without a letter, those less like every language than ``least_scores`` of the
    labelled rows, and texts below ``SHORT`` n-grams in letters of other alphabets.  With no language
    learned, only the first.  The documents are judged once and written to the shared folder, as the
    quantiles are taken of all labelled rows before any document is kept.
    """
    if not profiles.languages:
        return docs.filter(docs["text"].rlike(r"\p{L}"))
    names = ("lang_pred__", "score__", "grams__", "own__")
    schema = StructType([*docs.schema.fields]).add(names[0], StringType())
    for name in names[1:]:
        schema = schema.add(name, DoubleType())
    judged = settle(docs.mapInArrow(predictor(profiles, docs.columns, names), schema), "judged")
    lang, score, grams, own = (judged[name] for name in names)
    labelled = judged.filter(judged["lang"].isNotNull())
    least = F.array(*map(F.lit, least_scores(score, grams, labelled, profiles.prototypes.shape[1])))
    like = F.when(grams < SHORT, own >= OWN_SHARE).otherwise(
        score >= F.get(least, F.floor(F.log2(grams)).cast("int"))
    )
    return judged.filter((lang != UNKNOWN) & like).select(*[judged[c] for c in docs.columns])


def predictor(profiles: Profiles, carried: list[str], names: tuple[str, str]):
    """A function over Arrow batches that gives the carried columns, language and score; for four
    names, the n-grams that a text counts as and its share of letters of the known alphabets too."""
    table = letter_table()
    languages = [*profiles.languages, UNKNOWN]
    lengths = np.linalg.norm(profiles.prototypes, axis=1, keepdims=True)
    own = profiles.letters
    directions = (profiles.prototypes / lengths).T if len(profiles.languages) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = np.unpackbits(np.frombuffer(table, np.uint8)).astype(bool)
        for part, texts in text_slices(batches, "text", SLICE):
            best = np.full(len(texts), len(languages) - 1)
            score = np.zeros(len(texts))
            counted = gram_counts(texts, is_letter)
            if directions is not None:
                vectors = bundled(len(texts), counted, directions.shape[0]).astype(np.float64)
                size = np.linalg.norm(vectors, axis=1)
                some = np.flatnonzero(size)
                cosines = vectors[some] @ directions / size[some, None]
                best[some] = cosines.argmax(axis=1)
                score[some] = np.clip(cosines.max(axis=1), 0, 1)
            more = evidence(counted, len(texts), own) if names[2:] else ()
            yield as_batch(
                {
                    **{name: part.column(name) for name in carried},
                    names[0]: pa.array([languages[i] for i in best], pa.string()),
                    names[1]: pa.array(score, pa.float64()),
                    **dict(zip(names[2:], map(pa.array, more))),
                }
            )

    return run
