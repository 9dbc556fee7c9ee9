"""Text expressions: plain columns over built-in functions, no UDFs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitrank.functions.fixed_values import ENGLISH_STOP_WORDS

# A term is a run of two or more letters, digits or underscores, in any script.
TERM_BREAK = r"[^\p{L}\p{N}_]+"


def strip_space(c: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_key(c: Column) -> Column:
    """Lower-case, stripped text for comparisons; null and the text ``nan`` become empty."""
    return F.when(c.isNull() | (c == "nan"), "").otherwise(strip_space(F.lower(c)))


def contains_any(c: Column, keywords: Sequence[str], strip: bool = False) -> Column:
    """True if the text holds at least one keyword, ignoring case; a null text holds none.

    An empty keyword would match every row and is refused.
    """
    words = [(k.strip() if strip else k).lower() for k in keywords]
    if not words or not all(words):
        raise ValueError("keywords must be a non-empty list without empty entries")
    text = F.coalesce(F.lower(c), F.lit(""))
    return reduce(Column.__or__, [text.contains(F.lit(w)) for w in words])


def raw_terms(c: Column) -> Column:
    """All runs of word characters in lower case; may include empty and one-character runs."""
    return F.split(F.lower(c), TERM_BREAK)


def tokenize(c: Column) -> Column:
    """Terms in reading order, with repeats."""
    return F.filter(raw_terms(c), lambda t: F.length(t) >= 2)


def literal_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def remove_stop_words(
    tokens: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS
) -> Column:
    """Drop stop words from a token array and keep repeats.

    Spark turns a membership test against a long list of literals into one hash probe.
    """
    stop = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def distinct_terms(c: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Set of terms of a text without stop words; one hash pass over the tokens."""
    return F.filter(
        F.array_except(raw_terms(c), literal_array(stop_words)), lambda t: F.length(t) >= 2
    )


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a name inside ``body`` so that it is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_counts(c: Column) -> Column:
    """``array<struct<term, tf>>`` of a text, computed inside its row.

    Sorting the runs puts equal ones side by side, so a count is the distance between two run
    ends.  Counting per document therefore needs no shuffle.  The empty term is always present.
    """

    def count_runs(runs: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(0), F.size(runs) - 1),
            lambda i: F.coalesce(F.get(runs, i) != F.get(runs, i + 1), F.lit(True)),
        )
        return _let(
            ends,
            lambda e: F.transform(
                e,
                lambda i, k: F.struct(
                    F.get(runs, i).alias("term"),
                    (i - F.coalesce(F.get(e, k - 1), F.lit(-1))).alias("tf"),
                ),
            ),
        )

    text = F.concat(F.lit(" "), F.coalesce(c, F.lit("")))
    return _let(F.sort_array(raw_terms(text)), count_runs)


def is_scored_term(term: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    keep = F.length(term) >= 2
    return keep & ~term.isin(list(stop_words)) if stop_words else keep


def strip_markup(c: Column) -> Column:
    """Plain text of an HTML or Markdown text, pieces joined by one blank.

    Comments, script and style blocks and tags give way to a blank; then Markdown links, images,
    emphasis, headings, quotes, list marks and code marks go; then the common character entities
    are decoded.  This is a rule list over one column, not a document parser.
    """
    rules = (
        (r"(?s)<!--.*?-->", " "),
        (r"(?is)<script\b.*?</script\s*>", " "),
        (r"(?is)<style\b.*?</style\s*>", " "),
        (r"<[^>]*>", " "),
        (r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
        (r"(?m)^[ \t]*(#{1,6}|>|[-*+]|[0-9]+\.)[ \t]+", ""),
        (r"\*\*|__|~~|`+", ""),
        (r"&nbsp;", " "),
        (r"&lt;", "<"),
        (r"&gt;", ">"),
        (r"&quot;", '"'),
        (r"&#39;|&apos;", "'"),
        (r"&amp;", "&"),
        (r"\s+", " "),
    )
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return F.trim(c)
