"""Token counts under a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are split at special tokens and then into pre-tokens.  The distinct pre-tokens of a slice that
have not been counted yet are held as one ragged numpy array of symbols.  In each step every
pre-token applies its lowest-rank pair at all its places at once, the leftmost first where they
overlap; what no pair can merge any more is counted and leaves the array.  A merged symbol only has
pairs of higher ranks, so this order gives the symbols of one-at-a-time merging.

Defined results: a null or empty text has no tokens; each special token in a text counts as one;
null ids stay null; repeated rows are counted each; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fitrank.llm.batches import as_batch, narrow, text_slices

# Fixed value: the pre-token pattern of byte-level vocabularies, with white space as Unicode has it.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NO_PAIR = np.int32(2**31 - 1)
KEPT_PRE_TOKENS = 1 << 19  # counts a task remembers; when full it starts anew


class Vocabulary(NamedTuple):
    """byte_ids: symbol of each byte; keys, merged: pairs, sorted, and what each becomes; ranks."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    width: int
    special: list[str]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    shown = {byte: byte for byte in printable}
    return [chr(shown[b] if b in shown else next(others)) for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    ids = data["model"]["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
    width = max(ids.values()) + 1
    keys = np.array([ids[a] * width + ids[b] for a, b in pairs], np.int64)
    merged = np.array([ids[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys, kind="stable")
    byte_ids = np.array([ids[c] for c in byte_characters()], np.int32)
    special = [token["content"] for token in data.get("added_tokens", ())]
    return Vocabulary(byte_ids, keys[order], order.astype(np.int32), merged[order], width, special)


def pair_entries(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray):
    """Rank and merged symbol of each pair; NO_PAIR where the vocabulary has no merge."""
    keys = left.astype(np.int64) * vocabulary.width + right
    at = np.minimum(np.searchsorted(vocabulary.keys, keys), len(vocabulary.keys) - 1)
    known = vocabulary.keys[at] == keys
    return np.where(known, vocabulary.ranks[at], NO_PAIR), vocabulary.merged[at]


def every_other(chosen: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring true entries the first, third and so on."""
    at = np.flatnonzero(chosen)
    if len(at) == 0:
        return at
    starts = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
    return at[place % 2 == 0]


def count_symbols(vocabulary: Vocabulary, words: list[bytes]) -> np.ndarray:
    """The number of symbols that each word ends with."""
    counts = np.array([len(w) for w in words], np.int64)
    live = np.flatnonzero(counts > 1)
    if len(live) == 0:
        return counts
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
    lengths = counts[live]
    ends = np.cumsum(lengths) - 1
    ranks, becomes = pair_entries(vocabulary, symbols, np.roll(symbols, -1))
    ranks[ends] = NO_PAIR
    while len(live):
        starts = np.cumsum(lengths) - lengths
        lowest = np.minimum.reduceat(ranks, starts)
        done = lowest == NO_PAIR
        if done.any():
            counts[live[done]] = lengths[done]
            stay = np.repeat(~done, lengths)
            symbols, ranks, becomes = symbols[stay], ranks[stay], becomes[stay]
            live, lengths, lowest = live[~done], lengths[~done], lowest[~done]
            if len(live) == 0:
                break
            starts = np.cumsum(lengths) - lengths
        # A pair never starts at the end of a word, so runs don't reach over words.
        at = every_other(ranks == np.repeat(lowest, lengths))
        symbols[at] = becomes[at]
        last = np.zeros(len(symbols), bool)
        last[starts + lengths - 1] = True
        last[at] |= last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        moved = at - np.arange(len(at))
        gone = np.add.reduceat(~stay, starts)
        symbols, ranks, becomes, last = symbols[stay], ranks[stay], becomes[stay], last[stay]
        lengths = lengths - gone
        anew = np.unique(np.concatenate([moved, np.maximum(moved - 1, 0)]))
        anew = anew[anew < len(symbols)]
        ranks[anew], becomes[anew] = pair_entries(
            vocabulary, symbols[anew], symbols[np.minimum(anew + 1, len(symbols) - 1)]
        )
        ranks[last] = NO_PAIR
    return counts


class Counter:
    """Counts tokens of texts; remembers the counts of pre-tokens within a task."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.pre_tokens = regex.compile(PRE_TOKENS).findall
        special = sorted(map(regex.escape, vocabulary.special), key=len, reverse=True)
        self.special = regex.compile("|".join(special)) if special else None
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for text in texts:
            pieces = self.special.split(text) if self.special else [text]
            extra.append(len(pieces) - 1)
            split.append([w for piece in pieces for w in self.pre_tokens(piece)]
                         if len(pieces) > 1 else self.pre_tokens(text))
        words = set().union(*split)
        if len(self.known) + len(words) > KEPT_PRE_TOKENS:
            self.known = {}
        new = [w for w in words if w not in self.known]
        counts = count_symbols(self.vocabulary, [w.encode("utf-8", "surrogatepass") for w in new])
        self.known.update(zip(new, counts.tolist(), strict=True))
        return [sum(map(self.known.__getitem__, own)) + n for own, n in zip(split, extra, strict=True)]


def count_tokens(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(load_vocabulary(path))
        for part, texts in text_slices(batches, "text", 2 << 20):
            sizes = [len(text.encode("utf-8", "surrogatepass")) for text in texts]
            yield as_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": pa.array(sizes, pa.int64()),
                    "n_tokens": pa.array(count(texts), pa.int64()),
                }
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return narrow(docs, id_column, text_column).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )
