"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, only where a match of the split pattern must end: between a
letter or digit and a single space that a letter or digit follows.  No match reaches over such a
place, so the ids are those of the whole text.  A stretch of more than ``MOST_CHARS`` without such a
place, such as a run of blanks, would exhaust the stack of the library's pattern matching; it is split
by the regex library, and its matches are encoded one by one.  Decoding joins the raw bytes of the
ids, which need not be valid UTF-8 piece by piece.

Defined results: a null or empty text has no ids and decodes to no bytes; null ids stay null;
repeated rows are encoded each; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fitrank.llm.batches import as_batch, narrow, text_slices

CUT_CHARS = 100_000
MOST_CHARS = 200_000
SAFE_CUT = r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])"


def load_encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = CUT_CHARS) -> list[str]:
    """The text in pieces of at least ``size`` characters, cut at safe boundaries only."""
    if len(text) <= size:
        return [text]
    import regex

    cut, pieces, start = regex.compile(SAFE_CUT), [], 0
    while found := cut.search(text, start + size):
        pieces.append(text[start : found.start()])
        start = found.start()
    return [*pieces, text[start:]]


def matches(pattern: str, text: str) -> Iterator[str]:
    """The matches of the split pattern, without a limit on their length."""
    import regex

    # White space as the library has it, without the four separators of ASCII.
    own = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return (found[0] for found in regex.finditer(own, text))


def encode_text(encoding, text: str, size: int = CUT_CHARS, most: int = MOST_CHARS) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, size):
        if len(piece) <= most:
            ids += encoding.encode_ordinary(piece)
        else:
            for match in matches(encoding._pat_str, piece):
                ids += encoding._encode_single_piece(match)
    return ids


def encode(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id`` and ``token_ids``, an array of int, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path, pattern)
        for part, texts in text_slices(batches, "text"):
            ids = pa.array([encode_text(encoding, text) for text in texts], pa.list_(pa.int32()))
            yield as_batch({"doc_id": part.column("doc_id"), "token_ids": ids})

    return narrow(docs, id_column, text_column).mapInArrow(
        run, f"doc_id {docs.schema[id_column].dataType.simpleString()}, token_ids array<int>"
    )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes``, the raw bytes of ``token_ids``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [
                    None if ids is None else encoding.decode_bytes(ids)
                    for ids in part.column("token_ids").to_pylist()
                ]
                yield as_batch(
                    {"doc_id": part.column("doc_id"), "bytes": pa.array(raw, pa.binary())}
                )

    return encoded.select("doc_id", "token_ids").mapInArrow(
        run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary"
    )


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``token_ids`` and ``bytes``, encoded and decoded in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path, pattern)
        for part, texts in text_slices(batches, "text", 1 << 20):
            ids = [encode_text(encoding, text) for text in texts]
            yield as_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "token_ids": pa.array(ids, pa.list_(pa.int32())),
                    "bytes": pa.array(map(encoding.decode_bytes, ids), pa.binary()),
                }
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return narrow(docs, id_column, text_column).mapInArrow(
        run, f"doc_id {kind}, token_ids array<int>, bytes binary"
    )
