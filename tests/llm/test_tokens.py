"""Token counts and the codec against the libraries that define them."""

import random

import public_tokenizers
import pytest

from fitrank.llm import bpe_codec, token_count
from fitrank.llm.queries import op2_token_count, op10_bpe_codec

from .helpers import DATA, documents, given, rows

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
letters = random.Random(3)
TEXTS = [
    None,
    "",
    "  two  blanks\n\n\nand lines \t",
    "x" * 5000,
    "".join(letters.choice("abcdef") for _ in range(3000)),
    "<|endoftext|>a<|endoftext|><|endoftext|>",
    "a\u0085b\x1cc\xa0d \u3000e",
    "日本語 текст ελληνικά 🙂👩‍👧 é e\u0301 1234567 it's we'll I'M",
    "same",
    "same",
    " " * 3000 + "end",
    "word " * 60_000,
]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    docs = documents(spark, TEXTS, [None, *range(1, len(TEXTS))])
    got = rows(token_count.count_tokens(docs, JSON).select("n_bytes", "n_tokens"))
    want = [library.encode(t or "", add_special_tokens=False) for t in TEXTS]
    sizes = [len((t or "").encode()) for t in TEXTS]
    assert sorted(got) == sorted(zip(sizes, (len(w.ids) for w in want), strict=True))


def test_counts_of_all_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    texts = dict(rows(given(spark, "documents").select("doc_id", "text")))
    got = {r["doc_id"]: r for r in op2_token_count(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["over_limit"]) == (n, n > 1024)


def test_overlapping_pairs_merge_from_the_left():
    vocabulary = token_count.load_vocabulary(JSON)
    counts = token_count.count_symbols(vocabulary, [b"aaa", b"a", b"", b"aaaaa"])
    assert counts[1] == 1 and counts[2] == 0 and counts[0] <= 2


def test_ids_equal_the_library_and_decode(spark):
    encoding = bpe_codec.load_encoding(RANKS, PATTERN)
    docs = documents(spark, TEXTS, [None, *range(1, len(TEXTS))])
    coded = rows(bpe_codec.round_trip(docs, RANKS, PATTERN))
    want = {i or None: t or "" for i, t in enumerate(TEXTS)}
    assert len(coded) == len(TEXTS)
    for i, ids, raw in coded:
        assert list(ids or []) == encoding.encode_ordinary(want[i])
        assert bytes(raw) == want[i].encode()
    decoded = rows(bpe_codec.decode(bpe_codec.encode(docs, RANKS, PATTERN), RANKS, PATTERN))
    assert {i: bytes(b) for i, b in decoded} == {i: t.encode() for i, t in want.items()}


@pytest.mark.parametrize("size", [1, 7, 50])
def test_cuts_change_no_id(size):
    encoding = bpe_codec.load_encoding(RANKS, PATTERN)
    for text in filter(None, TEXTS):
        text = text[:4000]
        assert "".join(bpe_codec.safe_pieces(text, size)) == text
        assert bpe_codec.encode_text(encoding, text, size) == encoding.encode_ordinary(text)


def test_codec_query_digests(spark):
    import hashlib

    encoding = bpe_codec.load_encoding(RANKS, PATTERN)
    texts = dict(rows(given(spark, "documents").select("doc_id", "text")))
    for r in op10_bpe_codec(spark, DATA).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert rows(token_count.count_tokens(docs, JSON)) == []
    assert rows(bpe_codec.round_trip(docs, RANKS, PATTERN)) == []
