import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm.byte_bpe import ByteBpe, encode, piece_starts
from fieldloom.llm.queries import vocabulary
from fieldloom.llm.token_counts import WordCounter, count_tokens

RANKS, WORDS = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("word_bpe_49k.json")
ALPHABET = "ab'stvedlmr  \n\t1.,!é中 　<|²ΣİSTRDML"


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


CODER, COUNTER = ByteBpe(RANKS), WordCounter(WORDS)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=60))
def test_pieces_and_counts(text):
    import public_tokenizers as P
    import regex
    from tokenizers import Tokenizer

    assert piece_starts(text).tolist() == [m.start() for m in regex.finditer(P.PATTERN, text)]
    global _library
    _library = globals().get("_library") or Tokenizer.from_file(WORDS)
    assert COUNTER.count(text) == len(_library.encode(text, add_special_tokens=False).ids)


def test_against_tiktoken(spark, edge, reference):
    rows = encode(edge, RANKS, keep="ids").collect()
    texts = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in edge.collect())
    found = sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.decoded).decode(), r.ids, r.n_tokens, r.offsets[-1]) for r in rows)
    for (i, text), (j, decoded, ids, n, end) in zip(texts, found, strict=True):
        assert (i, text) == (j, decoded) and ids == reference.encode_ordinary(text) and n == len(ids) and end == len(text.encode())


def test_digests(edge, reference):
    texts = {r.doc_id: r.text or "" for r in edge.where("doc_id < 16").collect()}
    for r in encode(edge.where("doc_id < 16"), RANKS).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_token_counts(edge, library):
    texts = {r.doc_id: r.text or "" for r in edge.where("doc_id IS NOT NULL").collect()}
    rows = count_tokens(edge, WORDS, limit=10).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if r.doc_id is not None:
            n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 10)


def test_empty(none):
    assert encode(none, RANKS).count() == 0 and encode(none, RANKS, keep="ids").count() == 0 and count_tokens(none, WORDS).count() == 0
