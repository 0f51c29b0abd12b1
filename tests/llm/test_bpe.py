from __future__ import annotations

import random

import numpy as np
import public_tokenizers as tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pixlens.llm import bpe

from .conftest import documents

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Encoder(RANKS, tokenizers.PATTERN)


def ids(text):
    return np.frombuffer(OWN.text(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_blanks_and_repeats():
    rnd = random.Random(1)
    pool = " \n\t\r\x0b\x1c\x85\xa0 　​abZ'19é日²🙂,.%" + "  "
    for _ in range(4000):
        t = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 20)))
        assert ids(t) == LIBRARY.encode_ordinary(t), repr(t)
    for t in ("a" * 3000, "ab" * 900, "xyz" * 500 + "q", "é" * 600, "the " * 400):
        assert ids(t) == LIBRARY.encode_ordinary(t)


def test_both_merge_forms_agree():
    rnd = random.Random(2)
    pieces = [bytes(rnd.choice(b"abcdeinorst \xc3\xa9") for _ in range(rnd.randint(2, 90))) for _ in range(300)]
    pairs = bpe.PairRanks(RANKS)
    together = [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_pieces(pieces, pairs)]
    single = [bpe.merge_piece(p, RANKS) if p not in RANKS else None for p in pieces]
    assert all(a == b for a, b in zip(together, single) if b is not None)


def test_documents_round_trip(spark, odd_rows):
    docs = documents(spark, odd_rows).selectExpr("*", "5 AS ids", "6 AS decoded")
    got = bpe.decode(bpe.encode(docs, PATH, tokenizers.PATTERN), PATH).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == LIBRARY.encode_ordinary(r.text or "")
    assert bpe.encode(documents(spark, []), PATH, tokenizers.PATTERN).count() == 0
