import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.read_model(PATH)
ENCODER, DECODER = pieces.Encoder(MODEL), pieces.Decoder(MODEL)


def check(text):
    ids = ENCODER.encode(text).tolist()
    assert ids == SP.encode(text, add_eos=True)
    assert DECODER.decode(ids) == SP.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab ▁\n\tné漢<0x>", max_size=60), st.text("theraion ", max_size=80)))
def test_like_the_library(text):
    check(text)


def test_long_and_odd_texts():
    r = random.Random(1)
    for text in ("", " ", "  ", "▁", " a", "a ", "<0x0A></s><s><unk>", "a" * 5000, "=" * 999, " " * 777, "ab" * 3000, "\U0001f600‍ x", "\r\n\r\n", "x\u0000y"):
        check(text)
    check("".join(r.choice("abcdefgh   etaoin-_.,\n") for _ in range(50_000)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(3, 258), max_size=12))
def test_decodes_any_ids(ids):
    assert DECODER.decode(ids) == SP.decode(ids)


def test_query_over_nulls_and_repeats(spark):
    rows = [(1, "The text, und noch  einer.\n", "a"), (1, "The text, und noch  einer.\n", "a"), (2, None, None), (3, "", "b"), (None, "x y", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encoded_digests(df, MODEL).collect())
    want = []
    for d, t, _ in rows:
        ids = SP.encode(t or "", add_eos=True)
        want.append((str(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.encoded_digests(df.limit(0), MODEL).count() == 0
