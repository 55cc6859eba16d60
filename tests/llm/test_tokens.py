"""Token ids against the libraries, and the exact round trip."""

import os
import random

import pytest
from gritmill.llm import tokens as T
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = T.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return T.encoder(PATH), t


TEXTS = ["", " ", "a", "Hello, world!  \n\n x", "don't we'll", "naïve café 审查 👩‍💻 é", "<|endoftext|>", "x" * 5000, " " * 3000, "\t\r\n", "0123456789" * 20, "‮abc\u0000", "=-" * 2000]


def test_ids_equal_the_library(both):
    enc, t = both
    for x in TEXTS:
        assert enc.encode(x) == t.encode(x, add_special_tokens=False).ids, x[:40]
    assert enc.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeth in\n.,'sS-=01éß漢😀́ "), max_size=120))
def test_random_texts(both, x):
    enc, t = both
    ids = enc.encode(x)
    assert ids == t.encode(x, add_special_tokens=False).ids
    assert "".join(T.decode_stream(ids, enc.fst.bytes_of)) == x


def test_transducer_alone_and_after_a_reset(both):
    enc, t = both
    fst = T.Transducer(T.read_ranks(PATH))
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC_") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    want = [t.encode(w, add_special_tokens=False).ids for w in words]
    assert [[i for p in enc.cut(w) for i in fst.encode(p.encode())] for w in words] == want
    fst._reset()
    assert [[i for p in enc.cut(w) for i in fst.encode(p.encode())] for w in words] == want


def test_both_file_kinds_agree():
    assert T.read_ranks(PATH) == T.read_ranks(f"{T.TOKENIZERS}/byte_bpe_50k.json")


def test_decoding_bytes_that_never_end(both):
    enc, _ = both
    half = [enc.fst.ranks[b"\xe6"], enc.fst.ranks[b"a"]]
    assert "".join(T.decode_stream(half, enc.fst.bytes_of)) == "�a"
    assert "".join(T.decode_stream(half[:1], enc.fst.bytes_of)) == "�"


def test_corpus(spark, both):
    enc, _ = both
    rows = [(i, x, "clash") for i, x in enumerate([*TEXTS, None])] + [(None, "null id", "c"), (0, "repeated row", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.ids) for r in T.encode_corpus(df).collect())
    assert got == sorted(((i if i is not None else -1), enc.encode(x)) for i, x, _ in rows)
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in T.decode_corpus(T.encode_corpus(df)).collect())
    assert back == sorted((i if i is not None else -1, x or "") for i, x, _ in rows)
    assert T.encode_corpus(df.limit(0)).count() == 0
    counts = {(r.doc_id, r.n_tokens) for r in T.token_counts(df, keep=["ids"]).collect()}
    assert counts == {(i, len(enc.encode(x))) for i, x, _ in rows}
