import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from locusweave.llm.tokenizing import ForcedBoundaryEncoder, count_tokens, encode_texts, vocabulary_path
from locusweave.session import table

PIECES = ["'", "s", "'s", "ll", " ", "  ", "\n", " ", "　", "é", "ß", "漢", "字", ".", ",", "!", "re", "'ve", "x", "1", "22", "\t", " ", "d", "\u0085", "-", "’", "😀", "م", "<|endoftext|>"]


@pytest.fixture(scope="module")
def encoder():
    return ForcedBoundaryEncoder(vocabulary_path())


def encoded(encoder, texts):
    return [ids[a:b].tolist() for ends, ids in encoder.encode(texts) for a, b in zip(ends, ends[1:], strict=False)]


def test_random_texts_match_plain_encoding(encoder):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(8000)]
    assert encoded(encoder, pa.array(texts)) == [encoder.encoding.encode_ordinary(t) for t in texts]


def test_no_cut_inside_a_token(encoder):
    for token in [b" the", b"\n\n", b"'re", b"ing", "é".encode()]:
        assert len(encoder.cuts(np.frombuffer(token, np.uint8))) == 0


def test_null_empty_and_sliced_arrays(encoder):
    whole = pa.array(["left out", None, "", " ", "a b", "x" * 70_000])
    assert encoded(encoder, whole.slice(1)) == [[], [], *(encoder.encoding.encode_ordinary(t) for t in (" ", "a b", "x" * 70_000))]
    assert encoded(encoder, pa.array([], pa.string())) == []


def test_long_runs_without_blanks_are_cut_and_match(encoder):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    code = "".join(rng.choice(["if(", "x", "=", "){", "return", ";", "}", "'s'", '"a"', "&&", "é", "[0]", "_", "this."]) for _ in range(3000))
    texts = ["".join(rng.choice(letters) for _ in range(5000)), code, "data:" + "".join(rng.choice("\\x0123456789abcdef%") for _ in range(4000)), f"a {code[:39]} b {code[:80]}"]
    assert encoded(encoder, pa.array(texts)) == [encoder.encoding.encode_ordinary(t) for t in texts]
    assert all(len(encoder.cuts(np.frombuffer(t.encode(), np.uint8))) > len(t) / 60 for t in texts[:2])


def test_documents_match_the_other_library_and_decode_back(spark, encoder):
    docs = table(spark, SMALL, "documents")
    other = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    other.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in encode_texts(docs).collect()}
    assert got == {k: other.encode(t, add_special_tokens=False).ids if t else [] for k, t in texts.items()}
    assert all(encoder.encoding.decode(ids) == (texts[k] or "") for k, ids in got.items())
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()} == {k: len(v) for k, v in got.items()}


def test_no_documents_and_a_null_id(spark):
    schema = "text string, ids int, doc_id long"
    assert encode_texts(spark.createDataFrame([], schema)).count() == 0
    assert encode_texts(spark.createDataFrame([("a", 1, None)], schema)).collect()[0].asDict() == {"doc_id": None, "ids": [64]}
