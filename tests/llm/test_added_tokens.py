"""Texts that hold tokens added to the vocabulary."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from duelframe.llm import packing, queries

TEXTS = [
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "One.<|endoftext|>Two words  here.\n<|endoftext|>\nThree",
    "<|endoftext|", "<|EndOfText|>", "x<|endoftext|>x \ud800 y", "no such token in it", "",
]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_json_file(model):
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert added == {"<|endoftext|>": 50256}
    tokens = packing.Tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)
    for text in TEXTS:
        clean = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        ids = tokens.ids(text)
        assert ids.tolist() == model.encode(clean, add_special_tokens=False).ids
        assert all(0 < end < len(ids) for end in tokens.sentence_ends(ids))


def test_packed_documents(spark, model):
    texts = [t for t in TEXTS if "\ud800" not in t]
    rows = queries.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = [*model.encode(texts[r.doc_id], add_special_tokens=False).ids, packing.END_ID]
        assert (r.length, r.doc_tokens) == (len(want), len(want))
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(want, dtype="<u4").tobytes())
