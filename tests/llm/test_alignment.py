"""Alignment of two tokenizers against a plain per-token version."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duelframe.llm import alignment, queries

ODD = [
    None, "", "a", " lead", "trail ", "two  blanks", "tab\there\r\n\r\nx", "\nline", "line\n", "a\n\nb", "<|endoftext|> and </s><s> <unk>",
    "▁ is no blank", "x▁y", "１２３ ﬁ ① é é", "中文字 и кириллица 😀👍🏽 ​ \xa0 　x", "'s it's 'll", "\x00 zero", "..." * 50,
    "The end. The end. The end.", "The end. The end. The end.",
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(texts, tokenizers):
    """Rows of the contract, token by token."""
    a_model, b_model = tokenizers
    letters = {k: v for k, v in alignment._letters_of_bytes().items()}
    made, holders = [], {}
    for at, text in enumerate(texts):
        made.append(None)
        if not text:
            continue
        a = a_model.encode(" " + text, add_special_tokens=False)
        a = [(k, bytes(letters[c] for c in a_model.id_to_token(k))) for k in a.ids]
        b = []
        for k in b_model.encode(text):
            piece = b_model.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if b_model.is_byte(k) else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            continue

        def spans(tokens):
            place, out = 0, []
            for k, x in tokens:
                out.append((k, place, place + len(x)))
                place += len(x)
            return out

        a, b = spans(a), spans(b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            part = ["|".join([",".join(str(k) for k, s, e in side if start < e <= end) for side in (a, b)])]
            groups += part
            start = end
        links = [(x, y) for x, s, e in a for y, t, u in b if s < u and t < e]
        made[-1] = (len(a), len(b), groups, links)
        for pair in set(links):
            holders.setdefault(pair, set()).add(at)
    count = {pair: len(h) for pair, h in holders.items()}
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for one in made:
        if one is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = one
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("run_links, fan_in", [(alignment.RUN_LINKS, alignment.FAN_IN), (40, 2)])
def test_same_as_plain_version(spark, sf, tokenizers, run_links, fan_in):
    texts = ODD + [r.text[:400] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_a": F.lit("x"), "run": F.lit(1)})
    found = queries.align(docs, run_links=run_links, fan_in=fan_in).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in found] == plain(texts, tokenizers)


def test_repeated_and_missing_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one"), (2, None)], "doc_id long, text string")
    found = queries.align(docs).collect()
    assert sorted((r.doc_id or 0, r.n_a > 0) for r in found) == [(0, True), (1, True), (1, True), (2, False)]
    assert {r.count_sum for r in found if r.doc_id is None} == {3}  # " one" is in three rows
    assert queries.align(docs.limit(0)).collect() == []


def test_long_text(spark, tokenizers):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 9))) for _ in range(40_000))
    row = queries.align(spark.createDataFrame([(5, text)], "doc_id int, text string"), run_links=1000).first()
    assert row.n_a == len(tokenizers[0].encode(" " + text, add_special_tokens=False).ids)
    assert row.n_b == len(tokenizers[1].encode(text)) and row.n_links >= max(row.n_a, row.n_b)


def test_heap_merge_of_headers():
    rng = np.random.default_rng(1)
    headers = []
    for _ in range(5):
        pairs = np.unique(rng.integers(0, 6, 30) << 15 | rng.integers(0, 8, 30))
        headers.append((pairs, rng.integers(1, 5, len(pairs))))
    want: dict = {}
    for pairs, counts in headers:
        for p, c in zip(pairs.tolist(), counts.tolist()):
            want[p] = want.get(p, 0) + c
    got, last = {}, -1
    for pairs, totals, top, _ in alignment.merged(headers):
        assert len(set((pairs >> 15).tolist())) == 1 and pairs[0] >> 15 > last and top == totals.max()
        last = pairs[0] >> 15
        got.update(zip(pairs.tolist(), totals.tolist()))
    assert got == want
