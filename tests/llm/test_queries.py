"""The registered queries: oracles, contracts and the pipeline on the smallest tables."""

import zlib

import compare
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duelframe.llm import queries  # noqa: F401
from duelframe.llm.common import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(name, spark, sf, con):
    problem = compare.difference(QUERIES[name](spark, sf), con, ORACLES[name])
    assert problem is None, problem


def test_packing_round_trip(spark, sf):
    rows = QUERIES["op4_pack_documents"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    names = list(docs)
    ids = dict(zip(names, ([*e.ids, 1] for e in model.encode_batch([docs[k] or "" for k in names], add_special_tokens=False))))
    covered: dict = {k: [] for k in docs}
    windows: dict = {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length > 0
        covered[r.doc_id].append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k])
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * sum(map(len, ids.values()))


def test_held_out_languages(spark, sf):
    found = QUERIES["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    held = found.where("held_out AND lang IS NOT NULL AND length(text) > 40")
    assert held.count() > 10
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.where("score < 0 OR score > 1").count() == 0


def test_toxicity_contract(spark, sf):
    found = QUERIES["op2_toxicity"](spark, sf)
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_license_spans(spark, sf):
    rows = QUERIES["op6_license_scan"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(texts[r.doc_id][r.start : r.end] == r.wording for r in rows)
    names = {
        "Licensed under the Apache License, Version 2.0": "Apache-2.0", "Released under the MIT License": "MIT",
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    }
    want = sorted((k, name) for k, t in texts.items() for wording, name in names.items() for _ in range((t or "").count(wording)))
    assert sorted((r.doc_id, r.license) for r in rows) == want


def test_pipeline(spark, sf):
    import corpus_pipeline as cp
    from duelframe.session import spool

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"toxicity": F.lit(1), "n_tokens": F.lit("x")})
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = spool(stage(spark, docs, sf), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns, name
            assert docs.count() > 0
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == docs.where("text IS NOT NULL").count()
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
