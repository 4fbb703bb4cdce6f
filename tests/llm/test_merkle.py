"""Merkle manifests against trees built in memory, and the queue they are built with."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duelframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def built(nodes):
    """Root, and for every leaf its (place in its run, run) up to the root."""
    paths, holds = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
        for k, run in enumerate(runs):
            for j in range(len(run)):
                for x in holds[2 * k + j]:
                    paths[x].append((j, run))
        holds = [sum(holds[k : k + 2], []) for k in range(0, len(holds), 2)]
        nodes = [digest(run) for run in runs]
    return nodes[0], paths


def plain(rows, tampered):
    trees, out = {}, []
    for r in rows:
        trees.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append(r)
    names = sorted(trees, key=str.encode)
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf(r)))
    own = {name: built([leaf(r) for r in trees[name]]) for name in names}
    root, above = built([own[name][0] for name in names])
    for k, name in enumerate(names):
        for r, path in zip(trees[name], own[name][1]):
            path = path + above[k]
            end = leaf(r, 1 if tampered(r["doc_id"]) else 0)
            for j, run in path:
                end = digest([*run[:j], end, *run[j + 1 :]])
            proof = digest(x for j, run in path for i, x in enumerate(run) if i != j)
            out.append((r["doc_id"], leaf(r), own[name][0], root, proof, end, end == root))
    return out


def key(row):
    return tuple((x is None, x or 0) if isinstance(x, (int, type(None))) else x for x in row)


@pytest.mark.parametrize("levels, held", [(merkle.LEVELS, merkle.HELD), (2, 3), (1, 1)])
def test_same_as_plain_trees(spark, levels, held):
    rng = random.Random(levels)
    rows = [
        {"doc_id": k, "text": rng.choice(["é", "", None, "a:b", "x" * 100]), "lang": rng.choice(["en", "de", "é", ""]), "source": rng.choice(["s", None]),
         "n_chars": rng.choice([1, None, -7])}
        for k in range(90)
    ]
    rows += [{"doc_id": None, "text": "n", "lang": None, "source": "s", "n_chars": 2}, dict(rows[3]), dict(rows[3]), {**rows[4], "text": "other"}]
    rows += [{"doc_id": 500, "text": "y" * 300_000, "lang": "alone", "source": "s", "n_chars": 2**63 - 1}]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit(1), "TREE": F.lit("x")})
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(df, marked, levels, held).collect()
    want = plain(rows, lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 0)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_single_and_empty_tables(spark):
    row = {"doc_id": 1, "text": "a", "lang": "en", "source": "s", "n_chars": 1}
    got = merkle.manifest(spark.createDataFrame([row], SCHEMA)).first()
    assert got.leaf == got.subroot == got.root == got.folded_root == leaf(row) and got.verified
    assert got.proof_sha256 == digest([])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_change_of_a_leaf_is_seen(spark):
    rows = [{"doc_id": k, "text": str(k), "lang": "en", "source": "s", "n_chars": 1} for k in range(11)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 2 == 0, 2, 4).collect()
    assert {r.doc_id: r.verified for r in got} == {k: k % 2 == 1 for k in range(11)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.tuples(st.integers(-50, 50), st.binary(max_size=4))), max_size=80), st.integers(1, 9))
def test_queue_with_spilled_runs(moves, held):
    """``None`` takes the smallest message out."""
    queue, kept = merkle.ExternalQueue(held), []
    for move in [*moves, *[None] * len(moves)]:
        if move is None and kept:
            kept.sort()
            assert queue.front() == kept[0][0]
            assert queue.pop() == kept.pop(0)
        elif move is not None:
            queue.push(*move)
            kept.append(move)
    assert queue.front() is None
    assert len(queue._near) <= held


def test_blocks_spill():
    queue = merkle.ExternalQueue(64)
    leaves = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(1000)]
    root, nodes = merkle.forward(leaves, 0, 10, queue)
    assert queue.spilled > 3
    back = merkle.ExternalQueue(64)
    for place, proof in merkle.backward(nodes, b"", 0, len(leaves), back):
        assert merkle.folded(leaves[place], proof) == root
    assert back.spilled > 3
