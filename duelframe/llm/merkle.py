"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a tree stand in the order of their ids. Trees
are cut into blocks of 2^LEVELS neighbouring nodes, and a task processes the nodes
of a block in the order of their labels (level, then place): a node sends its
digest forward to its parent through a priority queue, and a parent whose label
comes up finds its children's digests at the queue's front. The roots of blocks
are the leaves of the next round, so a tree of any size takes a few rounds. A
second sweep runs against the labels: a node sends every child the proof it got
itself, with the digests of the child's siblings before it, down to the leaves.
The queue holds a bounded number of messages and spills sorted, compressed runs.
Digests move between tasks, texts never do.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.ordering import global_index
from duelframe.session import ship, spool

#: Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block, and the messages a queue holds in memory.
LEVELS, HELD = 12, 1024
#: Steps of a proof: a sibling after or before the node, or none.
AFTER, BEFORE, ALONE = b">", b"<", b"-"
_FRAME = 512


def field_text(value: Column) -> Column:
    """A field as hashed: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_text, fields)), 256))


def combined(digests: list[bytes]) -> bytes:
    """Digest of child digests, which are concatenated as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class ExternalQueue:
    """Priority queue of (label, bytes), the smallest label first; it keeps ``held`` messages and spills the others.

    Runs lie in files without a name, which vanish with the task. Messages with
    equal labels come in the order of their bytes.
    """

    def __init__(self, held: int = HELD):
        self._held = held
        self._near: list[tuple[int, bytes]] = []
        self._runs: list[tuple[int, bytes, int, Iterator[tuple[int, bytes]]]] = []
        self.spilled = 0

    def push(self, label: int, load: bytes) -> None:
        heapq.heappush(self._near, (label, load))
        if len(self._near) > self._held:
            self._spill()

    def front(self) -> int | None:
        heads = [side[0][0] for side in (self._near, self._runs) if side]
        return min(heads) if heads else None

    def pop(self) -> tuple[int, bytes]:
        if not self._runs or (self._near and self._near[0] <= self._runs[0][:2]):
            return heapq.heappop(self._near)
        label, load, number, rest = self._runs[0]
        following = next(rest, None)
        if following is None:
            heapq.heappop(self._runs)
        else:
            heapq.heapreplace(self._runs, (*following, number, rest))
        return label, load

    def _spill(self) -> None:
        """Keep the quarter that is needed first, write the rest as a sorted run."""
        rows = sorted(self._near)
        keep = self._held // 4
        self._near = rows[:keep]  # a sorted list is a heap
        run = _written_run(rows[keep:])
        self.spilled += 1
        heapq.heappush(self._runs, (*next(run), self.spilled, run))


def _written_run(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Write sorted messages as compressed frames; the result reads them back, a frame at a time."""
    import zstandard

    file = tempfile.TemporaryFile()
    pack, sizes = zstandard.ZstdCompressor(level=1), []
    for at in range(0, len(rows), _FRAME):
        part = rows[at : at + _FRAME]
        plain = b"".join(
            label.to_bytes(10, "big", signed=True) + len(load).to_bytes(4, "big") + load for label, load in part
        )
        frame = pack.compress(plain)
        file.write(frame)
        sizes.append(len(frame))

    def read() -> Iterator[tuple[int, bytes]]:
        with file:
            file.seek(0)
            for size in sizes:
                plain, at = zstandard.decompress(file.read(size)), 0
                while at < len(plain):
                    length = int.from_bytes(plain[at + 10 : at + 14], "big")
                    yield int.from_bytes(plain[at : at + 10], "big", signed=True), plain[at + 14 : at + 14 + length]
                    at += 14 + length

    return read()


def _label(level: int, place: int) -> int:
    return level << 56 | place


def forward(
    leaves: list[bytes], first: int, levels: int, queue: ExternalQueue
) -> tuple[bytes, list[tuple[int, list[bytes]]]]:
    """Root of a block, and its inner nodes in the order of their labels, with the digests of their children.

    ``first``: place of the block's first leaf, a multiple of 2^levels.
    """
    if levels == 0:
        return leaves[0], []
    for place, digest in enumerate(leaves, first):
        queue.push(_label(1, place >> 1) << 1 | place & 1, digest)
    nodes = []
    while True:
        front, digest = queue.pop()
        label, children = front >> 1, [digest]
        if queue.front() is not None and queue.front() >> 1 == label:
            children.append(queue.pop()[1])
        nodes.append((label, children))
        level, place, digest = label >> 56, label & (1 << 56) - 1, combined(children)
        if level == levels:
            return digest, nodes
        queue.push(_label(level + 1, place >> 1) << 1 | place & 1, digest)


def backward(
    nodes: list[tuple[int, list[bytes]]], proof: bytes, first: int, count: int, queue: ExternalQueue
) -> Iterator[tuple[int, bytes]]:
    """(place, proof) of every leaf of a block, last leaf first; ``proof`` is that of the block's root."""
    if not nodes:
        yield first, proof
        return
    queue.push(-nodes[-1][0], proof)
    for label, children in reversed(nodes):
        sent, proof = queue.pop()
        assert sent == -label
        level, place = (label >> 56) - 1, (label & (1 << 56) - 1) << 1
        if len(children) == 1:
            queue.push(-_label(level, place), ALONE + proof)
        else:
            queue.push(-_label(level, place), AFTER + children[1] + proof)
            queue.push(-_label(level, place + 1), BEFORE + children[0] + proof)
    for _ in range(count):
        label, proof = queue.pop()
        yield -label, proof


def steps(proof: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, sibling) of every step of a proof, from the leaf up."""
    at = 0
    while at < len(proof):
        kind = proof[at : at + 1]
        size = 0 if kind == ALONE else 32
        yield kind, proof[at + 1 : at + 1 + size]
        at += 1 + size


def folded(digest: bytes, proof: bytes) -> bytes:
    """Root that a leaf's digest leads to along its proof."""
    for kind, sibling in steps(proof):
        digest = combined([digest] if kind == ALONE else [digest, sibling] if kind == AFTER else [sibling, digest])
    return digest


def proof_digest(proof: bytes) -> bytes:
    """Digest of all siblings of a proof."""
    return combined([sibling for kind, sibling in steps(proof) if kind != ALONE])


_NODES = "tree string, at long, node binary, height int"
_PROOFS = "tree string, at long, proof binary, subroot binary"


def _block(table: pa.Table, done: int, levels: int) -> tuple[np.ndarray, list[bytes], int, int]:
    """Order, digests, first place and levels of one block."""
    at = table.column("at").to_numpy()
    order = np.argsort(at)
    nodes = table.column("node").to_pylist()
    height = table.column("height")[0].as_py()
    return order, [nodes[k] for k in order], int(at[order[0]]), max(0, min(levels, height - done))


def _one_up(levels: int, held: int, done: int) -> Callable:
    def up(table: pa.Table) -> pa.Table:
        _, digests, first, own = _block(table, done, levels)
        root, _ = forward(digests, first, own, ExternalQueue(held))
        return pa.table({
            "tree": table.column("tree").slice(0, 1), "at": pa.array([first >> levels], pa.int64()),
            "node": pa.array([root], pa.binary()), "height": table.column("height").slice(0, 1),
        })

    return up


def _proofs(table: pa.Table, above: pa.Table, levels: int, held: int, done: int) -> tuple[np.ndarray, list[bytes]]:
    """Proofs of a block's nodes in the order of their places; both sweeps of the block."""
    order, digests, first, own = _block(table, done, levels)
    _, nodes = forward(digests, first, own, ExternalQueue(held))
    found = list(backward(nodes, above.column("proof")[0].as_py(), first, len(digests), ExternalQueue(held)))
    return order, [proof for _, proof in reversed(found)]


def _one_down(levels: int, held: int, done: int) -> Callable:
    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"tree": pa.array([], pa.string()), "at": pa.array([], pa.int64()),
                             "proof": pa.array([], pa.binary()), "subroot": pa.array([], pa.binary())})
        order, proofs = _proofs(table, above, levels, held, done)
        return pa.table({
            "tree": table.column("tree").take(order), "at": table.column("at").take(order),
            "proof": pa.array(proofs, pa.binary()),
            "subroot": pa.array([above.column("subroot")[0].as_py()] * len(order), pa.binary()),
        })

    return down


def _keyed(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("at", levels))


def fold_up(nodes: DataFrame, levels: int = LEVELS, held: int = HELD) -> list[DataFrame]:
    """Layers of all trees from the leaves (tree, at, node, height) to one root per tree, a block's levels apart."""
    ship(__name__)
    layers = [nodes]
    tallest = nodes.agg(F.max("height")).first()[0] or 0
    for done in range(0, tallest, levels):
        blocks = _keyed(layers[-1].select("tree", "at", "node", "height"), levels)
        roots = blocks.groupBy("tree", "block").applyInArrow(_one_up(levels, held, done), _NODES)
        layers.append(spool(roots, "merkle-layer"))
    return layers


def _meet(below: DataFrame, proofs: DataFrame, levels: int):
    """Every block of a layer beside the proof of its root."""
    above = proofs.withColumnRenamed("at", "block").groupBy("tree", "block")
    return _keyed(below, levels).groupBy("tree", "block").cogroup(above)


def hand_down(layers: list[DataFrame], proofs: DataFrame, to: int, levels: int = LEVELS, held: int = HELD) -> DataFrame:
    """Proofs (tree, at, proof, subroot) of the nodes of layer ``to`` from those of the last layer's."""
    for depth in range(len(layers) - 2, to - 1, -1):
        nodes = layers[depth].select("tree", "at", "node", "height")
        sent = _meet(nodes, proofs, levels).applyInArrow(_one_down(levels, held, depth * levels), _PROOFS)
        proofs = spool(sent, "merkle-proofs")
    return proofs


def _height(count: Column) -> Column:
    """Levels above ``count`` leaves, two nodes to a parent."""
    return F.when(count <= 1, 0).otherwise(F.length(F.bin(count - 1))).cast("int")


def _place(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with their place in their tree and the tree's height, written once."""
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves"))
    placed = global_index(leaves, order, "at", ["tree"])
    return spool(placed.join(sizes, "tree").withColumn("height", _height(F.col("leaves"))).drop("leaves"), "merkle-leaves")


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS, held: int = HELD) -> DataFrame:
    """Manifest of documents: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), hex digests.

    A tree for each language, whose roots in the order of their languages (null
    first, then by bytes) are the leaves of the top tree. ``tampered`` marks rows
    whose n_chars is raised by one before the leaf is checked against its proof;
    rows with a null there stay as they are. A null field is hashed as ``-``.
    Rows with the same id, null ids last, stand in the order of their digests, so
    the result does not depend on the order of the rows; wholly equal rows are
    leaves of their own. An empty table gives no rows. Other columns are not
    read. Texts are hashed where they are read.
    """
    ship(__name__)
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    marked = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = spool(
        docs.select(
            F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", leaf_digest(fields).alias("node"),
            F.when(marked, leaf_digest(changed)).alias("seen"),
        ),
        "merkle-rows",
    )
    placed = _place(leaves, ["doc_id", "node"])
    layers = fold_up(placed, levels, held)
    subroots = layers[-1].select("tree", F.col("node").alias("subroot"))
    crowns = _place(
        subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node")), ["name"]
    )
    top = fold_up(crowns, levels, held)
    found = top[-1].select(F.hex("node").alias("root")).first()
    root = bytes.fromhex(found["root"]) if found else b""
    start = top[-1].select("tree", "at", F.lit(b"").cast("binary").alias("proof"), F.col("node").alias("subroot"))
    handed = hand_down(top, start, 0, levels, held)
    named = spool(
        handed.join(crowns.select("at", "name", "node"), "at")
        .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "proof", F.col("node").alias("subroot")),
        "merkle-tops",
    )
    proofs = hand_down(layers, named, 1, levels, held)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def check(table: pa.Table, above: pa.Table) -> pa.Table:
        if table.num_rows:
            order, known = _proofs(table, above, levels, held, 0)
        else:
            order, known = np.empty(0, np.int64), []
        ids, own, seen = (table.column(c).take(order) for c in ("doc_id", "node", "seen"))
        own, seen = own.to_pylist(), seen.to_pylist()
        ends = [folded(other or digest, proof) for digest, other, proof in zip(own, seen, known)]
        subroot = above.column("subroot")[0].as_py().hex() if len(known) else ""
        return pa.table({
            "doc_id": ids, "leaf": [d.hex() for d in own], "subroot": pa.array([subroot] * len(own), pa.string()),
            "root": pa.array([root.hex()] * len(own), pa.string()),
            "proof_sha256": pa.array([proof_digest(p).hex() for p in known], pa.string()),
            "folded_root": pa.array([d.hex() for d in ends], pa.string()),
            "verified": pa.array([d == root for d in ends], pa.bool_()),
        })

    return _meet(layers[0], proofs, levels).applyInArrow(check, out)
