"""Packing documents into token windows by order-preserving dynamic programming.

Each task walks its documents in order, as one stream of token ids. Windows may
be cut at document ends, at sentence ends, and, inside a sentence longer than a
window, at every full window. With P_j the tokens before boundary j, the least
cost of cutting at j is

    D_j = cut_j + window + min over P_j - size <= P_i < P_j of D_i + size - (P_j - P_i)

or D_i + cut_j + window where P_j - P_i is a power of two, which needs no padding. The
minimum of D_i + P_i over the sliding range is kept in a monotone queue, so a
boundary costs constant time. The stream is solved in stretches; the last
windows of a stretch are solved again with the next one, so only a task's last
window has padding beyond the optimum. Nothing is shuffled or collected.
"""

from __future__ import annotations

import base64
import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duelframe.llm.common import give_back, once_per_worker
from duelframe.session import ship

SIZE = 2048
END_ID = 1
#: Costs in tokens of padding: a cut at a document's end, at a sentence's end, inside a sentence.
DOCUMENT_CUT, SENTENCE_CUT, HARD_CUT = 0, 4, 64
#: Cost of a window, so that short windows (a power of two has no padding) are cut only where they save more.
WINDOW = 16
#: A stretch is solved when this many tokens have gathered; so many last windows are left for the next one.
STRETCH, OVERLAP = 400_000, 4
CACHED_WORDS = 200_000


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that a vocabulary's JSON file adds to its pieces; texts are split at them before anything else."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"{path}: {token['content']} takes in what is around it, which is not supported")
    return {token["content"]: token["id"] for token in found}


class Tokens:
    """Token ids of texts and the tokens at which sentences end; the vocabulary file is a parameter, and so are the tokens added to it."""

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import re

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._encode = self._encoding.encode_ordinary
        self._words: dict[str, bytes] = {}  # ids of a word after a space; bounded
        self._gap = re.compile(r"\s\s")
        self._added = {token: np.array([rank], dtype="<u2") for token, rank in (added or {}).items()}
        # the longest first, as the leftmost longest one counts
        self._split = re.compile(f"({'|'.join(map(re.escape, sorted(self._added, key=len, reverse=True)))})") if self._added else None
        size = max([*ranks.values(), *(added or {}).values()]) + 1
        self._ends, self._begins, self._spaced = (np.zeros(size, bool) for _ in range(3))
        for token, rank in ranks.items():
            self._ends[rank] = token[-1:] in (b".", b"!", b"?", b"\n")
            self._begins[rank] = token[:1] in (b" ", b"\n")
            self._spaced[rank] = token[:1] == b" "
        self._lines = np.zeros(size, bool)
        for token, rank in ranks.items():
            self._lines[rank] = token.endswith(b"\n")

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, without the end id: those of added tokens, and of the parts between them."""
        if self._split is None or not text or not self._split.search(text):
            return self._plain(text)
        parts = self._split.split(text)
        return np.concatenate([self._added[part] if k % 2 else self._plain(part) for k, part in enumerate(parts)])

    def _plain(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens.

        Byte-level pieces never reach across a single space between two words,
        so a text without double white space is the ids of its words in a row.
        """
        if not text:
            return np.empty(0, np.uint16)
        try:
            words = text.split(" ")
            if "" in words or self._gap.search(text):
                return self._whole(text)
            found = list(map(self._words.get, words))
            found[0] = self._whole(words[0]).tobytes()
            if None in found and not self._look_up(words, found):
                return self._whole(text)
            return np.frombuffer(b"".join(found), dtype="<u2")
        except UnicodeEncodeError:  # a lone surrogate cannot be encoded: as the replacement sign
            return self._plain(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), dtype="<u2")

    def _look_up(self, words: list[str], found: list[bytes | None]) -> bool:
        """Fill in the words not met before, all in one call."""
        missing = [k for k, ids in enumerate(found) if ids is None]
        ids = self._whole(" " + " ".join([words[k] for k in missing]))
        starts = np.flatnonzero(self._spaced[ids]).tolist()
        if len(starts) != len(missing):
            return False
        raw = ids.tobytes()
        starts.append(len(ids))
        for n, k in enumerate(missing):
            found[k] = raw[2 * starts[n] : 2 * starts[n + 1]]
            if len(self._words) < CACHED_WORDS:
                self._words[words[k]] = found[k]
        return True

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids after which a sentence or line ends, inside a text."""
        if len(ids) < 2:
            return np.empty(0, np.int64)
        ends = self._ends[ids[:-1]] & (self._begins[ids[1:]] | self._lines[ids[:-1]])
        return np.flatnonzero(ends) + 1


def boundaries(ends: np.ndarray, total: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of ``total`` tokens may be cut, and each cut's cost with its window's; the last is its end."""
    at = np.append(ends[ends < total], total)
    gaps = np.diff(at, prepend=0)
    if gaps.max(initial=0) > size:
        hard = [np.arange(e - g + size, e, size) for e, g in zip(at[gaps > size], gaps[gaps > size])]
        places = np.concatenate([at, *hard])
        costs = np.concatenate([np.full(len(at), SENTENCE_CUT), np.full(len(places) - len(at), HARD_CUT)])
        order = np.argsort(places, kind="stable")
        at, costs = places[order], costs[order]
    else:
        costs = np.full(len(at), SENTENCE_CUT)
    costs[-1] = DOCUMENT_CUT
    return at, costs + WINDOW


def best_cuts(at: np.ndarray, costs: np.ndarray, size: int = SIZE) -> list[int]:
    """Numbers of the boundaries to cut at, the last one included.

    ``at``: rising token counts from 0 (a free start); gaps are ``size`` at most.
    """
    n = len(at)
    exact: dict[int, list[int]] = {}
    length = 1
    while length <= size:
        found = np.searchsorted(at, at - length)
        for j in np.flatnonzero(at[found] == at - length).tolist():
            exact.setdefault(j, []).append(int(found[j]))
        length *= 2
    place, cost = at.tolist(), costs.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(place[0], 0)])  # (D_i + P_i, i), smallest first
    for j in range(1, n):
        p = place[j]
        while place[queue[0][1]] < p - size:
            queue.popleft()
        value, i = queue[0]
        value += size - p
        if j in exact:
            for k in exact[j]:
                if best[k] < value:
                    value, i = best[k], k
        value += cost[j]
        best[j], back[j] = value, i
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Stream of documents in, pieces out: (document, start, ids, document's tokens, window, offset, window's tokens)."""

    def __init__(self, size: int = SIZE):
        self._size = size
        self._docs: list[list] = []  # name, ids with the end id, first id not given out, ends (absolute), costs
        self._waiting = 0
        self._window = 0

    def add(self, name: object, ids: np.ndarray, at: np.ndarray, costs: np.ndarray) -> Iterator[tuple]:
        self._docs.append([name, ids, 0, at, costs])
        self._waiting += len(ids)
        if self._waiting >= STRETCH:
            yield from self._solve(OVERLAP)

    def finish(self) -> Iterator[tuple]:
        yield from self._solve(0)

    def _solve(self, left: int) -> Iterator[tuple]:
        if not self._docs:
            return
        base, places, costs = 0, [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for _, ids, start, at, cost in self._docs:
            open_ = at > start
            places.append(at[open_] - start + base)
            costs.append(cost[open_])
            base += len(ids) - start
        at = np.concatenate(places)
        cuts = best_cuts(at, np.concatenate(costs), self._size)
        given = 0
        for j in cuts[: len(cuts) - left]:
            yield from self._give(int(at[j]) - given)
            given = int(at[j])
        self._waiting -= given

    def _give(self, tokens: int) -> Iterator[tuple]:
        """The next window: so many tokens from the front of the stream."""
        offset, used = 0, 0
        while offset < tokens:
            doc = self._docs[used]
            name, ids, start = doc[0], doc[1], doc[2]
            take = min(tokens - offset, len(ids) - start)
            yield name, start, ids[start : start + take], len(ids), self._window, offset, tokens
            doc[2] = start + take
            offset += take
            used += doc[2] == len(ids)
        del self._docs[:used]
        self._window += 1


def pack_documents(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of packed windows: (id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens).

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers;
    ``added`` names the tokens that texts are split at, with their ids. A null or empty text is the end id alone. Every id of every row lies in
    exactly one piece, repeated rows included; documents keep their order within
    a task, ties of cost take the longest window. An empty table gives no rows.
    Very long texts are cut over many windows. Other columns are not read.
    """
    ship(__name__)
    kind = docs.schema[id_column].dataType
    out = T.StructType([
        T.StructField(id_column, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("sequence_tokens", T.LongType()),
    ])

    key = (path, pattern, tuple(sorted((added or {}).items())))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = once_per_worker("tokens", key, lambda: Tokens(path, pattern, added)), Packer(size)
        first = TaskContext.get().partitionId() << 33  # windows of a task are numbered below this
        names, rows = None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [
                pa.array([x for x in columns[0]], type=names), pa.array(columns[1], pa.int64()),
                pa.array([len(x) for x in columns[2]], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in columns[2]], pa.binary()),
                pa.array(columns[3], pa.int64()), pa.array([first + x for x in columns[4]], pa.int64()),
                pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.int64()),
            ]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out.fields])

        for part in batches:
            names = part.schema.field(0).type
            for name, text in zip(part.column(0).to_pylist(), part.column(1)):
                ids = np.append(tokens.ids(text.as_py() or ""), np.uint16(END_ID))
                rows.extend(packer.add(name, ids, *boundaries(tokens.sentence_ends(ids[:-1]), len(ids), size)))
                if len(rows) >= 2000:
                    yield batch()
            give_back()
        rows.extend(packer.finish())
        if rows:
            yield batch()

    return docs.select(id_column, text_column).mapInArrow(pack, out)
