"""Cross-tokenizer alignment, with corpus-wide counts of linked id pairs by external spill counting.

Both tokenizers cut the bytes of a text; two tokens are linked if their byte
ranges overlap. A task aligns its documents and gathers (pair, document) records
in memory. When enough have come together they are sorted side-major, that is by
the first token's radix, the first token, the second token and the document, and
spilled as one run: for every radix a compressed header (pairs and the number of
their documents) and compressed postings (documents and links). The headers of a
radix are merged over all runs by a heap of their next first tokens: a first
token that comes up brings all its pairs at once, so their counts add up, their
highest count is known, and both stream back to the runs they came from. With
more runs than a merge takes at once, runs are merged in groups and groups are
merged again; the answers go the same way back. Postings never leave their run,
so a pair that every document holds is spread over all runs.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import once_per_worker
from duelframe.session import ship, spool

#: Records (links, repeated ones included) that a task gathers before it spills a run, and the documents of a run at most.
RUN_LINKS, RUN_DOCS = 3_000_000, 60_000
#: Radix of the first token's id (a power of two), and the runs that one merge takes.
RADIX, FAN_IN = 32, 256
CACHED_WORDS = 200_000
#: Characters that are aligned at a time.
AT_ONCE = 1_000_000
_RADIX_BITS, _A_BITS, _B_BITS = 5, 16, 15
_BLANK = "▁"

#: Alignment of a piece of text: its counts as one number (tokens of A, of B, groups), the groups as text, and the linked pairs.
Aligned = tuple[int, bytes, bytes]
_COUNT = 40  # bits of each count


def counts_of(total: int) -> tuple[int, int, int]:
    """Tokens of A, of B and groups."""
    mask = (1 << _COUNT) - 1
    return total >> 2 * _COUNT, total >> _COUNT & mask, total & mask


def side_major(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sort keys of pairs: radix of A's id, the rest of A's id, B's id."""
    a = a.astype(np.uint32)
    return ((a & (RADIX - 1)) << (_A_BITS - _RADIX_BITS) | a >> _RADIX_BITS) << _B_BITS | b.astype(np.uint32)


def aligned(a_ids: np.ndarray, a_end: np.ndarray, b_ids: np.ndarray, b_end: np.ndarray, cuts: np.ndarray) -> Iterator[Aligned]:
    """Align two token rows of the same bytes, part by part.

    ``a_end``, ``b_end``: byte offsets at which tokens end; ``cuts``: those at which parts end, common ends of both rows.
    """
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    a_cut, b_cut = np.searchsorted(a_end, common, "right"), np.searchsorted(b_end, common, "right")
    # tokens of B that overlap a token of A: from the one that holds its first byte to the one that holds its last
    first = np.searchsorted(b_end, np.append(0, a_end[:-1]), "right")
    each = np.searchsorted(b_end, a_end - 1, "right") - first + 1
    linked = np.cumsum(each)
    at = np.arange(linked[-1]) + np.repeat(first - linked + each, each)
    pairs = side_major(np.repeat(a_ids, each), b_ids[at]).astype("<u4").tobytes()
    a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
    groups, i, j = [], 0, 0
    for to_a, to_b in zip(a_cut.tolist(), b_cut.tolist()):
        one = a_text[i] if to_a - i == 1 else ",".join(a_text[i:to_a])
        other = b_text[j] if to_b - j == 1 else ",".join(b_text[j:to_b])
        groups.append(f"{one}|{other}")
        i, j = to_a, to_b
    places = np.searchsorted(common, cuts) + 1
    a_to, b_to = a_cut[places - 1], b_cut[places - 1]
    link_to = 4 * linked[a_to - 1]
    a = b = g = p = 0
    for na, nb, ng, np_ in zip(a_to.tolist(), b_to.tolist(), places.tolist(), link_to.tolist()):
        yield (na - a) << 2 * _COUNT | (nb - b) << _COUNT | (ng - g), ";".join(groups[g:ng]).encode(), pairs[p:np_]
        a, b, g, p = na, nb, ng, np_


def _letters_of_bytes() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    letters.update({chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(plain)))})
    return letters


class TwoTokenizers:
    """Alignments of texts by two tokenizers; parts of texts that come again are aligned once per task.

    No token of A crosses a single blank or line break between two words, and
    no piece of B holds one after its first sign, so there a text falls into
    parts that are aligned on their own. Texts with other white space, or with
    several in a row, are aligned as a whole.
    """

    def __init__(self, bytes_path: str, pattern: str, pieces_path: str):
        import json

        import sentencepiece
        import tiktoken

        letters = _letters_of_bytes()
        with open(bytes_path, encoding="utf-8") as file:
            model = json.load(file)
        special = {token["content"] for token in model["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): k for t, k in model["model"]["vocab"].items() if t not in special}
        self._a = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        self._a_bytes = [b""] * len(self._a_size)
        for token, rank in ranks.items():
            self._a_size[rank], self._a_bytes[rank] = len(token), token
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        self._b_bytes = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(k) else p.replace(_BLANK, " ").encode() for k, p in enumerate(pieces)
        ]
        self._b_size = np.array(list(map(len, self._b_bytes)))
        if len(self._a_bytes) - 1 >> _A_BITS or len(pieces) - 1 >> _B_BITS:
            raise ValueError("a vocabulary has more ids than a pair holds")
        # pieces must not cross the borders of parts
        self._in_parts = not any(_BLANK in p[1:] and p.strip(_BLANK) or "\n" in p for p in pieces)
        self._odd = re.compile(r"\A\s|\s\s|\s\Z|[^\S \n]|" + _BLANK)
        self._part = re.compile(r"[ \n][^ \n]+")
        self._known: dict[str, Aligned | None] = {}

    def align(self, texts: list[str]) -> Iterator[list[Aligned] | None]:
        """For each text, after a blank, the alignments of its parts; None if a tokenizer does not give its bytes back."""
        parted = [None if not self._in_parts or self._odd.search(t) else self._part.findall(" " + t) for t in texts]
        known = self._known
        new = [p for p in dict.fromkeys(p for parts in parted if parts for p in parts) if p not in known]
        fresh = dict(zip(new, self._many(new)))
        room = CACHED_WORDS - len(known)
        if room >= len(new):
            known.update(fresh)
        elif room > 0:
            known.update({part: fresh[part] for part in new[:room]})
        for text, parts in zip(texts, parted):
            if parts is None:
                found = self._many([" " + text])
            else:
                found = [known[p] if p in known else fresh[p] for p in parts]
            yield None if None in found else found

    def _many(self, parts: list[str]) -> list[Aligned | None]:
        """Alignments of parts, each of which begins with a blank or a line break, in one go."""
        if not parts:
            return []
        led = [" .", *parts]  # B puts a blank of its own before a text
        spaced = "".join(led)
        raw, cuts = spaced.encode(), np.cumsum([len(p.encode()) for p in led])
        a_ids, b_ids = np.array(self._a.encode_ordinary(spaced)), np.array(self._b.encode(spaced[1:]))
        a_end, b_end = np.cumsum(self._a_size[a_ids]), np.cumsum(self._b_size[b_ids])
        same = all(
            b"".join(map(names.__getitem__, ids.tolist())) == raw and np.isin(cuts, ends, assume_unique=True).all()
            for names, ids, ends in ((self._a_bytes, a_ids, a_end), (self._b_bytes, b_ids, b_end))
        )
        if same:
            return list(aligned(a_ids, a_end, b_ids, b_end, cuts))[1:]
        if len(parts) > 1:  # find the parts that are not given back
            half = len(parts) // 2
            return self._many(parts[:half]) + self._many(parts[half:])
        return [self._alone(parts[0])]

    def _alone(self, spaced: str) -> Aligned | None:
        """Alignment of a text that begins with a blank, nothing before it."""
        if spaced[0] != " ":
            return None
        raw = spaced.encode()
        a_ids, b_ids = np.array(self._a.encode_ordinary(spaced)), np.array(self._b.encode(spaced[1:]), np.int64)
        for names, ids in ((self._a_bytes, a_ids), (self._b_bytes, b_ids)):
            if b"".join(map(names.__getitem__, ids.tolist())) != raw:
                return None
        a_end, b_end = np.cumsum(self._a_size[a_ids]), np.cumsum(self._b_size[b_ids])
        return next(aligned(a_ids, a_end, b_ids, b_end, np.array([len(raw)])))


def packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Compressed numbers; bytes of equal weight lie together."""
    import zstandard

    plain = numbers.astype(kind)
    planes = plain.view(np.uint8).reshape(len(plain), plain.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def rising(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys.astype(np.int64), prepend=0))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).astype(np.int64))


class Run:
    """(pair, document) records of a task, until they are spilled."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.links = 0
        self._pairs: list[bytes] = []

    def add(self, doc: tuple, pairs: Iterable[bytes]) -> None:
        """``doc``: id, tokens of A, of B, groups, links, digest of the groups."""
        self.docs.append(doc)
        self._pairs.extend(pairs)
        self.links += doc[4]

    def spill(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
        """(radix, pairs, document counts, documents, links) of every radix met, each compressed, sorted side-major."""
        keys = np.frombuffer(b"".join(self._pairs), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(self.docs), dtype=np.uint64), [d[4] for d in self.docs])
        keys = np.sort(keys << np.uint64(32) | owner)
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
        times = np.diff(np.append(starts, len(keys)))
        keys = keys[starts]
        pairs, owner = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        first = np.flatnonzero(np.diff(pairs.astype(np.int64), prepend=-1))
        counts = np.diff(np.append(first, len(pairs)))
        heads = pairs[first]
        radix = heads >> (_A_BITS + _B_BITS - _RADIX_BITS)
        cuts = np.searchsorted(radix, np.arange(RADIX + 1))
        ends = np.append(first, len(pairs))
        for r in range(RADIX):
            lo, hi = int(cuts[r]), int(cuts[r + 1])
            if lo < hi:
                own = slice(int(ends[lo]), int(ends[hi]))
                yield r, rising(heads[lo:hi]), packed(counts[lo:hi]), packed(owner[own]), packed(times[own])


def merged(headers: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[tuple[int, int, int]]]]:
    """Heap merge of sorted headers (pairs, counts): for each first token its pairs, their counts, the highest one, and
    where its pairs lie in the headers, as (header, from, to)."""
    parts = []
    for number, (pairs, _) in enumerate(headers):
        starts = np.flatnonzero(np.diff(pairs >> _B_BITS, prepend=-1))
        ends = np.append(starts[1:], len(pairs)).tolist()
        parts.append(iter(list(zip((pairs[starts] >> _B_BITS).tolist(), [number] * len(ends), starts.tolist(), ends))))
    heap = [head for part in parts if (head := next(part, None))]
    heapq.heapify(heap)
    while heap:
        token, found = heap[0][0], []
        while heap and heap[0][0] == token:
            _, number, start, end = heap[0]
            found.append((number, start, end))
            following = next(parts[number], None)
            if following:
                heapq.heapreplace(heap, following)
            else:
                heapq.heappop(heap)
        if len(found) == 1:
            number, start, end = found[0]
            pairs, total = headers[number][0][start:end], headers[number][1][start:end]
        else:
            every = np.concatenate([headers[n][0][s:e] for n, s, e in found])
            pairs, place = np.unique(every, return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, place, np.concatenate([headers[n][1][s:e] for n, s, e in found]))
        yield pairs, total, int(total.max()), found


_HEADER = "run long, radix int, pairs binary, counts binary"
_ANSWER = "run long, radix int, totals binary, highest binary"


def _headers(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [
        (risen(p), unpacked(c, "<u8").astype(np.int64) if wide else unpacked(c).astype(np.int64))
        for p, c, wide in zip(table.column("pairs").to_pylist(), table.column("counts").to_pylist(), table.column("wide").to_pylist())
    ]


def _merge_group(table: pa.Table) -> pa.Table:
    """Several headers of a radix as one."""
    pairs, totals = [], []
    for own, total, _, _ in merged(_headers(table)):
        pairs.append(own)
        totals.append(total)
    return pa.table({
        "run": table.column("group").slice(0, 1), "radix": table.column("radix").slice(0, 1),
        "pairs": pa.array([rising(np.concatenate(pairs))], pa.binary()),
        "counts": pa.array([packed(np.concatenate(totals), "<u8")], pa.binary()),
    })


def _answers(table: pa.Table, totals: list[np.ndarray], highest: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "run": table.column("run"), "radix": table.column("radix"),
        "totals": pa.array([packed(t, "<u8") for t in totals], pa.binary()),
        "highest": pa.array([packed(h, "<u1") for h in highest], pa.binary()),
    })


def _merge_and_answer(table: pa.Table) -> pa.Table:
    """Counts of all headers of a radix, sent back to each header, with a mark on the pairs that are highest."""
    headers = _headers(table)
    totals = [np.zeros(len(p), np.int64) for p, _ in headers]
    highest = [np.zeros(len(p), bool) for p, _ in headers]
    for pairs, total, top, found in merged(headers):
        for number, start, end in found:
            own = total[np.searchsorted(pairs, headers[number][0][start:end])]
            totals[number][start:end] = own
            highest[number][start:end] = own == top
    return _answers(table, totals, highest)


def _pass_on(table: pa.Table, above: pa.Table) -> pa.Table:
    """The answer to a group, cut to the pairs of each of its headers; ``above`` holds the group's pairs as well."""
    if not table.num_rows:
        return _answers(table.select(["run", "radix"]), [], [])
    pairs = risen(above.column("pairs")[0].as_py())
    total, top = unpacked(above.column("totals")[0].as_py(), "<u8"), unpacked(above.column("highest")[0].as_py(), "<u1")
    places = [np.searchsorted(pairs, own) for own, _ in _headers(table)]
    return _answers(table, [total[k] for k in places], [top[k] for k in places])


def count_headers(headers: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(run, radix, totals, highest): for the pairs of every header, all their documents, and whether their first token has no higher count.

    ``headers``: (run, radix, pairs, counts, wide), sorted side-major and compressed.
    """
    ship(__name__)
    runs = headers.agg(F.count_distinct("run")).first()[0]
    if runs <= fan_in:
        return headers.groupBy("radix").applyInArrow(_merge_and_answer, _ANSWER)
    groups = -(-2 * runs // fan_in)
    grouped = headers.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
    heads = spool(grouped.groupBy("group", "radix").applyInArrow(_merge_group, _HEADER).withColumn("wide", F.lit(True)), "pair-headers")
    above = count_headers(heads, fan_in).join(heads.select("run", "radix", "pairs"), ["run", "radix"])
    above = above.withColumnRenamed("run", "group").groupBy("group", "radix")
    return spool(grouped.groupBy("group", "radix").cogroup(above).applyInArrow(_pass_on, _ANSWER), "pair-answers")


_STATS = "n_a long, n_b long, n_groups long, n_links long"


def align_documents(
    docs: DataFrame, bytes_path: str, pattern: str, pieces_path: str, id_column: str = "doc_id", text_column: str = "text",
    run_links: int = RUN_LINKS, fan_in: int = FAN_IN,
) -> DataFrame:
    """Per document (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A document counts once for a pair of ids, however often it holds it linked;
    ``n_best`` are links whose pair has the highest count of all pairs with its
    first token, ties included, ``count_sum`` the counts of all links. Texts that
    are null or empty, or that a tokenizer does not give back byte by byte, have
    no tokens: zeros and an empty text. Rows with the same id are documents of
    their own, as are rows without one. Strings of special tokens inside texts
    are plain text. A text is aligned whole, however long it is; a run holds
    ``run_links`` links or one document. An empty table gives no rows. Other
    columns are not read.
    """
    ship(__name__)
    kind = docs.schema[id_column].dataType.simpleString()
    doc_type = f"array<struct<id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>"
    run_type = f"run long, radix int, pairs binary, counts binary, owners binary, times binary, docs {doc_type}"
    key = (bytes_path, pattern, pieces_path)

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = once_per_worker("two tokenizers", key, lambda: TwoTokenizers(*key))
        number, run, id_type = TaskContext.get().partitionId() << 32, Run(), None

        def written() -> Iterator[pa.RecordBatch]:
            nonlocal number, run
            fields = ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            kinds = (id_type, *[pa.int64()] * 4, pa.string())
            columns = [pa.array(values, type=t) for values, t in zip(zip(*run.docs), kinds)]
            listed = pa.ListArray.from_arrays(pa.array([0, len(run.docs)], pa.int32()), pa.StructArray.from_arrays(columns, fields))
            yield _run_batch([(number, -1, None, None, None, None)], listed)
            for spilled in run.spill() if run.links else ():
                yield _run_batch([(number, *spilled)], pa.nulls(1, listed.type))
            number, run = number + 1, Run()

        def gathered(names: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            given = both.align([t for t in texts if t])
            for name, text in zip(names, texts):
                parts = next(given) if text else None
                if parts is None:
                    run.add((name, 0, 0, 0, 0, ""), [])
                else:
                    counts, groups, pairs = zip(*parts)
                    links = sum(map(len, pairs)) // 4
                    run.add((name, *counts_of(sum(counts)), links, hashlib.sha256(b";".join(groups)).hexdigest()), pairs)
                if run.links >= run_links or len(run.docs) >= RUN_DOCS:
                    yield from written()
            names.clear()
            texts.clear()

        names, texts, size = [], [], 0
        for part in batches:
            id_type = part.schema.field(0).type
            for name, text in zip(part.column(0).to_pylist(), part.column(1)):
                names.append(name)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= AT_ONCE or len(texts) >= RUN_DOCS:
                    yield from gathered(names, texts)
                    size = 0
        yield from gathered(names, texts)
        if run.docs:
            yield from written()

    runs = spool(docs.select(id_column, text_column).mapInArrow(spill, run_type), "pair-runs")
    headers = runs.where("radix >= 0").select("run", "radix", "pairs", "counts", F.lit(False).alias("wide"))
    answers = count_headers(headers, fan_in)
    postings = runs.select("run", "radix", "counts", "owners", "times", "docs")
    out = f"{id_column} {kind}, {_STATS}, n_best long, count_sum long, groups_sha256 string"

    def contribute(table: pa.Table, answer: pa.Table) -> pa.Table:
        rows = {r: k for k, r in enumerate(table.column("radix").to_pylist())}
        listed = table.column("docs")[rows[-1]].values
        best, total = np.zeros(len(listed)), np.zeros(len(listed))
        cell = lambda name, k: table.column(name)[k].as_py()
        for r, totals, highest in zip(*(answer.column(c).to_pylist() for c in ("radix", "totals", "highest"))):
            k = rows[r]
            counts, owners, times = (unpacked(cell(c, k)).astype(np.int64) for c in ("counts", "owners", "times"))
            # sums stay below 2^53, so doubles hold them exactly
            best += np.bincount(owners, times * np.repeat(unpacked(highest, "<u1"), counts), len(listed))
            total += np.bincount(owners, times * np.repeat(unpacked(totals, "<u8").astype(np.int64), counts), len(listed))
        fields = {c: listed.field(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        digest = fields.pop("groups_sha256")
        return pa.table({
            id_column: listed.field("id"), **fields, "n_best": best.astype(np.int64), "count_sum": total.astype(np.int64),
            "groups_sha256": digest,
        })

    return postings.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(contribute, out)


def _run_batch(rows: list[tuple], docs: pa.Array) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    columns: Iterable = zip(*rows)
    arrays = [pa.array(values, type=t) for values, t in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([*arrays, docs], names=["run", "radix", "pairs", "counts", "owners", "times", "docs"])
