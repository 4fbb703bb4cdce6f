"""Near-duplicate texts by b-bit MinHash.

1. Every document's word shingles are hashed and ``HASHES`` minima taken; bands
   of minima are its candidate keys, and the low ``BITS`` bits of the minima its
   packed signature.
2. Documents with equal shingle sets form a class; one row per class goes on.
3. Classes that share a band key form candidate groups, found as components of
   (smallest id of the key, id) edges, so a key costs rows in proportion to its
   members. Links of similarity 0.8 share a band but for about three in 10^6
   pairs, those of 0.85 but for two in 10^9.
4. Groups are cut into blocks of bounded size by set size, as sets of very
   different sizes cannot be similar. A task compares two blocks: similarity is
   estimated from the bits that agree, corrected for those that agree by
   chance, and pairs near the threshold or above are confirmed on full sets.
   It returns a spanning forest of its links, never all pairs.
5. Components of the forests are the groups of near duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import connected_components, forget_kept, fresh_name, give_back, join_sized
from duelframe.session import ship, spool

WORDS, PERCENT = 3, 85
BANDS, ROWS = 42, 6
HASHES, BITS = BANDS * ROWS, 4
LANES = 16  # 64-bit words of a packed signature: 16 minima of 4 bits each
#: Estimates this far below the threshold are still confirmed: six standard deviations of the estimate at 0.85.
MARGIN = 0.14
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20

_random = np.random.default_rng(20240607)
BYTE_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))
FLIPS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
FACTORS = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; words are runs without ASCII white space."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    gap = SPACE[raw]
    inside = ~gap
    if not inside.any():
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([gap[1:], [True]])) + 1
    lengths = ends - starts
    kept = np.flatnonzero(inside)
    place = np.arange(len(kept)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    codes = BYTE_CODES[raw[kept]] * POWERS[place % len(POWERS)] * (place // len(POWERS) * 2 + 1).astype(np.uint64)
    return mixed(np.add.reduceat(codes, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + lengths.astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words are none."""
    if not text:
        return np.empty(0, np.uint64)
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    span = min(words, len(hashes))
    total = np.zeros(len(hashes) - span + 1, dtype=np.uint64)
    for k in range(span):
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - span + 1 + k])
    return np.unique(total + np.uint64(span))


def minima(sets: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    small = (sets >> np.uint64(32)).astype(np.uint32)
    for first in range(0, len(small), 256):
        part = (small[first : first + 256, None] ^ FLIPS) * FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """Low ``BITS`` bits of the minima, 16 to a 64-bit word; what is left of the last word is 0."""
    low = np.zeros(LANES * 16, dtype=np.uint64)
    low[:HASHES] = mixed(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(low.reshape(LANES, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), axis=1).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = mixed(least.astype(np.uint64).reshape(BANDS, ROWS) + np.arange(ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(np.bitwise_xor.reduce(rows, axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimated(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarities of signatures (rows of ``LANES`` words): agreeing minima, less those that agree by chance."""
    differ = np.zeros((len(left), len(right)), dtype=np.uint16)
    lanes = np.uint64(0x1111111111111111)
    for k in range(LANES):
        x = left[:, k, None] ^ right[None, :, k]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        differ += np.bitwise_count(x & lanes)
    chance = 2.0**-BITS
    return ((HASHES - differ.astype(np.float32)) / HASHES - chance) / (1 - chance)


def compare_blocks(left: pd.DataFrame, right: pd.DataFrame | None, percent: int = PERCENT) -> pd.DataFrame:
    """Spanning forest (a, b) of the links between two blocks, or within one if ``right`` is None.

    Blocks hold (rep, n, sig, shingles). Pairs already joined through others are not confirmed again.
    """
    other = left if right is None else right
    ids = np.concatenate([left["rep"].to_numpy(), other["rep"].to_numpy()]) if right is not None else left["rep"].to_numpy()
    shift = 0 if right is None else len(left)
    root = np.arange(len(ids))
    links: list[tuple[int, int]] = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def signatures(block: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(block["sig"]), dtype=np.uint64).reshape(-1, LANES)

    sizes_l, sizes_r = left["n"].to_numpy(), other["n"].to_numpy()
    near = estimated(signatures(left), signatures(other)) >= percent / 100 - MARGIN
    near &= (100 * sizes_l[:, None] >= percent * sizes_r[None]) & (100 * sizes_r[None] >= percent * sizes_l[:, None])
    if right is None:
        near = np.triu(near, 1)
    if near.any():
        sets = [np.frombuffer(s, dtype=np.uint64) for s in other["shingles"]]
        asked = [np.frombuffer(s, dtype=np.uint64) for s in left["shingles"]] if right is not None else sets
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for i in np.flatnonzero(near.any(axis=1)):
            mine = find(i)
            open_ = [j for j in np.flatnonzero(near[i]) if find(j + shift) != mine]
            if not open_:
                continue
            first, last = np.searchsorted(values, asked[i]), np.searchsorted(values, asked[i], "right")
            count = last - first
            at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            for j in open_:
                both = int(common[j])
                if 100 * both >= percent * (int(sizes_l[i]) + int(sizes_r[j]) - both):
                    a, b = find(i), find(j + shift)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append((i, j + shift))
    return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, columns=["a", "b"]).astype("int64")


def keep_one(docs: DataFrame, words: int, percent: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id.

    All columns stay. Groups are made of texts: rows of one id with unlike texts
    are judged each on its own, rows of one id with the same text are copies of
    each other. Rows with a null id or without words are kept.
    """
    _, rows, classes, linked, _ = _classed(docs, id_column, text_column, words, percent)
    # the group of a class, and of a group the class with the smallest id
    groups = join_sized(classes.select("rep", "name", "copies"), linked.select(F.col("node").alias("rep"), F.col("component").alias("g")), ["rep"], "left")
    groups = groups.withColumn("g", F.coalesce("g", "rep"))
    heads = groups.groupBy("g").agg(F.min(F.struct("name", "rep")).alias("head"), F.sum("copies").alias("rows")).where("rows > 1")
    found = spool(
        join_sized(groups.select("rep", "g"), heads, ["g"]).select("rep", F.col("head.rep").alias("head"), F.col("head.name").alias("head_id")), "near-heads"
    )
    # of the head class the row of the smallest id and text stays
    members = join_sized(rows.select("doc_id", "same", "rep"), found, ["rep"])
    first = members.where("rep = head AND doc_id = head_id").groupBy("rep").agg(F.min("same").alias("first"))
    judged = members.join(first, "rep", "left").withColumn("stays", F.coalesce((F.col("doc_id") == F.col("head_id")) & (F.col("same") == F.col("first")), F.lit(False)))
    judged = spool(judged.groupBy("doc_id", "same").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows")), "near-judged")
    own_id, own_same = (fresh_name(docs.columns, c) for c in ("near_id", "near_same"))
    keyed = docs.withColumns({own_id: F.col(id_column).cast("long"), own_same: F.coalesce(F.xxhash64(text_column), F.lit(0))})
    named = lambda df: df.select(F.col("doc_id").alias(own_id), F.col("same").alias(own_same))
    kept = join_sized(keyed, named(judged.where("NOT stays")), [own_id, own_same], "left_anti")
    repeated = spool(named(judged.where("stays AND rows > 1")), "near-repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = join_sized(kept, repeated, [own_id, own_same], "left_semi").dropDuplicates([own_id, own_same])
    return join_sized(kept, repeated, [own_id, own_same], "left_anti").unionByName(once).select(*docs.columns)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts link if 100 * intersection >= ``percent`` * union of their shingle
    sets. Null, empty and blank texts have no shingles and link with nothing.
    Rows with a null id link with nothing, have a null component and are kept.
    Links are found between texts and folded to ids at the end, so unlike texts
    of one id bring all their links, and are in one component as they share the
    id; ties do not matter. Repeated rows get equal results; exact copies of any
    number cost one class. Whole texts are read. Empty tables give no rows; other
    columns are not read.
    """
    signed, rows, classes, _, links = _classed(docs, id_column, text_column, words, percent)
    ids = classes.select("rep", "name")
    named = links.join(ids.withColumnsRenamed({"rep": "a", "name": "x"}), "a").join(ids.withColumnsRenamed({"rep": "b", "name": "y"}), "b").select("x", "y")
    # an id with several texts holds their classes together
    several = spool(rows.select("doc_id", "rep").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-several")
    held = join_sized(rows.select("doc_id", "rep"), several, ["doc_id"]).join(ids, "rep").select(F.col("doc_id").alias("x"), F.col("name").alias("y"))
    edges = named.unionByName(held).select(F.col("x").alias("a"), F.col("y").alias("b"))
    folded = spool(connected_components(edges, "near-ids").select("node", "component"), "near-folded")
    # a row's own class leads to its name, unless the id itself is in a component
    copied = join_sized(rows.select("doc_id", "rep"), classes.where("copies > 1").select("rep", "name"), ["rep"]).select("doc_id", "name").distinct()
    leads = copied.groupBy("doc_id").agg(F.min("name").alias("name"))
    out = signed.select("doc_id", "n").join(leads, "doc_id", "left").withColumn("name", F.coalesce("name", "doc_id"))
    out = join_sized(out, folded.select(F.col("node").alias("name"), "component"), ["name"], "left")
    component = F.coalesce("component", "name")
    return out.select(
        F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _classed(docs: DataFrame, id_column: str, text_column: str, words: int, percent: int) -> tuple[DataFrame, ...]:
    """Signed rows; rows with words and an id, with their class; classes of equal sets (rep, name: smallest id, copies);
    components of linked classes; links between classes.

    A class has a number of its own, so that unlike texts of one id are not taken for one another.
    """
    ship(__name__)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(F.xxhash64(text_column), F.lit(0)).alias("same"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            n, h1, h2, sig, bands = [], [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                least = minima(found)
                n.append(len(found))
                h1.append(_sum_of(found))
                h2.append(_other_of(found))
                sig.append(packed(least))
                bands.append(band_keys(least))
            columns = [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (n, h1, h2)), pa.array(sig, pa.binary()),
                       pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "n", "h1", "h2", "sig", "bands"])
            give_back()

    signed = spool(
        rows.mapInArrow(sign, "doc_id long, same long, n long, h1 long, h2 long, sig binary, bands array<long>"), "near-signatures"
    )
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    found = named.groupBy("h1", "h2", "n").agg(
        F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    reps = spool(found.withColumn("rep", F.monotonically_increasing_id()), "near-classes")
    classes = reps.select("rep", "name", "copies", "h1", "h2", "n")
    of_class = join_sized(named.select("doc_id", "same", "h1", "h2", "n"), classes.select("rep", "h1", "h2", "n"), ["h1", "h2", "n"])
    of_class = spool(of_class.select("doc_id", "same", "rep"), "near-rows")
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = spool(
        keys.groupBy("key").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("members"))
        .where("members > 1").select("key", "first"),
        "near-keys",
    )
    candidates = join_sized(keys, shared, ["key"]).select(F.col("first").alias("a"), F.col("rep").alias("b")).where("a <> b")
    groups = connected_components(candidates, "near-groups").select(F.col("node").alias("rep"), F.col("component").alias("g"))
    groups = spool(groups, "near-groups")
    lean = spool(join_sized(reps.select("rep", "n", "sig"), groups, ["rep"]), "near-members")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = [shingles(t, words) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n": [len(f) for f in every], "h1": [_sum_of(f) for f in every], "h2": [_other_of(f) for f in every],
                "shingles": [f.tobytes() for f in every],
            })
            del every
            give_back()

    wanted = spool(join_sized(classes.drop("copies"), groups.select("rep"), ["rep"]).withColumnRenamed("name", "doc_id"), "near-wanted")
    texts = join_sized(rows.drop("same"), wanted.select("doc_id").distinct(), ["doc_id"], "left_semi")
    held = texts.mapInPandas(sets, "doc_id long, n long, h1 long, h2 long, shingles binary")
    held = join_sized(held, wanted, ["doc_id", "n", "h1", "h2"]).groupBy("rep").agg(F.first("shingles").alias("shingles"))

    # blocks: a group's sets by size, so that linked sets are in the same or in neighbouring steps
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    sizes = lean.groupBy("g").agg(F.count(F.lit(1)).alias("all_sets"), F.sum("n").alias("all_shingles"))
    small = (F.col("all_sets") <= BLOCK_SETS) & (F.col("all_shingles") <= BLOCK_SHINGLES)
    stepped = join_sized(lean, sizes.select("g", small.alias("small")), ["g"]).withColumn("step", F.when(F.col("small"), 0).otherwise(step))
    blocks = spool(
        stepped.groupBy("g", "step").agg(
            F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES, F.lit(1))).cast("int").alias("parts")
        ),
        "near-blocks",
    )
    after = blocks.select("g", (F.col("step") - 1).alias("step"), F.col("parts").alias("parts_after"))
    before = blocks.select("g", (F.col("step") + 1).alias("step"), F.col("parts").alias("parts_before"))
    plan = blocks.join(after, ["g", "step"], "left").join(before, ["g", "step"], "left")
    cast = join_sized(stepped.select("rep", "n", "sig", "g", "step"), plan, ["g", "step"]).withColumn(
        "part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    )

    def meeting(s1, p1, s2, p2, side):
        return F.struct(*[x.cast("int").alias(n) for x, n in ((s1, "s1"), (p1, "p1"), (s2, "s2"), (p2, "p2"), (F.lit(side), "side"))])

    def upto(last):
        """Numbers 0 .. last - 1."""
        return F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))

    me, p = F.col("step"), F.col("part")
    within_left = F.transform(F.sequence(p, F.col("parts") - 1), lambda q: meeting(me, p, me, q, 0))
    within_right = F.transform(upto(p), lambda q: meeting(me, q, me, p, 1))
    onward = F.transform(upto(F.coalesce("parts_after", F.lit(0))), lambda q: meeting(me, p, me + 1, q, 0))
    backward = F.transform(upto(F.coalesce("parts_before", F.lit(0))), lambda q: meeting(me - 1, q, me, p, 1))
    meetings = F.concat(within_left, within_right, onward, backward)
    dealt = (
        cast.join(held, "rep").select("rep", "n", "sig", "shingles", "g", F.explode(meetings).alias("m"))
        .select("rep", "n", "sig", "shingles", "g", "m.*")
    )

    def link(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["side"] == 0], block[block["side"] == 1]
        same = (block["s1"].iloc[0], block["p1"].iloc[0]) == (block["s2"].iloc[0], block["p2"].iloc[0])
        if same:
            return compare_blocks(left, None, percent)
        return compare_blocks(left, right, percent) if len(left) and len(right) else compare_blocks(left.iloc[:0], None, percent)

    links = spool(dealt.groupBy("g", "s1", "p1", "s2", "p2").applyInPandas(link, "a long, b long"), "near-found")
    linked = spool(connected_components(links, "near-links"), "near-linked")
    return signed, of_class, classes, linked, links


def _sum_of(found: np.ndarray) -> int:
    return int(np.add.reduce(found).view(np.int64))


def _other_of(found: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mixed(found * np.uint64(3))).view(np.int64))
