"""Near-duplicate vectors by hierarchical navigable small-world graphs.

1. Rows with equal labels and equal vectors form a class; one row each goes on,
   so any number of copies costs one vector.
2. A label's vectors are dealt to shards of bounded size. Each shard gets a
   graph: levels of ever fewer vectors, each linked to near and mutually
   distinct neighbours, built batch by batch with the same beam search.
3. Every vector queries every shard of its label, blocks of queries at a time.
   A beam whose worst entry is still a link is widened. Each task audits a
   sample of its queries against all vectors of the shard and widens all beams
   until the audited links are all found; as wide as the shard, a beam is an
   exact scan.
4. Found pairs are confirmed by their cosine in double precision. A task returns
   each query's number of links and a spanning forest of the links, never the
   pairs of a group. Components of the forests are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import connected_components, join_sized
from duelframe.llm.vector_search import matrix, usable
from duelframe.session import ship, spool

THRESHOLD = 0.98
SHARD, QUERY_BLOCK = 8192, 2048
#: Links of a vector per level, on the lowest level, and the beams for building and for the first search.
LINKS, LOW_LINKS, BUILD_BEAM, BEAM = 12, 24, 48, 24
AUDITED = 96
BATCH = 256
#: Beam entries expanded at once.
STEP = 4
#: A beam of more than this part of the shard costs more than all of the shard, which then is the next beam.
SCAN_SHARE = 32


@dataclass
class Graph:
    """Unit vectors by position and, per level, the members and neighbours (positions, -1 where none)."""

    rows: np.ndarray
    members: list[np.ndarray]
    links: list[np.ndarray]


def beam_search(rows: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of the best ``width`` vectors met from ``entry``, best first (-1: none).

    ``entry``: positions per query. All queries walk in step.
    """
    m = len(queries)
    every = np.arange(m)[:, None]
    seen = np.zeros((m, len(rows) + 1), dtype=bool)  # the last column stands for "no neighbour"
    seen[:, -1] = True
    ids = np.full((m, width), -1)
    sims = np.full((m, width), -np.inf, dtype=np.float32)
    open_ = np.zeros((m, width), dtype=bool)

    def take(who: np.ndarray, new: np.ndarray) -> None:
        new = np.sort(new, axis=1)
        fresh = ~seen[who[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[who[:, None], new] = True
        near = np.einsum("mkd,md->mk", rows[new], queries[who])
        near[~fresh] = -np.inf
        all_ids = np.concatenate([ids[who], new], axis=1)
        all_sims = np.concatenate([sims[who], near], axis=1)
        all_open = np.concatenate([open_[who], fresh], axis=1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width] if all_sims.shape[1] > width else np.broadcast_to(
            np.arange(all_sims.shape[1]), all_sims.shape)
        line = np.arange(len(who))[:, None]
        kept = best.shape[1]
        ids[who[:, None], np.arange(kept)[None]] = all_ids[line, best]
        sims[who[:, None], np.arange(kept)[None]] = all_sims[line, best]
        open_[who[:, None], np.arange(kept)[None]] = all_open[line, best] & (all_sims[line, best] > -np.inf)

    take(np.arange(m), entry)
    while True:
        who = np.flatnonzero(open_.any(axis=1))
        if not len(who):
            break
        step = min(STEP, width)
        masked = np.where(open_[who], sims[who], -np.inf)
        chosen = np.argpartition(-masked, step - 1, axis=1)[:, :step]
        line = np.arange(len(who))[:, None]
        real = masked[line, chosen] > -np.inf
        open_[who[:, None], chosen] = False
        nodes = np.where(real, ids[who[:, None], chosen], -1)
        take(who, links[nodes].reshape(len(who), -1))  # the last line of links holds no neighbour
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.where(np.isfinite(sims[every, order]), ids[every, order], -1), sims[every, order]


def _descend(graph: Graph, queries: np.ndarray, level: int) -> np.ndarray:
    """Entry positions for ``level``: a narrow beam down the levels above it."""
    entry = np.full((len(queries), 1), graph.members[-1][0])
    for above in range(len(graph.members) - 1, level, -1):
        found, _ = beam_search(graph.rows, graph.links[above], queries, entry, 4)
        entry = np.where(found[:, :1] < 0, entry[:, :1], found[:, :1])
    return entry


def _distinct(rows: np.ndarray, candidates: np.ndarray, sims: np.ndarray, size: int) -> np.ndarray:
    """Up to ``size`` candidates, nearest first, that are nearer to the vector than to one already chosen; then the nearest rest."""
    candidates = candidates[:64]
    between = rows[candidates] @ rows[candidates].T
    chosen: list[int] = []
    rest: list[int] = []
    for k in range(len(candidates)):
        if len(chosen) == size:
            break
        (chosen if not chosen or between[k, chosen].max() < sims[k] else rest).append(k)
    return candidates[(chosen + rest)[:size]]


def build_graph(rows: np.ndarray, seed: int = 11) -> Graph:
    """Graph over unit vectors (float32); batches grow with the graph, and see each other exactly."""
    n = len(rows)
    level_of = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 8)
    members = [np.flatnonzero(level_of >= k) for k in range(int(level_of.max(initial=0)) + 1)]
    links = [np.full((n + 1, LOW_LINKS if k == 0 else LINKS), -1) for k in range(len(members))]
    graph = Graph(rows, members, links)
    for level in range(len(members) - 1, -1, -1):
        table, width = links[level], links[level].shape[1]
        done = 0
        # members of the level above come first: they are where the search enters
        upper = members[level + 1] if level + 1 < len(members) else members[level][:1]
        order = np.concatenate([upper, np.setdiff1d(members[level], upper)])
        while done < len(order):
            size = min(BATCH, max(32, done // 2), len(order) - done)
            new = order[done : done + size]
            near_new = rows[new] @ rows[new].T
            np.fill_diagonal(near_new, -np.inf)
            if done:
                found, sims = beam_search(rows, table, rows[new], _descend(graph, rows[new], level), BUILD_BEAM)
            else:
                found, sims = np.empty((size, 0), int), np.empty((size, 0), np.float32)
            found = np.concatenate([found, np.broadcast_to(new, (size, size))], axis=1)
            sims = np.concatenate([sims, near_new], axis=1)
            touched: dict[int, list[int]] = {}
            for k, node in enumerate(new):
                best = np.argsort(-sims[k], kind="stable")[:BUILD_BEAM]
                best = best[np.isfinite(sims[k, best]) & (found[k, best] >= 0)]
                mine = _distinct(rows, found[k, best], sims[k, best], LINKS)
                table[node, : len(mine)] = mine
                for other in mine.tolist():
                    touched.setdefault(other, []).append(int(node))
            for node, more in touched.items():
                held = np.unique(np.concatenate([table[node][table[node] >= 0], more]))
                held = held[held != node]
                if len(held) > width:
                    sims_held = rows[held] @ rows[node]
                    by = np.argsort(-sims_held, kind="stable")
                    held = _distinct(rows, held[by], sims_held[by], width)
                table[node] = -1
                table[node, : len(held)] = held
            done += size
    return graph


def find_links(
    graph: Graph, exact: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, seed: int = 5
) -> list[np.ndarray]:
    """Positions of the vectors whose cosine with each query reaches ``threshold``, the query's own position included.

    ``exact`` and ``queries`` hold unit vectors in double precision; ``own`` is
    the position of a query that is a vector of the graph (-1 otherwise): it
    enters there, among its neighbours, as well as from above.
    """
    n, low = len(exact), threshold - 1e-4
    narrow = queries.astype(np.float32)
    audited = np.random.default_rng(seed).permutation(len(queries))[:AUDITED]
    truth = [np.flatnonzero(row >= threshold) for row in queries[audited] @ exact.T]
    found: list[np.ndarray] = [np.empty(0, int)] * len(queries)
    width, waiting = min(BEAM, n), np.arange(len(queries))
    while len(waiting):
        wider = []
        for first in range(0, len(waiting), BATCH):
            batch = waiting[first : first + BATCH]
            if width >= n:  # as wide as the shard: all of it
                near = queries[batch] @ exact.T
                for k, q in enumerate(batch):
                    found[q] = np.flatnonzero(near[k] >= threshold)
                continue
            entry = np.concatenate([_descend(graph, narrow[batch], 0), own[batch, None]], axis=1)
            ids, sims = beam_search(graph.rows, graph.links[0], narrow[batch], entry, width)
            for k, q in enumerate(batch):
                hits = ids[k][(sims[k] >= low) & (ids[k] >= 0)]
                if len(hits) * 2 > width:
                    wider.append(q)
                else:
                    found[q] = hits[exact[hits] @ queries[q] >= threshold]
        if width >= n:
            break
        open_ = set(wider)
        missed = any(q not in open_ and len(np.setdiff1d(t, found[q])) for q, t in zip(audited.tolist(), truth))
        waiting = np.arange(len(queries)) if missed else np.array(wider, dtype=int)
        width = width * 4 if width * 4 * SCAN_SHARE < n else n
    return found


def _spanning(pairs_of: list[np.ndarray], queries: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """Spanning forest (a, b) of the links of queries (by id) with positions of ``ids``."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for query, places in zip(queries.tolist(), pairs_of):
        for other in ids[places].tolist():
            x, y = find(query), find(other)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(query)
                b.append(other)
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    shard: int = SHARD,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors link if their labels are equal and not null and their cosine in
    double precision reaches ``threshold``. Null, empty and zero vectors and
    those with null or non-finite numbers link with nothing; vectors of other
    lengths count as filled up with zeros. Links are found between vectors and
    folded to ids at the end: unlike rows of one id bring all their links, each
    row counts its own, and they share a component; equal rows of an id count
    once and get equal results. Rows with a null
    id link with nothing, have a null component and are kept. Ties do not
    matter, as every pair that reaches the threshold is a link. Empty tables give
    no rows; other columns are not read.
    """
    ship(__name__)
    ship("duelframe.llm.vector_search")
    every = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"), F.col(label_column).alias("label"))
    fits = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0)
    every = every.select("vec_id", "label", F.when(fits, F.transform("v", lambda x: x.cast("double") + 0.0)).alias("v"))
    # equal vectors are told by 128 bits
    every = every.withColumns({
        "h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), F.reverse("v"))),
    })
    single = spool(
        every.where("v IS NOT NULL").groupBy("vec_id", "label", "h1", "h2").agg(F.first("v").alias("v")), "vector-rows"
    )
    # a class has a number of its own, as several may hold the same id
    classes = spool(
        single.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "vector-classes",
    )
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    sizes = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"),
                                         F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    reps = spool(
        join_sized(classes.select("label", "v", "rep", "copies"), sizes, ["label"])
        .withColumn("s", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shards")).cast("int"))
        .withColumn("q", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int")),
        "vector-reps",
    )

    def units(block: pd.DataFrame) -> np.ndarray:
        rows = matrix(block["v"], width)
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rep")
        rows = units(block)
        graph = build_graph(rows.astype(np.float32))
        packed = [len(graph.links), *(x for m in graph.members for x in (len(m),)), *(t.shape[1] for t in graph.links)]
        tables = [np.array(packed, np.int32), *(m.astype(np.int32) for m in graph.members), *(t.astype(np.int32).ravel() for t in graph.links)]
        return pd.DataFrame({
            "label": [block["label"].iloc[0]], "s": [block["s"].iloc[0]], "ids": [block["rep"].to_numpy(np.int64).tobytes()],
            "copies": [block["copies"].to_numpy(np.int64).tobytes()], "rows": [rows.tobytes()],
            "graph": [np.concatenate(tables).tobytes()],
        })

    label_type = vectors.schema[label_column].dataType.simpleString()
    graphs = spool(
        reps.select("label", "s", "rep", "copies", "v").groupBy("label", "s")
        .applyInPandas(build, f"label {label_type}, s int, ids binary, copies binary, rows binary, graph binary"),
        "vector-graphs",
    )

    def load(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
        ids, copies = (np.frombuffer(row[c], np.int64) for c in ("ids", "copies"))
        exact = np.frombuffer(row["rows"], np.float64).reshape(len(ids), -1)
        flat = np.frombuffer(row["graph"], np.int32)
        levels = int(flat[0])
        counts, widths, at = flat[1 : 1 + levels], flat[1 + levels : 1 + 2 * levels], 1 + 2 * levels
        members, links = [], []
        for c in counts.tolist():
            members.append(flat[at : at + c].astype(np.int64))
            at += c
        for w in widths.tolist():
            links.append(flat[at : at + w * (len(ids) + 1)].reshape(-1, w).astype(np.int64))
            at += w * (len(ids) + 1)
        return ids, copies, exact, Graph(exact.astype(np.float32), members, links)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        def rows_of(rep, links, other, edge: bool) -> pd.DataFrame:
            return pd.DataFrame({"rep": rep, "links": links, "other": other, "edge": np.full(len(rep), edge)})

        none = np.empty(0, np.int64)
        if not len(left) or not len(right):
            return rows_of(none, none, none, False)
        ids, copies, exact, graph = load(left.iloc[0])
        names = right["rep"].to_numpy(np.int64)
        own = np.minimum(np.searchsorted(ids, names), len(ids) - 1)  # a shard's ids are in order
        found = find_links(graph, exact, units(right), np.where(ids[own] == names, own, -1), threshold)
        found = [f[ids[f] != name] for f, name in zip(found, names)]
        linked = np.array([copies[f].sum() for f in found], dtype=np.int64)
        forest = _spanning(found, names, ids)
        some = linked > 0
        return pd.concat([
            rows_of(names[some], linked[some], np.full(int(some.sum()), -1), False),
            rows_of(forest["a"].to_numpy(), np.zeros(len(forest), np.int64), forest["b"].to_numpy(), True),
        ])

    asked = reps.select("label", "q", "rep", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"))
    met = join_sized(graphs, sizes.select("label", "blocks"), ["label"]).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = spool(
        met.groupBy("label", "s", "q").cogroup(asked.groupBy("label", "s", "q"))
        .applyInPandas(search, "rep long, links long, other long, edge boolean"),
        "vector-links",
    )
    counts = found.where("NOT edge").groupBy("rep").agg(F.sum("links").alias("links"))
    same = ["label", "h1", "h2"]
    members = spool(
        single.select("vec_id", *same).join(classes.select(*same, "rep", "name", "copies"), same), "vector-members"
    )
    names = classes.select("rep", "name")
    edges = found.where("edge").select("rep", "other").join(names, "rep").select("other", F.col("name").alias("a"))
    edges = edges.join(names.withColumnsRenamed({"rep": "other", "name": "b"}), "other").select("a", "b")
    # an id with several vectors holds their classes together
    several = spool(members.groupBy("vec_id").count().where("count > 1").select("vec_id"), "vector-several")
    held = join_sized(members, several, ["vec_id"]).select(F.col("vec_id").alias("a"), F.col("name").alias("b"))
    groups = connected_components(edges.unionByName(held), "vector-groups").select(F.col("node").alias("name"), "component")
    leads = members.groupBy("vec_id").agg(F.min("name").alias("name"))
    out = every.select("vec_id", *same).join(members.drop("name"), ["vec_id", *same], "left").join(counts, "rep", "left")
    out = out.join(leads, "vec_id", "left").withColumn("name", F.coalesce("name", "vec_id")).join(groups, "name", "left")
    component = F.coalesce("component", "name")
    links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select(
        F.col("vec_id").alias(id_column), links.cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
