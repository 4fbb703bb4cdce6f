"""Exact top-k search by inner product with a pivot-distance index.

Components are scaled to integers. A search for large inner products becomes
one for small distances by giving every vector x one more component,
sqrt(M - |x|^2), with M the largest squared length: then all vectors lie on one
sphere and |q - x|^2 = |q|^2 + M - 2 <q, x> for queries with 0 there.

Index: every vector is keyed by its nearest pivot and its distance to it; the
rows in key order are cut into annuli of at most ``ANNULUS`` vectors. A query
at distance d from a pivot is at least max(lo - d, d - hi) away from the
annulus [lo, hi], so it visits annuli by that bound and stops at the first one
that cannot reach its k-th score.

Work is dealt as (group of annuli, block of queries) pairs of bounded size, so
neither side is ever whole in a task or on the driver. The pivots and the rows
for the first bound of the k-th score are bounded samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators.ordering import global_index
from duelframe.session import ship, spool

SCALE = 1024
K = 10
PIVOTS, FIRST_ROWS = 48, 2048
ANNULUS, GROUP_ANNULI, QUERY_BLOCK = 1024, 64, 2048


def usable(vector: str) -> Column:
    """Whether a vector column is not null and holds only finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of numbers as a matrix of doubles; shorter rows are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles hold them exactly up to 2**53, else they are taken as integers."""
    largest = np.abs(queries).max(initial=0.0) * np.abs(rows).max(initial=0.0) * max(1, rows.shape[1])
    if largest < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best by score, then smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_group(annuli: pd.DataFrame, queries: pd.DataFrame, pivots: np.ndarray, squared: float, width: int, k: int) -> pd.DataFrame:
    """Best ``k`` rows of these annuli for each query; annuli: (pivot, lo, hi, ids, rows)."""
    out_q, out_i, out_s = [], [], []
    if len(annuli) and len(queries):
        q = matrix(queries["v"], width)
        lengths = (q * q).sum(axis=1)
        # the pivots' last component does not meet the queries', which is 0
        away = np.sqrt(np.maximum(0.0, lengths[:, None] + squared - 2 * (q @ pivots[:, :width].T)))[:, annuli["pivot"].to_numpy()]
        bound = np.maximum(0.0, np.maximum(annuli["lo"].to_numpy()[None] - away, away - annuli["hi"].to_numpy()[None]))
        # above any score in the annulus, rounding included
        reach = (lengths[:, None] + squared - bound**2) / 2
        reach += 1e-9 * (lengths[:, None] + squared) + 1
        visit = np.argsort(-reach, axis=1, kind="stable")
        blocks = [
            (np.frombuffer(i, dtype=np.int64), np.frombuffer(r, dtype=np.float64).reshape(-1, width))
            for i, r in zip(annuli["ids"], annuli["rows"])
        ]
        names, least = queries["vec_id"].to_numpy(), queries["least"].to_numpy()
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in names]
        needed = np.where(np.isnan(least.astype(float)), -np.inf, least.astype(float))
        active = np.arange(len(names))
        for turn in range(len(blocks)):
            at = visit[active, turn]
            active, at = active[reach[active, at] >= needed[active]], at[reach[active, at] >= needed[active]]
            if not len(active):
                break
            for b in np.unique(at):
                asking = active[at == b]
                ids, rows = blocks[b]
                scores = products(q[asking], rows)
                good = (scores >= needed[asking, None]) & (ids[None] != names[asking, None])
                for n in np.flatnonzero(good.any(axis=1)):
                    row, hit = asking[n], good[n]
                    found = top_of(np.concatenate([best[row][0], scores[n, hit]]), np.concatenate([best[row][1], ids[hit]]), k)
                    best[row] = found
                    if len(found[0]) == k:
                        needed[row] = max(needed[row], found[0][-1])
        for name, (scores, ids) in zip(names, best):
            out_q.append(np.full(len(ids), name, np.int64))
            out_i.append(ids)
            out_s.append(scores)
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pd.DataFrame({"query_id": join(out_q), "vec_id": join(out_i), "score": join(out_s)})


def top_k_search(vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows, all if fewer.

    Null ids and vectors that are null or hold null or non-finite numbers take
    no part, nor do vectors whose integer form has a squared length of 2^62 or
    more, as their scores need not fit in 64 bits. Shorter vectors count as
    filled up with zeros. Rows count, whatever their ids: several rows of an id
    are candidates, and queries, each; a row is never its own candidate. Ties go
    to the smaller id. Empty tables and tables without queries give no rows;
    other columns are not read.
    """
    ship(__name__)
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("e"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = rows.where(F.col("id").isNotNull() & usable("e")).select("id", "asks", scaled("e").alias("v")).where(length < float(2**62))
    # rows are numbered in the order of their ids, which names them and settles ties
    base = spool(global_index(rows.withColumn("h", F.xxhash64("v")), ["id", "h"], "vec_id").drop("h"), "search-rows")
    n, width, squared = base.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(length)).first()
    width, squared = max(1, width or 1), float(squared or 0.0)
    sample = base.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(FIRST_ROWS).toPandas()
    first_ids, first_rows = sample["vec_id"].to_numpy(np.int64), matrix(sample["v"], width)

    def lifted(rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.sqrt(np.maximum(0.0, squared - (rows * rows).sum(axis=1)))[:, None]])

    pivots = lifted(first_rows[:PIVOTS]) if len(first_rows) else np.zeros((1, width + 1))

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = lifted(matrix(batch["v"], width))
            away = np.sqrt(np.maximum(0.0, 2 * squared - 2 * (rows @ pivots.T)))
            pivot = away.argmin(axis=1)
            yield batch.assign(pivot=pivot.astype(np.int32), away=away[np.arange(len(rows)), pivot])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) > ANNULUS:  # rows come sorted by pivot and distance
                same = int((held["pivot"].to_numpy() == held["pivot"].iloc[0]).sum())
                size = min(same, ANNULUS)
                yield annulus(held.iloc[:size])
                held = held.iloc[size:]
        while held is not None and len(held):
            size = min(int((held["pivot"].to_numpy() == held["pivot"].iloc[0]).sum()), ANNULUS)
            yield annulus(held.iloc[:size])
            held = held.iloc[size:]

    def annulus(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "pivot": [int(rows["pivot"].iloc[0])], "lo": [rows["away"].min()], "hi": [rows["away"].max()],
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "rows": [matrix(rows["v"], width).tobytes()],
        })

    parts = max(1, -(-n // (8 * ANNULUS)), min(spark.sparkContext.defaultParallelism, -(-n // ANNULUS)))
    keyed = base.select("vec_id", "v").mapInPandas(key, "vec_id long, v array<long>, pivot int, away double")
    index = spool(
        keyed.repartitionByRange(parts, "pivot", "away", "vec_id").sortWithinPartitions("pivot", "away", "vec_id")
        .mapInPandas(cut, "pivot int, lo double, hi double, ids binary, rows binary"),
        "search-index",
    )

    def first_bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k-th score among the sampled rows, which the k-th score among all rows cannot be below."""
        for batch in batches:
            scores = products(matrix(batch["v"], width), first_rows).astype(np.float64)
            scores[first_ids[None] == batch["vec_id"].to_numpy()[:, None]] = -np.inf
            enough = scores.shape[1] > k  # one of them may be the query itself
            least = np.partition(scores, -k, axis=1)[:, -k] if enough else np.full(len(batch), np.nan)
            yield batch.assign(least=least)

    annuli = index.count()
    groups = max(1, -(-annuli // GROUP_ANNULI), min(annuli, 2 * spark.sparkContext.defaultParallelism))
    asked = base.where("asks").select("vec_id", "v")
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = asked.mapInPandas(first_bound, "vec_id long, v array<long>, least double").withColumn(
        "q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
    )
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = index.withColumn("g", F.pmod(F.xxhash64("pivot", "lo", "hi", "ids"), F.lit(groups)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_group(left, right, pivots, squared, width, k)

    found = dealt.groupBy("g", "q").cogroup(queries.groupBy("g", "q")).applyInPandas(search, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spool(found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), "search-found")
    ids = base.select(F.col("vec_id"), "id")
    named = best.join(ids.withColumnsRenamed({"vec_id": "query_id", "id": "query"}), "query_id").join(ids, "vec_id")
    return named.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
