"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams (1 to ``MAX_N`` letters, with
word edges) in order. A document's own most frequent n-grams are ranked over
its whole text and compared with each profile by out-of-place distance: the sum
of rank differences, and the profile's length for an n-gram it lacks.

Profiles are counted in Spark from a bounded, hash-chosen sample of labelled
documents (``SAMPLE_DOCS`` per language in expectation); only the profiles,
``PROFILE`` n-grams per language, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.common import fold_of, forget_kept, give_back, join_sized
from duelframe.session import ship, spool

MAX_N = 4
PROFILE = 400
#: Expected number of documents per language that profiles are learned from.
SAMPLE_DOCS = 2000
UNKNOWN = "und"
BLOCK = 1 << 20
#: Counts of so many n-grams wait at most before they are added up.
HELD_GRAMS = 1 << 19


@dataclass(frozen=True)
class Profiles:
    """Languages in order, which code points are letters, the n-grams known and their ranks by language."""

    languages: tuple[str, ...]
    letters: np.ndarray  # by code point
    grams: np.ndarray  # sorted keys
    ranks: np.ndarray  # grams x languages; PROFILE where a language lacks the n-gram


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def letter_mask() -> np.ndarray:
    """Which code points are letters."""
    return np.frompyfunc(lambda c: chr(c).isalpha(), 1, 1)(np.arange(0x110000)).astype(bool)


def letters_of(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of a text, 0 for all that is no letter: a word edge."""
    points = code_points(text)
    return np.where(letters[points], points, 0)


def mixed(keys: np.ndarray) -> np.ndarray:
    """The same number of different keys, with their bits well mixed."""
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def count_grams(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct n-grams of a text given as letters and edges, and their counts.

    Runs of edges count as one; an n-gram may hold an edge only at its ends, and
    not be an edge alone. Every letter of every script counts as itself: keys are
    64-bit hashes of code points. Long texts are counted block by block.
    """
    edged = np.zeros(len(signs) + 2, dtype=np.uint64)
    edged[1:-1] = signs
    keep = np.ones(len(edged), dtype=bool)
    keep[1:] = (edged[1:] != 0) | (edged[:-1] != 0)
    run = edged[keep]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for first in range(0, len(run), BLOCK):
        part = run[first : first + BLOCK + MAX_N - 1]
        starts = min(BLOCK, len(run) - first)
        keys = []
        gram = part[:starts] + np.uint64(1)
        keys.append(gram[gram != 1])
        inner = np.ones(starts, dtype=bool)  # no edge strictly inside
        for n in range(2, MAX_N + 1):
            more = part[n - 1 :]
            size = min(starts, len(more))
            if size <= 0:
                break
            if n > 2:
                inner = inner[:size] & (part[n - 2 : n - 2 + size] != 0)
            # three code points fit in 64 bits side by side; with a fourth they are mixed first
            gram = gram[:size] if n < 4 else mixed(gram[:size]).view(np.uint64)
            gram = gram * np.uint64(0x10FFFF + 4) + more[:size] + np.uint64(1)
            keys.append(gram[inner[:size]])
        found.append(np.unique(mixed(np.concatenate(keys)), return_counts=True))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in found])).astype(np.int64)


def added_up(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several counts, and their sums."""
    keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[firsts], np.add.reduceat(counts, firsts).astype(np.int64) if len(keys) else np.empty(0, np.int64)


class GramTotals:
    """Counts of the n-grams of many texts: those of the latest texts wait, up to ``HELD_GRAMS``, and are then added to the rest."""

    def __init__(self) -> None:
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.found.append((keys, counts))
        self.waiting += len(keys)
        # never less than what is added up already, so that rare n-grams are not sorted again and again
        if self.waiting > max(HELD_GRAMS, len(self.found[0][0])):
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        self.found = [added_up(self.found)] if self.found else [(np.empty(0, np.int64), np.empty(0, np.int64))]
        self.waiting = 0
        return self.found[0]


def most_frequent(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first, ties to the smaller key."""
    if len(keys) > size:
        enough = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[enough], counts[enough]
    return keys[np.lexsort((keys, -counts))][:size]


def judge(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """Nearest language and 1 - distance / largest distance; ``und`` and 0 without a letter."""
    if not text or not len(profiles.languages):
        return UNKNOWN, 0.0
    signs = letters_of(text, profiles.letters)
    if not signs.any():
        return UNKNOWN, 0.0
    top = most_frequent(*count_grams(signs), PROFILE)
    at = np.searchsorted(profiles.grams, top)
    at[at == len(profiles.grams)] = 0
    known = profiles.grams[at] == top
    rank = np.arange(len(top))[:, None]
    away = np.where(known[:, None], np.minimum(np.abs(profiles.ranks[at] - rank), PROFILE), PROFILE)
    away[profiles.ranks[at] == PROFILE] = PROFILE
    total = away.sum(axis=0)
    best = int(np.argmin(total))  # ties: the first language in order
    return profiles.languages[best], float(1.0 - total[best] / (PROFILE * len(top)))


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", drawn_by: tuple[str, ...] = ("doc_id", "text")) -> Profiles:
    """Profiles from rows with a text and a language; other rows are ignored. ``drawn_by``: columns whose hash draws the sample."""
    ship(__name__)
    lot = F.pmod(F.xxhash64(*[c for c in drawn_by if c in labelled.columns]), F.lit(1 << 20)) / float(1 << 20)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), lot.alias("lot")).where("text IS NOT NULL AND lang IS NOT NULL")
    share = spool(
        rows.groupBy("lang").agg((F.lit(float(SAMPLE_DOCS)) / F.count(F.lit(1))).alias("share")), "lang-shares"
    )
    sample = spool(join_sized(rows, share, ["lang"]).where(F.col("lot") < F.col("share")).select("lang", "text"), "lang-sample")
    letters = letter_mask()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_kept()
        totals: dict[str, GramTotals] = {}
        for batch in batches:
            for name, value in zip(batch["lang"], batch["text"]):
                totals.setdefault(name, GramTotals()).add(*count_grams(letters_of(value, letters)))
        for name in list(totals):
            keys, counts = totals.pop(name).sums()
            for at in range(0, len(keys), HELD_GRAMS):
                yield pd.DataFrame({"lang": name, "gram": keys[at : at + HELD_GRAMS], "n": counts[at : at + HELD_GRAMS]})
            del keys, counts
        give_back()

    grams = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < PROFILE).select("lang", "gram", "rank").collect()
    languages = tuple(sorted({r["lang"] for r in top}))
    known = np.array(sorted({r["gram"] for r in top}), dtype=np.int64)
    ranks = np.full((len(known), len(languages)), PROFILE, dtype=np.int64)
    if top:
        ranks[np.searchsorted(known, [r["gram"] for r in top]), [languages.index(r["lang"]) for r in top]] = [r["rank"] for r in top]
    return Profiles(languages, letters, known, ranks)


def language_of(text: str, profiles: Profiles) -> Column:
    """Struct (lang, score) of a text column."""
    ship(__name__)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def identify(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([judge(t, profiles) for t in texts], columns=["lang", "score"])
        give_back()
        return found

    return identify(F.col(text))


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that profiles may be learned from: all but the held-out fifth."""
    return docs.where(F.coalesce(fold_of("doc_id", 5) != 0, F.lit(False)))


def identify_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document.

    Null and letterless texts are ``und`` with score 0, as is everything if there
    is nothing to learn from. A null doc_id is held out. Repeated rows return
    once each, ties go to the first language by name, whole texts are ranked.
    Other columns are not read.
    """
    profiles = learn_profiles(training_rows(docs))
    return docs.select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(True)).alias("held_out"),
                       language_of("text", profiles).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
