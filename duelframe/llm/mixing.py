"""Mixing sources to target weights by hierarchical budgeting.

The leaves of the mixture are (domain, language, source). A token budget is
propagated from the root by the weights of the children that exist. A child
that cannot use its share, because its documents times the allowed epochs hold
fewer tokens, gives the rest to its siblings; what no sibling can take moves to
the siblings of the parent. Each leaf then takes a prefix of its own token
sequence: its documents in seeded order, epoch after epoch.

The tree has as many rows as there are different leaves. Prefixes are cut in
two steps, so that a leaf with a third of all rows is spread over many slices:
tokens per slice of the seeded order decide which slices are whole, and only
the slice that holds the cut is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import fresh_name, join_sized
from duelframe.session import spool

#: Documents that one slice of a leaf's order holds on average.
SLICE_ROWS = 2000


def word_tokens(text: Column) -> Column:
    """Words of a text, as the unit of the budget (null and blank texts: 0)."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def _weight(name: Column, weights: Mapping[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for key, value in sorted(weights.items()):
        out = F.when(name == key, F.lit(float(value))).otherwise(out)
    return out


def split_budget(children: DataFrame, parents: Sequence[str], rounds: int) -> DataFrame:
    """Share each parent's ``budget`` among its children by ``weight``, none above ``supply``.

    Water filling: the children are ordered by supply per weight; those whose
    supply is below the level keep it all, the others share what is left by
    weight. It is one window per parent over that parent's children, so no
    repetition is needed and ``rounds`` only names the level of the tree.
    """
    by_parent = Window.partitionBy(*parents)
    order = by_parent.orderBy(F.col("supply") / F.col("weight"), "child")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    supply_before = F.coalesce(F.sum("supply").over(before), F.lit(0))
    weight_left = F.sum("weight").over(by_parent) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level that this child and all after it would share if it is not full
    level = (F.col("budget") - supply_before) / weight_left
    staged = children.withColumn("_level", level).withColumn("_full", F.col("supply") <= F.col("_level") * F.col("weight"))
    open_level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(by_parent)
    share = F.when(F.col("_full"), F.col("supply").cast("double")).otherwise(open_level * F.col("weight"))
    return staged.withColumn("share", F.greatest(share, F.lit(0.0))).drop("_level", "_full").withColumn("depth", F.lit(rounds))


def leaf_budgets(
    leaves: DataFrame,
    budget_share: float,
    max_epochs: float,
    weights: Mapping[str, Mapping[str, float]],
    default: float = 1.0,
) -> DataFrame:
    """Token quota of each leaf.

    ``leaves``: (domain, language, source, tokens), one row per leaf. ``weights``
    has a mapping of name to weight per level. The budget is ``budget_share`` of
    all tokens. Quotas are whole tokens, rounded down. Weights must be above 0.
    """
    tree = leaves.withColumn("supply", F.floor(F.col("tokens") * max_epochs).cast("long"))
    total = tree.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * budget_share).cast("double").alias("budget"))
    domains = tree.groupBy("domain").agg(F.sum("supply").alias("supply"))
    domains = domains.crossJoin(F.broadcast(total)).select(
        F.lit(0).alias("root"), F.col("domain").alias("child"), "supply", "budget",
        _weight(F.col("domain"), weights.get("domain", {}), default).alias("weight"),
    )
    domains = split_budget(domains, ["root"], 1).select(F.col("child").alias("domain"), F.col("share").alias("budget"))
    langs = tree.groupBy("domain", "language").agg(F.sum("supply").alias("supply")).join(domains, "domain").select(
        "domain", F.col("language").alias("child"), "supply", "budget",
        _weight(F.col("language"), weights.get("language", {}), default).alias("weight"),
    )
    langs = split_budget(langs, ["domain"], 2).select("domain", F.col("child").alias("language"), F.col("share").alias("budget"))
    rows = tree.join(langs, ["domain", "language"]).select(
        "domain", "language", F.col("source").alias("child"), "supply", "budget", "tokens",
        _weight(F.col("source"), weights.get("source", {}), default).alias("weight"),
    )
    return split_budget(rows, ["domain", "language"], 3).select(
        "domain", "language", F.col("child").alias("source"), "tokens",
        # the shares are sums of doubles: what misses a whole token by less than a millionth counts as whole
        F.floor(F.col("share") + 1e-6).cast("long").alias("quota"),
    )


class Mixture:
    """Picked rows, the quotas of the leaves, and the names under which columns were added to the rows."""

    def __init__(self, rows: DataFrame, quotas: DataFrame, names: Mapping[str, str]):
        self.rows, self.quotas, self.names = rows, quotas, names

    def readings(self, text_column: str = "text") -> DataFrame:
        """One row per reading of a document: each full epoch, then the prefix of the last document of a leaf.

        The rows have the columns of the documents; the text of a prefix ends with its last word.
        """
        names = self.names
        full, n, take = (F.col(names[k]) for k in ("epochs", "n_tokens", "take_tokens"))
        read, part = fresh_name(self.rows.columns, "reading"), take - full * n
        whole_words = F.regexp_extract_all(F.col(text_column), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
        each = self.rows.withColumn(read, F.explode(F.sequence(F.lit(1), (full + F.when(part > 0, 1).otherwise(0)).cast("int"))))
        cut = F.when(F.col(read) > full, F.array_join(F.slice(whole_words, F.lit(1), part.cast("int")), "")).otherwise(F.col(text_column))
        return each.withColumn(text_column, cut).drop(read, *names.values())


def mix(
    docs: DataFrame,
    domain: Column,
    language: Column,
    source: Column,
    budget_share: float,
    max_epochs: int = 3,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Mixture:
    """Pick documents so that leaves meet their quotas.

    Picked rows carry all columns of ``docs`` and domain, language, leaf_source,
    n_tokens (of one reading), epochs (full readings) and take_tokens (tokens
    read in total: the last document of a prefix is read in part). Added names
    get a leading underscore if ``docs`` has them.

    Null domains, languages and sources form leaves of their own, named ''.
    Documents without words belong to no prefix and are left out, as nothing of
    them is read. Repeated rows are separate documents; rows with equal ids and
    texts are interchangeable, so ties are cut between equal rows. Empty tables
    give empty results.
    """
    names = {}
    for stem in ("domain", "language", "leaf_source", "n_tokens", "epochs", "take_tokens", "mix_key", "mix_slice",
                 "mix_rest", "mix_slices", "mix_room", "mix_whole", "mix_before"):
        names[stem] = fresh_name([*docs.columns, *names.values()], stem)
    n, key, part = (names[k] for k in ("n_tokens", "mix_key", "mix_slice"))
    leaf = [names[k] for k in ("domain", "language", "leaf_source")]
    epochs, take, rest, room, whole = (names[k] for k in ("epochs", "take_tokens", "mix_rest", "mix_room", "mix_whole"))
    seeded = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"), F.lit("")),
                               F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))).cast("binary"))
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")  # of 2**32, in the seeded order
    staged = docs.withColumns({
        **{c: F.coalesce(v.cast("string"), F.lit("")) for c, v in zip(leaf, (domain, language, source))},
        n: word_tokens(F.col(text_column)), key: seeded,
    }).where(F.col(n) > 0)
    sizes = spool(
        staged.select(*[F.col(c).alias(a) for c, a in zip(leaf, ("domain", "language", "source"))], F.col(n).alias("n"))
        .groupBy("domain", "language", "source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")),
        "mix-leaves",
    )
    budgets = leaf_budgets(sizes.drop("rows"), budget_share, max_epochs, weights or {})
    quotas = spool(
        budgets.join(sizes.drop("tokens"), ["domain", "language", "source"])
        .withColumn("epochs", F.floor(F.col("quota") / F.col("tokens")).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
        .withColumn("slices", F.ceil(F.col("rows") / SLICE_ROWS).cast("long")),
        "mix-quotas",
    )
    to_leaf = quotas.select("domain", "language", "source", "epochs", "rest", "slices").toDF(*leaf, epochs, rest, names["mix_slices"])
    # a slice is a range of the seeded order; a leaf has as many as its rows ask for
    sliced = join_sized(staged, to_leaf, leaf).withColumn(
        part, F.floor(place * F.col(names["mix_slices"]) / F.lit(2.0**32)).cast("long")
    )
    per_slice = sliced.groupBy(*leaf, part).agg(F.sum(n).alias("held"), F.first(rest).alias("rest"))
    before = Window.partitionBy(*leaf).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("held").over(before), F.lit(0))
    cuts = spool(
        per_slice.withColumn("left", left).select(
            *leaf, part, F.greatest(F.lit(0), F.least("held", "left")).alias(room), (F.col("held") <= F.col("left")).alias(whole)
        ),
        "mix-cuts",
    )
    placed = join_sized(sliced, cuts, [*leaf, part])
    cut_here = ~F.col(whole) & (F.col(room) > 0)
    simple = placed.where(~cut_here).withColumn(take, F.col(epochs) * F.col(n) + F.when(F.col(whole), F.col(n)).otherwise(0))
    in_slice = Window.partitionBy(*leaf, part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    at_cut = placed.where(cut_here).withColumn(names["mix_before"], F.coalesce(F.sum(n).over(in_slice), F.lit(0)))
    at_cut = at_cut.withColumn(
        take, F.col(epochs) * F.col(n) + F.least(F.col(n), F.greatest(F.lit(0), F.col(room) - F.col(names["mix_before"])))
    ).drop(names["mix_before"])
    chosen = simple.unionByName(at_cut).where(F.col(take) > 0).withColumn(epochs, F.floor(F.col(take) / F.col(n)).cast("long"))
    added = {k: names[k] for k in ("domain", "language", "leaf_source", "n_tokens", "epochs", "take_tokens")}
    return Mixture(chosen.select(*docs.columns, *added.values()), quotas.select("domain", "language", "source", "tokens", "quota"), added)
