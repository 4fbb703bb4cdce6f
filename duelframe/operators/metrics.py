"""Binary prediction metrics per group, with an exact distributed AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.ordering import running_total

MACHINE_EDGE = 2.220446049250313e-16


def log_loss(y: Column, p: Column, edge: float = MACHINE_EDGE) -> Column:
    safe = F.least(F.greatest(p, F.lit(edge)), F.lit(1.0 - edge))
    return -F.when(y == 1, F.ln(safe)).otherwise(F.ln(1 - safe))


def metric_columns(y: str, p: str, edge: float = MACHINE_EDGE) -> list[Column]:
    """Everything but the AUC, for one aggregation."""
    label, prob = F.col(y), F.col(p)
    hit = (prob >= 0.5).cast("int") == label
    return [
        F.count(F.lit(1)).alias("rows"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.avg(log_loss(label, prob, edge)).alias("log_loss"),
        F.avg(F.pow(prob - label, 2)).alias("brier_score"),
        F.avg(label.cast("double")).alias("positive_rate"),
        F.avg(prob).alias("avg_pred_prob"),
    ]


def auc(df: DataFrame, groups: Sequence[str], y: str, p: str, weight: str | None = None) -> DataFrame:
    """Exact AUC per group (null when a class is absent).

    Rows collapse to one per distinct score before the shuffle; the running
    count of negatives below each score is range-partitioned, so neither a
    large group nor a repeated score is gathered in one task.
    """
    unit = F.col(weight) if weight else F.lit(1)
    scores = df.groupBy(*groups, p).agg(
        F.sum(F.when(F.col(y) == 1, unit).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(unit)).alias("_neg"),
    )
    ranked = running_total(scores, [p], {"_below": "_neg"}, groups)
    area = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    return ranked.groupBy(*groups).agg(
        F.try_divide(area, F.sum("_pos").cast("double") * F.sum("_neg").cast("double")).alias("roc_auc")
    )


def binary_metrics(df: DataFrame, groups: Sequence[str], y: str, p: str, edge: float = MACHINE_EDGE) -> DataFrame:
    base = df.groupBy(*groups).agg(*metric_columns(y, p, edge))
    areas = auc(df, groups, y, p)
    null_safe = None
    for g in groups:
        same = base[g].eqNullSafe(areas[g])
        null_safe = same if null_safe is None else null_safe & same
    return base.join(areas, null_safe, "left").select(*[base[c] for c in base.columns], areas["roc_auc"])


def checkpoint_metrics(scored: DataFrame, y: str = "label_player1_win_match", p: str = "prob_player1_win_match") -> DataFrame:
    """Metrics by split, by split and checkpoint, and by split, tour and surface, in one pass."""
    edge = 1e-6
    # rounded, so that equal states tie whatever the order of summation
    rows = scored.withColumn("_p", F.round(F.least(F.greatest(F.col(p), F.lit(edge)), F.lit(1.0 - edge)), 12))
    keys = ["split", "checkpoint_type", "tour", "surface"]
    sets = [["split"], ["split", "checkpoint_type"], ["split", "tour", "surface"]]
    kind = (
        F.when(F.grouping("checkpoint_type") == 0, F.concat("split", F.lit(":checkpoint_type")))
        .when(F.grouping("tour") == 0, F.concat("split", F.lit(":tour_surface")))
        .otherwise("split")
    )
    value = (
        F.when(F.grouping("checkpoint_type") == 0, F.col("checkpoint_type"))
        .when(F.grouping("tour") == 0, F.concat_ws("/", "tour", "surface"))
        .otherwise(F.col("split"))
    )
    base = rows.groupingSets(sets, *keys).agg(
        kind.alias("group"), value.alias("value"),
        F.count_distinct("match_id").alias("matches"),
        F.min("match_date").alias("date_min"), F.max("match_date").alias("date_max"),
        *metric_columns(y, "_p", edge),
    ).drop(*keys)
    # the AUC works on counts per distinct score, already small, once per group label
    per_score = rows.groupBy(*keys, "_p", y).agg(F.count(F.lit(1)).alias("_n"))
    labels = F.array(
        F.struct(F.lit("split").alias("group"), F.col("split").alias("value")),
        F.struct(F.concat("split", F.lit(":checkpoint_type")).alias("group"), F.col("checkpoint_type").alias("value")),
        F.struct(F.concat("split", F.lit(":tour_surface")).alias("group"), F.concat_ws("/", "tour", "surface").alias("value")),
    )
    spread = per_score.select("_p", y, "_n", F.explode(labels).alias("l")).select("_p", y, "_n", "l.*")
    return base.join(auc(spread, ["group", "value"], y, "_p", "_n"), ["group", "value"])
