"""Stage tables shared by queries: rated contests, player history, wide contests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duelframe.operators.features import METADATA
from duelframe.operators.history import INPUTS, player_history
from duelframe.operators.ingest import drop_voided
from duelframe.operators.longview import SIDE_FIELDS, long_view
from duelframe.operators.opponents import with_common_opponents
from duelframe.operators.pairing import CARRIED, CONTEST_FIELDS, context_flags, delta_features, keep_model_rounds, pair_wide
from duelframe.operators.ratings import rate_contests
from duelframe.operators.scoring import scoring_features
from duelframe.plans import fixtures as fx


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long view of the contests that were played out, without ratings."""
    return fx.stage(spark, sf_dir, "sides", lambda: long_view(drop_voided(fx.contests(spark, sf_dir))))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.stage(spark, sf_dir, "rated", lambda: rate_contests(fx.contests(spark, sf_dir)))


#: What is read of a player's contests besides their history: the contest and the player, not the box scores behind the ratios.
TRACKED = tuple(dict.fromkeys([*INPUTS, *CONTEST_FIELDS, *(f"player_{f}" for f in SIDE_FIELDS)]))


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_history(long_view(drop_voided(rated(spark, sf_dir))).select(*TRACKED))


def player_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings, long view and history of the contests that were played out."""
    return fx.stage(spark, sf_dir, "player_track", lambda: _tracked(spark, sf_dir))


def wide(long: DataFrame) -> DataFrame:
    """Wide contests with every feature, from a player track."""
    paired = delta_features(context_flags(keep_model_rounds(pair_wide(long, dealt_by="_dealt_by"))))
    return scoring_features(with_common_opponents(paired, long, ["_dealt_by", "match_id"])).drop("_dealt_by")


def baseline_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide contests that models read; histories go straight to the pairing unless they are written already."""

    def build() -> DataFrame:
        return compared(wide(fx.stage_or_plan(spark, sf_dir, "player_track", lambda: _tracked(spark, sf_dir))))

    return fx.stage(spark, sf_dir, "baseline_track", build)


def compared(contests: DataFrame) -> DataFrame:
    """Without what the features compare of the sides; who they are stays."""
    carried = {f"{c}_{side}" for c in CARRIED for side in "ab"} - set(METADATA)
    return contests.select(*[c for c in contests.columns if c not in carried])
