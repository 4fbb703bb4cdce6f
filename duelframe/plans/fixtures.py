"""Contests, points and predictions derived from the order and event tables.

Every definition uses integer arithmetic, so another engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.config import SplitConfig
from duelframe.session import CODEC, shared_dir

# last day of train and of validation for contests
SPLIT = SplitConfig.until("1999-12-31", "2000-12-31")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stages: dict[tuple[str, str, str], str] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Result of ``build()`` as a written table, made once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        df = build()
        path = f"{shared_dir(spark)}/stages/{abs(hash(sf_dir)):x}/{name}"
        df.write.mode("overwrite").parquet(path, compression=CODEC)
        _stages[key] = path
    return spark.read.parquet(_stages[key])


def stage_or_plan(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stage that was made already, else its plan: for a table that is read once, so that it need not be written."""
    made = (spark.sparkContext.applicationId, sf_dir, name) in _stages
    return stage(spark, sf_dir, name, build) if made else build()


def _div(value: Column, by: int) -> Column:
    """Integer division of non-negative numbers."""
    return ((value - value % by) / by).cast("double")


def _box(line: str, prefix: str) -> list[Column]:
    q = F.col(f"{line}.l_quantity").cast("int")
    d = F.round(F.col(f"{line}.l_discount") * 100).cast("int")
    t = F.round(F.col(f"{line}.l_tax") * 100).cast("int")
    n = F.col(f"{line}.l_linenumber")
    values = {
        "ace": _div(q * d, 10),
        "df": _div(q * t, 20),
        "svpt": (q * 2).cast("double"),
        "1stIn": _div(q * 12, 10),
        "1stWon": _div(q * 12 * (d + 60), 1000),
        "2ndWon": _div(q * 8 * (t + 40), 1000),
        "SvGms": _div(q + 3, 4),
        "bpSaved": _div(n * d, 10),
        "bpFaced": n.cast("double"),
    }
    return [v.alias(f"{prefix}_{k}") for k, v in values.items()]


def _person(who: str) -> list[Column]:
    key = F.col(f"{who}.s_suppkey")
    nation = F.col(f"{who}.s_nationkey")
    return [
        key.cast("string").alias(f"{who}_id"),
        F.when(key % 5 == 0, (key % 32 + 1).cast("string")).alias(f"{who}_seed"),
        F.lit(None).cast("string").alias(f"{who}_entry"),
        F.col(f"{who}.s_name").alias(f"{who}_name"),
        F.element_at(F.array(F.lit("R"), F.lit("L"), F.lit("U")), (nation % 3 + 1).cast("int")).alias(f"{who}_hand"),
        (nation + 170).cast("double").alias(f"{who}_ht"),
        F.lit(None).cast("string").alias(f"{who}_ioc"),
        (key % 20 + 18).cast("double").alias(f"{who}_age"),
        (key + 1).cast("double").alias(f"{who}_rank"),
        F.col(f"{who}.s_acctbal").alias(f"{who}_rank_points"),
    ]


def build_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contest per order whose lines name two suppliers: the dearest line
    wins, the best line of another supplier loses."""
    lines = table(spark, sf_dir, "lineitem")
    fields = ("l_linenumber", "l_suppkey", "l_quantity", "l_partkey", "l_discount", "l_tax", "l_shipdate", "l_returnflag")
    # lines of an order are shuffled and sorted once, the dearest first: both windows and the pairing share the sort
    dearest = Window.partitionBy("l_orderkey").orderBy("price", *fields)
    upto = dearest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_another = ~F.col("l_suppkey").eqNullSafe(F.col("first_supp"))
    pairs = (
        lines.select("l_orderkey", (-F.col("l_extendedprice")).alias("price"), *fields)
        .select("*", F.row_number().over(dearest).alias("place"), F.first("l_suppkey").over(upto).alias("first_supp"))
        .select("*", F.sum(of_another.cast("int")).over(upto).alias("others"))
        .filter((F.col("place") == 1) | (of_another & (F.col("others") == 1)))
        .select("l_orderkey", "price", *fields, "place", F.struct("price", *fields).alias("w"))
        .select("l_orderkey", "place", "w", F.lead("w").over(dearest).alias("l"))
        .filter("place = 1 and l is not null")
        .select("l_orderkey", "w", "l")
    )
    regions = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.date_trunc("week", "o_orderdate").cast("date").alias("tourney_date"),
    )
    # orders find their region while they are narrow, so that the pairs stay where their lines were brought together
    placed = orders.join(regions, F.col("o_custkey") == F.col("c_custkey"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    joined = (
        pairs.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers.select(F.struct("*").alias("winner")), F.col("w.l_suppkey") == F.col("winner.s_suppkey"))
        .join(suppliers.select(F.struct("*").alias("loser")), F.col("l.l_suppkey") == F.col("loser.s_suppkey"))
    )
    priority = F.substring("o_orderpriority", 1, 1)
    level = (
        F.when(priority == "1", "G").when(priority == "2", "M").when(priority == "3", "A")
        .when(priority == "4", "B").otherwise("250")
    )
    rounds = F.array(*[F.lit(x) for x in ("RR", "R128", "R64", "R32", "R16", "QF", "SF", "F", "BR")])
    surface = F.col("w.l_returnflag")
    score = (
        F.when((F.col("o_orderstatus") == "F") & (level == "G"), "6-4 6-4 6-4")
        .when(F.col("o_orderstatus") == "F", "6-4 6-4")
        .when(F.col("o_orderstatus") == "O", "6-7(4) 6-3 6-1")
        .otherwise("6-4 RET")
    )
    tourney_id = F.concat(F.lit("T"), F.col("tourney_date").cast("string"))
    return joined.select(
        F.col("r_name").alias("tour"),
        tourney_id.alias("tourney_id"),
        F.concat(F.lit("Event "), tourney_id).alias("tourney_name"),
        F.when(surface == "A", "HARD").when(surface == "N", "CLAY").otherwise("GRASS").alias("surface"),
        F.lit(32.0).alias("draw_size"),
        level.alias("tourney_level"),
        "tourney_date",
        F.col("o_orderkey").alias("match_num"),
        *_person("winner"),
        *_person("loser"),
        score.alias("score"),
        F.when(level == "G", 5.0).otherwise(3.0).alias("best_of"),
        F.element_at(rounds, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("round"),
        (F.col("w.l_quantity").cast("int") + F.col("l.l_quantity").cast("int") + 60).cast("double").alias("minutes"),
        *_box("w", "w"),
        *_box("l", "l"),
    )


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "contests", lambda: build_contests(spark, sf_dir))


def build_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    i = F.col("i")
    game = F.floor((i - 1) / 6)
    in_set = game % 12
    labels = F.array(*[F.lit(x) for x in ("0-0", "15-0", "15-15", "30-15", "40-15", "40-30")])
    server = (game % 2 + 1).cast("long")
    winner = (
        F.when(F.col("event_type").isin("purchase", "click"), 1)
        .when(F.col("event_type").isin("view", "signup"), 2)
        .cast("long")
    )
    return events.select("user_id", "event_type", "ts", F.row_number().over(w).cast("long").alias("i")).select(
        F.col("user_id").cast("string").alias("match_id"),
        i.alias("Pt"),
        (F.floor(game / 12) % 2).cast("long").alias("Set1"),
        F.lit(0).cast("long").alias("Set2"),
        F.floor((in_set + 1) / 2).cast("long").alias("Gm1"),
        F.floor(in_set / 2).cast("long").alias("Gm2"),
        F.element_at(labels, ((i - 1) % 6 + 1).cast("int")).alias("Pts"),
        server.alias("Svr"),
        winner.alias("PtWinner"),
        F.coalesce((winner == server).cast("long"), F.lit(0).cast("long")).alias("isSvrWinner"),
        F.lit(0).cast("long").alias("TB?"),
        F.concat(F.lit("charting-"), F.when(F.col("user_id") % 2 == 1, "m").otherwise("w"), F.lit("-points.csv")).alias("source_file"),
        "ts",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "points", lambda: build_points(spark, sf_dir))


def point_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    surfaces = F.array(*[F.lit(x) for x in ("Hard", "Clay", "Grass", "Carpet")])
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("first"))
        .select(
            user.cast("string").alias("match_id"),
            F.concat(F.lit("P"), user.cast("string")).alias("Player 1"),
            F.concat(F.lit("Q"), user.cast("string")).alias("Player 2"),
            F.date_format("first", "yyyyMMdd").alias("Date"),
            F.concat(F.lit("Open "), (user % 10).cast("string")).alias("Tournament"),
            F.lit("F").alias("Round"),
            F.element_at(surfaces, (user % 4 + 1).cast("int")).alias("Surface"),
            F.when(user % 2 == 1, F.lit("5")).otherwise("3").alias("Best of"),
            F.lit("S").alias("Final TB?"),
            F.when(user % 2 == 1, "atp").otherwise("wta").alias("tour"),
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic scores and outcomes per contest, with repeated scores."""
    n = F.col("match_num")
    per_mille = 50 + (((n * 7919) % 1000) * 9 - (((n * 7919) % 1000) * 9) % 10) / 10
    return contests(spark, sf_dir).select(
        F.concat_ws("__", "tourney_id", n.cast("string")).alias("match_id"),
        "tour", "tourney_date", "surface", "match_num",
        ((n * 104729) % 1000 < per_mille).cast("int").alias("y_true"),
        (per_mille.cast("double") / F.lit(1000.0)).alias("prob_player_a_win"),
    ).withColumn("pred_player_a_win", (F.col("prob_player_a_win") >= 0.5).cast("int"))


def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of four models under five seeds: one row per contest, model and seed."""
    n = F.col("match_num")
    models = ("logit_baseline", "logit_tuned", "tree_baseline", "tree_tuned")
    runs = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(i).alias("model_no"), F.lit(s).alias("seed"))
            for i, m in enumerate(models)
            for s in (7, 17, 29, 42, 88)
        ]
    )
    salt = F.when(F.col("model_no") < 2, F.col("model_no") * 31).otherwise(F.col("model_no") * 31 + F.col("seed"))
    raw = (n * 7919 + salt * 613) % 1000
    per_mille = 50 + (raw * 9 - (raw * 9) % 10) / 10
    return (
        predictions(spark, sf_dir)
        .select("match_id", "tour", "tourney_date", "surface", "match_num", "y_true", F.explode(runs).alias("run"))
        .select("match_id", "tour", "tourney_date", "surface", "match_num", "y_true", "run.*")
        .withColumn("prob", per_mille.cast("double") / F.lit(1000.0))
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction requests: every contest asks for its two players as of its week."""
    return contests(spark, sf_dir).select(
        F.col("match_num").alias("request_id"),
        "tour",
        F.col("winner_name").alias("player_a"),
        F.col("loser_name").alias("player_b"),
        F.col("tourney_date").alias("as_of"),
        F.initcap("surface").alias("surface"),
        "round",
        F.col("best_of").cast("int").alias("best_of"),
        "tourney_level",
    )
