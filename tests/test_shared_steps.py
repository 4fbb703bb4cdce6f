"""Steps that most queries share do their work once per row, and only what is asked for."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from duelframe.operators.longview import long_view
from duelframe.plans import fixtures as fx

CONTESTS = "tour string, tourney_id string, tourney_date date, match_num long, surface string, score string, tourney_level string, winner_id string, winner_name string, loser_id string, loser_name string, w_ace double, l_ace double"


@pytest.fixture
def contests(spark):
    day = date(2020, 1, 6)
    rows = [
        ("X", "T1", day, 1, "Hard", "6-4 6-4", "G", "1", "a", "2", "b", 3.0, 1.0),
        ("X", "T1", day, 2, "Clay", "6-7(4) 6-3 6-1", "A", "2", "b", "1", "a", float("nan"), None),
        ("X", "T1", None, None, None, None, None, "1", "a", None, None, 2.0, float("inf")),
    ]
    return spark.createDataFrame(rows, CONTESTS)


def test_long_view_reads_what_is_asked_for(contests, spark, tmp_path):
    contests.write.parquet(f"{tmp_path}/contests")
    asked = long_view(spark.read.parquet(f"{tmp_path}/contests")).select("match_id", "player_id")
    scan = asked._jdf.queryExecution().executedPlan().toString()
    assert "w_ace" not in scan and "loser_name" not in scan
    sides = long_view(contests).orderBy("match_num", F.desc("is_winner")).select("player_id", "opponent_id", "label_win", "aces").collect()
    assert [tuple(r) for r in sides] == [
        ("1", None, 1, 2.0), (None, "1", 0, None), ("1", "2", 1, 3.0), ("2", "1", 0, 1.0), ("2", "1", 1, None), ("1", "2", 0, None),
    ]


def test_contests_sort_the_lines_once(spark, tmp_path, sf):
    """An order's dearest line wins, the dearest of another supplier loses; a missing supplier is one of its own."""
    lines = [  # order, number, supplier, price
        (1, 1, 10, 50.0), (1, 2, 10, 90.0), (1, 3, 11, 70.0), (1, 4, 12, 60.0),  # 10 beats 11
        (2, 1, 10, 50.0), (2, 2, 10, 40.0),  # one supplier only
        (3, 1, 12, 30.0), (3, 2, 11, 30.0),  # equal prices: the first line wins
        (4, 1, 11, 80.0), (4, 2, None, 70.0), (4, 3, 12, 60.0),  # second is a line without supplier: no contest
        (None, 1, 10, 80.0), (None, 2, 11, 70.0), (5, 1, 11, None), (5, 2, 12, 10.0),
    ]
    kinds = "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double"
    whole = spark.createDataFrame(lines, kinds).select(
        "*", F.lit(5.0).alias("l_quantity"), F.lit(1).cast("long").alias("l_partkey"), F.lit(0.1).alias("l_discount"), F.lit(0.0).alias("l_tax"),
        F.lit(date(1998, 1, 1)).alias("l_shipdate"), F.lit("A").alias("l_returnflag"),
    )
    whole.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 6).select(
        F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.lit("1-URGENT").alias("o_orderpriority"), F.lit(date(1998, 1, 1)).alias("o_orderdate"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS c_custkey, 0L AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(10, 13).select(
        F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("s_name"), F.lit(0).cast("long").alias("s_nationkey"),
        F.lit(1.0).alias("s_acctbal"),
    ).write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("nation", "region"):
        fx.table(spark, sf, name).write.parquet(f"{tmp_path}/{name}.parquet")
    built = fx.build_contests(spark, str(tmp_path))
    found = {r.match_num: (r.winner_id, r.loser_id) for r in built.select("match_num", "winner_id", "loser_id").collect()}
    assert found == {1: ("10", "11"), 3: ("12", "11"), 5: ("11", "12")}
    assert "SortAggregate" not in built._jdf.queryExecution().executedPlan().toString()
