"""Scans, harmonisation, filters, validation and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions.coerce import category_or, category_upper, coerce_numeric, parse_yyyymmdd, to_double
from duelframe.operators import ingest, profile
from duelframe.operators.longview import long_view
from duelframe.plans import fixtures as fx
from duelframe.plans.oracle_base import CONTESTS
from duelframe.plans.registry import query, sql
from duelframe.session import fresh_path
from duelframe.sources.files import missing_items, scan_csv

RAW = """
raw AS (
  SELECT *, CASE WHEN match_num % 97 = 0 THEN '19930231' WHEN match_num % 5 = 0 THEN strftime(tourney_date, '%Y%m%d') || '.0'
      WHEN match_num % 11 = 0 THEN ' ' || strftime(tourney_date, '%Y%m%d') || ' ' ELSE strftime(tourney_date, '%Y%m%d') END AS date_text,
    CASE match_num % 6 WHEN 0 THEN lower(surface) WHEN 1 THEN ' ' || surface WHEN 2 THEN 'Carpet' WHEN 3 THEN NULL WHEN 4 THEN 'indoor' ELSE surface END AS surface_text,
    CASE WHEN match_num % 7 = 0 THEN 'n/a' WHEN match_num % 13 = 0 THEN 'NaN' ELSE w_ace::VARCHAR END AS ace_text
  FROM contests)
"""


def raw_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests as a source might deliver them: dates, surfaces and numbers as untidy text."""
    n = F.col("match_num")
    day = F.date_format("tourney_date", "yyyyMMdd")
    return fx.contests(spark, sf_dir).withColumns(
        {
            "date_text": F.when(n % 97 == 0, "19930231")
            .when(n % 5 == 0, F.concat(day, F.lit(".0")))
            .when(n % 11 == 0, F.concat(F.lit(" "), day, F.lit(" ")))
            .otherwise(day),
            "surface_text": F.when(n % 6 == 0, F.lower("surface"))
            .when(n % 6 == 1, F.concat(F.lit(" "), "surface"))
            .when(n % 6 == 2, "Carpet")
            .when(n % 6 == 3, F.lit(None))
            .when(n % 6 == 4, "indoor")
            .otherwise(F.col("surface")),
            "ace_text": F.when(n % 7 == 0, "n/a").when(n % 13 == 0, "NaN").otherwise(F.col("w_ace").cast("string")),
        }
    )


@query("scan_union_provenance", sql([CONTESTS], """
  SELECT match_num::VARCHAR AS match_num, tourney_id, winner_name, loser_name, score,
    'season=' || year(tourney_date) AS source_file
  FROM contests WHERE year(tourney_date) BETWEEN 1996 AND 1999"""))
def scan_union_provenance(spark, sf_dir):
    """Write contests as yearly CSV folders, then scan a range of years with provenance."""
    path = fresh_path(spark, "csv")
    fx.contests(spark, sf_dir).select(
        "match_num", "tourney_id", "winner_name", "loser_name", "score", F.year("tourney_date").alias("season")
    ).write.partitionBy("season").option("header", True).csv(path)
    return scan_csv(spark, [f"{path}/season={y}" for y in range(1996, 2000)], folder_level=True)


_DROPPED = {"winner_entry", "loser_entry"}
_RENAMED = {"tourney_name": "tournament", "winner_name": "winner", "loser_name": "loser", "w_SvGms": "w_svgms", "minutes": "mins"}


@query("schema_harmonise", sql([CONTESTS], "SELECT " + ", ".join(
    f'NULL::VARCHAR AS "{c}"' if c in _DROPPED else f'"{c}"' for c in ingest.CONTEST_COLUMNS
) + ", 'second' AS data_source, year(tourney_date)::INTEGER AS season FROM contests",
    ["winner_rank_points", "loser_rank_points"]))
def schema_harmonise(spark, sf_dir):
    source = (
        fx.contests(spark, sf_dir).drop(*_DROPPED)
        .withColumnsRenamed(_RENAMED).withColumn("season", F.year("tourney_date"))
    )
    return ingest.harmonise(source, "second")


@query("coerce_numeric", sql([CONTESTS, RAW], """
  SELECT match_num, CASE WHEN ace_text = 'NaN' THEN NULL ELSE try_cast(ace_text AS DOUBLE) END AS ace_text,
    try_cast(score AS DOUBLE) AS score FROM raw""", ["ace_text"]))
def coerce(spark, sf_dir):
    return coerce_numeric(raw_contests(spark, sf_dir).select("match_num", "ace_text", "score"), ["ace_text", "score"])


@query("parse_yyyymmdd", sql([CONTESTS, RAW], r"""
  SELECT match_num, date_text, try_strptime(trim(regexp_replace(date_text, '\.0$', '')), '%Y%m%d')::DATE AS parsed FROM raw"""))
def parse_dates(spark, sf_dir):
    return raw_contests(spark, sf_dir).select("match_num", "date_text", parse_yyyymmdd("date_text").alias("parsed"))


@query("standardise_category", sql([CONTESTS, RAW], """
  SELECT match_num, upper(trim(surface_text)) AS ingest,
    CASE WHEN upper(trim(surface_text)) IN ('HARD','CLAY','GRASS')
      THEN upper(left(trim(surface_text), 1)) || lower(substr(trim(surface_text), 2)) ELSE 'Hard' END AS rating,
    CASE WHEN upper(trim(surface_text)) IN ('HARD','CLAY','GRASS','CARPET')
      THEN upper(left(trim(surface_text), 1)) || lower(substr(trim(surface_text), 2)) ELSE 'Unknown' END AS point
  FROM raw"""))
def standardise(spark, sf_dir):
    return raw_contests(spark, sf_dir).select(
        "match_num",
        category_upper("surface_text").alias("ingest"),
        category_or("surface_text", ("Hard", "Clay", "Grass"), "Hard").alias("rating"),
        category_or("surface_text", ("Hard", "Clay", "Grass", "Carpet"), "Unknown").alias("point"),
    )


@query("drop_voided", sql([CONTESTS], """
  SELECT match_num, tour, winner_id, loser_id, score FROM contests
  WHERE NOT (upper(score) LIKE '%W/O%' OR upper(score) LIKE '%RET%')"""))
def voided(spark, sf_dir):
    return ingest.drop_voided(fx.contests(spark, sf_dir)).select("match_num", "tour", "winner_id", "loser_id", "score")


@query("date_range_semi", sql([CONTESTS], """
  SELECT match_num, tourney_date, tour FROM contests WHERE tour <> 'ASIA' AND tourney_date BETWEEN
    (SELECT min(tourney_date) FROM contests WHERE tour = 'ASIA' AND tourney_level = 'G' AND round = 'F' AND year(tourney_date) > 1992) AND
    (SELECT max(tourney_date) FROM contests WHERE tour = 'ASIA' AND tourney_level = 'G' AND round = 'F' AND year(tourney_date) > 1992)"""))
def date_range_semi(spark, sf_dir):
    contests = fx.contests(spark, sf_dir)
    reference = contests.filter("tour = 'ASIA' and tourney_level = 'G' and round = 'F' and year(tourney_date) > 1992")
    return ingest.within_dates_of(contests.filter("tour <> 'ASIA'"), reference).select("match_num", "tourney_date", "tour")


@query("fill_sequence_number", sql([CONTESTS], """
  SELECT line_no, season, tourney_id, CASE WHEN match_num IS NULL THEN
      99999 + row_number() OVER (PARTITION BY season, tourney_id, match_num IS NULL ORDER BY line_no) ELSE match_num END::BIGINT AS match_num
  FROM (SELECT match_num AS line_no, year(tourney_date)::INTEGER AS season, tourney_id,
    CASE WHEN match_num % 3 > 0 THEN match_num END AS match_num FROM contests)"""))
def fill_numbers(spark, sf_dir):
    lines = fx.contests(spark, sf_dir).select(
        F.col("match_num").alias("line_no"), F.year("tourney_date").alias("season"), "tourney_id",
        F.when(F.col("match_num") % 3 > 0, F.col("match_num")).alias("match_num"),
    )
    return ingest.fill_sequence_number(lines, ["line_no"])


@query("manifest_missing", sql([CONTESTS], """
  SELECT tour, tourney_date FROM contests EXCEPT
  SELECT tour, tourney_date FROM contests WHERE tourney_level = 'G' AND surface = 'CLAY'"""))
def manifest_missing(spark, sf_dir):
    """Tour weeks that hold no top-level clay contest."""
    contests = fx.contests(spark, sf_dir)
    present = contests.filter("tourney_level = 'G' and surface = 'CLAY'")
    return missing_items(contests, present, ["tour", "tourney_date"])


@query("validation_counts", sql([CONTESTS, RAW], r"""
  SELECT count(*)::BIGINT AS rows,
    count_if(try_strptime(trim(regexp_replace(date_text, '\.0$', '')), '%Y%m%d') IS NULL)::BIGINT AS invalid_dates,
    count_if(CASE WHEN ace_text = 'NaN' THEN NULL ELSE try_cast(ace_text AS DOUBLE) END IS NULL)::BIGINT AS invalid_numbers,
    count_if(winner_id = loser_id)::BIGINT AS self_contests, count_if(winner_seed IS NULL)::BIGINT AS unseeded_winners,
    (SELECT count(*) FROM (SELECT tourney_id || match_num FROM contests GROUP BY 1 HAVING count(*) <> 1))::BIGINT AS unpaired
  FROM raw"""))
def validation(spark, sf_dir):
    raw = raw_contests(spark, sf_dir)
    counts = profile.validation_counts(
        raw,
        {
            "invalid_dates": parse_yyyymmdd("date_text").isNull(),
            "invalid_numbers": to_double("ace_text").isNull(),
            "self_contests": F.col("winner_id") == F.col("loser_id"),
            "unseeded_winners": F.col("winner_seed").isNull(),
        },
    )
    unpaired = profile.unpaired_contests(long_view(raw)).count()  # one number
    return counts.withColumn("unpaired", F.lit(unpaired).cast("long"))


@query("processed_contests", sql([CONTESTS, RAW], r"""
  SELECT match_num::DOUBLE AS match_num, tour, upper(trim(surface_text)) AS surface,
    try_strptime(trim(regexp_replace(date_text, '\.0$', '')), '%Y%m%d')::DATE AS tourney_date, winner_id, loser_id,
    try_cast(winner_seed AS DOUBLE) AS winner_seed, winner_rank, winner_rank_points, w_ace, l_ace, score, best_of, minutes
  FROM raw WHERE NOT (upper(score) LIKE '%W/O%' OR upper(score) LIKE '%RET%')""", ["winner_rank_points"]))
def processed(spark, sf_dir):
    raw = raw_contests(spark, sf_dir).drop("tourney_date", "surface").withColumnsRenamed(
        {"date_text": "tourney_date", "surface_text": "surface"}
    )
    return ingest.process_contests(raw).select(
        "match_num", "tour", "surface", "tourney_date", "winner_id", "loser_id", "winner_seed", "winner_rank",
        "winner_rank_points", "w_ace", "l_ace", "score", "best_of", "minutes",
    )


_ALL = ("tour", *ingest.CONTEST_COLUMNS)


@query("schema_dump", sql([CONTESTS], "SELECT column_name, CASE kind WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(kind) END AS data_type, rows FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, any_value(typeof(\"{c}\")) AS kind, count(*)::BIGINT AS rows FROM contests" for c in _ALL) + ")"))
def dump(spark, sf_dir):
    return profile.schema_dump(fx.contests(spark, sf_dir))


@query("profile_summary", sql([CONTESTS], f"""
  SELECT tour, count(*)::BIGINT AS rows, {len(_ALL)}::BIGINT AS columns, count(tourney_date)::BIGINT AS dated,
    min(tourney_date) AS first_date, max(tourney_date) AS last_date FROM contests GROUP BY tour"""))
def summary(spark, sf_dir):
    return profile.summary(fx.contests(spark, sf_dir).select(*_ALL), "tourney_date", ["tour"])


_FIRST = ["tourney_date", "tourney_id", "match_num", "winner_id", "loser_id", "score"]


@query("profile_first_rows", sql([CONTESTS], f"SELECT {', '.join(_FIRST)} FROM contests ORDER BY {', '.join(_FIRST)} LIMIT 5"))
def first(spark, sf_dir):
    return profile.first_rows(fx.contests(spark, sf_dir).select(*_FIRST), _FIRST)


@query("profile_counts", sql([CONTESTS], """
  SELECT field, value, rows, row_number() OVER (PARTITION BY field ORDER BY rows DESC, value NULLS LAST)::INTEGER AS place
  FROM (SELECT 'surface' AS field, surface AS value, count(*)::BIGINT AS rows FROM contests GROUP BY surface UNION ALL
        SELECT 'round', round, count(*) FROM contests GROUP BY round UNION ALL
        SELECT 'winner_seed', winner_seed, count(*) FROM contests GROUP BY winner_seed)
  QUALIFY place <= 10"""))
def counts(spark, sf_dir):
    return profile.value_counts(fx.contests(spark, sf_dir), ["surface", "round", "winner_seed"])


@query("profile_missing", sql([CONTESTS], "SELECT column_name, missing FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg(CASE WHEN \"{c}\" IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS missing FROM contests"
    for c in ("tour", *ingest.CONTEST_COLUMNS)) + ") ORDER BY missing DESC, column_name LIMIT 15", ["missing"]))
def missing(spark, sf_dir):
    return profile.missing_share(fx.contests(spark, sf_dir))


@query("profile_level_round", sql([CONTESTS], """
  SELECT tourney_level, round, count(*)::BIGINT AS rows FROM contests GROUP BY ALL"""))
def level_round(spark, sf_dir):
    return fx.contests(spark, sf_dir).groupBy("tourney_level", "round").agg(F.count(F.lit(1)).alias("rows"))


@query("value_fraction", sql([CONTESTS], """
  SELECT avg((upper(score) LIKE '%RET%')::INTEGER) AS ret_share, avg((upper(score) LIKE '%W/O%')::INTEGER) AS walkover_share
  FROM contests""", ["ret_share", "walkover_share"]))
def fractions(spark, sf_dir):
    return profile.text_share(fx.contests(spark, sf_dir), "score", {"ret_share": "RET", "walkover_share": "W/O"})


_SECOND = ["season", "tourney_id", "match_num", "tourney_date", "winner_id", "loser_id", "winner_name", "loser_name", "score", "round", "minutes", "surface"]
_SECOND_ORDER = [c for c in _SECOND if c not in ("season", "tourney_id", "match_num")]


@query("second_source_build", sql([CONTESTS, RAW, r"""
  second AS (SELECT season, tourney_id, n, try_strptime(trim(regexp_replace(date_text, '\.0$', '')), '%Y%m%d')::DATE AS tourney_date,
      winner_id, loser_id, winner_name || ' é' AS winner_name, loser_name, score, round, minutes::DOUBLE AS minutes, upper(trim(surface_text)) AS surface
    FROM (SELECT *, year(tourney_date)::INTEGER AS season, CASE WHEN match_num % 3 > 0 THEN match_num END AS n FROM raw)
    WHERE season BETWEEN 1990 AND 1999 AND NOT (upper(score) LIKE '%W/O%' OR upper(score) LIKE '%RET%')),
  near AS (SELECT * FROM second WHERE tourney_date BETWEEN (SELECT min(tourney_date) FROM contests WHERE tour = 'ASIA' AND year(tourney_date) > 1992)
    AND (SELECT max(tourney_date) FROM contests WHERE tour = 'ASIA' AND year(tourney_date) > 1992))"""],
  f"""SELECT * REPLACE (CASE WHEN match_num IS NULL THEN 99999 + row_number() OVER (PARTITION BY season, tourney_id, match_num IS NULL
      ORDER BY {', '.join(_SECOND_ORDER)}) ELSE match_num END::BIGINT AS match_num) FROM (SELECT * RENAME (n AS match_num) FROM near)"""))
def second_source(spark, sf_dir):
    """Yearly files of another source, with other names and Latin-1 text in later years, and years asked for that have none."""
    root = fresh_path(spark, "second-source")
    raw = raw_contests(spark, sf_dir).select(
        "tourney_id", F.col("date_text").alias("tourney_date"), F.col("surface_text").alias("surface"), "winner_id", "loser_id",
        F.concat("winner_name", F.lit(" é")).alias("winner_name"), "loser_name", "score", "round", "minutes", "w_ace",
        F.when(F.col("match_num") % 3 > 0, F.col("match_num")).alias("match_num"), F.year("tourney_date").alias("year"),
    )
    late = raw.drop("w_ace").withColumnsRenamed(
        {"tourney_id": "tournament_id", "tourney_date": "date", "winner_name": "winner", "loser_name": "loser", "minutes": "mins"}
    )
    for part, folder, encoding in ((raw.filter("year < 1996"), "early", "UTF-8"), (late.filter("year >= 1996"), "late", "ISO-8859-1")):
        part.write.partitionBy("year").option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(f"{root}/{folder}")
    reference = fx.contests(spark, sf_dir).filter("tour = 'ASIA' and year(tourney_date) > 1992")
    built, _ = ingest.build_from_years(spark, root, range(1990, 2000), "second", reference, r"year=(\d{4})/", numbering=_SECOND_ORDER)
    return built.select(*_SECOND)
