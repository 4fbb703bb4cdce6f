import json
import os

import pytest

from duelframe.operators import ingest
from duelframe.operators.profile import demand_valid, unpaired_contests
from duelframe.sources import files
from pyspark.sql import functions as F


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_yearly_scan_skips_missing_years(spark, tmp_path):
    write(tmp_path, "atp_matches_2019.csv", "a,b\n1,x\n")
    write(tmp_path, "atp_matches_2021.csv", "b,c\ny,3\n")
    df, missing = files.scan_years(spark, str(tmp_path), range(2019, 2022))
    assert missing == [2020]
    rows = sorted((r.a or "", r.b, r.c or "", r.source_file) for r in df.collect())
    assert rows == [("", "y", "3", "atp_matches_2021.csv"), ("1", "x", "", "atp_matches_2019.csv")]
    with pytest.raises(FileNotFoundError):
        files.scan_years(spark, str(tmp_path), range(2000, 2002))


def test_encodings(spark, tmp_path):
    paths = [write(tmp_path, "u.csv", "n\nJosé\n"), write(tmp_path, "l.csv", "n\nMüller\n", "latin-1")]
    good, other = files.split_by_encoding(spark, paths)
    assert [os.path.basename(p) for p in good] == ["u.csv"] and [os.path.basename(p) for p in other] == ["l.csv"]
    assert {r.n for r in files.scan_csv_any_encoding(spark, paths).collect()} == {"José", "Müller"}


def test_point_files_and_manifest(spark, tmp_path):
    for name in ("charting-m-points-2010s.csv", "charting-m-points-2020s.csv", "charting-w-points-2020s.csv"):
        write(tmp_path, name, "match_id,Pt\nm,1\n")
    got = files.scan_points(spark, str(tmp_path), ["men", "w"])
    assert sorted(r.tour for r in got.collect()) == ["atp", "atp", "wta"]
    missing = files.missing_files(spark, str(tmp_path), ["charting-m-points-2020s.csv", "charting-m-matches.csv"])
    assert [r.file_name for r in missing.collect()] == ["charting-m-matches.csv"]
    with pytest.raises(ValueError):
        files.scan_points(spark, str(tmp_path), ["juniors"])


def test_metric_files(spark, tmp_path):
    write(tmp_path, "a.json", json.dumps({"validation": {"log_loss": 0.6}}))
    write(tmp_path, "b.json", json.dumps({"raw_validation": {"log_loss": 0.7}}))
    got = files.read_metrics_json(spark, str(tmp_path), {"v": "validation.log_loss", "raw": "raw_validation.log_loss", "none": "x.y"})
    assert sorted((r.source_file, r.v, r.raw, r.none) for r in got.collect()) == [("a.json", 0.6, None, None), ("b.json", None, 0.7, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    files.write_table(df, f"{tmp_path}/p", ["b"])
    files.write_csv(df, f"{tmp_path}/c")
    files.write_json(df, f"{tmp_path}/j")
    assert spark.read.parquet(f"{tmp_path}/p").first().a == 1
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first().b == "x"
    assert spark.read.json(f"{tmp_path}/j").first().a == 1


def test_harmonise_takes_the_first_known_name(spark):
    raw = spark.createDataFrame([("A", "B", "z", 5), (None, "B", "z", 6)], "winner string, loser string, w_1stin string, match_id int")
    rows = ingest.harmonise(raw, "second", 2020).collect()
    assert len(rows) == 1 and len(rows[0]) == len(ingest.CONTEST_COLUMNS) + 2 == 51
    assert rows[0].winner_name == "A" and rows[0]["w_1stIn"] == "z" and rows[0].match_num == 5 and rows[0].surface is None


def test_validation(spark):
    df = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", "t"), ("c", "t"), ("c", "u")], "match_id string, tour string")
    assert sorted((r.match_id, r.tour) for r in unpaired_contests(df).collect()) == [("b", "t"), ("c", "t"), ("c", "u")]
    with pytest.raises(ValueError, match="odd"):
        demand_valid(df, {"odd": F.col("match_id") == "b"})
    with pytest.raises(ValueError, match="lacks"):
        from duelframe.operators.ratings import rate_contests

        rate_contests(df)


def test_reference_range_is_optional(spark):
    df = spark.createDataFrame([(1,)], "tourney_date int")
    assert ingest.within_dates_of(df, None) is df
    with pytest.raises(ValueError):
        ingest.within_dates_of(df, df.filter("false"))


def test_encodings_of_files_with_one_name(spark, tmp_path):
    from duelframe.sources.files import scan_csv_any_encoding

    for folder, encoding in (("2019 a", "utf-8"), ("2020", "latin-1")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "m.csv").write_bytes("name\nJosé\n".encode(encoding))
    paths = [str(p) for p in sorted(tmp_path.glob("*/m.csv"))]
    assert [r.name for r in scan_csv_any_encoding(spark, paths).collect()] == ["José", "José"]
