"""Yearly files with unlike headers and encodings, equal base names, missing years."""

import pytest

from duelframe.operators.ingest import build_from_years
from duelframe.sources.files import survey_csv


def _write(root, files):
    for name, (text, encoding) in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode(encoding))


def test_unlike_files_are_one_table(spark, tmp_path):
    _write(tmp_path, {
        "a/2001.csv": ("tourney_id,tourney_date,match_num,winner_name,loser_name,score\n1,20010105,7,José,Ann,6-1 6-1\n1,20010105,,Bo,Cy,6-2 6-2\n", "utf-8"),
        "b/2001.csv": ("tournament_id,date,winner,loser,score\n1,20010106,Zoë,Al,6-3 6-3\n", "latin-1"),
        "2003.csv": ("﻿tournament,date,winner,loser,score\nx,20030106,Di,Ed,W/O\ny,20030107,,Ed,6-0 6-0\nz,20030108.0,Flo,Gus,\n", "utf-8"),
        "2004.csv": ("", "utf-8"),
        "2009.csv": ("winner,loser\nNot,Asked\n", "utf-8"),
    })
    built, missing = build_from_years(spark, str(tmp_path), range(2000, 2005), "second")
    rows = [(r.season, r.winner_name, r.match_num, str(r.tourney_date)) for r in built.collect()]
    assert missing == [2000, 2002, 2004]  # an empty file is none
    assert [r[3] for r in rows] == sorted(r[3] for r in rows)
    assert set(rows) == {
        (2001, "José", 7, "2001-01-05"), (2001, "Bo", 100_000, "2001-01-05"), (2001, "Zoë", 100_001, "2001-01-06"), (2003, "Flo", 100_000, "2003-01-08"),
    }
    with pytest.raises(FileNotFoundError):
        build_from_years(spark, str(tmp_path), [1990], "second")


def test_two_hundred_files_in_one_survey(spark, tmp_path):
    headers = ["winner,loser", "winner_name,loser_name", "winner,loser,score", "winner,loser,date", "loser,winner"]
    _write(tmp_path, {
        f"{k % 4}/{1900 + k // 4}.csv": (f"{headers[k % 5]}\n" + ",".join(["é", "b", "c"][: headers[k % 5].count(",") + 1]) + "\n", ("utf-8", "latin-1")[k % 2])
        for k in range(200)
    })
    paths = [str(p) for p in tmp_path.rglob("*.csv")]
    groups = survey_csv(spark, paths)
    assert len(groups) == 10 and sum(map(len, groups.values())) == 200
    built, missing = build_from_years(spark, str(tmp_path), range(1900, 1951), "second")
    assert built.count() == 200 and missing == [1950]
    assert built.filter("winner_name in ('é', 'b') and loser_name in ('é', 'b')").count() == 200
