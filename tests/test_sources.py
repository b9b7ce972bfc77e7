"""Readers on files: headers, damaged lines, missing columns, absent and broken sources."""

import json

import pytest

from farelake.sources import tables as T


def test_ticket_csv_is_text_and_keeps_bad_lines(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("airline,stops,price\n Indigo ,zero,12\n\"A \"\"x\"\"\",,1e3\nbad,line,1,2,3\n")
    rows = T.read_ticket_csv(spark, str(p)).collect()
    good = [tuple(r)[:3] for r in rows if r._corrupt_record is None]
    assert good == [(" Indigo ", "zero", "12"), ('A "x"', None, "1e3")]
    assert [r._corrupt_record for r in rows if r._corrupt_record] == ["bad,line,1,2,3"]


def test_airports_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("city,airport,iata,state,country,latitude,longitude\nDelhi,Indira Gandhi,DEL,DL,IN,28.5,77.1\nGoa,Dabolim,GOI,GA,IN,15.4,73.8\n")
    rows = T.read_airports_csv(spark, str(p)).orderBy("seq").collect()
    assert [r.iata for r in rows] == ["DEL", "GOI"] and rows[0].aliases == ""
    p.write_text("city,iata\nDelhi,DEL\n")
    with pytest.raises(ValueError, match="missing columns"):
        T.read_airports_csv(spark, str(p))


def test_observations_json(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps([{"route": "DEL -> BOM", "distance_km": 1148.2, "days_until_departure": 7, "current_fare": 5400.0, "extra": 1}, {"route": "X"}]))
    rows = T.read_observations_json(spark, str(p)).collect()
    assert rows[0].current_fare == 5400.0 and rows[0].days_until_departure == 7 and rows[1].current_fare is None


def test_history_absent_is_empty_and_broken_is_an_error(spark, tmp_path):
    assert T.read_comparables_history(spark, str(tmp_path / "none")).count() == 0
    whole = str(tmp_path / "h")
    spark.createDataFrame([(1.0, 2.0), (None, 2.0), (0.0, 2.0), (3.0, None)], "price double, distance_km double").write.parquet(whole)
    assert T.read_comparables_history(spark, whole).count() == 1
    broken = tmp_path / "b"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"PAR1 not a footer")
    with pytest.raises(Exception):
        T.read_comparables_history(spark, str(broken)).count()
