"""Times, delimited files and JSON as people write them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarsia.operators import reading

TIMES = {
    "Oct 1st 2026 22:53:09": datetime(2026, 10, 1, 22, 53, 9), "1 Oct 2026": datetime(2026, 10, 1), "Oct 1, 2026 10:53:09 PM": datetime(2026, 10, 1, 22, 53, 9), "2026-10-01 22:53:09": datetime(2026, 10, 1, 22, 53, 9),
    "2026/10/01 22:53": datetime(2026, 10, 1, 22, 53), "2026-10-01T22:53:09Z": datetime(2026, 10, 1, 22, 53, 9), "2026-10-01 22:53:09 UTC": datetime(2026, 10, 1, 22, 53, 9), "Thu Oct  1 22:53:09 2026": datetime(2026, 10, 1, 22, 53, 9),
    "13/04/2026 10:00": datetime(2026, 4, 13, 10), "04/13/2026": datetime(2026, 4, 13), "1790000000": datetime(2026, 9, 21, 14, 13, 20), "1790000000000": datetime(2026, 9, 21, 14, 13, 20), "1767225600.5": datetime(2026, 1, 1, 0, 0, 0, 500000),
    "2 March 2026": datetime(2026, 3, 2), "1st Mar 2026": datetime(2026, 3, 1), "2-Mar-2026 1:05 am": datetime(2026, 3, 2, 1, 5), "2026-Mar-02": datetime(2026, 3, 2), "20260302": datetime(2026, 3, 2), "2026-03-02T05:30:00+05:30": datetime(2026, 3, 2),
    "2026-03-02 05:30:00.25-0130": datetime(2026, 3, 2, 7, 0, 0, 250000), "05/05/2026": datetime(2026, 5, 5), "12:00 AM": None, "03/04/2026": None, "garbage": None, "": None, "12345": None, "99999999999": None, "2026-13-45": None, "2026-02-30": None,
    "2026-01-01 25:00": None, "2026-01-01 13:00 PM": None, "1 Foo 2026": None, "31/04/2026": None, "0000000001": None,
}


def test_times(spark):
    rows = spark.createDataFrame([(t,) for t in TIMES] + [(None,)], "t string")
    got = {r.t: r.at for r in rows.select("t", reading.written_time(F.col("t")).alias("at")).collect()}
    assert got == TIMES | {None: None}


def test_times_of_zones_and_orders(spark):
    cases = {
        ("2026-03-29 02:30", "Europe/Paris"): datetime(2026, 3, 29, 1, 30), ("2026-10-25 02:30", "Europe/Paris"): datetime(2026, 10, 25, 0, 30), ("2026-10-25 02:30Z", "Europe/Paris"): datetime(2026, 10, 25, 2, 30),
        ("1 Jan 2026 09:00", "+05:30"): datetime(2026, 1, 1, 3, 30), ("1767225600", "Asia/Tokyo"): datetime(2026, 1, 1),
    }
    rows = spark.createDataFrame(list(cases), "t string, z string")
    assert {(r.t, r.z): r.at for r in rows.select("t", "z", reading.written_time(F.col("t"), F.col("z")).alias("at")).collect()} == cases
    one = spark.createDataFrame([("03/04/2026",)], "t string").select(reading.written_time(F.col("t"), order="dmy").alias("d"), reading.written_time(F.col("t"), order="mdy").alias("m")).first()
    assert (one.d, one.m) == (datetime(2026, 4, 3), datetime(2026, 3, 4))


def test_session_zone_does_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("2026-03-08 02:30",), ("1767225600",)], "t string")
        assert [r.at for r in rows.select(reading.written_time(F.col("t")).cast("string").alias("at")).collect()] == ["2026-03-08 02:30:00", "2026-01-01 00:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_delimited_files_of_several_layouts(spark, tmp_path):
    files = {"a.csv": 'id,state\n1,open\n,\n\n  ,  \n2\n3,closed,extra\n', "b.csv": 'state,id\nclosed,4\n', "c.csv": '﻿"id, long";state;id\n"5;x";"two\nlines";6\n', "d.tsv": "id\tnote\n7\ta,b,c\n", "e.csv": "id,,Id,ＩＤ\n8,x,y,z\n", "empty.csv": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = sorted(str((r["id"], r["state"], r["id_long"], r["note"], r["column_2"], r["id_2"], r["id_3"])) for r in reading.scan_delimited(spark, str(tmp_path)).collect())
    want = [("1", "open"), ("2",), ("3", "closed"), ("4", "closed"), ("6", "two\nlines", "5;x"), ("7", None, None, "a,b,c"), ("8", None, None, None, "x", "y", "z")]
    assert got == sorted(str((w + (None,) * 7)[:7]) for w in want)
    assert reading.scan_delimited(spark, str(tmp_path / "empty.csv")).count() == 0


def test_headers():
    assert reading.clean_headers(["﻿Alert ID", "", "Severity", "severity", " alert_id "]) == ["alert_id", "column_2", "severity", "severity_2", "alert_id_2"]
    assert {reading.key_of(x) for x in (" Alert ID ", "alert_id", "ALERT-ID")} == {"alert_id"} and reading.key_of("MITRE ATT&CK Tactic") == "mitre_att_ck_tactic"
    assert reading.sniffed('"a,b,c,d";x;y') == ";" and reading.sniffed("single") == ","


@pytest.mark.parametrize("text, ids, bad", [
    ('[{"id": 1}, {"id": 2}]', ["1", "2"], 0), ('{"total": 2, "data": [{"id": 1}, {"id": 2}]}', ["1", "2"], 0), ('{\n "id": 1,\n "tags": ["a"]\n}', ["1"], 0), ('{"id": 1}\n\n{"id": 2}\n', ["1", "2"], 0),
    ('{"id": 1}\nnot json\n[1, 2]\n{"id": 2}\n', ["1", "2"], 3), ('[\n {"id": 1},\n {"id": "x"}\n]', ["1", "x"], 0), ("alert_id,severity\nA1,high\n", [], 2), ("", [], 0),
    ('{"id": 1, "cut\n{"id": 2}\n\n{"id": 3}', ["2", "3"], 1),
])
def test_json_shapes(spark, tmp_path, text, ids, bad):
    (tmp_path / "x.json").write_bytes(("﻿" + text).encode())
    rows = reading.json_records(spark, str(tmp_path / "x.json")).select("bad", reading.value_at("record", "id").alias("id"), F.col("record").isNull().alias("lost")).collect()
    assert sorted(r.id for r in rows if not r.lost) == ids and sum(r.bad is not None for r in rows) == bad


def test_json_values_one_after_another(spark, tmp_path):
    """Objects over many lines, several a file, with cut ones between them; and more files than the driver should hear of."""
    (tmp_path / "many").mkdir()
    (tmp_path / "x.json").write_text('{\n "id": 1,\n "tags": [{"a": 1},\n {"a": 2}]\n}\n{\n "id": 2\n}\n\n {"id": 3}\n{\n "id": 4,\n{"id": 5}\n')
    (tmp_path / "y.json").write_text('[\n{"id": 6}\n,\n{"id": 7}\n]\n[{"id": 8}]\nnote\n')
    for k in range(40):
        (tmp_path / "many" / f"{k}.json").write_text(f'{{\n "id": {100 + k}\n}}')
    df = reading.json_records(spark, str(tmp_path))
    rows = df.select("bad", reading.value_at("record", "id").cast("long").alias("id")).collect()
    assert sorted(r.id for r in rows if r.bad is None) == [1, 2, 3, 5, 6, 7, 8] + list(range(100, 140))
    assert sorted(r.bad.strip() for r in rows if r.bad is not None) == ['"id": 4,', "note", "{"]
    assert ".json" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_paths(spark):
    rows = spark.sql("""SELECT parse_json('{"a": {"b": 1}, "a.b": null, "c": " ", "d": {"e": "x"}, "x.y": "dot", "x": {"y": "deep"}}') AS v""")
    one = rows.select(reading.value_at("v", "a.b").alias("p"), reading.value_at("v", "c", "d.e").alias("q"), reading.value_at("v", "x.y").alias("r"), reading.value_at("v", "no.such").alias("s")).first()
    assert tuple(one) == ("1", "x", "dot", None)
