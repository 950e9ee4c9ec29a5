import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from transit_spark import schemas
from transit_spark.operators.weather import standardise_weather
from transit_spark.sinks.snapshots import claim_version, current_snapshot, history, publish_log, publish_snapshot, put_if_absent
from transit_spark.sinks.tables import (
    append_path,
    export_csv,
    export_documents,
    publish_path,
    publish_table,
    register_external,
    replace_dates,
    replace_table_dates,
)
from transit_spark.sources import csv_tables, tables
from transit_spark.sources.delay_documents import (
    delay_facts,
    read_delay_documents,
    read_document_records,
    rejected_cells,
    rejected_rows,
    split_records,
    unpivot_documents,
)
from transit_spark.sources.pages import page_cards

MATRIX = [
    {
        "Number": "12673",
        "Name": "Express",
        "data": [
            ["Date", "MAS", {"label": "AJJ", "type": "number"}],
            ["2025,1,31", 5, None],
            ["2025,2,30", 1, 1],
            ["2025,0,1", 1, 1],
            ["2025,13,1", 1, 1],
            ["2025,1,0", 1, 1],
            ["2025,1", 1, 1],
            ["soon", 1, 1],
            ["2025,2,1", 7],
            ["2025,2,2", 8.9, 9, 10],
            ["2025,2,3", "late", 4],
        ],
    }
]


@pytest.mark.parametrize("lines", [True, False])
def test_delay_documents(spark, tmp_path, rows, lines):
    path = tmp_path / "delays.json"
    path.write_text("\n".join(json.dumps(t) for t in MATRIX) if lines else json.dumps(MATRIX, indent=1))
    documents = read_delay_documents(spark, str(path), json_lines=lines)
    facts = delay_facts(documents)
    assert rows(facts, "station", "travel_date", "delay_min") == [
        ("AJJ", dt.date(2025, 1, 31), None),
        ("AJJ", dt.date(2025, 2, 2), 9),
        ("AJJ", dt.date(2025, 2, 3), 4),
        ("MAS", dt.date(2025, 1, 31), 5),
        ("MAS", dt.date(2025, 2, 1), 7),
        ("MAS", dt.date(2025, 2, 2), 8),
    ]
    assert [f.name for f in facts.schema] == schemas.DELAY_FACTS.names
    assert rejected_rows(documents).count() == 6
    reasons = {r.reason: r.n for r in rejected_cells(documents).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert reasons == {"date": 12, "delay": 1}


def test_csv_sources(spark, tmp_path, rows):
    weather = tmp_path / "weather.csv"
    weather.write_text(
        "Date,Latitude,Longitude,weather_code (wmo code),precipitation_sum (mm)\n01-02-2025,1.5,2.5,61,3.2\n02-02-2025,1.5,2.5,,0\n"
    )
    want = [(dt.date(2025, 2, 1), 61, 3), (dt.date(2025, 2, 2), None, 1)]
    for infer in (False, True):
        clean = standardise_weather(csv_tables.read_weather(spark, str(weather), infer=infer))
        assert rows(clean, "weather_date", "weather_code", "weather_risk_score") == want

    bookings = tmp_path / "bookings.csv"
    bookings.write_text(
        "\n" + ",".join(schemas.BOOKINGS.names) + "\n7,12,01-Sep,SL,GN,A,B,01-Jan,WL,2,Adult,Online,130,10,18,Express,120,None,No,WL12,Confirmed\n"
    )
    assert rows(csv_tables.read_bookings(spark, str(bookings)), "PNR", "Fare", "`Waitlist No`") == [("7", 120, "WL12")]

    pairs = tmp_path / "pairs.csv"
    pairs.write_text("train_number,station\n1,A\n1,B\n")
    assert rows(csv_tables.read_station_pairs(spark, str(pairs))) == [(1, "A"), (1, "B")]

    scraped = tmp_path / "scraped.csv"
    scraped.write_bytes(b"Train Number,Station Name,Delay\r\n1,A,13 Min\r\n")
    assert rows(csv_tables.read_scraped_delays(spark, str(scraped))) == [("1", "A", "13 Min")]

    stations = tmp_path / "stations.csv"
    stations.write_text("station_code,station_name,latitude,longitude\nA,Alpha,1.5,2.5\n")
    assert rows(csv_tables.read_station_master(spark, str(stations))) == [("A", "Alpha", 1.5, 2.5)]


def days(spark, n=4):
    return spark.range(n).select(
        F.col("id").cast("int").alias("v"), F.date_add(F.lit(dt.date(2025, 1, 1)), (F.col("id") % 2).cast("int")).alias("travel_date")
    )


def test_managed_tables(spark, rows):
    publish_table(days(spark), "managed_days", partition_by="travel_date")
    pruned = tables.read_table(spark, "managed_days", ["v"], date_from=dt.date(2025, 1, 2))
    assert rows(pruned) == [(1,), (3,)]
    assert "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().toString()
    publish_table(days(spark).withColumn("extra", F.lit(1)), "managed_days")
    assert spark.table("managed_days").columns == ["v", "travel_date", "extra"]


def test_path_and_external_tables(spark, tmp_path, rows):
    path = str(tmp_path / "days")
    publish_path(days(spark), path, partition_by="travel_date")
    publish_path(days(spark, 6), path)
    assert tables.read_path(spark, path).count() == 6
    append_path(days(spark), str(tmp_path / "log"))
    append_path(days(spark), str(tmp_path / "log"))
    assert tables.read_path(spark, str(tmp_path / "log")).count() == 8
    assert rows(tables.read_path(spark, path, ["v"], date_to=dt.date(2025, 1, 1))) == [(0,), (2,), (4,)]
    register_external(spark, "external_days", path)
    register_external(spark, "external_days", path)
    assert spark.table("external_days").count() == 6


def test_exports(spark, tmp_path, rows):
    export_csv(days(spark).select("v"), str(tmp_path / "csv"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv"))) == [("0",), ("1",), ("2",), ("3",)]
    documents = days(spark).select(F.to_json(F.struct("v")).alias("document"))
    export_documents(documents, str(tmp_path / "json"))
    assert rows(spark.read.schema("v INT").json(str(tmp_path / "json"))) == [(0,), (1,), (2,), (3,)]


def test_snapshots_may_read_what_they_replace(spark, tmp_path, rows):
    root = str(tmp_path / "snap")
    assert current_snapshot(spark, root) is None and history(spark, root).count() == 0
    publish_snapshot(days(spark), root, view="snap_view")
    for _ in range(6):
        publish_snapshot(spark.table("snap_view").withColumn("v", F.col("v") + 1), root, "snap_view", operation="UPDATE")
    assert rows(current_snapshot(spark, root), "v") == [(6,), (7,), (8,), (9,)]
    assert [r.version for r in history(spark, root).collect()] == [6, 5, 4, 3, 2]


def test_two_writers_get_two_versions(spark, tmp_path):
    """Both have read the same newest version before either claims the next one."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "shared")
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda k: claim_version(spark, root, f"p{k}", "WRITE"), range(24)))
    assert sorted(versions) == list(range(24))
    assert {(r.version, r.path) for r in publish_log(spark, root).collect()} == {(v, f"p{k}") for k, v in enumerate(versions)}
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: publish_snapshot(days(spark, k + 1), root, operation=f"W{k}"), range(3)))
    top = history(spark, root, 3).collect()
    assert [r.version for r in top] == [26, 25, 24] and {r.operation for r in top} == {"W0", "W1", "W2"}
    assert {current_snapshot(spark, root, v).count() for v in (24, 25, 26)} == {1, 2, 3}
    assert current_snapshot(spark, root, 99) is None


def test_a_lost_writer_leaves_no_version(spark, tmp_path):
    root = str(tmp_path / "lost")
    publish_snapshot(days(spark), root)
    (tmp_path / "lost" / "versions" / f"{1:012d}.json").touch()  # created, never filled
    assert current_snapshot(spark, root).count() == 4 and history(spark, root).count() == 1
    publish_snapshot(days(spark, 7), root)
    assert [r.version for r in history(spark, root).collect()] == [2, 0] and current_snapshot(spark, root).count() == 7
    assert put_if_absent(spark, f"{root}/once", "a") and not put_if_absent(spark, f"{root}/once", "b")
    assert (tmp_path / "lost" / "once").read_text() == "a"


def test_other_file_systems_create_without_overwriting(spark, tmp_path, monkeypatch):
    """The path that HDFS and object stores take, tried on Hadoop's own view of a local folder."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trial.link./t", f"file://{tmp_path}")
    where = "viewfs://trial/t/one"
    assert put_if_absent(spark, where, "zwölf") and not put_if_absent(spark, where, "b")
    assert (tmp_path / "one").read_text(encoding="utf-8") == "zwölf"


def stamps(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_the_dates_at_hand_are_replaced(spark, tmp_path, rows):
    path = tmp_path / "dated"
    replace_dates(days(spark, 10), str(path))
    before = stamps(path)
    one = days(spark, 3).filter("travel_date = DATE '2025-01-02'").withColumn("v", F.lit(77))
    for _ in range(2):  # a rerun changes nothing more
        replace_dates(one, str(path))
        assert rows(tables.read_path(spark, str(path), ["v"])) == [(0,), (2,), (4,), (6,), (77,), (8,)]
    after = stamps(path)
    assert {f for f in before if "2025-01-01" in f} == {f for f in after if "2025-01-01" in f}
    assert all(after[f] == t for f, t in before.items() if "2025-01-01" in f)
    replace_dates(days(spark, 0), str(path))
    assert tables.read_path(spark, str(path)).count() == 6


def test_only_the_dates_at_hand_are_replaced_in_a_table(spark, rows):
    replace_table_dates(days(spark, 10), "dated_table")
    one = days(spark, 3).filter("travel_date = DATE '2025-01-02'").select("travel_date", F.lit(77).alias("v"))
    for _ in range(2):
        replace_table_dates(one, "dated_table")
        assert rows(spark.table("dated_table"), "v") == [(0,), (2,), (4,), (6,), (77,), (8,)]
    with pytest.raises(ValueError):
        replace_table_dates(one.drop("v"), "dated_table")


def test_broken_documents_become_reject_rows(spark, tmp_path, rows):
    good = '{"Number":"1","Name":"T","data":[["Date","A",{"label":"B"}],["2025,1,1","5","6"]]}'
    bad = ['{"Number":"2","Name":', "[1,2]", '{"Number":"x","Name":"T","data":[["Date","A"],["2025,1,1","5"]]}', '{"Number":"3","data":[["Date"]]}', '{"Number":"4","data":"none"}']
    (tmp_path / "a.json").write_text("\n".join([good, *bad[:2]]) + "\n\n")
    (tmp_path / "b.json").write_text("\n".join(bad[2:]))
    documents, rejects = split_records(read_document_records(spark, str(tmp_path)))
    assert rows(unpivot_documents(documents), "train_number", "station", "delay_min") == [(1, "A", 5), (1, "B", 6)]
    got = rows(rejects, "file_name", "reason")
    assert got == [("a.json", "document"), ("a.json", "document"), ("b.json", "document"), ("b.json", "no data"), ("b.json", "train number")]
    assert bad[0] in {r.record for r in rejects.collect()}


def test_partitioned_write_rebalances(spark, tmp_path):
    path = tmp_path / "balanced"
    publish_path(days(spark, 1000).repartition(8), str(path), partition_by="travel_date")
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in path.glob("travel_date=*"))


def test_requests_from_rows(spark, rows):
    made = tables.requests_from_rows(spark, [(12673, dt.date(2026, 4, 2))], schemas.DELAY_REQUESTS)
    assert rows(made) == [(12673, dt.date(2026, 4, 2))]
    frame = pd.DataFrame({"train_number": [7], "travel_date": [dt.date(2026, 4, 2)]})
    assert rows(tables.requests_from_rows(spark, frame, schemas.DELAY_REQUESTS), "train_number") == [(7,)]
    from_dicts = tables.requests_from_rows(spark, [{"train_number": 1, "travel_date": dt.date(2026, 4, 2)}], schemas.DELAY_REQUESTS)
    assert rows(from_dicts, "train_number") == [(1,)]


CARD = """<div class="w3-card-2 w3-x">
  <div style="flex:1; float:left"><b> MAS &amp; CO </b></div>
  <div style="float:left;width:100px"><i>x</i><span class="w3-round w3-red"> 13 Min </span></div></div>"""
NO_DELAY = '<div class="w3-card-2"><div style="float:left;flex:1"><b>AJJ</b></div><div style="width:100px;float:left"></div></div>'
DIVIDER = '<div class="w3-card-2"><hr></div>'
OTHER = '<div class="w3-card-20"><div style="flex:1;float:left"><b>no</b></div></div>'


def test_page_cards(spark, rows):
    pages = spark.createDataFrame([("t1", "<body>" + CARD + DIVIDER + NO_DELAY), ("t2", "<body></body>"), ("t3", CARD)], "train STRING, html STRING")
    assert rows(page_cards(pages, "train")) == [
        ("t1", 1, "MAS & CO", "13 Min"),
        ("t1", 2, "N/A", "N/A"),
        ("t1", 3, "AJJ", "On Time / 0 Min"),
        ("t3", 1, "MAS & CO", "13 Min"),
    ]
    other = spark.createDataFrame([("t", OTHER)], "train STRING, html STRING")
    assert page_cards(other, "train").count() == 0
