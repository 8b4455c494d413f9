"""Catalogs through CSV files, and what is wrong with them."""

import pytest

from quakeframe.schema import Catalog
from quakeframe.sources import csv_catalog as io

STATIONS = "latitude,longitude,elevation,networkCode,stationCode,locationCode\n46.1,8.2,1200,CH,AAA,\n46.2,8.3,300,CH,BBB,00\n46.15,8.2,1201,CH,AAA,\n"
EVENTS = "id,isotime,latitude,longitude,depth,magnitude,other\n7,2020-01-01T00:00:01.5Z,46.5,8.1,3.25,1.2,x\n9,2020-01-01T00:10:00.1234567Z,46.6,8.15,4.0,,y\n"
PHASES = "eventId,isotime,lowerUncertainty,upperUncertainty,type,networkCode,stationCode,locationCode,channelCode\n7,2020-01-01T00:00:05.25Z,0.1,0.2,Pg,CH,AAA,,HHZ\n77,2020-01-01T00:00:05.5Z,,,Sg,CH,BBB,00,HHN\n"


def files(tmp_path, phases=PHASES, events=EVENTS):
    out = []
    for name, text in (("station", STATIONS), ("event", events), ("phase", phases)):
        p = tmp_path / f"{name}.csv"
        p.write_text(text)
        out.append(str(p))
    return out


def test_read(spark, tmp_path):
    c = io.read_catalog(spark, *files(tmp_path))
    st = {r.id: r for r in c.stations.collect()}
    assert set(st) == {"CH.AAA.", "CH.BBB.00"} and st["CH.AAA."].elevation == 1201  # the last row counts
    ev = {r.id: r for r in c.events.collect()}
    assert ev[7].t_us == 1577836801500000 and ev[9].t_us == 1577837400123456 and ev[9].magnitude is None
    ph = {r.event_id: r for r in c.phases.collect()}
    assert set(ph) == {7, 77} and ph[77].lower_unc is None and ph[7].station_id == "CH.AAA."


def test_round_trip(spark, tmp_path):
    c = io.read_catalog(spark, *files(tmp_path))
    to = [str(tmp_path / n) for n in ("s", "e", "p")]
    io.write_catalog(c, *to)
    again = io.read_catalog(spark, *to)
    for name in ("stations", "events", "phases"):
        a, b = getattr(c, name), getattr(again, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_bad_values_are_named(spark, tmp_path):
    with pytest.raises(Exception, match="latitude: north"):
        io.read_catalog(spark, *files(tmp_path, events=EVENTS.replace("46.5", "north"))).events.collect()
    with pytest.raises(Exception, match=r"no station CH\.CCC\."):
        io.read_catalog(spark, *files(tmp_path, phases=PHASES.replace("AAA", "CCC"))).phases.collect()


def test_pairs_and_xcorr(spark, tmp_path):
    p = tmp_path / "xcorr.csv"
    p.write_text("eventId1,eventId2,networkCode,stationCode,locationCode,phaseType,valid,coefficient,lag\n1,2,CH,AAA,,P,true,0.5,0.1\n2,1,CH,AAA,,P,1,0.7,0.2\n1,3,CH,AAA,,P,false,,\n")
    got = {(r.ev1, r.ev2): (r.valid, r.coefficient, r.lag) for r in io.read_xcorr(spark, str(p)).collect()}
    assert got == {(1, 2): (True, 0.7, -0.2), (1, 3): (False, None, None)}
    edges, nodes = io.read_pairs(spark, str(p))
    assert edges.count() == 3 and sorted(r.id for r in nodes.collect()) == [1, 2, 3]


def test_origins(spark):
    origins = spark.createDataFrame([("o1", 10, 46.0, 8.0, 5.0, 1.0), ("o2", 20, 46.0, 8.0, 5.0, None)], "public_id string, t_us long, latitude double, longitude double, depth double, magnitude double")
    arrivals = spark.createDataFrame([("o1", "p1", "P", 1.0, True), ("o1", "p2", "S", 0.0, True), ("o1", "p9", "P", 1.0, True)], "origin_id string, pick_id string, phase string, weight double, time_used boolean")
    picks = spark.createDataFrame([("p1", 100, "automatic", "CH", "AAA", "", "HHZ", 0.1, 0.1), ("p2", 100, "automatic", "CH", "AAA", "", "HHZ", 0.1, 0.1)], "public_id string, t_us long, mode string, network string, station string, location string, channel string, lower_unc double, upper_unc double")
    sensors = spark.createDataFrame([("CH", "AAA", "", 0, None, 46.1, 8.1, 100.0)], "network string, station string, location string, start_us long, end_us long, latitude double, longitude double, elevation double")
    c = io.origins_to_catalog(origins, arrivals, picks, sensors)
    assert isinstance(c, Catalog)
    assert [r.id for r in c.events.collect()] == [1]
    assert [(r.event_id, r.station_id, r.type) for r in c.phases.collect()] == [(1, "CH.AAA.", "P")]
    assert [r.id for r in c.stations.collect()] == ["CH.AAA."]


def test_written_pairs_lags_and_clusters(spark, tmp_path):
    c = io.read_catalog(spark, *files(tmp_path))
    cache = spark.createDataFrame([(7, 77, "CH.AAA.", "P", True, 0.5, -0.125), (7, 9, "CH.BBB.00", "S", False, None, None)], "ev1 long, ev2 long, station_id string, type string, valid boolean, coefficient double, lag double")
    io.write_xcorr(cache, c.stations, str(tmp_path / "lags"))
    again = io.read_xcorr(spark, str(tmp_path / "lags"))
    assert sorted(map(str, again.select(cache.columns).collect())) == sorted(map(str, cache.collect()))
    edges = spark.createDataFrame([(7, 77, "Pg", "CH.AAA.", 1), (9, 7, "Sg", "CH.BBB.00", 1)], "ref_id long, neigh_id long, type string, station_id string, cluster_id long")
    io.write_pairs(edges, c.stations, str(tmp_path / "pairs"))
    back, nodes = io.read_pairs(spark, str(tmp_path / "pairs"))
    assert sorted(map(str, back.collect())) == sorted(map(str, edges.select(back.columns).collect())) and nodes.count() == 3
    named = spark.createDataFrame([(7, 1), (77, 1), (9, 2)], "id long, cluster_id long")
    io.write_clusters(c, edges, named, str(tmp_path / "clusters"))
    assert (tmp_path / "clusters/pairs/cluster_id=1").is_dir() and (tmp_path / "clusters/events/cluster_id=2").is_dir()
    assert spark.read.option("header", True).csv(str(tmp_path / "clusters/phases")).count() == 2


def test_a_file_without_a_header(spark, tmp_path):
    p = tmp_path / "plain.csv"
    p.write_text('7,"a, b"\n8,c\n')
    assert [tuple(r) for r in io.read_with_header(spark, str(p), ["id", "name"]).collect()] == [("7", "a, b"), ("8", "c")]


def test_the_list_of_origins_and_preferred_magnitudes(spark, tmp_path):
    rows = spark.createDataFrame([("o1", "e1", "", 1_600_000_000_500_000, 7, 46.5), ("o2", "e2", None, 1_600_000_000_000_000, None, -1.0)], "public_id string, event_id string, type string, t_us long, n_phases long, latitude double")
    io.write_origin_list(rows, str(tmp_path / "list"))
    got = {r.origin: r.asDict() for r in io.read_csv(spark, str(tmp_path / "list")).drop("_row").collect()}
    assert list(got["o1"]) == "origin event eventType evalMode evalStat agencyID author methodID RMS numPhases latitude longitude depth time creationTime modificationTime".split()
    assert (got["o1"]["time"], got["o1"]["numPhases"], got["o2"]["time"], got["o2"]["numPhases"], got["o2"]["creationTime"]) == ("2020-09-13T12:26:40.5Z", "7", "2020-09-13T12:26:40.0000Z", "", "")
    io.write_origin_list(rows, str(tmp_path / "ids"), simple=True)
    assert sorted(r[0] for r in spark.read.csv(str(tmp_path / "ids")).collect()) == ["o1", "o2"]
    origins = spark.createDataFrame([("o1", 0, 46.0, 8.0, 5.0, 1.0), ("o2", 0, 46.0, 8.0, 5.0, 2.0), ("o3", 0, 46.0, 8.0, 5.0, 3.0)], "public_id string, t_us long, latitude double, longitude double, depth double, magnitude double")
    arrivals = spark.createDataFrame([(o, "p1", "P", 1.0, True) for o in ("o1", "o2", "o3")], "origin_id string, pick_id string, phase string, weight double, time_used boolean")
    picks = spark.createDataFrame([("p1", 100, "manual", "CH", "AAA", "", "HHZ", 0.1, 0.1)], "public_id string, t_us long, mode string, network string, station string, location string, channel string, lower_unc double, upper_unc double")
    sensors = spark.createDataFrame([("CH", "AAA", "", 0, None, 46.1, 8.1, 100.0)], "network string, station string, location string, start_us long, end_us long, latitude double, longitude double, elevation double")
    references = spark.createDataFrame([("e1", "o1", 1), ("e2", "o1", 2), ("e3", "o2", 3)], "event_id string, origin_id string, seq long")
    events = spark.createDataFrame([("e1", 4.5), ("e2", 9.9), ("e3", None)], "event_id string, preferred_magnitude double")
    c = io.origins_to_catalog(origins, arrivals, picks, sensors, references, events)
    assert [(r.id, r.magnitude) for r in c.events.orderBy("id").collect()] == [(1, 4.5), (2, 2.0), (3, 3.0)]
