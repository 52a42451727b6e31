"""The catalogue's files: columns, versions, generations, and writers that die."""

import datetime

import pytest
from pyspark.sql import functions as F

from packetloom.session import scratch
from packetloom.sources import event_catalogue as ec

T0 = datetime.datetime(2005, 1, 1)


def events(spark, n=3, version=ec.VERSION, start=0):
    kinds = {f.name: f.dataType for f in ec._fields(ec.ADDED, version)}
    return spark.range(start, start + n).select(*[(F.lit(T0) if t.simpleString() == "timestamp" else F.lit("QP60") if n == "band" else F.col("id")).cast(t).alias(n) for n, t in kinds.items()])


def peers(df, lists):
    return df.withColumns({n: F.from_json(F.lit(x), "array<double>") for n, x in zip(ec.PEERS, lists, strict=True)})


def test_round_trip_with_sidecar(spark):
    path, df = scratch(spark, "cat"), events(spark)
    assert len(ec.required()) == 22 and len(ec.required("1")) == 15
    assert ec.write_catalogue(df.select(*reversed(df.columns)), path, source="test") == 3
    rows, about = ec.read_catalogue(spark, path)
    assert rows.columns == df.columns and sorted(rows.collect()) == sorted(df.collect())
    assert about == {"n_rows": 3, "columns": df.columns, "versions": ["3"], "attrs": {"source": "test"}}


def test_missing_and_taken_columns(spark):
    df, path = events(spark), scratch(spark, "cat")
    with pytest.raises(ValueError, match="q_factor"):
        ec.write_catalogue(df.drop("q_factor"), path)
    with pytest.raises(ValueError, match="band"):
        ec.record(df, {"band": F.lit(1)})
    with pytest.raises(ValueError, match="version"):
        ec.write_catalogue(df, path, "9")
    with pytest.raises(ValueError, match="peers"):
        ec.write_catalogue(df.withColumn("peer_event_ids", F.array()), path)
    with pytest.raises(ValueError, match="no catalogue"):
        ec.read_catalogue(spark, path)


def test_versions_read_as_one_table(spark):
    path = scratch(spark, "cat")
    ec.write_catalogue(events(spark, 2, "1").withColumn("note", F.lit("x")), path, "1")
    ec.write_catalogue(events(spark, 2, "2", 10), path, "2")
    ec.write_catalogue(peers(events(spark, 2, "3", 20), ("[1,2]", "[3,4]", "[0.5,0.6]")).withColumn("region", F.lit("solar_wind")), path)
    rows, about = ec.read_catalogue(spark, path)
    got = {r.event_id: r for r in rows.collect()}
    assert about["versions"] == ["1", "2", "3"] and about["n_rows"] == len(got) == 6
    assert got[0].stokes_i is None and got[10].stokes_i == 10.0 and got[0].note == "x" and got[20].note is None
    assert got[10].peer_event_ids is None and got[20].peer_event_ids == [1, 2] and got[20].region == "solar_wind" and got[0].region is None
    assert rows.columns[-1] == "note" and rows.schema["peer_event_ids"].dataType.simpleString() == "array<bigint>"


def test_peers_are_lists_of_one_length(spark):
    path = scratch(spark, "cat")
    ec.write_catalogue(peers(events(spark, 1), ("null", "null", "null")), path)
    assert ec.read_catalogue(spark, path)[0].first().peer_event_ids == []
    with pytest.raises(Exception, match="differ in number"):
        ec.write_catalogue(peers(events(spark, 1), ("[1]", "[1,2]", "[1]")), path)
    assert ec.read_catalogue(spark, path)[1]["n_rows"] == 1


def test_types_must_agree(spark):
    path = scratch(spark, "cat")
    ec.write_catalogue(events(spark).withColumn("extra", F.lit(1)), path)
    ec.write_catalogue(events(spark).withColumn("extra", F.lit("a")), path)
    with pytest.raises(ValueError, match="extra"):
        ec.read_catalogue(spark, path)


@pytest.mark.parametrize("replace", [False, True])
@pytest.mark.parametrize("step", ["_put", "_rename"])
def test_a_writer_that_dies_leaves_the_old_table(spark, monkeypatch, replace, step):
    path = scratch(spark, "cat")
    ec.write_catalogue(events(spark), path)

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ec, step, die)
        with pytest.raises(OSError, match="lost"):
            ec.write_catalogue(events(spark, 5, start=50), path, replace=replace)
    rows, about = ec.read_catalogue(spark, path)
    assert rows.count() == about["n_rows"] == 3
    ec.write_catalogue(events(spark, 5, start=50), path, replace=replace)
    assert ec.read_catalogue(spark, path)[0].count() == (5 if replace else 8)


def test_of_two_that_replace_at_once_one_is_refused(spark, monkeypatch):
    path = scratch(spark, "cat")
    ec.write_catalogue(events(spark), path)
    old = ec.generation(spark, path)
    ec.write_catalogue(events(spark, 4), path, replace=True)
    monkeypatch.setattr(ec, "generation", lambda *_: old)
    with pytest.raises(Exception, match="exist|Exist"):
        ec.write_catalogue(events(spark, 5), path, replace=True)
    monkeypatch.undo()
    assert ec.read_catalogue(spark, path)[1]["n_rows"] == 4


def test_empty_catalogue_keeps_its_columns(spark):
    path = scratch(spark, "cat")
    assert ec.write_catalogue(events(spark).limit(0), path) == 0
    rows, about = ec.read_catalogue(spark, path)
    assert rows.count() == 0 and rows.columns == ec.required() and about["n_rows"] == 0
