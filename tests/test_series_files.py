"""The text-file source against a plain reading of each file."""

import datetime
import os

import pytest

from packetloom.sources import series_files as sf

T0 = datetime.datetime(2005, 1, 1)


def plain(path, first=None, last=None, resolution=None):
    """Read a file as a loop over its lines does: stride by line, stop after the range."""
    lines = path.read_text().splitlines()
    stride = 1
    if resolution is not None and len(lines) > 1:
        step = (datetime.datetime.fromisoformat(lines[1].split()[0]) - datetime.datetime.fromisoformat(lines[0].split()[0])).total_seconds()
        stride = max(1, int(resolution // step)) if step > 0 else 1
    out = []
    for n, line in enumerate(lines):
        if n % stride:
            continue
        t = datetime.datetime.fromisoformat(line.split()[0])
        if first and t < first:
            continue
        if last and t > last:
            break
        out.append((path.name, n, t))
    return out


def write(path, minutes, year=2005):
    base = datetime.datetime(year, 1, 1)
    path.write_text("".join(f" {(base + datetime.timedelta(minutes=m)).isoformat()}  {m} 2 3 4 5 6 7\n" for m in minutes))


@pytest.fixture
def files(tmp_path):
    write(tmp_path / "2004_A.TAB", range(40), 2004)
    write(tmp_path / "2005_A.TAB", [0, 1, 5, 3, 3, 9, 2, 30, 4, 6, 6, 7])  # unsorted, with repeated times
    write(tmp_path / "2006_A.TAB", [0, 0, 1, 2], 2006)  # no positive step
    return tmp_path


def got(df):
    return sorted((os.path.basename(r.file), r.line, r.ts) for r in df.select("file", "line", "ts").collect())


@pytest.mark.parametrize("resolution", [None, 60.0, 120.0, 200.0, 1e9])
@pytest.mark.parametrize("span", [None, (2, 8), (0, 30), (31, 40)])
def test_lines_in_file_order(spark, files, resolution, span):
    first, last = (T0 + datetime.timedelta(minutes=m) for m in span) if span else (None, None)
    df = sf.read_series(spark, str(files), "KSM", first and first.isoformat(), last and last.isoformat(), resolution_s=resolution)
    names = ["2005_A.TAB"] if span else ["2004_A.TAB", "2005_A.TAB", "2006_A.TAB"]
    assert got(df) == sorted(x for n in names for x in plain(files / n, first, last, resolution))


def test_files_outside_the_range_are_not_opened(spark, files):
    (files / "2007_A.TAB").mkdir()
    bad = files / "2003_A.TAB"
    bad.write_bytes(b"\xff\xfe not a table\n")
    bad.chmod(0)
    df = sf.read_series(spark, str(files), "KSM", "2005-12-31T23:00:00", "2006-01-01T00:01:00", margin_s=60)
    assert df.rdd.getNumPartitions() == 2  # one task for each of the two years
    assert [x[:2] for x in got(df)] == [("2006_A.TAB", 0), ("2006_A.TAB", 1), ("2006_A.TAB", 2), ("2006_A.TAB", 3)]


def test_reading_ends_after_the_range():
    seen = []

    def lines():
        for m in range(1000):
            seen.append(m)
            yield f"{(T0 + datetime.timedelta(minutes=m)).isoformat()} x"

    assert len(list(sf.chosen_lines(lines(), T0, T0 + datetime.timedelta(minutes=9), None))) == 10
    assert len(seen) == 11


def test_odd_lines_and_missing_files(spark, tmp_path):
    assert sf.read_series(spark, str(tmp_path / "none"), "KSM").count() == 0
    (tmp_path / "a.txt").write_text("header\n\n2005-002T00:00:30 1 2\n2005-01-02T00:01:00 1 2 3 4 5 6 7")
    assert [(r.line, r.bx, r.z) for r in sf.read_series(spark, str(tmp_path / "a.txt"), "KSM", "2005-01-02", "2005-01-03").orderBy("line").collect()] == [(2, 1.0, None), (3, 1.0, 7.0)]
    assert sf.read_series(spark, str(tmp_path), "KSM", resolution_s=60.0).count() == 4
    with pytest.raises(ValueError):
        sf.opened_uri("dbfs:/x")
    assert sf.opened_uri("s3a://b/k") == "s3://b/k" and sf.opened_uri("file:/a/b") == "file:///a/b"
    assert sf.read_time("2005-000T00:00:00") is None and sf.read_time("2005-032T01:02:03.5") == datetime.datetime(2005, 2, 1, 1, 2, 3, 500000) and sf.read_time("2005-01-01T01:00:00+01:00") == T0


@pytest.mark.parametrize("resolution", [None, 120.0, 200.0])
@pytest.mark.parametrize("span", [None, (3, 20)])
def test_parts_of_a_folder_are_one_table(spark, tmp_path, resolution, span):
    """Lines are numbered, thinned and cut off through the parts as in one file, whatever the first part holds."""
    (tmp_path / "whole").mkdir()
    write(tmp_path / "whole" / "2005_A.TAB", range(40))
    lines = (tmp_path / "whole" / "2005_A.TAB").read_text().splitlines(keepends=True)
    for y in ("year=2005", "year=2006"):
        (tmp_path / "parts" / y).mkdir(parents=True)
        for k, (a, b) in enumerate([(0, 1), (1, 1), (1, 14), (14, 29), (29, 40)]):
            (tmp_path / "parts" / y / f"part-{k}.txt").write_text("".join(lines[a:b]))
    first, last = (T0 + datetime.timedelta(minutes=m) for m in span) if span else (None, None)
    df = sf.read_series(spark, str(tmp_path / "parts"), "KSM", first and first.isoformat(), last and last.isoformat(), resolution_s=resolution, layout="folder")
    want = sorted(x[1:] for x in plain(tmp_path / "whole" / "2005_A.TAB", first, last, resolution))
    years = ["year=2005"] if span else ["year=2005", "year=2006"]
    for y in years:
        assert sorted((r.line, r.ts) for r in df.filter(df.file.contains(y)).select("line", "ts").collect()) == want
    assert df.rdd.getNumPartitions() == 5 * len(years)


def test_tables_under_headings_in_one_file(spark, tmp_path):
    """Each table goes by its own step and ends by itself; a file may hold any number of them."""
    of = lambda minutes: "".join(f"{(T0 + datetime.timedelta(minutes=m)).isoformat()} {m} 2 3 4 5 6 7\n" for m in minutes)
    (tmp_path / "a.txt").write_text("# 17\n" + of(range(10)) + "# 18\n# 19\n" + of([0, 5, 10, 15]) + "# 19\n" + of([3]))
    (tmp_path / "b.txt").write_text(of([1, 2]))
    got = lambda **k: sorted(((r.table or ""), r.line, r.bx) for r in sf.read_series(spark, str(tmp_path), "KSM", layout="headed", **k).collect())
    assert got(resolution_s=240.0) == [("", 0, 1.0), ("17", 0, 0.0), ("17", 4, 4.0), ("17", 8, 8.0), ("19", 0, 0.0), ("19", 0, 3.0), ("19", 1, 5.0), ("19", 2, 10.0), ("19", 3, 15.0)]
    assert got(date_from="2005-01-01T00:03:00", date_to="2005-01-01T00:05:00") == [("17", 3, 3.0), ("17", 4, 4.0), ("17", 5, 5.0), ("19", 0, 3.0), ("19", 1, 5.0)]


def test_files_follow_the_rows_and_not_the_segments(spark, tmp_path):
    from packetloom.sources import tables

    rows = spark.range(4000).selectExpr("id AS event_id", "id % 1000 AS user_id", "cast(-id AS double) AS t")
    tables.write_segments(rows, str(tmp_path / "s"), "user_id", ["t", "event_id"])
    back = spark.read.parquet(str(tmp_path / "s"))
    assert len(back.inputFiles()) <= 4 and back.count() == 4000
    at = back.selectExpr("user_id", "t", "_metadata.file_path AS f").collect()
    assert len({(r.user_id, r.f) for r in at}) == 1000
    for f in {r.f for r in at}:
        own = [(r.user_id, r.t) for r in at if r.f == f]
        assert own == sorted(own)


def lines_of_files(path):
    return [len(f.read_text().splitlines()) for f in path.rglob("part-*") if f.suffix == ".txt"]


def same_as_sql(spark, name, folder):
    import duckdb

    from packetloom.plans import catalogue

    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    res = c.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in res.description]
    plain = lambda rows: sorted([tuple(None if v is None else float(v) for v in r) for r in rows], key=str)
    want = plain(res.fetchall())
    assert want and plain(catalogue.queries()[name](spark, str(folder)).select(*names).collect()) == want


def test_headed_files_follow_the_rows_and_nulls_stay_null(spark, tmp_path, monkeypatch):
    """Values, times and users that are null are so in the text as well; 3000 rows at 100 a file aren't left to four tasks."""
    import duckdb

    from packetloom.plans import q_sources

    duckdb.execute(f"""COPY (SELECT i AS event_id, CASE WHEN i % 50 = 3 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_seconds(i * 977) END AS ts, nullif(i % 60, 7) AS user_id,
        'click' AS event_type, CASE WHEN i % 11 = 0 THEN NULL ELSE i / 7 END AS value, '{{"k": 1}}' AS props FROM range(3000) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    monkeypatch.setattr(q_sources, "LINES_PER_FILE", 100, raising=False)
    monkeypatch.setattr(q_sources, "scratch", lambda s, label: str(tmp_path / "made"))
    same_as_sql(spark, "src_tab_resolution", tmp_path)
    sizes = lines_of_files(tmp_path / "made")
    assert sum(sizes) == 3060 and len(sizes) > 12 and max(sizes) < 600


@pytest.mark.parametrize("name", ["src_select", "src_tab_read"])
def test_parts_follow_the_rows_and_nulls_stay_null(spark, tmp_path, monkeypatch, name):
    """6000 lines at 300 a file are about 20 ranges of time, whatever the session's number of partitions; a null leaves no gap in a line."""
    import duckdb

    from packetloom.plans import q_sources

    duckdb.execute(f"""COPY (SELECT i AS l_orderkey, i % 200 AS l_partkey, CASE WHEN i % 17 = 0 THEN NULL ELSE i % 10 END AS l_suppkey, CAST(1 + i % 7 AS INTEGER) AS l_linenumber,
        CASE WHEN i % 13 = 0 THEN NULL ELSE CAST(i % 50 AS DOUBLE) END AS l_quantity, CAST(i AS DOUBLE) AS l_extendedprice, 0.05 AS l_discount, 0.02 AS l_tax,
        CASE WHEN i % 97 = 5 THEN NULL ELSE TIMESTAMP '1995-11-01' + to_days(CAST(i % 600 AS INTEGER)) END AS l_shipdate FROM range(6000) r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    monkeypatch.setattr(q_sources, "LINES_PER_FILE", 300, raising=False)
    monkeypatch.setattr(q_sources, "scratch", lambda s, label: str(tmp_path / "made"))
    same_as_sql(spark, name, tmp_path)
    sizes = lines_of_files(tmp_path / "made")
    assert sum(sizes) == 6000 and len(sizes) >= 15 and max(sizes) < 900


def test_parts_are_counted_by_their_whole_path(spark, tmp_path):
    """Folders of one name under several roots keep their own numbers of lines."""
    for root, lines in (("a", 5), ("d+e", 3)):
        (tmp_path / root / "year=2005").mkdir(parents=True)
        for k in range(3):
            write(tmp_path / root / "year=2005" / f"part-{k}.txt", range(k * lines, (k + 1) * lines))
    rows = sf.read_series(spark, f"{tmp_path}/*", "KSM", resolution_s=120.0, layout="folder").collect()
    assert sorted((r.line, r.bx) for r in rows if "d+e" in r.file) == [(n, float(n)) for n in range(0, 9, 2)]
    assert sorted((r.line, r.bx) for r in rows if "d+e" not in r.file) == [(n, float(n)) for n in range(0, 15, 2)]
