"""Text tables by file: a data source that reads each file's lines in order, one task a file.

Thinning goes by line number and reading ends at the first line after the range, so what a table
gives depends on the order of its lines, as it must; nothing is sorted. Files of years outside
the range are never opened. A file is one table, or many small ones, each under a line that names
it; a large table is a folder of parts, which are read at once.
"""

from __future__ import annotations

import datetime
import itertools
import json
import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from packetloom.sources.tables import parse_table

#: Lines handed on at once, and bytes read at once.
LINES = 8192
CHUNK = 1 << 22
#: Tasks of a read, at most; more files are dealt among them.
MOST_TASKS = 4096
#: What the line over each of several tables in one file begins with.
HEADING = "# "
#: How file systems that Hadoop names are called by what opens the files in the tasks.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
_YEAR = re.compile(r"(?:^|[/=_])(\d{4})(?=[/_.]|$)")
_DOY = re.compile(r"(\d{4})-(\d{3})(?:T(\d{2}):(\d{2}):(\d{2})(\.\d+)?)?$")


def read_time(text: str) -> datetime.datetime | None:
    """A calendar or day-of-year time as UTC without a zone; None if it is neither."""
    if text[7:8] != "-" and (m := _DOY.match(text)):
        try:
            day = datetime.datetime(int(m[1]), 1, 1) + datetime.timedelta(days=int(m[2]) - 1)
        except (ValueError, OverflowError):
            return None
        return day + datetime.timedelta(hours=int(m[3] or 0), minutes=int(m[4] or 0), seconds=int(m[5] or 0) + float(m[6] or 0)) if int(m[2]) else None
    try:
        t = datetime.datetime.fromisoformat(text)
    except ValueError:
        return None
    return t.astimezone(datetime.UTC).replace(tzinfo=None) if t.tzinfo else t


def opened_uri(path: str) -> str:
    """The path in the form that tasks open it by; ValueError for a file system they can't reach."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme not in SCHEMES:
        raise ValueError(f"can't read {path!r} by file: give a path of one of {', '.join(sorted(SCHEMES))}")
    return f"{SCHEMES[scheme]}:///{rest.lstrip('/')}" if not rest.startswith("//") else f"{SCHEMES[scheme]}:{rest}"


def _time(line: str) -> datetime.datetime | None:
    words = line.split(None, 1)
    return read_time(words[0]) if words else None


def stride(head: list[str], resolution_s: float | None) -> int:
    """How often the step between the first two lines of a table goes into the resolution, 1 at least."""
    if resolution_s is not None and len(head) == 2 and (a := _time(head[0])) is not None and (b := _time(head[1])) is not None and (b - a).total_seconds() > 0:
        return max(1, int(resolution_s // (b - a).total_seconds()))
    return 1


def chosen_lines(lines: Iterator[str], first: datetime.datetime | None, last: datetime.datetime | None, resolution_s: float | None, start: int = 0, head: list[str] | None = None) -> Iterator[tuple[int, str]]:
    """(number, line) of the lines that a table gives, or a part of it that begins with line ``start`` of the table.

    Every k-th line by its number from 0, k being how often the step between the first two lines
    (``head``, if the part hasn't them) goes into the resolution; then those from ``first`` on, up
    to the first later than ``last``. Within a range, lines without a readable time are passed over.
    """
    held: list[str] = []
    if resolution_s is not None and head is None:
        held = head = list(itertools.islice(lines, 2))
    step = stride(head or [], resolution_s)
    for n, line in enumerate(itertools.chain(held, lines), start):
        if n % step:
            continue
        if first is not None or last is not None:
            t = _time(line)
            if t is None or (first is not None and t < first):
                continue
            if last is not None and t > last:
                return
        yield n, line


def headed(lines: Iterator[str]) -> Iterator[tuple[str | None, Iterator[str]]]:
    """(name, lines) of the tables in a file, one after another; lines over the first heading have no name."""
    count, name = 0, None

    def of(line: str) -> tuple[int, str | None]:
        nonlocal count, name
        if line.startswith(HEADING):
            count, name = count + 1, line[len(HEADING) :].strip()
        return count, name

    for (k, n), rows in itertools.groupby(lines, of):  # what a table's reader leaves is passed over
        yield n, itertools.islice(rows, 1, None) if k else rows


class _Files(InputPartition):
    """Files as (uri, year, number of the first line, uris of the table's parts if it has several)."""

    def __init__(self, files: list[tuple[str, int | None, int, list[str]]]):
        super().__init__(files)
        self.files = files


def file_lines(uri: str, chunk: int = CHUNK) -> Iterator[str]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    rest = b""
    with system.open_input_stream(path, buffer_size=chunk) as f:
        while data := f.read(chunk):
            whole, end, rest = (rest + data).rpartition(b"\n")
            if end:
                yield from whole.decode("utf-8", "replace").split("\n")
    if rest:
        yield rest.decode("utf-8", "replace")


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        at = lambda k: datetime.datetime.fromisoformat(options[k]) if options.get(k) else None
        self.files = json.loads(options["files"])
        self.first, self.last = at("first"), at("last")
        self.resolution_s = float(options["resolution"]) if options.get("resolution") else None
        self.headed = options.get("headed") == "true"

    def partitions(self) -> list[InputPartition]:
        files = [tuple(f) if len(f) == 4 else (f[0], f[1], 0, []) for f in self.files]
        n = min(len(files), MOST_TASKS)
        return [_Files(files[k * len(files) // n : (k + 1) * len(files) // n]) for k in range(n)]

    def rows(self, uri: str, start: int, parts: list[str]) -> Iterator[tuple[str | None, int, str]]:
        """(table, number, line) that a file gives."""
        if self.headed:
            for name, lines in headed(file_lines(uri)):
                for n, line in chosen_lines(lines, self.first, self.last, self.resolution_s):
                    yield name, n, line
            return
        head = list(itertools.islice(itertools.chain.from_iterable(file_lines(p, 1 << 12) for p in parts), 2)) if parts and self.resolution_s is not None else None
        for n, line in chosen_lines(file_lines(uri), self.first, self.last, self.resolution_s, start, head):
            yield None, n, line

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for uri, year, start, parts in partition.files:
            found = self.rows(uri, start, parts)
            while rows := list(itertools.islice(found, LINES)):
                n = len(rows)
                tables, numbers, lines = zip(*rows, strict=True)
                table = pa.array(tables, pa.string()) if self.headed else pa.nulls(n, pa.string())
                columns = [pa.repeat(pa.scalar(uri, pa.string()), n), pa.repeat(pa.scalar(year, pa.int32()), n), pa.array(numbers, pa.int64()), pa.array(lines, pa.string()), table]
                yield pa.record_batch(columns, names=["file", "year", "line", "value", "table"])


class SeriesSource(DataSource):
    """Lines of text files: (file, year, line, value, table).

    Options: files (JSON of [uri, year], or [uri, year, first line's number, uris of the table's parts]), first, last, resolution, headed.
    """

    @classmethod
    def name(cls) -> str:
        return "packetloom_series"

    def schema(self) -> str:
        return "file string, year int, line bigint, value string, table string"

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(dict(self.options))


def listed(spark: SparkSession, path: str, years: tuple[int, int] | None = None) -> list[tuple[str, int | None]]:
    """(uri, year) of :func:`listed_paths`."""
    return [f[:2] for f in listed_paths(spark, path, years)]


def listed_paths(spark: SparkSession, path: str, years: tuple[int, int] | None = None) -> list[tuple[str, int | None, str]]:
    """(uri, year, path as Hadoop names it) of the files under a path or glob, in order; the year is the four digits in the last part of the path that has any.

    With ``years`` only files within them; a file without a year is always listed.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for found in system.globStatus(p) or []:
        walk = system.listFiles(found.getPath(), True)
        while walk.hasNext():
            at = walk.next().getPath()
            name = at.toString()
            if at.getName().startswith(("_", ".")):
                continue
            digits = [m for part in reversed(name.split("/")) if (m := _YEAR.search(f"/{part}"))]
            year = int(digits[0][1]) if digits else None
            if years is None or year is None or years[0] <= year <= years[1]:
                out.append((opened_uri(name), year, name))
    return sorted(out)


def part_starts(spark: SparkSession, files: list[tuple[str, int | None]], paths: list[str]) -> list[list]:
    """[uri, year, number of the first line, parts] of files whose folders are tables; the lines of parts that others follow are counted."""
    folders = [list(g) for _, g in itertools.groupby(zip(files, paths, strict=True), lambda f: f[1].rsplit("/", 1)[0])]
    before = [path for g in folders for _, path in g[:-1]]
    n = {}
    if before:  # a row per part
        counted = spark.read.option("lineSep", "\n").text(before).groupBy(F.col("_metadata.file_path").alias("at")).agg(F.count(F.lit(1)).alias("n"))
        n = {opened_uri(urllib.parse.unquote(r.at)): r.n for r in counted.collect()}
    out = []
    for g in folders:
        start, head, rows = 0, [], []
        for (uri, year), _ in g:
            if start < 2:
                head.append(uri)  # parts that hold the table's first two lines
            rows.append([uri, year, start, head if len(g) > 1 else []])
            start += n.get(uri, 0)
        out += rows
    return out


def read_series(spark: SparkSession, path: str, coords: str, date_from: str | None = None, date_to: str | None = None, margin_s: float = 0, resolution_s: float | None = None, layout: str = "file") -> DataFrame:
    """Typed rows of the files under ``path`` with file, year, line and table, in the range widened by a margin at both ends; no rows where there are no files.

    ``layout`` tells what a table is: a ``file``; what follows a line of ``# `` and the table's name
    in a file (``headed``), where ``table`` is the name; or a ``folder`` of parts, in order of their
    names, of which none has a time before those of the part before it. Lines are numbered, thinned
    and cut off by table.
    """
    if layout not in ("file", "headed", "folder"):
        raise ValueError(f"unknown layout {layout!r}")
    margin = datetime.timedelta(seconds=margin_s)
    first = datetime.datetime.fromisoformat(date_from) - margin if date_from else None
    last = datetime.datetime.fromisoformat(date_to) + margin if date_to else None
    years = (first.year if first else 0, last.year if last else 9999) if first or last else None
    spark.dataSource.register(SeriesSource)
    keep = ["file", "year", "line", "table"]
    found = listed_paths(spark, path, years)
    files = [f[:2] for f in found]
    if not files:
        return parse_table(spark.createDataFrame([], SeriesSource({}).schema()), coords, keep=keep)
    options = {"files": json.dumps(part_starts(spark, files, [f[2] for f in found]) if layout == "folder" else files), "headed": "true" if layout == "headed" else "false"}
    options |= {k: str(v) for k, v in (("first", first), ("last", last), ("resolution", resolution_s)) if v is not None}
    return parse_table(spark.read.format("packetloom_series").options(**options).load(), coords, keep=keep)
