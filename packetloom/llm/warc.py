"""Deterministic sharded WARC writer and reader.

Records are range-partitioned by page id and sorted. The range bounds are keys picked by a hash
and thinned by payload bytes, so the same table gives the same shards on any cluster. Each task
writes its shards as gzip members, one per record, rolls to a next file by compressed size, and
names files provisionally. A job moves the files that successful tasks report to their names, and
one rename publishes the manifest, or fails if another writer has done so. What failed attempts
leave is never named by a manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._shared import hadoop_path, new_path, qualified, rename, table, written
from packetloom.sources.series_files import opened_uri

REVISIT_BYTES = 1000
SHARD_BYTES = 64 << 20
ROLL_BYTES = 32 << 20
#: Candidate range bounds: so many per shard, in all at least and at most so many.
BOUNDS = 8
LEAST_BOUNDS, MOST_BOUNDS = 4096, 1 << 20
#: Up to so many shards each is a task of its own; beyond, a task writes several in turn.
TASKS = 20_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard bigint, number bigint, records bigint, payload_bytes bigint, file_bytes bigint, path string"
FILES = "shard bigint, number bigint, draft string, records bigint, payload_bytes bigint, file_bytes bigint"


def _uri(url: str) -> str:
    return quote(url, safe="%:/?#[]@!$&'()*+,;=-._~")


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record, uncompressed. A revisit has the response's HTTP headers but no payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        head.append(f"WARC-Refers-To: {_record_id(refers_to, digest)}")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"WARC-Payload-Digest: sha1:{_base32(digest)}")
    head.append(f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}")
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(opened_uri(path))


class _Writer:
    """The open file of one task."""

    def __init__(self, folder: str, roll: int):
        self.folder, self.roll, self.out, self.row, self.done = folder, roll, None, None, []

    def add(self, shard: int, data: bytes, payload: int) -> None:
        if self.out is None or self.row["shard"] != shard or self.row["file_bytes"] >= self.roll:
            number = self.row["number"] + 1 if self.row is not None and self.row["shard"] == shard else 0
            self.close()
            fs, folder = _opened(self.folder)
            fs.create_dir(folder, recursive=True)
            name = f"{shard:08d}-{number:05d}-{uuid.uuid4().hex}"
            self.out = fs.open_output_stream(f"{folder}/{name}", compression=None)
            self.row = {"shard": shard, "number": number, "draft": f"{self.folder}/{name}", "records": 0, "payload_bytes": 0, "file_bytes": 0}
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        for k, v in (("records", 1), ("payload_bytes", payload), ("file_bytes", len(packed))):
            self.row[k] += v

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append(self.row)
            self.out = None

    def taken(self) -> pd.DataFrame:
        rows, self.done = self.done, []
        return pd.DataFrame(rows, columns=["shard", "number", "draft", "records", "payload_bytes", "file_bytes"])


class Bounds:
    """Keys (page id, payload hash) at which the next shard begins; null ids come before all others."""

    def __init__(self, none: np.ndarray, ids: np.ndarray, turns: np.ndarray):
        """``none`` are the payload hashes of keys without an id; all are sorted."""
        self.none, self.ids, self.turns = none, ids, turns

    def __len__(self) -> int:
        return len(self.none) + len(self.ids)

    def thinned(self, at: list[int]) -> Bounds:
        """The bounds at the given places only."""
        n, at = len(self.none), np.array(at, np.int64)
        rest = at[at >= n] - n
        return Bounds(self.none[at[at < n]], self.ids[rest], self.turns[rest])

    def part(self, none: np.ndarray, ids: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """How many bounds are at or below each key; ``none`` marks keys without an id."""
        low, high = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, side="right")
        for k in np.flatnonzero((low < high) & ~none):  # ids that are a bound themselves
            high[k] = low[k] + np.searchsorted(self.turns[low[k] : high[k]], turns[k], side="right")
        return np.where(none, np.searchsorted(self.none, turns, side="right"), len(self.none) + high)


def _bounds(narrow: DataFrame, shard_bytes: int) -> Bounds:
    """Keys at which the next shard begins: picked by hash, then thinned to shards of about the given payload.

    Their number follows the payload; at most ``MOST_BOUNDS`` or so come to the driver.
    """
    size = narrow.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("b")).first()
    wanted = min(MOST_BOUNDS, max(LEAST_BOUNDS, BOUNDS * size.b // shard_bytes))
    picks = narrow.filter(F.pmod(F.xxhash64("page_id", "turn"), F.lit(max(1, size.n // wanted))) == 0)
    picks = picks.select("page_id", "turn").distinct()
    none, known = picks.filter("page_id IS NULL").toPandas(), picks.filter("page_id IS NOT NULL").toPandas().sort_values(["page_id", "turn"])
    cuts = Bounds(np.sort(none["turn"].to_numpy()), known["page_id"].to_numpy(), known["turn"].to_numpy())
    rows = narrow.select(_ranged(cuts, narrow).alias("part"), "payload_bytes").groupBy("part").agg(F.sum("payload_bytes").alias("b"))
    sizes, held, kept = {r.part: r.b for r in rows.collect()}, 0, []
    for k in range(len(cuts) + 1):
        if k and held and held + sizes.get(k, 0) > shard_bytes:
            kept.append(k - 1)
            held = 0
        held += sizes.get(k, 0)
    return cuts.thinned(kept)


def _ranged(bounds: Bounds, keys: DataFrame) -> Column:
    """The range that each row's ``page_id`` and ``turn`` fall into."""

    @F.pandas_udf("bigint")
    def part(none: pd.Series, ids: pd.Series, turns: pd.Series) -> pd.Series:
        return pd.Series(bounds.part(none.to_numpy(), ids.to_numpy(), turns.to_numpy()))

    some = F.lit("0").cast(keys.schema["page_id"].dataType)  # a column without nulls keeps large ids exact
    return part(F.col("page_id").isNull(), F.coalesce("page_id", some), F.col("turn"))


def _moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Give files their names; a task that runs again finds some moved already."""
    from pyarrow.fs import FileType

    for b in batches:
        for draft, path in zip(b["draft"], b["path"], strict=True):
            (fs, old), (_, new) = _opened(draft), _opened(path)
            if fs.get_file_info(old).type != FileType.NotFound:
                fs.move(old, new)
            elif fs.get_file_info(new).type == FileType.NotFound:
                raise FileNotFoundError(draft)
        yield b.drop(columns="draft")


def write(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the rows (page_id, url, html) as WARC files under ``path``; the manifest.

    Equal payloads of at least 1000 bytes are stored once, in the record of the largest page id;
    all others revisit it. Rows that repeat that id and payload are responses too. Null html is
    an empty payload, a null url gives no target header, rows without a page id come first and
    revisit a known one. Rows with equal ids and payloads stand in one shard. An empty table
    gives an empty manifest. Other columns aren't read. A path that has a manifest is refused
    with FileExistsError; what an earlier writer left there without one does no harm. The path
    is taken as Hadoop takes it, and files are written through the same file system; one that
    tasks can't open is refused with ValueError before anything is written. Payloads of any
    length are one record, however large a shard or a file should be.
    """
    spark = pages.sparkSession
    path = qualified(spark, path).rstrip("/")
    opened_uri(path)
    if hadoop_path(spark, f"{path}/manifest", lambda fs, p: fs.exists(p)):
        raise FileExistsError(f"{path}/manifest")
    html = F.coalesce(pages["html"], F.lit(""))
    turn = lambda digest: F.xxhash64(digest).alias("turn")
    narrow = pages.select(pages["page_id"], F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("digest"))
    narrow = written(narrow.select("*", turn("digest")), "digests")
    large = narrow.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    first = large.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = written(first.filter("n > 1").drop("n"), "copies")  # a table of its own, so that a digest with many pages is split when joined
    again = large.join(first, ["digest", "payload_bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    bounds = _bounds(narrow, shard_bytes)
    null = F.lit(None).cast("string")
    notes = again.select("page_id", "turn", null.alias("url"), null.alias("html"), "digest", F.col("first_id").alias("refers_to"), F.lit(0).alias("kind")).distinct()
    kind = pages.schema["page_id"].dataType
    rows = pages.select("page_id", turn(F.sha1(html)), pages["url"], html.alias("html"), null.alias("digest"), F.lit(None).cast(kind).alias("refers_to"), F.lit(1).alias("kind"))
    both = notes.union(rows)
    both = both.withColumn("shard", _ranged(bounds, both))
    n_shards = len(bounds) + 1
    tasks = min(TASKS, n_shards)
    both = both.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {n_shards} as int)"))
    ids = lambda c: F.col(c).cast("string").alias(c)
    both = both.sortWithinPartitions("shard", "page_id", "turn", "kind", "url", "html")
    both = both.select("shard", ids("page_id"), "url", "html", "digest", ids("refers_to"), "kind")
    attempt = f"{path}/files-{uuid.uuid4().hex}"
    drafts = f"{attempt}/drafts"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at, known = _Writer(drafts, roll_bytes), object(), {}
        for b in batches:
            for shard, page_id, url, text, digest, refers_to, what in b.itertuples(index=False):
                if page_id != at:
                    at, known = page_id, {}
                if what == 0:
                    known[digest] = refers_to
                    continue
                payload = text.encode("utf-8", "surrogatepass")
                to = known.get(hashlib.sha1(payload).hexdigest()) if known else None
                out.add(int(shard), record(page_id, url, payload, to, to is not None), len(payload))
            yield out.taken()
        out.close()
        yield out.taken()

    files = written(both.mapInPandas(run, FILES), "files")
    name = F.concat(F.lit(f"{attempt}/part-"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit("-"), F.lpad(F.col("number").cast("string"), 5, "0"), F.lit(".warc.gz"))
    files = files.withColumn("path", name).select(*[c.split()[0] for c in MANIFEST.split(", ")], "draft")
    draft = f"{path}/manifest-{uuid.uuid4().hex}"
    files.mapInPandas(_moved, MANIFEST).write.parquet(draft)
    rename(spark, draft, f"{path}/manifest")
    hadoop_path(spark, drafts, lambda fs, p: fs.delete(p, True))
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _members(path: str) -> Iterator[bytes]:
    """The records of one file, one in memory at a time."""
    fs, inner = _opened(path)
    with fs.open_input_stream(inner, compression=None) as f:
        engine, parts = zlib.decompressobj(31), []
        data = f.read(1 << 20)
        while data:
            parts.append(engine.decompress(data))
            data = engine.unused_data if engine.eof else f.read(1 << 20)
            if engine.eof:
                yield b"".join(parts)
                engine, parts = zlib.decompressobj(31), []
                data = data or f.read(1 << 20)


def parsed(data: bytes) -> dict:
    """One record's fields, with both digests checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't match its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if fields["WARC-Block-Digest"][5:] != _base32(hashlib.sha1(block).hexdigest()):
        raise ValueError("a block's digest doesn't match its header")
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(stated["Content-Length"])):
        raise ValueError("a payload's digest doesn't match its header")
    return {
        "page_id": fields.get("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": int(stated["Content-Length"]),
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": fields.get("X-Refers-To-Page-ID"),
    }


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the files that a manifest names; page ids as strings."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if with_payload else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                rows, held = [], 0
                for data in _members(path):
                    rows.append({k: v for k, v in parsed(data).items() if k in names})
                    held += len(data) if with_payload else 200
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    files = manifest.select("path").repartition(max(1, min(10_000, manifest.count())), "path")
    return files.mapInPandas(run, schema + (", url string, payload binary" if with_payload else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = read(write(pages, new_path(spark, "warc")))
    kind = pages.schema["page_id"].dataType
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
