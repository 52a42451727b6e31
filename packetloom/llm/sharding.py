"""Sharding with size-tiered compaction and a versioned manifest. Column functions only.

A store is a folder with ``data`` (immutable Parquet shards) and ``manifest`` (one folder per
version: a table of the shards that make up that version). ``append`` writes arrivals as small
shards without a shuffle, from tasks whose number follows the bytes and not the input's splits. ``compact`` puts the shards of a version into tiers by size (all below
a sixteenth of the target are one tier), lines up each tier, cuts the line at the target size and
rewrites every cut of at least ``FANOUT`` shards, or of half the target, as one shard, until no
cut qualifies. A version is written under a temporary name and takes effect by one rename, which
fails if that version exists already. The ``KEPT`` latest versions stay readable; shards that only
older ones name are deleted, an arrival at a time.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm._shared import fresh, hadoop_path, new_path, rename, table

TARGET_BYTES = 128 << 20
FANOUT = 4
ARRIVALS = 8
#: Versions whose shards are kept.
KEPT = 2
#: A shard of an arrival is closed at this many rows.
ARRIVAL_ROWS = 100_000
#: An append has at most this many writing tasks, or one for each ``WRITER_BYTES`` if that is more.
WRITERS = 64
WRITER_BYTES = 4 * TARGET_BYTES
MANIFEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("arrival", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("version", T.LongType()),
])


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that needs no Python worker."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


class Store:
    """Shards of rows with one schema under ``path``; ``size`` is the column with each row's bytes."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, size: str):
        self.spark, self.path, self.schema, self.size = spark, path, schema, size

    def versions(self) -> list[int]:
        def found(fs, p):
            return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

        return sorted(int(m[1]) for x in hadoop_path(self.spark, f"{self.path}/manifest", found) if (m := re.fullmatch(r"v(\d+)", x)))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, the latest by default; none before the first commit."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return no_rows(self.spark, MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version:08d}")

    def commit(self, shards: DataFrame, version: int) -> None:
        """Make ``shards`` the given version, or fail if another writer has done so."""
        draft = f"{self.path}/manifest/draft-{uuid.uuid4().hex}"
        shards.coalesce(8).write.parquet(draft)
        rename(self.spark, draft, f"{self.path}/manifest/v{version:08d}")

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version with their shard's path in the column ``self.shard``."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]  # one per shard, as Spark's own listing
        if not paths:
            return no_rows(self.spark, self.schema).withColumn(self.shard, F.lit(None).cast("string"))
        return self.spark.read.schema(self.schema).parquet(*paths).withColumn(self.shard, F.col("_metadata.file_path"))

    @property
    def shard(self) -> str:
        return fresh(no_rows(self.spark, self.schema), "shard_path")

    def _listed(self, folder: str, by: str, version: int) -> DataFrame:
        """Manifest rows of the files that one write left in ``folder``."""
        where = re.escape(by) + r"=([^/]*)"
        files = self.spark.read.schema(T.StructType([self.schema[self.size]])).option("recursiveFileLookup", "true").parquet(folder)
        files = files.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col(f"`{self.size}`")), F.lit(0)).alias("bytes"))
        return files.select("path", F.regexp_extract("path", where, 1).alias("arrival"), "rows", "bytes", F.lit(version).cast("long").alias("version"))

    def _write(self, rows: DataFrame, by: str) -> str:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", ARRIVAL_ROWS if by == "arrival" else 0).partitionBy(rows.columns[-1]).parquet(folder)
        return folder

    def append(self, rows: DataFrame, arrival: Column) -> None:
        """Commit a version with the rows added, as the small shards of each arrival.

        Splits are put together without a shuffle (never taken apart), so an append leaves at
        most as many files as writing tasks times arrivals, beside those that ``ARRIVAL_ROWS`` closes.
        """
        version = max(self.versions(), default=0) + 1
        name = fresh(rows, "arrival")
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(f"`{self.size}`")), F.lit(0))).first()
        if not n:
            return self.commit(self.manifest(version - 1), version)
        folder = self._write(rows.withColumn(name, arrival).coalesce(max(WRITERS, -(-total // WRITER_BYTES))), "arrival")
        self.commit(self.manifest(version - 1).unionByName(self._listed(folder, name, version)), version)

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        """Merge similarly sized shards towards the target size, a version for each round."""
        while True:
            version = max(self.versions(), default=0)
            shards = self.manifest(version)
            tier = F.floor(F.log(float(fanout), F.greatest(F.col("bytes"), F.lit(target // fanout**2), F.lit(1)).cast("double")))
            line = Window.partitionBy("tier").orderBy("arrival", "path")
            small = shards.filter(F.col("bytes") < target // 2).withColumn("tier", tier)
            small = small.withColumn("before", F.sum("bytes").over(line) - F.col("bytes"))
            small = small.withColumn("cut", F.struct("tier", F.floor(F.col("before") / target).alias("n")))
            group = Window.partitionBy("cut")
            small = small.withColumn("members", F.count(F.lit(1)).over(group)).withColumn("total", F.sum("bytes").over(group))
            due = (F.col("members") >= fanout) | ((F.col("members") > 1) & (F.col("total") >= target // 2))
            run = F.concat_ws("-", F.lit("run"), F.col("cut.tier"), F.col("cut.n"))
            merges = small.filter(due).select("path", run.alias("run"))
            chosen = [r.path for r in merges.select("path").collect()]
            if not chosen:
                return
            rows = self.spark.read.schema(self.schema).parquet(*chosen)
            at, name = fresh(rows, "file"), fresh(rows, "run")
            merges = merges.select(F.col("path").alias(at), F.col("run").alias(name))
            rows = rows.withColumn(at, F.col("_metadata.file_path")).join(merges, at).drop(at)
            folder = self._write(rows.repartition(name).sortWithinPartitions(name), "run")
            kept = shards.join(merges.withColumnRenamed(at, "path"), "path", "left_anti")
            self.commit(kept.unionByName(self._listed(folder, name, version + 1)), version + 1)
            self.vacuum()

    def vacuum(self, keep: int = KEPT) -> None:
        """Drop all but the latest ``keep`` versions, and the folders of shards that none of those names.

        A folder is an arrival's or that of one merged shard, so this takes a call for each of
        them, however many shards an arrival has.
        """
        versions = self.versions()
        folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
        folders = lambda some: reduce(DataFrame.union, [self.manifest(v).select(folder) for v in some]).distinct()
        if len(versions) <= keep:
            return
        for r in folders(versions[:-keep]).join(folders(versions[-keep:]), "folder", "left_anti").toLocalIterator():
            hadoop_path(self.spark, r.folder, lambda fs, p: fs.delete(p, True))
        for v in versions[:-keep]:
            hadoop_path(self.spark, f"{self.path}/manifest/v{v:08d}", lambda fs, p: fs.delete(p, True))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrivals: int = ARRIVALS, target: int = TARGET_BYTES) -> tuple[DataFrame, Store]:
    """The rows of ``docs`` as read back from a new compacted store, with their shard; the store.

    Added columns: the row's bytes and its shard's path (``row_bytes`` and ``shard_path``, or the
    next free names). Arrivals are dealt by a hash of id and text. Null texts count no bytes,
    null ids are ids like any other, repeated rows are stored as often as they come, a text
    longer than a shard makes a larger shard. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    size = fresh(docs, "row_bytes")
    rows = docs.withColumn(size, text_bytes(docs[text_col]))
    store = Store(spark, new_path(spark, "store"), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]), size)
    store.append(rows, F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(arrivals)))
    store.compact(target)
    return store.rows(), store


def _numbered(rows: DataFrame, store: Store, keep: list[Column]) -> DataFrame:
    """``keep`` with each row's bytes and the number, rows and bytes of its shard."""
    shards = store.manifest().withColumn("number", (F.row_number().over(Window.orderBy("arrival", "path")) - 1).cast("long"))
    shards = shards.select("path", F.struct("number", "rows", "bytes").alias("of"))
    out = rows.select(*keep, F.col(store.size).alias("n_bytes"), F.col(store.shard).alias("of_path")).join(shards, F.col("of_path") == F.col("path"))
    out = out.withColumn("shard", F.col("of.number")).withColumn("shard_rows", F.col("of.rows")).withColumn("shard_bytes", F.col("of.bytes"))
    return out.drop("of", "path", "of_path")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the store returns it, and whether its shard is as the manifest says.

    That is so if the shard's rows and bytes, counted from the rows read back, are those of the
    manifest, and the shard keeps to the target size.
    """
    rows, store = shard(table(spark, sf_dir, "documents"))
    path, size = F.col(store.shard), F.col(store.size)
    counted = rows.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.max(size).alias("longest"))
    agrees = (F.col("n") == F.col("rows")) & (F.col("total") == F.col("bytes")) & (F.col("bytes") <= 2 * F.lit(TARGET_BYTES) + F.col("longest"))
    found = store.manifest().join(counted, "path", "left").select("path", F.coalesce(agrees, F.lit(False)).alias("shard_agrees"))
    out = rows.select("doc_id", size.alias("n_bytes"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), path.alias("of_path"))
    return out.join(found, F.col("of_path") == F.col("path"), "left").select("doc_id", "n_bytes", "text_md5", F.coalesce("shard_agrees", F.lit(False)).alias("shard_agrees"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: every document row with the shard that holds it.

    All rows come back, repeated ones as often as they came, null ids and texts too; a null text
    has no bytes. An empty table gives no rows. Other columns are stored, but not returned.
    """
    rows, store = shard(docs)
    return _numbered(rows, store, [F.col(c) for c in ("doc_id", "lang", "source", "n_chars")])


#: Which shard holds a row depends on the files that the arrivals were written as, so SQL has the rows only.
ORACLE = """
SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS text_md5, true AS shard_agrees
FROM documents
"""
