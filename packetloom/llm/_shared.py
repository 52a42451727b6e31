"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space and the ASCII controls tab to carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word for the whitespace-word operators; the same text in Java, Python and RE2 syntax.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent in a session of one process (tests) a temporary folder is
    made; on a cluster executors would not see it, so there its absence is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/packetloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The result survives the loss of any executor. The files stay, as checkpoint files do,
    because the caller's lazy result reads them.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._packetloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of an intermediate result that nothing reads any more."""
    path = getattr(df, "_packetloom_path", None)
    if path:
        hadoop_path(df.sparkSession, path, lambda fs, p: fs.delete(p, True))


def hadoop_path(spark: SparkSession, path: str, act):
    """Call ``act(filesystem, path)`` with Hadoop's file system for the path's scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return act(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Hadoop takes it for, which on a cluster need not be the machine's own."""
    return hadoop_path(spark, path, lambda fs, p: fs.makeQualified(p).toString())


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder in one step; an error if that fails or the target exists."""
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(jvm.Path(source).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(jvm.Path(source), jvm.Path(target), spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once per row, also where lambdas in ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The whitespace words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def sample_by_hash(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hash of the columns ``by``.

    A threshold on the hash first thins a large table to a few times as many rows, so that no
    more than that is sorted or sent anywhere, however many tasks there are.
    """
    name = fresh(df, "hash")
    df = df.withColumn(name, F.xxhash64(*by))
    total = df.count()
    if total > 8 * most:
        df = df.filter(F.col(name) < -(1 << 63) + (1 << 64) * 4 * most // total)
    return df.orderBy(name, *by).limit(most).drop(name)
