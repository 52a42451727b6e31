"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of its rows, so that a source that holds a third of
all rows is many blocks of the usual size. A source's target says how many passes over its
blocks the mix takes and how far the last pass goes. The blocks so due (tickets) are shared
out by a binary tree over the output shards: each node draws, without replacement, how many
tickets of each source its left half gets, so that every shard has its exact share of tickets
and the quotas of each source add up. Shards get disjoint ranges of a source's tickets; as
blocks are numbered by hash, a range is a random draw. Within a shard rows are ordered by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm._shared import fresh, let, n_words_of, table, written

WEIGHTS = (5, 2, 1)
OVERALL = 1.5
CAP = 2.0
SEED = 20_24
BLOCK_WORDS = 1_000_000
BLOCK_ROWS = 2_000
SHARD_WORDS = 50_000_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, overall: float = OVERALL, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_rows, src, target) from (source, source_size, n_rows).

    Sources in code-point order, null last, weigh ``weights`` in turn. With sources ordered by
    the level at which they reach their cap, the level that spends the rest on all later ones
    is the answer at the first source that it leaves below its cap. Windows run over sources,
    of which a mixture has few, never over rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    s = sources.withColumn("src", src).withColumn("w", weight).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), "src")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("all", F.sum("source_size").over(every) * overall)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "src", "level"))).over(every)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most")))
    return s.select("source", "source_size", "n_rows", "src", target.cast("double").alias("target"))


def split(quotas: np.ndarray, shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, quota of each source, its first ticket of each source) for shards first..last-1 of the tree.

    A node's draw depends on the seed and the node alone, so tasks that walk the same node agree.
    """
    todo = [(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64))]
    while todo:
        lo, hi, q, at = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, q, at
            continue
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(q, n, method="marginals")
        todo.append((mid, hi, q - left, at + left))
        todo.append((lo, mid, left, at))


def _fit(rows: Column, room: Column) -> Column:
    """(room left, keys) after the rows that still fit are taken in the given order."""
    start = F.struct(room.alias("room"), F.array().cast("array<bigint>").alias("keys"))
    step = lambda a, x: F.when(
        x["size"] <= a["room"], F.struct((a["room"] - x["size"]).alias("room"), F.concat(a["keys"], F.array(x["key"])).alias("keys"))
    ).otherwise(a)
    return F.aggregate(rows, start, step)


def _fitting(rows: Column, room: Column) -> Column:
    """Keys of (key, size) rows that come near ``room`` words: most by chance, the rest by size, largest first."""

    def rest(first: Column) -> Column:
        others = F.filter(rows, lambda x: ~F.array_contains(first["keys"], x["key"]))
        others = F.sort_array(F.transform(others, lambda x: F.struct(x["size"].alias("size"), x["key"].alias("key"))), asc=False)
        return F.concat(first["keys"], _fit(others, first["room"] + 0.2 * room)["keys"])

    return let(_fit(F.array_sort(rows), 0.8 * room), rest)


def placed(
    rows: DataFrame,
    key: Column,
    size: Column,
    source: Column,
    seed: int = SEED,
    block_words: int = BLOCK_WORDS,
    block_rows: int = BLOCK_ROWS,
    shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, str]:
    """``rows`` with one struct column (size, source_size, target, shards, key); the column's name.

    ``shards`` lists the output shard of each copy that the mix takes, none to two. ``key``
    identifies a row; rows with equal keys share their fate.
    """
    spark = rows.sparkSession
    mixed = fresh(rows, "mixed")
    slim = written(rows.select(F.xxhash64(F.lit(seed), key).alias("key"), size.cast("long").alias("size"), source.alias("source")), "sized")
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    share = written(targets(sums).withColumn(
        "n_blocks",
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words), F.ceil(F.col("n_rows") / block_rows)).cast("long"),
    ), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    dues = share.withColumn("passes", F.least(whole, F.lit(CAP).cast("long")).cast("long"))
    dues = dues.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))

    numbered = slim.join(share.select(F.col("source").alias("s"), "src", "n_blocks"), F.col("source").eqNullSafe(F.col("s")))
    numbered = numbered.select("src", F.expr("pmod(key, n_blocks)").alias("block"), "key", "size")
    blocks = numbered.groupBy("src", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("src").orderBy("block")
    blocks = blocks.withColumn("rank", F.row_number().over(order) - 1)
    blocks = blocks.withColumn("start", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
    blocks = blocks.withColumn("nb", F.count(F.lit(1)).over(Window.partitionBy("src")))
    blocks = blocks.join(dues.drop("n_blocks"), "src")
    blocks = blocks.withColumn("last", (F.col("start") < F.col("rest")).cast("long"))
    blocks = blocks.withColumn("room", F.when((F.col("last") == 1) & (F.col("start") + F.col("words") > F.col("rest")), F.col("rest") - F.col("start")))
    blocks = written(blocks, "blocks")

    # of the one block of each source that the last pass takes a part of, the rows that fit
    cut = blocks.filter("room IS NOT NULL").select("src", "block", "room")
    parts = numbered.join(cut, ["src", "block"]).groupBy("src", "block", "room", "key").agg(F.sum("size").cast("double").alias("size"))
    fitting = parts.groupBy("src", "block", "room").agg(F.collect_list(F.struct("key", "size")).alias("rows"))
    fitting = fitting.select("src", "block", _fitting(F.col("rows"), F.col("room")).alias("fitting"))

    quota = blocks.groupBy("src").agg(F.max(F.col("passes") * F.col("nb")).alias("full"), F.sum("last").alias("more"))
    drawn = quota.join(share.select("src", "target"), "src").select("src", (F.col("full") + F.col("more")).alias("n"), "target").orderBy("src").collect()  # one row per source
    n_shards = max(1, round(sum(r.target for r in drawn) / shard_words))
    quotas, numbers = np.array([r.n for r in drawn], np.int64), [r.src for r in drawn]

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            for shard, q, at in split(quotas, n_shards, int(b["id"].min()), int(b["id"].max()) + 1, seed):
                yield pd.DataFrame({"shard": shard, "src": numbers, "n": q, "at": at})

    tickets = spark.range(n_shards).mapInPandas(leaves, "shard bigint, src int, n bigint, at bigint").filter("n > 0")
    tickets = tickets.select("src", "shard", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("ticket"))
    tickets = tickets.join(blocks.select("src", "nb").distinct(), "src")
    taken = tickets.select("src", (F.col("ticket") % F.col("nb")).cast("int").alias("rank"), F.floor(F.col("ticket") / F.col("nb")).alias("pass"), "shard")
    taken = taken.groupBy("src", "rank").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("copies"))  # at most two or three
    plan = blocks.join(taken, ["src", "rank"], "left").join(fitting, ["src", "block"], "left")
    own = [F.col(x).alias(f"mix-{x}") for x in ("source_size", "target", "passes", "copies", "fitting")]
    plan = written(plan.select(F.col("src").alias("mix-src"), F.col("block").alias("mix-block"), *own, F.col("room").isNotNull().alias("mix-cut")), "plan")

    # columns of the plan have a hyphenated prefix, so they don't meet those of ``rows``
    named = share.select(F.col("source").alias("mix-source"), F.col("src").alias("mix-src"), F.col("n_blocks").alias("mix-blocks"))
    out = rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.xxhash64(F.lit(seed), key).alias("mix-key"), size.cast("long").alias("mix-size"), source.alias("mix-own"))
    out = out.join(named, F.col("mix-own").eqNullSafe(F.col("mix-source")))
    out = out.withColumn("mix-block", F.expr("pmod(`mix-key`, `mix-blocks`)")).join(plan, ["mix-src", "mix-block"])
    in_part = F.coalesce(F.array_contains("mix-fitting", F.col("mix-key")), F.lit(False))
    copies = F.coalesce("mix-copies", F.array().cast("array<struct<pass:bigint,shard:bigint>>"))
    copies = F.filter(copies, lambda x: ~F.col("mix-cut") | (x["pass"] < F.col("mix-passes")) | in_part)
    struct = F.struct(
        F.col("mix-size").alias("size"), F.col("mix-source_size").alias("source_size"), F.col("mix-target").alias("target"),
        F.transform(copies, lambda x: x["shard"]).alias("shards"), F.col("mix-key").alias("key"),
    )
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], struct.alias(mixed)), mixed


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **sizes) -> DataFrame:
    """(id, size, source_size, target, taken, shards) for every row of ``docs``.

    Null and blank texts have size 0 and nothing to take. Null is a source of its own, the last
    one. A row is taken whole or not at all in each pass; the last pass over a source ends
    within one short row of its target. Rows that repeat an id with the same size share their
    fate. An empty table gives an empty result. Other columns aren't read.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), n_words_of(docs[text_col]).alias("size"))
    slim = written(slim, "slim")
    out, m = placed(slim, F.struct("id", "size"), F.col("size"), F.col("source"), **sizes)
    c = lambda x: F.col(f"{m}.{x}")
    return out.select(
        F.col("id").alias(id_col), c("size").alias("size"), c("source_size").alias("source_size"), c("target").alias("target"),
        (c("size") * F.size(c("shards"))).cast("long").alias("taken"), c("shards").alias("shards"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed documents, a row per copy taken, by output shard and shuffled within it.

    Texts without words go where their block goes and use up nothing; a source without any words
    is left out. Null sources are one source, null ids are ids like any other, rows equal in id and
    text share their fate, an empty table stays empty, and any other columns are passed on.
    """
    out, m = placed(docs, F.struct(docs["doc_id"], docs["text"]), n_words_of(docs["text"]), docs["source"])
    shard, turn = fresh(out, "shard"), fresh(out, "turn")
    copies = out.select("*", F.posexplode(F.col(f"{m}.shards")).alias(turn, shard))
    copies = copies.repartition(F.col(shard), F.xxhash64(F.col(f"{m}.key")) % 16)
    copies = copies.sortWithinPartitions(shard, F.xxhash64(F.lit(SEED), F.col(f"{m}.key"), F.col(turn)))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
