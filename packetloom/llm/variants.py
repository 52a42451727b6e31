"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling, and each word's usual form.

Two words are one inserted, deleted or replaced code point apart if, and only if, the lengths of
their common prefix and their common suffix together reach the longer length less one. Blocks of
words become padded matrices of code points, once from the left and once from the right, and a
tile compares all rows of one block with all of another, column by column.

Which blocks meet is decided by where the edit can be. For a longer length m, an edit in the first
half leaves the last half alone, and the other way round, so words meet only under the half that
they share, and a group whose words are too many for a task is dealt again by halves of the part
in which the edit lies, down to a single place, which no more words share than there are letters.
Every pair has one place of edit (the end of the common prefix), so it is found exactly once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._shared import table, written

#: Least code points and occurrences of a word, and how many times as common its form must be.
LETTERS = 6
LEAST = 5
TIMES = 5
#: One in so many (document, run) pairs has a letter taken out.
MISSPELT = 199
#: Rows of a block, and code points of a group beyond which it is dealt again.
TILE = 256
GROUP_CELLS = 1 << 16
#: Different words that a task counts before it hands them on, and rows it hands on at once.
HELD = 300_000
HANDED = 50_000
_LETTER = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """The runs of letters up to U+00FF in a text, A-Z lower-cased, one byte a letter."""
    return (text or "").encode("latin-1", "replace").translate(_LETTER).split(b" ")


def counted(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n): words of at least ``letters`` code points with at least ``least`` occurrences in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sums() -> Iterator[pa.RecordBatch]:
            words, n = list(total), list(total.values())
            for k in range(0, len(words), HANDED):
                part = slice(k, k + HANDED)
                yield pa.record_batch({"word": pa.array([w.decode("latin-1") for w in words[part]], pa.string()), "n": pa.array(n[part], pa.int64())})
            total.clear()

        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                seed = zlib.crc32(f"{i or ''}:".encode())
                for w, n in Counter(w for w in runs(text) if len(w) >= letters).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
                    if h % misspelt == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                    total[w] += n
            if len(total) > HELD:
                yield from sums()
        yield from sums()

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) & (F.length("word") >= letters))


def matrix(words: list[str], pad: int, backwards: bool = False) -> np.ndarray:
    """Code points of words, a row each, padded on the right; with ``backwards`` from the last to the first."""
    size = np.array([len(w) for w in words])
    out = np.full((len(words), int(size.max())), pad, np.uint32)
    text = "".join(w[::-1] for w in words) if backwards else "".join(words)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return out.astype(np.uint8 if out.max() < 256 else np.uint32)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns each row of ``a`` has in common with each row of ``b`` from the left."""
    alike, n = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for c in range(min(a.shape[1], b.shape[1])):
        alike &= a[:, c, None] == b[None, :, c]
        if not alike.any():
            break
        n += alike
    return n


def tiled(x: pd.DataFrame, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j), i < j, of words one edit apart; ``x`` has word, m, lo, hi, key and is in order of key."""
    words, key = x["word"].tolist(), x["key"].to_numpy()
    size, m, lo, hi = np.array([len(w) for w in words]), x["m"].to_numpy(), x["lo"].to_numpy(), x["hi"].to_numpy()
    for a in range(0, len(words), tile):
        i = slice(a, min(a + tile, len(words)))
        left = [matrix(words[i], 0, back) for back in (False, True)]
        for b in range(a, len(words), tile):
            if b > a and key[b] != key[i.stop - 1]:
                break
            j = slice(b, min(b + tile, len(words)))
            prefix, suffix = (common(u, matrix(words[j], 1, back)) for u, back in zip(left, (False, True), strict=True))
            longer = np.maximum(size[i, None], size[None, j])
            near = (prefix + suffix >= longer - 1) & (longer == m[i, None]) & (key[i, None] == key[None, j]) & (prefix >= lo[i, None]) & (prefix < hi[i, None])
            if a == b:
                near = np.triu(near, 1)
            p, q = np.nonzero(near)
            yield p + a, q + b


def _keyed(rows: DataFrame) -> DataFrame:
    """Key of the part that words share if the edit of a word of length m lies in [lo, hi)."""
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", F.expr("left(word, lo)"), F.expr("right(word, m - hi)")))


def _halved(rows: DataFrame) -> DataFrame:
    mid = (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).cast("int")
    parts = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
    return _keyed(rows.withColumn("w", F.explode(parts)).select("word", "n", "m", "w.lo", "w.hi"))


def near(words: DataFrame, group_cells: int = GROUP_CELLS, tile: int = TILE) -> DataFrame:
    """(word, near, near_n) for each ordered pair of the distinct ``words`` (word, n) one edit apart, once."""
    size = F.length("word")
    rows = words.withColumn("m", F.explode(F.array(size, size + 1))).select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi"))
    rows, settled = _halved(rows), []
    while True:  # as many rounds as the longest word has halves, at most
        rows = written(rows, "keyed")
        large = (F.col("held") * F.col("m") > group_cells) & (F.col("hi") - F.col("lo") > 1)
        sizes = rows.groupBy("key", "m", "lo", "hi").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").withColumn("large", large)
        sizes = written(sizes.select("key", "held", "large"), "sizes")
        settled.append(rows.join(sizes.filter("NOT large").select("key"), "key", "left_semi"))
        if not sizes.filter("large").limit(1).count():
            break
        rows = _halved(rows.join(sizes.filter("large").select("key"), "key", "left_semi"))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in _ended(batches):
            x = pd.concat([rest, b], ignore_index=True) if rest is not None else b
            if b is not None and len(x):
                rest = x[x["key"] == x["key"].iloc[-1]]
                x = x.iloc[: len(x) - len(rest)].reset_index(drop=True)
            if x is None or not len(x):
                continue
            word, n = x["word"].to_numpy(), x["n"].to_numpy()
            for p, q in tiled(x, tile):
                if len(p):
                    yield pd.DataFrame({"word": np.append(word[p], word[q]), "near": np.append(word[q], word[p]), "near_n": np.append(n[q], n[p])})

    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    return every.repartition("key").sortWithinPartitions("m", "key").mapInPandas(pairs, "word string, near string, near_n bigint")


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    """The batches, then None."""
    yield from batches
    yield None


def variants(
    docs: DataFrame, letters: int = LETTERS, least: int = LEAST, times: int = TIMES, misspelt: int = MISSPELT, group_cells: int = GROUP_CELLS, tile: int = TILE
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts.

    The form is the near word of largest ``n``, of equals the first in code-point order, where it
    is at least ``times`` as common; the root ends the chain of forms. Null, empty and blank
    texts have no words, and an empty table no rows; texts and words of any length count whole.
    Repeated rows count each. A null id is taken as empty text where ids decide on misspelling.
    Only the id and the text are read, so other columns don't matter.
    """
    if times <= 1:
        raise ValueError("a form must be more common than the word")
    words = written(counted(docs, letters, least, misspelt), "words")
    links = near(words, group_cells, tile)
    best = links.groupBy(F.col("word").alias("of")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    fits = -F.col("best.n") >= times * F.col("n")
    rows = words.join(best, words["word"] == best["of"], "left")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"))
    rows = written(rows, "forms")
    most = rows.agg(F.max("form_n")).first()[0] or 1
    steps = int(math.log(most) / math.log(times)) + 1  # each form is ``times`` as common as what it is the form of
    chain = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, steps)))):  # a round doubles how far the root is
        after = chain.select(F.col("word").alias("at"), F.col("root").alias("next"))
        chain = written(chain.join(after, chain["root"] == after["at"], "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    ends = chain.withColumnRenamed("word", "of")
    return rows.join(ends, rows["word"] == ends["of"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
