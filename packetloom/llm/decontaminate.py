"""Benchmark decontamination by winnowing.

Words are hashed, five consecutive word hashes make a gram, and of every six consecutive grams
the least (the last such) is kept. A shared span of ten words covers six grams, so document
and item keep the same one there: no shared span of ten words or more is missed. Where a kept gram
of a document is one of the items', it is extended to the windows of ten words that hold it, and
these are joined with the items' windows word by word; overlapping windows make one run. So a
phrase shorter than a window, however many items and documents share it, joins nothing. An item of
fewer than ten words is one gram and one window of its own length, looked for at every word.

One pass reads the documents. What leaves it of a text are the windows about grams that some item
has too. The set of the items' grams goes to the executors to tell that, if it has at most
``broadcast_grams`` members; beyond that grams are joined, and the texts of documents that have
one in common are extended in a second step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._shared import LOWER, UPPER, fresh, table, written

WINDOW = 10
GRAM = 5
GRAMS = WINDOW - GRAM + 1
BROADCAST_GRAMS = 2_000_000
_WORD_BYTES = bytes(
    ord(chr(b).lower()) if b in UPPER.encode() else b if b >= 0x80 or b in b"0123456789" or b in LOWER.encode() else 0x20
    for b in range(256)
)
_MULTIPLIERS = (np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, WINDOW, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class _Hashes(dict):
    """Word -> hash, remembered for words seen before; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, from the hashes of the words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.full(m, n, np.uint64)
    for j in range(n):
        total += hashes[j : j + m] * _MULTIPLIERS[j]
    total ^= total >> np.uint64(31)
    return total * _MULTIPLIERS[1]


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions of the grams to keep: the last least one of every ``GRAMS`` consecutive ones."""
    if len(grams) < GRAMS:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, GRAMS)
    return np.unique(np.arange(len(view)) + GRAMS - 1 - view[:, ::-1].argmin(axis=1))


def _kept_grams(words: list[bytes], cache: _Hashes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes as int64, positions, lengths of the windows meant) of a document's grams: winnowed ones, and all of the short lengths."""
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    grams = gram_hashes(hashes, GRAM)
    at = winnowed(grams)
    found, places, means = [grams[at]], [at], [np.full(len(at), WINDOW)]
    for n in lengths:
        short = gram_hashes(hashes, n)
        found.append(short + np.uint64(n))
        places.append(np.arange(len(short)))
        means.append(np.full(len(short), n))
    return np.concatenate(found).view(np.int64), np.concatenate(places), np.concatenate(means)


def around(words: list[bytes], places: np.ndarray, means: np.ndarray) -> list[tuple[int, int, str]]:
    """(first word, length, words) of the windows that hold the grams: all of ten words about a winnowed one, a short one itself."""
    starts = {(int(p), int(n)) for p, n in zip(places, means, strict=True) if n < WINDOW}
    starts |= {(a, WINDOW) for p, n in zip(places.tolist(), means.tolist(), strict=True) if n == WINDOW for a in range(max(0, p - GRAMS + 1), min(p, len(words) - WINDOW) + 1)}
    return [(a, n, b" ".join(words[a : a + n]).decode("utf-8", "surrogatepass")) for a, n in sorted(starts)]


WINDOWS = "array<struct<a:int,n:int,w:string>>"


def scanned(docs: DataFrame, id_col: str, text_col: str, lengths: list[int], known: np.ndarray | None) -> DataFrame:
    """(id, n_words, windows, body, h, p, n) of each row: windows where the items' grams are known, else the body and its grams."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Hashes()
        of_items = shared.value if shared is not None else None
        for b in batches:
            out = []
            for text in b["text"]:
                words = words_of(text)
                h, p, n = _kept_grams(words, cache, lengths)
                if of_items is None:
                    body = b" ".join(words).decode("utf-8", "surrogatepass") if len(h) else None
                    out.append((len(words), None, body, *((h, p, n) if len(h) else (None, None, None))))
                    continue
                common = of_items[np.minimum(np.searchsorted(of_items, h), len(of_items) - 1)] == h if len(of_items) else np.zeros(len(h), bool)
                windows = [{"a": a, "n": m, "w": w} for a, m, w in around(words, p[common], n[common])] if common.any() else None
                out.append((len(words), windows, None, None, None, None))
            names = ("n_words", "windows", "body", "h", "p", "n")
            yield pd.DataFrame({"id": b["id"], **{c: pd.Series([x[k] for x in out], dtype=object) for k, c in enumerate(names)}})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n_words bigint, windows {WINDOWS}, body string, h array<bigint>, p array<bigint>, n array<bigint>")


def extended(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, windows) of the scanned rows that have one of ``grams`` (h): each text goes once, to where its grams in common are."""
    each = rows.filter("body IS NOT NULL").select("row", F.explode(F.arrays_zip("h", "p", "n")).alias("g")).select("row", "g.h", "g.p", "g.n")
    common = each.join(grams, "h", "left_semi").groupBy("row").agg(F.collect_list("p").alias("at"), F.collect_list("n").alias("means"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            windows = [[{"a": a, "n": n, "w": w} for a, n, w in around(body.encode("utf-8", "surrogatepass").split(b" "), np.asarray(p), np.asarray(m))] for body, p, m in zip(b["body"], b["at"], b["means"], strict=True)]
            yield pd.DataFrame({"row": b["row"], "windows": windows})

    return common.join(rows.select("row", "body"), "row").select("row", "body", "at", "means").mapInPandas(run, f"row bigint, windows {WINDOWS}")


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n, h, w): the items' kept grams and windows; items without words or id have none."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Hashes()
        for b in batches:
            for i, text in zip(b["id"], b["text"], strict=True):
                words = words_of(text)
                if not words:
                    continue
                n = min(WINDOW, len(words))
                hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                if len(words) < WINDOW:
                    h = gram_hashes(hashes, n) + np.uint64(n)
                else:
                    grams = gram_hashes(hashes, GRAM)
                    h = np.unique(grams[winnowed(grams)])
                windows = sorted({b" ".join(words[k : k + n]).decode("utf-8", "surrogatepass") for k in range(len(words) - n + 1)})
                yield pd.DataFrame({"item_id": [i], "n": [n], "h": [h.view(np.int64)], "w": [windows]})

    rows = items.select(items[id_col].alias("id"), items[text_col].alias("text")).filter("id IS NOT NULL")
    return rows.mapInPandas(run, f"item_id {kind}, n bigint, h array<bigint>, w array<string>")


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Null and blank texts have no words and no hits. Items without words never occur; items
    without an id can't be named and are left out; rows that repeat an item's id are one item
    whose windows are those of all its rows. Repeated documents each give a row. Empty tables
    on either side give no hits. Other columns aren't read, so their names don't matter.
    """
    items = written(item_windows(benchmark, item_col, item_text), "items")
    lengths = sorted(r[0] for r in items.filter(F.col("n") < WINDOW).select("n").distinct().collect())  # at most 9
    grams = items.select(F.explode("h").alias("h")).distinct()
    known = None
    if grams.limit(broadcast_grams + 1).count() <= broadcast_grams:
        known = np.sort(np.array([r[0] for r in grams.collect()], dtype=np.int64))
    rows = written(scanned(docs, id_col, text_col, lengths, known).withColumn("row", F.monotonically_increasing_id()), "scanned")
    mine = rows.filter("windows IS NOT NULL").select("row", "windows") if known is not None else extended(rows, grams)
    mine = mine.select("row", F.explode("windows").alias("x")).select("row", "x.a", "x.n", "x.w")
    theirs = items.select(F.col("item_id").cast("string").alias("item_id"), F.explode("w").alias("w")).distinct()
    found = mine.join(theirs, "w").select("row", F.struct(F.col("a").cast("bigint").alias("s"), (F.col("a") + F.col("n")).cast("bigint").alias("e")).alias("span"), "item_id")
    merged = lambda spans: F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
    )["n"]
    by_row = found.groupBy("row").agg(F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items"))
    by_row = by_row.select(
        "row",
        merged(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
    )
    out = rows.select("row", F.col("id").alias(id_col), "n_words").join(by_row, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any benchmark window.

    Whether a text has one depends on the text alone, so texts are told apart by their digest:
    rows that share an id, or have none, go or stay each by its own text. Null, empty and blank
    texts stay, repeated rows go or stay alike, an empty table or benchmark takes nothing away,
    and any other columns are passed on.
    """
    digest, hit = fresh(docs, "digest"), fresh(docs, "hit_digest")
    keyed = docs.withColumn(digest, F.md5(F.coalesce(docs["text"], F.lit(""))))
    bad = hits(keyed, table(spark, sf_dir, "benchmark"), id_col=digest).filter("contaminated").select(F.col(digest).alias(hit)).distinct()
    return keyed.join(bad, keyed[digest] == bad[hit], "left_anti").drop(digest)


_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_SQL_WORD}')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
